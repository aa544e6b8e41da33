"""Language of code-switched text by a linear-chain conditional random field.

Every word (a run of letters that touches no digit; runs of over ``WORD_BYTES`` bytes, as scripts without blanks have
them, are cut between characters) gets one label per language. Emissions add learned weights of its prefixes, suffixes,
byte trigrams, of the word itself and of the lexicons it stands in; transitions between neighbouring words are
learned with them. Forward-backward gives each word's label probabilities; a document's language has the largest
share of them, and the share is its score.

The model knows every language that a label names. It is fitted on a bounded sample: about ``per_label`` labelled
documents of each language, fewer when they would pass ``sample_docs`` in all but one at least, of each at most
``sample_chars`` neighbouring characters from a place that a hash chooses. Texts of several languages are spliced into
training sequences, so that changes of language are seen. Prediction reads every word of every text.

Long texts are exact and vectorised: words are cut into segments, each segment's product of transition and emission
matrices carries the forward and backward messages across it, and then all segments run side by side. With more than
``WIDE`` labels such products cost more than walking the segments of all documents in order, which is done then.

Defined results: a null text, and one without a letter, is ``und`` with score 0; so is every text when nothing could
be learned. Letters are those of Unicode. Ties go to the label that sorts first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import SLICE_BYTES, extended, mix, own_names, slices, span_hasher, word_bounds

PER_LABEL, SAMPLE_DOCS, SAMPLE_CHARS = 400, 25600, 2000
BUCKETS = 1 << 16
SEGMENT = 64
WORD_BYTES = 24
#: Labels from which on segments are walked in order, and up to which a slice of text has its full size.
WIDE = 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_AFFIXES = (1, 2, 3, 4)
#: Words of a language's lexicon: seen this often in its sample, and nine times in ten there.
_LEXICON_COUNT, _LEXICON_SHARE = 5, 0.9


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # feature bucket x label
    bias: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    lexicon_of: np.ndarray  # label of each
    lexicon_weights: np.ndarray  # lexicon x label
    transitions: np.ndarray  # label x label, logarithms
    start: np.ndarray


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and document of the words to label. Letters that touch a digit are pieces of keys and
    numbers, not words; only a document without other letters is read by them."""
    starts, ends, doc = word_bounds(data, offsets, _LETTER)
    if not len(starts):
        return starts, ends, doc
    digit = np.zeros(len(data) + 2, dtype=bool)
    digit[1:-1] = (data >= 0x30) & (data <= 0x39)
    begins, stops = offsets[doc], offsets[doc + 1]
    plain = ~(digit[starts] & (starts > begins)) & ~(digit[ends + 1] & (ends < stops))
    none = np.bincount(doc[plain], minlength=len(offsets))[doc] == 0
    keep = plain | none
    return _cut(data, starts[keep], ends[keep], doc[keep])


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of over ``WORD_BYTES`` bytes in parts of at most that many, cut where a character begins."""
    step = WORD_BYTES - 3
    parts = np.where(ends - starts > WORD_BYTES, -(-(ends - starts) // step), 1)
    if (parts == 1).all():
        return starts, ends, doc
    of = np.repeat(np.arange(len(starts)), parts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = starts[of] + step * number
    for _ in range(3):  # a character has at most three bytes after its first
        begin = begin - ((number > 0) & (data[begin] & 0xC0 == 0x80))
    last = np.concatenate((of[1:] != of[:-1], [True]))
    return begin, np.where(last, ends[of], np.append(begin[1:], 0)), doc[of]


def _word_slots(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of each word (the word, its prefixes and suffixes), and the words' hashes."""
    hashes = span_hasher(data)
    slots = [hashes(starts, ends)]
    for n in _AFFIXES:
        slots.append(mix(hashes(starts, np.minimum(starts + n, ends)) + np.uint64(101 * n)))
        slots.append(mix(hashes(np.maximum(ends - n, starts), ends) + np.uint64(103 * n + 7)))
    return np.stack([(s % np.uint64(BUCKETS)).astype(np.int32) for s in slots], axis=1), slots[0]


def _trigram_slots(data: np.ndarray) -> np.ndarray:
    """Feature bucket of the three bytes from each position."""
    d = data.astype(np.uint64)
    return (mix((d[:-2] << np.uint64(16)) | (d[1:-1] << np.uint64(8)) | d[2:]) % np.uint64(BUCKETS)).astype(np.int32)


def _emissions(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.tile(model.bias, (len(starts), 1)).astype(np.float64)
    slots, word = _word_slots(data, starts, ends)
    for column in slots.T:
        out += model.weights[column]
    if len(data) > 2:
        # A word's trigrams lie at positions start .. end - 3: differences of a running sum.
        sums = np.zeros((len(data) - 1, out.shape[1]))
        np.cumsum(model.weights[_trigram_slots(data)], axis=0, out=sums[1:], dtype=np.float64)
        out += sums[np.maximum(ends - 2, starts).clip(max=len(data) - 2)] - sums[starts.clip(max=len(data) - 2)]
    if len(model.lexicon):
        at = np.searchsorted(model.lexicon, word).clip(max=len(model.lexicon) - 1)
        known = model.lexicon[at] == word
        out[known] += model.lexicon_weights[model.lexicon_of[at[known]]]
    return out


def _messages(e: np.ndarray, mask: np.ndarray, a: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Marginals of (sequence, word, label). ``first`` is the message into the first word, transitions applied;
    ``last`` the message from what follows."""
    n, t, k = e.shape
    alpha = np.empty_like(e)
    now = first
    for i in range(t):
        step = now * e[:, i]
        step /= step.sum(axis=1, keepdims=True)
        alpha[:, i] = step
        now = step @ a
    beta = last.copy()
    for i in range(t - 1, -1, -1):
        own = alpha[:, i] * beta
        own /= own.sum(axis=1, keepdims=True)
        alpha[:, i] = own * mask[:, i, None]
        back = (e[:, i] * beta) @ a.T
        beta = np.where(mask[:, i, None], back / back.sum(axis=1, keepdims=True), beta)
    return alpha


def document_mass(model: Model, emissions: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Summed label probabilities of each document's words. ``doc`` ascends."""
    k = len(model.labels)
    if not len(doc):
        return np.zeros((docs, k))
    a, start = np.exp(model.transitions), np.exp(model.start)
    counts = np.bincount(doc, minlength=docs)
    begin = np.cumsum(counts) - counts
    number = np.arange(len(doc)) - begin[doc]
    parts = -(-counts // SEGMENT)
    part_base = np.cumsum(parts) - parts
    segment = part_base[doc] + number // SEGMENT
    n = int(parts.sum())
    e = np.ones((n, SEGMENT, k))
    mask = np.zeros((n, SEGMENT), dtype=bool)
    e[segment, number % SEGMENT] = np.exp(np.maximum(emissions - emissions.max(axis=1, keepdims=True), -60))
    mask[segment, number % SEGMENT] = True
    of = np.repeat(np.arange(docs), parts)
    within = np.arange(n) - part_base[of]
    first, last = np.tile(start, (n, 1)), np.ones((n, k))
    many = np.flatnonzero(parts[of] > 1)
    if len(many) and k > WIDE:
        for j in range(int(parts.max()) - 1):
            s = many[(within[many] == j) & (parts[of[many]] > j + 1)]
            now = first[s]
            for i in range(SEGMENT):
                now = (now * e[s, i]) @ a
                now /= now.sum(axis=1, keepdims=True)
            first[s + 1] = now
        for j in range(int(parts.max()) - 1, 0, -1):
            s = many[within[many] == j]
            now = last[s]
            for i in range(SEGMENT - 1, -1, -1):
                back = (now * e[s, i]) @ a.T
                now = np.where(mask[s, i, None], back / back.sum(axis=1, keepdims=True), now)
            last[s - 1] = now
    elif len(many):
        # across[s]: from the message into segment s to the message into the next one.
        across = np.tile(np.eye(k), (len(many), 1, 1))
        for i in range(SEGMENT):
            step = (across * e[many, i][:, None, :]) @ a
            step /= step.sum(axis=(1, 2), keepdims=True)
            across = np.where(mask[many, i][:, None, None], step, across)
        place = np.full(n, -1)
        place[many] = np.arange(len(many))
        for j in range(1, int(parts.max())):
            s = many[within[many] == j]
            first[s] = np.einsum("nk,nkl->nl", first[s - 1], across[place[s - 1]])
            first[s] /= first[s].sum(axis=1, keepdims=True)
        for j in range(int(parts.max()) - 2, -1, -1):
            s = many[(within[many] == j) & (parts[of[many]] > j + 1)]
            # The message from the next segment, before the transition into it.
            nxt = np.einsum("nkl,nl->nk", across[place[s + 1]], last[s + 1])
            last[s] = (nxt / nxt.sum(axis=1, keepdims=True)) @ a.T
            last[s] /= last[s].sum(axis=1, keepdims=True)
    mass = _messages(e, mask, a, first, last).sum(axis=1)
    return np.add.reduceat(mass, part_base[parts > 0], axis=0) if (parts > 0).all() else _scatter(mass, of, docs)


def _scatter(mass: np.ndarray, of: np.ndarray, docs: int) -> np.ndarray:
    out = np.zeros((docs, mass.shape[1]))
    np.add.at(out, of, mass)
    return out


def train(texts: list[str], langs: list[str], steps: int | None = None, batch: int = 64, length: int = 32, rate: float = 0.3, seed: int = 7) -> Model:
    """Fits weights, lexicon weights and transitions by stochastic gradient on the sequences' log-likelihood. With very many
    labels there are more steps, so that each is still seen often."""
    labels = sorted(set(langs))
    k, rng = len(labels), np.random.default_rng(seed)
    steps, number = steps or max(300, 5 * k), {x: i for i, x in enumerate(labels)}
    table = pa.RecordBatch.from_arrays([pc.utf8_lower(pa.array(texts, pa.string()))], names=["t"])
    pieces = []
    counts: dict[int, Counter] = {}
    base = 0
    for row, end, data, offsets in slices(table, "t"):
        starts, ends, doc = _words(data, offsets)
        if not len(starts):
            continue
        (words, hashes), tri = _word_slots(data, starts, ends), _trigram_slots(np.concatenate((data, np.zeros(2, np.uint8))))
        at = starts[:, None] + np.arange(WORD_BYTES - 2)  # every trigram of a word
        inside = at < np.maximum(ends - 2, starts)[:, None]
        grams = np.where(inside, tri[at.clip(max=len(tri) - 1)], BUCKETS)
        y = np.array([number[langs[row + d]] for d in doc])
        for h, label in zip(hashes.tolist(), y.tolist(), strict=True):
            counts.setdefault(h, Counter())[label] += 1
        pieces.append((np.concatenate((words, grams), axis=1), y, hashes, doc + base))
        base += end - row
    none = np.zeros(0)
    if not pieces:
        return Model(labels, np.zeros((BUCKETS, k), np.float32), np.zeros(k), none.astype(np.uint64), none.astype(int), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k))
    slots, y, hashes, _ = (np.concatenate([p[i] for p in pieces]) for i in range(4))
    chosen = sorted((h, c.most_common(1)[0][0]) for h, c in counts.items() if c.most_common(1)[0][1] >= max(_LEXICON_COUNT, _LEXICON_SHARE * sum(c.values())))
    lexicon, lexicon_of = np.array([h for h, _ in chosen], dtype=np.uint64), np.array([c for _, c in chosen], dtype=np.int64)
    place = np.searchsorted(lexicon, hashes).clip(max=max(0, len(lexicon) - 1))
    in_lexicon = np.where(lexicon[place] == hashes, lexicon_of[place], k) if len(lexicon) else np.full(len(hashes), k)
    by_label = [np.flatnonzero(y == i) for i in range(k)]
    w, lw = np.zeros((BUCKETS + 1, k)), np.zeros((k + 1, k))
    bias, trans, start = np.zeros(k), np.zeros((k, k)), np.zeros(k)
    seen = [np.full_like(x, 1e-2) for x in (w, lw, bias, trans, start)]

    def move(i: int, x: np.ndarray, g: np.ndarray) -> None:
        seen[i] += g * g
        x += rate * g / np.sqrt(seen[i])

    for _ in range(steps):
        at = np.zeros((batch, length), dtype=np.int64)
        for s in range(batch):  # segments of several documents, each read from a random place
            filled = 0
            while filled < length:
                pool = by_label[rng.integers(k)]
                take = min(length - filled, int(rng.geometric(0.1)))
                begin = int(rng.integers(max(1, len(pool) - take)))
                part = pool[begin : begin + take]
                at[s, filled : filled + len(part)] = part
                filled += len(part)
        f, gold, lex = slots[at], y[at], in_lexicon[at]
        em = np.zeros((batch, length, k))
        for j in range(f.shape[2]):
            em += w[f[:, :, j]]
        em += lw[lex]
        em += bias
        e, a = np.exp(em - em.max(axis=2, keepdims=True)), np.exp(trans)
        # Pairwise marginals need the messages themselves.
        alpha, now, st = np.empty_like(e), np.tile(np.exp(start), (batch, 1)), None
        for i in range(length):
            st = now * e[:, i]
            alpha[:, i] = st / st.sum(axis=1, keepdims=True)
            now = alpha[:, i] @ a
        beta = np.ones_like(e)
        pair = np.zeros((k, k))
        for i in range(length - 1, 0, -1):
            right = e[:, i] * beta[:, i]
            # alpha x a x right, of sum 1 in each sequence, summed over the sequences.
            total = ((alpha[:, i - 1] @ a) * right).sum(axis=1, keepdims=True)
            pair += a * ((alpha[:, i - 1] / total).T @ right)
            back = right @ a.T
            beta[:, i - 1] = back / back.sum(axis=1, keepdims=True)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        g = np.eye(k)[gold] - p
        flat = g.reshape(-1, k)
        gl = np.zeros_like(lw)
        # Only the buckets of this batch have a gradient.
        met, rows = np.unique(f.reshape(len(flat), -1), return_inverse=True)
        gw, rows = np.zeros((len(met), k)), rows.ravel()
        for c in range(k):
            gw[:, c] = np.bincount(rows, weights=np.repeat(flat[:, c], f.shape[2]), minlength=len(met))
            gl[:, c] = np.bincount(lex.ravel(), weights=flat[:, c], minlength=k + 1)
        gw[met == BUCKETS], gl[k] = 0, 0
        gw /= batch
        seen[0][met] += gw * gw
        w[met] += rate * gw / np.sqrt(seen[0][met])
        move(1, lw, gl / batch), move(2, bias, flat.sum(axis=0) / batch)
        seen_pairs = np.zeros((k, k))
        np.add.at(seen_pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        move(3, trans, (seen_pairs - pair) / batch)
        move(4, start, (np.eye(k)[gold[:, 0]] - p[:, 0]).sum(axis=0) / batch)
    return Model(labels, w[:BUCKETS].astype(np.float32), bias, lexicon, lexicon_of, lw[:k], trans, start)


def fit(docs: DataFrame, trainable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_label: int = PER_LABEL, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """A model of every language of the rows where ``trainable`` holds and the language is known, from a bounded
    sample of these rows."""
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id)), F.lit(1 << 30)) / float(1 << 30)
    at = F.pmod(F.xxhash64(F.lit("place"), F.col(doc_id)), F.greatest(F.lit(1), F.length(text) - sample_chars)).cast("int") + 1
    rows = docs.filter(trainable & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), draw.alias("draw"), at.alias("at"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()  # one row per label of the model
    if not sizes:
        return None
    most = max(1.0, min(per_label, sample_docs / len(sizes)))
    # The row drawn first is in the sample of its language, however small the share.
    shares = docs.sparkSession.createDataFrame([(r["lang"], max(most / r["n"], r["least"])) for r in sizes], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").filter("draw <= share")
    sample = drawn.groupBy("lang", "id").agg(F.max(F.substr("text", "at", F.lit(sample_chars))).alias("text"))
    pieces = sorted((r["lang"], r["text"] or "") for r in sample.collect())
    return train([t for _, t in pieces], [x for x, _ in pieces])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and ``_lang`` and ``_score``."""
    docs = own_names(docs)
    kept = docs.columns
    # Words and bytes have one number per label: the more labels, the smaller the slices.
    limit = SLICE_BYTES * WIDE // max(WIDE, len(model.labels) if model else 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            lowered = pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column("_text"))], names=["t"])
            for row, end, data, offsets in slices(lowered, "t", limit):
                starts, ends, doc = _words(data, offsets)
                n = end - row
                ascii_at = np.flatnonzero((data >= 0x61) & (data <= 0x7A))
                lettered = np.bincount(np.searchsorted(offsets, ascii_at, "right") - 1, minlength=n)[:n] > 0
                for d in np.flatnonzero(~lettered & (np.bincount(doc, minlength=n)[:n] > 0)):
                    lettered[d] = any(c.isalpha() for c in bytes(data[offsets[d] : offsets[d + 1]]).decode())
                if model is None:
                    langs += ["und"] * n
                    scores += [0.0] * n
                    continue
                mass = document_mass(model, _emissions(model, data, starts, ends), doc, n)
                best, total = mass.argmax(axis=1), mass.sum(axis=1)
                share = mass.max(axis=1) / np.where(total > 0, total, 1)
                langs += [model.labels[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                scores += np.where(lettered, share.clip(0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "_lang", "_score"])

    return docs.withColumn("_text", F.col(text)).mapInArrow(work, extended(docs, "_lang string, _score double"))
