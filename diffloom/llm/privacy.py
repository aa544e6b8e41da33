"""Personal data with offset-preserving deobfuscation.

Four kinds of identifiers are found in the text as it stands (the base spans). Disguised ones are found in a
normalised text that a chain of transducers makes: each replaces pieces of its input and knows, for every character
it puts out, which source characters it stands for. Detection runs over the normalised text with the same patterns,
and a span found there is mapped back to the characters of the source. Base spans always stay; a mapped span is added
where it meets no base span of its kind.

The transducers, in order:
* homoglyphs: compatibility forms, digits of other scripts, Cyrillic and Greek look-alikes inside words of Latin
  letters or digits, invisible characters, blanks and dashes of all kinds; the letters O, l and I between digits;
* spelled digits: runs of at least four number words;
* at and dot disguises: bracketed or spelled ``at``, ``dot``, ``plus``, and entities.

Spelled ``at`` without brackets counts only where a disguised dot follows in the same address; so prose that uses
these words is left alone.

Defined results: a null text is empty; offsets count code points; spans are half open.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import extended, own_names

KINDS = ("email", "ip", "card", "phone")

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from all: only first digits are tried.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    """Around each @: the address characters before it, and a domain after it. Linear, where a pattern that starts
    at every character is not."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL_END.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        # What was walked over before a failing @ is not walked again: the next run ends at its own @.
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return {"email": _emails(text), "ip": ips, "card": cards, "phone": phones}


# Letters of other scripts that look like these Latin ones.
_LOOKS_LIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ɡ": "g", "ı": "i",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "。": ".", "∙": ".", "‧": ".", "٠": "0",
}
_NUMBER_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_BETWEEN_DIGITS = re.compile(r"[0-9][OolI|](?=[0-9.])|\.[OolI|](?=[0-9])")
_DIGIT_WORD = "|".join(_NUMBER_WORDS)
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:(?:{_DIGIT_WORD}|[0-9])(?![A-Za-z0-9])[\x20,-]{{0,2}}){{4,}}", re.I)
_ONE_WORD = re.compile(rf"{_DIGIT_WORD}|[0-9]", re.I)
_BRACKETED_AT = re.compile(r"\s{0,3}[\[({<]\s{0,2}(?:at|@)\s{0,2}[\])}>]\s{0,3}|&#64;|&commat;|%40", re.I)
_BRACKETED_DOT = re.compile(r"\s{0,3}[\[({<]\s{0,2}(?:dot|\.)\s{0,2}[\])}>]\s{0,3}|&#46;|&period;|%2e", re.I)
_DOT = r"(?:\x20{1,2}(?:dot|\.)\x20{1,2}|\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|[_-]dot[_-])"
_AT = r"(?:\x20{1,2}(?:at|@)\x20{1,2}|[_-]at[_-]|\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?)"
_NAME = r"[A-Za-z0-9_%+-]{1,64}"
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:(?:\.|{_DOT}){_NAME}){{0,4}}{_AT}[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_DOT})[A-Za-z0-9-]{{1,63}}){{0,4}}{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.I)
_PLAIN_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])(?:{_NAME}\.){{0,4}}{_NAME}\x20@\x20?[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}})+|(?<![A-Za-z0-9._%+-])(?:{_NAME}\.){{0,4}}{_NAME}@\x20[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}})+")
_AT_WORD, _DOT_WORD = re.compile(_AT, re.I), re.compile(_DOT, re.I)
# Cheap tests on the lower-cased text that spare most texts the patterns above.
_DOT_HINTS = (" dot ", "_dot_", "-dot-", "[dot", "(dot", "{dot", "<dot", "[ dot", "( dot", "{ dot", "< dot", "[.", "(.", "{.", "<.", "[ .", "( .", "{ .", "< .", " . ")
_AT_HINTS = (" @", "@ ", "[at", "(at", "{at", "<at", "[ at", "( at", "{ at", "< at", "[@", "(@", "{@", "<@", "&#64;", "&commat;", "%40", "&#46;", "&period;", "%2e")
_SPELLED_HINT = re.compile(rf"[\x20,-](?:{_DIGIT_WORD})[\x20,-]{{1,2}}(?:{_DIGIT_WORD}|[0-9])")
_NUMBER_HINT = re.compile(r"[0-9]\x20?(?:\.\x20|\x20\.|point)")
_NUMBER_DOT = re.compile(r"(?<=[0-9])\x20{0,2}(?:[\[({<]\x20?(?:dot|\.)\x20?[\])}>]|\bdot\b|\bpoint\b)\x20{0,2}(?=[0-9])", re.I)
_SPACED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20\.\x20|\x20\.|\.\x20)[0-9]{1,3}(?:\x20\.\x20|\x20\.|\.\x20)[0-9]{1,3}(?:\x20\.\x20|\x20\.|\.\x20)[0-9]{1,3}(?![0-9.])")
_PLUS = re.compile(r"(?<![A-Za-z])plus\x20{1,2}(?=[0-9])", re.I)


class Mapped:
    """A text, and for each of its characters the source characters it stands for (itself, until the first edit)."""

    def __init__(self, text: str, first: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.first, self.end = text, first, end

    def replaced(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """With text[a:b] replaced for each (a, b, new), in order; an edit that meets an earlier one is left out. A
        new character stands for all of text[a:b], or, where lengths agree, for the character in its place."""
        if not edits:
            return self
        old_first = np.arange(len(self.text)) if self.first is None else self.first
        old_end = old_first + 1 if self.end is None else self.end
        parts, first, end, at = [], [], [], 0
        for a, b, new in edits:
            if a < at:
                continue
            parts += [self.text[at:a], new]
            first.append(old_first[at:a]), end.append(old_end[at:a])
            if len(new) == b - a:
                first.append(old_first[a:b]), end.append(old_end[a:b])
            elif new:
                first.append(np.full(len(new), old_first[a])), end.append(np.full(len(new), old_end[b - 1]))
            at = b
        parts.append(self.text[at:]), first.append(old_first[at:]), end.append(old_end[at:])
        return Mapped("".join(parts), np.concatenate(first), np.concatenate(end))

    def source(self, span: Span) -> Span:
        return int(self.first[span[0]]), int(self.end[span[1] - 1])


def _plain(c: str) -> str:
    """What a foreign character stands for; itself if nothing."""
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Pd" or c == "−":
        return "-"
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if c in _LOOKS_LIKE:
        return _LOOKS_LIKE[c]
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


_SEEN: dict[str, str] = {}  # at most one entry per character of Unicode


def _homoglyphs(t: Mapped) -> Mapped:
    if not t.text.isascii():
        foreign = {c for c in set(t.text) if c > "\x7f"}
        _SEEN.update((c, _plain(c)) for c in foreign if c not in _SEEN)
        table = {c: _SEEN[c] for c in foreign if _SEEN[c] != c}
        if table:
            t = t.replaced([(m.start(), m.end(), table[m[0]]) for m in re.finditer("[" + "".join(map(re.escape, table)) + "]", t.text)])
    return t.replaced([(m.end() - 1, m.end(), "0" if m[0][-1] in "Oo" else "1") for m in _BETWEEN_DIGITS.finditer(t.text)])


def _digits(t: Mapped) -> Mapped:
    low = t.text.lower()
    if not _SPELLED_HINT.search(low):
        return t
    edits = []
    for m in _SPELLED.finditer(t.text):
        words = list(_ONE_WORD.finditer(m[0]))
        if sum(w[0].lower() in _NUMBER_WORDS for w in words) < 3:
            continue
        for i, w in enumerate(words):
            stop = words[i + 1].start() if i + 1 < len(words) else w.end()
            edits.append((m.start() + w.start(), m.start() + stop, _NUMBER_WORDS.get(w[0].lower(), w[0])))
    return t.replaced(edits)


def _around(text: str, at: int, sign: str) -> tuple[int, int, str]:
    """The sign at ``at`` with the blanks beside it, to be replaced by the bare sign."""
    lo, hi = at, at + 1
    while text[lo - 1] == " ":
        lo -= 1
    while text[hi] == " ":
        hi += 1
    return lo, hi, sign


def _signs(t: Mapped) -> Mapped:
    low = t.text.lower()
    dots = any(h in low for h in _DOT_HINTS)
    if dots:
        edits = []
        for m in _ADDRESS.finditer(t.text):
            edits += [(x.start(), x.end(), "@") for x in _AT_WORD.finditer(t.text, m.start(), m.end())][:1]
            edits += [(x.start(), x.end(), ".") for x in _DOT_WORD.finditer(t.text, m.start(), m.end())]
        t = t.replaced(sorted(edits))
    if dots or any(h in low for h in _AT_HINTS):
        t = t.replaced([_around(t.text, t.text.index("@", m.start()), "@") for m in _PLAIN_AT.finditer(t.text)])
        t = t.replaced([(m.start(), m.end(), "@") for m in _BRACKETED_AT.finditer(t.text)])
        t = t.replaced([(m.start(), m.end(), ".") for m in _BRACKETED_DOT.finditer(t.text)])
    if dots or "plus " in low or _NUMBER_HINT.search(low):
        t = t.replaced([(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(t.text)])
        t = t.replaced([(m.start(), m.end(), "+") for m in _PLUS.finditer(t.text)])
        signs = [m.start() + x.start() for m in _SPACED_IP.finditer(t.text) for x in re.finditer(r"\.", m[0])]
        t = t.replaced([_around(t.text, at, ".") for at in signs])
    return t


def normalised(text: str) -> Mapped:
    return _signs(_digits(_homoglyphs(Mapped(text))))


def all_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and base and added spans together."""
    base = base_spans(text)
    t = normalised(text)
    if t.text == text:
        return base, base
    out = {k: list(v) for k, v in base.items()}
    for kind, spans in base_spans(t.text).items():
        for span in spans:
            a, b = t.source(span)
            if not any(x < b and a < y for x, y in base[kind]):
                out[kind].append((a, b))
        out[kind].sort()
    return base, out


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``; ``_base`` and ``_spans`` (kind:start:end, comma-joined), and counts of base spans."""
    docs = own_names(docs)
    kept = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every, counts = [], [], []
            for value in batch.column("_text"):
                own, found = all_spans(value.as_py() or "")
                base.append(written(own)), every.append(written(found)), counts.append([len(own[k]) for k in KINDS])
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(base, pa.string()), pa.array(every, pa.string()), *numbers], names=[*kept, "_base", "_spans", *[f"_n_{k}" for k in KINDS]])

    counts = ", ".join(f"_n_{k} long" for k in KINDS)
    return docs.withColumn("_text", F.col(text)).mapInArrow(work, extended(docs, f"_base string, _spans string, {counts}"))
