"""Text functions over columns: lines, keys, hashes, words, literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character a script engine counts as whitespace; both Java and RE2 read it.
SPACE = r"[\s\x0B\p{Z}\x{FEFF}]"
SPACES = SPACE + "+"

# What one token of a line is. In order: text between quotes of one kind, with escapes; letters, digits
# and underscores in a row; one other visible character. After a word character a quotation mark opens nothing.
# Runs and escapes alternate in a loop, so a long quotation costs the matcher no stack.
_QUOTED = "|".join(rf"{q}[^{q}\\]*(?:\\.[^{q}\\]*)*{q}" for q in "\"'`")
TOKEN = (
    rf"(?<![\p{{L}}\p{{N}}_])(?:{_QUOTED})"
    r"|[\p{L}\p{N}_]+|[^\s\x0B\p{Z}\x{FEFF}\p{L}\p{N}_]"
)
WORD = r"[\p{L}_$][\p{L}\p{N}_$]*"
DISPLAY_WORD = r"[\p{L}\p{N}_$]+"
COMMENT_MARKER = r"(?m)^[ \t]*(?:\*(?!/)|//+|#)[ \t]*"
SCAFFOLD = r"^[\s()\[\]{}<>;,]*$"
JOINER = r"^(?:[.,;()\[\]{}]|\?\.)+$"
DECIMAL = r"^([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?$"


def line_array(text: Column) -> Column:
    """The lines of a text: none for an empty one, and none after a final newline."""
    parts = F.split(text, "\n", -1)
    count = F.size(parts)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(
        text.endswith("\n"), F.slice(parts, 1, F.greatest(count - 1, F.lit(0)))
    ).otherwise(parts)


def solid(text: Column) -> Column:
    """The text with its whitespace dropped: two lines with the same solid text read the same."""
    return F.regexp_replace(text, SPACES, "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def line_key(text: Column) -> Column:
    """A line as it compares: its tokens, inner whitespace dropped."""
    return F.to_json(F.transform(tokens(text), lambda t: F.regexp_replace(t, SPACES, "")))


def compare_key(text: Column) -> Column:
    """``line_key`` as plain text: two lines are equal when their keys are; a blank line's is empty."""
    return F.array_join(F.transform(tokens(text), lambda t: F.regexp_replace(t, SPACES, "")), "\u0001")


def text_hash(text: Column) -> Column:
    """A whitespace-insensitive content hash of a line or a node."""
    return F.md5(F.array_join(tokens(text), "\u0001"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def line_of(text: Column, offset: Column) -> Column:
    """0-based line that holds the 0-based character ``offset``."""
    before = F.substring(text, F.lit(1), offset)
    newlines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    last = F.size(line_array(text)) - 1
    return F.least(newlines, F.greatest(last, F.lit(0)))


def line_end(text: Column, offset: Column) -> Column:
    """0-based offset just past the line holding ``offset``, its newline included."""
    rest = F.substring(text, offset + 1, F.length(text))
    at = F.instr(rest, "\n")
    return F.when(at == 0, F.length(text)).otherwise(offset + at)


def is_scaffold(text: Column) -> Column:
    return text.rlike(SCAFFOLD)


def is_joiner(text: Column) -> Column:
    return text.rlike(JOINER)


def chars_of(text: Column, first: Column, end: Column) -> Column:
    """Display offsets as whitespace-skipped character offsets."""

    def count(at: Column) -> Column:
        return F.length(solid(F.substring(text, F.lit(1), at)))

    return F.struct(count(first).alias("start"), count(end).alias("end"))


def display_range(text: Column, start: Column, end: Column) -> Column:
    """Whitespace-skipped offsets back to display offsets, ``end`` exclusive."""
    numbered = F.transform(F.split(text, "", -1), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    offsets = F.transform(F.filter(numbered, lambda x: (x["c"] != "") & ~x["c"].rlike(f"^{SPACE}$")), lambda x: x["i"])
    last = F.get(offsets, end - 1)
    first = F.coalesce(F.get(offsets, start), F.length(text))
    return F.struct(first.alias("start"), F.coalesce(last + 1, first).alias("end"))


def unescape_html(text: Column) -> Column:
    """The five entities a rendered page writes; the ampersand last, so nothing unescapes twice."""
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def subject(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def author_name(author: Column) -> Column:
    """The author without the e-mail address."""
    return F.regexp_replace(author, r"\s*<.*$", "")


def marker_free(text: Column) -> Column:
    """Each line without its leading comment marker."""
    return F.regexp_replace(text, COMMENT_MARKER, "")


def decimal_value(raw: Column) -> Column:
    """The canonical form of a decimal literal (``1.50`` is ``15e-1``), or null when it is none."""
    whole, fraction = F.regexp_extract(raw, DECIMAL, 2), F.regexp_extract(raw, DECIMAL, 3)
    exponent = F.regexp_extract(raw, DECIMAL, 4)
    digits = F.regexp_replace(F.concat(whole, fraction), r"^0+", "")
    kept = F.regexp_replace(digits, r"0+$", "")
    power = (
        F.when(exponent == "", F.lit(0)).otherwise(exponent.try_cast("int"))
        - F.length(fraction)
        + F.length(digits)
        - F.length(kept)
    )
    sign = F.when(F.regexp_extract(raw, DECIMAL, 1) == "-", "-").otherwise("")
    value = F.when(kept == "", F.concat(sign, F.lit("0e0"))).otherwise(
        F.concat(sign, kept, F.lit("e"), power.cast("string"))
    )
    return F.when(raw.rlike(DECIMAL) & (F.concat(whole, fraction) != ""), value)


def mostly_kept(kept_chars: Column, all_chars: Column) -> Column:
    """At least half of the text, whitespace aside, is unchanged."""
    return kept_chars * 2 >= all_chars
