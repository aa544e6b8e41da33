"""A small messy table of documents."""

import random

from pyspark.sql import types as T

#: Names that the operators use for themselves, and names of their results.
CLASHES = ["_text", "_id", "_kept", "_th", "h1", "pos", "fp", "n", "row", "key"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)


def documents(spark, texts):
    """Rows of documents (doc_id, text[, lang]) with columns whose names clash."""
    rows = [(t[0], t[1], t[2] if len(t) > 2 else "en", None, len(t[1] or ""), *CLASHES) for t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def messy_rows():
    """(doc_id, text): nulls, empty, blank, long and repeated texts, repeated rows, copies, near copies, shared lines."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(70))
    line = "All rights Reserved. \t"
    body = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = [(i, b) for i, b in enumerate(body)]
    rows += [(100 + i, f"{body[i]}\n{line}\n{passage} {word()}\n {line.upper()}") for i in range(12)]
    rows += [(200, None), (201, ""), (202, " \t\n "), (None, None), (None, "lost and found"), (203, "é È ß 你好 " * 30), (204, "x" * 300)]
    rows += [(205, "\n\n\n"), (206, body[3] + " end"), (207, " ".join(word() for _ in range(5000))), (208, body[5]), (208, body[6]), (5, body[5])]
    return rows
