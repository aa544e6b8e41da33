"""Markup texts to a nodes table, without a parser: tags are found by pattern, paired by running balances.

Every window is over the tags of one text, which was one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions import text as T
from diffloom.session import cut

# What holds raw text, and what a tag looks like.
RAW_TEXT = r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|textarea|title)\b[^>]*>.*?</\1\s*>"
TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>"


def _blanked(text):
    """The text with raw-text elements and comments as spaces, so offsets stay."""
    parts, raw = F.split(text, RAW_TEXT, -1), F.regexp_extract_all(text, F.lit(RAW_TEXT), F.lit(0))
    blank = F.transform(raw, lambda r: F.repeat(F.lit(" "), F.length(r)))
    zipped = F.arrays_zip(parts.alias("p"), blank.alias("b"))
    return F.array_join(F.transform(zipped, lambda z: F.concat(z["p"], F.coalesce(z["b"], F.lit("")))), "")


def _pair(tags: DataFrame, by: str) -> DataFrame:
    """Adds ``mate``: the end of the close tag an open one pairs with by name, or null. A close with no open
    before it is ignored; at one level of one name, an open pairs with the close that follows it."""
    name = Window.partitionBy(by, "name").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("closes"), -1).otherwise(1)
    rows = tags.repartition(by).withColumn("_sum", F.sum(delta).over(name))
    # Stray closes push the balance below its floor; the floor moves down with them.
    floor = F.least(F.min("_sum").over(name), F.lit(0))
    rows = rows.withColumn("_bal", F.col("_sum") - floor)
    rows = rows.withColumn("_level", F.when(F.col("closes"), F.col("_bal") + 1).otherwise(F.col("_bal")))
    level = Window.partitionBy(by, "name", "_level").orderBy("start")
    after = F.struct(F.lead("closes").over(level).alias("c"), F.lead("end").over(level).alias("e"), F.lead("start").over(level).alias("s"))
    rows = rows.withColumn("_next", after)
    paired = ~F.col("closes") & F.coalesce(F.col("_next.c"), F.lit(False))
    return rows.withColumns({"mate": F.when(paired, F.col("_next.e")), "mate_start": F.when(paired, F.col("_next.s"))}).drop("_sum", "_bal", "_level", "_next")


def _drop_crossing(elements: DataFrame, by: str) -> DataFrame:
    """Elements whose pair crosses another one become leaves: the depth at their close is not the one at
    their open. Crossing pairs only count against each other, so passes go on until none is left."""
    paired = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("mate_start").alias("at"), F.lit(-1).alias("d")))
    alone = F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("d")))
    columns = ["end", "kind", "label", "mate", "mate_start"]
    events = elements.select(by, "start", *columns, F.explode(F.when(F.col("mate").isNotNull(), paired).otherwise(alone)).alias("e"))
    order = Window.partitionBy(by).orderBy("e.at").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("_depth", F.sum("e.d").over(order))
    level = F.when(F.col("e.d") == 1, F.col("_depth") - 1).when(F.col("e.d") == -1, F.col("_depth"))
    rows = events.groupBy(by, "start").agg(F.any_value(F.struct(*columns)).alias("n"), (F.min(level) == F.max(level)).alias("_ok"))
    keep = F.coalesce("_ok", F.lit(True))
    return rows.select(
        by, "start", "n.end", "n.kind", "n.label", F.when(keep, F.col("n.mate")).alias("mate"), F.when(keep, F.col("n.mate_start")).alias("mate_start")
    )


def markup_nodes(texts: DataFrame, by: str = "blob_id") -> DataFrame:
    """``texts`` (``by``, ``text``) to nodes: elements and the text between tags, in preorder under one root.

    An open tag pairs with a close of its own name; one without a partner is a leaf, a stray close nothing.
    ``kind`` is the tag name or ``text``; ``label`` the tag's attributes or the text; ``parent`` an ``idx``.
    """
    clean = texts.select(by, _blanked(F.col("text")).alias("text"))
    found = F.regexp_extract_all("text", F.lit(TAG), F.lit(0))
    zipped = F.posexplode(F.arrays_zip(F.split("text", TAG, -1).alias("g"), found.alias("m"))).alias("_at", "_p")
    pieces = clean.select(by, zipped).select(by, "_at", F.col("_p.g").alias("gap"), F.coalesce("_p.m", F.lit("")).alias("tag"))
    upto = Window.partitionBy(by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("end", F.sum(F.length("gap") + F.length("tag")).over(upto).cast("int"))
    pieces = pieces.withColumn("start", F.col("end") - F.length("tag"))
    part = lambda g: F.regexp_extract("tag", TAG, g)
    gap_start = F.col("start") - F.length("gap")
    trimmed = F.regexp_replace("gap", f"^{T.SPACES}|{T.SPACES}$", "")
    lead = F.length(F.regexp_extract("gap", f"^({T.SPACE}*)", 1))
    # Written, since tags and texts are read apart: a text is searched and shuffled once.
    pieces = cut(pieces.select(
        by, "start", "end", (F.col("tag") != "").alias("tagged"), (part(1) == "/").alias("closes"), F.lower(part(2)).alias("name"), F.trim(part(3)).alias("label"),
        (gap_start + lead).alias("text_start"), trimmed.alias("solid"),
    ))
    tags = pieces.filter("tagged").select(by, "start", "end", "closes", "name", "label")
    texts_ = pieces.filter("solid <> ''").select(
        by, F.col("text_start").alias("start"), (F.col("text_start") + F.length("solid")).alias("end"), F.lit("text").alias("kind"), F.col("solid").alias("label"),
        F.lit(None).cast("int").alias("mate"), F.lit(None).cast("int").alias("mate_start"),
    )
    elements = _pair(tags, by).filter("not closes").select(by, "start", "end", F.col("name").alias("kind"), "label", "mate", "mate_start")
    elements = cut(elements)
    paired = elements.agg(F.count("mate")).first()[0]
    while True:  # until no element changes
        elements = cut(_drop_crossing(elements, by))
        left = elements.agg(F.count("mate")).first()[0]
        if left == paired:
            break
        paired = left
    root = texts.select(by, F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("document").alias("kind"), F.lit("").alias("label"),
                        F.length("text").alias("mate"), (F.length("text") + 1).alias("mate_start"))
    nodes = root.unionByName(elements).unionByName(texts_)
    # Openings and closings in one order give preorder number, size and depth as running counts.
    at = lambda c, o: F.struct(F.col(c).alias("at"), F.lit(o).alias("o"))
    both = F.when(F.col("mate").isNotNull(), F.array(at("start", 1), at("mate_start", 0))).otherwise(F.array(at("start", 1)))
    events = nodes.select("*", F.explode(both).alias("_e")).select(*nodes.columns, "_e.at", "_e.o")
    order = Window.partitionBy(by).orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("mate").isNull(), 0).when(F.col("o") == 1, 1).otherwise(-1)
    events = events.withColumns({"_seen": F.sum("o").over(order), "_depth": F.sum(step).over(order)})
    rows = events.groupBy(by, "start").agg(
        F.max(F.when(F.col("o") == 1, F.struct("kind", "label", "end", "mate", (F.col("_seen") - 1).alias("idx"),
                                               (F.col("_depth") - F.when(F.col("mate").isNull(), 0).otherwise(1)).alias("depth")))).alias("n"),
        F.max(F.when(F.col("o") == 0, F.col("_seen"))).alias("_last"),
    )
    rows = rows.select(
        by, F.col("n.idx").cast("int").alias("idx"), F.coalesce(F.col("_last") - F.col("n.idx"), F.lit(1)).cast("int").alias("size"),
        F.col("n.depth").cast("int").alias("depth"), F.col("n.kind").alias("kind"), F.col("n.label").alias("label"),
        F.greatest("start", F.lit(0)).alias("start"), F.coalesce(F.col("n.mate"), F.col("n.end")).alias("end"), F.col("n.mate").isNotNull().alias("_holds"),
    )
    # A node's parent is the last holder one level up.
    ask = F.struct((F.col("depth") - 1).alias("_l"), F.lit(None).cast("int").alias("_holder"), F.lit(True).alias("_ask"))
    tell = F.struct(F.col("depth").alias("_l"), F.col("idx").alias("_holder"), F.lit(False).alias("_ask"))
    both = rows.select("*", F.explode(F.when(F.col("_holds"), F.array(ask, tell)).otherwise(F.array(ask))).alias("_x")).select(*rows.columns, "_x.*")
    level = Window.partitionBy(by, "_l").orderBy("idx", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("parent", F.last("_holder", ignorenulls=True).over(level)).filter("_ask")
    return both.select(by, "idx", F.coalesce("parent", F.lit(-1)).alias("parent"), "size", "depth", "kind", "label", "start", "end")


def load_nodes(nodes: DataFrame, by: str = "blob_id") -> tuple[DataFrame, DataFrame]:
    """A nodes table of any parser, checked: ``(by, idx)`` is unique and ranges nest in their parent's.
    Returns the blobs that are sound, and what is wrong with the others."""
    twice = nodes.groupBy(by, "idx").count().filter("count > 1").select(by, F.lit("repeated idx").alias("problem"))
    up = nodes.select(by, F.col("idx").alias("parent"), F.col("size").alias("_size"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    held = nodes.filter("parent >= 0").join(up, [by, "parent"], "left")
    bad = F.col("_size").isNull() | (F.col("idx") <= F.col("parent")) | (F.col("idx") + F.col("size") > F.col("parent") + F.col("_size")) | (F.col("start") < F.col("_start")) | (F.col("end") > F.col("_end"))
    nest = held.filter(bad).select(by, F.lit("outside its parent").alias("problem"))
    problems = twice.unionByName(nest).distinct()
    return nodes.join(problems.select(by).distinct(), by, "left_anti"), problems
