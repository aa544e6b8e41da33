"""Reports over files and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions.paths import is_test_path
from diffloom.functions.scan import ranked


def review_order(files: DataFrame) -> DataFrame:
    """Files in the order a reviewer reads them: tree order (a folder sorts as ``path/``, which is the
    order of full paths), tests last. ``place`` counts per change set, which may be of any size."""
    rows = files.withColumn("is_test", is_test_path(F.col("path")))
    return ranked(rows, ["diffset_id"], ["is_test", "path"], "place")


def outcomes(runs: DataFrame) -> DataFrame:
    """A fixture's outcome over its option sets: refused before fail before pass; its mean ratio, a passing
    run counting as one."""
    ratio = F.when(F.col("outcome") == "pass", 1.0).otherwise(F.col("ratio"))
    return runs.groupBy("target", "fixture").agg(
        F.when(F.bool_or(F.col("outcome") == "refused"), "refused").when(F.bool_and(F.col("outcome") == "pass"), "pass").otherwise("fail").alias("outcome"),
        F.avg(ratio).alias("ratio"), F.count(F.lit(1)).alias("runs"), F.count_if(F.col("outcome") == "pass").alias("passed"),
    )


def matrix(results: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pass counts and rate per target, with its exclusions counted."""
    rows = results.groupBy("target").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "pass").alias("passed"),
        F.count_if(F.col("outcome") == "refused").alias("refused"), F.count_if(F.col("outcome") == "fail").alias("failed"),
    )
    left_out = excluded.groupBy("target").agg(F.count(F.lit(1)).alias("excluded"))
    rows = rows.join(left_out, "target", "full_outer").na.fill(0, ["total", "passed", "refused", "failed", "excluded"])
    return rows.withColumn("rate", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("passed") / F.col("total")))


def exclusions(excluded: DataFrame) -> DataFrame:
    return excluded.groupBy("target", "reason").agg(F.count(F.lit(1)).alias("fixtures"))


def merge_runs(parts: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partial runs unioned into one, and what keeps them from being one: groups measured twice, missing
    or unknown, and disagreement on how they ran. ``parts``: ``part, group_id, commit, settings, value``;
    ``order``: ``group_id, place``."""
    merged = parts.join(order, "group_id").select("group_id", "place", "commit", "value")
    twice = parts.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.lit("duplicate").alias("problem"), F.col("group_id").alias("subject"))
    gap = order.join(parts, "group_id", "left_anti").select(F.lit("missing").alias("problem"), F.col("group_id").alias("subject"))
    stray = parts.join(order, "group_id", "left_anti").select(F.lit("unknown").alias("problem"), F.col("group_id").alias("subject")).distinct()
    mixed = parts.agg(F.count_distinct("commit").alias("commit"), F.count_distinct("settings").alias("settings"))
    mixed = mixed.select(F.explode(F.map_from_arrays(F.array(F.lit("commit"), F.lit("settings")), F.array("commit", "settings"))).alias("subject", "_n")).filter("_n > 1").select(F.lit("mismatch").alias("problem"), "subject")
    return merged, twice.unionByName(gap).unionByName(stray).unionByName(mixed)


# The line endings that mark a style, and the print widths tried.
NO_SEMICOLON = r"[^\s{};,.:=+*/%&|!?<>-](?:\+\+|--)?$"
WIDTHS = [80, 100, 120, 140, 160]


def _wider(widths, limit: int):
    return F.size(F.filter(widths, lambda w: w > limit))


def style_profile(texts: DataFrame, by: str = "doc_id") -> DataFrame:
    """Formatting habits of a file: what indents it and by how much, whether statements end in semicolons, which
    quotes it takes, and its line width, rounded up to one of the usual limits. Higher-order functions over one file's lines; nothing is exploded."""
    lines = F.split("text", r"\r\n?|\n", -1)
    code = lambda l: F.regexp_replace(F.regexp_replace(l, r"\s+//.*$", ""), r"^\s+|\s+$", "")
    solid = F.filter(F.col("_lines"), lambda l: (code(l) != "") & ~code(l).rlike(r"^(?://|/\*|\*)"))
    count = lambda xs, test: F.size(F.filter(xs, test))
    indent = lambda l: F.length(l) - F.length(F.ltrim(l))
    rows = texts.select(by, "text", lines.alias("_lines")).withColumn("_code", solid)
    rows = rows.select(
        by, "_lines",
        count(F.col("_code"), lambda l: l.startswith("\t")).alias("_tabs"), count(F.col("_code"), lambda l: l.startswith(" ")).alias("_spaces"),
        F.exists("_code", lambda l: l.startswith(" ") & (indent(l) % 4 == 2)).alias("_two"),
        count(F.col("_code"), lambda l: code(l).endswith(";")).alias("_semi"),
        count(F.col("_code"), lambda l: ~code(l).endswith(";") & code(l).rlike(NO_SEMICOLON)).alias("_bare"),
        F.size(F.regexp_extract_all("text", F.lit(r"'(?:\\.|[^'\\\r\n])*'"), F.lit(0))).alias("_single"),
        F.size(F.regexp_extract_all("text", F.lit(r'"(?:\\.|[^"\\\r\n])*"'), F.lit(0))).alias("_double"),
    )
    use_tabs = F.col("_tabs") > F.col("_spaces")
    rows = rows.withColumns({"use_tabs": use_tabs, "tab_width": F.when(use_tabs | ~F.col("_two"), 4).otherwise(2)})
    widths = F.transform("_lines", lambda l: F.length(l) + F.length(F.regexp_extract(l, r"^(\t*)", 1)) * (F.col("tab_width") - 1))
    rows = rows.withColumn("_widths", widths)
    fits = F.lit(200)
    for width in reversed(WIDTHS):
        fits = F.when(_wider(F.col("_widths"), width) * 100 <= F.size("_lines"), width).otherwise(fits)
    return rows.select(by, (F.col("_bare") <= F.col("_semi")).alias("semi"), (F.col("_single") > F.col("_double")).alias("single_quote"), fits.alias("print_width"), "use_tabs", "tab_width")


def directory_tree(files: DataFrame) -> DataFrame:
    """Folders as a compact tree draws them, with the totals beneath each: a folder whose only child is a
    folder shares that child's row. ``files``: ``diffset_id, path, added, removed``. Totals add up per
    folder first, so a folder of many files climbs as one row."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    own = files.groupBy("diffset_id", folder.alias("dir")).agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    parts = F.split("dir", "/")
    upward = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    )
    rows = own.select("diffset_id", F.col("dir").alias("_own"), "files", "added", "removed", F.explode(upward).alias("dir"))
    direct = F.when(F.col("dir") == F.col("_own"), F.col("files")).otherwise(0)
    totals = rows.groupBy("diffset_id", "dir").agg(F.sum("files").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum(direct).alias("own_files"))
    up = F.regexp_extract("dir", r"^(.*)/[^/]*$", 1)
    children = totals.groupBy("diffset_id", up.alias("dir")).agg(F.count(F.lit(1)).alias("dirs"))
    totals = totals.join(children, ["diffset_id", "dir"], "left").na.fill(0, ["dirs"])
    shown = totals.filter("not (own_files = 0 and dirs = 1)")
    above = shown.select("diffset_id", "dir", F.explode(F.slice(upward, F.lit(1), F.greatest(F.size(upward) - 1, F.lit(0)))).alias("_up"))
    stops = shown.select("diffset_id", F.col("dir").alias("_up"))
    nearest = above.join(stops, ["diffset_id", "_up"]).groupBy("diffset_id", "dir").agg(F.max_by("_up", F.length("_up")).alias("parent"))
    out = shown.join(nearest, ["diffset_id", "dir"], "left").withColumn("parent", F.coalesce("parent", F.lit("")))
    name = F.when(F.col("parent") == "", F.col("dir")).otherwise(F.substring("dir", F.length("parent") + 2, F.length("dir")))
    return out.select("diffset_id", F.col("dir").alias("path"), name.alias("name"), "parent", "files", "added", "removed")


def stale_files(listing: DataFrame, manifest: DataFrame, index_time) -> tuple[DataFrame, DataFrame]:
    """Files whose content must be hashed, and those taken at the id already known. A file is known when
    size, time and inode match its entry and it is older than the index itself. Either side may lack an
    inode. A file the manifest has but the listing lacks is gone and in neither."""
    known = manifest.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("inode").alias("_inode"), "blob_id")
    rows = listing.join(known, "path", "left")
    inode = F.col("inode").isNull() | F.col("inode").eqNullSafe(F.col("_inode"))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")) & inode & (F.col("_mtime") < index_time)
    rows = rows.withColumn("_same", F.coalesce(same, F.lit(False)))
    return rows.filter("not _same").select(*listing.columns), rows.filter("_same").select(*listing.columns, "blob_id")


def fenced_blocks(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """Fenced code blocks of a text: fences toggle, so a running count of them says which lines lie inside.
    ``language`` is the one the opening fence names, null when it names none."""
    from diffloom.functions.paths import fence_language

    fence = F.col("text").rlike(r"^\s{0,3}(?:```|~~~)")
    upto = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_fence", fence).withColumn("_n", F.count_if("_fence").over(upto))
    info = F.nullif(F.regexp_extract("text", r"^\s{0,3}(?:`{3,}|~{3,})\s*([^\s`{]*)", 1), F.lit(""))
    rows = rows.filter("_n % 2 = 1").withColumn("block_no", ((F.col("_n") + 1) / 2).cast("int"))
    return rows.groupBy(by, "block_no").agg(
        fence_language(F.min_by(F.when(F.col("_fence"), info), "line_no")).alias("language"), F.min("line_no").alias("first_line"), F.count_if(~F.col("_fence")).alias("lines"),
    )


def embedded_blocks(pages: DataFrame) -> DataFrame:
    """Scripts and styles inside markup with the language each holds."""
    pattern = r"(?is)<(script|style)\b([^>]*)>(.*?)</\1\s*>"
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("block_no", "_b"))
    part = lambda g: F.regexp_extract("_b", pattern, g)
    kind = F.lower(F.trim(F.regexp_extract(part(2), r"""(?i)\btype\s*=\s*["']?([^"'>]*)""", 1)))
    script = F.when(kind.isin("", "module", "text/javascript", "application/javascript"), "javascript").when(
        kind.isin("importmap", "speculationrules") | kind.endswith("json"), "json"
    )
    return rows.select("page_id", "block_no", F.when(F.lower(part(1)) == "style", "css").otherwise(script).alias("language"), part(3).alias("content"))


def innermost_binding(uses: DataFrame, bindings: DataFrame, uncertain: DataFrame) -> DataFrame:
    """Each use of a name with the smallest interval of that name that holds it. ``uses``: ``blob_id, name,
    use_id, pos``; ``bindings``: ``blob_id, name, binding, start, end`` (half-open, nested or apart);
    ``uncertain``: intervals in which a name stays unresolved.

    Nesting depth is a running count of openings minus closings. The innermost interval around a position
    at depth d is the last one opened at depth d, so it is a running ``last`` within (name, depth): the
    intervals are never paired with the uses they hold.
    """
    key = ["blob_id", "name"]
    none = lambda t: F.lit(None).cast(t)
    id_type = bindings.schema["binding"].dataType
    use_type = uses.schema["use_id"].dataType
    b = bindings.select(*key, "binding", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    opens = b.select(*key, F.col("start").alias("pos"), F.lit(1).alias("o"), F.lit(1).alias("d"), "binding", none(use_type).alias("use_id"), (-F.col("end")).alias("t"))
    closes = b.select(*key, F.col("end").alias("pos"), F.lit(0).alias("o"), F.lit(-1).alias("d"), none(id_type).alias("binding"), none(use_type).alias("use_id"), (-F.col("start")).alias("t"))
    asks = uses.select(*key, F.col("pos").cast("bigint").alias("pos"), F.lit(2).alias("o"), F.lit(0).alias("d"), none(id_type).alias("binding"), "use_id", F.lit(0).cast("bigint").alias("t"))
    u = uncertain.select(*key, F.explode(F.array(
        F.struct(F.col("start").cast("bigint").alias("pos"), F.lit(1).alias("n")), F.struct(F.col("end").cast("bigint").alias("pos"), F.lit(-1).alias("n"))
    )).alias("e")).select(*key, "e.pos", F.lit(0).alias("o"), F.lit(0).alias("d"), none(id_type).alias("binding"), none(use_type).alias("use_id"), F.lit(0).cast("bigint").alias("t"), F.col("e.n").alias("n"))
    rows = opens.unionByName(closes).unionByName(asks).withColumn("n", F.lit(0)).unionByName(u)
    # At one position: closings, then openings (the outer first), then uses.
    order = Window.partitionBy(*key).orderBy("pos", "o", "t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"depth": F.sum("d").over(order), "doubt": F.sum("n").over(order)})
    level = Window.partitionBy(*key, "depth").orderBy("pos", "o", "t").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_b", F.last("binding", ignorenulls=True).over(level)).filter("o = 2")
    binding = F.when((F.col("depth") > 0) & (F.col("doubt") == 0), F.col("_b"))
    return found.select(*key, "use_id", binding.alias("binding"))
