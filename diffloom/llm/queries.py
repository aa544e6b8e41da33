"""The registered queries of this subpackage: thin forms of the operators, with the columns their contracts fix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm import decontaminate, jaccard_join, language, line_dedup, packing, periodic, phrase_dedup, privacy, simhash, suffix_dedup, tokenizers_align, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(modulus: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.col("_kept"), 256).alias("kept_sha256"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model = language.fit(docs, ~held_out & F.col("doc_id").isNotNull())
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, folder, "documents"))
    return out.select(F.col("_id").alias("doc_id"), simhash.hex_of().alias("fingerprint"), "component_id")


def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return out.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


def op6_privacy(spark: SparkSession, folder: str) -> DataFrame:
    out = privacy.find_personal_data(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    counts = [F.col(f"_n_{k}").alias(f"n_{k}") for k in privacy.KINDS]
    return out.select("doc_id", *counts, F.sha2("_base", 256).alias("base_sha256"), F.col("_spans").alias("spans"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op8_phrase_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = phrase_dedup.drop_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    index = toxicity.fit(docs, table(spark, folder, "labels"), ~held_out)
    out = toxicity.score(docs.select("doc_id", "text"), index)
    return out.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.drop_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256")
    )


def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    out = jaccard_join.join(table(spark, folder, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic.planted(table(spark, folder, "documents").select("doc_id", "text"))
    out = periodic.find_runs(docs).withColumn("best", F.array_max(F.transform("_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("shorter")))))
    listed = F.array_join(F.transform("_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length, period = F.col("best.length"), -F.col("best.shorter")
    return out.select(
        "doc_id",
        F.size("_runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("_kept", 256).alias("collapsed_sha256"),
    )


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    out = tokenizers_align.align_tokens(table(spark, folder, "documents"), digest=True)
    return out.select(F.col("_id").alias("doc_id"), *tokenizers_align.MEASURES, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language": op2_language,
    "op3_simhash": op3_simhash,
    "op4_top_k": op4_top_k,
    "op5_decontamination": op5_decontamination,
    "op6_privacy": op6_privacy,
    "op7_packing": op7_packing,
    "op8_phrase_dedup": op8_phrase_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {}

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_line_dedup"] = f"""
with lines as (
  select doc_id, unnest(range(len(parts))) as pos, unnest(parts) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)
), keyed as (
  select *, {_FOLD.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from lines
), frequent as (
  select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10
), judged as (
  select k.*, f.key is not null as drop_it from keyed k left join frequent f using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (drop_it) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not drop_it), '')) as kept_sha256
from judged group by doc_id
"""

ORACLES["op5_decontamination"] = rf"""
with words as (
  select doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, least(len(w), 13) as n, list_aggregate(list_slice(w, i, i + least(len(w), 13) - 1), 'string_agg', ' ') as words
  from (select *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from items where len(w) > 0)
), spots as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, (select distinct n from windows) where len(w) >= n
), met as (
  select s.doc_id, s.i, s.n, v.item_id from (select doc_id, i, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') as words from spots) s
  join windows v on v.n = s.n and v.words = s.words
), hits as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from met) group by doc_id
), listed as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item from met) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from words d left join hits using (doc_id) left join listed using (doc_id)
"""

ORACLES["op4_top_k"] = """
with v as (
  select vec_id, [floor(64 * cast(x as double)) for x in embedding] as e from embeddings
  where vec_id is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
