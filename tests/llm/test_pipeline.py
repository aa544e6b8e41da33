"""The pipeline stage by stage against plain versions, on a small folder of tables."""

import numpy as np
from llm_tables import documents
from test_text_operators import fingerprint, key_of, parts

import corpus_pipeline

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def folder_of(spark, tmp_path_factory, docs):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{folder}/documents.parquet")
    passage = "quam lorum ipsam dolet sitar amen constell adipis elitra sedan doris eius tempor incid utlab"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, passage


def test_stages(spark, messy, tmp_path_factory):
    docs = documents(spark, messy)
    folder, passage = folder_of(spark, tmp_path_factory, docs)
    docs = documents(spark, [*messy, (300, passage)])
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "decontamination", "packing"]
    lettered = stages["language"](spark, docs, folder)
    assert lettered.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in lettered.collect())
    assert got == sorted((i is None, i or 0, t) for i, t in [*messy, (300, passage)] if any(c.isalpha() for c in t or ""))
    lined = stages["lines"](spark, lettered, folder)
    rows = lined.collect()
    assert lined.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in rows) and all(r["_kept"] == "_kept" for r in rows)
    assert not any(key_of("all rights reserved.") in {key_of(x) for x in r["text"].split("\n")} for r in rows)
    lone = stages["near_duplicates"](spark, lined, folder)
    root = parts(sorted({fingerprint(r["text"]) for r in rows}), 2)
    kept = lone.collect()
    assert len(kept) == len(set(root.values())) and lone.columns == docs.columns
    clean = stages["decontamination"](spark, lone, folder)
    assert {r["doc_id"] for r in kept} - {r["doc_id"] for r in clean.collect()} == {300}
    packed = stages["packing"](spark, clean, folder).collect()
    assert sum(r["n_tokens"] for r in packed) == sum(len(r["text"].encode().split()) for r in clean.collect())


def test_run_on_the_smallest_tables(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and np.all([r["offset"] + r["n_tokens"] <= r["capacity"] for r in rows if r["n_tokens"]])
