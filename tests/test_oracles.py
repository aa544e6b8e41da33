"""Every registered query against its DuckDB oracle on the smallest data set."""

import pytest
from compare import check

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

#: Beyond SQL: tests of their own hold these against plain versions, round trips or held-out accuracy.
WITHOUT_ORACLE = {
    *("s12_markup_nodes", "j27_match_nodes", "j28_match_containers", "h5_whole_units", "pipeline"),
    *("op2_language", "op3_simhash", "op6_privacy", "op7_packing", "op8_phrase_dedup", "op9_toxicity", "op10_suffix_dedup"),
    *("op11_jaccard_join", "op12_periodic_runs", "op13_token_alignment"),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, name):
    line = check(spark, name, "0.001", queries=QUERIES, oracles=ORACLES)
    assert line.startswith("ROWS" if name in WITHOUT_ORACLE else "ok"), line
    assert "EMPTY" not in line and " 0 rows" not in line, line


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
