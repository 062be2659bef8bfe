"""Registered queries next to their SQL checks on the smallest data."""
import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
FAST = ["stats_comparisons", "stats_run_cells", "calib_risk_coverage", "schema_exact_duplicates", "score_schema_errors", "score_route",
        "integrity_validate_rows", "overlay_violations", "ledger_check", "bm25_shortlist", "leak_issues", "lookalike_keys", "catalogs",
        "sft_rows", "info_audit", "score_hostile", "near_dup_greedy_documents", "families_schemas", "calib_temperature", "schema_printed_sizes", "stream_pauses", "stream_pause_batch", "io_append_results", "metric_lookup",
        "score_rule_keywords", "score_unchecked_keywords", "stream_stop_chains", "stream_sessions", "stream_rate_summary_batch", "bm25_scores"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not mounted")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_check(spark, name):
    state, note, _ = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "ok", note


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not mounted")
def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3


def test_lookup_refuses_unknown_keys(spark):
    from callscope.sources.files import lookup
    keys = spark.createDataFrame([("main", "arm=x", "e2e")], "kind string, selector string, field string")
    metrics = spark.createDataFrame([("main", "arm=y", "e2e", 0.5)], "kind string, selector string, field string, value double")
    with pytest.raises(Exception, match="unknown key"):
        lookup(keys, metrics).collect()


def test_corpus_reader(spark, tmp_path):
    from callscope.sources.files import read_schema_corpus
    for sub, name in (("B", "x"), ("A", "y"), ("A", "c")):
        (tmp_path / sub).mkdir(exist_ok=True)
        (tmp_path / sub / f"{name}.json").write_text('{"n":\n "%s"}' % name)
    got = [r.schema_id for r in read_schema_corpus(spark, str(tmp_path), ["B", "A"]).orderBy("load_order").collect()]
    assert got == ["B/x", "A/c", "A/y"]
