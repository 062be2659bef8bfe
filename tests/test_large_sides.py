"""No derived side is broadcast by the size of its file; large files are digested in pieces; reasons are counted in one pass."""
import hashlib

from callscope.operators import corpus as co
from callscope.operators import integrity as ig


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlay_merges_its_sides(spark):
    rows = spark.createDataFrame([("a", "pending", "f", None), ("b", None, "g", "x"), (None, "pending", "h", None)],
                                 "request_key string, prefix_check string, fingerprint string, failure_class string")
    rows = rows.selectExpr("*", "false AS engine_error", "cast(null as string) AS request_error")
    patches = spark.createDataFrame([(1, "a", "f", "true"), (2, "a", "f", "true"), (3, "b", "g", "true"), (4, "z", "g", "true")],
                                    "patch_id long, request_key string, source_sha256 string, legal_prefix string")
    done, bad = ig.effective_rows(rows, patches)
    assert "BroadcastHashJoin" not in plan_of(done) + plan_of(bad)
    assert sorted((r.request_key or "", r.prefix_check) for r in done.collect() if r.request_key != "b") == [("", "pending"), ("a", "verified")]
    assert sorted((r.patch_id, r.problem) for r in bad.collect()) == [(2, "duplicate_patch"), (3, "not_pending"), (4, "unknown_key")]


def test_mounted_files_are_digested_in_pieces(spark, tmp_path):
    texts = {"a b.json": b"y", "c+d%20.json": b"x" * 3_000_000}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    m = ig.manifest(spark, str(tmp_path))
    assert "content:binary" not in plan_of(m)
    assert {r.artefact.rsplit("/", 1)[1]: (r.sha256, r.length) for r in m.collect()} == {n: (hashlib.sha256(t).hexdigest(), len(t)) for n, t in texts.items()}


def test_reasons_are_counted_in_one_pass(spark):
    d = spark.createDataFrame([(["x:1", "y"],), (["x:2", "x"],), ([],), (None,)], "exclusion_reasons array<string>")
    got = co.reason_counts(d)
    assert {r.reason: (r.n_all, r.n_first) for r in got.collect()} == {"x": (3, 2), "y": (1, 0)}
    assert "Union" not in plan_of(got)
