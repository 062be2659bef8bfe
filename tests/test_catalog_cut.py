"""A first cut by hash changes no catalog, also where it leaves too few families to some replicates."""
from callscope.operators import selection as se


def test_cut_is_exact(spark, monkeypatch):
    pool = spark.createDataFrame([(f"t{i}", f"f{i // 2}", "flat" if i % 3 else "structured") for i in range(900)], "tool_id string, family string, stratum string")
    targets = spark.createDataFrame([(r, s, f"t{7 * r + s}", f"f{(7 * r + s) // 2}", "flat") for r in range(6) for s in range(2)],
                                    "replicate int, slot int, tool_id string, family string, stratum string")
    seen = []
    for margin in (1000, 8, 1):
        monkeypatch.setattr(se, "MARGIN", margin)
        seen.append(sorted(map(tuple, se.build_catalogs(pool, targets, 6, [5, 12], 3).collect())))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 6 * 17
