"""All pairs of tables at once give what each pair gives alone."""

from itertools import combinations

from hexcadence.operators import merging


def test_all_pairs_equal_single_pairs(spark):
    make = spark.createDataFrame
    tables = {
        "a": make([(i, f"v{i % 3}", None if i % 4 else 1.0) for i in range(40)], "id int, s string, x double"),
        "b": make([(i, f"v{i % 5}", 2.0) for i in range(100, 140)], "id int, s string, x double"),
        "c": make([(i, "v1", i) for i in range(36)], "id int, s string, y int"),
        "d": make([(str(i), f"v{i}") for i in range(40)], "id string, s string"),
        "e": make([(None, None, None)] * 3, "id int, s string, x double"),
        "f": make([(1.5,)], "z double"),
        "g": make([], "id int, s string, x double"),
        "h": make([(i % 20, "k", 0.0) for i in range(60)] + [(i, "k", 0.0) for i in range(20, 40)], "id int, s string, x double"),
    }
    for limit, by_matches in ((5e7, True), (10, True), (100, False)):
        got = {(r["file_a"], r["file_b"]): r for r in merging.merge_decisions(tables, "id", limit, by_matches).collect()}
        assert list(sorted(got)) == sorted(combinations(tables, 2))
        for (a, b), r in got.items():
            alone = merging.merge_decision(tables[a], tables[b], "id", limit, by_matches).first()
            for c in ("strategy", "reason", "join_key"):
                assert r[c] == alone[c], (a, b, c)
            for c in ("similarity", "confidence_merge", "confidence_append"):
                assert r[c] == alone[c] or abs(r[c] - alone[c]) < 1e-12, (a, b, c)
            if r["join_key"]:
                key = r["join_key"]
                assert r["join_rows"] == tables[a].join(tables[b], key).count()
        if limit == 10:
            assert {r["strategy"] for r in got.values()} >= {"append", "reject", "manual_review"}


def test_index_counts_each_value_once_per_table(spark):
    a = spark.createDataFrame([(1, "x"), (1, None), (2, "x")], "id int, s string")
    b = spark.createDataFrame([(1, "y")], "id int, t string")
    got = {(r["column"], r["value"]): (r["n_0"], r["n_1"]) for r in merging.value_index({"a": a, "b": b}).collect()}
    assert got == {("id", "1"): (2, 1), ("id", "2"): (1, 0), ("s", "x"): (2, 0), ("s", None): (1, 0), ("t", "y"): (0, 1)}
