"""Audit of several tables: order of checks, one scan, edge cases."""

from datetime import datetime

from hexcadence.plans import audit_tables
from hexcadence.plans.audit_tables import CHECKS, Check, audit, ordered


def rows(df):
    return {(r["table"], r["other"], r["check"], r["column"]): (r["value"], r["flagged"]) for r in df.collect()}


def test_checks_follow_what_they_need():
    names = [c.name for c in ordered(CHECKS)]
    assert names.index("time_range") < names.index("time_gaps") and names.index("time_range") < names.index("time_overlap")
    assert sorted(names) == sorted(c.name for c in CHECKS)
    late = Check("late", "table", "m", lambda v: False, needs=("time_gaps",))
    assert [c.name for c in ordered([late])] == ["time_range", "time_gaps", "late"]


def test_findings_of_small_tables(spark):
    day = lambda d: datetime(2024, 1, d)
    a = spark.createDataFrame(
        [(1, day(1), "2024-01-01", 50.0, 4.0), (2, day(2), "x", 95.0, 4.0), (2, day(5), None, 50.0, 4.0), (2, day(5), None, 50.0, 4.0)],
        "a_key int, at timestamp, said string, lat double, lon double",
    )
    b = spark.createDataFrame([(2, day(5)), (3, day(9))], "a_key int, seen timestamp")
    got = rows(audit({"a": a, "b": b}))
    assert got["a", None, "datetime", "said"] == (0.5, False)
    assert got["a", None, "missing", "said"] == (0.5, False)
    assert got["a", None, "time_range", "at"] == (5.0, False)
    assert got["a", None, "time_gaps", "at"] == (2.0, True)
    assert got["a", None, "duplicates", "all"] == (0.25, True) and got["b", None, "duplicates", "all"] == (0.0, False)
    assert got["a", None, "geo_range", "lat"] == (0.25, True) and got["a", None, "geo_range", "lon"] == (0.0, False)
    assert got["a", None, "geo_duplicates", "lat,lon"] == (0.5, True)
    assert got["a", "b", "key_overlap", "a_key"] == (0.5, True) and got["b", "a", "key_overlap", "a_key"] == (0.5, True)
    assert got["a", "b", "time_overlap", "at,seen"] == (0.2, False)
    # Needed facts are not findings unless asked for.
    assert {k[2] for k in rows(audit({"a": a}, ["time_gaps"]))} == {"time_gaps"}


def test_empty_tables_and_odd_names(spark):
    schema = "`a b key` int, at timestamp, lat double, lng double, said string"
    got = rows(audit({"none": spark.createDataFrame([], schema)}))
    assert all(not flagged for _, flagged in got.values())
    assert got["none", None, "duplicates", "all"] == (None, False)
    assert not any(k[2] == "time_gaps" for k in got)


def test_scalar_checks_share_one_scan(spark, tmp_path):
    """The scan that groups whole rows gives all scalar checks: the source is read once."""
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id AS STRING) AS s").write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(path)
    n, groups, parts = audit_tables.scan(df.mapInArrow(counted, df.schema), CHECKS)
    assert (n, groups, seen.value) == (1000, 1000, 1000)
    assert parts["missing", "x"] == {"bad": 0} and ("skewness", "x") in parts
