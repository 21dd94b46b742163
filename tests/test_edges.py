"""Hand-made frames: empty, constant, null, infinite, duplicated, awkward times and files."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from hexcadence.functions import ranks, stats
from hexcadence.functions import timefn as T
from hexcadence.operators import (
    clean,
    clusters,
    cube,
    evaluation,
    flags,
    geo,
    graph,
    merging,
    modelling,
    quality,
    relational,
    resolution,
    risk,
    splits,
    timebin,
    windows,
)
from hexcadence.plans import audit, forecast
from hexcadence.sources import files, tables


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def day(n):
    return dt.datetime(2024, 1, n)


# --- time ---------------------------------------------------------------------------------------


def test_clock_text(spark):
    texts = ["1900", "930", "960", "45", "2460", "24:00", "7:5", "7:05:00", "x", None, " 815 ", "12:345"]
    want = ["19:00", "09:30", "09:60", None, None, None, "07:05", None, None, None, "08:15", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in timebin.with_clock(df, "t", "c").orderBy("i").collect()]
    assert got == want


def test_impossible_timestamps_are_null(spark):
    df = spark.createDataFrame(
        [("20240001", 2, 30, "1200"), ("20240002", 2, 29, "960"), ("20240003", 2, 29, "2359"), ("2024x", 1, 1, None)],
        "id string, month int, day int, hr_min string",
    )
    got = [r.datetime for r in timebin.with_timestamp(df, id_col="id").orderBy("id").collect()]
    assert got == [None, None, dt.datetime(2024, 2, 29, 23, 59), None]


def test_unknown_frequency():
    assert T.frequency("two_weekly").count == 2
    assert T.frequency("W").unit == "week"
    with pytest.raises(KeyError):
        T.frequency("yearly")


def test_month_end_calendar_and_gaps(spark):
    df = spark.createDataFrame([(day(i),) for i in range(1, 11) if i not in (3, 7)], "ts timestamp_ntz")
    assert [r[0] for r in rows(timebin.time_gaps(df, "ts", "daily"))] == [day(3), day(7)]
    ends = rows(timebin.calendar(timebin.time_limits(df, "ts"), "monthly_end"))
    assert len(ends) == 12 and ends[1][0] == dt.datetime(2024, 2, 29)
    assert timebin.time_gaps(df.limit(0), "ts", "daily").count() == 0


def test_bins_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        df = spark.createDataFrame([("2024-03-31 02:30:00",)], "s string").select(
            F.col("s").cast("timestamp_ntz").alias("ts")
        )
        got = df.select(*[T.bin_start("ts", f).cast("string") for f in ("hourly", "daily", "weekly")]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert list(got) == ["2024-03-31 02:00:00", "2024-03-31 00:00:00", "2024-03-25 00:00:00"]


# --- cubes and windows --------------------------------------------------------------------------


def series(spark, data):
    out = [(c, day(i + 1), v) for c, vs in data.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(out, "cell string, bin timestamp_ntz, n bigint")


def test_zero_streak(spark):
    df = series(spark, {"a": [0, 0, 1, 0, 0, 0, 1], "b": [1, 0, 0, 1]})
    out = windows.ts_features(df, "cell", "bin", "n").orderBy("cell", "bin").collect()
    assert [r.zero_streak for r in out] == [0, 1, 0, 1, 2, 3, 0, 0, 1, 2, 0]
    assert [r.zero_streak_prev for r in out] == [0, 0, 1, 0, 1, 2, 3, 0, 0, 1, 2]


@pytest.mark.parametrize("limit", [16, 0])
def test_rolling_against_plain_python(spark, monkeypatch, limit):
    monkeypatch.setattr(windows, "MAX_ROLL_BY_LAGS", limit)
    random.seed(3)
    data = {c: [random.randint(0, 5) for _ in range(15)] for c in "abc"}
    out = windows.ts_features(series(spark, data), "cell", "bin", "n").orderBy("cell", "bin").collect()
    for r in out:
        i = r.bin.day - 1
        past = data[r.cell][:i]
        assert r.lag_8 == (past[-8] if i >= 8 else 0)
        for k in (4, 8):
            win = past[-k:] if i >= k else []
            mean = sum(win) / k if win else 0
            std = math.sqrt(sum((x - mean) ** 2 for x in win) / (k - 1)) if win else 0
            assert r[f"roll_sum_{k}"] == sum(win)
            assert r[f"roll_mean_{k}"] == pytest.approx(mean)
            assert r[f"roll_std_{k}"] == pytest.approx(std)


def test_densify_keeps_the_sum_and_fills_the_grid(spark):
    df = spark.createDataFrame(
        [("a", day(2), 3), ("a", day(5), 1), ("b", day(1), 2), ("c", day(4), 1), (None, day(9), 7)],
        "cell string, bin timestamp_ntz, n bigint",
    )
    known = df.where("cell is not null")
    grid = cube.densify(known, "cell", "bin", "n", "daily", min_events=2)
    assert grid.agg(F.sum("n")).first()[0] == 6
    assert grid.count() == 2 * 4 and grid.distinct().count() == 8
    full = cube.densify(known, "cell", "bin", "n", "daily", calendar="full")
    assert full.count() == 3 * 5 and full.agg(F.sum("n")).first()[0] == 7
    lo, hi = (F.lit(day(i)).cast("timestamp_ntz") for i in (1, 6))
    assert cube.densify(known, "cell", "bin", "n", "daily", calendar="full", span=(lo, hi)).count() == 18
    assert cube.densify(df.limit(0), "cell", "bin", "n", "daily").count() == 0


def test_one_cell_one_bin(spark):
    df = series(spark, {"a": [4]})
    out = forecast.windows.ts_features(cube.densify(df, "cell", "bin", "n", "daily"), "cell", "bin", "n").first()
    assert (out.n, out.lag_1, out.zero_streak, out.roll_std_4) == (4, 0, 0, 0)


# --- metrics ------------------------------------------------------------------------------------


def test_constant_column_has_no_correlation(spark):
    df = series(spark, {"a": [1, 1, 1, 1, 1], "z": [0, 0, 0, 0, 0]})
    assert df.agg(stats.safe_corr("n", "n").alias("c")).first().c is not None
    got = resolution.time_stability(df, "cell", "bin", "n").first()
    assert got.stability_corr is None and got.nan_stability == 1.0 and got.stability_diff == 0
    assert quality.zscores(df.where("cell = 'a'"), "n").where("z_score is not null").count() == 0
    zeros = df.where("cell = 'z'")
    assert resolution.gini(zeros, "n").first().gini is None
    assert resolution.gini(zeros, "n", zero_sum=0.0).first().gini == 0.0
    assert resolution.entropy(zeros, "n").first().entropy is None


def test_sparse_sweep_equals_dense_metrics(spark):
    random.seed(11)
    raw = [(f"c{c}", day(b), random.randint(1, 4)) for c in range(12) for b in range(1, 13) if random.random() < 0.4]
    counts = spark.createDataFrame(raw, "cell string, time_bin timestamp_ntz, n bigint")
    long = counts.select(F.lit(1).alias("resolution"), F.lit("daily").alias("freq"), "cell", "time_bin", "n")
    got = resolution.sweep(long, min_events=3).first().asDict()
    grid = cube.densify(counts, "cell", "time_bin", "n", "daily", min_events=3)
    want = {
        **resolution.base_stats(grid, "n").first().asDict(),
        **resolution.entropy(grid, "n").first().asDict(),
        **resolution.gini(grid, "n").first().asDict(),
        **resolution.time_stability(grid, "cell", "time_bin", "n").first().asDict(),
        **resolution.active_bins(grid, "cell", "n").first().asDict(),
        **resolution.median_non_zero(grid, "cell", "n").first().asDict(),
        **resolution.event_intensity(grid, "cell", "n").first().asDict(),
    }
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k
    assert got["n_unique_cells"] == grid.select("cell").distinct().count()


@pytest.mark.parametrize("partitions", [1, 5, None])
def test_running_totals_over_any_number_of_ranges(spark, partitions):
    random.seed(6)
    data = [(g, float(v), random.randint(1, 9)) for g in "ab" for v in random.sample(range(10_000), 700)]
    hist = spark.createDataFrame(data, "g string, v double, f bigint")
    for descending in (False, True):
        out = ranks.running_totals(hist, "v", {"c": "f"}, ["g"], descending, totals={"t": "f"}, partitions=partitions)
        for g in "ab":
            rows_g = sorted((r for r in data if r[0] == g), key=lambda r: r[1], reverse=descending)
            want, run = {}, 0
            for _, v, f in rows_g:
                want[v] = run
                run += f
            got = out.where(F.col("g") == g).collect()
            assert {r.v: r.c for r in got} == want and {r.t for r in got} == {run}


def test_quantiles_and_ranks_with_ties_and_skew(spark):
    random.seed(5)
    values = [("hot", 1.0)] * 500 + [("hot", random.random()) for _ in range(300)] + [("cold", float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {(r.g, r.prob): r["quantile"] for r in ranks.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.99, 1.0], ["g"]).collect()}
    for g in ("hot", "cold"):
        want = df.where(F.col("g") == g).agg(F.percentile("v", F.array(*[F.lit(p) for p in (0.0, 0.1, 0.5, 0.99, 1.0)]))).first()[0]
        assert [got[g, p] for p in (0.0, 0.1, 0.5, 0.99, 1.0)] == pytest.approx(want)


def test_quantiles_of_large_groups_use_brackets_and_stay_exact(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("rest").alias("g"),
        F.when(F.col("id") % 5 == 0, F.lit(0.25)).otherwise(F.pmod(F.col("id") * 7919, F.lit(60_013)) / 60_013).alias("v"),
    )
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.9995, 1.0]
    near = ranks.histogram_near(df, "v", probs, ["g"])
    assert near.count() < 0.2 * df.select("g", "v").distinct().count()
    got = {(r.g, r.prob): r["quantile"] for r in ranks.exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g in ("hot", "rest"):
        want = df.where(F.col("g") == g).agg(F.percentile("v", F.array(*[F.lit(p) for p in probs]))).first()[0]
        assert [got[g, p] for p in probs] == pytest.approx(want, abs=1e-12)


def test_dense_index_is_the_sorted_position(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("k"))
    got = [r.k for r in ranks.dense_index(df.repartition(7), ["k"], "i").orderBy("i").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert ranks.dense_index(df, ["k"], "i").agg(F.max("i")).first()[0] == 999


# --- geo ----------------------------------------------------------------------------------------


def test_coordinate_classes(spark):
    data = [(48.8, 2.3), (2.3, 48.8), (5000000.0, 700000.0), (700000.0, 5000000.0), (0.0, 0.0), (None, 2.0), (float("nan"), 2.0)]
    want = ["wgs84", "swapped_wgs84", "lambert93_like", "swapped_lambert93", "invalid", "missing", "missing"]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(data)], "i int, lat double, lon double")
    assert [r.coord_class for r in geo.classify_coordinates(df, "lat", "lon").orderBy("i").collect()] == want
    assert geo.to_degrees(geo.classify_coordinates(df, "lat", "lon"), "lat", "lon", invalid="drop").count() == 6


def test_reprojection_of_the_origin(spark):
    df = spark.createDataFrame([(6600000.0, 700000.0)], "y double, x double")
    lon, lat = geo.LAMBERT_93.inverse(F.col("x"), F.col("y"))
    got = df.select(lon.alias("lon"), lat.alias("lat")).first()
    assert (got.lon, got.lat) == (pytest.approx(3.0, abs=1e-9), pytest.approx(46.5, abs=1e-9))


def test_cells_contain_their_points_and_parents_add_up(spark):
    random.seed(1)
    pts = [(i, random.uniform(42, 51), random.uniform(-4, 8)) for i in range(400)]
    df = spark.createDataFrame(pts, "i int, lat double, lon double")
    cells = geo.with_cells(df, "lat", "lon", [0, 2, 4])
    # A parent is a function of its child.
    assert cells.select("cell_res4").distinct().count() == cells.select("cell_res4", "cell_res2", "cell_res0").distinct().count()
    # The nearest centre is nearer than every neighbour's.
    box = geo.with_boundary(cells, "cell_res4").select(
        "lat", "lon", F.transform("boundary", lambda b: b["lat"]).alias("la"), F.transform("boundary", lambda b: b["lon"]).alias("lo")
    )
    outside = box.where(
        (F.col("lat") > F.array_max("la") + 1e-9)
        | (F.col("lat") < F.array_min("la") - 1e-9)
        | (F.col("lon") > F.array_max("lo") + 1e-9)
        | (F.col("lon") < F.array_min("lo") - 1e-9)
    )
    assert outside.count() == 0
    near = geo.neighbours(cells.select("cell_res4").distinct(), "cell_res4", k=2)
    assert near.count() == 18 * cells.select("cell_res4").distinct().count()
    # A filter on the coarsest cell must not unfold the levels below.
    plan = cells.where(F.col("cell_res0") == "0:1:2")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000


def brute_clusters(points, eps):
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(points)), 2):
        if math.dist(points[i], points[j]) <= eps:
            parent[root(i)] = root(j)
    sizes = {}
    for i in range(len(points)):
        sizes[root(i)] = sizes.get(root(i), 0) + 1
    return sorted(n for n in sizes.values() if n >= 2)


@pytest.mark.parametrize("kind", ["random", "line", "hot"])
def test_spatial_clusters_against_brute_force(spark, kind):
    random.seed(7)
    if kind == "random":
        pts = [(random.uniform(0, 0.03), random.uniform(0, 0.03)) for _ in range(500)]
    elif kind == "line":
        pts = [(-1 + i * 0.00049, 2.0) for i in range(150)] + [(-1 + 151 * 0.00049, 2.0)]
    else:
        pts = [(1.0, 1.0)] * 200 + [(1 + random.gauss(0, 0.0004), 1 + random.gauss(0, 0.0004)) for _ in range(200)] + [(3.0, 3.0)]
    df = spark.createDataFrame(pts, "lat double, lon double")
    got = sorted(r.n_members for r in clusters.spatial_clusters(df, "lat", "lon", 0.0005).collect())
    assert got == brute_clusters(pts, 0.0005)


# --- quality, cleaning, merging -----------------------------------------------------------------


def test_checks_on_awkward_numbers(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan), (2, inf), (3, -inf), (4, None), (5, 0.0)], "i int, v double")
    missing = {r.column: r for r in quality.missing_analysis(df).collect()}
    assert missing["v"].nan_count == 2 and missing["i"].nan_count == 0
    assert {r.column: r.inf_count for r in quality.infinite_analysis(df).collect()} == {"i": 0, "v": 2}
    empty = quality.missing_analysis(df.limit(0)).collect()
    assert all(not r.flagged and r.nan_count == 0 for r in empty)


def test_duplicates_and_kept_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None), (2, None)], "k int, v string")
    got = {r.scope: r.n_duplicates for r in quality.duplicate_analysis(df, ["k"]).collect()}
    assert got == {"general": 2, "grouped": 3}
    keyed = df.withColumn("o", F.monotonically_increasing_id())
    assert clean.drop_duplicates(keyed, ["k"], order_by="o").count() == 2


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    assert rows(clean.impute(df, ["s"], "median")) == [("a",), ("a",), ("b",)]
    assert rows(clean.impute(df, ["s"], "zero")) == [("0",), ("a",), ("b",)]


def test_lists(spark):
    texts = ["['a', 'b']", '["x"]', "[1, 2]", "[broken", "p, q,,", "plain", "", None, "[a b]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.l for r in df.select("i", clean.parse_list("t").alias("l")).orderBy("i").collect()]
    assert got == [["a", "b"], ["x"], ["1", "2"], [], ["p", "q"], [], [], [], []]


def test_half_even_integers(spark):
    df = spark.createDataFrame([("0.5",), ("1.5",), ("2.5",), ("x",)], "v string")
    assert [r.v for r in clean.normalise_integers(df, ["v"]).collect()] == [0, 2, 2, None]


def test_merge_decisions(spark):
    a = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))
    cases = {
        "append": a.withColumn("k", F.col("k") + 1000),
        "merge": a.withColumn("v", F.col("v") + 1),
        "manual_review": a.withColumn("k", F.col("k") + 50),
        "reject": a.drop("v"),
    }
    for want, b in cases.items():
        assert merging.merge_decision(a, b, "k").first().strategy == want, want
    none = spark.range(10).select(F.lit(1).cast("int").alias("v"))
    assert merging.merge_decision(none, none.select(F.col("v").cast("string")), "k").first().reason == "no valid join key"
    assert merging.execute_decision(a, cases["append"], merging.merge_decision(a, cases["append"], "k")).count() == 200
    wide = cases["merge"].withColumn("w", F.lit(1))
    assert merging.execute_decision(a, wide, merging.merge_decision(a, wide, "k")).columns == ["k", "v", "w"]
    with pytest.raises(ValueError):
        merging.execute_decision(a, cases["reject"], merging.merge_decision(a, cases["reject"], "k"))


def test_risk_levels_and_cap(spark):
    df = spark.createDataFrame(
        [("time_gaps", "missing_time_periods", "c", 500.0), ("other", "x", "c", None)],
        "check string, issue_type string, column string, value double",
    )
    scored = risk.with_points(risk.with_severity(df))
    assert sorted(r.points for r in scored.collect()) == [5, 105]
    assert risk.risk_summary(scored).first().risk_level == "medium"
    assert risk.risk_summary(scored.limit(0)).first().risk_level == "ok"


def test_audit_to_plan(spark):
    df = spark.createDataFrame(
        [(i, float(i % 2) if i < 4 else None, 48.0, 2.0) for i in range(10)], "id int, v double, lat double, lon double"
    )
    found = audit.run_all({"t": df}, {"table": True, "geo_data": True})
    plan = audit.as_plan(audit.recommend(found), {"impute_nan": {"strategy": "zero"}})
    assert {"action": "impute_nan", "target": ["v"], "params": {"strategy": "zero"}} in plan
    assert any(p["action"] == "drop_geo_duplicates" for p in plan)
    assert clean.apply_plan(df, plan).where("v is null").count() == 0


def test_joins_reject_bad_keys(spark):
    a = spark.range(3)
    with pytest.raises(ValueError):
        relational.join_all([a, a.withColumnRenamed("id", "x")], ["id"])
    with pytest.raises(ValueError):
        relational.join_all([a, a], [])
    both = a.withColumn("v", F.lit(1))
    with pytest.raises(ValueError):
        relational.join_all([both, both], ["id"])
    renamed = relational.Side(both, renamed={"v": "w"})
    assert relational.join_all([both, renamed, relational.Side(both, without=("v",))], ["id"]).columns == ["id", "v", "w"]


def test_flags_on_nulls(spark):
    df = spark.createDataFrame([(None, None), (10, 1)], "maneuver int, secu int")
    out = flags.add_code_flags(df, flags.MANEUVER_FLAGS).orderBy("maneuver").collect()
    assert [r.is_turning for r in out] == [False, True]


# --- evaluation and models ----------------------------------------------------------------------


def test_areas_in_edge_cases(spark):
    one_class = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")
    assert evaluation.areas(one_class, "y", "p").first().roc_auc is None
    ties = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.5), (0, 0.5)], "y int, p double")
    got = evaluation.areas(ties, "y", "p").first()
    assert (got.roc_auc, got.pr_auc) == (0.5, 0.5)
    never = spark.createDataFrame([(1, 0), (0, 0)], "y int, q int")
    assert tuple(evaluation.metrics(never, "y", "q").first()) == (0.0, 0.0, 0.0, 0.0)


def test_sweep_buckets_at_the_thresholds_themselves(spark):
    ts = evaluation.linear_thresholds(0.0, 1.0, 101)
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate([*ts, 1.5, -0.5, 0.005])], "y int, p double")
    scores = [r.p for r in df.collect()]
    got = {r.threshold: (r.tp + r.fp) for r in evaluation.threshold_counts(df, "y", "p", ts).collect()}
    for t in ts:
        assert got[t] == sum(s >= t for s in scores)


def test_stratified_share_is_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = rows(splits.stratified_holdout(df, "id", "y").where("is_holdout").groupBy("y").count())
    assert got == [(0, 180), (1, 20)]


def test_model_beats_always_one_and_persistence(spark):
    from hexcadence.workload.models import forecast_evaluation

    got = {r.model: r for r in forecast_evaluation(spark, "/root/testdata/sf0.01").collect()}
    assert got["logistic"].roc_auc > got["persistence"].roc_auc
    assert got["logistic"].pr_auc > 0.5


def test_pca_shares_add_to_one(spark):
    random.seed(2)
    data = [([x := random.random(), 2 * x, random.random()],) for _ in range(200)]
    report = modelling.pca_report(spark.createDataFrame(data, "v array<double>"), "v", 3)
    assert report.components.agg(F.sum("variance_ratio")).first()[0] == pytest.approx(1.0)
    assert modelling.components_needed(report.components).first().n_95 == 2


# --- files and tables ---------------------------------------------------------------------------


@pytest.mark.parametrize("sep", ["\t", ";", ","])
def test_messy_csv(spark, tmp_path, sep):
    lines = [["id", "prix", "nom"], ["1", "2.5", "été"], ["2", "3"], ["3", "4", "a", "extra"], ["4", "", f'"x{sep}y"']]
    path = tmp_path / "f.csv"
    path.write_bytes("\n".join(sep.join(x) for x in lines).encode("latin1"))
    got = rows(files.read_delimited(spark, str(path)).withColumn("prix", clean.to_number("prix")), "id", "nom")
    assert got[0] == ("1", "été") and ("2", None) in got and ("4", f"x{sep}y") in got and len(got) == 3
    with pytest.raises(ValueError):
        files.detect_delimiter("one")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "2", 0.5), (2, "x", 0.7)], "id int, code string, v double")
    try:
        check = tables.save_table(
            df, "hexcadence_t", dtypes={"id": "bigint", "code": "smallint", "v": "double"}, key="id", replace=True
        ).first()
        assert check.unique and tables.table_exists(spark, "hexcadence_t")
        assert [r.dtype for r in tables.table_schema(spark, "hexcadence_t").orderBy("position").collect()] == [
            "bigint",
            "smallint",
            "double",
        ]
        src = spark.createDataFrame([(2, "c9")], "id int, cell string")
        tables.update_table(spark, "hexcadence_t", src, "id", ["cell"], "hexcadence_u")
        assert spark.table("hexcadence_u").count() == 2
        assert rows(spark.table("hexcadence_u").where("cell is not null"), "id", "cell") == [(2, "c9")]
        both = tables.scan_cubes(spark, {(4, "weekly"): "hexcadence_t", (5, "weekly"): "hexcadence_u"})
        assert both.groupBy("resolution").count().count() == 2
    finally:
        spark.sql("DROP TABLE IF EXISTS hexcadence_t")
        spark.sql("DROP TABLE IF EXISTS hexcadence_u")


def test_checks_on_tables_without_such_columns(spark):
    numbers = spark.createDataFrame([(1, 2.0)], "i int, v double")
    texts = spark.createDataFrame([("a",)], "s string")
    for names in (["cardinality"], ["infinite"], ["zero_inflation"], ["skewness"]):
        assert audit.run_checks(numbers, names).count() >= 0
        assert audit.run_checks(texts, names).count() >= 0
    assert quality.top_values(numbers).count() == 0


def test_json_and_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("4:1:2", 4, 3)], "cell string, resolution int, n int")
    feats = geo.geojson_features(df, "resolution", "cell", "n")
    files.write_text(feats, "feature", str(tmp_path / "g"))
    assert '"type":"Polygon"' in spark.read.text(str(tmp_path / "g")).first()[0]
    for _ in range(2):
        files.write_json(df, str(tmp_path / "j"), mode="append")
    assert files.read_json(spark, str(tmp_path / "j"), "cell string, n int").count() == 2
    assert files.as_json(df, ["cell", "n"]).first().document == '{"cell":"4:1:2","n":3}'
    assert files.clean_file_name("acc - 2010.csv") == "acc_2010.csv"
    assert files.clean_file_name(" a b-c") == "a_b_c"
    assert set(files.list_folder(spark, str(tmp_path))) >= {"g", "j"}


def test_target_schema(spark):
    df = spark.createDataFrame([(1, "a", 0.5, True)], "id bigint, s string, v double, b boolean")
    want = {"id": "BIGINT PRIMARY KEY", "s": "VARCHAR(255)", "v": "DOUBLE PRECISION", "b": "BOOLEAN"}
    assert quality.target_schema(df, "id") == want
    assert quality.split_date_columns(["An", "mois", "x"]) == ["An", "mois"]
    assert geo.detect_geo_columns(["Latitude", "long", "gps"]) == {"lat": ["Latitude"], "lon": ["long"], "gps": ["gps"]}


@pytest.mark.parametrize("n", [1, 2, 11, 12, 13, 100])
def test_uneven_thresholds(spark, n):
    random.seed(n)
    ts = sorted({round(random.random() ** 3, 4) for _ in range(n)})
    rows = [(i, round(random.random(), 3), i % 3 == 0) for i in range(300)] + [(i, t, True) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "id int, p double, y boolean").withColumn("y", F.col("y").cast("int"))
    got = {r.threshold: (r.tp, r.fp) for r in evaluation.threshold_counts(df, "y", "p", ts).collect()}
    assert got == {t: (sum(p >= t and y for _, p, y in rows), sum(p >= t and not y for _, p, y in rows)) for t in ts}


def test_duplicates_without_order_values(spark):
    rows = [(1, None, "a"), (1, None, "b"), (2, None, "c"), (2, 5, "d"), (2, 7, "e"), (None, 1, "f")]
    df = spark.createDataFrame(rows, "k int, at int, v string")
    for keep, want in (("first", "d"), ("last", "e")):
        got = {r.k: r for r in clean.drop_duplicates(df, ["k"], keep, "at").collect()}
        assert set(got) == {1, 2, None} and got[2].v == want and got[1].v in "ab" and got[None].v == "f"
    with pytest.raises(ValueError):
        clean.drop_duplicates(df, ["k"], "last")
    with pytest.raises(ValueError):
        clean.drop_duplicates(df, ["k"], "middle", "at")


def test_rows_without_a_bin_stay(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 1, 4.0), (3, 2, 8.0), (4, 3, None)], "id int, bin int, f double")
    split = {r.id: r.split for r in splits.temporal_split(df, "bin", 0.5).collect()}
    assert split == {1: "train", 2: "train", 3: "test", 4: "test"}
    assert {r.id: r.scaled_persistence for r in graph.baselines(df, "f", "bin").collect()}.keys() == {1, 2, 3, 4}


def test_description_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), None), (3.0, 3)], "x double, n int")
    got = {r.column: r for r in resolution.describe_numeric(df, ["x", "n"]).collect()}
    for r in got.values():
        assert (r.count_clean, r.nan_count, r.mean, r.max, r.median) == (2, 1, 2.0, 3.0, 2.0)
    assert resolution.describe_numeric(df.limit(0), ["x"]).count() == 0


def test_merge_by_real_matches(spark):
    a = spark.range(200).withColumn("v", F.lit(1))
    b = spark.range(200).withColumn("v", F.lit(2))
    assert merging.merge_decision(a, b, "id", max_join_rows=1000).first().strategy == "reject"
    assert merging.merge_decision(a, b, "id", max_join_rows=1000, by_matches=True).first().strategy == "merge"


def test_unknown_parameters_of_an_action(spark):
    with pytest.raises(ValueError):
        clean.apply_plan(spark.range(3), [{"action": "impute_nan", "target": ["id"], "params": {"way": "zero"}}])


def test_both_rolling_forms_agree(spark, monkeypatch):
    random.seed(3)
    rows = [(c, i, random.choice([None, 0.0, 1.5, random.random() * 1e6])) for c in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "cell string, bin int, y double")
    out = []
    for limit in (16, 0):
        monkeypatch.setattr(windows, "MAX_ROLL_BY_LAGS", limit)
        got = windows.ts_features(df, "cell", "bin", "y", rolls=[2, 4, 9]).orderBy("cell", "bin")
        out.append(got.select(sorted(got.columns)).collect())
    for a, b in zip(*out, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or x == pytest.approx(y, rel=1e-6, abs=1e-3)
