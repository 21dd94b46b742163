"""Global ranks, cumulative sums and exact quantiles without a one-task sort.

The pattern is always the same: collapse rows to distinct values first, deal them to ranges of the value, add up the
ranges' totals (a row per range and group) and run the window inside each range only.  No task ever sees all the values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexcadence.session import materialise

# Quantile brackets: the sketch errs by 1 / accuracy of the rows at most, an eighth of the bracket.
SKETCH_ACCURACY = 4_000
BRACKET = 0.002
# From this many rows on a bracket holds the sketch's error and the two ranks beside the wanted one; groups with fewer
# rows have no such bracket, so their values are all inside.
BRACKETED_ROWS = ceil(2 / (BRACKET - 1 / SKETCH_ACCURACY))


def value_histogram(
    df: DataFrame, value: str, groups: Sequence[str] = (), freq: str = "n_rows"
) -> DataFrame:
    """One row per distinct value (and group) with its row count; nulls are left out."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias(freq))
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys whose nulls match each other; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


def running_totals(
    hist: DataFrame,
    value: str,
    sums: dict[str, str],
    groups: Sequence[str] = (),
    descending: bool = False,
    totals: dict[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add exclusive cumulative sums of ``sums`` (output -> input) in the order of ``value``.

    ``hist`` must hold one row per (groups, value).  ``totals`` (output -> input) adds sums over the
    whole group.  The histogram is dealt to ranges of (groups, value) and checkpointed, because range
    totals and cumulative sums both read them.
    """
    groups, totals = list(groups), totals or {}
    order = F.col(value).desc() if descending else F.col(value).asc()
    ranges = [*map(F.col, groups), order]
    dealt = hist.repartitionByRange(partitions, *ranges) if partitions else hist.repartitionByRange(*ranges)
    cut = materialise(dealt.withColumn("_range", F.spark_partition_id()))
    in_group = Window.partitionBy(*groups)
    before = in_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A row per group and range in which it has rows: ranges and groups together at most.
    offsets = (
        cut.groupBy(*groups, "_range")
        .agg(
            *[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()],
            *[F.sum(src).alias(f"_g_{out}") for out, src in totals.items()],
        )
        .select(
            *groups,
            "_range",
            *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_b_{out}") for out in sums],
            *[F.sum(f"_g_{out}").over(in_group).alias(out) for out in totals],
        )
    )
    inside = Window.partitionBy(*groups, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.select(
        "*", *[F.coalesce(F.sum(src).over(inside), F.lit(0)).alias(f"_i_{out}") for out, src in sums.items()]
    )
    return join_null_safe(ranked, offsets, [*groups, "_range"]).select(
        *hist.columns, *[(F.col(f"_b_{out}") + F.col(f"_i_{out}")).alias(out) for out in sums], *totals
    )


def histogram_near(
    df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """A value histogram that is fine only around the wanted quantiles.

    A sketch gives for each probability a bracket that surely holds its rank.  Values inside a
    bracket keep a row of their own; all values between two brackets fall into one row (with their
    smallest value, so that the order holds).  The partial aggregate shrinks the rows to a few
    percent before the shuffle.
    """
    groups, k = list(groups), len(probs)
    v = F.col(value)
    known = df.where(v.isNotNull())
    at = [max(p - BRACKET, 0.0) for p in probs] + [min(p + BRACKET, 1.0) for p in probs]
    sketch = materialise(
        known.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("_all"),
            F.percentile_approx(value, F.array(*[F.lit(p) for p in at]), F.lit(SKETCH_ACCURACY)).alias("_at"),
        )
    )
    if groups:
        rows = join_null_safe(known, sketch, groups)
    else:
        rows = known.withColumns({"_all": sketch.select("_all").scalar(), "_at": sketch.select("_at").scalar()})
    low, high = [F.col("_at")[i] for i in range(k)], [F.col("_at")[k + i] for i in range(k)]
    inside = F.col("_all") < BRACKETED_ROWS
    passed = F.lit(0)
    for p, lo, hi in zip(probs, low, high):
        above = F.lit(True) if p - BRACKET <= 0 else v >= lo
        below = F.lit(True) if p + BRACKET >= 1 else v <= hi
        inside = inside | (above & below)
        passed = passed + (v > hi).cast("int")
    return (
        rows.groupBy(
            *groups, F.when(~inside, passed).alias("_gap"), F.when(inside, v).alias("_own")
        )
        .agg(F.min(value).alias(value), F.count(F.lit(1)).alias("n_rows"))
        .select(*groups, value, "n_rows")
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    groups: Sequence[str] = (),
    freq: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles as rows (groups, prob, quantile).

    With ``freq`` the frame is already a histogram.
    """
    groups = list(groups)
    hist = df if freq else histogram_near(df, value, probs, groups)
    f = freq or "n_rows"
    ranked = running_totals(hist, value, {"_before": f}, groups, totals={"_n": f})
    # A value covers the ranks [_before, _before + freq); keep the probabilities that fall on it.
    first, last = F.col("_before"), F.col("_before") + F.col(f) - 1

    def position(p):
        return p * (F.col("_n") - 1).cast("double")

    def touches(p):
        low, high = F.floor(position(p)), F.ceil(position(p))
        return ((low >= first) & (low <= last)) | ((high >= first) & (high <= last))

    probed = ranked.select(
        *groups,
        value,
        "_before",
        f,
        "_n",
        F.explode(F.filter(F.array(*[F.lit(float(p)) for p in probs]), touches)).alias("prob"),
    )
    pos = position(F.col("prob"))
    low, high = F.floor(pos), F.ceil(pos)
    lo_val = F.max(F.when((low >= first) & (low <= last), F.col(value)))
    hi_val = F.max(F.when((high >= first) & (high <= last), F.col(value)))
    frac = F.max(pos - low)
    return probed.groupBy(*groups, "prob").agg(
        (lo_val + (hi_val - lo_val) * frac).cast("double").alias("quantile")
    )


def wide_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of many columns at once: rows (column, prob, quantile); columns without a value have none.

    Rows are never multiplied by columns.  One scan sketches all columns and gives each (column, probability) a bracket
    that surely holds its rank.  A bracket of one value is that quantile.  For the others a second scan counts what lies
    below each bracket, and a third sends out the values inside, a few percent.  The driver sees one row of sketches and
    one of counts: three numbers per column and probability.
    """
    columns, probs, k = list(columns), [float(p) for p in probs], len(probs)
    values = df.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    at = F.array(*[F.lit(p) for p in [max(p - BRACKET, 0.0) for p in probs] + [min(p + BRACKET, 1.0) for p in probs]])
    sketches = [
        F.struct(F.count(v).alias("n"), F.percentile_approx(v, at, F.lit(SKETCH_ACCURACY)).alias("at")).alias(v)
        for v in values.columns
    ]
    sketch = values.agg(F.lit(0), *sketches).first()
    settled, wanted, below, inside = [], [], [], []
    for i, c in enumerate(columns):
        n, at_value, v = sketch[f"_v{i}"].n, sketch[f"_v{i}"]["at"], F.col(f"_v{i}")
        for j, p in enumerate(probs if n else []):
            narrow = n >= BRACKETED_ROWS
            low = at_value[j] if narrow and p - BRACKET > 0 else None
            high = at_value[k + j] if narrow and p + BRACKET < 1 else None
            if low is not None and low == high:
                settled.append((c, p, low))
                continue
            position, q = p * float(n - 1), len(wanted)
            wanted.append((q, c, p, floor(position), ceil(position), position - floor(position)))
            below.append(F.lit(0).alias(f"_b{q}") if low is None else F.count_if(v < low).alias(f"_b{q}"))
            within = v.isNotNull() if low is None else v >= low
            within = within if high is None else within & (v <= high)
            inside.append(F.when(within, F.struct(F.lit(q).alias("_q"), v.alias("_value"))))
    spark = df.sparkSession
    known = spark.createDataFrame(settled, "column string, prob double, quantile double")
    if not wanted:
        return known
    counted = values.agg(F.lit(0), *below).first()
    asked = spark.createDataFrame(
        [(q, c, p, lo, hi, part, counted[f"_b{q}"]) for q, c, p, lo, hi, part in wanted],
        "_q int, column string, prob double, _low bigint, _high bigint, _part double, _below bigint",
    )
    picked = values.select(F.explode(F.array_compact(F.array(*inside))).alias("_i")).select("_i._q", "_i._value")
    hist = materialise(picked.groupBy("_q", "_value").agg(F.count(F.lit(1)).alias("_freq")))
    ranked = running_totals(hist, "_value", {"_before": "_freq"}, ["_q"])
    first = F.col("_below") + F.col("_before")

    def value_at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= first) & (F.col(rank) < first + F.col("_freq")), F.col("_value")))

    lower, upper = value_at("_low"), value_at("_high")
    # A row per column and probability on the broadcast side.
    found = (
        ranked.join(F.broadcast(asked), "_q")
        .groupBy("column", "prob")
        .agg((lower + (upper - lower) * F.max("_part")).alias("quantile"))
    )
    return found.unionByName(known)


def kth_smallest(df: DataFrame, value: str, groups: Sequence[str], share: float) -> DataFrame:
    """Per group the value at rank ``round(share * n)``; rows up to it are that share."""
    groups = list(groups)
    hist = histogram_near(df, value, [share], groups)
    ranked = running_totals(hist, value, {"_before": "n_rows"}, groups, totals={"_n": "n_rows"})
    want = F.round(F.col("_n") * F.lit(float(share))).cast("bigint")
    return ranked.where(
        (F.col("_before") < want) & (want <= F.col("_before") + F.col("n_rows"))
    ).select(*groups, F.col(value).alias("cut"))


def dense_index(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Number all rows 0..n-1 in the order of ``keys`` (which must be unique).

    Range-partitioned and checkpointed, so that the two passes (counting, numbering) see the same
    partitions; only one count per partition is kept beside the data.
    """
    keys = list(keys)
    spread = materialise(
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mid", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spread.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition: bounded by the partition count.
    return (
        spread.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_offset") + local).alias(out))
    )
