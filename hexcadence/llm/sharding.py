"""Contiguous shards of near equal size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexcadence.llm.base import free_names, named, stored


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + F.lit(1).cast("bigint")


def summed(df: DataFrame, order: list[str], size: str | None, start: str, row: str, whole: str, partitions: int) -> DataFrame:
    """Add, in the order of ``order``: the sizes before each row, the row's number from 0, and the sum of all sizes.

    1. The rows are dealt to ``partitions`` ranges of ``order`` and written once, which fixes the ranges.
    2. Each range gives one total and one count; their prefix sums (a row per range) are the ranges' offsets.
    3. A window inside each range adds the sizes before a row; offset and window give the global prefix sum.

    Ranges hold about equal numbers of rows, whatever the sizes are and however often a key repeats: rows equal in all
    of ``order`` are told apart by their place in the input. Nulls sort last. ``size`` None stands for 1.
    """
    tie, part, total, count = free_names(df, "tie", "part", "total", "count")
    keys = [named(c).asc_nulls_last() for c in order] + [F.col(tie).asc()]
    ranged = stored(
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(partitions, *keys)
        .withColumn(part, F.spark_partition_id()),
        "ranges",
    )
    one = F.lit(1) if size is None else named(size)
    totals = ranged.groupBy(part).agg(F.sum(one).alias(total), F.count(F.lit(1)).alias(count))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        F.col(part),
        F.coalesce(F.sum(total).over(before), F.lit(0)).alias(total),
        F.coalesce(F.sum(count).over(before), F.lit(0)).alias(count),
        F.sum(total).over(everything).alias(whole),
    )
    inside = Window.partitionBy(part).orderBy(*keys)
    within = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns(
        {start: F.coalesce(F.sum(one).over(within), F.lit(0)), row: F.row_number().over(inside) - F.lit(1)}
    ).join(F.broadcast(offsets), part)  # a row for each of the ranges, whose number is set here
    return local.select(
        *[named(c) for c in df.columns],
        (F.col(start) + F.col(total)).cast("bigint").alias(start),
        (F.col(row) + F.col(count)).cast("bigint").alias(row),
        F.col(whole),
    )


def numbered(df: DataFrame, order: list[str], row: str, partitions: int | None = None) -> DataFrame:
    """Number all rows from 0 in the order of ``order``, without a window over all of them."""
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start, whole = free_names(df, "start", "whole")
    return summed(df, order, None, start, row, whole, partitions).drop(start, whole)


def shards(df: DataFrame, order: list[str], size: str, n_shards: int, partitions: int | None = None) -> DataFrame:
    """Cut the rows, in the order of ``order``, into ``n_shards`` contiguous shards of near equal total size.

    Adds ``shard`` (from 0) and ``slot`` (the row's number in its shard, from 0, without gaps). With S the sum of
    all sizes, a row goes where its middle lies: shard k takes the middles from k*S/n to (k+1)*S/n, so each shard
    is off its equal share by at most one row's size. Sizes must be positive integers; see ``summed`` for the prefix
    sums. An empty table gives no rows. Input columns named ``shard`` or ``slot`` are replaced.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.select(*[named(c) for c in df.columns if c not in ("shard", "slot")])
    start, row, whole, first = free_names(df, "start", "row", "whole", "first")
    middle = F.col(start) * 2 + named(size)
    placed = stored(
        summed(df, order, size, start, row, whole, partitions).select(
            *[named(c) for c in df.columns],
            F.least(
                F.lit(n_shards - 1), F.call_function("div", middle * F.lit(n_shards), F.col(whole) * 2)
            ).cast("int").alias("shard"),
            F.col(row),
        ),
        "shards",
    )
    firsts = placed.groupBy("shard").agg(F.min(row).alias(first))
    return placed.join(F.broadcast(firsts), "shard").select(  # a row for each shard
        *[named(c) for c in df.columns], "shard", (F.col(row) - F.col(first)).cast("bigint").alias("slot")
    )
