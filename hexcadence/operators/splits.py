"""Train, validation and test splits without a global sort where bins or hashes decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexcadence.functions.ranks import dense_index, kth_smallest
from hexcadence.functions.stats import stable_hash

TRAIN_SIZE = 0.7


def temporal_split(
    df: DataFrame,
    bin_col: str,
    train_size: float = TRAIN_SIZE,
    validation: bool = False,
    exact_rows: bool = False,
    tie_keys: Sequence[str] = (),
    out: str = "split",
) -> DataFrame:
    """First ``train_size`` of the rows in time order are train, the rest test (or val and test).

    By default the cut falls on a bin boundary: a bin belongs to the part in which its first row
    lies, decided by the counts per bin.  ``exact_rows`` cuts inside a bin, in the order of
    (bin, tie_keys), which must be unique.  Rows without a bin come first in time, so they are train.
    """
    rest = (1 - train_size) / 2 if validation else 1 - train_size
    if exact_rows:
        numbered = dense_index(df, [bin_col, *tie_keys], "_pos")
        n = df.agg(F.count(F.lit(1))).scalar()
        pos = F.col("_pos")
    else:
        # One row per bin reaches this window and the join.
        counts = df.groupBy(bin_col).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(
            F.col(bin_col).alias("_bin"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_pos"),
            F.sum("_n").over(Window.partitionBy()).alias("_total"),
        )
        numbered = df.join(starts, F.col(bin_col).eqNullSafe(F.col("_bin"))).drop("_bin")
        n, pos = F.col("_total"), F.col("_pos")
    n_train = F.floor(n * F.lit(train_size))
    n_val = F.floor(n * F.lit(rest))
    part = F.when(pos < n_train, "train")
    if validation:
        part = part.when(pos < n_train + n_val, "val")
    return numbered.withColumn(out, part.otherwise("test")).drop("_pos", "_total")


def expanding_folds(df: DataFrame, bin_col: str, n_splits: int, gap: int = 0) -> DataFrame:
    """Rows (fold, bin, role) of expanding-window folds over the ordered bins.

    Each fold tests on the next block of bins and trains on all bins before it, minus ``gap``.
    """
    bins = df.select(bin_col).distinct()
    order = Window.orderBy(bin_col)  # one row per bin
    numbered = bins.select(
        bin_col,
        (F.row_number().over(order) - 1).alias("_i"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"),
    )
    fold = F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("fold")
    block = F.floor(F.col("_n") / F.lit(n_splits + 1))
    start = F.col("_n") - (F.lit(n_splits + 1) - F.col("fold")) * block
    staged = numbered.select(bin_col, "_i", "_n", fold)
    role = F.when(F.col("_i") < start - gap, "train").when(
        (F.col("_i") >= start) & (F.col("_i") < start + block), "test"
    )
    return staged.select("fold", bin_col, role.alias("role")).where(F.col("role").isNotNull())


def group_folds(df: DataFrame, group: str, n_folds: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number 0..n-1 by group hash: a group is never divided."""
    return df.withColumn(out, F.pmod(stable_hash(group, seed=seed), F.lit(n_folds)).cast("int"))


def group_shuffle(
    df: DataFrame, group: str, n_splits: int, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """``is_test_<i>`` columns: about ``test_size`` of the groups in each split."""
    top = F.lit(float(1 << 60))
    return df.withColumns(
        {
            f"is_test_{i}": stable_hash(group, seed=seed + i).cast("double") / top < F.lit(test_size)
            for i in range(1, n_splits + 1)
        }
    )


def stratified_holdout(
    df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42, out: str = "is_holdout"
) -> DataFrame:
    """Exactly ``round(share * n)`` rows of each class, chosen by key hash.

    The cut hash per class is found without sorting a class in one task.
    """
    hashed = df.withColumn("_h", stable_hash(key, seed=seed))
    cuts = kth_smallest(hashed, "_h", [label], share)
    cuts = cuts.withColumnRenamed(label, "_label")
    joined = hashed.join(cuts, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    return joined.withColumn(out, F.coalesce(F.col("_h") <= F.col("cut"), F.lit(False))).drop("_h", "cut")
