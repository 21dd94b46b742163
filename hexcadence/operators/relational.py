"""Joins, sets, sorting and sampling with the conventions used by the other operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcadence.functions.stats import stable_hash


@dataclass(frozen=True)
class Side:
    """One frame of an n-way join: what to leave out of it, and new names for columns that others have too."""

    frame: DataFrame
    without: tuple[str, ...] = ()
    renamed: dict[str, str] = field(default_factory=dict)

    def ready(self) -> DataFrame:
        return self.frame.drop(*self.without).withColumnsRenamed(self.renamed)


def join_all(sides: Sequence[Side | DataFrame], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join many frames on the same keys, from left to right.

    All frames are checked before the first join is planned: every one needs the keys, and no two may share another
    column (``Side`` renames or drops it).
    """
    if not keys:
        raise ValueError("an n-way join needs keys")
    frames = [(s if isinstance(s, Side) else Side(s)).ready() for s in sides]
    owners: dict[str, list[int]] = {}
    for i, f in enumerate(frames):
        for c in f.columns:
            owners.setdefault(c, []).append(i)
    lacking = {k: sorted(set(range(len(frames))) - set(owners.get(k, []))) for k in keys}
    if any(lacking.values()):
        raise ValueError(f"keys missing, by frame number: { {k: v for k, v in lacking.items() if v} }")
    shared = {c: at for c, at in owners.items() if len(at) > 1 and c not in keys}
    if shared:
        raise ValueError(f"columns of several frames: {shared}")
    return reduce(lambda left, right: left.join(right, list(keys), how), frames)


def natural_join(frames: Sequence[DataFrame]) -> DataFrame:
    """Inner join on whatever columns neighbours share."""
    return reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns]), frames)


def left_join_chain(base: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), others, base)


def update_from(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Values of ``source`` where it has the key and a value, else the old ones."""
    fresh = source.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(fresh, key, "left")
    for c in columns:
        old = F.col(c) if c in target.columns else F.lit(None)
        joined = joined.withColumn(c, F.coalesce(F.col(f"_new_{c}"), old))
    return joined.drop(*[f"_new_{c}" for c in columns])


def map_values(df: DataFrame, column: str, mapping: dict, out: str) -> DataFrame:
    """Look a column up in a small fixed mapping; unknown values are null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, m[F.col(column)])


def top_rows(df: DataFrame, sort: Sequence[str], columns: Sequence[str], k: int) -> DataFrame:
    """Largest ``k`` rows by the sort columns."""
    return df.orderBy(*[F.desc(c) for c in sort]).select(*columns).limit(k)


def sample_rows(df: DataFrame, key: str | Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Repeatable random sample: the ``n`` rows with the smallest key hash."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(stable_hash(*keys, seed=seed), *keys).limit(n)


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of the key sets, their intersection and both differences: one row, one group per key."""
    tagged = a.select(F.col(key).alias("k"), F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).unionByName(
        b.select(F.col(key).alias("k"), F.lit(False).alias("in_a"), F.lit(True).alias("in_b"))
    )
    keys = tagged.groupBy("k").agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))
    return keys.agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("common"),
        F.count_if(~F.col("in_b")).alias("only_a"),
        F.count_if(~F.col("in_a")).alias("only_b"),
    )
