"""Mixing sources to target weights by balanced sampling: the cube method."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexcadence.llm.base import WORD, named, stored

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK = 4096  #: rows that one flight balances
LANDING = 12  #: rows of a source that the landing phase settles, over all their 0/1 choices
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(
    df: DataFrame, source: str, size: str, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT
) -> DataFrame:
    """A row per source: source, source_size, target.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes by weight. A
    target is at most ``max_repeat`` times its source's size; what is cut off is shared by the others by weight until
    none is above. That is target = min(cap, level * weight) with one level for all: sources are capped in the order
    of cap / weight, and running sums over them show where capping ends. The windows hold one row per source.
    """
    sums = df.groupBy(named(source).alias("source")).agg(
        F.sum(F.col(size)).cast("bigint").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here_on = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = ranked.withColumns(
        {
            "cap": cap,
            # The level if all sources before this one are capped and this one and the rest are not.
            "level": (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
            / F.sum("weight").over(here_on),
        }
    )
    level = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True)
    levelled = stepped.withColumn("level", level.over(everything))
    return levelled.select(
        "source", "source_size", "source_rows", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def flight(prob: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, leave: int = 2) -> np.ndarray:
    """Move inclusion probabilities along the null space of (count, size) until at most ``leave`` stay fractional.

    Each step settles the largest open row, or another one on the way: a direction that moves this row by one and,
    so that the sums of probability and of probability times size don't change, all smaller open rows a little,
    each in proportion to p * (1 - p). A step along it or against it goes as far as [0, 1] allows; which of the two is
    drawn so that probabilities stay right on average. What is left in the end are small rows.
    """
    p = prob.astype(float)
    p[(p <= _EPS) | (p >= 1 - _EPS)] = np.round(p[(p <= _EPS) | (p >= 1 - _EPS)])
    open_ = np.flatnonzero((p > 0) & (p < 1))
    open_ = open_[np.argsort(-sizes[open_], kind="stable")]
    scale = max(1.0, float(sizes[open_[0]])) if len(open_) else 1.0
    while len(open_) > max(2, leave):
        q, s = p[open_], sizes[open_] / scale
        u = _direction(q, s)
        if u is None:
            break
        ahead = np.divide(np.where(u > 0, 1 - q, q), np.abs(u), out=np.full(len(u), np.inf), where=u != 0)
        back = np.divide(np.where(u > 0, q, 1 - q), np.abs(u), out=np.full(len(u), np.inf), where=u != 0)
        up, down = ahead.min(), back.min()
        forward = rng.random() * (up + down) < down
        q = np.clip(q + (up if forward else -down) * u, 0.0, 1.0)
        hit = (ahead if forward else back).argmin()
        q[hit] = np.round(q[hit])
        done = (q <= _EPS) | (q >= 1 - _EPS)
        q[done] = np.round(q[done])
        p[open_] = q
        open_ = open_[~done]
    return p


def _direction(q: np.ndarray, s: np.ndarray) -> np.ndarray | None:
    """Null vector that moves the first row by one, and the others by w * (a + b * s) with w = q * (1 - q)."""
    w, t = (q * (1 - q))[1:], s[1:]
    center = (w @ t) / w.sum()
    spread = w @ (t - center) ** 2
    u = np.empty(len(q))
    u[0] = 1.0
    if spread > 1e-12 * w.sum():
        u[1:] = -w * (1 / w.sum() + (s[0] - center) / spread * (t - center))
    elif abs(s[0] - center) < 1e-9:
        u[1:] = -w / w.sum()  # all sizes alike: one constraint
    else:
        u[0] = 0.0  # the others are alike and this row is not: only they can move
        if len(q) < 3:
            return None
        u[1] = 1.0
        u[2:] = -w[1:] / w[1:].sum()
    return u


def land(prob: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Settle the last few fractional units: of all 0/1 choices the one whose size is nearest, then whose count is."""
    p = prob.copy()
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if len(open_):
        choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1).astype(float)
        off = np.abs(choices @ sizes[open_] - p[open_] @ sizes[open_])
        count = np.abs(choices.sum(1) - p[open_].sum())
        p[open_] = choices[np.lexsort((count, off))[0]]
    return np.round(p)


def _fly(seed: int, last: bool):
    def run(key, group):
        group = group.sort_by([("draw", "ascending"), ("size", "ascending"), ("tie", "ascending")])
        prob, sizes = group["prob"].to_numpy(), group["size"].to_numpy()
        start = int(np.bitwise_xor.reduce(group["draw"].to_numpy())) & (1 << 62) - 1
        if last:
            out = land(prob, sizes)
        else:
            leave = LANDING if group["blocks"][0].as_py() == 1 else 2
            out = flight(prob, sizes, np.random.default_rng([seed, start, len(prob)]), leave)
        return group.set_column(group.schema.get_field_index("prob"), "prob", pa.array(out))

    return run


def mix(
    df: DataFrame, source: str, size: str, key: list[str], weights: tuple[float, ...] = WEIGHTS,
    max_repeat: float = MAX_REPEAT, block: int = BLOCK, seed: int = 1,
) -> DataFrame:
    """Add source_size, target and copies: how often the mix takes a row, so that each source meets its target.

    A source with rate r = target / size takes every row floor(r) times, and once more with probability r - floor(r).
    Those draws are balanced: in each block of a source's rows, the flight phase of the cube method keeps the sums of
    rows and of sizes exactly and leaves at most two fractional rows. These meet in new blocks, until one block per
    source is left; of its last LANDING rows, which are small ones, the landing phase takes those whose sizes come
    nearest to the target. Large sources have many blocks; no task sees more than about ``block`` rows.

    ``key`` and the row's values fix the order of the draws, so reruns agree; rows alike in all of ``df`` are
    interchangeable. Pass keys and sizes, not texts: rows travel through the tasks. Null is a source of its own, null
    sizes count as 0 and are drawn like others. No rows give no rows. Input columns named like a result are replaced.
    """
    results = ("source_size", "target", "copies")
    plain = [c for c in df.columns if c not in results]
    names = {"row": F.struct(*[named(c) for c in plain]), "source": named(source), "size": F.coalesce(named(size), F.lit(0)).cast("bigint")}
    rows = df.select(*[c.alias(n) for n, c in names.items()])
    goal = stored(targets(rows, "source", "size", weights, max_repeat), "targets")
    drawn = F.xxhash64(F.lit(seed), *[F.col("row")[c] for c in key])
    # The sources' file is small, a row per source; the planner broadcasts it by its size.
    both = rows.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeat)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    state = both.withColumns(
        {"rate": rate, "draw": drawn, "tie": F.xxhash64("row"), "blocks": F.ceil(F.col("source_rows") / block)}
    ).withColumns({"whole": F.floor("rate"), "prob": F.col("rate") - F.floor("rate")})
    state = state.withColumn("block", F.pmod(F.xxhash64("draw", "tie"), F.col("blocks")))
    columns = ["row", "source", "size", "source_size", "target", "whole", "blocks", "draw", "tie", "block", "prob"]
    state = state.select(*columns)
    settled = state.where(f"prob <= {_EPS} OR prob >= {1 - _EPS}")
    open_ = state.where(f"prob > {_EPS} AND prob < {1 - _EPS}")
    done = [settled]
    for level in range(20):
        flown = stored(
            open_.groupBy("source", "block", "blocks").applyInArrow(_fly(seed + level, False), open_.schema), "flight"
        )
        done.append(flown.where(f"prob <= {_EPS} OR prob >= {1 - _EPS}"))
        # At most two rows of a block are left; the source's blocks merge, ``block`` / 2 into one.
        left = flown.where(f"prob > {_EPS} AND prob < {1 - _EPS}")
        many = flown.agg(F.max("blocks")).first()[0] or 1
        if many == 1:
            done.append(left.groupBy("source").applyInArrow(_fly(seed, True), left.schema))
            break
        open_ = left.withColumn("blocks", F.ceil(F.col("blocks") * 2 / block)).withColumn("block", F.pmod(F.xxhash64("draw", "tie"), F.col("blocks")))
        open_ = open_.select(*columns)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(
        *[F.col("row")[c].alias(c) for c in plain],
        "source_size", "target", (F.col("whole") + F.round("prob")).cast("bigint").alias("copies"),
    )
