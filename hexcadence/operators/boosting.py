"""Boosted trees over binned features in three growth orders.

Features become small bin numbers once. A pass over the rows routes each row through the trees as grown so far (a
generated CASE expression), and one aggregate sums gradients per (model, node, feature, bin): partial sums per task, then
at most models x nodes x features x bins rows, from which the driver picks splits. Rows never move and no node is
sorted. All models of a call share their passes.

Gradients and their second derivatives are rounded to whole multiples of 2^-16, so sums are exact integers: the trees
do not depend on partitions, on their order, or on a repeated task.

Growth orders: ``level`` splits every node of a level by its own best cut; ``symmetric`` gives all nodes of a level the one
cut that gains most in sum; ``leaf`` always splits the leaf that gains most, until there are enough leaves. The leaf order
asks ahead: it evaluates the children of every split that the known gains allow, so a tree takes about as many passes as
it is deep and not one for every leaf.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Generator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexcadence.functions.ranks import exact_quantiles
from hexcadence.functions.stats import stable_hash
from hexcadence.session import materialise

UNIT = 1 << 16  #: gradients are counted in parts of this
BINS = 16
SEED = 42


@dataclass(frozen=True)
class Preset:
    """``depth`` 0 is no limit; ``rows`` and ``columns`` are the shares that a tree sees."""

    growth: str
    rounds: int
    learning_rate: float
    depth: int
    leaves: int
    l2: float
    min_weight: float
    min_rows: int
    rows: float = 1.0
    columns: float = 1.0


# The three default parameter sets.
PRESETS = {
    "regularised": Preset("level", 300, 0.05, 6, 64, 1.0, 1.0, 1, 0.8, 0.8),
    "leafwise": Preset("leaf", 500, 0.05, 0, 31, 0.0, 0.001, 20),
    "symmetric": Preset("symmetric", 1000, 0.05, 6, 64, 3.0, 0.0, 0),
}


@dataclass
class Node:
    """A node of a tree: 1 is the root, 2i and 2i + 1 are the children of i. Inner nodes send bins up to ``cut`` left."""

    n: int
    g: int
    h: int
    gain: float | None = None
    feature: int | None = None
    cut: int | None = None
    value: float | None = None


@dataclass
class Model:
    preset: Preset
    features: list[str]
    trees: list[dict[int, Node]] = field(default_factory=list)


# --- bins -----------------------------------------------------------------------------------------


def bin_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Exact quantiles of each feature at 1/bins, 2/bins, ...; features times bins numbers."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = df.select(F.inline(items)).where("value IS NOT NULL AND NOT isnan(value)")
    found: dict[str, list[float]] = {f: [] for f in features}
    for r in exact_quantiles(long, "value", [i / bins for i in range(1, bins)], ["feature"]).orderBy("feature", "prob").collect():
        found[r["feature"]].append(r["quantile"])
    return found


def binned(df: DataFrame, cuts: dict[str, list[float]], out: str = "bins") -> DataFrame:
    """An array of bin numbers: 0 for null or NaN, else 1 plus the number of cuts below the value."""

    def one(feature: str) -> Column:
        x = F.col(feature).cast("double")
        above = reduce(lambda a, c: a + (x > F.lit(c)).cast("int"), cuts[feature], F.lit(1))
        return F.when(x.isNull() | F.isnan(x), 0).otherwise(above)

    return df.withColumn(out, F.array(*[one(f) for f in cuts]))


# --- growing ----------------------------------------------------------------------------------------

Histogram = dict[tuple[int, int], dict[int, tuple[int, int, int]]]  # (node, feature) -> bin -> (rows, g, h)


def tree_features(n: int, share: float, tree: int, seed: int = SEED) -> list[int]:
    """The features that a tree may use: those with the smallest digests of their numbers."""
    order = sorted(range(n), key=lambda f: md5(f"{f}|{tree}|{seed}".encode()).hexdigest())
    return sorted(order[: max(1, math.ceil(share * n))])


def _score(g: int, h: int, l2: float) -> float:
    return float(g) * float(g) / (float(h) + l2) if h + l2 > 0 else 0.0


def _candidates(hist: Histogram, node: int, f: int) -> list[tuple[int, tuple[int, int, int], tuple[int, int, int]]]:
    """(cut, left sums, right sums) for every bin of a feature that holds rows, but the last."""
    by_bin = hist.get((node, f), {})
    total = [sum(v[i] for v in by_bin.values()) for i in range(3)]
    left, out = [0, 0, 0], []
    for b in sorted(by_bin)[:-1]:
        left = [a + c for a, c in zip(left, by_bin[b], strict=True)]
        out.append((b, tuple(left), tuple(t - a for t, a in zip(total, left, strict=True))))
    return out


def _best(hist: Histogram, node: int, whole: Node, p: Preset, usable: list[int]) -> tuple | None:
    """(gain, feature, cut, left sums, right sums) of a node's best cut; ties go to the first feature and cut."""
    l2, best = p.l2 * UNIT, None
    for f in usable:
        for cut, left, right in _candidates(hist, node, f):
            if min(left[0], right[0]) < p.min_rows or min(left[2], right[2]) < p.min_weight * UNIT:
                continue
            gain = _score(left[1], left[2], l2) + _score(right[1], right[2], l2) - _score(whole.g, whole.h, l2)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, f, cut, left, right)
    return best


def _split(tree: dict[int, Node], node: int, found: tuple) -> tuple[int, int]:
    gain, f, cut, left, right = found
    tree[node].gain, tree[node].feature, tree[node].cut = gain / UNIT, f, cut
    tree[2 * node], tree[2 * node + 1] = Node(*left), Node(*right)
    return 2 * node, 2 * node + 1


Growth = Generator[tuple[dict[int, Node], list[int]], Histogram, dict[int, Node]]


def _root(hist: Histogram, usable: list[int]) -> dict[int, Node]:
    sums = [sum(v[i] for v in hist.get((1, usable[0]), {}).values()) for i in range(3)]
    return {1: Node(*sums)}


def _grow_level(p: Preset, usable: list[int]) -> Growth:
    hist = yield {}, [1]
    tree = _root(hist, usable)
    level = [1]
    for depth in range(p.depth):
        if depth:
            hist = yield tree, level
        below = []
        for node in level:
            found = _best(hist, node, tree[node], p, usable)
            if found:
                below += _split(tree, node, found)
        if not below:
            break
        level = below
    return tree


def _grow_symmetric(p: Preset, usable: list[int]) -> Growth:
    hist = yield {}, [1]
    tree = _root(hist, usable)
    level, l2 = [1], p.l2 * UNIT
    for depth in range(p.depth):
        if depth:
            hist = yield tree, level
        before = sum(_score(tree[i].g, tree[i].h, l2) for i in level)
        best = None
        for f in usable:
            bins = sorted({b for i in level for b in hist.get((i, f), {})})
            for cut in bins[:-1]:
                after = 0.0
                for i in level:
                    left = _left(hist, i, f, cut)
                    after += _score(left[1], left[2], l2) + _score(tree[i].g - left[1], tree[i].h - left[2], l2)
                # Thousandths, so that the order of the nodes in the sum doesn't decide ties.
                gain = math.floor((after - before) * 1000 + 0.5)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, f, cut)
        if not best:
            break
        below = []
        for i in level:
            left = _left(hist, i, best[1], best[2])
            rest = tuple(t - a for t, a in zip((tree[i].n, tree[i].g, tree[i].h), left, strict=True))
            below += _split(tree, i, (best[0] / 1000, best[1], best[2], left, rest))
        level = below
    return tree


def _left(hist: Histogram, node: int, f: int, cut: int) -> tuple[int, ...]:
    parts = [v for b, v in hist.get((node, f), {}).items() if b <= cut]
    return tuple(sum(v[i] for v in parts) for i in range(3))


def _grow_leaf(p: Preset, usable: list[int]) -> Growth:
    hist = yield {}, [1]
    start = _root(hist, usable)[1]
    known: dict[int, tuple | None] = {1: _best(hist, 1, start, p, usable)}
    while True:
        # Grow anew with what is known; children that nothing is known of are asked for together.
        tree, unknown, leaves = {1: Node(start.n, start.g, start.h)}, [], 1
        open_ = [(-known[1][0], 1)] if known[1] else []
        while open_ and leaves < p.leaves:
            _, node = heapq.heappop(open_)
            children = _split(tree, node, known[node])
            leaves += 1
            if leaves == p.leaves or p.depth and children[0].bit_length() > p.depth:
                continue
            for child in children:
                if child not in known:
                    unknown.append(child)
                elif known[child]:
                    heapq.heappush(open_, (-known[child][0], child))
        if not unknown:
            return tree
        hist = yield tree, unknown
        for node in unknown:
            known[node] = _best(hist, node, tree[node], p, usable)


_GROW = {"level": _grow_level, "leaf": _grow_leaf, "symmetric": _grow_symmetric}


# --- in Spark -----------------------------------------------------------------------------------------


def _routed(tree: dict[int, Node], bins: Column, leaf, node: int = 1) -> Column:
    """A CASE expression that gives ``leaf(node)`` of the node where a row ends."""
    here = tree.get(node)
    if here is None or here.feature is None:
        return leaf(node)
    low, high = _routed(tree, bins, leaf, 2 * node), _routed(tree, bins, leaf, 2 * node + 1)
    return F.when(bins[here.feature] <= here.cut, low).otherwise(high)


def _histograms(rows: DataFrame, asked: dict[str, tuple[dict[int, Node], list[int]]]) -> dict[str, Histogram]:
    """Sums of (rows, g, h) for the nodes that each model asks for, by feature and bin, in one pass."""
    at = {f"at_{name}": _routed(tree, F.col("bins"), lambda i: F.lit(i).cast("bigint")) for name, (tree, _) in asked.items()}
    items = []
    for name, (_, nodes) in asked.items():
        node = F.col(f"at_{name}")
        cell = F.struct(F.lit(name).alias("model"), node.alias("node"), F.col(f"g_{name}").alias("g"), F.col(f"h_{name}").alias("h"))
        items.append(F.when(F.col(f"in_{name}") & node.isin(nodes), cell))
    rows = rows.withColumns(at)
    one = rows.select("bins", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("m"))
    cells = one.select("m.*", F.posexplode("bins").alias("feature", "bin"))
    sums = cells.groupBy("model", "node", "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    out: dict[str, Histogram] = {name: {} for name in asked}
    for r in sums.collect():  # models x nodes x features x bins at most
        out[r["model"]].setdefault((r["node"], r["feature"]), {})[r["bin"]] = (r["n"], r["g"], r["h"])
    return out


def _chance(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def fit(
    df: DataFrame, keys: Sequence[str], label: str, presets: dict[str, Preset], features: Sequence[str],
    bins: str = "bins", weight: str | None = None, rounds: int | None = None, seed: int = SEED,
) -> dict[str, Model]:
    """Fit one model for each preset on rows of bin numbers (``binned`` over ``features``).

    ``keys`` name a row and draw the row samples, repeatably. ``rounds`` limits all presets. Rows without a label take no
    part; a null weight counts as none. Without rows every tree is one leaf of value 0.
    """
    y = F.col(label).cast("double")
    state = df.where(F.col(label).isNotNull()).select(
        *keys, F.col(bins).alias("bins"), y.alias("y"), (F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).alias("w"),
        *[F.lit(0.0).alias(f"s_{m}") for m in presets],
    )
    models = {m: Model(p if rounds is None else replace(p, rounds=min(rounds, p.rounds)), list(features)) for m, p in presets.items()}
    state = materialise(state)
    for t in range(max((m.preset.rounds for m in models.values()), default=0)):
        active = {name: m for name, m in models.items() if t < m.preset.rounds}
        steps = {}
        for name, m in active.items():
            chance = _chance(F.col(f"s_{name}"))
            steps[f"g_{name}"] = F.floor((chance - F.col("y")) * F.col("w") * float(UNIT) + 0.5)
            steps[f"h_{name}"] = F.floor(chance * (1 - chance) * F.col("w") * float(UNIT) + 0.5)
            drawn = F.lit(True) if m.preset.rows >= 1 else stable_hash(*keys, seed=seed + t) / F.lit(float(1 << 60)) < m.preset.rows
            steps[f"in_{name}"] = drawn
        rows = state.withColumns(steps)
        growing = {name: _GROW[m.preset.growth](m.preset, tree_features(len(features), m.preset.columns, t, seed)) for name, m in active.items()}
        asked = {name: next(g) for name, g in growing.items()}
        while asked:
            told = _histograms(rows, asked)
            for name in list(asked):
                try:
                    asked[name] = growing[name].send(told[name])
                except StopIteration as done:
                    models[name].trees.append(_valued(done.value, models[name].preset))
                    del asked[name]
        # The rows are written once a round; their plan never holds more than one tree of a model.
        added = {f"s_{name}": F.col(f"s_{name}") + _value(models[name].trees[-1], F.col("bins")) for name in active}
        state = materialise(state.withColumns(added))
    return models


def _valued(tree: dict[int, Node], p: Preset) -> dict[int, Node]:
    for node in tree.values():
        if node.feature is None:
            weight = node.h + p.l2 * UNIT
            node.value = -p.learning_rate * node.g / weight if weight > 0 else 0.0
    return tree


def _value(tree: dict[int, Node], bins: Column) -> Column:
    return _routed(tree, bins, lambda i: F.lit(tree[i].value))


def tree_table(models: dict[str, Model], spark) -> DataFrame:
    """One row per node: model, tree, node, feature, cut, gain, value, n."""
    rows = [
        (name, t, i, None if v.feature is None else m.features[v.feature], v.cut, v.gain, v.value, v.n)
        for name, m in models.items()
        for t, tree in enumerate(m.trees)
        for i, v in sorted(tree.items())
    ]
    return spark.createDataFrame(rows, "model string, tree int, node bigint, feature string, cut int, gain double, value double, n bigint")


def predict(df: DataFrame, model: Model, bins: str = "bins", out: str = "y_proba", step: int = 20) -> DataFrame:
    """Probability of label 1. ``step`` trees are added up in one projection."""
    score = "_score"
    df = df.withColumn(score, F.lit(0.0))
    for t in range(0, len(model.trees), step):
        parts = [_value(tree, F.col(bins)) for tree in model.trees[t : t + step]]
        df = df.withColumn(score, reduce(lambda a, b: a + b, parts, F.col(score)))
    return df.withColumn(out, _chance(F.col(score))).drop(score)
