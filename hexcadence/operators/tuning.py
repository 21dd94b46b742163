"""Cross-fitting and successive halving over boosted trees.

Both are short loops over folds, a parameter; every fit inside is distributed, and all models of a fold share its passes.
Cut points are taken from the fitted rows alone, so nothing of a held-out row reaches a model.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexcadence.functions.stats import stable_hash
from hexcadence.operators import boosting, splits
from hexcadence.operators.boosting import Preset
from hexcadence.session import materialise


def row_folds(keys: Sequence[str], n_folds: int, seed: int = 42) -> Column:
    """Fold number 0..n-1 of a row, by the hash of its keys."""
    return F.pmod(stable_hash(*keys, seed=seed), F.lit(n_folds)).cast("int")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _fitted(train: DataFrame, keys, label, features, presets, rounds) -> tuple[dict, dict]:
    cuts = boosting.bin_cuts(train, features)
    return cuts, boosting.fit(boosting.binned(train, cuts), keys, label, presets, features, rounds=rounds)


def cross_fit(
    df: DataFrame, keys: Sequence[str], label: str, features: Sequence[str], fold: str, n_folds: int,
    presets: dict[str, Preset], rounds: int | None = None,
) -> DataFrame:
    """Rows (keys, fold, label, model, y_proba, n_fitted, n_own_fold): every row, predicted by models fitted without its fold.

    ``n_fitted`` counts the rows the models of that fold were fitted on, ``n_own_fold`` those of them that lie in the fold
    itself; it is counted from the rows that were fitted and must be 0. Rows of a null fold are not predicted and not fitted.
    Such predictions may train a stacker (``modelling.stack_models``) on all training rows.
    """
    rows = materialise(df.where(F.col(fold).between(0, n_folds - 1)).select(*keys, fold, label, *features))
    parts = []
    for f in range(n_folds):
        train = rows.where(F.col(fold) != f)
        cuts, models = _fitted(train, keys, label, features, presets, rounds)
        seen = train.where(F.col(label).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(fold) == f).alias("own"))
        held = boosting.binned(rows.where(F.col(fold) == f), cuts)
        for name, model in models.items():
            parts.append(
                boosting.predict(held, model).select(
                    *keys, fold, label, F.lit(name).alias("model"), "y_proba", seen.select("n").scalar().alias("n_fitted"), seen.select("own").scalar().alias("n_own_fold")
                )
            )
    return _union(parts)


def rungs(n_configs: int, n_folds: int) -> list[tuple[list[int], int, int]]:
    """(folds, configurations at the start, configurations kept) of every rung: half go each time, the last keeps one.

    A rung takes the next fold; the last one takes all that are left. With too few folds the last rung decides among more.
    """
    out, n, fold = [], n_configs, 1
    while fold <= n_folds:
        keep = math.ceil(n / 2)
        last = keep == 1 or fold == n_folds
        folds = list(range(fold, n_folds + 1)) if last else [fold]
        out.append((folds, n, 1 if last else keep))
        if last:
            break
        n, fold = keep, fold + 1
    return out


def halving(
    df: DataFrame, bin_col: str, keys: Sequence[str], label: str, features: Sequence[str], configs: dict[str, Preset], n_splits: int,
    gap: int = 0, rounds: int | None = None,
) -> DataFrame:
    """Rank parameter sets by F2 over expanding folds, dropping the worse half after each rung.

    Rows (rung, fold, config, tp, fp, fn, tn, f2, mean_f2, rank, kept) for every set that a rung measured, losers
    included. A later rung trains on more bins and ranks by the mean over all folds so far. Ties (to nine digits) go to the set that
    comes first in ``configs``. Undefined F2 counts as 0.
    """
    roles = splits.expanding_folds(df, bin_col, n_splits, gap)
    rows = materialise(df.select(*dict.fromkeys([*keys, bin_col, label, *features])))
    alive, scores, out = dict(configs), {c: [] for c in configs}, []
    order = {c: i for i, c in enumerate(configs)}
    for rung, (folds, _, keep) in enumerate(rungs(len(configs), n_splits)):
        measured = {}
        for fold in folds:
            part = materialise(rows.join(roles.where(F.col("fold") == fold).drop("fold"), bin_col))
            cuts, models = _fitted(part.where("role = 'train'"), keys, label, features, alive, rounds)
            test = boosting.binned(part.where("role = 'test'").where(F.col(label).isNotNull()), cuts)
            said = [boosting.predict(test, m).select(F.lit(c).alias("config"), F.col(label).alias("y"), (F.col("y_proba") >= 0.5).alias("yes")) for c, m in models.items()]
            counts = _union(said).groupBy("config").agg(
                *[F.count_if((F.col("y") == y) & (F.col("yes") == yes)).alias(n) for n, y, yes in (("tp", 1, True), ("fp", 0, True), ("fn", 1, False), ("tn", 0, False))]
            )
            found = {r["config"]: r.asDict() for r in counts.collect()}  # a row per configuration
            for c in alive:
                n = found.get(c, {"tp": 0, "fp": 0, "fn": 0, "tn": 0})
                wrong = 5 * n["tp"] + 4 * n["fn"] + n["fp"]
                f2 = 5 * n["tp"] / wrong if wrong else 0.0
                measured[fold, c] = (*[n[k] for k in ("tp", "fp", "fn", "tn")], f2)
                scores[c].append(f2)
        mean = {c: sum(scores[c]) / len(scores[c]) for c in alive}
        ranked = sorted(alive, key=lambda c: (-math.floor(mean[c] * 1e9 + 0.5), order[c]))
        place = {c: i + 1 for i, c in enumerate(ranked)}
        out += [(rung, fold, c, *measured[fold, c], mean[c], place[c], place[c] <= keep) for fold in folds for c in alive]
        alive = {c: p for c, p in alive.items() if place[c] <= keep}
    schema = "rung int, fold int, config string, tp bigint, fp bigint, fn bigint, tn bigint, f2 double, mean_f2 double, rank int, kept boolean"
    return df.sparkSession.createDataFrame(out, schema)
