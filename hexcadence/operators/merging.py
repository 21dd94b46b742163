"""Can two tables be merged or appended?  Column profile, key choice, decision, execution."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexcadence.functions.stats import ratio

# Limits of the decision.
CARDINALITY_RATIO = 10
KEY_UNIQUENESS = 0.9
DISJOINT_OVERLAP, STRONG_OVERLAP = 0.01, 0.8
JOIN_EXPLOSION_ROWS = 5e7


def schema_compare(tables: dict[str, DataFrame]) -> DataFrame:
    """For every pair of tables: each column with where it occurs.

    Works on column names only (metadata), never on rows.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for a, b in combinations(tables, 2):
        in_a, in_b = set(tables[a].columns), set(tables[b].columns)
        for c in sorted(in_a | in_b):
            where = "common" if c in in_a and c in in_b else "only_in_a" if c in in_a else "only_in_b"
            rows.append((f"{a}_vs_{b}", a, b, c, where))
    return spark.createDataFrame(rows, "pair string, file_a string, file_b string, column string, place string")


def pair_profile(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per common column: types, distinct values, uniqueness and overlap.

    Both tables are tagged, unpivoted and grouped once; a hot value is summed before the shuffle.
    """
    common = [c for c in a.columns if c in b.columns]

    def tagged(df: DataFrame, in_a: int) -> DataFrame:
        items = F.array(
            *[F.named_struct(F.lit("column"), F.lit(c), F.lit("value"), F.col(c).cast("string")) for c in common]
        ).cast("array<struct<column: string, value: string>>")  # also without common columns
        return df.select(F.explode(items).alias("_i")).select(
            "_i.column", "_i.value", F.lit(in_a).alias("_a"), F.lit(1 - in_a).alias("_b")
        )

    values = (
        tagged(a, 1)
        .unionByName(tagged(b, 0))
        .groupBy("column", "value")
        .agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"))
    )
    in_a, in_b, known = F.col("na") > 0, F.col("nb") > 0, F.col("value").isNotNull()
    stats = values.groupBy("column").agg(
        F.sum("na").alias("n_rows_a"),
        F.sum("nb").alias("n_rows_b"),
        F.count_if(in_a & known).alias("n_unique_a"),
        F.count_if(in_b & known).alias("n_unique_b"),
        F.count_if(in_a).alias("unique_keys_a"),
        F.count_if(in_b).alias("unique_keys_b"),
        F.count_if(in_a & in_b).alias("overlap_rows"),
        F.sum(F.when(known, F.col("na") * F.col("nb")).otherwise(0)).alias("n_matches"),
    )
    clash = [c for c in common if a.schema[c].dataType != b.schema[c].dataType]
    return _judged(stats.withColumn("type_conflict", F.col("column").isin(clash)))


def _judged(stats: DataFrame) -> DataFrame:
    """Shares and validity of key columns from their counts in two tables."""
    low = F.least("n_unique_a", "n_unique_b")
    high = F.greatest("n_unique_a", "n_unique_b")
    spread = F.when(low > 0, high / low)
    return stats.withColumns(
        {
            "cardinality_mismatch": F.coalesce(spread > CARDINALITY_RATIO, F.lit(False)),
            "uniqueness_a": ratio(F.col("unique_keys_a"), F.col("n_rows_a")),
            "uniqueness_b": ratio(F.col("unique_keys_b"), F.col("n_rows_b")),
            "overlap_vs_a": ratio(F.col("overlap_rows"), F.col("unique_keys_a")),
            "overlap_vs_b": ratio(F.col("overlap_rows"), F.col("unique_keys_b")),
        }
    ).withColumn("valid_key", ~F.col("type_conflict") & ~F.col("cardinality_mismatch"))


def value_index(tables: dict[str, DataFrame]) -> DataFrame:
    """Inverted index: a row per (column, value) that occurs, with its number of rows in each table (n_0, n_1, ...).

    All tables are unpivoted into one frame and grouped once; a hot value is summed before the shuffle.
    """
    parts = []
    for i, df in enumerate(tables.values()):
        items = F.array(*[F.named_struct(F.lit("column"), F.lit(c), F.lit("value"), F.col(f"`{c}`").cast("string")) for c in df.columns])
        parts.append(df.select(F.lit(i).alias("_t"), F.explode(items).alias("_i")).select("_t", "_i.column", "_i.value"))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("column", "value").agg(*[F.count_if(F.col("_t") == i).alias(f"n_{i}") for i in range(len(tables))])


def pair_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """``pair_profile`` of every pair of tables (file_a before file_b in the given order), from one index.

    The counts of all pairs are one aggregate over the index with a row per column; pairs and columns are metadata.
    """
    names = list(tables)
    index, known = value_index(tables), F.col("value").isNotNull()
    sums = {}
    for i in range(len(names)):
        n = F.col(f"n_{i}")
        sums |= {f"rows_{i}": F.sum(n), f"known_{i}": F.count_if((n > 0) & known), f"keys_{i}": F.count_if(n > 0)}
    pairs = list(combinations(range(len(names)), 2))
    for i, j in pairs:
        x, y = F.col(f"n_{i}"), F.col(f"n_{j}")
        sums |= {f"both_{i}_{j}": F.count_if((x > 0) & (y > 0)), f"joined_{i}_{j}": F.sum(F.when(known, x * y).otherwise(0))}
    totals = index.groupBy("column").agg(*[v.alias(k) for k, v in sums.items()])
    rows = []
    for i, j in pairs:
        a, b = tables[names[i]], tables[names[j]]
        common = [c for c in a.columns if c in b.columns]
        clash = [c for c in common if a.schema[c].dataType != b.schema[c].dataType]
        rows.append(
            F.when(
                F.col("column").isin(common),
                F.struct(
                    F.lit(names[i]).alias("file_a"), F.lit(names[j]).alias("file_b"),
                    *[F.col(f"{src}_{t}").alias(f"{out}_{side}") for src, out in (("rows", "n_rows"), ("known", "n_unique"), ("keys", "unique_keys")) for t, side in ((i, "a"), (j, "b"))],
                    F.col(f"both_{i}_{j}").alias("overlap_rows"), F.col(f"joined_{i}_{j}").alias("n_matches"), F.col("column").isin(clash).alias("type_conflict"),
                ),
            )
        )
    listed = totals.select("column", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("_p"))
    return _judged(listed.select("column", "_p.*"))


def merge_decisions(
    tables: dict[str, DataFrame], expected_key: str | None = None, max_join_rows: float = JOIN_EXPLOSION_ROWS, by_matches: bool = True
) -> DataFrame:
    """``merge_decision`` for every pair of tables: (file_a, file_b, strategy, reason, join_key, join_rows, similarity, confidences).

    ``join_rows`` is the number of rows that a join on the key would really have. A pair without a common or valid column
    has no key and goes to manual review.
    """
    names = list(tables)
    spark = tables[names[0]].sparkSession
    meta = []
    for a, b in combinations(names, 2):
        diff = ColumnDifference.of(tables[a], tables[b])
        meta.append((a, b, diff.missing > 0, diff.similarity))
    pairs = spark.createDataFrame(meta, "file_a string, file_b string, misses boolean, similarity double")
    score = F.least("uniqueness_a", "uniqueness_b")
    wanted = F.coalesce((F.col("column") == F.lit(expected_key)) & (score > KEY_UNIQUENESS), F.lit(False))
    # A row per pair and common column.
    order = Window.partitionBy("file_a", "file_b").orderBy(F.desc("_first"), F.desc("score"), "column")
    keys = (
        pair_profiles(tables).where("valid_key").withColumns({"score": score, "_first": wanted})
        .where((F.col("score") > 0) | F.col("_first")).withColumn("_place", F.row_number().over(order)).where("_place = 1")
    )
    strategy, reason = _verdict(F.col("misses"), max_join_rows, by_matches)
    sure = confidence(F.least("uniqueness_a", "uniqueness_b"), F.least("overlap_vs_a", "overlap_vs_b"), F.col("similarity"))
    return pairs.join(keys, ["file_a", "file_b"], "left").select(
        "file_a", "file_b", strategy.alias("strategy"), reason.alias("reason"), F.col("column").alias("join_key"), F.col("n_matches").alias("join_rows"),
        "similarity", *[c.alias(n) for n, c in sure.items()],
    )


def join_key(profile: DataFrame, expected: str | None = None) -> DataFrame:
    """The expected key when it is valid and nearly unique, else the most unique valid column."""
    score = F.least("uniqueness_a", "uniqueness_b")
    wanted = (F.col("column") == F.lit(expected)) & (score > KEY_UNIQUENESS)
    return (
        profile.where(F.col("valid_key"))
        .withColumns({"score": score, "_first": F.coalesce(wanted, F.lit(False))})
        .where((F.col("score") > 0) | F.col("_first"))
        .orderBy(F.desc("_first"), F.desc("score"), "column")
        .limit(1)  # the feature: one key
        .drop("_first")
    )


@dataclass(frozen=True)
class ColumnDifference:
    """How the columns of two tables differ (metadata)."""

    missing: int
    added: int
    type_changes: int

    @classmethod
    def of(cls, a: DataFrame, b: DataFrame) -> ColumnDifference:
        ca, cb = set(a.columns), set(b.columns)
        changed = sum(a.schema[c].dataType != b.schema[c].dataType for c in ca & cb)
        return cls(len(ca - cb), len(cb - ca), changed)

    @property
    def similarity(self) -> float:
        # The penalty of each difference, and the weights in ``confidence``.
        off = self.missing + self.added
        total = off + max(1, self.type_changes)
        return max(0.0, 1 - (off + self.type_changes) / (total + off))


def confidence(uniqueness: Column, overlap: Column, similarity: float | Column) -> dict[str, Column]:
    """Merging gains from overlap, appending from its absence."""
    base = F.lit(0.4) * uniqueness + F.lit(0.2) * similarity
    return {
        "confidence_merge": base + F.lit(0.4) * overlap,
        "confidence_append": base + F.lit(0.4) * (1 - overlap),
    }


def _verdict(misses_columns: Column, max_join_rows: float, by_matches: bool) -> tuple[Column, Column]:
    """Strategy and reason, from the chosen key's row."""
    va, vb = F.col("overlap_vs_a"), F.col("overlap_vs_b")
    product = F.col("n_rows_a").cast("double") * F.col("n_rows_b")
    explosive = (F.col("n_matches").cast("double") if by_matches else product) > max_join_rows
    disjoint = (va < DISJOINT_OVERLAP) & (vb < DISJOINT_OVERLAP)
    strong = (va > STRONG_OVERLAP) & (vb > STRONG_OVERLAP)
    cases = [
        (F.col("column").isNull(), "manual_review", "no valid join key"),
        (misses_columns, "reject", "schema mismatch"),
        (disjoint, "append", "datasets disjoint"),
        (strong & explosive, "reject", "join explosion risk"),
        (strong, "merge", "strong overlap"),
    ]
    strategy, reason = F, F
    for cond, s, r in cases:
        strategy, reason = strategy.when(cond, s), reason.when(cond, r)
    return strategy.otherwise("manual_review"), reason.otherwise("partial overlap")


def merge_decision(
    a: DataFrame,
    b: DataFrame,
    expected_key: str | None = None,
    max_join_rows: float = JOIN_EXPLOSION_ROWS,
    by_matches: bool = False,
) -> DataFrame:
    """One row: strategy (append, merge, reject, manual_review), reason, key and confidences.

    A merge is rejected if it could give more than ``max_join_rows``.  The estimate is the product of both row counts,
    which rejects any two tables of some thousand rows; ``by_matches`` counts the rows that the join on the key would
    really have.
    """
    diff = ColumnDifference.of(a, b)
    key = join_key(pair_profile(a, b), expected_key)
    strategy, reason = _verdict(F.lit(diff.missing > 0), max_join_rows, by_matches)
    # At most one row comes in; the aggregate keeps an answer when no key exists.
    needed = ["column", "uniqueness_a", "uniqueness_b", "overlap_vs_a", "overlap_vs_b", "n_rows_a", "n_rows_b", "n_matches"]
    row = key.agg(*[F.max(c).alias(c) for c in needed])
    return row.select(
        strategy.alias("strategy"),
        reason.alias("reason"),
        F.col("column").alias("join_key"),
        F.lit(diff.similarity).alias("similarity"),
        *[
            c.alias(n)
            for n, c in confidence(
                F.least("uniqueness_a", "uniqueness_b"), F.least("overlap_vs_a", "overlap_vs_b"), diff.similarity
            ).items()
        ],
    )


def execute_decision(a: DataFrame, b: DataFrame, decision: DataFrame) -> DataFrame:
    """Append or merge as decided (reads the one decision row); other strategies raise."""
    row = decision.first()
    if row["strategy"] == "append":
        return a.unionByName(b, allowMissingColumns=True)
    if row["strategy"] == "merge":
        key = row["join_key"]
        fresh = [c for c in b.columns if c not in a.columns]
        return a.join(b.select(key, *fresh), key, "inner")
    raise ValueError(f"{row['strategy']}: {row['reason']}")
