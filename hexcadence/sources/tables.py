"""Catalog tables: load with validation, scan, views, update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexcadence.operators import relational


def key_validation(df: DataFrame, key: str) -> DataFrame:
    """Row count against distinct keys."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col(key).isNotNull()).alias("n_keys"),
    ).withColumn("unique", F.col("n_rows") == F.col("n_keys"))


def save_table(
    df: DataFrame,
    name: str,
    *,
    dtypes: dict[str, str] | None = None,
    key: str | None = None,
    replace: bool = False,
    partition_by: Sequence[str] = (),
) -> DataFrame | None:
    """Write a managed table with the given column types; returns the key validation row."""
    if dtypes:
        df = df.select(*[F.col(c).try_cast(t).alias(c) for c, t in dtypes.items()])
    writer = df.write.mode("overwrite" if replace else "append").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return key_validation(df.sparkSession.table(name), key) if key else None


def scan_cube(spark: SparkSession, name: str, resolution: int) -> DataFrame:
    return spark.table(name).withColumn("resolution", F.lit(resolution))


def scan_cubes(spark: SparkSession, names: dict[tuple[int, str], str]) -> DataFrame:
    """All (resolution, freq) cubes as one frame."""
    out = None
    for (resolution, freq), name in names.items():
        one = scan_cube(spark, name, resolution).withColumn("freq", F.lit(freq))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def place_view(df: DataFrame, name: str, columns: Sequence[str], lat: str, lon: str) -> DataFrame:
    """Register a view of the rows that have a place, and read it."""
    view = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*columns)
    view.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def update_table(
    spark: SparkSession, name: str, source: DataFrame, key: str, columns: Sequence[str], into: str
) -> None:
    """Fill columns of a table from ``source`` by key, written as table ``into``."""
    updated = relational.update_from(spark.table(name), source, key, columns)
    updated.write.mode("overwrite").format("parquet").saveAsTable(into)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def table_schema(spark: SparkSession, name: str) -> DataFrame:
    fields = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(spark.table(name).schema)]
    return spark.createDataFrame(fields, "position int, column string, dtype string, nullable boolean")
