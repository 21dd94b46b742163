"""Model runs on shared storage: predictions, parameters and metrics, committed all or not at all.

An attempt writes its predictions into a folder of its own and then, last, the run's manifest, which names that folder. A
reader trusts manifests alone: what a killed attempt left behind is never read, and repeating a run that is committed
changes nothing. Of two attempts at once the one that creates the manifest first is the run.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run string, attempt string, n_rows bigint, model string, params map<string,string>, metrics map<string,double>, features array<string>, complete boolean"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifest_path(root: str, run: str) -> str:
    return f"{root.rstrip('/')}/manifests/{run}.json"


def manifest(spark: SparkSession, root: str, run: str) -> dict | None:
    """The manifest of a committed run; None if there is none, or one that was cut off while it was written."""
    fs, at = _file_system(spark, _manifest_path(root, run))
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if found.get("complete") else None


def save_run(
    predictions: DataFrame, root: str, run: str, *, model: str, params: dict | None = None, metrics: dict[str, float] | None = None, features=None
) -> dict:
    """Write a run once; gives its manifest, the earlier one if the run is committed already.

    ``run`` names the run (letters, digits, ``-`` and ``_``): a repeated job passes the same name.
    """
    if not run or not all(c.isalnum() or c in "-_" for c in run):
        raise ValueError(f"a run's name may hold letters, digits, - and _ only: {run!r}")
    spark = predictions.sparkSession
    if known := manifest(spark, root, run):
        return known
    attempt = f"{root.rstrip('/')}/attempts/{run}-{uuid.uuid4().hex}"
    predictions.write.parquet(attempt)
    told = {
        "run": run,
        "attempt": attempt,
        "n_rows": spark.read.parquet(attempt).count(),
        "model": model,
        "params": {k: str(v) for k, v in (params or {}).items()},
        "metrics": {k: float(v) for k, v in (metrics or {}).items()},
        "features": list(features or []),
        "complete": True,
    }
    _commit(spark, root, run, told)
    return manifest(spark, root, run)


def _commit(spark: SparkSession, root: str, run: str, told: dict) -> None:
    fs, at = _file_system(spark, _manifest_path(root, run))
    if fs.exists(at) and manifest(spark, root, run) is None:
        fs.delete(at, False)  # cut off: no reader has trusted it
    try:
        stream = fs.create(at, False)  # fails if another attempt was first
    except Exception as error:
        if manifest(spark, root, run) is None:
            raise RuntimeError(f"the manifest of run {run!r} can't be written") from error
        return
    try:
        stream.write(bytearray(json.dumps(told).encode()))
    finally:
        stream.close()


def runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed run: name, attempt folder, number of rows, model, parameters, metrics, features."""
    fs, at = _file_system(spark, f"{root.rstrip('/')}/manifests")
    if not fs.exists(at):
        return spark.createDataFrame([], MANIFEST).drop("complete")
    texts = spark.read.text(f"{root.rstrip('/')}/manifests", wholetext=True, pathGlobFilter="*.json")
    return texts.select(F.from_json("value", MANIFEST).alias("m")).select("m.*").where("complete").drop("complete")


def read_runs(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """Predictions of committed runs (all, or those named) with the run's name; one scan per run."""
    found = runs(spark, root)
    if names is not None:
        found = found.where(F.col("run").isin(names))
    listed = found.select("run", "attempt").orderBy("run").collect()  # a row per run
    if not listed:
        raise ValueError(f"no committed run in {root}")
    parts = [spark.read.parquet(r["attempt"]).withColumn("run", F.lit(r["run"])) for r in listed]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drop_leftovers(spark: SparkSession, root: str) -> int:
    """Remove attempts that no manifest names; not while a run is being written. Gives how many there were."""
    fs, at = _file_system(spark, f"{root.rstrip('/')}/attempts")
    if not fs.exists(at):
        return 0
    kept = {r["attempt"].rsplit("/", 1)[1] for r in runs(spark, root).select("attempt").collect()}
    gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in kept]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
