"""Shared parts of the text operators: the registry, stored intermediates and batch mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexcadence.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Words are runs of anything but ASCII white space; Java and Python read the pattern alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that one call of a row function sees; bounds the objects it makes.
SLICE_CHARS = 2_000_000

#: Bytes that an Arrow batch may hold.
BATCH_BYTES = "4m"


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir), with the SQL that must give the same rows if there is one."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends there, and the planner knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the folder, for a caller that removes it when nothing reads it any more."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate that no frame reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column has that name (case ignored)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = "_" + wanted
    return wanted


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    taken, out = list(df.columns), []
    for w in wanted:
        out.append(free_name(taken, w))
        taken.append(out[-1])
    return out


def named(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of text that travel to a task's Python at once; a longer text travels alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _slices(batch: pa.RecordBatch, texts: list[int]) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_CHARS bytes of text each; a longer text stands alone."""
    if batch.num_rows == 0:
        return
    sizes = [0] * batch.num_rows
    for c in texts:
        for i, n in enumerate(pa.compute.binary_length(batch.column(c)).to_pylist()):
            sizes[i] += n or 0
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def map_rows(
    df: DataFrame,
    inputs: list[str],
    into: str,
    dtype: T.DataType,
    make: Callable[[], Callable[..., pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append column ``into``: a row function over Arrow batches of the input columns.

    ``make`` runs once per task and returns the function, which gets one list of Python values per input
    column and returns an Arrow array of ``dtype``. ``keep`` names the columns that stay (all by default);
    a kept column of the name ``into`` is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kept = [c for c in (df.columns if keep is None else keep) if c != into]
    extra = [c for c in inputs if c not in kept]
    # Columns travel by place: names may hold dots.
    source = df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(kept + extra)])
    schema = T.StructType([*list(source.schema)[: len(kept)], T.StructField("new", dtype)])
    at = [(kept + extra).index(c) for c in inputs]
    texts = [i for i in at if isinstance(source.schema[i].dataType, T.StringType | T.BinaryType)]
    n_kept, kind = len(kept), to_arrow_type(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  used by _slices

        fn = make()
        for batch in batches:
            pa.default_memory_pool().release_unused()  # tasks keep their Python, and it would keep its largest batch
            for part in _slices(batch, texts):
                new = fn(*[part.column(i).to_pylist() for i in at])
                if new.type != kind:
                    new = new.cast(kind)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(n_kept)] + [new], names=[f.name for f in schema]
                )

    small_batches(df.sparkSession)
    return source.mapInArrow(run, schema).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("new").alias(into)
    )
