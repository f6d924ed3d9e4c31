"""Shared helpers: tables, the shared work folder, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyspark.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the setting is missing (tests on one machine) a temporary folder is used, and only with a local master.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it again, which cuts its lineage; returns it and its path.

    The table lives until drop_table() or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop_table, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for files; it lives until the end of the driver."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_table, spark, path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended; what is left is a temporary table
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def give_back() -> None:
    """Returns memory that this process has freed to the system, where its C library can."""
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What Python workers remember from task to task (dicts): models, and words with what is known of them.
caches: list[dict] = []


def cache() -> dict:
    """A dict of this worker that free_caches() empties."""
    caches.append({})
    return caches[-1]


def free_caches() -> None:
    """Workers are used again by later stages, which need the memory for themselves."""
    for c in caches:
        c.clear()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: T.StructType) -> DataFrame:
    """mapInArrow with a function from a batch to columns (a dict in the schema's order); memory is that of a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield to_batch(out, arrow)

    return df.mapInArrow(run, schema)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def utf8_list(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def runs(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Cuts consecutive rows into ranges of at most `most` bytes (one row may be larger)."""
    start = total = i = -1
    for i, size in enumerate(sizes):
        if start < 0 or total + size > most:
            if start >= 0:
                yield start, i
            start, total = i, 0
        total += size
    if start >= 0:
        yield start, i + 1
