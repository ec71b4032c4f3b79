"""Shared-folder storage, document order and Arrow batches: what several operators here need."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# freed Arrow buffers go back to the system: workers live on and share an executor's memory
pa.set_memory_pool(pa.system_memory_pool())

# A slice of a batch holds about this many bytes of text, or a single document.
SLICE_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has processes of their own
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="postgrain-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call has."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends here."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Whole texts are long: where the session has Spark's default, batches get 1,000 rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- columns of any name ------------------------------------------------------------------------


def position(df: DataFrame, name: str) -> int:
    """Where the column ``name`` is: an equal name first, else one that differs in case alone."""
    names = df.columns
    if name in names:
        return names.index(name)
    found = [k for k, n in enumerate(names) if n.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name} among {names}")
    return found[0]


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: no name clashes with another."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def picked(df: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` of ``df``, found by ``position``, whatever its others are called."""
    return by_place(df).select(*(F.col(f"c{position(df, n)}").alias(n) for n in names))


def mapped(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any name, on both sides: tasks see c0, c1, ..."""
    plain = [f"c{k}" for k in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=plain)

    kinds = StructType([StructField(c, f.dataType) for c, f in zip(plain, schema, strict=True)])
    return by_place(df).mapInArrow(renamed, kinds).toDF(*schema.names)


def beside(df: DataFrame, columns: list[str], keep: dict[str, Column] | None) -> tuple[DataFrame, StructType]:
    """``columns`` of ``df``, then the expressions in ``keep`` (None: every column of ``df``), and the schema of
    those kept. Names do not matter: only places do."""
    wide = df if keep is None else df.select("*", *keep.values())
    first = 0 if keep is None else len(df.columns)
    names = df.columns if keep is None else list(keep)
    kept = StructType([StructField(n, f.dataType) for n, f in zip(names, wide.schema.fields[first:], strict=True)])
    own = [F.col(f"c{position(df, c)}").alias(f"own{k}") for k, c in enumerate(columns)]
    return by_place(wide).select(*own, *(F.col(f"c{first + k}").alias(f"kept{k}") for k in range(len(names)))), kept


# --- document order -----------------------------------------------------------------------------


def split_points(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` rising values that cut ``key`` into parts of about equal size."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = df.select(F.percentile_approx(key, shares, max(10_000, 20 * buckets))).first()[0]
    return sorted(set(found or []))


def bucket_of(key: Column, points: list[int]) -> Column:
    """How many points are below ``key``: 0 for null and the smallest, rising with the key.

    Two steps over about the square root of the points each, so many points stay cheap.
    """
    if not points:
        return F.lit(0)
    step = math.isqrt(len(points) - 1) + 1 if len(points) > 1 else 1
    below = lambda array: F.size(F.filter(array, lambda x: x < key))
    coarse = points[step - 1::step]
    skipped = below(F.lit(coarse)) * step if coarse else F.lit(0)
    return skipped + below(F.slice(F.lit(points), skipped + 1, step))


def in_order(df: DataFrame, key: str, ties: list[Column], descending: bool = False) -> tuple[DataFrame, int]:
    """``df`` with ``bucket``, one partition per bucket, sorted by ``key``; and the bucket count."""
    buckets = shuffle_partitions(df.sparkSession)
    points = split_points(df, key, buckets)
    count = len(points) + 1
    order = F.desc_nulls_last(key) if descending else F.asc_nulls_first(key)
    placed = df.withColumn("bucket", bucket_of(F.col(key), points))
    return placed.repartitionById(count, F.col("bucket")).sortWithinPartitions(order, *ties), count


def running_base(totals: DataFrame, bucket: str, value: str) -> DataFrame:
    """(bucket, base): the sum of ``value`` over all smaller buckets. One row per bucket goes in."""
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(bucket, F.coalesce(F.sum(value).over(before), F.lit(0)).alias("base"))


# --- Arrow batches ------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that arrays derived from the text stay small."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str | int = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]
