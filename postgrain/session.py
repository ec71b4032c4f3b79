"""Session settings and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "postgrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so lost executors cost no recompute.

    The folder comes from the session (``spark.checkpoint.dir``). A local session without one gets
    a temporary folder; a cluster without one is refused, because executors share no local disk.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get(
            "spark.checkpoint.dir", None
        )
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="postgrain-checkpoints-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def new_shared_folder(spark: SparkSession, label: str) -> str:
    """A path that no other call has, in the shared folder of the session (see :func:`checkpointed`)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="postgrain-tables-")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


# Below this size a table is read as it is, however few partitions that gives.
SPREAD_BYTES = 256 * 1024


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; a file too coarse to occupy the cores is spread over them.

    Files are split at row groups, so one small file is one task however many cores wait. Tables
    with at least as many splits as cores, which is every table of real size, are not shuffled.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a split holds at most maxPartitionBytes, so a larger table has more splits than cores
    if SPREAD_BYTES < size < cores * 128 * 1024 * 1024 and table.rdd.getNumPartitions() < cores:
        return table.repartition(cores)
    return table


def bounded(items: Iterable, limit: int, what: str) -> list:
    """A driver-side rule list, refused when too long to be inlined into a plan."""
    values = list(items)
    if len(values) > limit:
        raise ValueError(f"{what}: {len(values)} entries, at most {limit} can be inlined")
    return values
