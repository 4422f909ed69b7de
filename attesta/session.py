"""Session settings, and tables written to shared storage to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "attesta", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    Partition sizing is left to AQE: a high initial shuffle partition number with
    coalescing lets the same plan fit eight local cores or a thousand executors.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    `spark.checkpoint.dir` decides. Only when nothing is configured, which is the
    single-machine case, is a fresh temporary folder used and remembered.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), "attesta", f"{label}-{uuid.uuid4().hex}")


def stage(df: DataFrame, label: str = "stage", group_mb: int = 0) -> DataFrame:
    """Write `df` once to shared storage and read it back.

    A Parquet reader holds up to 4,096 rows of a row group, and a writer looks at the size of a group only every
    100 rows. For rows of many KB, `group_mb` keeps a group to about so many MB, uncompressed as they are in memory.

    Used where a value must be the same in every branch of a plan (bucket ids) or
    where an iterative job must not regrow its lineage. The written table survives
    the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    wide = {"compression": "uncompressed", "parquet.block.size": str(group_mb << 20), "parquet.page.size.row.check.min": "1"} if group_mb else {}
    df.write.options(**wide).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


TASK_ROWS = 1_000_000


def dealt(keys: Sequence[str], *frames: DataFrame) -> list[DataFrame]:
    """Frames dealt alike over tasks by their keys, for about TASK_ROWS rows of all of them a task.

    The number of shuffle partitions is fixed, so what a task of a plain grouping or join holds grows with the input.
    """
    cores, rows = frames[0].sparkSession.sparkContext.defaultParallelism, sum(f.count() for f in frames)
    return [f.repartition(max(cores, -(-rows // TASK_ROWS)), *keys) for f in frames]


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False, place: bool = False) -> DataFrame:
    """A stored table. With `spread`, a scan that yields fewer tasks than there are cores (one small
    file) is spread over all of them, for CPU-heavy row work; larger scans are left as they are.
    With `place`, a column of that name orders rows as they are stored: by file, then by row."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if place:
        df = df.selectExpr("*", "struct(_metadata.file_path, _metadata.row_index) AS place")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df
