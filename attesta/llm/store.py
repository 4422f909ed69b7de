"""Steps written to the cluster's shared folder, with shuffle files dropped once a step is written."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from attesta.session import fresh_path

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as each action ends, since its result is stored."""
    old = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, old)


def kept(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to `spark.checkpoint.dir` and read back; it outlives any executor."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove stored steps that nothing reads any more."""
    for df in tables:
        hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
