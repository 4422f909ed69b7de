"""Write-once outputs, append-only ledgers and keyed routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.numeric import clean


def write_once(df: DataFrame, path: str, fields: Sequence[str], fmt: str = "csv", sep: str = "\t") -> None:
    """Fixed field order, non-finite numbers empty, refusal when the output exists."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    out = df.select(*[clean(F.col(f)).alias(f) if f in floats else F.col(f) for f in fields])
    writer = out.write.mode("errorifexists").format(fmt)
    (writer.option("sep", sep).option("header", "true") if fmt == "csv" else writer).save(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def route_by_suffix(df: DataFrame, key: str, pattern: str, path: str) -> DataFrame:
    """Write rows into one folder per key suffix ('other' where none matches); returns counts per part.

    Rows are spread by (part, hash) before writing, so a part with most rows is written by many tasks. The
    counts are those of the written files.
    """
    spark = df.sparkSession
    part: Column = F.regexp_extract(key, pattern, 1)
    tagged = df.withColumn("part", F.when(part == "", F.lit("other")).otherwise(part))
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tagged.repartition("part", spread).write.mode("errorifexists").partitionBy("part").parquet(path)
    return spark.read.schema(tagged.schema).parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
