"""Live forms of the journal audit, budget totals and receipt dedupe.

Streams read an append-only folder, keep state per key, and write to shared storage with a
checkpoint there, so a restarted driver or a lost executor continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from attesta.session import fresh_path, table


def events_stream(spark: SparkSession, folder: str, name: str = "events", files_per_batch: int = 200) -> DataFrame:
    """The table's files as a stream; the batch size bounds what one key can hold in one batch."""
    schema = table(spark, folder, name).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def budget_events(events: DataFrame) -> DataFrame:
    """Amounts in integer micros; clicks are reservations, the rest is recorded spend."""
    return events.select(
        "user_id",
        F.round(F.col("value") * 1000000).cast("bigint").alias("amount"),
        F.when(F.col("event_type") == "click", "reserved").otherwise("recorded").alias("kind"),
    )


def _finish(writer, spark: SparkSession, label: str) -> None:
    query = writer.option("checkpointLocation", fresh_path(spark, f"{label}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_budget_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals per run; every micro-batch overwrites its own version folder, the last one is current."""
    out = fresh_path(spark, "budget")
    totals = budget_events(events_stream(spark, folder)).groupBy("user_id").agg(
        F.sum(F.when(F.col("kind") == "recorded", F.col("amount")).otherwise(0)).alias("recorded"),
        F.sum(F.when(F.col("kind") == "reserved", F.col("amount")).otherwise(0)).alias("reserved"),
    )

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    _finish(totals.writeStream.outputMode("update").foreachBatch(keep), spark, "budget")
    # Update mode emits changed keys only: the newest epoch of each key is its current total.
    rows = spark.read.schema("user_id bigint, recorded bigint, reserved bigint, epoch int").parquet(out)
    latest = rows.groupBy("user_id").agg(F.max_by(F.struct("recorded", "reserved"), "epoch").alias("t"))
    return latest.select("user_id", "t.recorded", "t.reserved")


def stream_first_receipts(spark: SparkSession, folder: str) -> DataFrame:
    """First result wins per (run, kind): a stateful dedupe on the receipt's content key.

    The receipt number is the smallest of its key, kept as a streaming minimum, so arrival order
    inside a batch does not matter.
    """
    out = fresh_path(spark, "receipts")
    first = events_stream(spark, folder).groupBy("user_id", "event_type").agg(F.min("event_id").alias("n_first"))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    _finish(first.writeStream.outputMode("update").foreachBatch(keep), spark, "receipts")
    rows = spark.read.schema("user_id bigint, event_type string, n_first bigint, epoch int").parquet(out)
    return rows.groupBy("user_id", "event_type").agg(F.min("n_first").alias("n_first"))


class TransitionAudit(StatefulProcessor):
    """Keeps the last state and time of each run; emits a row per illegal step or backward clock."""

    def __init__(self, allowed: Sequence[tuple[str | None, str]]):
        self.allowed = {(a or "", b) for a, b in allowed}

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "state string, at timestamp")

    def handleInputRows(self, key, rows, timerValues):
        old = self.last.get() if self.last.exists() else None
        state, at = (old[0], old[1]) if old is not None else ("", None)
        found = []
        # One key's rows of one micro-batch, in sequence; earlier batches live on in the state only.
        batch = pd.concat(list(rows)).sort_values("event_id")
        for event_id, kind, ts in zip(batch["event_id"], batch["event_type"], batch["ts"]):
            ts = pd.Timestamp(ts)
            if at is not None and ts < pd.Timestamp(at):
                found.append((key[0], event_id, "time"))
            elif (state, kind) not in self.allowed:
                found.append((key[0], event_id, "transition"))
            state, at = kind, ts
        if at is not None:
            self.last.update((state, pd.Timestamp(at).to_pydatetime()))
        yield pd.DataFrame(found, columns=["user_id", "event_id", "rule"])

    def close(self) -> None:
        pass


def stream_journal_audit(spark: SparkSession, folder: str, allowed: Sequence[tuple[str | None, str]]) -> DataFrame:
    out = fresh_path(spark, "audit")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        audited = (
            events_stream(spark, folder)
            .select("user_id", "event_id", "event_type", "ts")
            .groupBy("user_id")
            .transformWithStateInPandas(TransitionAudit(allowed), "user_id bigint, event_id bigint, rule string", "append", "none")
        )
        _finish(audited.writeStream.format("parquet").option("path", out).outputMode("append"), spark, "audit")
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema("user_id bigint, event_id bigint, rule string").parquet(out)
