"""Structured Streaming jobs over run events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import state_store
from . import events as E

EVENT_SCHEMA = (
    "run_id bigint, seq bigint, at timestamp, kind string, text string, session_id string, agent string, depth int"
)


def open_parquet(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> DataFrame:
    """Stream of the parquet files in a folder."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def normalised(events: DataFrame) -> DataFrame:
    """Clean events, stateless."""
    return E.normalise(events)


def sessions(events: DataFrame, gap: str = "15 minutes", watermark: str = E.WATERMARK) -> DataFrame:
    """Activity sessions per run; a session closes once the watermark passes its end."""
    return (
        events.withWatermark("at", watermark)
        .groupBy("run_id", F.session_window("at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
        .select("run_id", F.col("w.start").alias("started"), F.col("w.end").alias("closes"), "n", "first_seq", "last_seq")
    )


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", partitions: int | None = None):
    """Process what is there now into a parquet table; returns the finished query.

    Append goes straight to the file sink.  Update and complete write each
    micro-batch under its own id, so a replayed batch overwrites itself.  State is
    kept in RocksDB, whatever store the session names.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.outputMode("append").format("parquet").option("path", sink)
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            out = batch if partitions is None else batch.coalesce(partitions)
            out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

        writer = writer.outputMode(mode).foreachBatch(save)
    with state_store(stream.sparkSession):
        query = writer.start()
    query.awaitTermination()
    return query


def latest_rows(spark: SparkSession, sink: str, key: list[str], version: str = "seq") -> DataFrame:
    """Current row per key of an update-mode sink."""
    df = spark.read.parquet(sink)
    rest = [c for c in df.columns if c not in (*key, "batch")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("batch", version)).alias("r")).select(
        *key, *[F.col(f"r.{c}").alias(c) for c in rest]
    )
