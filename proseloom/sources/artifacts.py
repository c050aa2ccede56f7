"""Corpus artifacts and structured logs as partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = (
    "book_id string, timestamp string, stage string, stage_name string, agent string, event string, message string, "
    "data string, error_name string, error_message string, stack string, resolved_at string, resolution string, "
    "_corrupt_record string"
)
LOG_KINDS = ("phase", "audit", "error")
CORPUS_TABLES = ("measures", "passages", "fingerprints", "document_stats")


def write_corpus(tables: dict[str, DataFrame], root: str, partition: str = "book_id") -> None:
    """Write corpus tables partitioned by book; a rebuild replaces only its own books.

    Rows are spread over several files per book, so a very large book is not
    written by one task.
    """
    for name, df in tables.items():
        if name not in CORPUS_TABLES:
            raise ValueError(f"unknown corpus table {name}")
        (
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition).parquet(f"{root}/{name}")
        )


def read_corpus(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{root}/{name}")


def append_log(entries: DataFrame, root: str, kind: str) -> None:
    """Append entries to one of the three logs as JSON lines."""
    if kind not in LOG_KINDS:
        raise ValueError(f"unknown log {kind}")
    entries.write.mode("append").json(f"{root}/log_kind={kind}")


def read_log(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Valid entries of one log; torn or foreign lines are left out."""
    return _read(spark, root, kind).where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_torn(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The lines :func:`read_log` leaves out."""
    return _read(spark, root, kind).where(F.col("_corrupt_record").isNotNull()).select(
        F.col("_corrupt_record").alias("line")
    )


def _read(spark: SparkSession, root: str, kind: str) -> DataFrame:
    # Parse from text, so the check on the corrupt column never re-reads a
    # pruned JSON scan.
    lines = spark.read.text(f"{root}/log_kind={kind}").where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return lines.select(F.from_json("value", LOG_SCHEMA, options).alias("e")).select("e.*")


def resolve_errors(errors: DataFrame, matching: Column, resolution: str, resolved_at: Column) -> DataFrame:
    """Mark unresolved matching errors; ``changed`` tells which rows did."""
    hit = F.col("resolved_at").isNull() & F.coalesce(matching, F.lit(False))
    return errors.withColumns(
        {
            "changed": hit,
            "resolution": F.when(hit, F.lit(resolution)).otherwise(F.col("resolution")),
            "resolved_at": F.when(hit, resolved_at).otherwise(F.col("resolved_at")),
        }
    )
