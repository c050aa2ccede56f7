"""Sinks of micro-batches: late rows beside those on time, and current rows per key.

Both write under the id of the micro-batch and commit last, so a batch that is
replayed after a loss overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def split_late(root: str, delay: str, time: str = "at") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows on time to ``on_time``, rows behind the watermark to ``late``.

    The watermark of a batch is the greatest time of all earlier batches less
    ``delay``; rows without a time are late.  ``marks`` holds one small row per
    batch: both counts and the greatest time so far; only the last one is read.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [int(n.split("=")[1]) for n in _children(spark, f"{root}/marks") if n.startswith("batch=")]
        before = max((n for n in before if n < batch_id), default=None)
        seen = None
        if before is not None:
            seen = spark.read.parquet(f"{root}/marks/batch={before}").first()["seen"]
        limit = F.lit(seen).cast("timestamp") - F.expr(f"interval {delay}")
        late = F.col(time).isNull() | F.coalesce(F.col(time) < limit, F.lit(False))
        # One pass over the batch; the side of a row is a partition of its output.
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{root}/rows/batch={batch_id}")
        try:
            written = spark.read.parquet(f"{root}/rows/batch={batch_id}")
        except AnalysisException:  # An empty batch leaves no files.
            written = batch.withColumn("late", late).limit(0)
        written.agg(
            F.count_if(~F.col("late")).alias("n_on_time"), F.count_if("late").alias("n_late"),
            F.greatest(F.max(time), F.lit(seen).cast("timestamp")).alias("seen"),
        ).coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/batch={batch_id}")

    return save


def read_side(spark: SparkSession, root: str, late: bool) -> DataFrame:
    """Rows on time, or late rows, of all batches; only their own files are read."""
    return spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows").where(F.col("late") == late).drop("late", "batch")


def read_marks(spark: SparkSession, root: str) -> DataFrame:
    """(batch, n_on_time, n_late, seen) of every batch."""
    return spark.read.parquet(f"{root}/marks")


def upsert(
    root: str, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame], partial: Callable[[DataFrame], DataFrame],
    buckets: int = 16,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps one current row per key.

    ``partial`` reduces a batch to mergeable rows and ``merge`` any union of such
    rows to one per key, so no stream state is held.  Keys lie in hash buckets; a
    batch rewrites the buckets it touches as a new generation and then commits a
    list of the generations that count.  Readers see the last list committed;
    what neither it nor the one before names is deleted, so reading costs the
    same after any number of batches.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = partial(batch).withColumn("bucket", bucket)
        current = _generations(spark, root, batch_id)
        data = f"{root}/data/generation={batch_id}"
        # Bucket numbers alone reach the driver.
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        if touched:
            old = [f"{root}/data/generation={g}/bucket={b}" for b, g in current.items() if b in touched]
            rows = new.drop("bucket")
            if old:
                rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*old))
            merge(rows).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(data)
        named = current | {b: batch_id for b in touched}
        listing = spark.createDataFrame(sorted(named.items()), "bucket int, generation bigint")
        listing.coalesce(1).write.mode("overwrite").parquet(f"{root}/listing/batch={batch_id}")
        kept = set(named.values()) | set(current.values())
        for name in _children(spark, f"{root}/data"):
            if name.startswith("generation=") and int(name.split("=")[1]) not in kept:
                _delete(spark, f"{root}/data/{name}")
        last_two = sorted(_listings(spark, root))[-2:]
        for number in set(_listings(spark, root)) - set(last_two):
            _delete(spark, f"{root}/listing/batch={number}")

    return save


def _listings(spark: SparkSession, root: str) -> list[int]:
    """Batches whose list of generations is committed."""
    names = [n for n in _children(spark, f"{root}/listing") if n.startswith("batch=")]
    return [int(n.split("=")[1]) for n in names if "_SUCCESS" in _children(spark, f"{root}/listing/{n}")]


def _generations(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    found = [n for n in _listings(spark, root) if before is None or n < before]
    if not found:
        return {}
    return {r.bucket: r.generation for r in spark.read.parquet(f"{root}/listing/batch={max(found)}").collect()}


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The current row of every key, or None before the first commit."""
    paths = [f"{root}/data/generation={g}/bucket={b}" for b, g in _generations(spark, root).items()]
    return spark.read.parquet(*paths) if paths else None


def run_batches(stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there now, micro-batch by micro-batch."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(save).start().awaitTermination()
