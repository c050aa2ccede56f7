"""Document sources: scans, folder index and the admission filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scalar import trim
from ..operators.running import running


def read_documents(
    spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", columns: Sequence[str] | None = None,
    text: str = "text", schema: str | None = None,
) -> DataFrame:
    """Scan documents; unreadable and empty ones are skipped.

    ``fmt`` is ``parquet``, ``json`` (schema required), ``orc``, ``csv`` or
    ``text`` (one document per file).  Only the named columns are read.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "text":
        df = spark.read.text(paths, wholetext=True).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"),
            F.col("value").alias("text"),
        )
    else:
        reader = spark.read
        if fmt == "csv":
            reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
        if schema:
            reader = reader.schema(schema)
        df = reader.format(fmt).load(paths)
    if columns:
        df = df.select(*columns)
    return df.where(F.col(text).isNotNull() & (F.col(text) != ""))


BAD = "_bad_record"


def _records(spark: SparkSession, path: str | Sequence[str], fmt: str, schema: str) -> DataFrame:
    """Rows of the schema and, for records that do not fit it, their raw text."""
    paths = [path] if isinstance(path, str) else list(path)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    wide = f"{schema}, {BAD} string"
    if fmt == "json":
        lines = spark.read.text(paths).where(trim("value") != "")
        return lines.select(F.from_json("value", wide, options).alias("r")).select("r.*")
    if fmt == "csv":
        reader = spark.read.options(**options, header=True, multiLine=True, escape='"')
        return reader.schema(wide).csv(paths)
    if fmt == "orc":
        # Records of a columnar file are whole; files that cannot be read are left out.
        rows = spark.read.option("ignoreCorruptFiles", True).schema(schema).orc(paths)
        return rows.withColumn(BAD, F.lit(None).cast("string"))
    raise ValueError(f"no records in format {fmt}")


def read_records(
    spark: SparkSession, path: str | Sequence[str], fmt: str, schema: str, root: str, text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(documents, bad): records with a text, and what could not be read as ``(record, reason)``.

    The files are parsed once; both sides are written below ``root`` and read
    from there.  A record that breaks the schema is kept as its raw text, one
    without a text as an empty record of that reason.
    """
    rows = _records(spark, path, fmt, schema)
    empty = F.col(text).isNull() | (F.col(text) == "")
    reason = F.when(F.col(BAD).isNotNull(), "malformed").when(empty, "no text").otherwise("")
    rows.withColumn("reason", reason).write.partitionBy("reason").parquet(root)
    written = spark.read.schema(f"{schema}, {BAD} string, reason string").parquet(root)
    good = written.where(F.coalesce("reason", F.lit("")) == "").drop(BAD, "reason")
    bad = written.where(F.col("reason") != "").select(F.coalesce(BAD, F.lit("")).alias("record"), "reason")
    return good, bad


def spread_small_scan(df: DataFrame) -> DataFrame:
    """Use every core on an input that has fewer splits than the cluster has slots.

    Large inputs already have many splits and pass through untouched.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def folder_index(
    spark: SparkSession, root: str, pattern: str = "*"
) -> DataFrame:
    """Every file below a folder ``(path, relative, name, depth, length)``.

    Content is never read.  Repeats of one path count once.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(root).select("path", "length")
    )
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/+", "/")
    relative = F.regexp_replace(
        F.replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), F.regexp_replace(base, "/+$", ""), F.lit("")), "^/+", ""
    )
    return (
        files.dropDuplicates(["path"]).withColumn("relative", relative)
        .withColumn("depth", F.size(F.split("relative", "/")) - 1)
        .select("path", "relative", F.element_at(F.split("relative", "/"), -1).alias("name"), "depth", "length")
    )


def admit(files: DataFrame, batch: str = "batch_id", order: str = "ord") -> DataFrame:
    """Admission status and reason of every uploaded file.

    Blank names and texts are skipped, unsuitable files rejected, and the batch
    caps (files, characters) apply in upload order to the rows themselves.
    """
    name, text = trim("name"), F.col("text")
    extension = F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)\z", 1))
    mime = F.coalesce("mime", F.lit(""))
    first = (
        F.when((name == "") | (trim(text) == ""), "blank")
        .when(F.length(name) > L.UPLOAD_MAX_NAME, "name too long")
        .when(~extension.isin(L.UPLOAD_EXTENSIONS), "extension")
        .when(~mime.isin(L.UPLOAD_MIMES), "mime type")
        .when(F.length(text) > L.UPLOAD_MAX_CHARS, "file too large")
    )
    base = files.select(
        batch, order, name.alias("name"), mime.alias("mime"), F.length(text).cast("long").alias("n_chars"),
        first.alias("first_reason"), F.lit(1).cast("long").alias("_one"),
    ).withColumn("_chars", F.when(F.col("first_reason").isNull(), F.col("n_chars")).otherwise(0))
    summed = running(base, [batch], order, {"file_no": ("sum", "_one"), "batch_chars": ("sum", "_chars")})
    reason = (
        F.when(F.col("file_no") > L.UPLOAD_MAX_FILES, "too many files")
        .otherwise(
            F.coalesce(
                "first_reason", F.when(F.col("batch_chars") > L.UPLOAD_MAX_BATCH_CHARS, "batch too large"), F.lit("")
            )
        )
    )
    return summed.select(
        batch, order, "name", "mime", "n_chars", "file_no", "batch_chars",
        (reason == "").alias("admitted"), reason.alias("reason"),
    )
