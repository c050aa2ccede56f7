"""A corpus as stored tables per book: measures, passages, fingerprints, document statistics.

Texts are read when a book is built or rebuilt; everything that compares,
scores or retrieves reads the tables.  A rebuild replaces the partitions of its own
books and leaves others alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..sources import artifacts
from . import manuscript, metrics, structure


def measured_passages(docs: DataFrame, delimiter: str = L.BLANK_LINE) -> DataFrame:
    """Passages with beat, speakers and their own metrics."""
    cut = structure.passages(docs, ["book_id", "doc_id"], delimiter=delimiter)
    rows = cut.select(
        "book_id", "doc_id", "passage_no", F.concat_ws("-", "doc_id", "passage_no").alias("passage_id"), "text", "n_words",
        structure.beat("text", F.col("n_words")).alias("beat"), structure.speakers("text").alias("speakers"))
    own = [*L.COUNT_COLUMNS, *L.METRIC_COLUMNS]
    # The words of a passage are counted with its metrics again.
    key = [c for c in rows.columns if c != "n_words"]
    measured = metrics.document_metrics(rows, key, delimiter=delimiter)
    return measured.withColumn("n_words", F.col("word_count")).select(*rows.columns, F.struct(*own).alias("metrics"))


def document_stats(docs: DataFrame) -> DataFrame:
    """Story words, chapters and words per chapter of every document."""
    key = ["book_id", "doc_id"]
    return manuscript.document_stats(manuscript.manuscripts(docs, key, columns=["story_words", "chapters"]), key)


TABLES = ("measures", "passages", "document_stats", "fingerprints")


def _marked(rows: DataFrame, books: DataFrame) -> DataFrame:
    """The rows and an empty one per book, so that a book that is left without rows loses its old ones too."""
    return rows.withColumn("_mark", F.lit(False)).unionByName(
        books.withColumn("_mark", F.lit(True)), allowMissingColumns=True)


def build(docs: DataFrame, root: str, tables: Sequence[str] = TABLES, delimiter: str = L.BLANK_LINE) -> None:
    """Write or replace tables of the corpus for the books in ``docs(book_id, doc_id, text)``.

    Fingerprints are derived from the written measures, without reading a text
    again.
    """
    books = docs.select("book_id").distinct()
    made = {
        "measures": lambda: metrics.measures(docs, ["book_id", "doc_id"], delimiter=delimiter),
        "passages": lambda: measured_passages(docs, delimiter),
        "document_stats": lambda: document_stats(docs),
    }
    artifacts.write_corpus({name: _marked(made[name](), books) for name in tables if name in made}, root)
    if "fingerprints" in tables:
        mine = read(docs.sparkSession, root, "measures").join(books, "book_id", "left_semi")
        artifacts.write_corpus({"fingerprints": _marked(metrics.fingerprints(mine, ["book_id"]), books)}, root)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the corpus; a filter on ``book_id`` reads only that book's files."""
    return artifacts.read_corpus(spark, root, name).where(~F.col("_mark")).drop("_mark")
