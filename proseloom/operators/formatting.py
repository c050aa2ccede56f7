"""Formatting evidence: bold dialogue, italics, and the gate over directions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.scalar import count_matches, matches


def observations(df: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Word, dialogue, bold and italic span counts per source."""
    counts = {
        "word_count": T.word_count(text),
        "dialogue_count": count_matches(text, L.FORMAT_DIALOGUE, False),
        "bold_dialogue_count": count_matches(text, L.FORMAT_BOLD_DIALOGUE, False),
        "italic_count": count_matches(text, L.FORMAT_ITALIC, False),
        "bold_count": count_matches(text, L.FORMAT_BOLD, False),
    }
    return df.select(*key, *[c.cast("long").alias(n) for n, c in counts.items()])


def conventions(observed: DataFrame, group: Sequence[str]) -> DataFrame:
    """How many sources of a group use bold dialogue and italics."""
    return observed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("bold_dialogue_count") > 0).alias("bold_dialogue_sources"),
        F.count_if(F.col("italic_count") > 0).alias("italic_sources"),
    )


def gate(chapters: DataFrame, directions: DataFrame, text: str = "text") -> DataFrame:
    """Does each chapter hold the formatting its directions ask for?

    Directions are reduced to two flags per book and per (book, chapter) before
    they meet the chapters, so no chapter is joined to a list of directions.
    """
    lowered = F.lower(F.col("text"))
    flags = directions.select(
        "book_id", "scope", "chapter",
        matches(lowered, L.BOLD_DIRECTION, False).alias("bold"),
        matches(lowered, L.ITALIC_DIRECTION, False).alias("italic"),
    )
    book = (
        flags.where(F.col("scope") == "book").groupBy("book_id")
        .agg(F.bool_or("bold").alias("b_bold"), F.bool_or("italic").alias("b_italic"))
    )
    own = (
        flags.where(F.col("chapter").isNotNull()).groupBy("book_id", "chapter")
        .agg(F.bool_or("bold").alias("c_bold"), F.bool_or("italic").alias("c_italic"))
    )
    seen = observations(chapters, ["book_id", "chapter"], text)
    joined = seen.join(own, ["book_id", "chapter"], "left").join(book, "book_id", "left")
    flag = lambda a, b: F.coalesce(F.col(a), F.lit(False)) | F.coalesce(F.col(b), F.lit(False))
    out = joined.withColumn("needs_bold_dialogue", flag("b_bold", "c_bold")).withColumn(
        "needs_italic_thoughts", flag("b_italic", "c_italic")
    )
    plain_line = (F.col("dialogue_count") > 0) & (F.col("bold_dialogue_count") < F.col("dialogue_count"))
    return out.select(
        "book_id", "chapter", "needs_bold_dialogue", "needs_italic_thoughts",
        (~(F.col("needs_bold_dialogue") & plain_line)
         & ~(F.col("needs_italic_thoughts") & (F.col("italic_count") == 0))).alias("follows"),
    )
