"""Structuring jobs: one document row in, many paragraph/sentence/word rows out.

All of them are narrow (a projection and an explode).  ``key`` names the columns
carried along, so the same job serves drafts, sources and passages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.scalar import (
    all_matches,
    array_sum,
    count_matches,
    let,
    matches,
    ranked_values,
    ratio,
    rows,
    slug,
    trim,
)
from .clean import prose


def paragraphs(df: DataFrame, key: Sequence[str], text: str = "text", delimiter: str = L.BLANK_LINE) -> DataFrame:
    """``(key, par_no, char_offset, text, n_words, is_speech)``."""
    return (
        df.select(*key, F.posexplode(T.chunks_with_offsets(text, delimiter)).alias("par_no", "p"))
        .select(*key, "par_no", "p.char_offset", "p.text")
        .withColumn("n_words", T.word_count("text"))
        .withColumn("is_speech", T.is_speech("text"))
    )


def sentences(df: DataFrame, key: Sequence[str], text: str = "text", delimiter: str = L.BLANK_LINE) -> DataFrame:
    """``(key, par_no, sent_no, text, words)``."""
    return (
        df.select(*key, F.posexplode(T.paragraphs(text, delimiter)).alias("par_no", "p"))
        .select(*key, "par_no", F.posexplode(T.sentences("p")).alias("sent_no", "text"))
        .withColumn("words", T.words("text"))
    )


def words(df: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """``(key, pos, word)``."""
    return df.select(*key, F.posexplode(T.words(text)).alias("pos", "word"))


def dialogue_spans(df: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """``(key, span_no, span, n_words)``."""
    return df.select(*key, F.posexplode(T.spoken(text)).alias("span_no", "span")).withColumn(
        "n_words", T.word_count("span")
    )


def dialogue_tags(df: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """``(key, tag_no, tag)``."""
    return df.select(*key, F.posexplode(T.dialogue_tags(text)).alias("tag_no", "tag"))


def ngrams(df: DataFrame, key: Sequence[str], text: str = "text", n: int = 4) -> DataFrame:
    """``(key, pos, gram)``."""
    return df.withColumn("_w", T.words(text)).select(*key, F.posexplode(T.ngrams(F.col("_w"), n)).alias("pos", "gram"))


def openers(df: DataFrame, key: Sequence[str], text: str = "text", delimiter: str = L.BLANK_LINE) -> DataFrame:
    """``(key, par_no, sent_no, opener)`` for openers of three letters or more."""
    return (
        sentences(df, key, text, delimiter)
        .select(*key, "par_no", "sent_no", T.opener(F.col("words")).alias("opener"))
        .where(F.length("opener") >= 3)
    )


def line_flags(line: Column) -> dict[str, Column]:
    return {
        "is_bullet": matches(line, L.BULLET_LINE, False),
        "is_heading": matches(line, L.HEADING_LINE, False),
        "is_field": matches(line, L.FIELD_LINE, False),
        "is_dated": matches(line, L.DATE_LINE),
    }


def lines(df: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Non-blank lines with flags ``(key, line_no, line, is_bullet, is_heading, is_field, is_dated)``."""
    out = df.select(*key, F.posexplode(T.lines(text)).alias("line_no", "line")).where(trim("line") != "")
    return out.withColumns(line_flags(F.col("line")))


# --- passages ----------------------------------------------------------------


def passage_ranges(paras: Column, min_words: int = 60, max_words: int = 320, seam_words: int = 25) -> Column:
    """Group an ordered ``array<struct<text, n, speech>>`` into passages.

    An ordered fold that keeps only ``(first, len)`` ranges.  A paragraph at the
    ceiling stands alone; the run breaks at a speech/narration seam once enough
    words are held; a narration paragraph closes the run when it is long enough.
    Speech is sticky within a run.
    """
    none = F.array().cast("array<struct<first:int,len:int>>")
    start = F.struct(
        none.alias("out"), F.lit(0).alias("i"), F.lit(0).alias("held"), F.lit(0).cast("long").alias("n"),
        F.lit("").alias("run"),
    )

    def piece(first: Column, length: Column) -> Column:
        return F.array(F.struct(first.cast("int").alias("first"), length.cast("int").alias("len")))

    def step(acc: Column, p: Column) -> Column:
        held_out = F.when(acc["held"] > 0, piece(acc["i"] - acc["held"], acc["held"])).otherwise(none)
        speech_run = F.when(p["speech"], F.lit("speech")).otherwise(F.lit("narration"))
        seam = (acc["run"] != "") & (acc["run"] != speech_run) & (acc["n"] >= seam_words)
        held = F.when(seam, F.lit(0)).otherwise(acc["held"]) + 1
        n = F.when(seam, F.lit(0).cast("long")).otherwise(acc["n"]) + p["n"]
        run = F.when(p["speech"] | seam | (acc["run"] == ""), speech_run).otherwise(acc["run"])
        closes = (n >= min_words) & ~p["speech"]
        long = F.struct(
            F.concat(acc["out"], held_out, piece(acc["i"], F.lit(1))).alias("out"),
            (acc["i"] + 1).alias("i"), F.lit(0).alias("held"), F.lit(0).cast("long").alias("n"), F.lit("").alias("run"),
        )
        before = F.concat(acc["out"], F.when(seam, held_out).otherwise(none))
        normal = F.struct(
            F.concat(before, F.when(closes, piece(acc["i"] + 1 - held, held)).otherwise(none)).alias("out"),
            (acc["i"] + 1).alias("i"),
            F.when(closes, F.lit(0)).otherwise(held).alias("held"),
            F.when(closes, F.lit(0).cast("long")).otherwise(n).alias("n"),
            F.when(closes, F.lit("")).otherwise(run).alias("run"),
        )
        return F.when(p["n"] >= max_words, long).otherwise(normal)

    def finish(acc: Column) -> Column:
        tail = F.when(acc["held"] > 0, piece(acc["i"] - acc["held"], acc["held"])).otherwise(none)
        return F.concat(acc["out"], tail)

    return F.aggregate(paras, start, step, finish)


def passages(
    df: DataFrame,
    key: Sequence[str],
    text: str = "text",
    source: str | None = None,
    min_words: int = 60,
    max_words: int = 320,
    delimiter: str = L.BLANK_LINE,
) -> DataFrame:
    """Passages ``(key, passage_no, text, n_words[, passage_id])``.

    Numbers count every group, so dropping the ones under 20 words leaves gaps.
    """
    paras = F.filter(
        F.transform(
            T.paragraphs("_prose", delimiter),
            lambda p: F.struct(p.alias("text"), T.word_count(p).alias("n"), T.is_speech(p).alias("speech")),
        ),
        lambda p: p["n"] > 0,
    )
    carried = [*key] + ([source] if source and source not in key else [])
    out = (
        df.select(*carried, prose(text).alias("_prose"))
        .select(*carried, paras.alias("_paras"))
        .withColumn("_ranges", passage_ranges(F.col("_paras"), min_words, max_words))
        .select(*carried, "_paras", F.posexplode(rows("_ranges")).alias("passage_no", "_r"))
        .withColumn("_slice", F.slice("_paras", F.col("_r.first") + 1, F.col("_r.len")))
        .select(
            *carried,
            "passage_no",
            F.array_join(F.transform("_slice", lambda p: p["text"]), "\n\n").alias("text"),
            array_sum(F.transform("_slice", lambda p: p["n"])).alias("n_words"),
        )
        .where(F.col("n_words") >= 20)
    )
    if source:
        out = out.withColumn("passage_id", F.concat_ws("-", slug(source), F.col("passage_no")))
    return out


def beat(text: Column | str, n_words: Column | None = None) -> Column:
    """What a passage is doing, by marker density per 100 words."""
    c = F.col(text) if isinstance(text, str) else text
    total = T.word_count(c) if n_words is None else n_words
    densities = F.struct(
        total.alias("n"),
        ratio(T.spoken_words(c), total).alias("spoken"),
        *[
            ratio(count_matches(c, p), total.cast("double") / F.lit(100.0)).alias(name)
            for name, p in (("act", L.ACTION_VERBS), ("inner", L.INTERIOR_MARKERS), ("shift", L.TRANSITION_MARKERS))
        ],
    )

    def label(d: Column) -> Column:
        return (
            F.when(d["n"] == 0, "description")
            .when(d["spoken"] >= 0.3, "dialogue")
            .when((d["shift"] >= 1.2) & (d["n"] < 120), "transition")
            .when((d["act"] >= 1.5) & (d["act"] > d["inner"]), "action")
            .when(d["inner"] >= 1.2, "interiority")
            .when(d["act"] >= 0.8, "action")
            .otherwise("description")
        )

    return let(densities, label)


def speakers(text: Column | str) -> Column:
    """Capitalised names away from sentence starts, all of them, most frequent first.

    Ties keep the order of first appearance.
    """
    found = F.filter(
        # The capital first: looking behind is for the few places that have one.
        all_matches(text, "(?=[A-Z])" + L.SPEAKER, 1, multiline=True), lambda n: ~F.lower(n).isin(L.SPEAKER_STOP)
    )
    return let(found, ranked_values)
