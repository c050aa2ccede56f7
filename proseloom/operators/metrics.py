"""Style metrics: per document, pooled per group, and merged by weight."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.scalar import (
    array_mean,
    array_percentile,
    array_spread,
    array_sum,
    col,
    count_char,
    count_matches,
    let,
    per_1k,
    ratio,
    round_half_up,
    sealed,
    share,
    spread,
)

# Additive raw counts behind the metrics.
COUNTS = [
    "n_words", "n_sentences", "n_paragraphs", "n_single", "n_spans", "n_spoken", "n_plain_tags", "n_ornate_tags",
    "n_ornate_words", "n_ly", "n_filter", "n_abstract", "n_simile", "n_contraction", "n_comma", "n_hyphen",
    "n_semicolon", "n_ellipsis",
]

#: Token arrays of a text: how each follows from the text or an earlier one, and from which.
ARRAYS = {
    "ps": (lambda a: F.transform(T.paragraphs(a["text"], a["delimiter"]), T.sentences), None),
    "psw": (lambda a: F.transform(a["ps"], lambda ss: F.transform(ss, T.words)), "ps"),
    "words": (lambda a: F.flatten(F.flatten(a["psw"])), "psw"),
    "slen": (lambda a: F.sort_array(F.filter(F.transform(F.flatten(a["psw"]), F.size), lambda n: n > 0)), "psw"),
    "plen": (lambda a: F.transform(a["psw"], lambda ss: array_sum(F.transform(ss, F.size)).cast("int")), "psw"),
    "spans": (lambda a: F.transform(T.spoken(a["text"]), T.word_count), None),
    "tags": (lambda a: T.dialogue_tags(a["text"]), None),
}


def with_arrays(
    text: Column | str, delimiter: str, body: Callable[[dict[str, Column]], Column], asked: Iterable[str] = tuple(ARRAYS)
) -> Column:
    """What ``body`` makes of the asked token arrays of a text, each computed once.

    Text is tokenised once, sentence by sentence; paragraph and document words
    are the concatenation, because no word crosses white space.  All is one
    expression: arrays as columns would be copied by every projection after them.
    """
    needed = set(asked)
    for name in reversed(ARRAYS):
        if name in needed and ARRAYS[name][1]:
            needed.add(ARRAYS[name][1])

    def bind(names: list[str], a: dict[str, Column]) -> Column:
        return let(ARRAYS[names[0]][0](a), lambda x: bind(names[1:], {**a, names[0]: x})) if names else body(a)

    return bind([n for n in ARRAYS if n in needed], {"text": col(text), "delimiter": delimiter})


def count_columns(a: dict[str, Column]) -> dict[str, Column]:
    """Raw counts of one document, from the arrays of :func:`with_arrays`."""
    text, words, tags = a["text"], a["words"], a["tags"]
    c = {
        "n_words": F.size(words),
        "n_sentences": array_sum(F.transform(a["ps"], F.size)),
        "n_paragraphs": F.size(a["ps"]),
        "n_single": F.size(F.filter(a["ps"], lambda s: F.size(s) == 1)),
        "n_spans": F.size(a["spans"]),
        "n_spoken": array_sum(a["spans"]),
        "n_plain_tags": T.count_in(tags, L.PLAIN_TAGS),
        "n_ornate_tags": T.count_in(tags, L.ORNATE_TAGS),
        "n_ornate_words": T.count_in(words, L.ORNATE_TAGS),
        "n_ly": count_matches(text, L.LY_ADVERB),
        "n_filter": T.count_in(words, L.FILTER_VERBS),
        "n_abstract": T.count_in(words, L.ABSTRACT_NOUNS),
        "n_simile": count_matches(text, L.SIMILE),
        "n_contraction": count_matches(text, L.CONTRACTION),
        "n_comma": count_char(text, ","),
        # Every ASCII hyphen counts here, never the long dash.
        "n_hyphen": count_char(text, "-"),
        "n_semicolon": count_char(text, ";"),
        "n_ellipsis": count_matches(text, L.ELLIPSIS),
    }
    return {k: v.cast("long") for k, v in c.items()}


def rates_from_counts(distinct: Column) -> dict[str, Column]:
    """Metrics that only need the additive counts (and the distinct word count)."""
    n = F.col("n_words")
    tags = F.col("n_plain_tags") + F.col("n_ornate_tags")
    per = {
        "dialogue_ornate_per_1k": "n_ornate_words",
        "texture_ly_adverbs_per_1k": "n_ly",
        "texture_filter_verbs_per_1k": "n_filter",
        "texture_abstract_nouns_per_1k": "n_abstract",
        "texture_similes_per_1k": "n_simile",
        "texture_contractions_per_1k": "n_contraction",
        "texture_commas_per_1k": "n_comma",
        "texture_em_dashes_per_1k": "n_hyphen",
        "texture_semicolons_per_1k": "n_semicolon",
        "texture_ellipses_per_1k": "n_ellipsis",
    }
    return {
        "paragraph_mean_sentences": round_half_up(ratio(F.col("n_sentences"), F.col("n_paragraphs"))),
        "paragraph_single_rate": share(F.col("n_single"), F.col("n_paragraphs")),
        "dialogue_word_share": share(F.col("n_spoken"), n),
        "dialogue_mean_line_words": round_half_up(ratio(F.col("n_spoken"), F.col("n_spans"))),
        # No known tag at all reads as plain.
        "dialogue_plain_tag_share": F.when(tags == 0, F.lit(1.0)).otherwise(share(F.col("n_plain_tags"), tags)),
        **{name: per_1k(F.col(count), n) for name, count in per.items()},
        "texture_type_token_ratio": share(distinct, n),
    }


def _state(a: dict[str, Column]) -> list[Column]:
    counts = [c.alias(name) for name, c in count_columns(a).items()]
    return [*counts, array_sum(a["plen"]).alias("par_words"), a["slen"].alias("lengths")]


def measures(
    df: DataFrame, key: Sequence[str], text: str = "text", delimiter: str = L.BLANK_LINE,
    **more: Callable[[dict[str, Column]], Column],
) -> DataFrame:
    """What one reading of every document leaves: counts, sentence lengths, distinct words.

    The state adds up: :func:`fingerprints` measures any grouping of the rows as
    one text, :func:`draft_metrics` each row alone, and neither reads a text.
    Write it where both are wanted.  ``more`` columns are computed from the token
    arrays of :func:`with_arrays` in the same pass.
    """
    made = with_arrays(text, delimiter, lambda a: F.struct(
        *_state(a), F.array_distinct(a["words"]).alias("vocabulary"), *[f(a).alias(name) for name, f in more.items()]))
    return df.select(*key, F.inline(F.array(made)))


def _row_rates(distinct: Column) -> dict[str, Column]:
    """The metrics of a row with ``lengths``."""
    slen = F.col("lengths")
    return {
        "sentence_mean_words": round_half_up(array_mean(slen)),
        "sentence_median_words": round_half_up(array_percentile(slen, 0.5)),
        "sentence_stdev_words": round_half_up(array_spread(slen)),
        "sentence_p10_words": round_half_up(array_percentile(slen, 0.1)),
        "sentence_p90_words": round_half_up(array_percentile(slen, 0.9)),
        "sentence_fragment_rate": share(F.size(F.filter(slen, lambda n: n < 5)), F.size(slen)),
        "sentence_long_rate": share(F.size(F.filter(slen, lambda n: n > 30)), F.size(slen)),
        "paragraph_mean_words": round_half_up(ratio(F.col("par_words"), F.col("n_paragraphs"))),
        **rates_from_counts(distinct),
    }


def _metric_columns(rates: dict[str, Column]) -> list[Column]:
    return [
        F.col("n_words").alias("word_count"), F.col("n_sentences").alias("sentence_count"),
        F.col("n_paragraphs").alias("paragraph_count"), *[rates[name].alias(name) for name in L.METRIC_COLUMNS],
    ]


def draft_metrics(measured: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Three counts and 24 metrics of every row of :func:`measures`."""
    rates = _row_rates(F.size("vocabulary"))
    return sealed(measured, key, [*_metric_columns(rates), *keep])


def document_metrics(
    df: DataFrame, key: Sequence[str], text: str = "text", delimiter: str = L.BLANK_LINE
) -> DataFrame:
    """Three counts and 24 metrics per document, in one narrow stage."""
    made = with_arrays(text, delimiter, lambda a: F.struct(
        *_state(a), F.size(F.array_distinct(a["words"])).alias("n_distinct")))
    return sealed(df.select(*key, F.inline(F.array(made))), key, _metric_columns(_row_rates(F.col("n_distinct"))))


def pooled_fingerprint(
    df: DataFrame, group: Sequence[str], text: str = "text", delimiter: str = L.BLANK_LINE
) -> DataFrame:
    """Metrics of a whole group measured as one text, never averaged."""
    return fingerprints(measures(df, list(group), text, delimiter), group)


def fingerprints(measured: DataFrame, group: Sequence[str]) -> DataFrame:
    """Metrics of each group of :func:`measures`, as if measured as one text.

    Each document becomes ``(kind, item, n)`` facts: its additive counts, its
    sentence lengths and its distinct words.  One aggregation by ``(group, kind,
    item)`` with map-side combine turns them into a small histogram, a
    vocabulary and totals per group, so a group holding a third of all rows
    never meets in one task.
    """
    group = list(group)

    def fact(kind: str, item: Column, n: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), item.alias("item"), n.cast("long").alias("n"))

    names = [*COUNTS, "par_words"]
    facts = F.concat(
        F.array(*[fact("count", F.lit(name), F.col(name)) for name in names]),
        F.transform("lengths", lambda n: fact("length", n.cast("string"), F.lit(1))),
        F.transform("vocabulary", lambda w: fact("word", w, F.lit(1))),
    )
    tallies = measured.select(*group, F.inline(facts)).groupBy(*group, "kind", "item").agg(F.sum("n").alias("n"))
    is_length = F.col("kind") == "length"
    length = F.when(is_length, F.col("item").try_cast("bigint"))
    freq = F.when(is_length, F.col("n"))
    zero = tallies.groupBy(*group).agg(
        *[
            F.coalesce(F.sum(F.when((F.col("kind") == "count") & (F.col("item") == c), F.col("n"))), F.lit(0)).alias(c)
            for c in names
        ],
        F.count_if(F.col("kind") == "word").alias("n_distinct"),
        F.coalesce(F.sum(freq), F.lit(0)).alias("s_n"),
        F.coalesce(F.sum(length * freq), F.lit(0)).alias("s_sum"),
        F.coalesce(F.sum(length * length * freq), F.lit(0)).alias("s_sq"),
        F.coalesce(F.sum(F.when(length < 5, freq)), F.lit(0)).alias("s_short"),
        F.coalesce(F.sum(F.when(length > 30, freq)), F.lit(0)).alias("s_long"),
        F.percentile(length, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.coalesce(freq, F.lit(0))).alias("s_pct"),
    )
    pct = lambda i: F.coalesce(F.get("s_pct", i), F.lit(0.0))
    rates = {
        "sentence_mean_words": round_half_up(ratio(F.col("s_sum"), F.col("s_n"))),
        "sentence_median_words": round_half_up(pct(1)),
        "sentence_stdev_words": round_half_up(spread(F.col("s_n"), F.col("s_sum"), F.col("s_sq"))),
        "sentence_p10_words": round_half_up(pct(0)),
        "sentence_p90_words": round_half_up(pct(2)),
        "sentence_fragment_rate": share(F.col("s_short"), F.col("s_n")),
        "sentence_long_rate": share(F.col("s_long"), F.col("s_n")),
        "paragraph_mean_words": round_half_up(ratio(F.col("par_words"), F.col("n_paragraphs"))),
        **rates_from_counts(F.col("n_distinct")),
    }
    return zero.select(*group, *_metric_columns(rates))


def merge_metrics(metrics: DataFrame, group: Sequence[str]) -> DataFrame:
    """Word-weighted mean of metric rows; rows without words do not count.

    A group with one usable row keeps that row's values, and a group with none
    gets zeros (plain-tag share 1), as an empty text would.
    """
    weight = F.col("word_count")
    used = weight > 0
    agg = metrics.groupBy(*group).agg(
        F.count_if(used).alias("_rows"),
        *[F.coalesce(F.sum(F.when(used, F.col(c))), F.lit(0)).cast("long").alias(c) for c in L.COUNT_COLUMNS],
        *[
            F.struct(
                F.sum(F.when(used, F.col(c) * weight)).alias("weighted"), F.max(F.when(used, F.col(c))).alias("only")
            ).alias(c)
            for c in L.METRIC_COLUMNS
        ],
    )

    def value(name: str) -> Column:
        empty = F.lit(1.0 if name == "dialogue_plain_tag_share" else 0.0)
        return (
            F.when(F.col("_rows") == 0, empty)
            .when(F.col("_rows") == 1, F.col(name)["only"])
            .otherwise(round_half_up(ratio(F.col(name)["weighted"], weight)))
        )

    return agg.select(*group, *L.COUNT_COLUMNS, *[value(c).alias(c) for c in L.METRIC_COLUMNS])
