"""Evidence findings over project material: one row per book and finding.

Each document is read once into candidate values (first labelled line, first
useful line, ...).  Books are then resolved with ``min_by`` aggregates, which
combine map side, so no book is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.patterns import JAVA_BOUNDARY, java
from ..functions.scalar import (
    all_matches,
    any_match,
    count_matches,
    first_match,
    let,
    matches,
    replace_all,
    sealed,
    trim,
    value_counts,
)
from ..session import cut_lineage
from .lookup import salted_lookup
from .manuscript import WORKING, story_start, with_boundaries

SEPARATE_OPENING = "Present as a separate opening section."
SEPARATE_SECTION = "Present as a separate section."


# --- document roles ------------------------------------------------------------


def has_kind(kind: str) -> Column:
    return F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), kind)


def _has_any(kinds: Sequence[str]) -> Column:
    return F.arrays_overlap(F.coalesce("kinds", F.array().cast("array<string>")), F.array(*[F.lit(k) for k in kinds]))


def is_planning() -> Column:
    return _has_any(L.PLANNING_KINDS)


def is_narrative() -> Column:
    return (F.size(F.coalesce("kinds", F.array().cast("array<string>"))) == 0) | _has_any(
        ["past_book", "reference_book"]
    )


def is_relationship_evidence() -> Column:
    return (F.size(F.coalesce("kinds", F.array().cast("array<string>"))) == 0) | has_kind("past_book") | is_planning()


def narrative_slice(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``narrative``: first chapter to story end for narrative documents.

    A table that already carries it passes through, so a job with several
    readers can compute it once.
    """
    if "narrative" in df.columns:
        return df
    # Only narrative documents have a story to look for.
    out = with_boundaries(df.withColumn("_told", F.when(is_narrative(), F.col(text))), "_told")
    start = F.coalesce(story_start(), F.lit(0))
    end = F.when(F.col("story_end") == 0, F.length(text)).otherwise(F.col("story_end"))
    sliced = let(start, lambda at: F.substring(F.col(text), at + 1, F.greatest(end - at, F.lit(0))))
    return out.withColumn("narrative", F.when(is_narrative(), sliced).otherwise(F.col(text))).drop(
        *WORKING, "_told", "story_end"
    )


# --- snippets ----------------------------------------------------------------------


def clean_snippet(value: Column, limit: int = 300) -> Column:
    """One line: white space runs closed, list marks off, cut at whole sentences."""
    flat = trim(replace_all(replace_all(value, r"\s+", " "), r"^[-*\d.)\s]+", ""))

    def cut(line: Column) -> Column:
        done = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("full"))
        whole = F.filter(T.sentences(line), lambda s: matches(s, r"[.!?][\"'”’)]?$", False))

        def step(acc: Column, s: Column) -> Column:
            longer = F.when(acc["n"] == 0, s).otherwise(F.concat(acc["text"], F.lit(" "), s))
            over = (F.length(longer) > limit) & (acc["n"] > 0)
            return F.when(
                acc["full"] | over, F.struct(acc["text"].alias("text"), acc["n"].alias("n"), F.lit(True).alias("full"))
            ).otherwise(
                F.struct(longer.alias("text"), (acc["n"] + 1).alias("n"), (F.length(longer) >= limit).alias("full"))
            )

        kept = F.aggregate(whole, done, step, lambda acc: acc["text"])
        return F.when(F.length(line) <= limit, line).otherwise(F.coalesce(F.nullif(kept, F.lit("")), line))

    return let(flat, cut)


def _first(lines: Column, value: Callable[[Column], Column]) -> Column:
    """The first value that is not null; lines after it are not looked at."""
    return F.aggregate(
        lines, F.lit(None).cast("string"), lambda found, x: F.when(found.isNotNull(), found).otherwise(value(x))
    )


def labelled(text: Column, pattern: str) -> Column:
    """First line whose label starts within three characters, value cleaned.

    Null when no line carries 12 characters or more.  A label ends in a colon or
    a hyphen.
    """
    at_start = java(r"^[^\n]{0,3}?" + pattern, True)
    label = lambda x: (F.contains(x, F.lit(":")) | F.contains(x, F.lit("-"))) & x.rlike(at_start)
    value = lambda x: let(
        clean_snippet(F.regexp_extract(x, at_start, 1)), lambda v: F.when(F.length(v) >= 12, v))
    return _first(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.when(label(x), value(x)))


def useful_line(text: Column) -> Column:
    """First line of 25 characters or more that is not a list or heading."""
    value = lambda x: let(
        clean_snippet(x), lambda v: F.when((F.length(v) >= 25) & ~v.rlike(r"^[-*#\d]"), v))
    # Cleaning makes no line longer.
    return _first(F.split(text, r"\r?\n"), lambda x: F.when(F.length(x) >= 25, value(x)))


def matching_line(text: Column, pattern: str) -> Column:
    """First line of 18 characters or more that matches, cleaned."""
    value = lambda x: let(
        clean_snippet(x), lambda v: F.when(matches(v, pattern) & (F.length(v) >= 18), v))
    return _first(F.split(text, r"\r?\n"), lambda x: F.when(matches(x, pattern), value(x)))


def section_marker(text: Column, pattern: str, fallback: str) -> Column:
    """``Present: ...`` for an explicit prologue or epilogue line, else null."""
    lines = F.transform(F.split(text, r"\r?\n"), trim)

    def find(ls: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: matches(F.get(ls, i), pattern))

        def detail(i: Column) -> Column:
            own = F.nullif(clean_snippet(first_match(F.get(ls, i), pattern, 1, True)), F.lit(""))
            later = F.get(
                F.filter(
                    F.slice(ls, i + 2, F.greatest(F.size(ls) - i - 1, F.lit(0))),
                    lambda x: (F.length(x) >= 20) & ~x.rlike(r"^[-*#]"),
                ),
                0,
            )
            return F.concat(F.lit("Present: "), F.coalesce(own, later, F.lit(fallback)))

        return F.get(F.transform(F.slice(hits, 1, 1), detail), 0)

    return let(lines, find)


def summaries(documents: DataFrame, key: Sequence[str]) -> DataFrame:
    """Words and the heading-like lines of each document."""
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: replace_all(trim(x), r"^#+\s*", ""))
    headings = F.filter(
        lines,
        lambda x: F.length(x).between(3, 100)
        & (any_match(x, L.SUMMARY_HEADING) | matches(x, L.SUMMARY_TITLE, False)),
    )
    return documents.select(
        *key, F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"),
        T.word_count("text").alias("n_words"), headings.alias("headings"),
    )


# --- names --------------------------------------------------------------------------


def _outside_quotes(text: Column) -> Column:
    """Blank the capitals inside quotes, by parity of the marks before them."""

    def blank(c: Column, marks: str) -> Column:
        pieces = F.split(F.regexp_replace(c, f"([{marks}])", "$1\x01"), "\x01")
        # Every piece ends with its mark, so parity is the piece's own index.
        return F.array_join(
            F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, "[A-Z]", "\x02")).otherwise(p)), ""
        )

    return blank(blank(text, '"'), "“”")


def _counted_mentions(narrative: Column) -> Column:
    """``array<struct<name, mentions, inner>>`` of capitalised runs in one text."""
    space = java(r"\s")
    # The class first spares all other signs the rest; before a capital the boundary is one-sided.
    pattern = (
        rf"(?=[A-Z\x03.!?])(?:[\x03.!?]{space}*)?(?<!\w)[A-Z][a-zÀ-ɏ]{{2,}}(?:{space}+[A-Z][a-zÀ-ɏ]{{2,}}){{0,2}}"
        + JAVA_BOUNDARY
    )
    found = F.regexp_extract_all(F.concat(F.lit("\x03"), _outside_quotes(narrative)), F.lit(pattern), F.lit(0))
    # Name and place as one value, so that one sort counts both: a name's entries stand together, inner ones first.
    marked = F.transform(
        found,
        lambda m: F.concat(
            F.regexp_replace(m, r"^[^A-Z]+", ""),
            F.when(m.rlike(r"^[\x03.!?]"), F.lit("\x01" + "1")).otherwise(F.lit("\x01" + "0")),
        ),
    )
    entries = F.transform(
        value_counts(marked),
        lambda c: F.struct(
            F.substring_index(c["value"], "\x01", 1).alias("name"), c["n"].alias("n"), c["value"].endswith("0").alias("inner")
        ),
    )

    def tally(es: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            second = F.when(F.get(es, i + 1)["name"] == e["name"], F.get(es, i + 1)["n"])
            return F.when(
                (i == 0) | (F.get(es, i - 1)["name"] != e["name"]),
                F.struct(
                    e["name"].alias("name"), (e["n"] + F.coalesce(second, F.lit(0).cast("long"))).alias("mentions"),
                    F.when(e["inner"], e["n"]).otherwise(F.lit(0).cast("long")).alias("inner"),
                ),
            )

        return F.array_compact(F.transform(es, one))

    return let(entries, tally)


def character_names(documents: DataFrame, group: Sequence[str]) -> DataFrame:
    """All ranked names per group ``(group, rank, name, score, mentions)``; readers filter.

    Candidates are reduced to one row per (group, name) with map-side combine
    before they are ranked; a reader's rank filter is pushed below the sort shuffle.
    """
    group = list(group)
    documents = narrative_slice(documents)
    clean = lambda c: trim(replace_all(c, r"\s+", " "))
    labelled_names = documents.select(
        *group, F.explode(all_matches("text", L.LABELLED_NAME, 1, True, True)).alias("name")
    ).select(*group, clean(F.col("name")).alias("name"), F.lit(4).alias("score"), F.lit(1).alias("mentions"),
             F.lit(True).alias("trusted"))
    called = documents.where(~is_narrative()).select(
        *group, F.explode(all_matches("text", L.CALLED_NAME, 1)).alias("name")
    ).select(*group, clean(F.col("name")).alias("name"), F.lit(3).alias("score"), F.lit(1).alias("mentions"),
             F.lit(True).alias("trusted"))

    tokens = documents.where(has_kind("characters")).select(
        *group, F.explode(all_matches("name", r"[A-Z][a-zÀ-ɏ]{2,}", 0)).alias("t")
    ).select(*group, F.lower("t").alias("t")).distinct()
    gated_groups = tokens.select(*group).distinct().withColumn("gated", F.lit(True))

    told = documents.where(is_narrative())
    mentioned = told.select(*group, F.inline(_counted_mentions(F.col("narrative")))).where(
        (F.col("mentions") >= 2) & (F.col("inner") >= 1)
    )
    # One row per name, read three times below: written once, or each of them would scan the texts.
    candidates = cut_lineage(mentioned.groupBy(*group, "name").agg(
        F.sum(F.col("mentions") * 2 + F.col("inner")).alias("score"), F.sum("mentions").alias("mentions")
    ))
    parts = candidates.select(
        *group, "name", F.size(F.split("name", java(r"\s+"))).alias("n_parts"),
        F.explode(F.split(F.lower("name"), java(r"\s+"))).alias("t"),
    )
    exact = (
        parts.join(tokens, [*group, "t"], "left_semi").groupBy(*group, "name", "n_parts")
        .agg(F.count(F.lit(1)).alias("hit")).where(F.col("hit") == F.col("n_parts")).select(*group, "name")
    )
    prefixes = tokens.select(
        *group, F.explode(F.transform(F.sequence(F.lit(3), F.length("t")),
                                      lambda n: F.substring(F.col("t"), F.lit(1), n))).alias("t")
    ).distinct()
    owners = told.select(
        *group, F.explode(F.array_distinct(F.transform(
            F.regexp_extract_all(F.col("narrative"), F.lit(r"(?<!\w)([A-Za-zÀ-ɏ]++)['’][sS](?!\w)"), F.lit(1)), F.lower
        ))).alias("t")
    ).distinct()
    short = (
        parts.where((F.col("n_parts") == 1) & (F.length("t") >= 3))
        .join(prefixes, [*group, "t"], "left_semi").join(owners, [*group, "t"], "left_semi").select(*group, "name")
    )
    allowed = exact.union(short).distinct().withColumn("known", F.lit(True))
    narrative = (
        candidates.join(gated_groups, group, "left").join(allowed, [*group, "name"], "left")
        .where(F.col("gated").isNull() | F.col("known"))
        .select(*group, clean(F.col("name")).alias("name"), "score", "mentions", F.lit(True).alias("trusted"))
    )
    pooled = (
        labelled_names.unionByName(called).unionByName(narrative)
        .where(matches("name", L.NAME_SHAPE, False))
        .groupBy(*group, "name")
        .agg(F.sum("score").cast("long").alias("score"), F.sum("mentions").cast("long").alias("mentions"))
    )
    from pyspark.sql import Window

    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("mentions"), "name")
    return pooled.withColumn("rank", F.row_number().over(order))


#: Names of a group that findings and pairs go by.
LEADING = 8


def name_lists(names: DataFrame, group: Sequence[str], top: int = LEADING) -> DataFrame:
    """The leading names per group as one array."""
    return names.where(F.col("rank") <= top).groupBy(*group).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]
        ).alias("names")
    )


#: Groups up to which their name lists are broadcast (about 60 MB); beyond, texts meet them through salted keys.
BROADCAST_GROUPS = 200_000


def with_names(texts: DataFrame, names: DataFrame, group: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Texts of groups with names, beside the group's ``names``; texts are not shuffled while the lists are few."""
    lists = name_lists(names, group)
    if lists.count() <= BROADCAST_GROUPS:
        return texts.join(F.broadcast(lists), list(group))
    return salted_lookup(texts, lists, group, key)


#: One by one: Java finds listed low signs in a table, but tries the ranges of a class in turn.
NAME_LOW = "abcdefghijklmnopqrstuvwxyz0123456789_"


def names_in(paragraph: Column, names: Column) -> Column:
    """Which of a short list of names a paragraph mentions.

    Blank-insensitive whole-word containment on a padded, squeezed copy.
    """
    squeezed = F.concat(F.lit(" "), F.regexp_replace(F.lower(paragraph), rf"[^{NAME_LOW}À-ɏ]+", " "), F.lit(" "))
    # Squeezed once per paragraph, then looked up per name.
    return let(
        squeezed, lambda s: F.filter(names, lambda n: F.contains(s, F.concat(F.lit(" "), F.lower(n), F.lit(" "))))
    )


def relationship_pairs(documents: DataFrame, names: DataFrame, group: Sequence[str]) -> DataFrame:
    """Shared and romance paragraphs of every pair of the top eight names.

    At most 28 pairs per paragraph by definition.  The name lists travel to the
    paragraphs, which stay where they are; counts combine map side.
    """
    group = list(group)
    told = narrative_slice(documents.where(is_relationship_evidence()))
    paras = told.select(*group, "doc_id", F.posexplode(T.paragraphs("narrative")).alias("par_no", "p"))
    named = with_names(paras, names, group, ["doc_id", "par_no"])
    held = sealed(
        named, [*group, "p", "names"], [names_in(F.col("p"), F.col("names")).alias("in")]
    ).where(F.size("in") >= 2)
    pairs = F.flatten(
        F.transform(
            "in",
            lambda a, i: F.transform(
                F.slice(F.col("in"), i + 2, F.size("in")), lambda b: F.struct(a.alias("first"), b.alias("second"))
            ),
        )
    )
    romance = (count_matches("p", L.GENRES[0][1]) > 0).cast("long")
    together = matches("p", L.ESTABLISHED)
    # Read once per paragraph, not once per pair of it.
    read = sealed(held, [*group, "in", "names"], [romance.alias("r"), together.alias("t")])
    return (
        read.select(*group, F.inline(pairs), "r", "t", "names")
        .groupBy(*group, "first", "second")
        .agg(F.count(F.lit(1)).alias("shared"), F.sum("r").cast("long").alias("romance"),
             F.bool_or("t").alias("established"),
             F.max(F.array_position("names", F.col("first")) * 100
                   + F.array_position("names", F.col("second"))).alias("pair_order"))
        .withColumn("score", F.col("shared") + F.col("romance") * 2)
    )


def best_pair(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """The strongest pair with shared and romance paragraphs."""
    key = F.struct((-F.col("score")).alias("a"), (-F.col("shared")).alias("b"), F.col("pair_order").alias("c"))
    fields = ["first", "second", "shared", "romance", "established", "score"]
    return (
        pairs.where((F.col("shared") > 0) & (F.col("romance") > 0)).groupBy(*group)
        .agg(F.min_by(F.struct(*fields), key).alias("p"))
        .select(*group, *[F.col(f"p.{f}").alias(f) for f in fields])
    )
