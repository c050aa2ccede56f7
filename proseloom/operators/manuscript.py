"""Manuscript structure: chapters, epilogue, back matter, ending, conventions.

One narrow pass per document: lines with offsets live in an array, and chapters,
boundaries and conventions are read from it, so no line ever leaves its row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.patterns import java
from ..functions.scalar import (
    all_matches,
    any_match,
    count_matches,
    let,
    matches,
    ranked_values,
    ratio,
    replace_all,
    rows,
    sealed,
    trim,
    trim_end,
)

WORKING = ["_lines", "_heads", "_main_lines", "_bm", "_ep", "_story", "_main"]


def is_heading(line: Column, isolated: Column | bool = False) -> Column:
    """Chapter-like line; an all-caps line only counts when it stands alone."""
    caps = F.lit(isolated) if isinstance(isolated, bool) else isolated
    return let(trim(line), lambda t: (
        (t != "") & (F.length(t) <= 90)
        & (any_match(t, L.HEADING_PATTERNS) | (matches(t, L.CAPS_HEADING, False) & caps))
    ))


def is_scene_break(line: Column) -> Column:
    return let(trim(line), lambda t: (t != "") & (F.length(t) <= 12) & matches(t, L.SCENE_BREAK, False))


def strip_trailing_layout(text: Column) -> Column:
    """Page-break rules at the end are layout, not prose."""

    def cut(c: Column) -> Column:
        # The rule pattern can only hit a text that ends in three equal marks.
        return F.when(F.right(c, F.lit(3)).isin(L.TRAILING_MARKS), trim_end(replace_all(c, L.TRAILING_RULES, ""))).otherwise(c)

    return let(trim_end(replace_all(text, L.LAYOUT_CHARS, "\n")), cut)


def _heading_rows(lines: Column) -> Column:
    """Heading lines of ``array<struct<line, at>>`` that are not scene breaks."""

    def heading(x: Column, i: Column) -> Column:
        before = trim(F.coalesce(F.get(lines, i - 1)["line"], F.lit("")))
        after = trim(F.coalesce(F.get(lines, i + 1)["line"], F.lit("")))
        alone = ((before == "") | matches(before, L.DIVIDER, False)) & (after == "")
        return is_heading(x["line"], alone) & ~is_scene_break(x["line"])

    return F.transform(
        F.filter(lines, heading), lambda x: F.struct(x["at"].alias("at"), trim(x["line"]).alias("heading"))
    )


def _cut(lines: Column, end: Column) -> Column:
    """Lines of a prefix of the text."""
    # The end is worked out once, not per line.
    return let(end, lambda stop: F.transform(
        F.filter(lines, lambda x: x["at"] < stop),
        lambda x: F.struct(F.substring(x["line"], F.lit(1), stop - x["at"]).alias("line"), x["at"].alias("at")),
    ))


def _back_matter(text: Column, lines: Column) -> Column:
    """Struct ``(at, heading)`` of what follows the story, or null."""
    def title(x: Column, threshold: Column) -> Column:
        t = trim(x["line"])
        return (x["at"] >= threshold) & (t != "") & (F.length(t) <= 90) & any_match(t, L.BACK_MATTER_HEADINGS)

    # The length of the text is worked out once, not per line.
    limit = F.length(text).cast("double") * F.lit(L.BACK_MATTER_AFTER)
    by_title = F.get(
        F.transform(
            let(limit, lambda threshold: F.filter(lines, lambda x: title(x, threshold))),
            lambda x: F.struct(x["at"].alias("at"), trim(x["line"]).alias("heading")),
        ),
        0,
    )

    def first_hit(chunk: Column) -> Column:
        spots = [
            F.nullif(F.regexp_instr(chunk["text"], F.lit(java(p, True))), F.lit(0)) for p, _ in L.BACK_MATTER_CONTENT
        ]
        return F.array_min(F.array(*spots)) - 1

    located = F.transform(
        T.chunks_with_offsets(text),
        lambda c: F.struct(c["char_offset"].alias("start"), (c["char_offset"] + first_hit(c)).alias("hit")),
    )

    def edge(threshold: Column) -> Column:
        return let(
            F.get(F.filter(located, lambda x: x["hit"] >= threshold), 0),
            lambda c: F.when(c["start"] >= threshold, c["start"]).otherwise(c["hit"]),
        )

    boundary = let(limit, edge)

    def named(at: Column) -> Column:
        line = F.substring(trim(F.get(F.split(F.substring(text, at + 1, F.length(text)), r"[.!?\n]"), 0)), 1, 90)
        return F.when(
            at.isNotNull(),
            F.struct(at.alias("at"), F.when(line == "", "Closing material").otherwise(line).alias("heading")),
        )

    lowered = let(
        F.lower(text), lambda c: reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in L.BACK_MATTER_PIECES])
    )
    by_content = F.when(lowered, let(boundary, named))
    return F.coalesce(by_title, by_content)


def with_boundaries(df: DataFrame, text: str = "text") -> DataFrame:
    """Add lines, back matter, epilogue, story and main-story columns."""
    t = F.col(text)
    out = df.withColumn("_lines", T.with_line_offsets(T.lines(text)))
    out = out.withColumn("_bm", _back_matter(t, F.col("_lines")))
    out = out.withColumn("story_end", F.coalesce(F.col("_bm.at"), F.length(t)))
    out = out.withColumn("_story", F.substring(t, F.lit(1), F.col("story_end")))
    epilogue = F.filter(
        _cut(F.col("_lines"), F.col("story_end")),
        lambda x: matches(x["line"], L.EPILOGUE_HEADING) & is_heading(x["line"]),
    )
    out = out.withColumn(
        "_ep",
        F.get(F.transform(epilogue, lambda x: F.struct(x["at"].alias("at"), trim(x["line"]).alias("heading"))), 0),
    )
    main = F.when(F.col("_ep").isNull(), F.col("_story")).otherwise(
        trim_end(F.substring(F.col("_story"), F.lit(1), F.col("_ep.at")))
    )
    out = out.withColumn("_main", main)
    out = out.withColumn("_main_lines", _cut(F.col("_lines"), F.length("_main")))
    return out.withColumn("_heads", _heading_rows(F.col("_main_lines")))


def _section_starts() -> Column:
    opening = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("heading"))
    return F.concat(F.array(opening), F.col("_heads"))


def _section(s: Column, i: Column, stop: Column) -> Column:
    """Words of a section and whether it is the last; it ends at the next heading or at the story's end."""
    return F.struct(
        s["at"].alias("at"), s["heading"].alias("heading"),
        T.word_count(
            F.substring(F.col("_main"), s["at"] + 1, F.coalesce(F.get(F.col("_heads"), i)["at"], stop) - s["at"])
        ).alias("n"),
        (i == F.size("_heads")).alias("last"),
    )


def _real(s: Column) -> Column:
    return (s["n"] > 0) & (s["heading"].isNotNull() | (s["n"] > 20) | s["last"])


def story_start() -> Column:
    """Where the first of the kept sections begins; the words of sections after it are not counted."""
    none = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("i"))

    def step(acc: Column, s: Column, stop: Column) -> Column:
        own = let(_section(s, acc["i"], stop), lambda x: F.when(_real(x), x["at"]))
        return F.struct(
            F.when(acc["at"].isNotNull(), acc["at"]).otherwise(own).alias("at"), (acc["i"] + 1).alias("i"))

    return let(F.length("_main"), lambda stop: F.aggregate(
        _section_starts(), none, lambda acc, s: step(acc, s, stop), lambda acc: acc["at"]))


def _chapters() -> Column:
    """Kept sections as ``array<struct<chapter_no, heading, n_words, at>>``."""
    sections = let(F.length("_main"), lambda stop: F.transform(_section_starts(), lambda s, i: _section(s, i, stop)))
    real = F.filter(sections, _real)
    kept = F.filter(
        real,
        lambda s, i: (i == 0) | (s["n"] >= 20) | F.coalesce(matches(s["heading"], L.EXPLICIT_HEADING), F.lit(False)),
    )
    return F.transform(
        kept,
        lambda s, i: F.struct(
            (i + 1).cast("long").alias("chapter_no"),
            F.coalesce(s["heading"], F.concat(F.lit("Untitled section "), (i + 1).cast("string"))).alias("heading"),
            s["n"].alias("n_words"),
            s["at"].cast("long").alias("at"),
        ),
    )


def with_chapters(df: DataFrame, text: str = "text") -> DataFrame:
    return with_boundaries(df, text).withColumn("chapters", _chapters())


def chapters(df: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Chapter rows ``(key, chapter_no, heading, n_words, at)``."""
    return with_chapters(df.select(*key, text), text).select(*key, F.inline(rows("chapters")))


def _last_word(text: Column) -> Column:
    """The last word of a text, from its end; the whole text is read only if the end does not show where it begins."""
    ending = rf"({L.WORD})[^a-zÀ-ɏ]*\z"
    near = F.regexp_extract(F.lower(F.right(text, F.lit(120))), rf"(?<=[^a-zÀ-ɏ']){ending}", 1)
    return let(near, lambda w: F.when(w != "", w).otherwise(F.regexp_extract(F.lower(text), ending, 1)))


def _completeness() -> Column:
    """Struct ``(complete, why)``: does the story stop at an ending?"""

    def judge(body: Column) -> Column:
        last_char = F.substring(body, -1, 1)
        last_word = let(body, _last_word)
        others = F.sort_array(
            F.transform(F.slice("chapters", 1, F.greatest(F.size("chapters") - 1, F.lit(0))), lambda c: c["n_words"])
        )
        median = F.get(others, F.floor(F.size(others) / F.lit(2)).cast("int"))
        last = F.element_at("chapters", -1)["n_words"]
        short = (F.size("chapters") >= 3) & (median > 0) & (last.cast("double") < median * F.lit(0.35))
        return (
            F.when(body == "", F.struct(F.lit(True).alias("complete"), F.lit("empty").alias("why")))
            .when(
                ~F.contains(F.lit(L.TERMINAL_CHARS), last_char),
                F.struct(F.lit(False).alias("complete"), F.lit("no closing punctuation").alias("why")),
            )
            .when(
                last_word.isin(L.DANGLING_WORDS),
                F.struct(F.lit(False).alias("complete"), F.concat(F.lit("ends on "), last_word).alias("why")),
            )
            .when(
                F.coalesce(short, F.lit(False)),
                F.struct(F.lit(False).alias("complete"), F.lit("short final section").alias("why")),
            )
            .otherwise(F.struct(F.lit(True).alias("complete"), F.lit("complete sentence").alias("why")))
        )

    return let(strip_trailing_layout(F.col("_main")), judge)


def tail(text: Column, target_words: int = 400) -> Column:
    """Whole closing paragraphs, from the end until the word target is met."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("out"))
    kept = F.aggregate(
        F.reverse(T.paragraphs(strip_trailing_layout(text))),
        start,
        lambda acc, p: F.when(acc["n"] >= target_words, acc).otherwise(
            F.struct((acc["n"] + T.word_count(p)).alias("n"), F.array_append(acc["out"], p).alias("out"))
        ),
        lambda acc: F.reverse(acc["out"]),
    )
    return F.array_join(kept, "\n\n")


def convention_columns() -> dict[str, Column]:
    """Layout conventions read from the main story."""
    heading = F.get(F.col("_heads"), 0)["heading"]
    bare = replace_all(heading, r"^#+\s*", "")
    case = (
        F.when(heading.isNull(), F.lit(None).cast("string"))
        .when((bare == F.upper(bare)) & matches(bare, r"[A-Z]", False), "upper")
        .when(matches(bare, r"^[A-Z][a-z]", False), "title")
        .otherwise("other")
    )
    breaks = F.filter(F.transform("_main_lines", lambda x: trim(x["line"])), is_scene_break)
    curly = count_matches("_main", "[“”]", False)
    straight = count_matches("_main", '"', False)
    em = count_matches("_main", "—", False)
    double = count_matches("_main", r"(?<!-)--(?!-)", False)
    spaced = count_matches("_main", " – ", False)
    long_lines = F.filter("_main_lines", lambda x: F.length(trim(x["line"])) > 40)
    indented = F.size(F.filter(long_lines, lambda x: x["line"].rlike(r"^[ \t]{2,}|^\t")))
    return {
        "heading_example": heading,
        "heading_case": case,
        "scene_break": F.get(let(breaks, ranked_values), 0),
        "quotes": F.when((curly == 0) & (straight == 0), "none")
        .when(curly > straight * 3, "curly")
        .when(straight > curly * 3, "straight")
        .otherwise("mixed"),
        "dashes": F.when((em == 0) & (double == 0) & (spaced == 0), "none")
        .when((em >= double) & (em >= spaced), "em")
        .when(double >= spaced, "double-hyphen")
        .otherwise("spaced-en"),
        "indented": (F.size(long_lines) > 0) & (ratio(indented, F.size(long_lines)) > 0.4),
    }


def _registry(text: str) -> dict[str, Column]:
    """Every column of a manuscript row, from the columns of :func:`with_chapters` and ``_done``."""
    rest = lambda at: T.word_count(F.substring(F.col(text), at + 1, F.length(text)))
    return {
        "total_words": T.word_count(text),
        "story_words": T.word_count("_story"),
        "story_end": F.col("story_end").cast("long"),
        "back_matter_at": F.col("_bm.at").cast("long"),
        "back_matter_heading": F.col("_bm.heading"),
        "back_matter_words": F.when(F.col("_bm").isNotNull(), rest(F.col("_bm.at"))),
        "epilogue_at": F.col("_ep.at").cast("long"),
        "epilogue_heading": F.col("_ep.heading"),
        "epilogue_words": F.when(
            F.col("_ep").isNotNull(),
            T.word_count(F.substring(F.col("_story"), F.col("_ep.at") + 1, F.length("_story"))),
        ),
        "chapters": F.col("chapters"),
        "complete": F.col("_done.complete"),
        "complete_why": F.col("_done.why"),
        "tail": tail(F.col("_main")),
        **convention_columns(),
    }


def manuscripts(
    df: DataFrame, key: Sequence[str], text: str = "text", columns: Sequence[str] | None = None
) -> DataFrame:
    """One summary row per manuscript, chapters nested.

    Only the asked ``columns`` are planned, with what they depend on; all
    without a choice.
    """
    full = with_chapters(df.select(*key, text), text).withColumn("_done", _completeness())
    known = _registry(text)
    return sealed(full, key, [known[c].alias(c) for c in columns or known])


def section_kind(heading: Column) -> Column:
    return (
        F.when(matches(heading, r"^\s*#{0,3}\s*prologue\b"), "prologue")
        .when(matches(heading, r"^\s*#{0,3}\s*chapter\b"), "chapter")
        .otherwise("section")
    )


def sections(df: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Text of each story section, up to the next one or the end of the story."""
    full = with_chapters(df.select(*key, text), text)
    named = F.filter("chapters", lambda c: matches(c["heading"], L.STORY_HEADING))
    end = F.coalesce(F.col("_ep.at"), F.col("_bm.at"), F.col("story_end"))
    full = full.withColumn("_named", named).select(
        *key,
        F.posexplode(
            F.transform(
                "_named",
                lambda c, i: F.struct(
                    c["chapter_no"].alias("chapter_no"), c["heading"].alias("heading"), c["at"].alias("at"),
                    F.coalesce(F.get(F.col("_named"), i + 1)["at"], end.cast("long")).alias("stop"),
                ),
            )
        ).alias("section_no", "s"),
        text,
    )
    body = F.substring(F.col(text), F.col("s.at").cast("int") + 1, (F.col("s.stop") - F.col("s.at")).cast("int"))
    return full.select(
        *key, (F.col("section_no") + 1).cast("long").alias("section_no"), "s.chapter_no", "s.heading",
        section_kind(F.col("s.heading")).alias("kind"), trim(body).alias("markdown"),
    )


def merge_continuations(books: DataFrame, additions: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Insert continuation prose before the epilogue or back matter.

    ``additions`` has one row per key with ``addition``; blank additions leave
    the text alone.
    """
    full = with_boundaries(books.select(*key, text), text).join(additions, list(key), "left")
    clean = trim(F.coalesce("addition", F.lit("")))
    at = F.coalesce(F.least("_ep.at", "_bm.at"), F.length(text))
    before = F.substring(F.col(text), F.lit(1), at)
    after = F.substring(F.col(text), at + 1, F.length(text))
    head = F.when((before == "") | matches(before, r"\n\s*$", False), before).otherwise(F.concat(before, F.lit("\n\n")))
    rest = F.when((after == "") | matches(after, r"^\s*\n", False), after).otherwise(F.concat(F.lit("\n\n"), after))
    merged = F.when(clean == "", F.col(text)).otherwise(F.concat(head, clean, rest))
    return full.select(*key, merged.alias("text"))


def next_chapters(chapter_status: DataFrame, manuscripts_table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Next chapter to write: first unapproved, else after the last one."""
    planned = chapter_status.groupBy(*key).agg(
        F.min(F.when(F.col("status") != "approved", F.col("number"))).alias("planned")
    )
    known = manuscripts_table.select(*key, "complete", F.size("chapters").cast("long").alias("n_chapters"))
    return planned.join(known, list(key), "full").select(
        *key,
        F.coalesce(
            "planned", F.when(F.col("complete"), F.col("n_chapters") + 1).otherwise(F.col("n_chapters"))
        ).cast("long").alias("next_chapter"),
    )


def document_stats(manuscripts_table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Story words, chapter count and words per chapter of each document."""
    return manuscripts_table.select(
        *key, "story_words", F.size("chapters").cast("long").alias("chapter_count"),
        F.transform("chapters", lambda c: c["n_words"]).alias("words_per_chapter"),
    )


def heading_count(text: Column | str) -> Column:
    return F.size(all_matches(text, L.CHAPTER_HEADING, 0, True, True)).cast("long")
