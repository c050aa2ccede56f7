"""Domain tables derived by Spark from the given parquet tables.

The given texts hold no quotes, headings or planning documents, so manuscripts
are derived from them line by line: every input line becomes one paragraph of
speech, narration or action around a fixed cast.  Derivation is a narrow
projection over the whole table; its size grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalar import trim
from ..sources.scan import spread_small_scan

CAST = ["Anna", "Marcus Vale", "Ilse", "Tobias"]
GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def given(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, source, text)`` over every core."""
    return spread_small_scan(given(spark, sf_dir, "documents", "doc_id", "source", "text"))


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in CAST]), F.pmod(index, F.lit(len(CAST))).cast("int"))


def story_text(text: Column, doc_id: Column) -> Column:
    """A manuscript made of the document's own lines."""

    def paragraph(raw: Column, i: Column) -> Column:
        line = trim(raw)
        who, other = _name(doc_id + i), _name(doc_id + i + 1)
        body = (
            F.when(i % 5 == 1, _cat('"', line, '," ', who, " said."))
            .when(i % 5 == 2, _cat(who, ' whispered, "', line, '" They thought about ', other,
                                   " and it was like a silence."))
            .when(i % 5 == 3, _cat(line, " Later that night ", who, " ran and grabbed the cold sword; ", who,
                                   "'s heart didn't stop."))
            .when(i % 5 == 4, _cat(line, "\n\n* * *\n\nThe room was quiet when ", who, " kissed ", other,
                                   " and they were together."))
            .otherwise(line)
        )
        heading = F.when(i % 6 == 0, _cat("Chapter ", F.floor(i / F.lit(6)).cast("string"), "\n\n")).otherwise("")
        return F.concat(heading, body)

    body = F.array_join(F.transform(F.split(text, "\n"), paragraph), "\n\n")
    ending = (
        F.when(doc_id % 5 == 1, "\n\nEpilogue\n\nAfter the war Anna went home and slept for a day.")
        .when(doc_id % 5 == 2, "\n\nAcknowledgements\n\nTo everyone who helped.")
        .when(doc_id % 5 == 3, "\n\nAs an independent author I hope you leave an honest review. Goodbye.")
        .when(doc_id % 5 == 4, " They waited and")
        .otherwise("\n\n***\n")
    )
    return F.concat(body, ending)


def _sheet(text: Column, doc_id: Column) -> Column:
    """Planning documents: cast sheet, outline, timeline, world notes."""
    lines = F.split(text, "\n")
    numbered = lambda f: F.array_join(F.transform(lines, lambda x, i: f(trim(x), i)), "\n")
    who = _name(doc_id)
    cast = _cat("Name: ", who, "\nProtagonist: ", who, " wants the throne back before winter.\nAge: 30\n",
                numbered(lambda x, i: _cat("Trait ", i.cast("string"), ": ", x)))
    outline = _cat("Premise: A thief must steal one heart before dawn.\nEnding: The city burns and ", who,
                   " walks away.\n", numbered(lambda x, i: _cat("- ", x)))
    dates = numbered(lambda x, i: _cat("Day ", (i + 1).cast("string"), ": ", x))
    world = _cat("# The world\n\nSetting: A drowned kingdom called Vell, ruled by a guild.\n\n",
                 numbered(lambda x, i: F.when(i % 3 == 0, _cat("## ", x)).otherwise(x)))
    kind = doc_id % 8
    return F.when(kind == 4, cast).when(kind == 5, outline).when(kind == 6, dates).otherwise(world)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source catalog: ``book_id, doc_id, ord, name, path, mime, text, kinds, voice_confirmed``."""
    docs = documents(spark, sf_dir)
    labels = given(spark, sf_dir, "labels", "doc_id", "quality")
    d, kind = F.col("doc_id"), F.col("doc_id") % 8
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), kind.cast("int"))
    number = d.cast("string")
    kinds = F.when(kind == 0, F.array(F.lit("past_book"), F.lit("reference_book"))).when(
        kind == 1, F.array(F.lit("past_book"))
    ).when(kind == 2, F.array(F.lit("reference_book"))).when(kind == 3, F.array().cast("array<string>")).otherwise(
        F.array(pick(["", "", "", "", "characters", "plot", "timeline", "world"]))
    )
    # One label per document at most; size decides the join strategy at run time.
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("book_id"), "doc_id", d.alias("ord"),
        F.when(kind == 4, "Anna Vale").otherwise(
            F.concat(pick(["Book ", "Draft novel ", "Reference study ", "Chapter file ", "", "Outline plan ",
                           "Timeline ", "World notes "]), number, F.lit(".md"))).alias("name"),
        F.concat(F.lit("/project/"), pick(["books", "drafts", "misc", "inbox", "characters", "plot", "history", "lore"]),
                 F.lit("/"), number).alias("path"),
        F.when(d % 9 == 0, "text/plain").otherwise("text/markdown").alias("mime"),
        F.when(kind < 4, story_text(F.col("text"), d)).otherwise(_sheet(F.col("text"), d)).alias("text"),
        kinds.alias("kinds"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("voice_confirmed"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a manuscript ``(book_id, doc_id, text)``."""
    d = F.col("doc_id")
    return documents(spark, sf_dir).select(
        F.col("source").alias("book_id"), "doc_id", story_text(F.col("text"), d).alias("text")
    )


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene briefs from the benchmark items, one corpus each."""
    from ..functions.lexicons import BEATS

    b = F.col("item_id")
    return given(spark, sf_dir, "benchmark").select(
        b.alias("brief_id"), F.concat(F.lit("src"), (b % 20).cast("string")).alias("book_id"),
        F.get(F.array(*[F.lit(x) for x in BEATS]), (b % 5).cast("int")).alias("beat"),
        F.when(b % 3 == 0, F.array(F.lit("Ilse"), F.lit("tobias"))).otherwise(F.array().cast("array<string>")).alias(
            "characters"),
        F.col("text").alias("summary"), F.lit("quiet").alias("register"), (b % 7 + 2).cast("int").alias("k"),
        F.lit(1200).alias("max_words"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the stories with beat and speakers."""
    from ..operators import structure as S

    cut = S.passages(stories(spark, sf_dir), ["book_id", "doc_id"])
    return cut.select(
        "book_id", F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("source"), "passage_no",
        F.concat_ws("-", "doc_id", "passage_no").alias("passage_id"), "text", "n_words",
        S.beat("text", F.col("n_words")).alias("beat"), S.speakers("text").alias("speakers"),
    )


# --- continuity ------------------------------------------------------------------


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chapters of a book."""
    turns = given(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("book_id"), (F.col("turn") + 1).alias("chapter"),
        F.concat(F.col("role"), F.lit(" met Guide. "), F.col("text")).alias("text"),
    )


def handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handoffs derived from the words of each turn; some chapters arrive twice."""
    turns = given(spark, sf_dir, "conversations").withColumn("w", T.words("text"))
    chapter = (F.col("turn") + 1).cast("int")
    word = lambda i: F.coalesce(F.get("w", i), F.lit("nowhere"))
    last = F.coalesce(F.try_element_at("w", F.lit(-1)), F.lit("nothing"))

    def person(name: Column, place: Column, knows: Column) -> Column:
        return F.struct(
            name.alias("name"), place.alias("location"), knows.alias("knows"),
            F.when(F.col("turn") % 2 == 0, last).otherwise("").alias("condition"), word(1).alias("emotional_state"),
            F.array(F.lit("Guide")).alias("with_characters"), chapter.alias("last_seen_chapter"),
        )

    people = F.array(
        person(F.col("role"), word(0), F.array(F.concat_ws(" ", word(1), word(2)))),
        person(F.lit("Guide"), word(2), F.array(word(3), word(5))),
        person(F.lit("user"), word(4), F.array(word(3))),
    )
    first = turns.select(
        F.col("conv_id").alias("book_id"), (F.col("turn") + 1).alias("chapter"),
        F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("title"), word(0).alias("ends_at_location"),
        F.struct(
            chapter.alias("chapter"),
            F.concat(F.lit("Day "), (F.col("turn") * 3 % 5 + 1).cast("string"), F.lit(", dusk")).alias("ends_at"),
            F.lit("an hour").alias("elapsed"), (F.col("turn") % 4 == 3).alias("is_flashback"),
        ).alias("timeline"),
        people.alias("characters"), word(2).alias("closing_beat"),
        F.array_join(F.slice("w", 1, 8), " ").alias("open_question"),
        (F.col("turn") * 2 + 1).alias("arrival_seq"),
    )
    # An earlier version of every third chapter, to be replaced.
    older = first.where(F.col("chapter") % 3 == 0).withColumns(
        {"arrival_seq": F.col("arrival_seq") - 1, "title": F.lit("stale"), "ends_at_location": F.lit("attic")}
    )
    return first.unionByName(older)


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = given(spark, sf_dir, "conversations").where(F.col("turn") % 2 == 0)
    t = F.col("turn")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    return turns.select(
        F.col("conv_id").alias("book_id"), F.concat_ws("-", "conv_id", "turn").alias("thread_id"),
        F.array_join(F.slice(T.words("text"), 1, 8), " ").alias("question"), (t + 1).cast("int").alias("opened_chapter"),
        (t + 1).cast("int").alias("last_touched_chapter"),
        pick(["open", "advanced", "open", "resolved", "abandoned"], (t + F.col("conv_id")) % 5).alias("status"),
        F.when(F.col("conv_id") % 3 == 0, (t + 2).cast("int")).alias("must_resolve_by"),
        pick(["main", "subplot", "minor"], (t + F.col("conv_id")) % 3).alias("weight"),
    )


def promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = given(spark, sf_dir, "conversations").where(F.col("turn") % 3 == 0)
    t = F.col("turn")
    return turns.select(
        F.col("conv_id").alias("book_id"), F.concat_ws("-", "conv_id", "turn").alias("promise_id"),
        F.array_join(F.slice(T.words("text"), 1, 5), " ").alias("setup"), (t + 1).cast("int").alias("planted_chapter"),
        F.when(F.col("conv_id") % 2 == 0, (t + 2).cast("int")).alias("paid_off_chapter"),
    )


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = given(spark, sf_dir, "conversations", "conv_id", "turn")
    return turns.groupBy(F.col("conv_id").alias("book_id")).agg((F.max("turn") + 1).alias("planned_chapters")).select(
        "book_id", F.when(F.col("book_id") % 2 == 0, "series").otherwise("standalone").alias("shape"),
        "planned_chapters",
        F.array(F.concat(F.lit("Canon of "), F.col("book_id").cast("string")), F.lit("The gate stays shut")).alias(
            "inherited_canon"),
    )


# --- run events ---------------------------------------------------------------------


def event_columns(events: DataFrame) -> DataFrame:
    """Given events as run events; works on a batch table and on a stream."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", _cat("Reading chapter-", k.cast("string"), " plan outline.md"))
        .when(kind == "click", F.when(k % 3 == 0, "Searching the workspace.").otherwise("Delegating to the editor"))
        .when(kind == "purchase", F.when(k % 2 == 0, "result done: true").otherwise("token = abc123 validation passed"))
        .when(kind == "error", F.when(k % 3 == 0, "Error 429 rate limit").when(k % 3 == 1, "API error 503").otherwise(
            "\x1b[31mFailed\x1b[0m step"))
        .otherwise(_cat("RUN_PROGRESS phase=writing_chapter percent=", F.floor("value").cast("string"), " chapter=",
                        (k % 12 + 1).cast("string"), " detail=Drafting"))
    )
    return events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"),
        F.when(kind == "view", "step").when(kind == "purchase", "system").when(kind == "error", "error")
        .otherwise("note").alias("kind"),
        text.alias("text"),
        F.when(k % 4 != 0, F.concat(F.lit("s"), (k % 4).cast("string"))).alias("session_id"),
        F.when(k % 4 == 1, "Editor").when(k % 4 == 2, "Subagent").alias("agent"),
        (k % 4).cast("int").alias("depth"),
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small_scan(event_columns(given(spark, sf_dir, "events")))


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = given(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return e.where(F.col("event_type") == "error").select(
        F.col("user_id").alias("book_id"), F.col("event_id").alias("entry_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.lit("run_error").alias("event"),
        F.when(F.col("value") > 30, "settings.json is not valid JSON").otherwise("tool failed").alias("error_message"),
        F.when(F.col("event_id") % 7 == 0, "2024-01-01T00:00:00").alias("resolved_at"),
        F.when(F.col("event_id") % 7 == 0, "earlier fix").alias("resolution"),
    )
