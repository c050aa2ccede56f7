"""Texts are scanned once for what several lists or readers ask of them."""

import pytest
from pyspark.sql import functions as F

from proseloom.functions import lexicons as L
from proseloom.functions import patterns as P
from proseloom.functions.scalar import count_each, count_matches
from proseloom.operators import evidence, findings
from proseloom.plans import queries_project


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_java_space_is_the_same_set(spark):
    signs = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000] + ["\U0001f600"]
    found = spark.createDataFrame([(c,) for c in signs], "c string").where(F.col("c").rlike(P.JAVA_SPACE))
    assert sorted(r.c for r in found.collect()) == sorted(P.TRIM_CHARS)


TEXTS = [
    "Love, loved LOVING kiss_ed kissed; a dead body, the Dead-Body and dead\nbody. éloved lovers' lovely",
    "king-kingdom twenty-one TWENTY TWO twentythree coffee shop shop|coffee wwii war.war wars demon demons_",
    "The high school sophomore was seventeen; fade to black. Nineteenth century, city life, cities.", "", None,
    "She thought it was a ten-year-old's realisation: shit, SHITTY, unshit; blood-bloody murder",
]


@pytest.mark.parametrize("patterns", [
    [p for _, p, _ in L.GENRES], [p for _, ps, _ in L.AUDIENCES for p in ps] + [L.FADE, L.ROMANCE_SIGNALS, L.EXPLICIT_SIGNALS],
    [*L.SENSORY.values(), L.SIMILE, L.EMOTION_WORDS, L.INTERIORITY], [L.PAST_MARKERS, L.PRESENT_MARKERS, L.NARRATED_THOUGHT],
    [r"\b(?:dead body|body|dead)\b", r"\b(?:war|wars)\b", r"\b(?:war)\w*\b"],
])
def test_counts_of_many_lists_equal_single_counts(spark, patterns):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    named = {f"p{i}": p for i, p in enumerate(patterns)}
    together = count_each("t", named, lambda c: F.struct(*[n.alias(k) for k, n in c.items()]))
    alone = F.struct(*[count_matches("t", p).alias(k) for k, p in named.items()])
    for row in df.select("t", together.alias("a"), alone.alias("b")).collect():
        assert tuple(row.a) == tuple(row.b), row.t


STORY = (
    "Chapter 1\n\nThe rain fell when Anna kissed Marcus Vale. Then Anna left and Marcus Vale ran.\n\n"
    "Later Anna's heart and Marcus Vale were in love, a couple: ANNA,  marcus-vale! A dragon, magic and a spell."
)


def library(spark):
    rows = [
        ("b", 1, 1, "Book", STORY, ["past_book"]), ("b", 2, 2, "Other", "\n\n".join([STORY] * 3), []),
        ("b", 3, 3, "Anna Vale", "Name: Anna\nProtagonist: Anna leads.\nMarcus's personal arc. A girl called Anna", ["characters"]),
        ("b", 4, 4, "Plot", "The misleading lead follows Marcus Vale", ["plot"]), ("b", 5, 5, "Empty", None, ["plot"]),
    ]
    return spark.createDataFrame(
        rows, "book_id string, doc_id long, ord long, name string, text string, kinds array<string>")


def test_names_read_stories_once(spark):
    names = evidence.character_names(library(spark), ["book_id"])
    assert "[A-Z][a-zÀ-ɏ]{2,}(?:" not in plan(names)
    assert [r.name for r in names.orderBy("rank").collect()][:1] == ["Anna"]


def test_pairs_and_lead_signals(spark):
    lib = library(spark)
    names = spark.createDataFrame([("b", 1, "Anna"), ("b", 2, "Marcus Vale"), ("b", 3, "Tobias")], "book_id string, rank int, name string")
    pairs = [tuple(r) for r in evidence.relationship_pairs(lib, names, ["book_id"]).select(
        "first", "second", "shared", "romance", "established").collect()]
    assert pairs == [("Anna", "Marcus Vale", 8, 8, True)]
    [row] = findings.lead_signals(lib, names, ["book_id"]).collect()
    assert row.lead.asDict() == {"name": "Anna", "lead": True, "signals": 1} and row.any_called


def test_story_begins_at_the_first_kept_section(spark):
    text = "Short note\n\nChapter 1\n\n" + "one two three " * 9 + "\n\nChapter 2\n\nmore words here"
    rows = [(1, text, ["past_book"]), (2, text, ["notes"]), (3, "Plain text.", []), (4, None, [])]
    lib = spark.createDataFrame(rows, "doc_id long, text string, kinds array<string>")
    told = {r.doc_id: r.narrative for r in evidence.narrative_slice(lib).collect()}
    assert told == {1: text[text.index("Chapter 1"):], 2: text, 3: "Plain text.", 4: None}


def test_context_leaves_no_scan_of_texts_to_its_readers(spark, tmp_path):
    docs = [(i, f"{STORY}\n{STORY}", "en", "src1") for i in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    _, names, genres, profiles = queries_project._context(spark, str(tmp_path))
    for read in (names, genres, profiles):
        assert "regexp" not in plan(read).lower()
    assert genres.first().genre == "Fantasy"
