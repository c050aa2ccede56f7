"""Queries: inventory, genre, gates, cost and evidence extraction."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import evidence as E
from ..operators import findings as G
from ..operators import inventory as I
from ..operators import profile
from ..session import cut_lineage
from . import tables as X
from .checks import book as B
from .checks import sql as Q
from .registry import query

LIB, STORY = Q.library_cte(), Q.stories_cte()


# --- inventory --------------------------------------------------------------------


@query("agg14_inventory", f"""WITH {LIB}, k AS (SELECT book_id, unnest(CASE WHEN len(kinds) = 0 THEN ['unclassified'] ELSE kinds END) AS kind,
  {Q.n_words('text')} AS n FROM library) SELECT book_id, kind, count(*) AS documents, CAST(sum(n) AS BIGINT) AS words FROM k GROUP BY ALL""")
def agg14(spark, sf):
    return I.source_inventory(X.library(spark, sf), ["book_id"])


def _genre_ctes() -> str:
    text = "name || chr(10) || text"
    counts = ", ".join(f"sum({Q.hits(text, p)}) AS g_{i}" for i, (_, p, _) in enumerate(L.GENRES))
    long = " UNION ALL ".join(
        f"SELECT book_id, words_read, {i} AS i, {Q.lit(g)} AS genre, g_{i} AS hits FROM gh" for i, (g, _, _) in enumerate(L.GENRES))
    return f"""gh AS (SELECT book_id, CAST(sum({Q.n_words(text)}) AS BIGINT) AS words_read, {counts} FROM library GROUP BY book_id),
gl AS ({long}), gr AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY hits DESC, i) AS r FROM gl WHERE hits > 0),
gt AS (SELECT b.book_id, b.words_read, max(genre) FILTER (r = 1) AS g1, CAST(max(hits) FILTER (r = 1) AS DOUBLE) AS h1,
  CAST(max(hits) FILTER (r = 2) AS DOUBLE) AS h2 FROM gh b LEFT JOIN gr USING (book_id) GROUP BY b.book_id, b.words_read),
genres AS (SELECT book_id, words_read, CASE WHEN h1 >= 2 THEN g1 END AS genre, CASE WHEN h1 >= 2 THEN
  {Q.rnd("least(CAST(0.96 AS DOUBLE), CAST(0.45 AS DOUBLE) + coalesce((h1 - h2) / h1, 0.5) * CAST(0.35 AS DOUBLE) + least(h1 / 20.0, CAST(0.3 AS DOUBLE)))")}
  ELSE 0.2 END AS confidence FROM gt)"""


@query("agg16_genre", f"WITH {LIB}, {_genre_ctes()} SELECT book_id, words_read, coalesce(genre, '') AS genre, confidence FROM genres")
def agg16(spark, sf):
    g = I.rank_genres(I.genre_hits(X.library(spark, sf), ["book_id"]), ["book_id"])
    return g.select("book_id", "words_read", F.coalesce("genre", F.lit("")).alias("genre"), "confidence")


def _sub_sql() -> str:
    text = "(name || chr(10) || text)"
    terms = L.FANTASY_TERMS.split("(?:")[1].split(")")[0].split("|")
    n = " + ".join(f"CAST(bool_or({Q.has(text, chr(92) + 'b' + t + chr(92) + 'b')}) AS INT)" for t in terms)
    rules = " ".join(f"WHEN genre = '{g}' AND r{i} THEN '{name}'" for i, (g, _, name) in enumerate(L.SUBGENRE_RULES))
    flags = ", ".join(f"bool_or({Q.has(text, p)}) AS r{i}" for i, (_, p, _) in enumerate(L.SUBGENRE_RULES))
    return f"""sg AS (SELECT book_id, {n} AS nt, {flags} FROM library GROUP BY book_id),
subs AS (SELECT book_id, genre, CASE WHEN genre = 'Romance' AND nt >= 2 THEN 'Fantasy romance' {rules} END AS subgenre
  FROM sg JOIN genres USING (book_id))"""


@query("agg17_subgenre", f"WITH {LIB}, {_genre_ctes()}, {_sub_sql()} SELECT book_id, coalesce(genre, '') AS genre, "
                         f"coalesce(subgenre, '') AS subgenre FROM subs")
def agg17(spark, sf):
    lib = X.library(spark, sf)
    g = I.rank_genres(I.genre_hits(lib, ["book_id"]), ["book_id"])
    s = I.subgenres(lib, g, ["book_id"])
    return s.select("book_id", F.coalesce("genre", F.lit("")).alias("genre"),
                    F.coalesce("subgenre", F.lit("")).alias("subgenre"))


@query("agg18_length_range", f"""WITH {LIB}, n AS (SELECT book_id, {Q.n_words('text')} AS n FROM library
  WHERE list_has_any(kinds, ['past_book', 'reference_book'])) SELECT book_id, min(n) AS min_words, max(n) AS max_words FROM n
WHERE n >= 1000 GROUP BY book_id""")
def agg18(spark, sf):
    return I.length_range(X.library(spark, sf), ["book_id"]).select("book_id", "min_words", "max_words")


@query("agg19_source_gate", f"""WITH {LIB}, c AS (SELECT *, {Q.n_words('text')} AS n, list_contains(kinds, 'reference_book') AND
    (list_contains(kinds, 'past_book') OR (voice_confirmed AND NOT list_has_any(kinds, {Q.array(L.PLANNING_KINDS)}))) AS v FROM library),
g AS (SELECT book_id, count(*) FILTER (v) AS voice_documents, coalesce(sum(n) FILTER (v), 0) AS vw,
  count(*) FILTER (list_contains(kinds, 'plot')) AS plot_documents, count(*) FILTER (list_contains(kinds, 'past_book')) AS sb FROM c GROUP BY book_id)
SELECT book_id, voice_documents, CAST(vw AS BIGINT) AS voice_words, plot_documents, voice_documents > 0 AND vw >= 2000 AND plot_documents > 0 AS ok,
  voice_documents > 0 AND sb = 0 AS from_reference, CASE WHEN voice_documents = 0 THEN 'no voice source; 2,000 words are needed'
  WHEN vw < 2000 THEN 'voice words: ' || format('{{:,}}', CAST(vw AS BIGINT)) || '; 2,000 are needed'
  ELSE '' END AS style_reason FROM g""")
def agg19(spark, sf):
    catalog = X.library(spark, sf).withColumn("word_count", T.word_count("text"))
    return I.source_gate(catalog, ["book_id"]).select(
        "book_id", "voice_documents", "voice_words", "plot_documents", "ok", "from_reference", "style_reason")


@query("agg20_cost_estimate", f"""WITH c AS (SELECT source AS book_id, {Q.n_words('text')} AS n, doc_id FROM documents WHERE text <> ''),
t AS (SELECT book_id, count(*) FILTER (doc_id % 4 <> 0) AS unfinished, count(n) FILTER (n > 0) AS k, sum(n) AS s FROM c GROUP BY book_id),
e AS (SELECT *, CAST(substr(book_id, 4) AS BIGINT) AS b FROM t),
w AS (SELECT *, greatest(unfinished, 1) AS chapters, CAST(floor(CAST(s AS DOUBLE) / k + 0.5) AS BIGINT) AS words_per_chapter FROM e),
o AS (SELECT *, CAST(ceil(CAST(chapters * words_per_chapter * 3 AS DOUBLE) * CAST(1.33 AS DOUBLE)) AS BIGINT) AS output_tokens FROM w)
SELECT book_id, chapters, words_per_chapter, output_tokens, output_tokens * 2 AS input_tokens,
  CASE WHEN b % 2 = 0 THEN -1.0 ELSE CAST(output_tokens * 2 AS DOUBLE) / CAST(1000000 AS DOUBLE) * (b % 5 + 1) + CAST(output_tokens AS DOUBLE) / CAST(1000000 AS DOUBLE) * ((b % 5 + 1) * 5) END AS total_cost FROM o""")
def agg20(spark, sf):
    d = X.documents(spark, sf).select(F.col("source").alias("book_id"), F.col("doc_id").alias("number"),
                                      T.word_count("text").alias("word_count"))
    status = d.withColumn("status", F.when(F.col("number") % 4 == 0, "approved").otherwise("draft"))
    b = F.substring("book_id", 4, 10).cast("long")
    engines = d.select("book_id").distinct().select(
        "book_id", F.concat(F.lit("m"), (b % 5).cast("string")).alias("model"),
        F.when(b % 2 == 0, "subscription").otherwise("api_key").alias("auth_method"))
    r = F.col("r_regionkey")
    prices = X.given(spark, sf, "region").select(
        F.concat(F.lit("m"), r.cast("string")).alias("model"), (r + 1).cast("double").alias("input_per_mtok"),
        ((r + 1) * 5).cast("double").alias("output_per_mtok"))
    known = d.groupBy("book_id").agg(F.sum("word_count").alias("story_words"), F.count(F.lit(1)).alias("chapter_count"))
    measured = d.select("book_id", F.col("word_count").alias("n_words"))
    out = I.estimate_cost(status, measured, known, engines, prices)
    return out.select("book_id", "chapters", "words_per_chapter", "output_tokens", "input_tokens",
                      F.coalesce("total_cost", F.lit(-1.0)).alias("total_cost"))


# --- evidence ----------------------------------------------------------------------


def _flat(x: str) -> str:
    return Q.trim(Q.sub(Q.sub(x, r"\s+", " "), r"^[-*\d.)\s]+", ""))


def _clean_cte(name: str, source: str, keys: str, raw: str) -> str:
    """CTE with ``v``: the cleaned snippet of ``raw``."""
    kept = ("list_filter(ss, lambda z, i: i = 1 OR list_sum(list_transform(ss[1:i], lambda y: length(y))) + i - 1 <= 300)")
    return f"""{name}0 AS (SELECT {keys}, {_flat(raw)} AS flat FROM {source}),
{name}1 AS (SELECT *, CASE WHEN length(flat) > 300 THEN list_filter({Q.sentences('flat')}, lambda z: {Q.has('z', '[.!?]["' + chr(39) + '”’)]?$', False)})
  END AS ss FROM {name}0),
{name} AS (SELECT {keys}, CASE WHEN length(flat) <= 300 THEN flat ELSE coalesce(nullif(array_to_string({kept}, ' '), ''), flat) END AS v FROM {name}1)"""


_LINES = """ll AS (SELECT book_id, doc_id, ord, name, kinds, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM library)"""
_PLANNING = f"list_has_any(kinds, {Q.array(L.PLANNING_KINDS)})"
_LABELS = " UNION ALL ".join(
    f"SELECT book_id, ord, i, '{k}' AS key, regexp_extract(line, {Q.lit(chr(94) + '[^' + chr(92) + 'n]{0,3}?').replace(chr(94), '(?i)^')[:-1] + Q.re2(p).replace(chr(39), chr(39) * 2) + chr(39)}, 1) AS raw "
    f"FROM ll WHERE regexp_matches(line, {Q.lit('(?i)^[^' + chr(92) + 'n]{0,3}?' + Q.re2(p))}) AND {_PLANNING}"
    for k, p in L.LABELS.items())


@query("int1_labelled_lines", f"""WITH {LIB}, {_LINES}, lb AS ({_LABELS}), {_clean_cte('cl', 'lb', 'book_id, ord, i, key', 'raw')}
SELECT book_id, key, v AS value FROM cl WHERE length(v) >= 12
QUALIFY row_number() OVER (PARTITION BY book_id, key ORDER BY ord, i) = 1""")
def int1(spark, sf):
    lib = X.library(spark, sf).where(E.is_planning())
    per_doc = lib.select("book_id", "ord", F.inline(F.array(*[
        F.struct(F.lit(k).alias("key"), E.labelled(F.col("text"), p).alias("value")) for k, p in L.LABELS.items()])))
    return per_doc.where(F.col("value").isNotNull()).groupBy("book_id", "key").agg(F.min_by("value", "ord").alias("value"))


@query("int2_useful_lines", f"""WITH {LIB}, {_LINES}, {_clean_cte('cl', 'll', 'doc_id, i', 'line')}
SELECT doc_id, arg_min(v, i) AS value FROM cl WHERE length(v) >= 25 AND NOT regexp_matches(v, '^[-*#0-9]') GROUP BY doc_id""")
def int2(spark, sf):
    lib = X.library(spark, sf).select("doc_id", F.inline(F.array(F.struct(E.useful_line(F.col("text")).alias("value")))))
    return lib.where(F.col("value").isNotNull())


def _names(spark, sf):
    return E.character_names(X.library(spark, sf), ["book_id"])


def _context(spark, sf):
    """Findings inputs of every book: documents, names, genres, pooled profile."""
    # Names, pairs and findings all read it: written once to the shared folder.
    lib = cut_lineage(E.narrative_slice(X.library(spark, sf)))
    names = cut_lineage(E.character_names(lib, ["book_id"]))
    # Counts of one row per book, read by findings and by the chain after them.
    genres = I.rank_genres(cut_lineage(I.genre_hits(lib, ["book_id"])), ["book_id"])
    prose = lib.where((F.size("kinds") == 0) | F.arrays_overlap(
        "kinds", F.array(F.lit("past_book"), F.lit("reference_book"), F.lit("notes"))))
    counts = profile.profile_counts(prose, ["book_id"], columns=profile.FINDING_COUNTS)
    # One row per book, read by three readings: written once, or each of them would scan the texts.
    counts = cut_lineage(profile.pooled_counts(counts, ["book_id"]))
    return lib, names, genres, G.profile_for_findings(counts, ["book_id"])


@query("int3_findings")
def int3(spark, sf):
    return G.findings(*_context(spark, sf), ["book_id"])


@query("int4_names")
def int4(spark, sf):
    return _names(spark, sf).select("book_id", "rank", "name", "score", "mentions")


_CAST_NAMES = Q.array(X.CAST)


@query("int5_relationship_pairs", f"""WITH {STORY}, {B.chapter_ctes('stories')},
fc AS (SELECT doc_id, arg_min(ofs, chapter_no) AS st FROM chapters GROUP BY doc_id),
nv AS (SELECT s.book_id, b.doc_id, substr(b.text, CAST(coalesce(st, 0) AS BIGINT) + 1, CAST(length(story) - coalesce(st, 0) AS BIGINT)) AS t
  FROM bounds b JOIN stories s USING (doc_id) LEFT JOIN fc USING (doc_id)),
np AS (SELECT book_id, doc_id, unnest({Q.paragraphs('t')}) AS p, generate_subscripts({Q.paragraphs('t')}, 1) AS n FROM nv),
mn AS (SELECT book_id, doc_id, n, p, unnest({_CAST_NAMES}) AS name, unnest([1, 2, 3, 4]) AS k FROM np),
hit AS (SELECT * FROM mn WHERE regexp_matches(p, '(?i)\\b' || name || '\\b'))
SELECT a.book_id, a.name AS first, b.name AS second, count(*) AS shared,
  CAST(sum(CASE WHEN {Q.has('a.p', L.GENRES[0][1])} THEN 1 ELSE 0 END) AS BIGINT) AS romance
FROM hit a JOIN hit b ON a.book_id = b.book_id AND a.doc_id = b.doc_id AND a.n = b.n AND a.k < b.k GROUP BY ALL""")
def int5(spark, sf):
    stories = X.stories(spark, sf)
    docs = stories.withColumn("kinds", F.array().cast("array<string>"))
    names = stories.select("book_id").distinct().select(
        "book_id", F.posexplode(F.array(*[F.lit(n) for n in X.CAST])).alias("rank", "name"))
    return E.relationship_pairs(docs, names, ["book_id"]).select("book_id", "first", "second", "shared", "romance")


@query("int6_summaries", f"""WITH {LIB}, h AS (SELECT doc_id, {Q.n_words('text')} AS n, list_filter(list_transform(
    string_split_regex(text, '\\r?\\n'), lambda z: {Q.sub(Q.trim('z'), '^#+' + chr(92) + 's*', '')}),
    lambda z: length(z) BETWEEN 3 AND 100 AND ({Q.has('z', L.SUMMARY_HEADING[0])} OR {Q.has('z', L.SUMMARY_HEADING[1])}
      OR {Q.has('z', L.SUMMARY_TITLE, False)})) AS hs FROM library)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, array_to_string(hs, '|') AS headings FROM h""")
def int6(spark, sf):
    s = E.summaries(X.library(spark, sf), ["doc_id"])
    return s.select("doc_id", "n_words", F.array_join("headings", "|").alias("headings"))


# Findings, answers and corrections spread over the documents of each book.
_KEYS = Q.array(L.FINDING_KEYS)
_ANSWERS = ["lengthTarget", "chapterWords", "chapterCount", "prologue", "epilogue", "audience", "spice", "revealPolicy"]
_FOUND = f"""fd AS (SELECT DISTINCT source AS book_id, {_KEYS}[CAST(doc_id // 20 % 13 AS INT) + 1] AS key,
    {_KEYS}[CAST(doc_id // 20 % 13 AS INT) + 1] || ' note' AS value FROM documents WHERE text <> '' AND lang = 'fr'),
an AS (SELECT DISTINCT source AS book_id, {Q.array(_ANSWERS)}[CAST(doc_id // 20 % 8 AS INT) + 1] AS key FROM documents
    WHERE text <> '' AND lang = 'de'),
ed AS (SELECT DISTINCT source AS book_id, {_KEYS}[CAST(doc_id // 20 % 13 AS INT) + 1] AS key,
    CASE WHEN doc_id // 20 % 2 = 0 THEN '' ELSE 'fixed' END AS value FROM documents WHERE text <> '' AND lang = 'es'),
bk AS (SELECT DISTINCT source AS book_id, CAST(substr(source, 4) AS BIGINT) AS b FROM documents WHERE text <> '')"""
_BOOKS = """gn AS (SELECT *, CASE b % 4 WHEN 0 THEN 'Romance' WHEN 1 THEN 'Mystery' WHEN 2 THEN 'Fantasy' END AS genre, b % 3 = 0 AS no_past,
    b % 2 = 0 AS series FROM bk)"""


def _slot(values):
    return F.get(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("doc_id") / F.lit(20)) % len(values)).cast("int"))


def _of_language(spark, sf, lang):
    """Documents of one language: French ones stand for findings, German ones for answers, Spanish ones for corrections."""
    return X.given(spark, sf, "documents").where((F.col("text") != "") & (F.col("lang") == lang))


def _found(spark, sf):
    d = _of_language(spark, sf, "fr")
    return d.select(F.col("source").alias("book_id"), _slot(L.FINDING_KEYS).alias("key")).distinct().select(
        "book_id", "key", F.concat("key", F.lit(" note")).alias("value"), F.lit(0.6).alias("confidence"),
        F.lit("Measured.").alias("evidence"))


def _answers(spark, sf):
    d = _of_language(spark, sf, "de")
    return d.select(F.col("source").alias("book_id"), _slot(_ANSWERS).alias("key")).distinct().withColumn(
        "answer", F.lit("yes"))


def _edits(spark, sf):
    d = _of_language(spark, sf, "es")
    blank = F.floor(F.col("doc_id") / F.lit(20)) % 2 == 0
    return d.select(F.col("source").alias("book_id"), _slot(L.FINDING_KEYS).alias("key"),
                    F.when(blank, "").otherwise("fixed").alias("value")).distinct()


def _state(spark, sf):
    books = X.documents(spark, sf).groupBy(F.col("source").alias("book_id")).agg(F.count(F.lit(1)).alias("documents"))
    b = F.substring("book_id", 4, 10).cast("long")
    books = books.select(
        "book_id", "documents", F.when(b % 2 == 0, "series").otherwise("standalone").alias("shape"),
        F.when(b % 3 == 0, 0).otherwise(1).alias("past_books"), F.lit(None).cast("string").alias("length_range"))
    genres = books.select(
        "book_id", F.when(b % 4 == 0, "Romance").when(b % 4 == 1, "Mystery").when(b % 4 == 2, "Fantasy").alias("genre"),
        F.lit(None).cast("string").alias("subgenre"))
    return G.project_state(books, _found(spark, sf), genres, _answers(spark, sf), ["book_id"])


def _unknown_sql() -> str:
    conditions = {"no_genre": "genre IS NULL", "romance": "coalesce(genre = 'Romance', false)", "no_past": "no_past",
                  "mystery": "coalesce(genre IN ('Mystery', 'Thriller'), false)", "series": "series"}
    rows = []
    for name, finding, answer, condition in G.UNKNOWN_RULES:
        where = [conditions[condition]] if condition else []
        if finding:
            where.append(f"NOT EXISTS (SELECT 1 FROM fd WHERE fd.book_id = gn.book_id AND key = '{finding}')")
        if answer:
            where.append(f"NOT EXISTS (SELECT 1 FROM an WHERE an.book_id = gn.book_id AND key = '{answer}')")
        rows.append(f"SELECT book_id, {Q.lit(name)} AS unknown FROM gn WHERE {' AND '.join(where)}")
    return " UNION ALL ".join(rows)


@query("int7_unknowns", f"WITH {_FOUND}, {_BOOKS} {_unknown_sql()}")
def int7(spark, sf):
    return G.unknowns(_state(spark, sf), ["book_id"]).select("book_id", "unknown")


def _about_sql(key: str, word: str, lower: bool = False) -> str:
    value = f"'{key} note'"
    return (f"CASE WHEN list_contains(f, '{key}') THEN ' ({word}: ' || {'lower(' + value + ')' if lower else value} || ')' ELSE '' END")


def _question_sql() -> str:
    """Every rule in order with its question; findings of this table are all below the firm confidence."""
    genre = "' Genre so far: ' || coalesce(genre, 'unnamed genre') || '.'"
    no = lambda k: f"NOT list_contains(f, '{k}')"
    romance, mystery = "coalesce(genre = 'Romance', false)", "coalesce(genre IN ('Mystery', 'Thriller'), false)"
    rules = [
        ("storyPromise", no("premise"), True, "", "'State the promise of the book to its reader.' || "
         + _about_sql("protagonist", "lead") + " || " + _about_sql("setting", "setting") + " || " + genre),
        ("protagonistArc", "true", True, "", "'Name the lead, the first want and the final change.' || " + _about_sql("protagonist", "candidate")),
        ("relationshipArc", romance, True, "", "'Describe how the couple moves from first page to last, and at what price.' || "
         + _about_sql("relationships", "noted")),
        ("centralConflict", no("centralConflict"), True, "", "'Who or what stands in the way, and what is lost on defeat?' || "
         + _about_sql("protagonist", "lead") + " || " + genre),
        ("settingRules", no("setting"), False, "", "'Give place, period and the rules scenes must obey.'"),
        ("endingAndStructure", no("structure"), True, "", "'Give the ending and any fixed turning points.' || " + genre),
        ("audience", no("audience"), True, "Adult|New adult|Young adult|Middle grade|Children|Other",
         "'Pick the shelf. Genre so far: ' || coalesce(genre, 'unnamed genre') || '.'"),
        ("spice", romance, True, "None|Romantic tension only|Fade to black|Open door|Explicit|Very explicit",
         "'Pick the limit for intimate scenes.' || " + _about_sql("intimacy", "measured", True)),
        ("revealPolicy", mystery, True, "Keep secret|Imply early|Explain progressively|Fully expose in plans",
         "'Pick how openly plans may treat the secret at the core.'"),
        ("seriesPosition", f"series AND {no('structure')}", True, "", "'Which volume is this, and what does it inherit or leave open?'"),
        ("lengthTarget", no("structure"), False, "", "'Give total words and the usual chapter size.'"),
        ("lengthTarget", f"no_past AND NOT {no('structure')}", True, "", "'Give total words.'"),
        ("chapterWords", "no_past", True, "", "'Give words per chapter, one number or a range.'"),
        ("chapterCount", "no_past", True, "", "'Give a rough number of chapters.'"),
        ("prologue", f"no_past AND {no('prologue')}", True, "Yes|No|Undecided", "'Prologue: yes or no, and for what?'"),
        ("epilogue", f"no_past AND {no('epilogue')}", True, "Yes|No|Undecided", "'Epilogue: yes or no, and for what?'"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT book_id, {i} AS i, '{key}' AS key, {question} AS question, '{options}' AS options, {str(blocking).lower()} AS blocking "
        f"FROM x WHERE ({condition}) AND NOT list_contains(a, '{key}')"
        for i, (key, condition, blocking, options, question) in enumerate(rules))
    return f"""has AS (SELECT book_id, list(key) AS ks FROM fd GROUP BY book_id), ans AS (SELECT book_id, list(key) AS ks FROM an GROUP BY book_id),
x AS (SELECT gn.*, coalesce(has.ks, CAST([] AS VARCHAR[])) AS f, coalesce(ans.ks, CAST([] AS VARCHAR[])) AS a
  FROM gn LEFT JOIN has USING (book_id) LEFT JOIN ans USING (book_id)), qs AS ({rows})
SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY i) - 1 AS INTEGER) AS position, key, question, options, blocking FROM qs"""


@query("int8_question_plan", f"WITH {_FOUND}, {_BOOKS}, {_question_sql()}")
def int8(spark, sf):
    return G.question_plan(_state(spark, sf), ["book_id"]).select(
        "book_id", "position", "key", "question", F.array_join("options", "|").alias("options"), "blocking")


@query("int9_pending_questions", f"""WITH {_FOUND}, {_BOOKS}, has AS (SELECT book_id, list(key) AS ks FROM fd GROUP BY book_id),
ans AS (SELECT book_id, list(key) AS ks FROM an GROUP BY book_id),
x AS (SELECT gn.*, coalesce(has.ks, CAST([] AS VARCHAR[])) AS f, coalesce(ans.ks, CAST([] AS VARCHAR[])) AS a FROM gn LEFT JOIN has USING (book_id) LEFT JOIN ans USING (book_id)),
pl AS (""" + " UNION ALL ".join(f"SELECT book_id, '{k}' AS key FROM x WHERE {c}" for k, c in [
    ("storyPromise", "NOT list_contains(f, 'premise')"), ("protagonistArc", "true"),
    ("relationshipArc", "genre = 'Romance'"), ("centralConflict", "NOT list_contains(f, 'centralConflict')"),
    ("settingRules", "NOT list_contains(f, 'setting')"), ("endingAndStructure", "NOT list_contains(f, 'structure')"),
    ("audience", "NOT list_contains(f, 'audience')"), ("spice", "genre = 'Romance'"), ("revealPolicy", "genre = 'Mystery'"),
    ("seriesPosition", "series AND NOT list_contains(f, 'structure')"),
    ("lengthTarget", "no_past OR NOT list_contains(f, 'structure')"), ("chapterWords", "no_past"), ("chapterCount", "no_past"),
    ("prologue", "no_past AND NOT list_contains(f, 'prologue')"), ("epilogue", "no_past AND NOT list_contains(f, 'epilogue')"),
]) + """) SELECT pl.book_id, pl.key FROM pl LEFT JOIN an ON an.book_id = pl.book_id AND an.key = pl.key
WHERE an.key IS NULL AND NOT (pl.key = 'settingRules' AND CAST(substr(pl.book_id, 4) AS BIGINT) % 2 = 1)""")
def int9(spark, sf):
    state = _state(spark, sf)
    asked = state.where(F.substring("book_id", 4, 10).cast("long") % 2 == 1).select(
        "book_id", F.lit("settingRules").alias("key"))
    plan = G.question_plan(state, ["book_id"])
    return G.pending_questions(plan, _answers(spark, sf), asked, ["book_id"]).select("book_id", "key")


@query("int9_blocking_questions", """SELECT source AS book_id, 'q' || doc_id AS key FROM documents
WHERE text <> '' AND lang = 'en' AND n_chars <= 2000""")
def int9_blocking(spark, sf):
    docs = X.given(spark, sf, "documents").where(F.col("text") != "")
    asked = docs.select(
        F.col("source").alias("book_id"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("key"),
        (F.col("lang") == "en").alias("blocking"), F.when(F.col("n_chars") > 2000, "done").alias("answer"))
    return G.blocking_questions(asked).select("book_id", "key")


@query("int10_corrections", f"""WITH {_FOUND}, e1 AS (SELECT book_id, key, max(value) AS edit FROM ed GROUP BY ALL),
m AS (SELECT coalesce(fd.book_id, e1.book_id) AS book_id, coalesce(fd.key, e1.key) AS key, value, edit FROM fd FULL JOIN e1
  ON fd.book_id = e1.book_id AND fd.key = e1.key)
SELECT book_id, key, CASE WHEN edit IS NOT NULL THEN edit ELSE value END AS value, edit IS NOT NULL AS edited,
  CASE WHEN edit IS NOT NULL THEN 1.0 ELSE 0.6 END AS confidence FROM m WHERE edit IS NULL OR edit <> ''""")
def int10(spark, sf):
    edits = _edits(spark, sf).groupBy("book_id", "key").agg(F.max("value").alias("value"))
    return G.apply_edits(_found(spark, sf), edits, ["book_id"]).select("book_id", "key", "value", "edited", "confidence")


_MERGED = """e1 AS (SELECT book_id, key, max(value) AS edit FROM ed GROUP BY ALL),
mg AS (SELECT coalesce(fd.book_id, e1.book_id) AS book_id, coalesce(fd.key, e1.key) AS key FROM fd FULL JOIN e1
  ON fd.book_id = e1.book_id AND fd.key = e1.key WHERE edit IS NULL OR edit <> ''),
ge AS (SELECT book_id, CASE WHEN b % 6 < 2 THEN '' ELSE 'Romance' END AS edit FROM gn WHERE b % 2 = 0),
g2 AS (SELECT gn.* EXCLUDE (genre), CASE WHEN edit IS NULL THEN genre ELSE nullif(edit, '') END AS genre, edit IS NOT NULL AS edited
  FROM gn LEFT JOIN ge USING (book_id))"""


def _genre_edits(spark, sf):
    """Series are corrected: some lose their genre, the others become romances."""
    b = F.col("b")
    return X.documents(spark, sf).select(F.col("source").alias("book_id")).distinct().withColumn(
        "b", F.substring("book_id", 4, 10).cast("long")).where(b % 2 == 0).select(
        "book_id", F.lit("genre").alias("key"), F.when(b % 6 < 2, "").otherwise("Romance").alias("value"))


@query("int10_genre_corrections", f"""WITH {_FOUND}, {_BOOKS}, {_MERGED} SELECT book_id, coalesce(genre, '') AS genre,
  CASE WHEN edited THEN 1.0 ELSE 0.5 END AS confidence FROM g2""")
def int10_genres(spark, sf):
    genres = _state(spark, sf).select("book_id", "genre", F.lit(0.5).alias("confidence"))
    fixed = G.apply_genre_edits(genres, _genre_edits(spark, sf), ["book_id"])
    return fixed.select("book_id", F.coalesce("genre", F.lit("")).alias("genre"), "confidence")


@query("int10_gaps_after_corrections", f"WITH {_FOUND}, {_BOOKS}, {_MERGED} "
       + _unknown_sql().replace("FROM gn", "FROM g2").replace("gn.", "g2.").replace("FROM fd WHERE fd.", "FROM mg WHERE mg."))
def int10_gaps(spark, sf):
    edits = _edits(spark, sf).groupBy("book_id", "key").agg(F.max("value").alias("value"))
    found = G.apply_edits(_found(spark, sf), edits, ["book_id"])
    state = _state(spark, sf)
    genres = G.apply_genre_edits(
        state.select("book_id", "genre", F.lit(0.5).alias("confidence")), _genre_edits(spark, sf), ["book_id"])
    books = state.select("book_id", "documents", "shape", "past_books", "length_range")
    fixed = G.project_state(
        books, found, genres.withColumn("subgenre", F.lit(None).cast("string")), _answers(spark, sf), ["book_id"])
    return G.unknowns(fixed, ["book_id"]).select("book_id", "unknown")


# The chain on measured findings: no SQL states the findings themselves.
@query("int10_chain_on_findings")
def int10_chain(spark, sf):
    """Questions still open after the measured findings of every book are corrected and fill the intake."""
    lib, names, genres, profiles = _context(spark, sf)
    found = cut_lineage(G.findings(lib, names, genres, profiles, ["book_id"]))
    edits = _edits(spark, sf).groupBy("book_id", "key").agg(F.max("value").alias("value"))
    fixed = cut_lineage(G.apply_edits(found, edits, ["book_id"]))
    intake = G.prefill(_answers(spark, sf), fixed, edits, ["book_id"])
    books = lib.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.array_contains("kinds", "past_book")).alias("past_books"))
    books = books.select("book_id", "documents", "past_books", F.lit("standalone").alias("shape"), F.lit(None).cast("string").alias("length_range"))
    state = G.project_state(books, fixed, genres.select("book_id", "genre", F.lit(None).cast("string").alias("subgenre")), intake, ["book_id"])
    return G.question_plan(state, ["book_id"]).select("book_id", "position", "key", "question", "blocking")


@query("int10_prefill", f"""WITH {_FOUND}, ms AS (SELECT book_id, CASE key WHEN 'audience' THEN 'audience' ELSE 'spice' END AS key, value
  FROM fd WHERE key IN ('audience', 'intimacy'))
SELECT coalesce(an.book_id, ms.book_id) AS book_id, coalesce(an.key, ms.key) AS key, CASE WHEN an.key IS NOT NULL THEN 'yes' ELSE value END AS answer
FROM an FULL JOIN ms ON an.book_id = ms.book_id AND an.key = ms.key""")
def int10_prefill(spark, sf):
    none = _edits(spark, sf).where(F.col("key") == "no such key")
    return G.prefill(_answers(spark, sf), _found(spark, sf), none, ["book_id"])


@query("int11_suggestions")
def int11(spark, sf):
    # Lengths ride along with the counts, so the passages are cut once.
    sample = X.passages(spark, sf).withColumn("sample_chars", F.length("text") + 2)
    counts = profile.profile_counts(sample, ["book_id", "sample_chars"], columns=profile.FINDING_COUNTS)
    # One row per book, read by four suggestions: written once.
    counts = cut_lineage(profile.pooled_counts(counts, ["book_id"], ["sample_chars"]))
    own = X.library(spark, sf).groupBy("book_id").agg(
        F.count_if(F.array_contains("kinds", "past_book")).alias("n_books"))
    return G.suggestions(own, counts, ["book_id"])


@query("int12_narrative_slice", f"""WITH {STORY}, {B.chapter_ctes('stories')}, fc AS (SELECT doc_id, arg_min(ofs, chapter_no) AS st FROM chapters GROUP BY doc_id)
SELECT b.doc_id, substr(b.text, CAST(coalesce(st, 0) AS BIGINT) + 1, CAST(length(story) - coalesce(st, 0) AS BIGINT)) AS narrative
FROM bounds b LEFT JOIN fc USING (doc_id)""")
def int12(spark, sf):
    docs = X.stories(spark, sf).withColumn("kinds", F.array().cast("array<string>"))
    return E.narrative_slice(docs).select("doc_id", "narrative")



