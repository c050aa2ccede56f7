"""Queries: source classification, manuscript structure, retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scalar import rows
from ..operators import classify, corpus, formatting, manuscript, retrieve
from ..session import shared_dir
from . import tables as X
from .checks import book as B
from .checks import sql as Q
from .registry import query

LIB, STORY = Q.library_cte(), Q.stories_cte()
CLS = f"{LIB}, {B.classify_ctes()}"


# --- classification --------------------------------------------------------------


def _signals_query(name: str, first: int, last: int):
    check = (f"WITH {LIB}, {B.feature_ctes()}, {B.signal_ctes()} SELECT doc_id, kind, weight FROM sig "
             f"WHERE n BETWEEN {first} AND {last}")

    def run(spark, sf):
        lib = X.library(spark, sf)
        full = classify.features(lib)
        parts = [*classify.name_signals(F.col("name"), F.col("path")), *classify.structure_signals(F.col("name")),
                 *classify.vocabulary_signals(F.col("text"))][first:last + 1]
        return full.select("doc_id", F.inline(F.array_compact(F.array(*parts)))).select("doc_id", "kind", "weight")

    query(name, check)(run)


_N = len(L.NAME_SIGNALS) + len(L.PATH_SIGNALS)
_signals_query("cls1_name_signals", 0, _N - 1)
_signals_query("cls2_structure_signals", _N, _N + 10)
_signals_query("cls3_vocabulary_signals", _N + 11, _N + 15)


def _classified(spark, sf):
    return classify.classify(X.library(spark, sf), ["book_id", "doc_id"])


@query("cls4_classification",
       f"WITH {CLS} SELECT doc_id, kind, confidence, coalesce(alternative, '') AS alternative FROM cls")
def cls4(spark, sf):
    return _classified(spark, sf).select(
        "doc_id", "kind", "confidence", F.coalesce("alternative", F.lit("")).alias("alternative"))


@query("cls4_reasons")
def cls4_reasons(spark, sf):
    return _classified(spark, sf).select("doc_id", "kind", F.array_join("reasons", "; ").alias("reasons"))


@query("cls5_suggested_kinds", f"WITH {CLS} SELECT doc_id, suggested FROM cls")
def cls5(spark, sf):
    return _classified(spark, sf).select("doc_id", F.array_join("suggested", "|").alias("suggested"))


@query("cls6_groups", f"""WITH {CLS} SELECT k.kind, count(c.doc_id) AS documents,
  count(c.doc_id) FILTER (confidence < 0.6) AS needs_review FROM kinds k LEFT JOIN cls c USING (kind) GROUP BY k.kind""")
def cls6(spark, sf):
    return classify.group_sizes(_classified(spark, sf))


@query("cls6_review_queue", f"WITH {CLS} SELECT doc_id, kind, confidence FROM cls WHERE confidence < 0.6")
def cls6_queue(spark, sf):
    return classify.review_queue(_classified(spark, sf)).select("doc_id", "kind", "confidence")


_PLAN = Q.array(L.PLANNING_KINDS)


@query("cls7_voice_reference", f"""WITH {LIB} SELECT doc_id, list_contains(kinds, 'reference_book') AND
  (list_contains(kinds, 'past_book') OR (voice_confirmed AND NOT list_has_any(kinds, {_PLAN}))) AS is_voice FROM library""")
def cls7(spark, sf):
    return X.library(spark, sf).select(
        "doc_id", classify.is_voice_reference(F.col("kinds"), F.col("voice_confirmed")).alias("is_voice"))


@query("cls8_roles", f"""WITH {CLS} SELECT doc_id, CASE WHEN kind = 'past_book' THEN suggested ||
  CASE WHEN list_contains(string_split(suggested, '|'), 'reference_book') THEN '' ELSE '|reference_book' END ELSE suggested END AS kinds
  FROM cls""")
def cls8(spark, sf):
    return _classified(spark, sf).select(
        "doc_id", F.array_join(classify.expand_kinds(F.col("kind"), F.col("suggested")), "|").alias("kinds"))


@query("cls8_corrections", f"""WITH {LIB}, n AS (SELECT doc_id, kinds, voice_confirmed AS vc, list_contains(kinds, 'past_book') AS hb,
    list_contains(kinds, 'reference_book') AS hv, CASE WHEN doc_id % 3 = 0 THEN ['past_book'] WHEN doc_id % 3 = 1 THEN ['notes'] END AS nk
    FROM library),
m AS (SELECT *, CASE WHEN nk IS NULL THEN kinds WHEN (list_contains(nk, 'past_book') OR hb) THEN list_append(nk, 'reference_book')
    ELSE nk END AS k2 FROM n)
SELECT doc_id, array_to_string(k2, '|') AS kinds, CASE WHEN nk IS NULL THEN CAST(vc AS VARCHAR)
  WHEN NOT list_contains(k2, 'reference_book') THEN '' WHEN NOT list_contains(nk, 'past_book') AND (NOT hv OR hb) THEN 'true'
  ELSE CAST(vc AS VARCHAR) END AS confirmed FROM m""")
def cls8_corrections(spark, sf):
    lib = X.library(spark, sf)
    fixes = lib.where(F.col("doc_id") % 3 != 2).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("past_book"))).otherwise(
            F.array(F.lit("notes"))).alias("new_kinds"))
    out = classify.correct_kinds(lib.select("doc_id", "kinds", "voice_confirmed"), fixes, ["doc_id"])
    return out.select("doc_id", F.array_join("kinds", "|").alias("kinds"),
                      F.coalesce(F.col("voice_confirmed").cast("string"), F.lit("")).alias("confirmed"))


@query("cls9_series_order", """SELECT doc_id, array_to_string(list_filter([doc_id + 2, doc_id, doc_id + 9], lambda x: x % 2 = doc_id % 2), ',')
  || ',' || (doc_id + 4) AS ordered FROM documents""")
def cls9(spark, sf):
    d = F.col("doc_id")
    ids = X.documents(spark, sf).select(
        d, F.array(d + 2, d, d + 9).alias("requested"), F.array(d, d + 2, d + 4).alias("valid"))
    return ids.select("doc_id", F.array_join(
        F.transform(classify.series_order(F.col("requested"), F.col("valid")), lambda x: x.cast("string")), ","
    ).alias("ordered"))


# --- manuscript structure -------------------------------------------------------------

CH = f"{STORY}, {B.chapter_ctes('stories')}"


def _manuscripts(spark, sf, *columns):
    return manuscript.manuscripts(X.stories(spark, sf), ["book_id", "doc_id"], columns=columns or None)


@query("man1_chapters", f"WITH {CH} SELECT doc_id, chapter_no, heading, CAST(n_words AS BIGINT) AS n_words, "
                        f"CAST(ofs AS BIGINT) AS char_offset FROM chapters")
def man1(spark, sf):
    return manuscript.chapters(X.stories(spark, sf), ["doc_id"]).withColumnRenamed("at", "char_offset")


@query("man2_epilogue", f"WITH {CH} SELECT doc_id, CAST(ep_at AS BIGINT) AS epilogue_at, ep_heading AS epilogue_heading, "
                        f"CAST({Q.n_words('substr(story, CAST(ep_at AS BIGINT) + 1)')} AS BIGINT) AS epilogue_words "
                        f"FROM bounds WHERE ep_at IS NOT NULL")
def man2(spark, sf):
    columns = ("epilogue_at", "epilogue_heading", "epilogue_words")
    return _manuscripts(spark, sf, *columns).where(F.col("epilogue_at").isNotNull()).select("doc_id", *columns)


@query("man3_back_matter", f"WITH {CH} SELECT doc_id, CAST(bm_at AS BIGINT) AS back_matter_at, bm_heading AS "
                           f"back_matter_heading, CAST({Q.n_words('substr(text, CAST(bm_at AS BIGINT) + 1)')} AS BIGINT) "
                           f"AS back_matter_words FROM bounds WHERE bm_at IS NOT NULL")
def man3(spark, sf):
    columns = ("back_matter_at", "back_matter_heading", "back_matter_words")
    return _manuscripts(spark, sf, *columns).where(F.col("back_matter_at").isNotNull()).select("doc_id", *columns)


@query("man4_completeness", f"WITH {CH}, {B.completeness_ctes()} SELECT doc_id, complete, why FROM done")
def man4(spark, sf):
    m = _manuscripts(spark, sf, "complete", "complete_why")
    return m.select("doc_id", "complete", F.col("complete_why").alias("why"))


@query("man5_tail", f"""WITH {CH}, tp AS (SELECT doc_id, unnest({Q.paragraphs(B.stripped('main'))}) AS p,
    generate_subscripts({Q.paragraphs(B.stripped('main'))}, 1) AS i FROM bounds),
tw AS (SELECT doc_id, i, p, coalesce(sum({Q.n_words('p')}) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS before FROM tp)
SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS tail FROM tw WHERE before < 400 GROUP BY doc_id""")
def man5(spark, sf):
    return _manuscripts(spark, sf, "tail").select("doc_id", "tail").where(F.col("tail") != "")


_NULLS = "coalesce({0}, '') AS {0}".format


@query("man6_conventions", f"""WITH {CH}, {B.convention_ctes()} SELECT doc_id, {_NULLS('heading_example')}, {_NULLS('heading_case')},
  {_NULLS('scene_break')}, quotes, dashes, indented FROM conv""")
def man6(spark, sf):
    m = _manuscripts(spark, sf, "heading_example", "heading_case", "scene_break", "quotes", "dashes", "indented")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return m.select("doc_id", *[blank(c) for c in ("heading_example", "heading_case", "scene_break")], "quotes",
                    "dashes", "indented")


@query("man7_merge", f"""WITH {CH}, mg AS (SELECT doc_id, text, CAST(coalesce(least(ep_at, bm_at), length(text)) AS BIGINT) AS ofs FROM bounds),
sp AS (SELECT doc_id, left(text, ofs) AS b, substr(text, ofs + 1) AS a FROM mg)
SELECT doc_id, CASE WHEN b = '' OR {Q.has('b', chr(92) + 'n' + chr(92) + 's*$', False)} THEN b ELSE b || chr(10) || chr(10) END
  || 'A new page ' || doc_id || CASE WHEN a = '' OR {Q.has('a', '^' + chr(92) + 's*' + chr(92) + 'n', False)} THEN a
  ELSE chr(10) || chr(10) || a END AS text FROM sp""")
def man7(spark, sf):
    books = X.stories(spark, sf).select("doc_id", "text")
    added = books.select("doc_id", F.concat(F.lit(" A new page "), "doc_id").alias("addition"))
    return manuscript.merge_continuations(books, added, ["doc_id"])


@query("man8_next_chapter", f"""WITH {CH}, {B.completeness_ctes()}, k AS (SELECT doc_id, count(*) AS n FROM chapters GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.doc_id % 2 = 0 AND n > 1 THEN 2 WHEN complete THEN n + 1 ELSE n END AS BIGINT) AS next_chapter
FROM done d JOIN k USING (doc_id)""")
def man8(spark, sf):
    m = _manuscripts(spark, sf, "chapters", "complete")
    status = m.select("doc_id", F.inline(rows("chapters"))).select(
        "doc_id", F.col("chapter_no").alias("number"),
        F.when((F.col("doc_id") % 2 == 0) & (F.col("chapter_no") > 1), "draft").otherwise("approved").alias("status"))
    return manuscript.next_chapters(status, m, ["doc_id"])


@query("man9_sections", f"""WITH {CH}, nm AS (SELECT c.*, lead(ofs) OVER (PARTITION BY c.doc_id ORDER BY chapter_no) AS nxt,
    row_number() OVER (PARTITION BY c.doc_id ORDER BY chapter_no) AS section_no FROM chapters c WHERE {Q.has('heading', L.STORY_HEADING)})
SELECT n.doc_id, section_no, chapter_no, heading, CASE WHEN {Q.has('heading', '^#{0,3}prologue')} THEN 'prologue'
    WHEN {Q.has('heading', '^#{0,3} *chapter')} THEN 'chapter' ELSE 'section' END AS kind,
  {Q.trim("substr(text, CAST(ofs AS BIGINT) + 1, CAST(coalesce(nxt, ep_at, bm_at, length(text)) - ofs AS BIGINT))")} AS markdown
FROM nm n JOIN bounds USING (doc_id)""")
def man9(spark, sf):
    return manuscript.sections(X.stories(spark, sf), ["doc_id"])


@query("agg13_formatting_gate", f"""WITH {STORY}, ch AS (SELECT book_id, doc_id AS chapter, text FROM stories),
o AS (SELECT book_id, chapter, {Q.hits('text', L.FORMAT_DIALOGUE, False)} AS d, {Q.hits('text', L.FORMAT_BOLD_DIALOGUE, False)} AS b FROM ch)
SELECT book_id, chapter, chapter % 2 = 0 AS needs_bold_dialogue, book_id IN (SELECT book_id FROM ch WHERE chapter % 31 = 0)
  AS needs_italic_thoughts, NOT (chapter % 2 = 0 AND d > 0 AND b < d) AND NOT (book_id IN (SELECT book_id FROM ch WHERE chapter % 31 = 0))
  AS follows FROM o""")
def agg13(spark, sf):
    chapters = X.stories(spark, sf).withColumnRenamed("doc_id", "chapter")
    c = F.col("chapter")
    asked = chapters.where(c % 2 == 0).select(
        "book_id", F.lit("chapter").alias("scope"), "chapter", F.lit("Use bold for all dialogue").alias("text"))
    whole = chapters.where(c % 31 == 0).select(
        "book_id", F.lit("book").alias("scope"), F.lit(None).cast("long").alias("chapter"),
        F.lit("Italic thoughts please").alias("text"))
    return formatting.gate(chapters, asked.unionByName(whole))


@query("agg15_document_stats", f"""WITH {CH} SELECT b.doc_id, CAST({Q.n_words('any_value(story)')} AS BIGINT) AS story_words,
  count(chapter_no) AS chapter_count, coalesce(string_agg(CAST(n_words AS VARCHAR), ',' ORDER BY chapter_no), '') AS words_per_chapter
FROM bounds b LEFT JOIN chapters c USING (doc_id) GROUP BY b.doc_id""")
def agg15(spark, sf):
    s = manuscript.document_stats(_manuscripts(spark, sf, "story_words", "chapters"), ["doc_id"])
    return s.select("doc_id", "story_words", "chapter_count", F.array_join(
        F.transform("words_per_chapter", lambda x: x.cast("string")), ",").alias("words_per_chapter"))


@query("src7_document_stats", f"""WITH {CH} SELECT st.book_id, b.doc_id, CAST({Q.n_words('any_value(story)')} AS BIGINT) AS story_words,
  count(chapter_no) AS chapter_count, coalesce(string_agg(CAST(n_words AS VARCHAR), ',' ORDER BY chapter_no), '') AS words_per_chapter
FROM bounds b JOIN stories st USING (doc_id) LEFT JOIN chapters c USING (doc_id) GROUP BY st.book_id, b.doc_id""")
def src7_stats(spark, sf):
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    corpus.build(X.stories(spark, sf), root, ["document_stats"])
    counts = F.array_join(F.transform("words_per_chapter", lambda x: x.cast("string")), ",")
    return corpus.read(spark, root, "document_stats").select(
        "book_id", "doc_id", "story_words", "chapter_count", counts.alias("words_per_chapter"))


# --- retrieval ------------------------------------------------------------------------------

# Passages for the checked pairs are the paragraphs of the stories.
_STOP = Q.listed(L.BRIEF_STOP_WORDS)
_BEATS = Q.array(L.BEATS)


def _paragraph_passages(spark, sf):
    from ..operators import structure as S

    p = S.paragraphs(X.stories(spark, sf), ["book_id", "doc_id"])
    return p.select(
        "book_id", F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("source"),
        F.col("par_no").alias("passage_no"), F.concat_ws("-", "doc_id", "par_no").alias("passage_id"), "text", "n_words",
        S.beat("text", F.col("n_words")).alias("beat"), S.speakers("text").alias("speakers"))


def _retrieval_ctes(passages: bool = False) -> str:
    """Scored pairs over paragraphs, or over passages with WITH RECURSIVE."""
    from .queries_text import _FOLD, _PAR, _beat_cte, _speaker_sql

    if passages:
        cut = f"{_FOLD}, pb AS (SELECT doc_id, passage_no AS par_no, book_id, text FROM psg)"
    else:
        cut = f"{_PAR}, pb AS (SELECT p.doc_id, p.par_no, s.book_id, p.text FROM par p JOIN stories s USING (doc_id))"

    near = " OR ".join(f"(p.beat = '{a}' AND b.beat IN {Q.listed(n)})" for a, n in L.ADJACENT_BEATS.items())
    return f"""{STORY}, {cut},
{_beat_cte('pb', 'book_id, doc_id, par_no, text').replace('text, text,', 'text,').replace('n, sp, CAST', 'n, sp, CAST')},
sp0 AS (SELECT doc_id, par_no, {_speaker_sql('text')} AS xs FROM pb),
sp1 AS (SELECT doc_id, par_no, unnest(xs) AS name, generate_subscripts(xs, 1) AS i FROM sp0),
sp2 AS (SELECT doc_id, par_no, name, count(*) AS c, min(i) AS f FROM sp1 GROUP BY ALL),
sp3 AS (SELECT doc_id, par_no, name, row_number() OVER (PARTITION BY doc_id, par_no ORDER BY c DESC, f) AS rk FROM sp2),
spk AS (SELECT doc_id, par_no, list(name ORDER BY rk) AS speakers FROM sp3 GROUP BY ALL),
pas AS (SELECT b.book_id, b.doc_id, b.par_no, b.n_words, b.beat, coalesce(speakers, CAST([] AS VARCHAR[])) AS speakers,
  list_distinct(regexp_extract_all(lower(text), '{L.PASSAGE_TERM}')) AS terms FROM beats b LEFT JOIN spk USING (doc_id, par_no)),
br AS (SELECT item_id AS brief_id, 'src' || (item_id % 20) AS book_id, {_BEATS}[CAST(item_id % 5 AS INT) + 1] AS beat,
  CASE WHEN item_id % 3 = 0 THEN ['ilse', 'tobias'] ELSE CAST([] AS VARCHAR[]) END AS wanted, item_id % 7 + 2 AS k,
  list_distinct(list_filter(list_append({Q.words('text')}, 'quiet'), lambda z: length(z) > 3 AND z NOT IN {_STOP})) AS terms FROM benchmark),
pr0 AS (SELECT b.brief_id, b.k, p.doc_id, p.par_no, p.n_words, len(list_intersect(b.terms, p.terms)) AS ov,
  len(list_filter(p.speakers, lambda z: list_contains(b.wanted, lower(z)))) AS mt,
  len(p.speakers) AS ns, len(b.wanted) AS nw, p.speakers, b.wanted, b.beat AS bb, p.beat AS pbt,
  CASE WHEN p.beat = b.beat THEN 5.0 WHEN {near} THEN 1.5 ELSE 0.0 END AS sb FROM br b JOIN pas p USING (book_id)),
pr AS (SELECT *, {Q.rnd("sb + CASE WHEN mt > 0 THEN 3.0 * mt WHEN nw > 0 AND ns = 0 AND bb <> 'dialogue' THEN 0.5 ELSE 0 END + least(ov, 6) * 0.75 + CASE WHEN n_words BETWEEN 80 AND 260 THEN 1 WHEN n_words < 40 THEN -1 ELSE 0 END")} AS score
  FROM pr0)"""


@query("ret1_matched_pairs", f"""WITH {_retrieval_ctes()} SELECT brief_id, doc_id || '-' || par_no AS passage_id,
  CAST(ov AS BIGINT) AS overlap, CAST(score AS DOUBLE) AS score FROM pr WHERE ov > 0 OR mt > 0""")
def ret1(spark, sf):
    pairs = retrieve.matched_pairs(X.briefs(spark, sf), _paragraph_passages(spark, sf))
    return pairs.select("brief_id", "passage_id", "overlap", "score")


# What a brief's greedy choice can reach: fewer than k better ones need no more words, or its source
# and fewer than k sources are among those.
_REACH = """it AS (SELECT * FROM pr WHERE score > 0 AND n_words <= 1200),
rc AS (SELECT a.brief_id, a.doc_id, a.par_no, a.n_words, a.score, a.k, count(b.doc_id) AS better, count(DISTINCT b.doc_id) AS sources,
    count_if(b.doc_id = a.doc_id) AS own
  FROM it a LEFT JOIN it b ON b.brief_id = a.brief_id AND b.n_words <= a.n_words
    AND (b.score > a.score OR (b.score = a.score AND (b.doc_id, b.par_no) < (a.doc_id, a.par_no)))
  GROUP BY ALL),
reach AS (SELECT * FROM rc WHERE better < k OR (own = 0 AND sources < k))"""


@query("ret1_reachable", f"""WITH {_retrieval_ctes()}, {_REACH} SELECT brief_id, doc_id || '-' || par_no AS passage_id, n_words,
  CAST(score AS DOUBLE) AS score FROM reach""")
def ret1_reachable(spark, sf):
    reach = retrieve.reachable(X.briefs(spark, sf), _paragraph_passages(spark, sf))
    return reach.select("brief_id", "passage_id", F.col("n_words").cast("long").alias("n_words"), "score")


@query("ret2_ranked", f"""WITH {_retrieval_ctes()} SELECT brief_id, doc_id || '-' || par_no AS passage_id, CAST(score AS DOUBLE) AS score,
  row_number() OVER (PARTITION BY brief_id ORDER BY score DESC, doc_id, par_no) AS rank FROM pr WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY brief_id ORDER BY score DESC, doc_id, par_no) <= k""")
def ret2(spark, sf):
    reach = retrieve.reachable(X.briefs(spark, sf), _paragraph_passages(spark, sf))
    # The k best of each brief; k is the brief's own.
    return retrieve.rank(reach).where(F.col("rank") <= F.col("b_k")).select("brief_id", "passage_id", "score", F.col("rank").cast("long").alias("rank"))


# One step per candidate and pass: the first pass takes a source once, the second fills up.
_CHOICE = f"""{_REACH},
li AS (SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY score DESC, doc_id, par_no) AS n,
    count(*) OVER (PARTITION BY brief_id) AS m FROM reach),
pick AS (
  SELECT brief_id, k, m, CAST(0 AS BIGINT) AS step, CAST(1200 AS BIGINT) AS left_words, CAST([] AS BIGINT[]) AS docs,
    CAST([] AS VARCHAR[]) AS taken FROM li WHERE n = 1
  UNION ALL
  SELECT brief_id, k, m, step + 1, CASE WHEN ok THEN left_words - n_words ELSE left_words END,
    CASE WHEN ok THEN list_append(docs, doc_id) ELSE docs END, CASE WHEN ok THEN list_append(taken, id) ELSE taken END
  FROM (SELECT p.*, l.n_words, l.doc_id, l.doc_id || '-' || l.par_no AS id, len(taken) < p.k AND l.n_words <= left_words
        AND NOT CASE WHEN step < p.m THEN list_contains(docs, l.doc_id) ELSE list_contains(taken, l.doc_id || '-' || l.par_no) END AS ok
        FROM pick p JOIN li l ON l.brief_id = p.brief_id AND l.n = step % p.m + 1 WHERE step < 2 * p.m)),
last AS (SELECT brief_id, taken FROM pick WHERE step = 2 * m),
chosen AS (SELECT brief_id, CAST(pos AS BIGINT) AS position, taken[pos] AS passage_id
  FROM (SELECT *, unnest(range(1, len(taken) + 1)) AS pos FROM last))"""


@query("ret3_exemplars", f"""WITH RECURSIVE {_retrieval_ctes(True)}, {_CHOICE}
SELECT c.brief_id, position, c.passage_id, CAST(l.doc_id AS VARCHAR) AS source, l.n_words, CAST(l.score AS DOUBLE) AS score
FROM chosen c JOIN li l ON l.brief_id = c.brief_id AND l.doc_id || '-' || l.par_no = c.passage_id""")
def ret3(spark, sf):
    chosen = retrieve.select_exemplars(X.briefs(spark, sf), X.passages(spark, sf))
    return chosen.select("brief_id", "position", "passage_id", "source", "n_words", "score")


@query("ret3_paragraph_exemplars", f"""WITH RECURSIVE {_retrieval_ctes()}, {_CHOICE} SELECT * FROM chosen""")
def ret3_paragraphs(spark, sf):
    chosen = retrieve.select_exemplars(X.briefs(spark, sf), _paragraph_passages(spark, sf))
    return chosen.select("brief_id", "position", "passage_id")


@query("ret4_reasons", f"""WITH {_retrieval_ctes()} SELECT brief_id, doc_id || '-' || par_no AS passage_id,
  concat_ws('; ', CASE WHEN sb = 5 THEN 'beat matches: ' || pbt WHEN sb > 0 THEN 'beat is near: ' || pbt END,
    CASE WHEN mt > 0 THEN 'with ' || array_to_string(list_filter(speakers, lambda z: list_contains(wanted, lower(z))), ', ') END,
    CASE WHEN ov > 0 THEN 'terms in common: ' || ov END) AS reasons
FROM pr WHERE ov > 0 OR mt > 0""")
def ret4(spark, sf):
    pairs = retrieve.matched_pairs(X.briefs(spark, sf), _paragraph_passages(spark, sf))
    return pairs.select("brief_id", "passage_id", F.array_join("reasons", "; ").alias("reasons"))
