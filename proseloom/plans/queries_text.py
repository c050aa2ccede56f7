"""Queries: sources, cleaning, structure, metrics, scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.scalar import rows
from ..operators import clean, corpus, formatting, metrics, profile, score, structure
from ..session import cut_lineage, shared_dir
from ..sources import scan
from . import tables as X
from .checks import sql as Q
from .checks import text as C
from .registry import query

LINE = r"\n"
LIB, STORY = Q.library_cte(), Q.stories_cte()


# --- sources ------------------------------------------------------------------


@query("src1_document_scan", "SELECT doc_id, source, lang, n_chars FROM documents WHERE text IS NOT NULL AND text <> ''")
def src1(spark, sf):
    docs = scan.read_documents(spark, f"{sf}/documents.parquet", columns=["doc_id", "source", "lang", "n_chars", "text"])
    return docs.drop("text")


_RECORD = "doc_id bigint, source string, text string"


def _exported(spark, sf, fmt):
    """The documents as files of a format; a fiftieth of the JSON lines are torn."""
    folder = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    docs = X.given(spark, sf, "documents").select("doc_id", "source", "text")
    if fmt == "json":
        line = F.to_json(F.struct("doc_id", "source", "text"))
        docs.select(F.when(F.col("doc_id") % 50 == 7, F.left(line, F.lit(20))).otherwise(line).alias("value")).write.text(folder)
    elif fmt == "csv":
        docs.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    else:
        docs.write.format(fmt).save(folder)
    return folder


def _read_back(spark, sf, fmt):
    root = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    good, bad = scan.read_records(spark, _exported(spark, sf, fmt), fmt, _RECORD, root)
    rows = good.select("doc_id", "source", F.md5("text").alias("digest"), F.lit("").alias("reason"))
    none = F.lit(None)
    return rows.unionByName(bad.select(
        none.cast("long").alias("doc_id"), none.cast("string").alias("source"), F.md5("record").alias("digest"), "reason"))


_WHOLE = "SELECT doc_id, source, md5(text) AS digest, '' AS reason FROM documents WHERE text <> ''"


@query("src1_json_scan", f"""{_WHOLE} AND doc_id % 50 <> 7 UNION ALL
SELECT NULL, NULL, md5(left('{{"doc_id":' || doc_id || ',"source":"' || source || '"', 20)), 'malformed' FROM documents WHERE doc_id % 50 = 7""")
def src1_json(spark, sf):
    return _read_back(spark, sf, "json")


@query("src1_csv_scan", _WHOLE)
def src1_csv(spark, sf):
    return _read_back(spark, sf, "csv")


@query("src1_orc_scan", _WHOLE)
def src1_orc(spark, sf):
    return _read_back(spark, sf, "orc")


_EXT = Q.array(L.UPLOAD_EXTENSIONS)


@query("src2_admission", f"""
WITH {LIB}, base AS (SELECT book_id, ord, {Q.trim('name')} AS name, mime, length(text) AS n_chars,
    CASE WHEN {Q.trim('name')} = '' OR {Q.trim('text')} = '' THEN 'blank'
         WHEN length({Q.trim('name')}) > {L.UPLOAD_MAX_NAME} THEN 'name too long'
         WHEN NOT list_contains({_EXT}, lower(regexp_extract({Q.trim('name')}, '[^/](\\.[^./]*)$', 1))) THEN 'extension'
         WHEN mime NOT IN {Q.listed(L.UPLOAD_MIMES)} THEN 'mime type'
         WHEN length(text) > {L.UPLOAD_MAX_CHARS} THEN 'file too large' END AS r FROM library),
run AS (SELECT *, row_number() OVER w AS file_no, sum(CASE WHEN r IS NULL THEN n_chars ELSE 0 END) OVER w AS batch_chars
    FROM base WINDOW w AS (PARTITION BY book_id ORDER BY ord)),
why AS (SELECT *, CASE WHEN file_no > {L.UPLOAD_MAX_FILES} THEN 'too many files'
    ELSE coalesce(r, CASE WHEN batch_chars > {L.UPLOAD_MAX_BATCH_CHARS} THEN 'batch too large' END, '') END AS reason FROM run)
SELECT book_id, ord, name, mime, n_chars, CAST(file_no AS BIGINT) AS file_no, CAST(batch_chars AS BIGINT) AS batch_chars,
    reason = '' AS admitted, reason FROM why""")
def src2(spark, sf):
    return scan.admit(X.library(spark, sf), "book_id", "ord")


@query("src3_folder_index", """SELECT DISTINCT 'source=' || source AS folder, 1 AS depth, true AS filled FROM documents WHERE text <> ''""")
def src3(spark, sf):
    """The folders of the documents exported by source."""
    folder = f"{shared_dir(spark)}/library-{uuid.uuid4().hex}"
    X.documents(spark, sf).select("doc_id", "source").write.partitionBy("source").parquet(folder)
    files = scan.folder_index(spark, folder, pattern="*.parquet")
    return files.groupBy(F.element_at(F.split("relative", "/"), 1).alias("folder"), F.col("depth").cast("int").alias("depth")).agg(
        F.bool_and(F.col("length") > 0).alias("filled"))


def _html_sql(x: str = "html") -> str:
    s = Q.raw_sub(x, r"(?i)<style(?s:.)*?</style>|<script(?s:.)*?</script>", "")
    s = Q.raw_sub(s, r"(?i)<span([^>]*)>((?s:.)*?)</span>", "\x01\\1\x02\\2\x03")
    for style, mark in ((r"font-weight\s*:\s*(?:bold|[7-9]00)", r"**\1**"), (r"font-style\s*:\s*italic", r"*\1*")):
        s = Q.raw_sub(s, "(?i)\x01[^\x02]*?" + style + "[^\x02]*\x02([^\x03]*)\x03", mark)
    s = Q.raw_sub(s, "\x01[^\x02]*\x02([^\x03]*)\x03", r"\1")
    s = Q.raw_sub(s, r"(?i)<(strong|b)(?:\s[^>]*)?>", "**")
    s = Q.raw_sub(s, r"(?i)</(strong|b)>", "**")
    s = Q.raw_sub(s, r"(?i)<(em|i)(?:\s[^>]*)?>", "*")
    s = Q.raw_sub(s, r"(?i)</(em|i)>", "*")
    for n in range(1, 7):
        s = Q.raw_sub(s, rf"(?i)<h{n}(?:\s[^>]*)?>((?s:.)*?)</h{n}>", "#" * n + " \\1\n\n")
    s = Q.raw_sub(s, r"(?i)<br\s*/?>", "\n")
    s = Q.raw_sub(s, r"(?i)</(?:p|div|li|tr|table|ul|ol)>", "\n\n")
    s = Q.raw_sub(s, r"<[^>]+>", "")
    s = Q.trim(Q.raw_sub(s, r"\n{3,}", "\n\n"))
    for entity, plain in L.ENTITIES:
        s = Q.raw_sub(s, "(?i)" + entity, plain)
    return s


@query("src4_html_markdown", f"SELECT page_id, {_html_sql()} AS markdown FROM pages")
def src4(spark, sf):
    pages = scan.spread_small_scan(X.given(spark, sf, "pages", "page_id", "html"))
    return pages.select("page_id", clean.html_to_markdown("html").alias("markdown"))


def _plain_sql(x: str) -> str:
    per_line = f"list_transform(string_split_regex({x}, '\\r?\\n'), lambda z: regexp_replace(z, '^#{{1,6}}[ \\t]+', ''))"
    s = Q.raw_sub(f"array_to_string({per_line}, chr(10))", r"\*\*|\*|`", "")
    return Q.rtrim(Q.raw_sub(s, r"\n{3,}", "\n\n")) + " || chr(10)"


@query("src5_markdown_plain", f"WITH md AS (SELECT page_id, {_html_sql()} AS m FROM pages) "
                              f"SELECT page_id, {_plain_sql('m')} AS plain FROM md")
def src5(spark, sf):
    return src4(spark, sf).select("page_id", clean.markdown_to_plain("markdown").alias("plain"))


def _prose_sql(x: str) -> str:
    s = Q.raw_sub(x, r"\A---\n(?s:.)*?\n---\n", "")
    s = Q.raw_sub(s, r"```(?s:.)*?```", "")
    t = Q.trim("z")
    keep = (f"NOT (starts_with({t}, '#') OR starts_with({t}, '>') OR starts_with({t}, '|') OR "
            f"regexp_matches({t}, '^[-*_]{{3,}}$'))")
    s = f"array_to_string(list_filter(string_split({s}, chr(10)), lambda z: {keep}), chr(10))"
    return Q.trim(Q.raw_sub(s, r"\n{3,}", "\n\n"))


@query("src6_prose", f"WITH {LIB} SELECT doc_id, {_prose_sql('text')} AS prose FROM library")
def src6(spark, sf):
    return X.library(spark, sf).select("doc_id", clean.prose("text").alias("prose"))


# The same patterns in the SQL dialect: flags in front, dot over lines, backslash groups.
_REDACT_SQL = [
    (name, ("(?i)" if ignore_case else "") + pattern.replace(r"[\s\S]", "(?s:.)"), repl.replace("$1", r"\1"))
    for name, pattern, ignore_case, repl in L.REDACTIONS
]


def _redact_sql(x: str) -> tuple[str, dict[str, str]]:
    counts = {}
    for name, pattern, repl in _REDACT_SQL:
        counts[name] = f"len(regexp_extract_all({x}, {Q.lit(pattern)}))"
        x = Q.raw_sub(x, pattern, repl)
    return x, counts


_RTEXT, _RCOUNTS = _redact_sql("text")


@query("src9_redaction", f"SELECT doc_id, {_RTEXT} AS text, " + ", ".join(
    f"CAST({c} AS BIGINT) AS n_{n}" for n, c in _RCOUNTS.items()) + " FROM documents")
def src9(spark, sf):
    return clean.redact_table(X.documents(spark, sf), ["doc_id"])


@query("src9_redaction_report", "SELECT source, count(*) AS documents, " + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS n_{n}" for n, c in _RCOUNTS.items()) + " FROM documents GROUP BY source")
def src9_report(spark, sf):
    return clean.redaction_report(X.documents(spark, sf), "source")


# --- structure ---------------------------------------------------------------------

_PAR = f"""parts AS (SELECT doc_id, string_split({Q.raw_sub('text', '(' + Q.re2(L.BLANK_LINE) + ')', chr(92) + '1' + Q.MARK)}, chr(1)) AS xs
    FROM stories),
chunk AS (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM parts),
off AS (SELECT doc_id, i, x, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) + length(x) - length(ltrim(x, {Q.lit(Q.TRIM_CHARS)})) AS pos FROM chunk),
par AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS par_no, CAST(pos AS BIGINT) AS char_offset,
    {Q.trim('x')} AS text FROM off WHERE {Q.trim('x')} <> '')"""


@query("txt1_paragraphs", f"""WITH {STORY}, {_PAR} SELECT doc_id, par_no, char_offset, text,
    CAST({Q.n_words('text')} AS BIGINT) AS n_words FROM par""")
def txt1(spark, sf):
    p = structure.paragraphs(X.stories(spark, sf), ["doc_id"])
    return p.select(
        "doc_id", F.col("par_no").cast("long").alias("par_no"), F.col("char_offset").cast("long").alias("char_offset"),
        "text", "n_words")


_SENT = f"""p AS (SELECT doc_id, unnest({Q.paragraphs('text')}) AS p, generate_subscripts({Q.paragraphs('text')}, 1) - 1 AS par_no
    FROM stories),
s AS (SELECT doc_id, par_no, unnest({Q.sentences('p')}) AS text, generate_subscripts({Q.sentences('p')}, 1) - 1 AS sent_no FROM p)"""


@query("txt2_sentences", f"WITH {STORY}, {_SENT} SELECT doc_id, par_no, sent_no, text, "
                         f"CAST({Q.n_words('text')} AS BIGINT) AS n_words FROM s")
def txt2(spark, sf):
    s = structure.sentences(X.stories(spark, sf), ["doc_id"])
    return s.select("doc_id", F.col("par_no").cast("long").alias("par_no"), F.col("sent_no").cast("long").alias("sent_no"),
                    "text", F.size("words").cast("long").alias("n_words"))


@query("txt2_sentences_raw", f"""WITH p AS (SELECT doc_id, unnest({Q.paragraphs('text', LINE)}) AS p FROM documents)
SELECT doc_id, CAST(sum(len({Q.sentences('p')})) AS BIGINT) AS n_sentences FROM p GROUP BY doc_id""")
def txt2_raw(spark, sf):
    d = X.documents(spark, sf)
    n = F.size(F.flatten(F.transform(T.paragraphs("text", LINE), T.sentences))).cast("long")
    return d.select("doc_id", n.alias("n_sentences")).where(F.col("n_sentences") > 0)


@query("txt3_words", f"""WITH w AS (SELECT source, unnest({Q.words('text')}) AS word FROM documents)
SELECT source, word, count(*) AS n FROM w GROUP BY source, word""")
def txt3(spark, sf):
    w = structure.words(X.documents(spark, sf), ["source"])
    return w.groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))


@query("txt4_dialogue_spans", f"""WITH {STORY}, x AS (SELECT doc_id, {Q.spoken('text')} AS xs FROM stories)
SELECT doc_id, unnest(xs) AS span, CAST(generate_subscripts(xs, 1) - 1 AS BIGINT) AS span_no FROM x""")
def txt4(spark, sf):
    return structure.dialogue_spans(X.stories(spark, sf), ["doc_id"]).select(
        "doc_id", "span", F.col("span_no").cast("long").alias("span_no"))


@query("txt5_dialogue_tags", f"""WITH {STORY}, x AS (SELECT doc_id, {Q.tags('text')} AS xs FROM stories)
SELECT doc_id, unnest(xs) AS tag, CAST(generate_subscripts(xs, 1) - 1 AS BIGINT) AS tag_no FROM x""")
def txt5(spark, sf):
    return structure.dialogue_tags(X.stories(spark, sf), ["doc_id"]).select(
        "doc_id", "tag", F.col("tag_no").cast("long").alias("tag_no"))


@query("txt6_speech_paragraphs", f"""WITH {STORY}, p AS (SELECT doc_id, unnest({Q.paragraphs('text')}) AS p FROM stories)
SELECT doc_id, count(*) FILTER (len({Q.spoken('p')}) > 0) AS speech, count(*) AS n FROM p GROUP BY doc_id""")
def txt6(spark, sf):
    p = structure.paragraphs(X.stories(spark, sf), ["doc_id"])
    return p.groupBy("doc_id").agg(F.count_if("is_speech").alias("speech"), F.count(F.lit(1)).alias("n"))


_TOK = f"""t AS (SELECT doc_id, source, unnest({Q.words('text')}) AS w, generate_subscripts({Q.words('text')}, 1) AS i FROM documents),
g AS (SELECT source, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS gram FROM t
    WINDOW o AS (PARTITION BY doc_id ORDER BY i))"""


@query("txt7_four_grams", f"WITH {_TOK} SELECT source, gram, count(*) AS n FROM g WHERE gram IS NOT NULL "
                          f"GROUP BY source, gram HAVING count(*) > 1")
def txt7(spark, sf):
    g = structure.ngrams(X.documents(spark, sf), ["source"])
    return g.groupBy("source", "gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


@query("txt8_openers", f"""WITH {STORY}, {_SENT},
o AS (SELECT doc_id, array_to_string(list_slice({Q.words('text')}, 1, 2), ' ') AS opener FROM s)
SELECT doc_id, opener, count(*) AS n FROM o WHERE length(opener) >= 3 GROUP BY doc_id, opener""")
def txt8(spark, sf):
    return structure.openers(X.stories(spark, sf), ["doc_id"]).groupBy("doc_id", "opener").agg(
        F.count(F.lit(1)).alias("n"))


# The ordered fold as a recursion over the paragraphs of every document.
_FOLD = f"""prosed AS (SELECT book_id, doc_id, {_prose_sql('text')} AS text FROM stories), {_PAR.replace('FROM stories', 'FROM prosed')},
pp AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY par_no) AS i, text, {Q.n_words('text')} AS n,
    len({Q.spoken('text')}) > 0 AS speech FROM par WHERE {Q.n_words('text')} > 0),
fold AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS g, CAST(0 AS BIGINT) AS held,
    CAST(0 AS BIGINT) AS n, '' AS run FROM pp
  UNION ALL
  SELECT doc_id, i, place, place + CAST(over OR closes AS BIGINT), CASE WHEN over OR closes THEN 0 ELSE held END,
    CASE WHEN over OR closes THEN 0 ELSE n END, CASE WHEN over OR closes THEN '' ELSE run END
  FROM (SELECT *, NOT over AND NOT speech AND n >= 60 AS closes FROM (
    SELECT doc_id, i, over, speech, g + CAST(held > 0 AND (over OR seam) AS BIGINT) AS place, CASE WHEN seam THEN 1 ELSE held + 1 END AS held,
      CASE WHEN seam THEN pn ELSE n + pn END AS n, CASE WHEN speech OR seam OR run = '' THEN sr ELSE run END AS run
    FROM (SELECT *, NOT over AND run <> '' AND run <> sr AND n >= 25 AS seam FROM (
      SELECT f.doc_id, p.i, f.g, f.held, f.n, f.run, p.n AS pn, p.speech, p.n >= 320 AS over,
        CASE WHEN p.speech THEN 'speech' ELSE 'narration' END AS sr
      FROM fold f JOIN pp p ON p.doc_id = f.doc_id AND p.i = f.i + 1))))),
psg AS (SELECT st.book_id, f.doc_id, f.place AS passage_no, f.doc_id || '-' || f.place AS passage_id,
    string_agg(p.text, chr(10) || chr(10) ORDER BY p.i) AS text, CAST(sum(p.n) AS BIGINT) AS n_words
  FROM fold f JOIN pp p ON p.doc_id = f.doc_id AND p.i = f.i JOIN stories st ON st.doc_id = f.doc_id GROUP BY ALL HAVING sum(p.n) >= 20)"""


@query("txt9_passages", f"WITH RECURSIVE {STORY}, {_FOLD} SELECT book_id, passage_id, passage_no, n_words, text FROM psg")
def txt9(spark, sf):
    return X.passages(spark, sf).select("book_id", "passage_id", "passage_no", "n_words", "text")


_BEAT_CASE = f"""CASE WHEN n = 0 THEN 'description' WHEN {Q.div('sp', 'n')} >= 0.3 THEN 'dialogue'
    WHEN tr >= 1.2 AND n < 120 THEN 'transition' WHEN ac >= 1.5 AND ac > inn THEN 'action' WHEN inn >= 1.2 THEN 'interiority'
    WHEN ac >= 0.8 THEN 'action' ELSE 'description' END"""


def _beat_cte(source: str, keys: str) -> str:
    d = lambda p: Q.div(Q.hits("text", p), "(n / 100.0)")
    sp = f"coalesce(list_sum(list_transform({Q.spoken('text')}, lambda z: {Q.n_words('z')})), 0)"
    return f"""b0 AS (SELECT {keys}, text, {Q.n_words('text')} AS n, {sp} AS sp FROM {source}),
b1 AS (SELECT {keys}, n, sp, {d(L.ACTION_VERBS)} AS ac, {d(L.INTERIOR_MARKERS)} AS inn, {d(L.TRANSITION_MARKERS)} AS tr FROM b0),
beats AS (SELECT {keys}, CAST(n AS BIGINT) AS n_words, {_BEAT_CASE} AS beat FROM b1)"""


@query("txt10_beats", f"""WITH {STORY}, {_PAR}, {_beat_cte('par', 'doc_id, par_no')} SELECT doc_id, par_no, n_words, beat FROM beats""")
def txt10(spark, sf):
    p = structure.paragraphs(X.stories(spark, sf), ["doc_id"])
    return p.select("doc_id", F.col("par_no").cast("long").alias("par_no"), "n_words",
                    structure.beat("text", F.col("n_words")).alias("beat"))


def _speaker_sql(x: str) -> str:
    s = Q.raw_sub(x, rf'([.!?]["”]?{Q.SPACE})([A-Z])', r"\1" + Q.MARK + r"\2")
    found = f"regexp_extract_all({s}, {Q.lit('[^0-9A-Za-z_' + Q.MARK + chr(92) + 'n]([A-Z][a-zÀ-ɏ]{2,})' + chr(92) + 'b')}, 1)"
    return f"list_filter({found}, lambda z: lower(z) NOT IN {Q.listed(L.SPEAKER_STOP)})"


@query("txt11_speakers", f"""WITH {STORY}, x AS (SELECT doc_id, {_speaker_sql('text')} AS xs FROM stories),
y AS (SELECT doc_id, unnest(xs) AS name, generate_subscripts(xs, 1) AS i FROM x),
z AS (SELECT doc_id, name, count(*) AS c, min(i) AS f FROM y GROUP BY doc_id, name),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) AS rk FROM z)
SELECT doc_id, string_agg(name, '|' ORDER BY rk) AS speakers FROM r GROUP BY doc_id""")
def txt11(spark, sf):
    s = X.stories(spark, sf).select("doc_id", structure.speakers("text").alias("s"))
    return s.where(F.size("s") > 0).select("doc_id", F.array_join("s", "|").alias("speakers"))


@query("txt12_lines", f"""WITH {LIB}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM library)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, {Q.has('line', L.BULLET_LINE, False)} AS is_bullet,
    {Q.has('line', L.HEADING_LINE, False)} AS is_heading, {Q.has('line', L.FIELD_LINE, False)} AS is_field,
    {Q.has('line', L.DATE_LINE)} AS is_dated FROM l WHERE {Q.trim('line')} <> ''""")
def txt12(spark, sf):
    found = structure.lines(X.library(spark, sf), ["doc_id"])
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "is_bullet", "is_heading", "is_field",
                       "is_dated")


# --- metrics --------------------------------------------------------------------------

_ALL = ", ".join([*L.COUNT_COLUMNS, *L.METRIC_COLUMNS])


@query("agg1_document_metrics", f"WITH {STORY}, {C.metric_ctes('stories', 'doc_id')} SELECT doc_id, {_ALL} FROM metrics")
def agg1(spark, sf):
    return metrics.document_metrics(X.stories(spark, sf), ["doc_id"])


@query("agg1_document_metrics_raw",
       f"WITH {C.metric_ctes('documents', 'doc_id', 'text', LINE)} SELECT doc_id, {_ALL} FROM metrics")
def agg1_raw(spark, sf):
    return metrics.document_metrics(X.documents(spark, sf), ["doc_id"], "text", LINE)


@query("agg2_pooled_fingerprint", f"WITH {STORY}, {C.pooled_ctes('stories', 'book_id')} SELECT book_id, {_ALL} FROM fingerprints")
def agg2(spark, sf):
    return metrics.pooled_fingerprint(X.stories(spark, sf), ["book_id"])


def _merged_sql() -> str:
    w = "word_count"
    parts = ", ".join(
        f"CASE WHEN count(*) FILTER ({w} > 0) = 1 THEN max({c}) FILTER ({w} > 0) ELSE "
        f"{Q.rnd(f'sum({c} * {w}) / sum({w})')} END AS {c}" for c in L.METRIC_COLUMNS
    )
    return (f"SELECT book_id, CAST(sum(word_count) AS BIGINT) AS word_count, CAST(sum(sentence_count) AS BIGINT) AS "
            f"sentence_count, CAST(sum(paragraph_count) AS BIGINT) AS paragraph_count, {parts} FROM metrics "
            f"WHERE {w} > 0 GROUP BY book_id")


def _stored(spark, sf, *tables):
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    corpus.build(X.stories(spark, sf), root, tables)
    return corpus.read(spark, root, tables[-1])


@query("src7_corpus_artifact", f"WITH {STORY}, {C.pooled_ctes('stories', 'book_id')} SELECT book_id, {_ALL} FROM fingerprints")
def src7(spark, sf):
    return _stored(spark, sf, "measures", "fingerprints").select("book_id", *L.COUNT_COLUMNS, *L.METRIC_COLUMNS)


@query("src7_passages", f"""WITH RECURSIVE {STORY}, {_FOLD}, {_beat_cte('psg', 'passage_id')}, {C.metric_ctes('psg', 'passage_id')}
SELECT b.passage_id, b.n_words, b.beat, m.sentence_count, m.paragraph_count, m.sentence_median_words, m.texture_commas_per_1k
FROM beats b JOIN metrics m USING (passage_id)""")
def src7_passages(spark, sf):
    stored = _stored(spark, sf, "passages")
    picked = ("sentence_count", "paragraph_count", "sentence_median_words", "texture_commas_per_1k")
    return stored.select("passage_id", "n_words", "beat", *[F.col(f"metrics.{c}").alias(c) for c in picked])


@query("agg3_weighted_merge", f"WITH {STORY}, {C.metric_ctes('stories', 'book_id, doc_id')} {_merged_sql()}")
def agg3(spark, sf):
    per_doc = metrics.document_metrics(X.stories(spark, sf), ["book_id", "doc_id"])
    return metrics.merge_metrics(per_doc, ["book_id"])


# --- profile ------------------------------------------------------------------------------

_CLEAN_QUOTE = Q.lit('\x01(?:"' + Q.re2(r"(?:\S|\S[^\u0002]*\S)") + '"|“' + Q.re2(r"(?:\S|\S[^\u0002]*\S)") + "”)\x02")
_NARR = Q.raw_sub("text", r'(["“][^"“”]{1,1000}[^"“”]{0,1000}["”])', "\x01\\1\x02")
_NARR = f"regexp_replace({_NARR}, {_CLEAN_QUOTE}, ' ', 'g')"
_NARR = Q.raw_sub(_NARR, "[\x01\x02]", "")
_H = lambda p, c="text": Q.hits(c, p)
_AUD = " ".join(
    f", {' + '.join(_H(p) for p in patterns)} AS aud_{i}" for i, (_, patterns, _) in enumerate(L.AUDIENCES)
)


def profile_cte(source: str, keys: str) -> str:
    n = lambda ws, ex=(): f"len(list_filter(nw, lambda z: z IN {Q.listed([w for w in ws if w not in ex])}))"
    sense = ", ".join(f"{_H(p)} AS sense_{s}" for s, p in L.SENSORY.items())
    return f"""pc0 AS (SELECT {keys}, text, {_NARR} AS narr FROM {source}),
pc1 AS (SELECT *, {Q.words('narr')} AS nw FROM pc0),
counts AS (SELECT {keys}, len(nw) AS n_narrative, {n(L.FIRST_PERSON)} AS first, {n(L.SECOND_PERSON, L.FIRST_PERSON)} AS second,
  {n(L.THIRD_PERSON, L.FIRST_PERSON)} AS third, {_H(L.NARRATED_THOUGHT, 'narr')} AS thought, {_H(L.PAST_MARKERS, 'narr')} AS past,
  {_H(L.PRESENT_MARKERS, 'narr')} AS present, {Q.n_words('text')} AS n_words, {_H(L.FILTER_PATTERN)} AS filt,
  {_H(L.INTERIORITY)} AS interior, {_H(L.EMOTION_WORDS)} AS emotion, {_H(L.BODY_CUES)} AS body_cue, {_H(L.SIMILE)} AS simile,
  {_H(L.METAPHOR_SIGNALS)} AS metaphor, {sense}, {_H(L.ROMANCE_SIGNALS)} AS romance, {_H(L.SEXUAL_SIGNALS)} AS sexual,
  {_H(L.EXPLICIT_SIGNALS)} AS explicit, {_H(L.FADE)} AS fade {_AUD} FROM pc1)"""


def narration_select(keys: str, source: str = "counts") -> str:
    pron, verbs = "greatest(first + second + third, 1)", "greatest(past + present, 1)"
    return f"""SELECT {keys}, pov, tense, pov_confidence, CASE WHEN tense = 'mixed' THEN 0.4 ELSE least(abs(p - 0.5) * 2.4, 1.0) END
  AS tense_confidence FROM (SELECT *,
    CASE WHEN f > 0.35 THEN 'first' WHEN s > 0.3 THEN 'second' WHEN t > 0.5 AND inn > 1.2 THEN 'third_limited'
         WHEN t > 0.5 THEN 'third_omniscient' ELSE 'mixed' END AS pov,
    CASE WHEN f > 0.35 THEN least(f * 1.6, 1.0) WHEN s > 0.3 THEN least(s * 1.6, 1.0)
         WHEN t > 0.5 THEN least(t * CAST(1.2 AS DOUBLE), 1.0) * CASE WHEN inn > 1.2 THEN 1.0 ELSE CAST(0.7 AS DOUBLE) END
         ELSE 0.3 END AS pov_confidence,
    CASE WHEN p > 0.65 THEN 'past' WHEN p < 0.35 THEN 'present' ELSE 'mixed' END AS tense
    FROM (SELECT {keys}, {Q.div('first', pron)} AS f, {Q.div('second', pron)} AS s, {Q.div('third', pron)} AS t,
      {Q.div('past', verbs)} AS p, {Q.div('thought', '(greatest(n_narrative, 1) / 1000.0)')} AS inn FROM {source}))"""


def _round_conf(df, *columns):
    """Confidences to nine decimals, so the last bit of a product never decides."""
    return df.withColumns({c: F.floor(F.col(c) * 1e9 + 0.5) / 1e9 for c in columns})


def _r9(c: str) -> str:
    return f"floor({c} * 1e9 + 0.5) / 1e9 AS {c}"


def _counts(texts, key, columns):
    return profile.profile_counts(texts, [key], columns=columns)


@query("agg4_narration", f"""WITH {STORY}, {profile_cte('stories', 'doc_id')}
SELECT doc_id, pov, tense, {_r9('pov_confidence')}, {_r9('tense_confidence')} FROM ({narration_select('doc_id')})""")
def agg4(spark, sf):
    n = profile.narration(_counts(X.stories(spark, sf), "doc_id", profile.NARRATION_COUNTS), ["doc_id"])
    return _round_conf(n.select("doc_id", "pov", "tense", "pov_confidence", "tense_confidence"),
                       "pov_confidence", "tense_confidence")


@query("agg5_distance", f"""WITH {STORY}, {profile_cte('stories', 'doc_id')}
SELECT doc_id, CASE WHEN filt > interior * 1.35 THEN 'distant' WHEN interior > filt * 1.35 THEN 'close' ELSE 'middle' END
  AS distance, {Q.per1k('filt', 'n_words')} AS filter_verbs_per_1k, {Q.per1k('interior', 'n_words')} AS interiority_per_1k
FROM counts""")
def agg5(spark, sf):
    return profile.distance(_counts(X.stories(spark, sf), "doc_id", profile.DISTANCE_COUNTS), ["doc_id"])


@query("agg6_sensory", f"""WITH {STORY}, {profile_cte('stories', 'doc_id')} SELECT doc_id, """ + ", ".join(
    f"{Q.per1k(f'sense_{s}', 'n_words')} AS {s}" for s in L.SENSORY) + " FROM counts")
def agg6(spark, sf):
    return profile.sensory(_counts(X.stories(spark, sf), "doc_id", profile.SENSORY_COUNTS), ["doc_id"])


@query("agg7_beat_mix", f"""WITH {STORY}, {_PAR}, par2 AS (SELECT p.*, st.book_id FROM par p JOIN stories st USING (doc_id)),
{_beat_cte('par2', 'book_id')}, tot AS (SELECT book_id, """ + ", ".join(
    f"coalesce(sum(n_words) FILTER (beat = '{b}'), 0) AS {b}" for b in L.BEATS) + """, greatest(sum(n_words), 1) AS total
FROM beats GROUP BY book_id) SELECT book_id, """ + ", ".join(f"{Q.share(b, 'total')} AS {b}" for b in L.BEATS) + " FROM tot")
def agg7(spark, sf):
    p = structure.paragraphs(X.stories(spark, sf), ["book_id", "doc_id"])
    return profile.beat_mix(p.withColumn("beat", structure.beat("text", F.col("n_words"))), ["book_id"])


@query("agg8_emotion", f"""WITH {STORY}, {profile_cte('stories', 'doc_id')} SELECT doc_id, """ + ", ".join(
    f"{Q.per1k(c, 'n_words')} AS {n}" for n, c in (
        ("explicit_per_1k", "emotion"), ("body_cue_per_1k", "body_cue"), ("thought_per_1k", "interior"),
        ("similes_per_1k", "simile"), ("metaphor_per_1k", "metaphor"))) + " FROM counts")
def agg8(spark, sf):
    return profile.emotion(_counts(X.stories(spark, sf), "doc_id", profile.EMOTION_COUNTS), ["doc_id"])


_POOL = "pooled AS (SELECT book_id, " + ", ".join(
    f"sum({c}) AS {c}" for c in ("n_words", "romance", "sexual", "explicit", "fade",
                                 *(f"aud_{i}" for i in range(len(L.AUDIENCES))))) + " FROM counts GROUP BY book_id)"


@query("agg9_intensity", f"""WITH {STORY}, {profile_cte('stories', 'book_id')}, {_POOL}, v AS (SELECT book_id,
  CASE WHEN explicit >= 4 THEN 'Very explicit' WHEN explicit > 0 THEN 'Explicit' WHEN sexual > 0 THEN 'Open door'
       WHEN fade > 0 AND romance > 0 THEN 'Fade to black' WHEN romance > 0 THEN 'Romantic tension only' ELSE 'None' END AS intimacy,
  CASE WHEN explicit >= 4 THEN least(0.98, 0.65 + explicit / 40.0) WHEN explicit > 0 THEN least(0.94, 0.6 + explicit / 30.0)
       WHEN sexual > 0 THEN least(0.85, 0.55 + sexual / 30.0) WHEN fade > 0 AND romance > 0 THEN 0.72
       WHEN romance > 0 THEN least(0.78, 0.5 + romance / 40.0) ELSE 0.55 END AS intimacy_confidence FROM pooled)
SELECT book_id, intimacy, {_r9('intimacy_confidence')} FROM v""")
def agg9(spark, sf):
    counts = profile.pooled_counts(_counts(X.stories(spark, sf), "book_id", profile.INTENSITY_COUNTS), ["book_id"])
    out = profile.intensity(counts, ["book_id"]).select("book_id", "intimacy", "intimacy_confidence")
    return _round_conf(out, "intimacy_confidence")


@query("agg10_audience", f"""WITH {LIB}, {profile_cte('library', 'book_id')}, {_POOL}, a AS (""" + " UNION ALL ".join(
    f"SELECT book_id, n_words, {i} AS i, {Q.lit(v)} AS v, aud_{i} AS n FROM pooled" for i, (v, _, _) in enumerate(L.AUDIENCES)
) + f"""), r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, i) AS k FROM a WHERE n >= 2)
SELECT p.book_id, coalesce(string_agg(v, '|' ORDER BY k), '') AS audience,
  coalesce(max({Q.rnd("least(0.9, 0.5 + n / greatest(r.n_words / 1000.0, 1.0) / 10.0)")}) FILTER (k = 1), 0.25) AS audience_confidence
FROM pooled p LEFT JOIN r ON p.book_id = r.book_id GROUP BY p.book_id""")
def agg10(spark, sf):
    counts = profile.pooled_counts(_counts(X.library(spark, sf), "book_id", profile.AUDIENCE_COUNTS), ["book_id"])
    a = profile.audience(counts, ["book_id"])
    return a.select("book_id", F.array_join("audience", "|").alias("audience"), "audience_confidence")


def _italics(x: str) -> str:
    """Spans between lone stars: runs of stars become another sign first, as this dialect cannot look behind."""
    masked = f"regexp_replace({x}, '[*][*]+', chr(2), 'g')"
    inside = chr(92) + "s*" + chr(92) + "n" + chr(2)
    return f"len(regexp_extract_all({masked}, {Q.lit('[*][^' + inside + '](?:[^*' + chr(92) + 'n' + chr(2) + ']*[^' + inside + '])?[*]')}))"


_FMT = f"""md AS (SELECT page_id, {_html_sql()} AS m FROM pages),
obs AS (SELECT page_id, {Q.n_words('m')} AS word_count, {Q.hits('m', L.FORMAT_DIALOGUE, False)} AS dialogue_count,
  {Q.hits('m', L.FORMAT_BOLD_DIALOGUE, False)} AS bold_dialogue_count,
  {Q.hits('m', L.FORMAT_BOLD, False)} AS bold_count, {_italics('m')} AS italic_count FROM md)"""


@query("agg11_formatting", f"WITH {_FMT} SELECT page_id, CAST(word_count AS BIGINT) AS word_count, dialogue_count, "
                           f"bold_dialogue_count, bold_count, italic_count FROM obs")
def agg11(spark, sf):
    md = src4(spark, sf).withColumnRenamed("markdown", "text")
    return formatting.observations(md, ["page_id"])


@query("agg12_convention_rollup", f"""WITH {STORY}, o AS (SELECT book_id, doc_id,
  {Q.hits("replace(text, chr(34) || chr(10), chr(34))", L.FORMAT_BOLD_DIALOGUE, False)} AS b, {_italics('text')} AS i
  FROM stories) SELECT book_id, count(*) AS sources, count(*) FILTER (b > 0) AS bold_dialogue_sources,
  count(*) FILTER (i > 0) AS italic_sources FROM o GROUP BY book_id""")
def agg12(spark, sf):
    seen = formatting.observations(X.stories(spark, sf), ["book_id", "doc_id"])
    return formatting.conventions(seen, ["book_id"])


# --- scoring ------------------------------------------------------------------------------

_BASE = f"{STORY}, {C.pooled_ctes('stories', 'book_id')}, drafts_m AS (SELECT * FROM metrics)"
_DEV = f"{_BASE}, {C.deviation_ctes('drafts_m', 'fingerprints', 'book_id')}"


def _deviations(spark, sf):
    """Every text is read once: group prints and draft rows derive from the same measures."""
    measured = cut_lineage(metrics.measures(X.stories(spark, sf), ["doc_id", "book_id"]))
    rows = metrics.draft_metrics(measured, ["doc_id", "book_id"])
    return score.deviations(rows, metrics.fingerprints(measured, ["book_id"]), ["doc_id"], ["book_id"])


@query("sco1_drift", f"WITH {_DEV} SELECT doc_id, metric, draft, author, drift, direction FROM dev")
def sco1(spark, sf):
    return _deviations(spark, sf).select("doc_id", "metric", "draft", "author", "drift", "direction")


@query("sco2_severity", f"WITH {_DEV} SELECT doc_id, metric, severity FROM dev")
def sco2(spark, sf):
    return _deviations(spark, sf).select("doc_id", "metric", "severity")


@query("sco3_ranked_deviations", f"WITH {_DEV} SELECT doc_id, position, metric, severity FROM dev")
def sco3(spark, sf):
    return _deviations(spark, sf).select("doc_id", "position", "metric", "severity")


_REP = f"{STORY}, {C.metric_ctes('stories', 'doc_id')}, {C.repetition_ctes('stories')}"


def _findings(asked: str, name: str, step: int):
    check = f"WITH {_REP} SELECT doc_id, kind, value, CAST(n AS BIGINT) AS n, severity FROM rep WHERE step = {step}"

    def run(spark, sf):
        found = score.repetitions(X.stories(spark, sf), ["doc_id"], checks=[asked])
        return found.select("doc_id", "kind", "value", "n", "severity")

    query(name, check)(run)


_findings("phrase", "sco4_repeated_phrases", 1)
_findings("opener", "sco5_repeated_openers", 2)
_findings("paragraphs", "sco6_uniform_paragraphs", 3)
_findings("tag", "sco7_overused_tags", 4)
_findings("dialogue", "sco8_uniform_dialogue", 5)

_RANK = "CASE severity WHEN 'blocker' THEN 3 WHEN 'major' THEN 2 ELSE 1 END"


@query("sco9_combined_findings", f"""WITH {_REP} SELECT doc_id, kind, value, CAST(n AS BIGINT) AS n, severity,
  row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK} DESC, n DESC, step, value) AS position FROM rep""")
def sco9(spark, sf):
    return score.repetitions(X.stories(spark, sf), ["doc_id"]).select(
        "doc_id", "kind", "value", "n", "severity", "position")


_FID = f"""{_DEV}, {C.repetition_ctes('stories')},
pd AS (SELECT doc_id, sum(least(abs(drift), 2) * weight * 7.0 ORDER BY position) AS p, count(*) AS nd FROM dev GROUP BY doc_id),
pr AS (SELECT doc_id, sum(CASE severity WHEN 'blocker' THEN 12 WHEN 'major' THEN 6 ELSE 2 END) AS p, count(*) AS nr
  FROM rep GROUP BY doc_id),
fid AS (SELECT m.doc_id, m.book_id, m.word_count, f.word_count AS a_words, coalesce(nd, 0) AS nd, coalesce(nr, 0) AS nr,
  CAST(greatest(0, least(100, floor(100.0 - (coalesce(pd.p, 0) + coalesce(pr.p, 0)) + 0.5))) AS BIGINT) AS fidelity
  FROM metrics m JOIN fingerprints f USING (book_id) LEFT JOIN pd USING (doc_id) LEFT JOIN pr USING (doc_id))"""


def _reports(spark, sf, *columns):
    measured = cut_lineage(score.measured_drafts(X.stories(spark, sf), ["doc_id", "book_id"]))
    prints = metrics.fingerprints(measured, ["book_id"])
    return score.reports(measured, prints, ["doc_id"], ["book_id"], columns=columns).select("doc_id", *columns)


@query("sco10_fidelity", f"WITH {_FID} SELECT doc_id, fidelity, CAST(nd AS BIGINT) AS n_deviations, "
                         f"CAST(nr AS BIGINT) AS n_repetitions FROM fid")
def sco10(spark, sf):
    return _reports(spark, sf, "fidelity", "n_deviations", "n_repetitions")


@query("sco11_verdict", f"""WITH {_FID} SELECT doc_id,
  CASE WHEN fidelity >= 80 THEN 'pass' WHEN fidelity >= 60 THEN 'revise' ELSE 'fail' END AS verdict,
  a_words < 2000 AS thin_corpus, word_count < 300 AS short_draft FROM fid""")
def sco11(spark, sf):
    return _reports(spark, sf, "verdict", "thin_corpus", "short_draft")


def _number_sql(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


_TEMPLATES = ", ".join(
    f"({Q.lit(m)}, {Q.lit(score._templates(m, label)[0])}, {Q.lit(score._templates(m, label)[1])})"
    for m, _, label, *_ in score.COMPARED)
# Notes of findings, then instructions of deviations, both without minor ones.
_SAID = f"""tp AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(metric, above, below)),
nt AS (SELECT doc_id, 1 AS part, row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK} DESC, n DESC, step, value) AS p, severity,
  CASE step WHEN 1 THEN 'Repeated phrase, ' || n || ' uses: "' || value || '".' WHEN 2 THEN 'Repeated opening, ' || n || ' sentences: "' || value || '".'
    WHEN 3 THEN 'Paragraphs hardly differ in length: mean ' || split_part(value, ' words ±', 1) || ', deviation ' || split_part(value, '±', 2) || ' words.'
    WHEN 4 THEN 'Repeated tag, ' || n || ' uses: "' || value || '".'
    ELSE 'Speeches hardly differ in length: ' || n || ' of them, mean ' || split_part(split_part(value, '~', 2), ' ', 1) || ' words.' END AS said FROM rep),
dn AS (SELECT doc_id, 2 AS part, position AS p, severity, replace(replace(CASE WHEN direction = 'above' THEN above ELSE below END,
    '{{author}}', {_number_sql('author')}), '{{target}}', 'author runs ' || {_number_sql('author')} || ', this draft runs ' || {_number_sql('draft')}) AS said
  FROM dev JOIN tp USING (metric)),
loud AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, p) - 1 AS position
  FROM (SELECT * FROM nt UNION ALL SELECT * FROM dn) WHERE severity <> 'minor')"""


@query("sco12_instructions", f"WITH {_FID}, {_SAID} SELECT doc_id, CAST(position AS INTEGER) AS position, said AS instruction FROM loud")
def sco12(spark, sf):
    return _reports(spark, sf, "instructions").select(
        "doc_id", F.posexplode(rows("instructions")).alias("position", "instruction"))


_SETS = list(L.ADVISORY_PHRASES)
_AUDIT = f"""au AS (SELECT book_id, doc_id, {Q.n_words('text')} AS n_words, """ + ", ".join(
    f"{Q.hits('text', score.phrase_pattern(L.ADVISORY_PHRASES[s]))} AS {s}" for s in _SETS) + """ FROM stories),
al AS (""" + " UNION ALL ".join(f"SELECT book_id, doc_id, n_words, '{s}' AS phrase_set, {s} AS n FROM au" for s in _SETS) + """),
ac AS (SELECT *, sum(n) OVER w AS c_n, sum(n_words) OVER w AS c_words FROM al WINDOW w AS (PARTITION BY book_id, phrase_set))"""


@query("sco13_phrase_audit", f"""WITH {STORY}, {_AUDIT} SELECT doc_id, book_id, phrase_set, CAST(n AS BIGINT) AS n,
  CAST(n_words AS BIGINT) AS n_words, CAST(c_n AS BIGINT) AS c_n, CAST(c_words AS BIGINT) AS c_words FROM ac
WHERE n >= 2 AND c_words >= 2000 AND {Q.div('n', 'n_words')} > {Q.div('c_n', 'c_words')} * 1.5""")
def sco13(spark, sf):
    return score.phrase_audit(X.stories(spark, sf), ["doc_id"], ["book_id"])


# --- flagship ----------------------------------------------------------------------------------

_FLAG = f"""{C.pooled_ctes('documents', 'source', 'text', LINE)}, {C.deviation_ctes('metrics', 'fingerprints', 'source')},
{C.repetition_ctes('documents', 'text', LINE)},
pd AS (SELECT doc_id, sum(least(abs(drift), 2) * weight * 7.0 ORDER BY position) AS p, count(*) AS nd FROM dev GROUP BY doc_id),
pr AS (SELECT doc_id, sum(CASE severity WHEN 'blocker' THEN 12 WHEN 'major' THEN 6 ELSE 2 END) AS p FROM rep GROUP BY doc_id),
fid AS (SELECT m.doc_id, m.source, coalesce(nd, 0) AS nd,
  CAST(greatest(0, least(100, floor(100.0 - (coalesce(pd.p, 0) + coalesce(pr.p, 0)) + 0.5))) AS BIGINT) AS fidelity
  FROM metrics m LEFT JOIN pd USING (doc_id) LEFT JOIN pr USING (doc_id))"""


@query("style_reports", f"""WITH {_FLAG} SELECT doc_id, source, fidelity, CASE WHEN fidelity >= 80 THEN 'pass'
  WHEN fidelity >= 60 THEN 'revise' ELSE 'fail' END AS verdict, CAST(nd AS BIGINT) AS n_deviations FROM fid""")
def style_reports(spark, sf):
    """Each document scored against the pooled fingerprint of its own source."""
    measured = cut_lineage(score.measured_drafts(X.documents(spark, sf), ["doc_id", "source"], "text", LINE))
    prints = metrics.fingerprints(measured, ["source"])
    return score.reports(measured, prints, ["doc_id"], ["source"], columns=("fidelity", "verdict", "n_deviations"))

