"""Checks for classification and manuscript structure."""

from __future__ import annotations

from ...functions import lexicons as L
from . import sql as Q


def is_heading(t: str, isolated: str = "false") -> str:
    any_p = " OR ".join(Q.has(t, p) for p in L.HEADING_PATTERNS)
    return f"({t} <> '' AND length({t}) <= 90 AND ({any_p} OR ({isolated} AND {Q.has(t, L.CAPS_HEADING, False)})))"


def is_break(t: str) -> str:
    return f"({t} <> '' AND length({t}) <= 12 AND {Q.has(t, L.SCENE_BREAK, False)})"


def line_cte(name: str, source: str, text: str) -> str:
    """Lines with offsets, one row each: ``(doc_id, i, line, pos, t)``."""
    return f"""{name}0 AS (SELECT doc_id, unnest(string_split({text}, chr(10))) AS line,
      generate_subscripts(string_split({text}, chr(10)), 1) AS i FROM {source}),
    {name} AS (SELECT doc_id, i, line, {Q.trim('line')} AS t, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id
      ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM {name}0)"""


def boundary_ctes(source: str) -> str:
    """CTE ``bounds(doc_id, text, bm_at, bm_heading, story, ep_at, ep_heading, main)``."""
    titles = " OR ".join(Q.has("t", p) for p in L.BACK_MATTER_HEADINGS)
    contents = [p for p, _ in L.BACK_MATTER_CONTENT]
    # Position of the first hit: length of the text before it.
    spot = lambda p: (
        f"CASE WHEN {Q.has('c', p)} THEN length(regexp_extract(c, {Q.lit('(?is)^(.*?)' + Q.re2(p))}, 1)) END")
    spots = ", ".join(spot(p) for p in contents)
    mark = f"string_split({Q.raw_sub('text', '(' + Q.re2(L.BLANK_LINE) + ')', chr(92) + '1' + Q.MARK)}, chr(1))"
    return f"""
    {line_cte('ln', source, 'text')},
    src AS (SELECT doc_id, text, length(text) * CAST(0.25 AS DOUBLE) AS thr FROM {source}),
    bm1 AS (SELECT doc_id, arg_min(pos, i) AS ofs, arg_min(t, i) AS heading FROM ln JOIN src USING (doc_id)
        WHERE pos >= thr AND t <> '' AND length(t) <= 90 AND ({titles}) GROUP BY doc_id),
    ck0 AS (SELECT doc_id, unnest({mark}) AS x, generate_subscripts({mark}, 1) AS i FROM src),
    ck AS (SELECT doc_id, i, {Q.trim('x')} AS c, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(x) - length(ltrim(x, {Q.lit(Q.TRIM_CHARS)})) AS st FROM ck0),
    ch AS (SELECT doc_id, i, st, st + least({spots}) AS hit FROM ck WHERE c <> ''),
    bm2a AS (SELECT doc_id, arg_min(CASE WHEN st >= thr THEN st ELSE hit END, i) AS ofs FROM ch JOIN src USING (doc_id)
        WHERE hit >= thr GROUP BY doc_id),
    bm2 AS (SELECT doc_id, ofs, left({Q.trim("string_split_regex(substr(text, CAST(ofs AS BIGINT) + 1), '[.!?\\n]')[1]")}, 90) AS h
        FROM bm2a JOIN src USING (doc_id)),
    st AS (SELECT s.doc_id, s.text, coalesce(a.ofs, b.ofs) AS bm_at,
        coalesce(a.heading, CASE WHEN b.h = '' THEN 'Closing material' ELSE b.h END) AS bm_heading,
        left(s.text, CAST(coalesce(a.ofs, b.ofs, length(s.text)) AS BIGINT)) AS story
        FROM src s LEFT JOIN bm1 a USING (doc_id) LEFT JOIN bm2 b USING (doc_id)),
    {line_cte('sl', 'st', 'story')},
    ep AS (SELECT doc_id, arg_min(pos, i) AS ep_at, arg_min(t, i) AS ep_heading FROM sl
        WHERE {is_heading('t')} AND {Q.has('t', L.EPILOGUE_HEADING)} GROUP BY doc_id),
    bounds AS (SELECT st.*, ep_at, ep_heading, CASE WHEN ep_at IS NULL THEN story
        ELSE {Q.rtrim('left(story, CAST(ep_at AS BIGINT))')} END AS main FROM st LEFT JOIN ep USING (doc_id))"""


def chapter_ctes(source: str) -> str:
    """CTEs ``bounds``, ``ml`` (main lines), ``heads`` and ``chapters``."""
    isolated = (f"((coalesce(pt, '') = '' OR {Q.has('pt', L.DIVIDER, False)}) AND coalesce(nt, '') = '')")
    return f"""{boundary_ctes(source)},
    {line_cte('ml', 'bounds', 'main')},
    mlw AS (SELECT *, lag(t) OVER w AS pt, lead(t) OVER w AS nt FROM ml WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    heads AS (SELECT doc_id, i, pos, t AS heading FROM mlw WHERE {is_heading('t', isolated)} AND NOT {is_break('t')}),
    starts AS (SELECT doc_id, 0 AS i, 0 AS pos, CAST(NULL AS VARCHAR) AS heading FROM bounds
        UNION ALL SELECT doc_id, i, pos, heading FROM heads),
    secs AS (SELECT s.doc_id, s.i, s.pos, s.heading, lead(s.pos) OVER w AS nxt, main FROM starts s JOIN bounds USING (doc_id)
        WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.i)),
    secn AS (SELECT *, {Q.n_words("substr(main, CAST(pos AS BIGINT) + 1, CAST(coalesce(nxt, length(main)) - pos AS BIGINT))")} AS n FROM secs),
    secr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM secn
        WHERE n > 0 AND (heading IS NOT NULL OR n > 20 OR nxt IS NULL)),
    chapters AS (SELECT doc_id, row_number() OVER w AS chapter_no,
        coalesce(heading, 'Untitled section ' || row_number() OVER w) AS heading, n AS n_words, pos AS ofs FROM secr
        WHERE rn = 1 OR n >= 20 OR coalesce({Q.has('heading', L.EXPLICIT_HEADING)}, false)
        WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


def stripped(x: str) -> str:
    a = Q.raw_sub(x, Q.re2(L.LAYOUT_CHARS), "\n")
    return Q.rtrim(f"regexp_replace({a}, {Q.rx(L.TRAILING_RULES, False)}, '')")


def completeness_ctes() -> str:
    """CTE ``done(doc_id, complete, why)``; needs ``bounds`` and ``chapters``."""
    return f"""
    body AS (SELECT doc_id, {stripped('main')} AS b FROM bounds),
    tailw AS (SELECT doc_id, b, right(b, 1) AS c, {Q.words('b')}[-1] AS w FROM body),
    lastc AS (SELECT doc_id, count(*) AS k, arg_max(n_words, chapter_no) AS last_n, max(chapter_no) AS last_no FROM chapters GROUP BY doc_id),
    oth AS (SELECT c.doc_id, n_words, row_number() OVER (PARTITION BY c.doc_id ORDER BY n_words) - 1 AS r, k FROM chapters c
        JOIN lastc USING (doc_id) WHERE chapter_no < last_no),
    med AS (SELECT doc_id, n_words AS m FROM oth WHERE r = (k - 1) // 2),
    why AS (SELECT doc_id, CASE WHEN b = '' THEN 'empty'
        WHEN NOT contains({Q.lit(L.TERMINAL_CHARS)}, c) THEN 'no closing punctuation'
        WHEN w IN {Q.listed(L.DANGLING_WORDS)} THEN 'ends on ' || w
        WHEN coalesce(k >= 3 AND m > 0 AND last_n < m * CAST(0.35 AS DOUBLE), false) THEN 'short final section'
        ELSE 'complete sentence' END AS why FROM tailw LEFT JOIN lastc USING (doc_id) LEFT JOIN med USING (doc_id)),
    done AS (SELECT doc_id, why IN ('empty', 'complete sentence') AS complete, why FROM why)"""


def convention_ctes() -> str:
    """CTE ``conv``; needs ``bounds``, ``ml`` and ``heads``."""
    bare = Q.sub("h", r"^#+\s*", "")
    count = lambda p: Q.hits("main", p, False)
    return f"""
    h1 AS (SELECT doc_id, arg_min(heading, i) AS h FROM heads GROUP BY doc_id),
    brk AS (SELECT doc_id, t, count(*) AS c, min(i) AS f FROM ml WHERE {is_break('t')} GROUP BY doc_id, t),
    brk1 AS (SELECT doc_id, t AS scene_break FROM brk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) = 1),
    ind AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '^[ \\t]{{2,}}|^\\t')) AS k FROM ml
        WHERE length(t) > 40 GROUP BY doc_id),
    cnt AS (SELECT doc_id, {count('[“”]')} AS cu, {count('"')} AS st, {count('—')} AS em,
        len(list_filter(regexp_extract_all(main, '-+'), lambda z: length(z) = 2)) AS dh, {count(' – ')} AS en FROM bounds),
    conv AS (SELECT c.doc_id, h AS heading_example,
        CASE WHEN h IS NULL THEN NULL WHEN {bare} = upper({bare}) AND {Q.has(bare, '[A-Z]', False)} THEN 'upper'
             WHEN {Q.has(bare, '^[A-Z][a-z]', False)} THEN 'title' ELSE 'other' END AS heading_case, scene_break,
        CASE WHEN cu = 0 AND st = 0 THEN 'none' WHEN cu > st * 3 THEN 'curly' WHEN st > cu * 3 THEN 'straight' ELSE 'mixed' END AS quotes,
        CASE WHEN em = 0 AND dh = 0 AND en = 0 THEN 'none' WHEN em >= dh AND em >= en THEN 'em' WHEN dh >= en THEN 'double-hyphen'
             ELSE 'spaced-en' END AS dashes, coalesce(k / n > 0.4, false) AS indented
        FROM cnt c LEFT JOIN h1 USING (doc_id) LEFT JOIN brk1 USING (doc_id) LEFT JOIN ind USING (doc_id))"""


# --- classification --------------------------------------------------------------


def feature_ctes(source: str = "library") -> str:
    """CTE ``feat`` with the counts and ratios of each document."""
    line = lambda p, ic: f"count(*) FILTER ({Q.has('line', p, ic)})"
    return f"""
    fl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {source}),
    fc AS (SELECT doc_id, count(*) AS lines, {line(L.BULLET_LINE, False)} AS bullets, {line(L.HEADING_LINE, False)} AS headings,
        {line(L.FIELD_LINE, False)} AS fields, {line(L.DATE_LINE, True)} AS dates FROM fl WHERE {Q.trim('line')} <> '' GROUP BY doc_id),
    fp AS (SELECT doc_id, count(*) AS pars, count(*) FILTER (n >= 40) AS longp FROM
        (SELECT doc_id, {Q.n_words('p')} AS n FROM (SELECT doc_id, unnest({Q.paragraphs('text')}) AS p FROM {source})) GROUP BY doc_id),
    fs AS (SELECT doc_id, sum({Q.n_words('s')}) AS spoken FROM (SELECT doc_id, unnest({Q.spoken('text')}) AS s FROM {source}) GROUP BY doc_id),
    fr AS (SELECT l.*, {Q.n_words('text')} AS words, {Q.hits('text', L.CHAPTER_HEADING, True, True)} AS chap,
        coalesce(headings, 0) AS headings, coalesce(dates, 0) AS dates,
        {Q.div('bullets', 'lines')} AS br, {Q.div('fields', 'lines')} AS fr, {Q.div('dates', 'lines')} AS dr,
        coalesce(spoken, 0) AS spoken, {Q.div('coalesce(longp, 0)', 'coalesce(pars, 0)')} AS lp
        FROM {source} l LEFT JOIN fc USING (doc_id) LEFT JOIN fp USING (doc_id) LEFT JOIN fs USING (doc_id)),
    feat AS (SELECT *, {Q.div('spoken', 'words')} AS ds, br < 0.2 AND fr < 0.15 AND ({Q.div('spoken', 'words')} > 0.03 OR lp > 0.25)
        AS prose FROM fr)"""


def signal_ctes() -> str:
    """CTE ``sig(doc_id, n, kind, weight)``; needs ``feat``."""
    hay = "(path || ' ' || name)"
    rows = [(k, w, Q.has(hay, p)) for k, p, w in L.NAME_SIGNALS]
    rows += [(k, w, Q.has("path", p)) for k, p, w in L.PATH_SIGNALS]
    scale = "CASE WHEN words > 3000 THEN 3.0 WHEN words > 800 THEN 1.5 ELSE 0.75 END"
    rows += [
        ("past_book", scale, "prose"), ("reference_book", f"({scale}) * CAST(0.66 AS DOUBLE)", "prose"),
        ("characters", 5.0, f"{Q.has(Q.trim('name'), L.PERSON_NAME, False)} AND chap < 3"),
        ("past_book", 2.0, "chap >= 3"), ("reference_book", 1.0, "chap >= 3"), ("characters", 3.0, "fr > 0.15"),
        ("plot", 1.5, "br > 0.3"), ("notes", 1.0, "br > 0.3"), ("notes", 1.5, "br > 0.08"), ("timeline", 3.0, "dr > 0.2"),
        ("world", 1.5, "headings > 5 AND br > 0.15 AND NOT prose"),
    ]
    rows += [(k, w, f"{Q.hits('lower(text)', p, False)} >= 3") for k, p, w, _ in L.VOCABULARY_SIGNALS]
    rows += [("reference_book", 2.5, Q.has("text", L.BYLINE, False))]
    return "sig AS (" + " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, '{k}' AS kind, CAST({w} AS DOUBLE) AS weight FROM feat WHERE {c}"
        for n, (k, w, c) in enumerate(rows)) + ")"


def classify_ctes() -> str:
    kinds = ", ".join(f"({i}, '{k}')" for i, k in enumerate(L.KINDS))
    hay = "(path || ' ' || name)"
    return f"""{feature_ctes()}, {signal_ctes()},
    kinds(ko, kind) AS (VALUES {kinds}),
    sc AS (SELECT f.doc_id, k.kind, k.ko, CASE WHEN k.kind = 'notes' THEN 0.5 ELSE 0.0 END + coalesce(sum(weight ORDER BY n), 0) AS s
        FROM feat f CROSS JOIN kinds k LEFT JOIN sig ON sig.doc_id = f.doc_id AND sig.kind = k.kind GROUP BY f.doc_id, k.kind, k.ko),
    rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, ko) AS r FROM sc),
    tp AS (SELECT doc_id, max(kind) FILTER (r = 1) AS top, max(s) FILTER (r = 1) AS ts, max(kind) FILTER (r = 2) AS alt,
        max(s) FILTER (r = 2) AS a FROM rk GROUP BY doc_id),
    cls AS (SELECT f.doc_id, f.book_id, top AS kind,
        {Q.rnd("greatest(CAST(0.15 AS DOUBLE), least(CAST(0.98 AS DOUBLE), least(ts / 6.0, 1.0) * CAST(0.6 AS DOUBLE) + (CASE WHEN ts > 0 THEN (ts - a) / ts ELSE 0 END) * CAST(0.4 AS DOUBLE)))")} AS confidence,
        CASE WHEN a > 0 THEN alt END AS alternative,
        concat_ws('|', top, CASE WHEN top <> 'timeline' AND dr > 0.08 THEN 'timeline' END,
          CASE WHEN top <> 'plot' AND (br > 0.08 OR {Q.has(hay, L.OUTLINE_WORDS)}) THEN 'plot' END,
          CASE WHEN top <> 'notes' AND br > 0.08 AND NOT prose THEN 'notes' END) AS suggested
        FROM feat f JOIN tp USING (doc_id))"""
