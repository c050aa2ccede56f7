"""Queries: continuity ledger, logs and run events, batch and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import continuity as N
from ..operators import metrics, score
from ..session import cut_lineage, shared_dir
from ..sources import artifacts
from ..streaming import events as E
from ..streaming import jobs as J
from ..streaming import ordered as O
from ..streaming import sinks
from . import tables as X
from .checks import sql as Q
from .registry import query

DR, EV = Q.drafts_cte(), Q.events_cte()


# --- continuity ---------------------------------------------------------------------

_W = Q.words("text")


def _led() -> str:
    word = lambda i: f"coalesce(w[{i + 1}], 'nowhere')"
    last = "coalesce(w[-1], 'nothing')"
    cond = f"CASE WHEN turn % 2 = 0 THEN {last} ELSE '' END"
    person = lambda no, name, place, knows: (
        f"SELECT conv_id AS book_id, turn + 1 AS chapter, {no} AS c_no, {name} AS name, {place} AS location, {knows} AS knows, "
        f"{cond} AS condition FROM tw")
    return f"""{DR}, tw AS (SELECT *, {_W} AS w FROM conversations),
ho AS (SELECT conv_id AS book_id, turn + 1 AS chapter, {word(0)} AS loc, turn * 3 % 5 + 1 AS day, turn % 4 = 3 AS flash,
  array_to_string(list_slice(w, 1, 8), ' ') AS question, {word(2)} AS closing FROM tw),
pe AS ({person(0, 'role', word(0), f"[concat_ws(' ', {word(1)}, {word(2)})]")} UNION ALL
  {person(1, "'Guide'", word(2), f"[{word(3)}, {word(5)}]")} UNION ALL {person(2, "'user'", word(4), f"[{word(3)}]")}),
nz AS (SELECT d.*, {_W} AS w, array_to_string(list_slice({_W}, 1, 250), ' ') AS opening FROM drafts d)"""


def _norm(x: str) -> str:
    return Q.trim(Q.sub(f"lower({x})", r"\s+", " "))


def _mentions(t: str, p: str) -> str:
    return f"({Q.trim(p)} <> '' AND contains({_norm(t)}, {_norm(p)}))"


def _touch(w: str, q: str) -> str:
    terms = f"list_filter({Q.words(q)}, lambda z: length(z) > 4)"
    hit = f"len(list_filter({terms}, lambda z: list_contains({w}, z)))"
    return f"(len({terms}) = 0 OR CAST({hit} AS DOUBLE) / len({terms}) >= 0.4)"


def _handoffs(spark, sf):
    return N.latest_handoffs(X.handoffs(spark, sf))


@query("con1_latest_handoffs", f"WITH {_led()} SELECT book_id, chapter, 'Turn ' || (chapter - 1) AS title, "
                               f"loc AS ends_at_location FROM ho")
def con1(spark, sf):
    return _handoffs(spark, sf).select("book_id", "chapter", "title", "ends_at_location")


@query("con1_chapters_complete", "SELECT conv_id AS book_id, max(turn) + 1 AS chapters_complete FROM conversations GROUP BY conv_id")
def con1_complete(spark, sf):
    return N.chapters_complete(X.handoffs(spark, sf))


_STATE = """lat AS (SELECT book_id, lower(name) AS name_key, arg_max(struct_pack(location := location, knows := knows, chapter := chapter),
  chapter * 10 + c_no) AS s FROM pe GROUP BY book_id, lower(name))"""


@query("con2_latest_states", f"WITH {_led()}, {_STATE} SELECT book_id, name_key, s.location AS location, "
                             f"array_to_string(s.knows, '|') AS knows, CAST(s.chapter AS BIGINT) AS last_seen FROM lat")
def con2(spark, sf):
    return N.latest_states(_handoffs(spark, sf)).select(
        "book_id", "name_key", "state.location", F.array_join("state.knows", "|").alias("knows"),
        F.col("state.last_seen_chapter").cast("long").alias("last_seen"))


@query("con3_previous", f"WITH {_led()} SELECT d.book_id, d.chapter, h.loc AS location, h.question FROM drafts d JOIN ho h "
                        f"ON h.book_id = d.book_id AND h.chapter = d.chapter - 1")
def con3(spark, sf):
    prev = N.previous_handoffs(_handoffs(spark, sf))
    return X.drafts(spark, sf).join(prev, ["book_id", "chapter"]).select(
        "book_id", "chapter", F.col("prev_ends_at_location").alias("location"),
        F.col("prev_open_question").alias("question"))


_PAIR = f"""pp AS (SELECT n.book_id, n.chapter, n.text, n.opening, p.name, p.location AS was, p.condition AS had, h.loc AS place,
    (SELECT arg_min(struct_pack(location := c.location, condition := c.condition), c.c_no) FROM pe c
     WHERE c.book_id = n.book_id AND c.chapter = n.chapter AND lower(c.name) = lower(p.name)) AS cl
  FROM nz n JOIN ho h ON h.book_id = n.book_id AND h.chapter = n.chapter - 1
  JOIN pe p ON p.book_id = n.book_id AND p.chapter = n.chapter - 1),
act AS (SELECT * FROM pp WHERE cl IS NOT NULL AND {_mentions('opening', 'name')})"""


def _issues(spark, sf):
    drafts, h = X.drafts(spark, sf), _handoffs(spark, sf)
    return N.handoff_issues(drafts, h, h)


def _kind(kind: str):
    return lambda spark, sf: _issues(spark, sf).where(F.col("kind") == kind).select(
        "book_id", "chapter", "severity", "subject")


query("con4_location_jump", f"""WITH {_led()}, {_PAIR} SELECT book_id, chapter, 'blocker' AS severity, name AS subject FROM act
WHERE {_norm('cl.location')} <> {_norm('was')} AND NOT {_mentions('opening', 'place')} AND NOT {Q.has('text', L.TRANSIT)}""")(
    _kind("location-jump"))
query("con5_condition_ignored", f"""WITH {_led()}, {_PAIR} SELECT book_id, chapter, 'major' AS severity, name AS subject FROM act
WHERE had <> '' AND cl.condition = '' AND NOT {_mentions('text', 'had')}""")(_kind("condition-ignored"))
query("con6_timeline_regression", f"""WITH {_led()} SELECT c.book_id, c.chapter, 'blocker' AS severity, CAST(c.day AS VARCHAR) AS subject
FROM ho c JOIN ho p ON p.book_id = c.book_id AND p.chapter = c.chapter - 1 WHERE NOT c.flash AND c.day < p.day""")(
    _kind("timeline-regression"))
query("con7_dropped_hook", f"""WITH {_led()} SELECT n.book_id, n.chapter, 'major' AS severity, h.question AS subject
FROM nz n JOIN ho h ON h.book_id = n.book_id AND h.chapter = n.chapter - 1
WHERE h.question <> '' AND NOT {_touch('n.w', 'h.question')}""")(_kind("dropped-hook"))


# The ledger a chapter is judged by ends with the chapter before it.
@query("con8_knowledge_violation", f"""WITH {_led()}, prior AS (
  SELECT p.book_id, p.chapter, p.c_no, p.name, p.knows, arg_max(q.knows, q.chapter * 10 + q.c_no) AS known
  FROM pe p JOIN pe q ON q.book_id = p.book_id AND lower(q.name) = lower(p.name) AND q.chapter <= p.chapter - 1
  GROUP BY p.book_id, p.chapter, p.c_no, p.name, p.knows),
kn AS (SELECT book_id, chapter, name, unnest(knows) AS fact, known FROM prior)
SELECT k.book_id, k.chapter, name, fact FROM kn k JOIN drafts d ON d.book_id = k.book_id AND d.chapter = k.chapter
WHERE NOT list_contains(known, fact) AND NOT {_mentions('text', 'fact')}""")
def con8(spark, sf):
    drafts, h = X.drafts(spark, sf), _handoffs(spark, sf)
    out = N.knowledge_issues(drafts, h, h)
    return out.select("book_id", "chapter", F.regexp_extract("message", '^(.*) has learned "', 1).alias("name"),
                      F.col("subject").alias("fact"))


_TH = f"""th AS (SELECT conv_id AS book_id, conv_id || '-' || turn AS thread_id, array_to_string(list_slice(w, 1, 8), ' ') AS question,
  turn + 1 AS last, ['open','advanced','open','resolved','abandoned'][CAST((turn + conv_id) % 5 AS INT) + 1] AS status,
  CASE WHEN conv_id % 3 = 0 THEN turn + 2 END AS due,
  ['main','subplot','minor'][CAST((turn + conv_id) % 3 AS INT) + 1] AS weight FROM tw WHERE turn % 2 = 0),
tp AS (SELECT n.book_id, n.chapter, n.w, th.* EXCLUDE (book_id), coalesce(n.chapter > due, false) AS late,
  n.chapter - last >= CASE weight WHEN 'main' THEN 3 WHEN 'subplot' THEN 5 ELSE 8 END AS cold
  FROM nz n JOIN th ON th.book_id = n.book_id WHERE status NOT IN ('resolved', 'abandoned'))"""


@query("con9_overdue_thread", f"WITH {_led()}, {_TH} SELECT book_id, chapter, thread_id FROM tp WHERE late")
def con9(spark, sf):
    out = N.thread_issues(X.drafts(spark, sf), X.threads(spark, sf))
    return out.where(F.col("kind") == "overdue-thread").select("book_id", "chapter", F.col("pos").alias("thread_id"))


@query("con10_stale_thread", f"""WITH {_led()}, {_TH} SELECT book_id, chapter, thread_id,
  CASE WHEN weight = 'main' THEN 'major' ELSE 'minor' END AS severity FROM tp WHERE NOT late AND cold AND NOT {_touch('w', 'question')}""")
def con10(spark, sf):
    out = N.thread_issues(X.drafts(spark, sf), X.threads(spark, sf))
    return out.where(F.col("kind") == "stale-thread").select(
        "book_id", "chapter", F.col("pos").alias("thread_id"), "severity")


_PR = """hd AS (SELECT conv_id AS book_id, max(turn) + 1 AS planned FROM conversations GROUP BY conv_id),
pm AS (SELECT conv_id AS book_id, conv_id || '-' || turn AS promise_id, turn + 1 AS planted,
  array_to_string(list_slice(w, 1, 5), ' ') AS setup FROM tw WHERE turn % 3 = 0 AND conv_id % 2 = 1)"""


@query("con11_unpaid_promise", f"""WITH {_led()}, {_PR} SELECT d.book_id, d.chapter, promise_id,
  CASE WHEN planned - chapter <= 0 THEN 'blocker' ELSE 'major' END AS severity
FROM drafts d JOIN hd USING (book_id) JOIN pm USING (book_id) WHERE planned - chapter <= 2""")
def con11(spark, sf):
    out = N.promise_issues(X.drafts(spark, sf), X.promises(spark, sf), X.heads(spark, sf))
    return out.select("book_id", "chapter", F.col("pos").alias("promise_id"), "severity")


def _all_issues(spark, sf):
    drafts, h = X.drafts(spark, sf), _handoffs(spark, sf)
    return drafts, N.flow_issues(drafts, h, h, X.threads(spark, sf), X.promises(spark, sf), X.heads(spark, sf))


def _flow_sql() -> str:
    from .registry import CHECKS

    def body(name: str, severity: str) -> str:
        return f"SELECT book_id, chapter, {severity} AS severity FROM ({CHECKS[name]})"

    parts = [body(n, "severity") for n in ("con4_location_jump", "con5_condition_ignored", "con6_timeline_regression",
                                           "con7_dropped_hook", "con10_stale_thread", "con11_unpaid_promise")]
    parts += [body("con8_knowledge_violation", "'major'"), body("con9_overdue_thread", "'blocker'")]
    return " UNION ALL ".join(parts)


_FLOW = f"""fi AS ({_flow_sql()}), fv AS (SELECT d.book_id, d.chapter, count(severity) FILTER (severity = 'blocker') AS blockers,
  count(severity) FILTER (severity = 'major') AS majors, count(severity) FILTER (severity = 'minor') AS minors
  FROM (SELECT conv_id AS book_id, turn + 1 AS chapter FROM conversations) d LEFT JOIN fi ON fi.book_id = d.book_id
  AND fi.chapter = d.chapter GROUP BY d.book_id, d.chapter)"""
_VERDICT = "CASE WHEN blockers > 0 THEN 'fail' WHEN majors > 0 THEN 'revise' ELSE 'pass' END"


@query("con12_verdicts", f"WITH {_FLOW} SELECT *, {_VERDICT} AS verdict FROM fv")
def con12(spark, sf):
    return N.flow_reports(*_all_issues(spark, sf))


@query("con13_obligations", f"""WITH {_led()}, {_PR}, {_TH}, pv AS (
  SELECT h.book_id, h.chapter + 1 AS chapter, unnest(['location', 'time', 'closing beat', 'open question']) AS subject FROM ho h)
SELECT d.book_id, chapter, 'canon' AS section, unnest(['Canon of ' || d.book_id, 'The gate stays shut']) AS subject FROM drafts d
  WHERE book_id % 2 = 0
UNION ALL SELECT d.book_id, d.chapter, 'previous', subject FROM drafts d JOIN pv USING (book_id, chapter)
UNION ALL SELECT d.book_id, d.chapter, 'character', name FROM drafts d JOIN pe h ON h.book_id = d.book_id AND h.chapter = d.chapter - 1
UNION ALL SELECT d.book_id, d.chapter, 'thread', question FROM drafts d JOIN th ON th.book_id = d.book_id
  AND status IN ('open', 'advanced') AND th.last < d.chapter
UNION ALL SELECT d.book_id, d.chapter, 'promise', setup FROM drafts d JOIN pm ON pm.book_id = d.book_id AND pm.planted < d.chapter""")
def con13(spark, sf):
    rows = N.obligations(X.drafts(spark, sf), _handoffs(spark, sf), X.threads(spark, sf), X.promises(spark, sf),
                         X.heads(spark, sf))
    return rows.select("book_id", "chapter", "section", "subject")


def _gate_sql() -> str:
    """Style reports of the chapters against their own book, beside the continuity verdicts."""
    from .queries_text import _FID, _SAID, STORY

    fid = _FID.replace(f"{STORY}, ", "").replace("stories", "dd")
    return f"""{DR}, {_FLOW}, dd AS (SELECT book_id * 100000 + chapter AS doc_id, book_id, chapter, text FROM drafts), {fid}, {_SAID},
ln AS (SELECT doc_id, count(*) AS n FROM loud GROUP BY doc_id),
gt AS (SELECT v.*, fidelity, word_count, coalesce(n, 0) AS said FROM fv v
  JOIN dd ON dd.book_id = v.book_id AND dd.chapter = v.chapter JOIN fid ON fid.doc_id = dd.doc_id LEFT JOIN ln ON ln.doc_id = dd.doc_id)"""


@query("con14_chapter_gate", f"""WITH {_gate_sql()} SELECT book_id, chapter, {_VERDICT} AS flow_verdict, fidelity, word_count,
  CASE WHEN fidelity >= 80 AND blockers = 0 AND majors = 0 THEN 'validated' ELSE 'needs_work' END AS status,
  CAST(blockers + majors + minors + said AS BIGINT) AS n_issues FROM gt""")
def con14(spark, sf):
    drafts, issues = _all_issues(spark, sf)
    status = drafts.select("book_id", "chapter", F.lit("drafted").alias("status"))
    measured = cut_lineage(score.measured_drafts(drafts, ["book_id", "chapter"]))
    styles = score.reports(
        measured, metrics.fingerprints(measured, ["book_id"]), ["book_id", "chapter"], ["book_id"],
        columns=("word_count", "fidelity", "verdict", "instructions"))
    gate = N.chapter_gate(status, N.flow_reports(drafts, issues), issues, styles)
    return gate.select(
        "book_id", "chapter", "flow_verdict", "fidelity", "word_count", "status", F.size("issues").cast("long").alias("n_issues"))


# --- logs -------------------------------------------------------------------------------

_ERR = """err AS (SELECT user_id AS book_id, event_id AS entry_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS tat,
  CASE WHEN value > 30 THEN 'settings.json is not valid JSON' ELSE 'tool failed' END AS error_message,
  CASE WHEN event_id % 7 = 0 THEN '2024-01-01T00:00:00' END AS resolved_at,
  CASE WHEN event_id % 7 = 0 THEN 'earlier fix' END AS resolution FROM events WHERE event_type = 'error')"""


@query("src8_log_append_read", f"WITH {_ERR} SELECT CAST(book_id AS VARCHAR) AS book_id, error_message, "
                               f"coalesce(resolution, '') AS resolution, count(*) AS n FROM err GROUP BY ALL")
def src8(spark, sf):
    errors = X.error_log(spark, sf)
    root = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    rows = errors.select(
        F.col("book_id").cast("string").alias("book_id"), F.col("at").alias("timestamp"), "event", "error_message",
        "resolved_at", "resolution")
    artifacts.append_log(rows, root, "error")
    # A torn tail: the last line of another writer was cut.
    torn = errors.limit(1).select(F.lit('{"book_id": "1", "event": "run_er').alias("value"))
    torn.write.mode("append").text(f"{root}/log_kind=error")
    log = artifacts.read_log(spark, root, "error")
    return log.groupBy("book_id", "error_message", F.coalesce("resolution", F.lit("")).alias("resolution")).agg(
        F.count(F.lit(1)).alias("n"))


@query("src10_error_resolution", f"""WITH {_ERR} SELECT entry_id, CASE WHEN resolved_at IS NULL AND error_message LIKE '%not valid JSON'
  THEN 'now valid' ELSE coalesce(resolution, '') END AS resolution, resolved_at IS NULL AND error_message LIKE '%not valid JSON' AS changed FROM err""")
def src10(spark, sf):
    out = artifacts.resolve_errors(
        X.error_log(spark, sf), F.col("error_message").rlike(r"(?i)settings\.json.*not valid JSON"), "now valid",
        F.lit("2024-06-01T00:00:00"))
    return out.select("entry_id", F.coalesce("resolution", F.lit("")).alias("resolution"), "changed")


# --- run events: batch --------------------------------------------------------------------

_NOANSI = "replace(regexp_replace(text, '\x1b?\\[[0-9;]*[A-Za-z]', '', 'g'), chr(13), '')"
_MARK = rf"(?i){L.PROGRESS_MARKER}\s+phase=([a-z_]+)(?:\s+percent=(\d+))?(?:\s+chapter=(\d+))?(?:\s+detail=([^\n\r]*))?"
_CLEANED = f"regexp_replace({_NOANSI}, '{_MARK}', '', 'g')"
_ASSIGNED = next(pattern for name, pattern, _, _ in L.REDACTIONS if name == "assignment")
_CLEANED = Q.trim(Q.raw_sub(_CLEANED, f"(?i){_ASSIGNED}", r"\1=[redacted]"))


@query("str1_normalised", f"WITH {EV}, c AS (SELECT run_id, seq, kind, {_CLEANED} AS text FROM run_events) SELECT * FROM c WHERE text <> ''")
def str1(spark, sf):
    return E.normalise(X.run_events(spark, sf)).select("run_id", "seq", "kind", "text")


@query("str1_retained", f"""WITH {EV} SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS age FROM run_events""")
def str1_retained(spark, sf):
    return E.with_age(X.run_events(spark, sf)).select("run_id", "seq", F.col("age").cast("long").alias("age"))


@query("str2_cursor", f"WITH {EV} SELECT run_id, seq, kind FROM run_events WHERE seq > 500")
def str2(spark, sf):
    return E.since(X.run_events(spark, sf), 500).select("run_id", "seq", "kind")


def _progress_cte() -> str:
    raw = _NOANSI
    rule = " ".join(f"WHEN {Q.has('lower(raw)', p, False)} THEN '{phase}'" for p, phase in L.PROGRESS_RULES)
    pct = " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in L.PROGRESS_PHASES.items())
    return f"""{EV}, p0 AS (SELECT run_id, seq, {raw} AS raw FROM run_events),
p1 AS (SELECT *, lower(regexp_extract(raw, '{_MARK}', 1)) AS m, regexp_extract(raw, '{_MARK}', 2) AS mp,
  regexp_extract(raw, '{_MARK}', 3) AS mc FROM p0),
p2 AS (SELECT *, m IN {Q.listed(L.PROGRESS_PHASES)} AS explicit FROM p1),
p3 AS (SELECT *, CASE WHEN explicit THEN m ELSE CASE {rule} END END AS phase FROM p2),
prog AS (SELECT run_id, seq, explicit, phase, CASE WHEN explicit AND mp <> '' THEN CAST(mp AS BIGINT) ELSE CASE phase {pct} END END AS percent,
  CASE WHEN explicit THEN try_cast(nullif(mc, '') AS BIGINT) WHEN phase IS NOT NULL THEN
    try_cast(nullif(regexp_extract(raw, '(?i)chapter[\\s-]*(\\d+)', 1), '') AS BIGINT) END AS chapter FROM p3)"""


@query("str3_progress", f"WITH {_progress_cte()} SELECT run_id, seq, explicit, coalesce(phase, '') AS phase, "
                        f"CAST(coalesce(percent, -1) AS BIGINT) AS percent, CAST(coalesce(chapter, -1) AS BIGINT) AS chapter FROM prog")
def str3(spark, sf):
    p = E.with_progress(X.run_events(spark, sf))
    num = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(c)
    return p.select("run_id", "seq", "explicit", F.coalesce("phase", F.lit("")).alias("phase"), num("percent"), num("chapter"))


_STATE4 = f"""WITH {_progress_cte()} SELECT run_id, CAST(max(least(percent, 100)) AS BIGINT) AS percent, arg_max(phase, seq) AS phase,
  CAST(coalesce(arg_max(chapter, seq) FILTER (chapter IS NOT NULL), -1) AS BIGINT) AS chapter, max(seq) AS seq
FROM prog WHERE phase IS NOT NULL GROUP BY run_id"""


def _state_columns(df):
    return df.select("run_id", F.col("percent").cast("long").alias("percent"), "phase",
                     F.coalesce("chapter", F.lit(-1)).cast("long").alias("chapter"), "seq")


@query("str4_progress_state", _STATE4)
def str4(spark, sf):
    return _state_columns(E.progress_state(X.run_events(spark, sf)))


@query("str4_progress_history", f"""WITH {_progress_cte()} SELECT run_id, seq, CAST(coalesce(max(least(percent, 100)) OVER w, -1) AS BIGINT) AS run_percent,
  coalesce(last_value(phase IGNORE NULLS) OVER w, '') AS run_phase,
  CAST(coalesce(last_value(chapter IGNORE NULLS) OVER w, -1) AS BIGINT) AS run_chapter
FROM prog WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def str4_history(spark, sf):
    h = E.progress_history(X.run_events(spark, sf))
    num = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(c)
    return h.select("run_id", "seq", num("run_percent"), F.coalesce("run_phase", F.lit("")).alias("run_phase"),
                    num("run_chapter"))


_AGENTS = f"""WITH {EV}, a AS (SELECT run_id, seq, coalesce(session_id, 'orchestrator') AS agent_key,
  CASE WHEN agent IN ('Subagent', 'Orchestrator') THEN NULL ELSE agent END AS name, depth, {Q.has(Q.trim('text'), L.DONE_SIGNAL)} AS done,
  CASE WHEN session_id IS NULL AND {Q.has('text', L.HANDOVER)} THEN 'waiting' ELSE 'working' END AS status, 1 AS step, session_id FROM run_events),
b AS (SELECT run_id, seq, agent_key, name, depth, done, status, step FROM a UNION ALL
  SELECT run_id, seq, 'orchestrator', NULL, 0, false, 'working', 2 FROM a WHERE done AND session_id IS NOT NULL)
SELECT run_id, agent_key, coalesce(arg_max(name, seq) FILTER (name IS NOT NULL),
    CASE WHEN agent_key = 'orchestrator' THEN 'Orchestrator' ELSE 'Subagent' END) AS agent,
  CAST(min(depth) AS BIGINT) AS depth, CASE WHEN bool_or(done) THEN 'done' ELSE arg_max(status, seq * 2 + step) END AS status
FROM b GROUP BY run_id, agent_key"""


def _agent_columns(df):
    return df.select("run_id", "agent_key", "agent", F.col("depth").cast("long").alias("depth"), "status")


@query("str5_agent_status", _AGENTS)
def str5(spark, sf):
    return _agent_columns(E.agent_status(X.run_events(spark, sf)))


_GAP = 6 * 3600


@query("str6_stalls", f"""WITH {EV}, l AS (SELECT *, lag(tat) OVER w AS prev_at, lag(seq) OVER w AS prev_seq,
    coalesce(sum(CASE WHEN session_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED
    PRECEDING AND 1 PRECEDING), 0) AS nested, CASE WHEN {Q.has(Q.trim('text'), L.LOOKUP_LINE)} THEN {Q.trim('text')} END AS look
    FROM run_events WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
g AS (SELECT *, (epoch_us(tat) - epoch_us(prev_at)) / 1000000.0 AS secs FROM l),
k AS (SELECT *, sum(CASE WHEN look IS DISTINCT FROM pl OR prev_seq IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq) AS isl
    FROM (SELECT *, lag(look) OVER (PARTITION BY run_id ORDER BY seq) AS pl FROM g)),
q AS (SELECT run_id, 'lookup' AS kind, min(seq) AS from_seq, max(seq) AS to_seq, (epoch_us(max(tat)) - epoch_us(min(tat))) / 1000000.0 AS secs
    FROM k WHERE look IS NOT NULL GROUP BY run_id, isl)
SELECT run_id, 'parent' AS kind, prev_seq AS from_seq, seq AS to_seq FROM g WHERE secs > {_GAP}
UNION ALL SELECT run_id, 'nested', prev_seq, seq FROM g WHERE secs > {_GAP // 2} AND nested > 0
UNION ALL SELECT run_id, kind, from_seq, to_seq FROM q WHERE secs > {_GAP}""")
def str6(spark, sf):
    return E.stalls(X.run_events(spark, sf), _GAP, _GAP // 2).select("run_id", "kind", "from_seq", "to_seq")


_ISLANDS = f"""{EV}, l AS (SELECT run_id, seq, CASE WHEN prev IS NULL OR epoch_us(tat) - epoch_us(prev) > {_GAP * 1_000_000} THEN 1 ELSE 0 END AS s
    FROM (SELECT *, lag(tat) OVER (PARTITION BY run_id ORDER BY seq) AS prev FROM run_events)),
i AS (SELECT run_id, seq, sum(s) OVER (PARTITION BY run_id ORDER BY seq) AS island FROM l)"""


@query("str6_activity_islands", f"WITH {_ISLANDS} SELECT run_id, CAST(island AS BIGINT) AS island, min(seq) AS first_seq, "
                                f"max(seq) AS last_seq, count(*) AS n FROM i GROUP BY run_id, island")
def str6_islands(spark, sf):
    return E.quiet_sessions(X.run_events(spark, sf), _GAP)


def _parts(df, *more):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return df.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("part_key"), F.col("event_id").alias("seq"),
                     F.repeat(F.lit("word "), k % 4).alias("text"), *more)


@query("str7_text_deltas", """WITH p AS (SELECT user_id AS run_id, event_type AS part_key, event_id AS seq,
    repeat('word ', CAST(json_extract(props, '$.k') AS BIGINT) % 4) AS text FROM events),
l AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY run_id, part_key ORDER BY seq), '') AS prev FROM p),
d AS (SELECT *, CASE WHEN starts_with(text, prev) THEN trim(substr(text, length(prev) + 1)) ELSE text END AS delta FROM l WHERE text <> prev)
SELECT run_id, part_key, seq, delta FROM d WHERE delta <> ''""")
def str7(spark, sf):
    return E.text_deltas(_parts(X.given(spark, sf, "events")))


_HALT = " ".join(f"WHEN bool_or({Q.has('text', p)}) THEN '{n}'" for p, n in L.HALT_RULES)


@query("str8_halt_reason", f"""WITH {EV} SELECT run_id, CASE {_HALT} ELSE 'other' END AS reason FROM run_events GROUP BY run_id""")
def str8(spark, sf):
    return E.halt_reasons(X.run_events(spark, sf))


@query("str9_history_agents", f"""WITH {EV} SELECT run_id, coalesce(session_id, 'orchestrator') AS agent_key,
  coalesce(arg_max(struct_pack(a := agent), seq).a, CASE WHEN coalesce(session_id, 'orchestrator') = 'orchestrator' THEN 'Orchestrator' ELSE 'Subagent' END) AS agent,
  CAST(arg_max(depth, seq) AS BIGINT) AS depth, 'done' AS status FROM run_events WHERE seq % 3 > 0 GROUP BY run_id, session_id""")
def str9(spark, sf):
    ev = X.run_events(spark, sf)
    log = ev.select(
        "run_id", F.when(F.col("seq") % 3 > 0, "runtime_message").otherwise("phase_started").alias("event"),
        F.col("at").cast("string").alias("timestamp"), F.col("text").alias("message"),
        F.to_json(F.struct("kind", "seq", F.col("session_id").alias("sessionId"), "agent", "depth")).alias("data"))
    return _agent_columns(E.history_agents(E.history(log)))


def _transcript(spark, sf):
    """Conversation turns as transcript lines: calls, results and broken lines."""
    turns = X.given(spark, sf, "conversations")
    t = F.col("turn")
    call = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(
        F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"),
                 F.col("text"), F.lit(None).cast(E_INPUT).alias("input")),
        F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), t.cast("string")).alias("id"), F.lit("Task").alias("name"),
                 F.lit(None).cast("string").alias("text"),
                 F.struct(F.lit("Editor").alias("subagent_type"), F.lit("trim it").alias("description")).alias("input")),
    ).alias("content")).alias("message")))
    result = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.array(F.struct(
        F.lit("tool_result").alias("type"), F.concat(F.lit("t"), (t - 1).cast("string")).alias("tool_use_id"),
        (t % 3 == 0).alias("is_error"), F.lit("boom").alias("content"))).alias("content")).alias("message")))
    line = F.when(t % 4 == 1, result).when(t % 4 == 3, F.lit("plain words, not json")).otherwise(call)
    return turns.select(F.col("conv_id").alias("run_id"), t.alias("line_no"), line.alias("line"))


E_INPUT = "struct<subagent_type:string,description:string>"


_SQUEEZED = Q.trim(Q.sub("text", r"\s+", " "))


@query("str10_transcript_events", f"""WITH t AS (SELECT conv_id AS run_id, turn AS line_no, turn % 4 AS m, {_SQUEEZED} AS said FROM conversations)
SELECT run_id, line_no, 0 AS part, 'note' AS kind, said AS text, NULL AS session_id, NULL AS agent, false AS done FROM t
  WHERE m IN (0, 2) AND said <> ''
UNION ALL SELECT run_id, line_no, CASE WHEN said = '' THEN 0 ELSE 1 END, 'step', 'Handing over to Editor: trim it.', 't' || line_no, 'Editor', false
  FROM t WHERE m IN (0, 2)
UNION ALL SELECT run_id, line_no, 0, 'error', 'A step failed: boom', NULL, NULL, false FROM t WHERE m = 1 AND line_no % 3 = 0
UNION ALL SELECT run_id, line_no, 0, 'note', 'plain words, not json', NULL, NULL, false FROM t WHERE m = 3""")
def str10(spark, sf):
    return E.transcript_events(_transcript(spark, sf))


@query("str10_delegated_sessions", """WITH t AS (SELECT conv_id AS run_id, turn FROM conversations)
SELECT a.run_id, 't' || a.turn AS session_id, CASE WHEN b.turn IS NULL THEN 'working' ELSE 'done' END AS status
FROM t a LEFT JOIN t b ON a.run_id = b.run_id AND b.turn = a.turn + 1 AND b.turn % 4 = 1 WHERE a.turn % 4 IN (0, 2)""")
def str10_sessions(spark, sf):
    return E.delegated_sessions(_transcript(spark, sf)).select("run_id", "session_id", "status")


# --- run events: streaming ----------------------------------------------------------------------


def _stream(spark, sf):
    schema = X.given(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return X.event_columns(raw)


def _run(spark, stream, mode):
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    J.run_available(stream, f"{root}/table", f"{root}/checkpoint", mode)
    return f"{root}/table"


@query("str1_stream_normalised",
       f"WITH {EV}, c AS (SELECT run_id, seq, {_CLEANED} AS text FROM run_events) SELECT * FROM c WHERE text <> ''")
def str1_stream(spark, sf):
    out = _run(spark, J.normalised(_stream(spark, sf)).select("run_id", "seq", "text"), "append")
    return spark.read.parquet(out)


def _current(spark, stream, keys, merge, partial):
    """Rows of an upsert sink after all that is there now."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    sinks.run_batches(stream, sinks.upsert(f"{root}/table", keys, merge, partial), f"{root}/checkpoint")
    return sinks.read_current(spark, f"{root}/table")


@query("str4_stream_progress", _STATE4)
def str4_stream(spark, sf):
    return _state_columns(E.progress_rows(_current(spark, _stream(spark, sf), ["run_id"], E.merge_progress, E.progress_parts)))


@query("str5_stream_agents", _AGENTS)
def str5_stream(spark, sf):
    rows = _current(spark, _stream(spark, sf), ["run_id", "agent_key"], E.merge_agents, E.agent_parts)
    return _agent_columns(E.agent_states(rows))


# Arrival in eight files by time, every fifth event two files late.
_ARRIVED = """span AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) - min(epoch_us(ts)) + 1 AS w FROM events),
arrived AS (SELECT event_id AS seq, epoch_us(ts) AS us, least(7, (epoch_us(ts) - a) * 8 // w + CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END) AS file
  FROM events, span),
seen AS (SELECT file, max(max(us)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM arrived GROUP BY file)"""


def _arrivals(spark, sf):
    """The events as a stream of eight files, some rows behind their time."""
    events = X.run_events(spark, sf)
    us = F.unix_micros("at")
    span = events.agg(F.min(us).alias("_a"), (F.max(us) - F.min(us) + 1).alias("_w"))
    late = F.when(F.col("seq") % 5 == 0, 2).otherwise(0)
    file = F.least(F.lit(7), F.floor((us - F.col("_a")) * 8 / F.col("_w")) + late).cast("int")
    # One row of two numbers meets every event.
    placed = cut_lineage(events.join(F.broadcast(span)).withColumn("file", file).drop("_a", "_w"))
    folder = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    for n in range(8):
        placed.where(F.col("file") == n).drop("file").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(J.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@query("str1_late_rows", f"""WITH {_ARRIVED} SELECT seq, coalesce(us < before - 600000000, false) AS late
FROM arrived JOIN seen USING (file)""")
def str1_late(spark, sf):
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    sinks.run_batches(_arrivals(spark, sf), sinks.split_late(root, E.WATERMARK), f"{root}/checkpoint")
    sides = [sinks.read_side(spark, root, late).select("seq", F.lit(late).alias("late")) for late in (False, True)]
    return sides[0].unionByName(sides[1])


# The time up to which a stream of all events has decided.
_UNTIL = "(SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events)"


@query("str5_stream_changes", f"""WITH {EV}, a AS (SELECT run_id, epoch_us(tat) // 1000 AS ms, seq * 2 + 1 AS ord, session_id,
    coalesce(session_id, 'orchestrator') AS agent_key, {Q.has(Q.trim('text'), L.DONE_SIGNAL)} AS done,
    CASE WHEN session_id IS NULL AND {Q.has('text', L.HANDOVER)} THEN 'waiting' ELSE 'working' END AS status FROM run_events),
b AS (SELECT run_id, agent_key, ms, ord, done, status FROM a UNION ALL
  SELECT run_id, 'orchestrator', ms, ord + 1, false, 'working' FROM a WHERE done AND session_id IS NOT NULL),
c AS (SELECT *, CASE WHEN bool_or(done) OVER (w ROWS UNBOUNDED PRECEDING) THEN 'done' ELSE status END AS now FROM b WHERE ms <= {_UNTIL}
  WINDOW w AS (PARTITION BY run_id, agent_key ORDER BY ord)),
d AS (SELECT *, coalesce(lag(now) OVER w, '') AS before, lag(ms) OVER w AS prev_ms, lead(ms) OVER w AS next_ms FROM c
  WINDOW w AS (PARTITION BY run_id, agent_key ORDER BY ord)),
e AS (SELECT *, before = 'working' AND ms - prev_ms > {_GAP * 1000} AS rested FROM d)
SELECT run_id, agent_key, prev_ms + {_GAP * 1000} AS ms, 'waiting' AS status FROM e WHERE rested UNION ALL
SELECT run_id, agent_key, ms, now FROM e WHERE now <> CASE WHEN rested THEN 'waiting' ELSE before END UNION ALL
SELECT run_id, agent_key, ms + {_GAP * 1000}, 'waiting' FROM e WHERE next_ms IS NULL AND now = 'working' AND ms + {_GAP * 1000} < {_UNTIL}""")
def str5_changes(spark, sf):
    out = _run(spark, O.agent_changes(_stream(spark, sf), _GAP), "append")
    return spark.read.parquet(out)


@query("str6_stream_alarms", f"""WITH {EV}, a AS (SELECT run_id, seq, epoch_us(tat) // 1000 AS ms, session_id IS NOT NULL AS nested FROM run_events),
b AS (SELECT *, bool_or(nested) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS delegated,
  coalesce(lead(ms) OVER (PARTITION BY run_id ORDER BY seq), {_UNTIL}) - ms AS quiet FROM a WHERE ms <= {_UNTIL})
SELECT run_id, 'parent' AS kind, seq AS last_seq, ms AS quiet_since_ms FROM b WHERE quiet > {L.STALL_MINUTES * 60_000} UNION ALL
SELECT run_id, 'nested', seq, ms FROM b WHERE delegated AND quiet > {L.NESTED_STALL_MINUTES * 60_000}""")
def str6_alarms(spark, sf):
    out = _run(spark, O.run_alarms(_stream(spark, sf)), "append")
    return spark.read.parquet(out)


@query("str7_stream_deltas", f"""WITH p AS (SELECT user_id AS run_id, event_type AS part_key, event_id AS seq,
    repeat('word ', CAST(json_extract(props, '$.k') AS BIGINT) % 4) AS text FROM events WHERE epoch_us(ts) // 1000 <= {_UNTIL}),
l AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY run_id, part_key ORDER BY seq), '') AS prev FROM p),
d AS (SELECT *, CASE WHEN starts_with(text, prev) THEN trim(substr(text, length(prev) + 1)) ELSE text END AS delta FROM l WHERE text <> prev)
SELECT run_id, part_key, seq, delta FROM d WHERE delta <> ''""")
def str7_stream(spark, sf):
    schema = X.given(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    parts = _parts(raw.withColumn("at", F.col("ts").cast("timestamp")), "at")
    return spark.read.parquet(_run(spark, O.text_deltas(parts), "append"))


@query("str6_stream_sessions", f"""WITH {_ISLANDS}, s AS (SELECT i.run_id, island, min(i.seq) AS first_seq, max(i.seq) AS last_seq, count(*) AS n,
    max(epoch_us(tat)) AS last_us FROM i JOIN run_events USING (seq) GROUP BY i.run_id, island)
SELECT run_id, first_seq, last_seq, n FROM s WHERE last_us + {_GAP * 1_000_000} <= (SELECT max(epoch_us(ts)) FROM events) - 600 * 1000000""")
def str6_stream(spark, sf):
    out = _run(spark, J.sessions(_stream(spark, sf), f"{_GAP} seconds"), "append")
    return spark.read.parquet(out).select("run_id", "first_seq", "last_seq", "n")
