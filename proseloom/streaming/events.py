"""Run events: projections that work on a batch table and on a stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.patterns import java
from ..functions.scalar import first_match, matches, replace_all, rows, sealed, trim
from ..operators.clean import redact
from ..operators.running import running

WATERMARK = "10 minutes"


def _marker(marker: str) -> str:
    return (
        "(?i)" + marker + java(r"\s+phase=([a-z_]+)(?:\s+percent=(\d+))?(?:\s+chapter=(\d+))?(?:\s+detail=([^\n\r]*))?")
    )


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, L.ANSI_CODES, ""), "\r", "")


def is_done(text: Column) -> Column:
    return matches(trim(text), L.DONE_SIGNAL)


def with_progress(events: DataFrame, marker: str = L.PROGRESS_MARKER) -> DataFrame:
    """Add ``phase``, ``percent``, ``detail``, ``chapter`` and ``explicit``.

    An explicit marker wins; otherwise the first of seven keyword rules.
    """
    pattern = _marker(marker)
    raw = strip_ansi(F.col("text"))
    named = F.lower(F.regexp_extract(raw, pattern, 1))
    explicit = named.isin(list(L.PROGRESS_PHASES))
    inferred = F.lit(None).cast("string")
    for rule, phase in reversed(L.PROGRESS_RULES):
        inferred = F.when(matches(F.lower(raw), rule, False), phase).otherwise(inferred)
    found = sealed(
        events, events.columns, [explicit.alias("explicit"), F.when(explicit, named).otherwise(inferred).alias("phase")]
    )
    pairs = lambda i: F.create_map(*[F.lit(x) for k, v in L.PROGRESS_PHASES.items() for x in (k, v[i])])
    field = lambda i: F.nullif(F.regexp_extract(raw, pattern, i), F.lit(""))
    known = F.col("phase").isNotNull()
    default, label = F.try_element_at(pairs(1), F.col("phase")), F.try_element_at(pairs(0), F.col("phase"))
    spoken = trim(F.coalesce(field(4), label))
    return found.withColumns(
        {
            "percent": F.when(F.col("explicit"), F.coalesce(field(2).try_cast("int"), default)).otherwise(default),
            "chapter": F.when(F.col("explicit"), field(3).try_cast("int")).when(
                known, F.nullif(first_match(raw, L.EVENT_CHAPTER, 1, True), F.lit("")).try_cast("int")
            ),
            "detail": redact(F.when(F.col("explicit"), spoken).when(known, trim(raw))),
        }
    )


def normalise(events: DataFrame, marker: str = L.PROGRESS_MARKER) -> DataFrame:
    """Clean event text: codes, markers and secrets out, empty rows dropped."""
    text = F.regexp_replace(strip_ansi(F.col("text")), _marker(marker), "")
    clean = trim(redact(text))
    rest = [c for c in events.columns if c != "text"]
    return sealed(events, rest, [clean.alias("text")]).where(F.col("text") != "")


def with_age(events: DataFrame) -> DataFrame:
    """Every event with ``age``, 1 for the newest of its run; readers keep what they want.

    A reader's filter ``age <= n`` is pushed below the shuffle as a rank limit.
    """
    order = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    return events.withColumn("age", F.row_number().over(order))


def since(events: DataFrame, cursor: int) -> DataFrame:
    return events.where(F.col("seq") > cursor)


# --- progress and agents --------------------------------------------------------


def progress_parts(events: DataFrame, marker: str = L.PROGRESS_MARKER) -> DataFrame:
    """What events say about the progress of their runs, in rows that :func:`merge_progress` can join with others."""
    updates = with_progress(events, marker).where(F.col("phase").isNotNull())
    return merge_progress(updates.select(
        "run_id", F.least("percent", F.lit(100)).alias("percent"), F.struct("seq", "phase", "detail").alias("last"),
        F.when(F.col("chapter").isNotNull(), F.struct("seq", "chapter")).alias("place")))


def merge_progress(parts: DataFrame) -> DataFrame:
    """One row per run of any union of :func:`progress_parts`."""
    return parts.groupBy("run_id").agg(
        F.max("percent").alias("percent"), F.max("last").alias("last"), F.max("place").alias("place"))


def progress_rows(parts: DataFrame) -> DataFrame:
    """Current progress per run from merged parts."""
    return parts.select(
        "run_id", "percent", F.col("last.phase").alias("phase"), F.col("last.detail").alias("detail"),
        F.col("place.chapter").alias("chapter"), F.col("last.seq").alias("seq"))


def progress_state(events: DataFrame, marker: str = L.PROGRESS_MARKER) -> DataFrame:
    """Current progress per run: percent never falls, the last phase and the last known chapter."""
    return progress_rows(progress_parts(events, marker))


def progress_history(events: DataFrame, marker: str = L.PROGRESS_MARKER) -> DataFrame:
    """Progress after every event: percent never falls, chapter is carried on."""
    marked = with_progress(events, marker).withColumn("_pct", F.least("percent", F.lit(100)))
    return running(
        marked.select("run_id", "seq", "phase", "_pct", "chapter"), ["run_id"], "seq",
        {"run_percent": ("max", "_pct"), "run_phase": ("last", "phase"), "run_chapter": ("last", "chapter")},
    ).select("run_id", "seq", "run_percent", "run_phase", "run_chapter")


def agent_rows(events: DataFrame) -> DataFrame:
    """One status fact per event, plus the orchestrator waking when a session ends."""
    key = F.coalesce("session_id", F.lit("orchestrator"))
    done = is_done(F.col("text"))
    base = events.select(
        "run_id", "seq", *[c for c in events.columns if c == "at"], key.alias("agent_key"),
        F.when(F.col("agent").isin("Subagent", "Orchestrator"), None).otherwise(F.col("agent")).alias("name"),
        F.coalesce("depth", F.lit(0)).alias("depth"), done.alias("done"),
        F.when(F.col("session_id").isNull() & matches("text", L.HANDOVER), "waiting").otherwise("working").alias("status"),
        F.col("session_id").isNotNull().alias("nested"),
    )
    own = F.struct("agent_key", "name", "depth", "done", "status", F.lit(1).alias("step"))
    wake = F.struct(
        F.lit("orchestrator").alias("agent_key"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("depth"),
        F.lit(False).alias("done"), F.lit("working").alias("status"), F.lit(2).alias("step"),
    )
    both = F.when(F.col("nested") & F.col("done"), F.array(own, wake)).otherwise(F.array(own))
    return base.select("run_id", "seq", *[c for c in events.columns if c == "at"], F.inline(both))


def agent_parts(events: DataFrame) -> DataFrame:
    """What events say about the agents of their runs, in rows that :func:`merge_agents` can join with others."""
    named = F.when(F.col("name").isNotNull(), F.struct("seq", "name"))
    return merge_agents(agent_rows(events).select(
        "run_id", "agent_key", named.alias("known"), "depth", "done",
        F.struct((F.col("seq") * 2 + F.col("step")).alias("ord"), "status", "seq").alias("last")))


def merge_agents(parts: DataFrame) -> DataFrame:
    """One row per agent of any union of :func:`agent_parts`."""
    return parts.groupBy("run_id", "agent_key").agg(
        F.max("known").alias("known"), F.min("depth").alias("depth"), F.bool_or("done").alias("done"), F.max("last").alias("last"))


def agent_states(parts: DataFrame) -> DataFrame:
    """Agents of each run from merged parts: done is sticky, depth is the smallest, last specific name."""
    fallback = F.when(F.col("agent_key") == "orchestrator", "Orchestrator").otherwise("Subagent")
    return parts.select(
        "run_id", "agent_key", F.coalesce("known.name", fallback).alias("agent"), "depth",
        F.when(F.col("done"), "done").otherwise(F.col("last.status")).alias("status"), "done", F.col("last.seq").alias("seq"))


def agent_status(events: DataFrame) -> DataFrame:
    """Agents of each run: done is sticky, depth is the smallest, last specific name."""
    return agent_states(agent_parts(events))


def agent_changes(events: DataFrame, idle_seconds: int = 30, until_ms: Column | None = None) -> DataFrame:
    """(run_id, agent_key, ms, status): every change of status of every agent.

    A working agent waits after ``idle_seconds`` without output and works again
    on output; done stays.  ``until_ms`` is the time of the view: later rows are
    left out, and quiet time lasts until then.
    """
    key, ms, idle = ["run_id", "agent_key"], F.col("ms"), idle_seconds * 1000
    base = agent_rows(events).select(
        *key, F.unix_millis("at").alias("ms"), (F.col("seq") * 2 + F.col("step")).alias("ord"), "status",
        F.col("done").cast("int").alias("d"))
    if until_ms is not None:
        base = base.where(ms <= until_ms)
    seen = running(base, key, "ord", {
        "prev_ms": ("lag", "ms"), "prev_status": ("lag", "status"), "done_so_far": ("sum", "d")})
    now = F.when(F.col("done_so_far") > 0, "done").otherwise(F.col("status"))
    before = F.when(F.col("done_so_far") - F.col("d") > 0, "done").otherwise(F.coalesce("prev_status", F.lit("")))
    rested = (before == "working") & (ms - F.col("prev_ms") > idle)
    row = lambda at, status: F.struct(at.alias("ms"), status.alias("status"))
    changes = seen.select(*key, F.inline(F.array_compact(F.array(
        F.when(rested, row(F.col("prev_ms") + idle, F.lit("waiting"))),
        F.when(now != F.when(rested, "waiting").otherwise(before), row(ms, now))))))
    if until_ms is None:
        return changes
    last = seen.groupBy(*key).agg(F.max_by(F.struct(now.alias("status"), "ms"), "ord").alias("l"))
    quiet = last.where((F.col("l.status") == "working") & (F.col("l.ms") + idle < until_ms))
    return changes.unionByName(quiet.select(*key, (F.col("l.ms") + idle).alias("ms"), F.lit("waiting").alias("status")))


def run_alarms(
    events: DataFrame, parent_seconds: int = L.STALL_MINUTES * 60, nested_seconds: int = L.NESTED_STALL_MINUTES * 60,
    until_ms: Column | None = None,
) -> DataFrame:
    """(run_id, kind, last_seq, quiet_since_ms): quiet times of runs over the limits of parent and nested work.

    ``until_ms`` as in :func:`agent_changes`.
    """
    base = events.select(
        "run_id", "seq", F.unix_millis("at").alias("ms"), F.col("session_id").isNotNull().cast("int").alias("nested"))
    if until_ms is not None:
        base = base.where(F.col("ms") <= until_ms)
    seen = running(base, ["run_id"], "seq", {
        "prev_ms": ("lag", "ms"), "prev_seq": ("lag", "seq"), "nested_so_far": ("sum", "nested")})
    spells = seen.where(F.col("prev_seq").isNotNull()).select(
        "run_id", F.col("prev_seq").alias("last_seq"), F.col("prev_ms").alias("quiet_since_ms"),
        (F.col("ms") - F.col("prev_ms")).alias("quiet"), (F.col("nested_so_far") - F.col("nested") > 0).alias("delegated"))
    if until_ms is not None:
        last = seen.groupBy("run_id").agg(F.max_by(F.struct("seq", "ms", "nested_so_far"), "seq").alias("l"))
        spells = spells.unionByName(last.select(
            "run_id", F.col("l.seq").alias("last_seq"), F.col("l.ms").alias("quiet_since_ms"),
            (until_ms - F.col("l.ms")).alias("quiet"), (F.col("l.nested_so_far") > 0).alias("delegated")))
    kinds = F.array_compact(F.array(
        F.when(F.col("quiet") > parent_seconds * 1000, F.lit("parent")),
        F.when((F.col("quiet") > nested_seconds * 1000) & F.col("delegated"), F.lit("nested"))))
    return spells.select("run_id", F.explode(kinds).alias("kind"), "last_seq", "quiet_since_ms")


# --- stalls --------------------------------------------------------------------------


def stalls(
    events: DataFrame, parent_seconds: int = L.STALL_MINUTES * 60, nested_seconds: int = L.NESTED_STALL_MINUTES * 60
) -> DataFrame:
    """Quiet gaps and repeated lookups ``(run_id, kind, from_seq, to_seq, seconds)``.

    ``parent``: no output; ``nested``: neither side spoke after delegated work;
    ``lookup``: one lookup line repeated with nothing in between.
    """
    base = events.select(
        "run_id", "seq", F.unix_micros("at").alias("us"),
        F.when(matches(trim("text"), L.LOOKUP_LINE), trim("text")).alias("lookup"),
        F.col("session_id").isNotNull().cast("int").alias("nested"),
    )
    seen = running(
        base, ["run_id"], "seq",
        {"prev_us": ("lag", "us"), "prev_seq": ("lag", "seq"), "prev_lookup": ("lag", "lookup"),
         "nested_so_far": ("sum", "nested")},
    )
    quiet = (F.col("us") - F.col("prev_us")) / F.lit(1_000_000.0)
    earlier_nested = (F.col("nested_so_far") - F.col("nested")) > 0
    kinds = F.array_compact(
        F.array(
            F.when(quiet > parent_seconds, F.lit("parent")),
            F.when((quiet > nested_seconds) & earlier_nested, F.lit("nested")),
        )
    )
    gaps = seen.select(
        "run_id", F.explode(kinds).alias("kind"), F.col("prev_seq").alias("from_seq"), F.col("seq").alias("to_seq"),
        quiet.alias("seconds"),
    )
    return gaps.unionByName(_lookup_stalls(seen, parent_seconds))


def _lookup_stalls(seen: DataFrame, limit: int) -> DataFrame:
    starts = (~F.col("lookup").eqNullSafe(F.col("prev_lookup")) | F.col("prev_us").isNull()).cast("long")
    islands = running(seen.withColumn("_start", starts), ["run_id"], "seq", {"island": ("sum", "_start")})
    spans = islands.where(F.col("lookup").isNotNull()).groupBy("run_id", "island").agg(
        F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.min("us").alias("a"), F.max("us").alias("b")
    )
    seconds = (F.col("b") - F.col("a")) / F.lit(1_000_000.0)
    return spans.where(seconds > limit).select(
        "run_id", F.lit("lookup").alias("kind"), "from_seq", "to_seq", seconds.alias("seconds")
    )


def quiet_sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Activity islands per run ``(run_id, island, first_seq, last_seq, n)``."""
    base = events.select("run_id", "seq", F.unix_micros("at").alias("us"))
    lagged = running(base, ["run_id"], "seq", {"prev_us": ("lag", "us")})
    start = F.when(
        F.col("prev_us").isNull() | ((F.col("us") - F.col("prev_us")) > gap_seconds * 1_000_000), 1
    ).otherwise(0).cast("long")
    islands = running(lagged.withColumn("_start", start), ["run_id"], "seq", {"island": ("sum", "_start")})
    return islands.groupBy("run_id", "island").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n")
    )


# --- text deltas, halts, history -----------------------------------------------------------


def text_deltas(parts: DataFrame) -> DataFrame:
    """New text of growing message parts ``(run_id, part_key, seq, delta)``.

    Repeats are ignored; a grown part yields its new suffix.
    """
    lagged = running(parts.select("run_id", "part_key", "seq", "text"), ["run_id", "part_key"], "seq",
                     {"prev": ("lag", "text")})
    before = F.coalesce("prev", F.lit(""))
    grown = F.col("text").startswith(before)
    delta = F.when(
        grown, trim(F.substring(F.col("text"), F.length(before) + 1, F.length("text")))
    ).otherwise(F.col("text"))
    return (
        lagged.where(F.col("text") != before).select("run_id", "part_key", "seq", delta.alias("delta"))
        .where(F.col("delta") != "")
    )


def halt_reasons(events: DataFrame) -> DataFrame:
    """Why a run stopped, from all its events, first rule that hits; one aggregation with map-side combine."""
    flags = events.groupBy("run_id").agg(
        *[F.bool_or(matches("text", p)).alias(name) for p, name in L.HALT_RULES]
    )
    reason = F.lit("other")
    for _, name in reversed(L.HALT_RULES):
        reason = F.when(F.col(name), name).otherwise(reason)
    return flags.select("run_id", reason.alias("reason"))


def history(log: DataFrame) -> DataFrame:
    """Runtime messages of a phase log as event rows.

    ``log(run_id, event, timestamp, message, data JSON)``.
    """
    data = F.from_json("data", "kind string, seq bigint, sessionId string, agent string, depth int")
    return (
        log.where(F.col("event") == "runtime_message").withColumn("_d", data)
        .where(F.col("_d.kind").isin(L.EVENT_KINDS))
        .select(
            "run_id", F.col("_d.seq").alias("seq"), F.col("timestamp").alias("at"), F.col("_d.kind").alias("kind"),
            F.coalesce("message", F.lit("")).alias("text"), F.col("_d.sessionId").alias("session_id"),
            F.col("_d.agent").alias("agent"), F.col("_d.depth").alias("depth"),
        )
    )


def history_agents(events: DataFrame) -> DataFrame:
    """Final row per agent of a finished run: the last event wins, all done."""
    key = F.coalesce("session_id", F.lit("orchestrator"))
    keyed = events.select("run_id", "seq", key.alias("agent_key"), "agent", "depth")
    return (
        keyed.groupBy("run_id", "agent_key").agg(F.max_by(F.struct("agent", "depth"), "seq").alias("l"))
        .select(
            "run_id", "agent_key",
            F.coalesce(
                "l.agent", F.when(F.col("agent_key") == "orchestrator", "Orchestrator").otherwise("Subagent")
            ).alias("agent"),
            F.coalesce("l.depth", F.lit(0)).alias("depth"), F.lit("done").alias("status"),
        )
    )


# --- transcripts ---------------------------------------------------------------------------

TRANSCRIPT = (
    "type string, subtype string, model string, session_id string, timestamp string, total_cost_usd double, "
    "message struct<content:array<struct<type:string,id:string,name:string,text:string,tool_use_id:string,"
    "is_error:boolean,content:string,input:struct<subagent_type:string,agent:string,description:string,"
    "file_path:string,filePath:string,command:string>>>>"
)


def _tool_text(block: Column) -> Column:
    name, given = F.lower(F.coalesce(block["name"], F.lit(""))), block["input"]
    path = F.coalesce(given["file_path"], given["filePath"])
    file = F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit("a file"))
    who = F.coalesce(given["subagent_type"], given["agent"], F.lit("a specialist"))
    what = F.coalesce(given["description"], F.lit("work in this phase"))
    cat = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    return (
        F.when(name.isin("task", "agent"), cat("Handing over to ", who, ": ", what, "."))
        .when(name == "read", cat("Reading ", file, "."))
        .when(name == "write", cat("Writing ", file, "."))
        .when(name == "edit", cat("Editing ", file, "."))
        .when(name == "bash", "Running an approved project check.")
        .when(name.isin("glob", "grep"), "Searching the workspace.")
        .when(name.isin("webfetch", "websearch"), "Looking up a reference.")
        .otherwise(cat("Using ", F.coalesce(F.nullif(block["name"], F.lit("")), F.lit("a tool")), "."))
    )


def transcript_events(lines: DataFrame) -> DataFrame:
    """JSON transcript lines as typed event rows.

    ``lines(run_id, line_no, line[, started_at])``.  Unparsable lines become
    notes; rows stamped more than two seconds before the run start are skipped.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.withColumn("e", F.from_json("line", TRANSCRIPT + ", _bad string", options))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull()
    if "started_at" in lines.columns:
        stamp = F.col("e.timestamp").try_cast("timestamp")
        parsed = parsed.where(
            bad | stamp.isNull() | (stamp >= F.col("started_at") - F.expr("interval 2 seconds"))
        )
    e = lambda f: F.col(f"e.{f}")
    cat = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])

    def row(kind: str, text: Column, session=None, agent=None, done: Column | bool = False) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), text.cast("string").alias("text"),
            (F.lit(None) if session is None else session).cast("string").alias("session_id"),
            (F.lit(None) if agent is None else agent).cast("string").alias("agent"),
            (F.lit(done) if isinstance(done, bool) else done).alias("done"),
        )

    squeezed = lambda t: trim(replace_all(t, r"\s+", " "))

    def spoken(b: Column) -> Column:
        delegated = F.lower(F.coalesce(b["name"], F.lit(""))).isin("task", "agent")
        who = F.coalesce(b["input"]["subagent_type"], b["input"]["agent"], F.lit("Subagent"))
        return (
            F.when((b["type"] == "text") & (squeezed(b["text"]) != ""), row("note", squeezed(b["text"])))
            .when(b["type"] == "tool_use", row(
                "step", _tool_text(b), F.when(delegated, b["id"]), F.when(delegated, who)))
        )

    def answered(b: Column) -> Column:
        return F.when(
            (b["type"] == "tool_result") & F.coalesce(b["is_error"], F.lit(False)),
            row("error", cat("A step failed: ", F.coalesce(b["content"], F.lit("")))),
        )

    # Only a currency amount with two decimals; absent without a reported cost.
    cost = F.when(e("total_cost_usd").isNotNull(), cat(
        " Provider-reported API usage: $", F.format_string("%.2f", e("total_cost_usd")), ".")).otherwise("")
    none = F.array().cast("array<struct<kind:string,text:string,session_id:string,agent:string,done:boolean>>")
    events = (
        F.when(bad, F.array(row("note", F.col("line"))))
        .when((e("type") == "system") & (e("subtype") == "init"), F.array(row(
            "system", cat("Session ready", F.coalesce(cat(" on ", e("model")), F.lit("")), "."))))
        .when(e("type") == "assistant", F.array_compact(F.transform(e("message.content"), spoken)))
        .when(e("type") == "user", F.array_compact(F.transform(e("message.content"), answered)))
        .when((e("type") == "result") & (e("subtype") == "success"), F.array(row("system", cat("Done.", cost), done=True)))
        .when(e("type") == "result", F.array(row(
            "error", cat("Stopped: ", F.coalesce(e("subtype"), F.lit("unknown reason")), ".", cost))))
        .otherwise(none)
    )
    return parsed.select("run_id", "line_no", F.posexplode(events).alias("part", "v")).select(
        "run_id", "line_no", "part", "v.*"
    )


def delegated_sessions(lines: DataFrame) -> DataFrame:
    """Delegated calls with whether their result has closed them."""
    parsed = lines.select("run_id", "line_no", F.from_json("line", TRANSCRIPT).alias("e")).select(
        "run_id", "line_no", "e.type", F.explode(rows("e.message.content")).alias("b")
    )
    opened = parsed.where(
        (F.col("type") == "assistant") & (F.col("b.type") == "tool_use")
        & F.lower("b.name").isin("task", "agent") & F.col("b.id").isNotNull()
    ).select(
        "run_id", F.col("b.id").alias("session_id"), F.col("line_no").alias("opened_at"),
        F.coalesce("b.input.subagent_type", F.lit("Subagent")).alias("agent"),
    )
    closed = parsed.where((F.col("type") == "user") & (F.col("b.type") == "tool_result")).select(
        "run_id", F.col("b.tool_use_id").alias("session_id"), F.col("line_no").alias("closed_at"),
        F.coalesce("b.is_error", F.lit(False)).alias("failed"),
    )
    return opened.join(closed, ["run_id", "session_id"], "left").select(
        "run_id", "session_id", "agent", "opened_at", "closed_at",
        F.when(F.col("closed_at").isNull(), "working").otherwise("done").alias("status"),
        F.coalesce("failed", F.lit(False)).alias("failed"),
    )
