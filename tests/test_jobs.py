"""Retrieval against brute force, streams, plans and a sample of SQL checks."""

import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from proseloom.operators import metrics, retrieve, score
from proseloom.plans import registry
from proseloom.plans import tables as X
from proseloom.session import STATE_STORE, shared_dir
from proseloom.sources import artifacts
from proseloom.streaming import events as E
from proseloom.streaming import jobs as J
from proseloom.streaming import ordered as O
from proseloom.streaming import sinks

SF = "/root/testdata/sf0.001"
BEATS = ["dialogue", "action", "interiority", "description", "transition"]
NEAR = {("dialogue", "interiority"), ("action", "description"), ("interiority", "dialogue"), ("interiority", "description"),
        ("description", "interiority"), ("description", "action"), ("transition", "description")}


def greedy(brief, passages):
    _, beat, people, terms, k, budget = brief
    scored = []
    for p in passages:
        s = 5.0 if p["beat"] == beat else 1.5 if (p["beat"], beat) in NEAR else 0.0
        known = [x for x in p["speakers"] if x.lower() in people]
        s += 3 * len(known) if known else 0.5 if people and not p["speakers"] and beat != "dialogue" else 0
        s += min(len(terms & set(p["text"].split())), 6) * 0.75
        s += 1 if 80 <= p["n_words"] <= 260 else -1 if p["n_words"] < 40 else 0
        if s > 0:
            scored.append((-s, p["ord"], p["passage_no"], p))
    chosen, used, left = [], set(), budget
    for first in (True, False):
        for *_, p in sorted(scored, key=lambda x: x[:3]):
            if len(chosen) < k and p not in chosen and p["n_words"] <= left and not (first and p["source"] in used):
                chosen.append(p)
                used.add(p["source"])
                left -= p["n_words"]
    return [p["passage_id"] for p in chosen]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pruned_selection_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["stone", "river", "winter", "letter", "garden", "silver"]
    passages = [
        {"book_id": "b", "passage_id": f"{d}-{n}", "source": f"s{d}", "ord": d, "passage_no": n,
         "beat": rng.choice(BEATS), "n_words": rng.choice([20, 39, 40, 90, 90, 260, 300, 700]),
         "speakers": rng.sample(["Ann", "Bo"], rng.randint(0, 2)),
         "text": " ".join(rng.sample(vocabulary, rng.choice([0, 0, 0, 1, 2])))}
        for d in range(7) for n in range(40)
    ]
    briefs = [(i, rng.choice(BEATS), rng.choice([[], ["ann"]]), set(rng.sample(vocabulary, rng.randint(0, 2))),
               rng.choice([1, 3, 4, 6, 10]), rng.choice([60, 400, 1200, 4000])) for i in range(12)]
    p = spark.createDataFrame(
        [tuple(x[c] for c in ("book_id", "passage_id", "source", "ord", "passage_no", "beat", "n_words", "speakers", "text"))
         for x in passages],
        "book_id string, passage_id string, source string, ord long, passage_no int, beat string, n_words long, "
        "speakers array<string>, text string")
    b = spark.createDataFrame(
        [("b", i, beat, people, " ".join(sorted(t)), "", k, w) for i, beat, people, t, k, w in briefs],
        "book_id string, brief_id int, beat string, characters array<string>, summary string, register string, k int, max_words int")
    got = {}
    for r in retrieve.select_exemplars(b, p).orderBy("brief_id", "position").collect():
        got.setdefault(r.brief_id, []).append(r.passage_id)
    for brief in briefs:
        assert got.get(brief[0], []) == greedy(brief, passages), brief


def test_a_term_of_every_passage_gives_few_pairs(spark):
    rng = random.Random(4)
    rows = [("b", f"{i}", f"s{i % 50}", i, 0, rng.choice(BEATS), rng.randint(20, 300), [], "winter " + rng.choice(["stone", "", "", ""]))
            for i in range(4000)]
    p = spark.createDataFrame(rows, "book_id string, passage_id string, source string, ord long, passage_no int, beat string, "
                              "n_words long, speakers array<string>, text string")
    b = spark.createDataFrame([("b", i, beat, [], text, "", 4, 1200) for i, (beat, text) in enumerate(
        [("action", "winter"), ("dialogue", "winter stone")])],
        "book_id string, brief_id int, beat string, characters array<string>, summary string, register string, k int, max_words int")
    pairs = {r.brief_id: r["count"] for r in retrieve.candidate_pairs(b, retrieve.measured(p)).groupBy("brief_id").count().collect()}
    few = retrieve.champions(b, retrieve.measured(p)).count()
    assert few < 400 and pairs[0] == few and pairs[1] < few + 200
    assert {r["count"] for r in retrieve.matched_pairs(b, p).groupBy("brief_id").count().collect()} == {4000}


def test_what_briefs_ask_for_goes_to_the_passages(spark, monkeypatch):
    p = spark.createDataFrame([("b", f"{i}", f"s{i}", i, 0, "action", 90, ["Ann"], "winter stone") for i in range(20)],
                              "book_id string, passage_id string, source string, ord long, passage_no int, beat string, "
                              "n_words long, speakers array<string>, text string")
    b = spark.createDataFrame([("b", 1, "action", ["ann"], "winter", "", 4, 1200)],
        "book_id string, brief_id int, beat string, characters array<string>, summary string, register string, k int, max_words int")
    made = []
    monkeypatch.setattr(retrieve, "cut_lineage", lambda df, keep=retrieve.cut_lineage: made.append(set(df.columns)) or keep(df))
    assert retrieve.reachable(b, p).count() == 4
    # Asked postings, probes and both lists of pairs are files whose size the planner knows.
    assert {"book_id", "brief_id", "posting"} in made and any({"posting", "below", "_salt"} <= c for c in made)
    assert made.count({"book_id", "brief_id", "passage_id"}) == 2


# --- streams --------------------------------------------------------------------


def write_events(spark, path, rows):
    df = spark.createDataFrame(rows, "run_id bigint, seq bigint, at string, text string").select(
        "run_id", "seq", F.col("at").cast("timestamp").alias("at"), F.lit("note").alias("kind"), "text",
        F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("agent"), F.lit(0).alias("depth"))
    df.coalesce(1).write.mode("append").parquet(path)


def test_progress_survives_a_restart_and_equals_batch(spark):
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    write_events(spark, f"{root}/in", [
        (1, 1, "2024-01-01 00:00:00", "RUN_PROGRESS phase=editing_chapter percent=80 chapter=3 detail=x"),
        (2, 1, "2024-01-01 00:00:00", "reading the project")])
    for extra in ([], [(1, 2, "2024-01-01 00:01:00", "RUN_PROGRESS phase=gathering_info percent=5")]):
        if extra:
            write_events(spark, f"{root}/in", extra)
        stream = J.open_parquet(spark, f"{root}/in", J.EVENT_SCHEMA)
        J.run_available(E.progress_state(stream), f"{root}/out", f"{root}/cp", "update")
    live = {r.run_id: r.asDict() for r in J.latest_rows(spark, f"{root}/out", ["run_id"]).collect()}
    batch = {r.run_id: r.asDict() for r in E.progress_state(spark.read.parquet(f"{root}/in")).collect()}
    assert live == batch
    assert (live[1]["percent"], live[1]["phase"], live[1]["chapter"]) == (80, "gathering_info", 3)


def _shuffled_batches(spark, rows, schema, seed, files=3, mark=None):
    """Rows in files that mix neighbouring times, then a row far ahead that moves the watermark past them."""
    rng = random.Random(seed)
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    parts = [[] for _ in range(files)]
    for row in rows:
        parts[rng.randrange(files)].append(row)
    for part in [*parts, [mark]]:
        rng.shuffle(part)
        spark.createDataFrame(part, schema).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), spark.read.parquet(folder)


def _live(spark, stream):
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    J.run_available(stream, f"{root}/out", f"{root}/cp")
    return spark.read.parquet(f"{root}/out")


def test_shuffled_text_deltas_equal_batch(spark):
    rng = random.Random(1)
    rows, text = [], ""
    for i in range(40):
        text = "" if rng.random() < 0.2 else text + rng.choice(["a", " b", "", " "])
        rows.append((1, "x" if i % 3 else "y", i, f"2024-01-01 00:00:{i:02d}", text))
    mark = (9, "z", 99, "2024-01-02 00:00:00", "end")
    stream, table = _shuffled_batches(spark, rows, "run_id bigint, part_key string, seq bigint, at string, text string", 5, mark=mark)
    live = {(r.part_key, r.seq, r.delta) for r in _live(spark, O.text_deltas(stream)).collect()}
    assert live == {(r.part_key, r.seq, r.delta) for r in E.text_deltas(table.where("run_id = 1")).collect()}
    assert len(live) > 5


def test_shuffled_agent_changes_and_alarms_equal_batch(spark):
    rng = random.Random(2)
    rows, at = [], 0
    for i in range(60):
        at += rng.choice([1, 5, 31, 40, 310, 1000])
        text = rng.choice(["note", "note", "note", "Handing over to x", "done: true"])
        rows.append((1 + i % 2, i, f"2024-01-01 {at // 3600:02d}:{at // 60 % 60:02d}:{at % 60:02d}", "note", text,
                     rng.choice([None, "s1", "s2"]) if i > 10 else None, "Editor", 1))
    mark = (9, 999, "2024-01-03 00:00:00", "note", "x", None, None, 0)
    stream, table = _shuffled_batches(spark, rows, J.EVENT_SCHEMA.replace("timestamp", "string"), 7, mark=mark)
    until = F.lit(1704240000000 - 600_000).cast("long")
    table = table.where("run_id < 9")
    slow = "1 day"
    live = [(r.run_id, r.agent_key, r.ms, r.status) for r in _live(spark, O.agent_changes(stream, 30, slow)).collect()]
    want = [(r.run_id, r.agent_key, r.ms, r.status) for r in E.agent_changes(table, 30, until).collect()]
    assert sorted(live) == sorted(want) and {s for *_, s in live} == {"working", "waiting", "done"}
    live = [tuple(r) for r in _live(spark, O.run_alarms(stream, watermark=slow)).collect()]
    assert sorted(live) == sorted(tuple(r) for r in E.run_alarms(table, until_ms=until).collect())
    assert {kind for _, kind, *_ in live} == {"parent", "nested"}


def test_streams_keep_state_whatever_store_the_session_names(spark):
    schema = "run_id bigint, part_key string, seq bigint, at string, text string"
    rows = [(1, "x", i, f"2024-01-01 00:00:0{i}", "ab"[: i + 1]) for i in range(2)]
    stream, _ = _shuffled_batches(spark, rows, schema, 3, mark=(9, "z", 99, "2024-01-02 00:00:00", "end"))
    named = spark.conf.get(STATE_STORE)
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(STATE_STORE, other)
    try:
        live = _live(spark, O.text_deltas(stream))
        assert spark.conf.get(STATE_STORE) == other
    finally:
        spark.conf.set(STATE_STORE, named)
    assert sorted((r.seq, r.delta) for r in live.collect()) == [(0, "a"), (1, "b")]


def test_a_row_at_the_watermark_is_handled(spark):
    schema = "run_id bigint, part_key string, seq bigint, at string, text string"
    rows = [(1, "x", 1, "2024-01-01 23:50:00", "a"), (1, "x", 2, "2024-01-01 23:50:01", "ab")]
    stream, _ = _shuffled_batches(spark, rows, schema, 3, mark=(9, "z", 99, "2024-01-02 00:00:00", "end"))
    assert [(r.seq, r.delta) for r in _live(spark, O.text_deltas(stream)).collect()] == [(1, "a")]


def test_quiet_state_ends(spark):
    machine = O._Agents(30)
    empty = spark.createDataFrame([], machine.ROW).toPandas()
    assert machine.step(empty, (1000, "working"), 40_000)[0] == {"ms": [31_000], "status": ["waiting"]}
    assert machine.step(empty, (1000, "done"), 10**9)[0] == {"ms": [], "status": []}
    alarms = O._Alarms(900, 300)
    out, state, _ = alarms.step(spark.createDataFrame([], alarms.ROW).toPandas(), (0, 5, True, False, True), 10**7)
    assert out == {"kind": ["parent"], "last_seq": [5], "quiet_since_ms": [0]} and state[3:] == (True, True)


def test_late_rows_are_kept_beside_those_on_time(spark):
    root, folder = (f"{shared_dir(spark)}/{uuid.uuid4().hex}" for _ in range(2))
    files = [["2024-01-01 00:00:00", "2024-01-01 01:00:00"], ["2024-01-01 00:49:59", "2024-01-01 00:50:00", None], ["2024-01-01 02:00:00"],
             ["2024-01-01 01:10:00"]]
    for times in files:
        spark.createDataFrame([(t,) for t in times], "at string").select(F.col("at").cast("timestamp")).coalesce(1).write.mode(
            "append").parquet(folder)
    stream = spark.readStream.schema("at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    save = sinks.split_late(root, "10 minutes")
    sinks.run_batches(stream, save, f"{root}/cp")
    save(spark.createDataFrame([("2024-01-01 01:10:00",)], "at string").select(F.col("at").cast("timestamp")), 3)  # Replayed.
    late = {str(r["at"]) for r in sinks.read_side(spark, root, True).collect()}
    assert late == {"2024-01-01 00:49:59", "None", "2024-01-01 01:10:00"}
    assert sinks.read_side(spark, root, False).count() == 4
    marks = {r.batch: (r.n_on_time, r.n_late) for r in sinks.read_marks(spark, root).collect()}
    assert marks == {0: (2, 0), 1: (1, 2), 2: (1, 0), 3: (0, 1)}


def test_upsert_replays_and_keeps_reading_cheap(spark):
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    save = sinks.upsert(root, ["k"], merge, merge, buckets=4)
    assert sinks.read_current(spark, root) is None
    want = {}
    for batch in range(12):
        rows = [(k, batch + 1) for k in range(batch % 5, 20, 3)]
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        df = spark.createDataFrame(rows, "k int, n long")
        save(df, batch)
        if batch in (0, 7):
            save(df, batch)  # The same batch again changes nothing.
    assert {r.k: r.n for r in sinks.read_current(spark, root).collect()} == want
    assert len(sinks._children(spark, f"{root}/listing")) == 2 and len(sinks._children(spark, f"{root}/data")) <= 8
    save(spark.createDataFrame([], "k int, n long"), 12)
    assert sinks.read_current(spark, root).count() == len(want)


def test_logs_and_corpus_round_trip(spark):
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    entries = spark.createDataFrame([("b", "e1"), ("b", "e2")], "book_id string, event string")
    artifacts.append_log(entries, root, "audit")
    spark.createDataFrame([('{"book_id": "b", "ev',)], "value string").write.mode("append").text(f"{root}/log_kind=audit")
    assert artifacts.read_log(spark, root, "audit").count() == 2
    assert artifacts.read_torn(spark, root, "audit").count() == 1
    first = spark.createDataFrame([("a", 1), ("b", 1)], "book_id string, n int")
    artifacts.write_corpus({"fingerprints": first}, root)
    artifacts.write_corpus({"fingerprints": spark.createDataFrame([("b", 2)], "book_id string, n int")}, root)
    assert {(r.book_id, r.n) for r in artifacts.read_corpus(spark, root, "fingerprints").collect()} == {("a", 1), ("b", 2)}


def test_transcripts(spark):
    lines = ['{"type":"system","subtype":"init","model":"m1"}', "not json",
             '{"type":"assistant","message":{"content":[{"type":"text","text":" hi  there "},'
             '{"type":"tool_use","id":"t1","name":"Task","input":{"subagent_type":"Editor","description":"cut"}}]}}',
             '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t1","is_error":true,"content":"no"}]}}',
             '{"type":"result","subtype":"success","total_cost_usd":1.5}']
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "run_id long, line_no int, line string")
    got = [(r.kind, r.text, r.session_id) for r in E.transcript_events(df).orderBy("line_no", "part").collect()]
    assert got == [
        ("system", "Session ready on m1.", None), ("note", "not json", None), ("note", "hi there", None),
        ("step", "Handing over to Editor: cut.", "t1"), ("error", "A step failed: no", None),
        ("system", "Done. Provider-reported API usage: $1.50.", None)]
    assert [(r.session_id, r.status, r.failed) for r in E.delegated_sessions(df).collect()] == [("t1", "done", True)]


# --- plans -----------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_document_jobs_do_not_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    for df in (metrics.document_metrics(docs, ["doc_id"]), score.repetitions(docs, ["doc_id"])):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


@pytest.mark.parametrize("name", ["agg2_pooled_fingerprint", "sco10_fidelity", "ret3_exemplars", "con12_verdicts", "cls4_classification"])
def test_no_python_and_no_products(spark, name):
    registry.load()
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text and "MapInPandas" not in text


@pytest.mark.parametrize("name", [
    "style_reports", "txt2_sentences", "agg3_weighted_merge", "man1_chapters", "con12_verdicts", "str4_progress_history"])
def test_sql_checks_agree(spark, name):
    registry.load()
    con = duckdb.connect()
    for t in X.GIVEN:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(registry.CHECKS[name])
    columns = sorted(d[0] for d in cur.description)
    names = [d[0] for d in cur.description]
    want = sorted(repr([dict(zip(names, r))[c] for c in columns]) for r in cur.fetchall())
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == want


def test_row_order_and_partitions_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    mixed = docs.orderBy(F.desc("doc_id")).repartition(7)
    a, b = ({r.source: r.asDict() for r in metrics.pooled_fingerprint(d, ["source"], "text", r"\n").collect()}
            for d in (docs, mixed))
    assert a == b
