import random
import re
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from proseloom.functions import lexicons as L
from proseloom.functions import text as T
from proseloom.operators import classify, clean, continuity, corpus, evidence, findings, formatting, inventory, manuscript
from proseloom.operators import metrics, profile, score, structure
from proseloom.operators.lookup import interval_join
from proseloom.operators.running import running
from proseloom.session import cut_lineage, shared_dir
from proseloom.sources import scan

STORY = (
    'The rain came down. It fell on the roof, slowly; it fell on the road.\n\n"Where were you?" Anna said. '
    '"I waited."\n\nTobias didn\'t answer. He looked like a man who felt nothing.'
)


def docs(spark, *texts):
    return spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "doc_id long, g string, text string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- metrics -------------------------------------------------------------------


def test_metrics_fixed_values(spark):
    m = one(metrics.document_metrics(docs(spark, STORY), ["doc_id"]))
    assert (m.word_count, m.sentence_count, m.paragraph_count) == (33, 7, 3)
    assert m.sentence_mean_words == 4.71
    assert m.dialogue_word_share == 0.152
    assert m.dialogue_plain_tag_share == 1.0
    assert m.texture_commas_per_1k == 30.3
    assert m.texture_semicolons_per_1k == 30.3
    assert m.texture_similes_per_1k == 30.3
    assert m.texture_contractions_per_1k == 30.3
    assert m.texture_filter_verbs_per_1k == 60.61


def test_empty_text_gives_zeros_and_a_plain_share_of_one(spark):
    for text in ("", "  \n\n "):
        m = one(metrics.document_metrics(docs(spark, text), ["doc_id"])).asDict()
        assert m.pop("dialogue_plain_tag_share") == 1.0
        m.pop("doc_id")
        assert not any(m.values())


def test_hyphens_count_as_dashes_and_the_long_dash_does_not(spark):
    m = one(metrics.document_metrics(docs(spark, "well-known -- yes — no"), ["doc_id"]))
    assert m.texture_em_dashes_per_1k == 750.0


def test_pooled_equals_the_joined_text(spark):
    parts = ["One two three. Four five.\n\nSix seven!", "Eight nine ten, eleven twelve.", "Two three."]
    pooled = one(metrics.pooled_fingerprint(docs(spark, *parts), ["g"])).asDict()
    joined = one(metrics.document_metrics(docs(spark, "\n\n".join(parts)), ["g"])).asDict()
    assert pooled == joined


def test_merge_keeps_counts_and_single_rows(spark):
    per = metrics.document_metrics(docs(spark, STORY, "", "A b c. D e."), ["g", "doc_id"])
    merged = one(metrics.merge_metrics(per, ["g"]))
    assert merged.word_count == 38
    alone = one(metrics.merge_metrics(per.where("doc_id < 2"), ["g"])).asDict()
    assert alone == {k: v for k, v in per.where("doc_id = 0").collect()[0].asDict().items() if k != "doc_id"}
    assert one(metrics.merge_metrics(per.where("doc_id = 1"), ["g"])).dialogue_plain_tag_share == 1.0


# --- scoring ------------------------------------------------------------------------


def test_a_draft_matches_its_own_fingerprint(spark):
    d = docs(spark, STORY)
    report = one(score.style_reports(d, metrics.pooled_fingerprint(d, ["g"]), ["doc_id"], ["g"]))
    assert (report.fidelity, report.verdict, report.n_deviations) == (100, "pass", 0)
    assert report.thin_corpus and report.short_draft


def test_fidelity_stays_in_range_and_every_instruction_is_given(spark):
    d = docs(spark, STORY, "word " * 400, "a b c d. " * 60)
    prints = metrics.pooled_fingerprint(d.where("doc_id = 0"), ["g"])
    for r in score.style_reports(d, prints, ["doc_id"], ["g"]).collect():
        assert 0 <= r.fidelity <= 100
        assert len(r.instructions) <= r.n_deviations + r.n_repetitions
    assert max(len(r.instructions) for r in score.style_reports(d, prints, ["doc_id"], ["g"]).collect()) > 12


def test_repetition_findings(spark):
    text = "the cold gray sea rolled. " * 5 + "\n\n" + '"Go," Anna hissed. ' * 6
    found = score.repetitions(docs(spark, text), ["doc_id"]).collect()
    phrases = {f.value: (f.n, f.severity) for f in found if f.kind == "phrase"}
    assert phrases["the cold gray sea"] == (5, "blocker")
    assert [(f.value, f.n, f.severity) for f in found if f.kind == "dialogue-tag"] == [("hissed", 6, "major")]
    assert ("the cold", 5) in {(f.value, f.n) for f in found if f.kind == "sentence-opener"}


def test_one_check_of_repetition_reads_for_itself_alone(spark):
    even = "\n\n".join(" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(10)) + "." for i in range(6))
    d = docs(spark, "the cold gray sea rolled. " * 5 + '"Go off now," Anna hissed. ' * 9 + "\n\n" + even, '"', "", "Ⱥ")
    columns = ["doc_id", "kind", "value", "n", "severity", "note"]
    every = score.repetitions(d, ["doc_id"]).select(columns).collect()
    alone = {c: score.repetitions(d, ["doc_id"], checks=[c]) for c in score.CHECKS}
    rows = [r for c in score.CHECKS for r in alone[c].select(columns).collect()]
    assert {r.kind for r in rows if r.doc_id == 0} >= {"phrase", "sentence-opener", "dialogue-tag", "paragraph-shape"}
    assert sorted(rows) == sorted(every)
    plan = alone["dialogue"]._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "approx" not in plan and L.LY_ADVERB not in plan


def test_uniform_paragraphs(spark):
    even = "\n\n".join(" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(10)) + "." for i in range(6))
    found = score.repetitions(docs(spark, even), ["doc_id"]).where("kind = 'paragraph-shape'").collect()
    assert [f.n for f in found] == [6]


# --- passages ---------------------------------------------------------------------------


def fold(paras, low=60, high=320):
    """Passages as lists of paragraph numbers."""
    out, held, n, run = [], [], 0, None
    for i, (count, speech) in enumerate(paras):
        if count == 0:
            continue
        if count >= high:
            if held:
                out.append(held)
            out.append([i])
            held, n, run = [], 0, None
            continue
        if run is not None and speech != run and n >= 25:
            out.append(held)
            held, n, run = [], 0, None
        held, n = held + [i], n + count
        run = True if speech else (speech if run is None else run)
        if n >= low and not speech:
            out.append(held)
            held, n, run = [], 0, None
    return out + ([held] if held else [])


def test_passages_match_a_plain_walk(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for doc in range(60):
        paras, shape = [], []
        for p in range(rng.randint(0, 14)):
            n, speech = rng.choice([3, 8, 12, 30, 61, 330]), rng.random() < 0.5
            body = " ".join(f"{'abcdefghij'[p % 10]}{'klmno'[k % 5]}" for k in range(n))
            paras.append(f'"{body}"' if speech else body)
            shape.append((n, speech))
        rows.append((doc, "g", "\n\n".join(paras)))
        for number, group in enumerate(fold(shape)):
            if sum(shape[i][0] for i in group) >= 20:
                expected[(doc, number)] = "\n\n".join(paras[i] for i in group)
    df = spark.createDataFrame(rows, "doc_id long, g string, text string")
    got = {(r.doc_id, r.passage_no): r.text for r in structure.passages(df, ["doc_id"]).collect()}
    assert got == expected


def test_beats_and_speakers(spark):
    beats = docs(spark, "", '"Come here now," he said.', "They ran and grabbed and fell down.",
                 "She thought it over and knew and hoped.", "Blue hills lay under the wide quiet sky.",
                 "Later that night it snowed.")
    assert [r.b for r in beats.select("doc_id", structure.beat("text").alias("b")).orderBy("doc_id").collect()] == [
        "description", "dialogue", "action", "interiority", "description", "transition"]
    text = "Then Anna saw Tobias. Anna smiled. But God knew that Anna and Ilse left.\nMarcus stayed with Tobias."
    got = one(docs(spark, text).select(structure.speakers("text").alias("s"))).s
    assert got == ["Anna", "Tobias", "Ilse"]


# --- profile and formatting -----------------------------------------------------------------


@pytest.mark.parametrize("text, pov, tense", [
    ("I walked home and I knew my father was there. We had made it.", "first", "past"),
    ("You walk in. You are late and your coat is wet.", "second", "present"),
    ("She thought of her brother. She knew he was gone and she felt it.", "third_limited", "past"),
    ("The hill was bare.", "mixed", "past"),
])
def test_narration(spark, text, pov, tense):
    n = one(profile.narration(profile.profile_counts(docs(spark, text), ["doc_id"]), ["doc_id"]))
    assert (n.pov, n.tense) == (pov, tense)


def test_dialogue_does_not_decide_narration(spark):
    text = '"I am here, I am," she said. He took her hand and she thought he was cold.'
    n = one(profile.narration(profile.profile_counts(docs(spark, text), ["doc_id"]), ["doc_id"]))
    assert n.pov == "third_limited"
    kept = one(docs(spark, 'a "x y" b " z " c “q” d "m”').select(profile.without_dialogue("text").alias("t"))).t
    assert kept == 'a   b " z " c   d "m”'


def test_formatting(spark):
    text = '**"Go."** she said. "Stay." *quiet thought* and **bold** but not * this *'
    o = one(formatting.observations(docs(spark, text), ["doc_id"]))
    assert (o.dialogue_count, o.bold_dialogue_count, o.italic_count, o.bold_count) == (2, 1, 1, 2)


# --- cleaning and sources ----------------------------------------------------------------------


def test_html_to_markdown(spark):
    html = ('<style>p{}</style><h2 class="x">Title</h2><p>A <b>bold</b> &amp; <em>soft</em><br/>line</p>'
            '<span style="font-weight:700">heavy</span> <span>plain</span><script>x()</script>&mdash;&#39;')
    got = one(docs(spark, html).select(clean.html_to_markdown("text").alias("m"))).m
    assert got == "## Title\n\nA **bold** & *soft*\nline\n\n**heavy** plain—'"


def test_prose_and_plain(spark):
    md = "---\ntitle: x\n---\n# Head\n\nReal *words* here.\n\n> quote\n| a | b |\n***\n```\ncode\n```\n\n\nEnd."
    assert one(docs(spark, md).select(clean.prose("text").alias("p"))).p == "Real *words* here.\n\nEnd."
    assert one(docs(spark, "# A\n\n\n**b** `c`\n\n").select(clean.markdown_to_plain("text").alias("p"))).p == "A\n\nb c\n"


def test_redaction(spark):
    text = "Bearer abc.def and sk-abcdefghijklmnop plus token: xyz, done"
    r = one(clean.redact_table(docs(spark, text), ["doc_id"]))
    assert r.text == "Bearer [redacted] and [redacted key] plus token=[redacted], done"
    assert (r.n_bearer, r.n_key, r.n_assignment) == (1, 1, 1)


def test_admission(spark):
    files = [(0, "a.txt", "", "hi"), (1, "b.exe", "", "hi"), (2, " ", "", "hi"), (3, "c.md", "image/png", "hi"),
             (4, "n" * 250 + ".txt", "", "hi"), (5, "d.html", "text/html", "hi")]
    df = spark.createDataFrame([("b", *f) for f in files], "batch_id string, ord long, name string, mime string, text string")
    got = {r.ord: r.reason for r in scan.admit(df).collect()}
    assert got == {0: "", 1: "extension", 2: "blank", 3: "mime type", 4: "name too long", 5: ""}
    many = spark.range(103).selectExpr("'b' batch_id", "id ord", "concat(id, '.txt') name", "'' mime", "'x' text")
    assert scan.admit(many).where("admitted").count() == 100


def test_running_equals_a_plain_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abb"), i, rng.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = running(df, ["k"], "seq", {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v"), "p": ("lag", "v")}, bucket=16)
    w = Window.partitionBy("k").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"),
                     F.last("v", True).over(upto).alias("l"), F.lag("v").over(w).alias("p"))
    a, b = ({(r.k, r.seq): (r.s or 0, r.m, r.l, r.p) for r in x.collect()} for x in (got, want))
    assert a == b


def test_running_keeps_null_keys_and_orders(spark):
    rows = [(None, 1, 5), (None, 40, 7), ("a", 1, 1), ("a", None, 3), ("a", 90, 2)]
    got = running(spark.createDataFrame(rows, "k string, seq long, v long"), ["k"], "seq", {"s": ("sum", "v")}, bucket=16)
    assert sorted((r.k or "", r.seq or 0, r.s) for r in got.collect()) == [("", 1, 5), ("", 40, 12), ("a", 0, 3), ("a", 1, 4), ("a", 90, 6)]


def test_offsets_of_a_very_long_document(spark):
    text = "\n\n".join(f" line {i}" for i in range(100_000))
    found = docs(spark, text).select(F.explode(T.chunks_with_offsets("text")).alias("x")).select("x.*")
    rows = [(r.text, r.char_offset) for r in found.collect()]
    assert len(rows) == 100_000
    assert all(text[at : at + len(line)] == line for line, at in rows)


# --- classification and manuscripts -----------------------------------------------------------------


def test_classification(spark):
    prose = "\n\n".join(['"Stay," she said to the tall old man by the door of the house.'] * 40)
    rows = [
        (0, "Book 2 manuscript.md", "/x", prose),
        (1, "cast.md", "/x/characters", "Name: Anna\nAge: 30\nRole: thief\n"),
        (2, "outline.md", "/x/plot", "- one\n- two\n- three\n"),
        (3, "empty.md", "/x", "  "),
        (4, "thing.md", "/x", "plain words"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, name string, path string, text string")
    got = {r.doc_id: r for r in classify.classify(df, ["doc_id"]).collect()}
    assert [got[i].kind for i in range(5)] == ["past_book", "characters", "plot", "notes", "notes"]
    assert (got[3].confidence, got[3].reasons) == (0.2, ["file is empty or unreadable"])
    assert got[4].reasons == ["no signal"]
    assert "notes" in got[2].suggested


BOOK = (
    "Chapter One\n\n" + "It was cold and the road was long. " * 10 + "\n\n* * *\n\nMore came.\n\n"
    "Chapter Two\n\n" + "They walked all day and said little. " * 10 + "\n\nEpilogue\n\nYears on it was quiet.\n\n"
    "Acknowledgements\n\nThanks to all."
)


def test_manuscript(spark):
    m = one(manuscript.manuscripts(docs(spark, BOOK), ["doc_id"]))
    assert [c.heading for c in m.chapters] == ["Chapter One", "Chapter Two"]
    assert BOOK[m.epilogue_at:].startswith("Epilogue") and BOOK[m.back_matter_at:].startswith("Acknowledgements")
    assert (m.complete, m.scene_break, m.heading_case) == (True, "* * *", "title")
    merged = one(manuscript.merge_continuations(
        docs(spark, BOOK).select("doc_id", "text"), spark.createDataFrame([(0, " New part. ")], "doc_id long, addition string"),
        ["doc_id"]))
    assert "New part.\n\nEpilogue" in merged.text and merged.text.endswith("Thanks to all.")


def test_unfinished_endings(spark):
    d = docs(spark, "He stopped and", "He stopped because.", "He stopped.", "")
    got = {r.doc_id: r.complete for r in manuscript.manuscripts(d, ["doc_id"]).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True}


def test_caps_sign_inside_prose_is_no_heading(spark):
    text = "A door. " * 30 + "\nKEEP OUT NOW\nhe read. " + "More words here. " * 30
    assert len(manuscript.chapters(docs(spark, text), ["doc_id"]).collect()) == 1


# --- evidence ---------------------------------------------------------------------------------------------


def library(spark, rows):
    return spark.createDataFrame(
        [("b", i, i, name, text, kinds) for i, (name, text, kinds) in enumerate(rows)],
        "book_id string, doc_id long, ord long, name string, text string, kinds array<string>")


def test_names_and_findings(spark):
    story = ("Chapter 1\n\nThat night Mira kissed Jonas by the river, and Mira laughed. They saw Jonas and Mira again.\n\n"
             "Then Mira and Jonas were together, and everyone knew that Jonas loved Mira.")
    lib = library(spark, [
        ("book.md", story, ["past_book", "reference_book"]),
        ("plan.md", "Premise: A thief must return what she stole before dawn.\nThe protagonist is Mira\n"
                    "Ending: they burn the map together at last.", ["plot"]),
    ])
    names = evidence.character_names(lib, ["book_id"])
    # Equal scores rank by name.
    assert [r.name for r in names.orderBy("rank").collect()][:2] == ["Jonas", "Mira"]
    genres = inventory.rank_genres(inventory.genre_hits(lib, ["book_id"]), ["book_id"])
    assert one(genres).genre == "Romance"
    prof = findings.profile_for_findings(
        profile.pooled_counts(profile.profile_counts(lib, ["book_id"]), ["book_id"]), ["book_id"])
    found = {r.key: r for r in findings.findings(lib, names, genres, prof, ["book_id"]).collect()}
    assert found["premise"].value == "A thief must return what she stole before dawn."
    assert found["structure"].value == "they burn the map together at last."
    assert (found["protagonist"].value, found["protagonist"].confidence) == ("Mira", 0.78)
    assert found["relationships"].value.startswith("Jonas and Mira are a couple")
    edits = spark.createDataFrame([("b", "premise", "  "), ("b", "setting", "A mill")], "book_id string, key string, value string")
    after = {r.key: r for r in findings.apply_edits(
        findings.findings(lib, names, genres, prof, ["book_id"]), edits, ["book_id"]).collect()}
    assert "premise" not in after and after["setting"].confidence == 1.0 and after["setting"].edited


def test_long_snippets_end_on_a_sentence(spark):
    line = "Setting: " + "A town of salt. " * 40
    got = one(docs(spark, line).select(evidence.labelled(F.col("text"), r"(?:setting)\s*[:\-]\s*([^\n]+)").alias("v"))).v
    assert got.endswith("salt.") and 280 < len(got) <= 300


# --- continuity -----------------------------------------------------------------------------------------------


def person(name, place, knows=(), condition="", seen=1):
    return (name, place, list(knows), condition, "calm", [], seen)


def handoffs(spark, rows):
    schema = ("book_id string, chapter long, ends_at_location string, timeline struct<chapter:int,ends_at:string,elapsed:string,"
              f"is_flashback:boolean>, characters array<{continuity.CHARACTER}>, closing_beat string, open_question string, arrival_seq long")
    return spark.createDataFrame(rows, schema)


def test_flow_issues(spark):
    ledger = handoffs(spark, [
        ("b", 1, "the mill", (1, "Day 4, dusk", "", False), [person("Anna", "the mill", ["the code"], "a broken arm")], "x",
         "Who forged the letter from Geneva?", 1)])
    claims = handoffs(spark, [
        ("b", 2, "Paris", (2, "Day 2", "", False), [person("anna", "Paris", ["the code", "the traitor"], "", 2)], "y", "", 2)])
    drafts = spark.createDataFrame([("b", 2, "Anna sat in a cafe and drank.")], "book_id string, chapter long, text string")
    threads = spark.createDataFrame(
        [("b", "t1", "Where is the brother?", 1, 1, "open", 1, "main"), ("b", "t2", "Who?", 1, 1, "resolved", 1, "main")],
        "book_id string, thread_id string, question string, opened_chapter int, last_touched_chapter int, status string, "
        "must_resolve_by int, weight string")
    promises = spark.createDataFrame([("b", "p1", "the gun", 1, None)],
                                     "book_id string, promise_id string, setup string, planted_chapter int, paid_off_chapter int")
    heads = spark.createDataFrame([("b", "series", 3, ["fact"])],
                                  "book_id string, shape string, planned_chapters int, inherited_canon array<string>")
    issues = continuity.flow_issues(drafts, ledger, claims, threads, promises, heads)
    assert {(r.kind, r.severity) for r in issues.collect()} == {
        ("location-jump", "blocker"), ("condition-ignored", "major"), ("timeline-regression", "blocker"),
        ("dropped-hook", "major"), ("knowledge-violation", "major"), ("overdue-thread", "blocker"), ("unpaid-promise", "major")}
    assert one(continuity.flow_reports(drafts, issues)).verdict == "fail"
    moved = drafts.withColumn("text", F.lit("Anna drove all night from the mill with a broken arm."))
    kinds = {r.kind for r in continuity.handoff_issues(moved, ledger, claims).collect()}
    assert "location-jump" not in kinds and "condition-ignored" not in kinds


def test_knowledge_is_judged_by_earlier_chapters(spark):
    ledger = handoffs(spark, [
        ("b", n, "x", (n, "", "", False), [person("Anna", "x", facts, "", n)], "", "", n)
        for n, facts in ((1, ["the code"]), (2, ["the code", "the traitor"]), (3, ["the code", "the traitor", "the heir"]))])
    drafts = spark.createDataFrame([("b", n, "Nothing is told.") for n in (1, 2, 3)], "book_id string, chapter long, text string")
    found = continuity.knowledge_issues(drafts, ledger, ledger).collect()
    assert sorted((r.chapter, r.subject) for r in found) == [(2, "the traitor"), (3, "the heir")]
    duties = continuity.obligations(
        drafts, ledger,
        spark.createDataFrame([("b", "t", "Who?", 2, 2, "open", None, "main")],
                              "book_id string, thread_id string, question string, opened_chapter int, last_touched_chapter int, "
                              "status string, must_resolve_by int, weight string"),
        spark.createDataFrame([("b", "p", "the gun", 1, None)],
                              "book_id string, promise_id string, setup string, planted_chapter int, paid_off_chapter int"),
        spark.createDataFrame([("b", "single", 3, [])], "book_id string, shape string, planned_chapters int, inherited_canon array<string>"))
    assert sorted((r.chapter, r.section) for r in duties.collect() if r.section in ("thread", "promise")) == [
        (2, "promise"), (3, "promise"), (3, "thread")]


def test_a_gap_means_no_previous_handoff(spark):
    ledger = handoffs(spark, [("b", 1, "x", (1, "", "", False), [], "", "q", 1)])
    drafts = spark.createDataFrame([("b", 3, "text")], "book_id string, chapter long, text string")
    assert continuity.handoff_issues(drafts, ledger, ledger).count() == 0


def test_words_column_is_reused(spark):
    assert one(docs(spark, "a b").select(T.word_count("text").alias("n"))).n == 2


# --- stored measures ---------------------------------------------------------------


def test_measures_add_up_and_reports_read_no_text(spark):
    d = docs(spark, STORY, "", "A b c. D e.\n\nF g, \"h i\" said J.")
    measured = cut_lineage(score.measured_drafts(d, ["g", "doc_id"]))
    prints = metrics.fingerprints(measured, ["g"])
    assert one(prints) == one(metrics.pooled_fingerprint(d, ["g"]))
    rows = {r.doc_id: r for r in metrics.draft_metrics(measured, ["g", "doc_id"]).collect()}
    assert rows == {r.doc_id: r for r in metrics.document_metrics(d, ["g", "doc_id"]).collect()}
    report = score.reports(measured, prints, ["doc_id"], ["g"], columns=("fidelity", "verdict"))
    assert report.columns == ["doc_id", "g", "fidelity", "verdict"]
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "split(" not in plan and "instruction" not in plan.split("\n")[0]


def test_a_rebuild_replaces_its_books_only(spark):
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    schema = "book_id string, doc_id long, text string"
    first = spark.createDataFrame([("a", 1, STORY), ("b", 2, STORY), ("b", 3, "One two.")], schema)
    corpus.build(first, root)
    before = {r.book_id: r.word_count for r in corpus.read(spark, root, "fingerprints").collect()}
    corpus.build(spark.createDataFrame([("b", 2, "Only three words.")], schema), root)
    after = {r.book_id: r.word_count for r in corpus.read(spark, root, "fingerprints").collect()}
    assert after == {"a": before["a"], "b": 3} and before["b"] > 3
    stats = {(r.book_id, r.doc_id) for r in corpus.read(spark, root, "document_stats").collect()}
    assert stats == {("a", 1), ("b", 2)} == {(r.book_id, r.doc_id) for r in corpus.read(spark, root, "measures").collect()}
    passages = corpus.read(spark, root, "passages").collect()
    assert {r.book_id for r in passages} <= {"a"} and all(r.metrics.word_count == r.n_words for r in passages)


def test_interval_join_meets_matching_pairs_only(spark):
    rng = random.Random(8)
    points = [(rng.choice("ab"), rng.choice([None, *range(300)]), i) for i in range(300)]
    spans = [(rng.choice("abc"), rng.choice([None, *range(320)]), rng.choice([None, *range(320)]), i) for i in range(200)]
    p = spark.createDataFrame(points, "k string, x int, p int")
    s = spark.createDataFrame(spans, "k string, a int, z int, s int")
    got = {(r.p, r.s) for r in interval_join(p, s, ["k"], "x", "a", "z").collect()}
    assert got == {(i, j) for k, x, i in points for m, a, z, j in spans
                   if k == m and x is not None and a is not None and a <= x and (z is None or x <= z)}
    got = {(r.p, r.s) for r in interval_join(p, s.drop("z"), ["k"], "x", "a").collect()}
    assert got == {(i, j) for k, x, i in points for m, a, z, j in spans if k == m and x is not None and a is not None and a <= x}


def test_ten_thousand_chapters_and_threads_of_one_book_meet_where_they_match(spark):
    chapters = spark.range(10_000).select(F.lit("b").alias("k"), F.col("id").cast("int").alias("x"))
    threads = spark.range(10_000).select(F.lit("b").alias("k"), (F.col("id") % 9_000 + 990).cast("int").alias("a"),
                                         (F.col("id") % 9_000 + 992).cast("int").alias("z"), F.col("id").alias("s"))
    met = interval_join(chapters, threads, ["k"], "x", "a", "z")
    want = sum(min(9_999, i % 9_000 + 992) - (i % 9_000 + 990) + 1 for i in range(10_000) if i % 9_000 + 990 <= 9_999)
    assert met.count() == want
    pairs = interval_join(chapters, threads, ["k"], "x", "a", "z", width=64)
    assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_paragraphs_stay_where_they_are(spark):
    d = spark.createDataFrame([("b", 1, "Anna kissed Tobias.\n\nAnna and Mara left.", ["past_book"])], "book_id string, doc_id long, text string, kinds array<string>")
    names = spark.createDataFrame([("b", i + 1, n) for i, n in enumerate(["Anna", "Tobias", "Mara"])], "book_id string, rank int, name string")
    pairs = evidence.relationship_pairs(d, names, ["book_id"])
    assert {(r.first, r.second) for r in pairs.collect()} == {("Anna", "Tobias"), ("Anna", "Mara")}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        assert not ("Exchange hashpartitioning" in line and "doc_id" in line)


def test_bad_records_are_kept(spark):
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    lines = ['{"id": 1, "text": "a"}', '{"id": 2, "te', '{"id": "x", "text": "b"}', '{"id": 3, "text": ""}', "", '{"id": 4}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{root}/json")
    good, bad = scan.read_records(spark, f"{root}/json", "json", "id int, text string", f"{root}/out")
    assert [tuple(r) for r in good.collect()] == [(1, "a")]
    assert sorted(tuple(r) for r in bad.collect()) == [
        ("", "no text"), ("", "no text"), ('{"id": "x", "text": "b"}', "malformed"), ('{"id": 2, "te', "malformed")]
    spark.createDataFrame([("id,text",), ('1,"a, ""b""',), (' c"',), ("x,d",), ("2,e",)], "value string").coalesce(1).write.text(f"{root}/csv")
    good, bad = scan.read_records(spark, f"{root}/csv", "csv", "id int, text string", f"{root}/out2")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 'a, "b"\n c'), (2, "e")]
    assert [tuple(r) for r in bad.collect()] == [("x,d", "malformed")]
    files = f"{root}/text"
    spark.createDataFrame([("one\ntwo",)], "value string").coalesce(1).write.text(files)
    assert [r.text for r in scan.read_documents(spark, files, "text").collect()] == ["one\ntwo\n"]


def test_only_asked_manuscript_columns_are_planned(spark):
    d = docs(spark, BOOK)
    plan = manuscript.manuscripts(d, ["doc_id"], columns=["quotes", "scene_break"])._jdf.queryExecution().optimizedPlan().toString()
    assert "closing punctuation" not in plan and "Untitled section" not in plan
    whole = one(manuscript.manuscripts(d, ["doc_id"])).asDict()
    some = one(manuscript.manuscripts(d, ["doc_id"], columns=["quotes", "scene_break", "complete"])).asDict()
    assert some == {k: whole[k] for k in ("doc_id", "quotes", "scene_break", "complete")}


def test_readings_scan_only_for_their_counts(spark):
    every = profile.profile_counts(docs(spark, "She saw the cold dark sea. I was afraid as if lost."), ["doc_id"])
    for columns, reading in ((profile.DISTANCE_COUNTS, profile.distance), (profile.SENSORY_COUNTS, profile.sensory),
                             (profile.EMOTION_COUNTS, profile.emotion), (profile.NARRATION_COUNTS, profile.narration)):
        asked = profile.profile_counts(docs(spark, "She saw the cold dark sea. I was afraid as if lost."), ["doc_id"], columns=columns)
        assert set(asked.columns) == {"doc_id", *columns}
        assert one(reading(asked, ["doc_id"])) == one(reading(every, ["doc_id"]))


def test_counts_of_a_book_are_read_once_by_all_readings(spark, monkeypatch):
    from proseloom.plans import queries_project as Q

    made = []
    monkeypatch.setattr(Q, "cut_lineage", lambda df, keep=Q.cut_lineage: made.append(set(df.columns)) or keep(df))
    Q.int11(spark, "/root/testdata/sf0.001")
    assert [c for c in made if {"sample_chars", "first", "aud_0", "romance"} <= c]


def test_the_first_usable_line_decides(spark):
    text = "Setting: x\nsetting - a drowned kingdom, far\nSetting: a second kingdom"
    row = spark.createDataFrame([(text, "short\n# " + "h" * 30 + "\n- a line of more than twenty-five signs\nlast")], ["t", "u"]).select(
        evidence.labelled(F.col("t"), L.LABELS["setting"]).alias("a"), evidence.useful_line(F.col("u")).alias("b")).first()
    assert (row.a, row.b) == ("a drowned kingdom, far", "a line of more than twenty-five signs")


def test_last_word_and_names_of_long_texts(spark):
    from proseloom.operators import manuscript as M

    texts = ["one two." + "!" * 300, "it wasn't" + "." * 5, "x" * 400 + ".", "end of and.", "...", "a " * 200 + "didn't'."]
    for text in texts:
        found = re.search(rf"({L.WORD})[^a-zÀ-ɏ]*\Z", text.lower())
        got = spark.createDataFrame([(text,)], ["t"]).select(M._last_word(F.col("t")).alias("w")).first().w
        assert got == (found[1] if found else "")
    told = "Anna Vale ran. Anna saw Anna Vale, and Anna. Tobias met Anna Vale."
    rows = spark.createDataFrame([(told,)], ["t"]).select(F.inline(evidence._counted_mentions(F.col("t")))).collect()
    assert {tuple(r) for r in rows} == {("Anna Vale", 3, 2), ("Anna", 2, 1), ("Tobias", 1, 0)}
