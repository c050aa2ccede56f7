"""Page extraction, near duplicates, personal data, licences, languages and quality on small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from proseloom.llm import html, langid, license, pii, quality, simhash
from proseloom.llm.graph import components

SF = "/root/testdata/sf0.001"

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, really.</div>
<div id="page"><div class="sidebar"><p>Popular, posts, here, now, then.</p></div>
<div class="story"><h1>The  Title</h1><p>First, long &amp; <b>bold</b>
 paragraph of the article, with commas.<p>Second&nbsp;paragraph, unclosed, but fine &lt;ok&gt;.
<div class="share">Share this, please</div><ul><li>an item of prose, in the article</li></ul></div>
<div class="comments"><p>I disagree, strongly, with all of this, said a reader, twice.</p></div></div>
<form><p>Your name, please</p></form><footer>&copy; 2020, someone</footer></body></html>"""


def test_page_text_keeps_the_article_only():
    assert html.main_text(PAGE).split("\n") == [
        "The Title", "First, long & bold paragraph of the article, with commas.",
        "Second paragraph, unclosed, but fine <ok>.", "an item of prose, in the article",
    ]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<article>x <br> y</article>", "x y"),
    ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"), ("<article><p>cut off &am", "cut off &am"), ("<!-- only a comment", ""),
    ("<article><h1>T</h1><p>Short.</p></article><footer>f, f, f, f, f, f</footer>", "T\nShort."),
])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def test_what_stands_beside_an_article_is_kept():
    told = "<p>One part, long enough, of what the page tells, with commas.</p>" * 3
    page = f"<body><main><h1>Title</h1><p>A lead that ends here.</p><article>{told}</article><ul><li><a>Other</a></li><li><a>Pages</a></li></ul></main></body>"
    told = "One part, long enough, of what the page tells, with commas.\n" * 3
    assert html.main_text(page) == "Title\nA lead that ends here.\n" + told.strip()
    parts = "".join(f"<article><p>Part {i}, long enough, with commas, of the page.</p></article>" for i in range(3))
    for page in (parts, f"<body>{parts}</body>", f"<body><div>{parts}</div></body>"):
        assert html.main_text(page).split("\n") == [f"Part {i}, long enough, with commas, of the page." for i in range(3)]
    page = "<body><article><p>Prose, with commas, of the article, first.</p><ul><li><a>Source one</a></li><li><a>Source two</a></li></ul></article></body>"
    assert html.main_text(page).split("\n")[1:] == ["Source one", "Source two"]


LONG = "<p>" + "One part, long enough, of what the page tells, with commas. " * 3 + "</p>"


@pytest.mark.parametrize("name", ["main-nav", "post-related", "article-sidebar", "content-ad", "post-share", "story-promo", "user-feedback"])
def test_compound_names_are_judged_by_their_last_word(name):
    page = f'<div class="post">{LONG * 2}</div><div class="{name}">{LONG}</div>'
    assert len(html.main_text(page).split("\n")) == 2
    assert len(html.main_text(page.replace("class", "id")).split("\n")) == 2


@pytest.mark.parametrize("page, blocks", [
    (f'<div class="widget">{LONG * 3}</div>', 3), (f'<div class="search-results-page">{LONG * 3}</div>', 3),
    (f'<div class="sidebar">{LONG * 3}</div>', 3), (f'<body class="has-sidebar"><div class="with-nav">{LONG * 3}</div></body>', 3),
    (f'<article>{LONG}<div class="alert">Mind the gap, reader, here.</div>{LONG}</article>', 3),
    (f'<article>{LONG}<p class="search">A search began.</p><p id="hidden-fees">Fees rose.</p></article>', 3),
    (f'<article><div class="entry-header"><h1>Title</h1></div>{LONG}</article>', 2),
    (f'<div>{LONG * 2}</div><div id="discussion">{LONG}</div>', 2), (f'<article>{LONG}<section id="discussion">{LONG}</section></article>', 2),
    (f'<div><div>{LONG * 5}</div><div>{LONG}</div></div>', 6),
    (f'<div><div><div>{LONG * 3}</div></div><div><div>{LONG * 3}</div></div></div>', 6),
    (f'<div><p>A short lead</p><div>{LONG * 4}</div><p>The end</p></div>', 6),
    ("<table><tr><td>a, b</td><td>c</td><td>d</td></tr></table>", 3),
    (f'<table><tr><td><a>Home</a></td><td>{LONG * 3}</td></tr></table>', 3),
])
def test_articles_lose_and_gain_nothing(page, blocks):
    assert len(html.main_text(page).split("\n")) == blocks


@pytest.mark.parametrize("page, text", [
    ("<p>one <script>x()</script> two</p>", "one two"), ('<article><p>one <span class="ad">x</span> two</p></article>', "one two"),
    ('<article><p>one <span hidden>x</span>two</p></article>', "one two"), ("<article><p>so <math><mi>x</mi></math> is</p></article>", "so x is"),
])
def test_dropped_inline_elements_break_no_block(page, text):
    assert html.main_text(page) == text


def test_an_empty_table_of_pages(spark):
    none = spark.createDataFrame([], "html string, text string").select(html.extract(F.col("html")).alias("t"), "text")
    assert none.count() == 0


def test_deep_and_long_pages_end():
    assert html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(html.main_text("<article>" + "<p>word, word</p>" * 20000 + "</article>").split("\n")) == 20000


def test_extract_keeps_rows(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "<p>a")], "page_id long, html string")
    got = rows.select("page_id", html.extract(F.col("html")).alias("t")).collect()
    assert sorted(map(tuple, got)) == [(1, ""), (1, ""), (2, "a")]


def _plain_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_components(prints: dict) -> dict:
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z ".split()
    texts = [None, "", " \t\n", "One", "one", "ÄÖ two", "äö two", "x y", "\x1cq r s"]
    texts += [" ".join(base * 8 + [f"t{i}"]) for i in range(40)] + [" ".join(base * 8)] * 5 + ["w " * 40_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(rows).collect()
    prints = {i: _plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == _brute_components(prints)


def test_near_duplicates_of_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r["doc_id"]: _plain_fingerprint(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == _brute_components(prints)


def test_keep_one_row_of_each_group(spark):
    rows = spark.createDataFrame(
        [(3, "a b c d", 1), (1, "A b c d", 2), (1, "A b c d", 2), (7, None, 3), (8, "", 4), (None, "a b c d", 5)],
        "doc_id long, text string, component_id int",
    )
    got = simhash.keep_one(rows).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 5), (1, 2), (7, 3)]
    assert simhash.keep_one(rows.limit(0)).count() == 0


def test_components_follow_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)] + [(2000, 2000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert set(got.values()) == {0, 1000, 2000} and len(got) == 301 + 2 + 50
    assert components(edges.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.ball_masks(3)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain_spans(text: str) -> str:
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            fits = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.group().split(".")),
                "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }
            if fits[kind]:
                out.append((match.start(), order, f"{kind}:{match.start()}:{match.end()}"))
    return ",".join(x for *_, x in sorted(out))


@pytest.fixture(scope="module")
def trees(spark):
    return pii.fit(pii.training_rows(spark))


def test_base_spans_match_plain_patterns(spark, trees):
    rng = np.random.default_rng(7)
    texts = [None, "", "a@b.c_d@e.f.g x", "é😀 me@x.org, 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.04", "4111 1111 1111 1111 +1 (988) 555-2485",
             "1" * 4000 + " " + "a" * 3000, " ".join(f"u{i}@ex{i}.com +1 415 555 {i:04d}" for i in range(1200))]
    texts += ["".join(rng.choice(list("ab1@..-+ ()23_"), int(rng.integers(5, 60)))) for _ in range(800)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find(rows, trees).select("text", pii.joined(F.col("base")).alias("b"), pii.joined(F.col("spans")).alias("s")).collect():
        plain = _plain_spans(row["text"] or "")
        assert row["b"] == plain
        assert set(filter(None, plain.split(","))) <= set(row["s"].split(","))


def test_wider_candidates(spark, trees):
    cases = {
        "call me: 555-234-5678": "phone:9:21", "ssn 123-45-6789": "ssn:4:15", "joe [at] mail dot com": "email:0:21",
        "IBAN DE89370400440532013000": "iban:5:27", "on 2024-01-02 we met": "", "item 12345678": "", "look at this.then": "",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r["text"]: r["s"] for r in pii.find(rows, trees).select("text", pii.joined(F.col("spans")).alias("s")).collect()}
    assert got == cases


def test_neighbouring_numbers_are_told_apart(spark, trees):
    cases = {
        "202-555-0143 202-555-0144": "phone:0:12,phone:13:25", "(202) 555-0143 / (202) 555-0144": "phone:0:14,phone:17:31",
        "123-45-6789 202-555-0143": "ssn:0:11,phone:12:24", "2024-01-02 202-555-0143": "phone:11:23",
        "Call 202-555-0143. 5 people": "phone:5:17", "Ring 202-555-0143 (2 lines)": "phone:5:17",
        "202-555-0143 10.0.0.1": "phone:0:12,ip:13:21", "call me: 202-555-0143 202-555-0144": "phone:9:21,phone:22:34",
        "phone 1-202-555-0143, item 12345678": "phone:6:20", "tel. 030 1234 5678. 5 people": "phone:5:18", "call me: 5551234567. 5 people": "phone:9:19",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r["text"]: r["s"] for r in pii.find(rows, trees).select("text", pii.joined(F.col("spans")).alias("s")).collect()}
    assert got == cases


def test_redaction_changes_text_and_count_only(spark, trees):
    rows = spark.createDataFrame(
        [(1, "write a@b.cd, or +1 (988) 555-2485!", 35, "x"), (2, None, 0, None), (3, "clean", 5, "y")],
        "doc_id long, text string, n_chars long, spans string",
    )
    got = sorted(map(tuple, pii.redact(rows, trees).collect()))
    assert got == [(1, "write [EMAIL], or [PHONE]!", 26, "x"), (2, None, 0, None), (3, "clean", 5, "y")]
    assert pii.redact(rows.limit(0), trees).columns == rows.columns


def test_pii_query_of_the_given_table(spark):
    from proseloom.llm.queries import op3_pii

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in op3_pii(spark, SF).collect():
        plain = _plain_spans(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
        assert row["n_email"] == plain.count("email:") and row["n_phone"] == plain.count("phone:")


@pytest.fixture(scope="module")
def notices():
    return license.train(["The river was wide and the boats were slow.", "He counted to twelve, twice."] * 20)


def test_licences_are_told_apart(notices):
    for family, texts in license.TEMPLATES.items():
        assert [notices.classify(t)[0] for t in texts] == [family] * len(texts)
    assert {notices.classify(t)[0] for t in license.OTHERS} == {license.UNKNOWN}
    assert notices.classify("Licensed under the Apache License, Version 1.1.")[0] == "Apache"


def test_licence_spans(spark, notices):
    text = "é one\nReleased under the MIT License.\n\nno license here at all, said the bear\nLicensed under CC BY-NC 4.0."
    rows = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "word " * 50_000)], "doc_id long, text string").withColumn("spans", F.lit(0))
    got = sorted((r["doc_id"], [(s["family"], text[s["start"] : s["end"]]) for s in r["spans"]]) for r in license.scan(rows, notices).collect())
    found = [("MIT", "Released under the MIT License."), ("CC-BY-NC", "Licensed under CC BY-NC 4.0.")]
    assert got == [(1, found), (1, found), (2, []), (3, []), (4, [])]
    long = "Words of no use here. " * 40 + "Released under the MIT License. " + "More words follow here. " * 40
    assert [s[0] for s in notices.scan(long)] in ([], ["MIT"])
    covered = sum(e - s for s, e in license.paragraphs(long))
    assert covered == len(long)


def test_forward_backward_matches_the_plain_recursion():
    rng = np.random.default_rng(3)
    step, sizes = rng.random((3, 3)) + 0.1, np.array([1, 32, 33, 100, 2])
    potential = rng.random((sizes.sum(), 3)) + 0.01
    got, start = langid.forward_backward(potential, step, sizes), 0
    for size in sizes:
        part = potential[start : start + size]
        ahead, back = [np.full(3, 1 / 3)], [np.ones(3)]
        for row in part:
            ahead.append((ahead[-1] @ step) * row / 3)
        for row in part[::-1]:
            back.append(step @ (row * back[-1]) / 3)
        exact = np.array(ahead[1:]) * np.array(back[-2::-1])
        assert np.allclose(got[start : start + size], exact / exact.sum(axis=1, keepdims=True))
        start += size


@pytest.fixture(scope="module")
def field(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_language_held_out_accuracy(spark):
    from proseloom.llm.queries import op8_language_id

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = op8_language_id(spark, sf).where("held_out").join(docs, "doc_id").collect()
    assert len(held) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_of_odd_texts(spark, field):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the of and"), (4, "the of and"), (5, "und " * 60_000)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(rows.withColumn("lang_pred", F.lit(1)), field).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    empty = langid.fit(rows.select("text", F.lit("x").alias("lang")).limit(0))
    assert {r["lang_pred"] for r in langid.predict(rows, empty).collect()} == {"und"}


def test_code_switching_is_labelled_by_word(spark, field):
    text = "the reason that this is for and with nicht der schen und die einer von für mit"
    runs = spark.createDataFrame([(text,)], "text string").select(langid.label_runs(F.col("text"), field).alias("r")).first()["r"]
    assert [r["lang"] for r in runs] == ["en", "de"]
    assert text[runs[0]["start"] : runs[0]["end"]].endswith("with")


def test_quality_held_out_accuracy(spark):
    from proseloom.llm.queries import op10_quality

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = op10_quality(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 500
    assert np.mean([r["quality"] == r["predicted"] for r in held]) > 0.97


def test_quality_of_odd_texts(spark):
    docs = spark.createDataFrame(
        [(i, "Good words, well put. " * 9 if i % 2 else "BAD!! BAD!! " * 9) for i in range(40)] + [(90, None), (91, ""), (91, ""), (92, "a " * 60_000)],
        "doc_id long, text string",
    ).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 44 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] < 40)
    blank = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, blank).collect()} == {0.5}


def test_quality_sample_counts_a_repeated_document_once(spark):
    docs = spark.range(20).selectExpr("id AS doc_id", "repeat(IF(id % 2 = 1, 'Good words, well put. ', 'BAD!! BAD!! '), 9) AS text")
    docs = docs.union(spark.range(7_000).selectExpr("0L AS doc_id", "repeat('BAD!! BAD!! ', 9) AS text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 7_020 and all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got)


def test_attention_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    counts, labels = np.array([1, 3, 2]), np.array([0.0, 1.0, 1.0])
    features = rng.normal(size=(6, quality.FEATURES))
    model = quality.train([], [])
    for name, value in model.weights.items():
        model.weights[name] = rng.normal(size=value.shape) * 0.5

    def loss() -> float:
        p = model.score(features, counts)[0]
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())

    slopes = model.slopes(model.forward(features, counts), counts, labels)
    for name, slope in slopes.items():
        at = tuple(rng.integers(n) for n in slope.shape)
        kept, small = model.weights[name][at], 1e-5
        model.weights[name][at] = kept + small
        up = loss()
        model.weights[name][at] = kept - small
        down = loss()
        model.weights[name][at] = kept
        assert np.isclose((up - down) / (2 * small), slope[at], atol=1e-7)


def test_unrelated_digits_do_not_decide_about_a_number(spark):
    texts = ["tel 12 34 56 78 90 x", "tel 12 34 56 78 90 x, room 555"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r.s for r in pii.find(rows).select("doc_id", pii.joined(F.col("spans")).alias("s")).orderBy("doc_id").collect()]
    assert got[0] == got[1]
    for name, guard in pii.GUARD.items():
        for sample in ["12 34 56 78 90", "202-555-0143", "123-45-6789", "01 23 45 67 89", "GB29 NWBK 6016", "a.b [at] c.d", "1:2:3:4:5", "1234567"]:
            if re.search((pii.WIDE | pii.BOUNDED)[name], sample):
                assert re.search(guard, sample), (name, sample)


def test_letters_by_category_with_their_marks():
    assert langid.WORD.findall("½ ² ① x² हिन्दी e\u0301t 3rd") == ["x", "हिन्दी", "e\u0301t", "rd"]


def test_texts_without_letters_and_languages_of_long_texts(spark):
    rows = [("de", "und der Wald ist groß " * 3), ("en", "the woods are deep " * 3), ("fr", "la forêt est grande et belle " * 1200), (None, "x"), ("en", None)]
    table = spark.createDataFrame(rows * 5, "lang string, text string")
    sample = langid.training_sample(table).groupBy("lang").agg(F.max(F.char_length("text")).alias("n")).collect()
    assert {r.lang for r in sample} == {"de", "en", "fr"} and max(r.n for r in sample) == langid.SAMPLE_CHARS
    docs = spark.createDataFrame([(1, "½ ² ①"), (2, "la forêt est belle"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(table)).collect()}
    assert got == {1: "und", 2: "fr", None: "und"}
    assert langid.predict(docs.limit(0), langid.fit(table)).count() == 0
