"""Tokenizer alignment, periodic runs and the url filter against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import accumulate, combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseloom.llm import crosstok, periodic, queries, urlrules

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


# Tokenizer alignment.

@pytest.fixture(scope="module")
def files():
    return queries.tokenizer_path(queries.BYTE_FILE), queries.tokenizer_path(queries.PIECE_FILE)


@pytest.fixture(scope="module")
def plain(files):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(files[0])
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=files[1])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def align(text):
        """(A ids, B ids, groups) by the decoded bytes alone."""
        if not text:
            return None
        ids, pieces = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids]
        right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            return None
        left, right = list(accumulate(map(len, left))), list(accumulate(map(len, right)))
        groups, i, j = [], 0, 0
        for end in sorted(set(left) & set(right)):
            to_i, to_j = left.index(end) + 1, right.index(end) + 1
            groups.append((tuple(ids[i:to_i]), tuple(pieces[j:to_j])))
            i, j = to_i, to_j
        return ids, pieces, groups

    return align


def _told(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


ODD = [
    None, "", " ", "  ", "x ", "x  ", " x", "a\nb", "a\n b", "a \n\n b\t", "<|endoftext|> <s> <0x41>", "don't we'll", "▁x y", "é€😀x 龘龘 中",
    "a\x00b", "퟿\xa0 ß", "１２ 34567", "tab\t tab", "e\u0301 \u200d🏽", "word " * 3000 + "é",
]


def test_alignment_equals_decoded_bytes(files, plain):
    rng = random.Random(3)
    letters = "ab c\n\t é€😀龘中'12\x00\u3000\xa0\u0301ß,.\r▁<>"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    aligner = crosstok.SpanAligner(*files)
    for _ in range(2):  # The second time from the cache.
        sizes, told, row, pairs, times = aligner.batch(texts)
        links = [Counter() for _ in texts]
        for r, p, n in zip(row.tolist(), pairs.tolist(), times.tolist()):
            links[r][p >> 32, p & 0xFFFFFFFF] = n
        for text, size, groups, found in zip(texts, sizes.tolist(), told, links):
            want = plain(text)
            assert groups == (_told(want[2]) if want else ""), text
            assert size == ([len(want[0]), len(want[1]), len(want[2])] if want else [0, 0, 0])
            assert found == (Counter((a[-1], b[-1]) for a, b in want[2]) if want else Counter())


def test_alignment_without_cuts_and_with_a_small_cache(files, plain, monkeypatch):
    monkeypatch.setattr(crosstok, "CACHE_STRETCHES", 3)
    aligner = crosstok.SpanAligner(*files)
    aligner.cuttable = False
    for text in ODD[1:]:
        want = plain(text)
        assert aligner.batch([text, text])[1] == [_told(want[2]) if want else ""] * 2


def _sums(texts, plain):
    done = [plain(t) for t in texts]
    ends = [[(a[-1], b[-1]) for a, b in d[2]] if d else [] for d in done]
    counts = Counter(x for e in ends for x in e)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for d, e in zip(done, ends):
        yield (
            len(d[0]) if d else 0, len(d[1]) if d else 0, len(d[2]) if d else 0, len(e),
            sum(counts[x] == most[x[1]] for x in e), sum(counts[x] for x in e),
            hashlib.sha256(_told(d[2]).encode()).hexdigest() if d else "",
        )


@pytest.mark.parametrize("limit", [crosstok.BROADCAST_PAIRS, 0])
def test_op11_equals_brute_force(spark, plain, monkeypatch, limit):
    monkeypatch.setattr(crosstok, "BROADCAST_PAIRS", limit)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], _sums([d.text for d in docs], plain)))
    got = queries.op11_cross_tokenizer(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[r.doc_id]


def test_alignment_of_odd_tables(spark, files):
    schema = "text string, links int, id int, doc_id string, row string"
    rows = [("a b", 1, 2, "x", "r"), ("a b", 1, 2, "x", "r"), (None, None, None, None, None), ("", 1, 2, None, "r")]
    got = crosstok.align(spark.createDataFrame(rows, schema), *files)
    assert sorted((r.doc_id or "", r.n_a, len(r.links)) for r in got.collect()) == [("", 0, 0), ("", 0, 0), ("x", 2, 2), ("x", 2, 2)]
    empty = crosstok.align(spark.createDataFrame([], schema), *files)
    assert empty.count() == 0 and crosstok.pair_counts(empty).count() == 0


# Periodic runs.

def _plain_runs(words):
    out, n = set(), len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(words[k] == words[k + p] for k in range(start, start + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.add((start, length, q))
    return sorted(out, key=lambda run: (run[0], run[2]))


def _plain_collapsed(words, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words = []
            for _ in range(rng.randint(0, 6)):
                kinds = rng.choice([1, 2, 3, 5, 50])
                unit = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, rng.choice([3, 9, 30])))]
                words += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
            texts.append(" ".join(words))
        runs, collapsed = periodic._search(texts)
        for text, found, left in zip(texts, runs, collapsed):
            want = _plain_runs(text.split())
            assert found == want, text
            assert left.decode() == _plain_collapsed(text.split(), want)


def test_long_texts_end():
    assert periodic._search(["a " * 100_000])[0] == [[(0, 100_000, 1)]]
    unit = " ".join(f"w{i}" for i in range(9973))
    assert periodic._search([" ".join([unit] * 5) + " end"])[0] == [[(0, 5 * 9973, 9973)]]


@pytest.mark.parametrize("length", [1, 2, 8, 64])
def test_convolution_is_exact(length):
    rng = np.random.default_rng(length)
    blocks, windows = rng.integers(0, 10**6, (5, length)), rng.integers(0, 10**6, (5, 2 * length - 1))
    at = rng.integers(0, length, 5)
    for k in range(5):
        windows[k, at[k] : at[k] + length] = blocks[k]
    want = np.array([[int(((windows[k, j : j + length] - blocks[k]).astype(object) ** 2).sum()) for j in range(length)] for k in range(5)])
    for p, g in periodic.PRIMES:
        assert (periodic.mismatches(blocks, windows, p, g) == want % p).all()
    row, offset = periodic.occurrences(blocks, windows)
    assert set(zip(range(5), at)) <= set(zip(row, offset)) and all(want[r, j] == 0 for r, j in zip(row, offset))


def _planted(doc_id, text):
    words, h = re.findall(WORD, text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), zlib.crc32(str(doc_id).encode()) // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_op12_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got.values()) > 5
    for d in docs:
        words, r = _planted(d.doc_id, d.text), got[d.doc_id]
        if len(words) > 2500:
            continue  # Brute force is quadratic; long texts have their own test.
        runs = _plain_runs(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(_plain_collapsed(words, runs).encode()).hexdigest()


def test_runs_of_odd_tables(spark):
    schema = "runs string, text string, doc_id string, id int"
    rows = [("x", "b a a a a a a", None, 1), ("x", None, "d", None), (None, " \t\n", "d", 1), ("", "a\x1cb\u2003c", "e", 1)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or "", [tuple(x) for x in r.runs], r.collapsed) for r in got) == [
        ("", [(1, 6, 1)], "b a"), ("d", [], ""), ("d", [], ""), ("e", [], "a\x1cb\u2003c")]
    assert periodic.periodic_runs(spark.createDataFrame([], schema)).count() == 0


# Url filter.

def _plain_rule(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[2]) if m else ""
    path = m[3] if m else ""
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


URLS = [
    None, "", "no scheme.com/", "http://COM/", "http://com", "https://www.Example.com/en/x?y#z", "https://a.www.example.com/en/", "ftp://example.com/en/",
    "x://ex.example.com/en", "http://notexample.com/en/", "http://a.net/es/1", "http://a.net/esp/", "http://net/fr/", "http://org/?a=://b.com/",
    "http://a.net?x=/es/", "http://a.com#/", "a://b\nc.com/\n", "http://user@a.com:80/x", "://com/x", "http://É.com/É",
]


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    none = spark.createDataFrame([], "url string, verdict string")
    for r in urlrules.filter_urls(pages, none, queries.URL_RULES).collect():
        host, path, rule, verdict = _plain_rule(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r.url


def _plain_mined(rows, support, confidence, least):
    """All rules by counting every subset of every row, unpruned: {items: verdict -> (confidence, support)}."""
    total, counts, of = len(rows), Counter(), Counter()
    for tokens, verdict in rows:
        for size in range(1, len(tokens) + 1):
            for items in combinations(sorted(tokens), size):
                counts[items] += 1
                of[items, verdict] += 1
    return {
        (items, v): (n / counts[items], n) for (items, v), n in of.items()
        if n >= max(least, support * total) and n / counts[items] >= confidence
    }


def _plain_verdict(tokens, rules):
    fit = [(c, s, -len(items), v == "allow", v) for (items, v), (c, s) in rules.items() if set(items) <= set(tokens)]
    return max(fit)[-1] if fit else "allow"


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(2)
    names, rows = list("abcdefg"), []
    for _ in range(600):
        tokens = [t for t in names if rng.random() < 0.45] + ["every"]
        bad = 0.9 if {"a", "b"} <= set(tokens) else 0.8 if "c" in tokens else 0.1
        rows.append((tokens, "block" if rng.random() < bad else "allow"))
    for tokens, _ in rows:
        if "d" in tokens:
            tokens.append("twin")  # Always beside d: one item with it.
    table = spark.createDataFrame(rows + [(["a"], None), (["a"], "other"), ([], "allow")], "tokens array<string>, verdict string")
    mined = urlrules.mine(table, 0.02, 0.75, 5)
    found = {(tuple(sorted([r.key, *r.rest])), r.verdict): (r.confidence, r.support) for r in mined.collect()}
    held = [([t for t in tokens if t not in ("every", "twin")], v) for tokens, v in rows] + [([], "allow")]
    every = _plain_mined(held, 0.02, 0.75, 5)
    assert found and all(found[k] == pytest.approx(every[k]) for k in found)
    assert any(v == "block" and len(items) > 1 for items, v in found)
    for size in range(len(names) + 1):
        for tokens in combinations(names, size):
            assert _plain_verdict(tokens, found) == _plain_verdict(tokens, every)


def test_judged_urls(spark, monkeypatch):
    bad = [(f"http://win{i % 7}.org/play/{i}", "block") for i in range(60)]
    good = [(f"https://news{i % 7}.org/story/{i}?ref=a", "allow") for i in range(60)]
    labels = spark.createDataFrame(bad + good + [(None, "block"), ("nothing", "block")] * 3, "url string, verdict string")
    pages = [("https://new.org/play/99", 7, "x"), ("https://new.org/story/1.html", 7, "x"), ("https://q.net/play/1", 1, "x"), (None, 1, "x"), ("https://new.org/play/99", 7, "x")]
    pages = spark.createDataFrame(pages, "url string, page_id long, verdict string")
    for limit in (urlrules.BROADCAST_RULES, 0):
        monkeypatch.setattr(urlrules, "BROADCAST_RULES", limit)
        got = urlrules.filter_urls(pages, labels, queries.URL_RULES, min_support=0.05)
        assert sorted((r.url or "", r.verdict) for r in got.collect()) == [
            ("", "allow"), ("https://new.org/play/99", "block"), ("https://new.org/play/99", "block"),
            ("https://new.org/story/1.html", "allow"), ("https://q.net/play/1", "block")]
    assert urlrules.filter_urls(pages.limit(0), labels, queries.URL_RULES).count() == 0


def test_tokens_of_urls(spark):
    url = "HTTPS://www.a-b.example.org/en/12/x.y/12.html?page=2&ref#top"
    row = spark.createDataFrame([(url,), (None,), ("x",)], "url string").select(urlrules.tokens(F.col("url")).alias("t")).collect()
    assert row[1].t == [] and row[2].t == []
    assert set(row[0].t) == {
        "scheme:HTTPS", "label:www", "label:a-b", "label:example", "label:org", "top:org", "part:en", "part:#", "part:x", "ending:html",
        "argument:page=2", "argument:ref", "key:page", "key:ref", "fragment:top"}


def test_op13_covers_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in queries.op13_url_filter(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        host, path, rule, verdict = _plain_rule(p.url)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_page_labels_by_document_number(spark, tmp_path):
    pages = [("http://a.org/en/7.html#x",), ("http://a.org/en/8/?y",), ("http://a.org/en/9",), ("http://a.org/",), (None,)]
    spark.createDataFrame(pages, "url string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(7, 1, 0), (7, 0, 0), (8, 1, None), (9, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.url: r.verdict for r in queries.page_labels(spark, str(tmp_path)).collect()}
    assert got == {pages[0][0]: "block", pages[1][0]: "allow", pages[2][0]: None, pages[3][0]: None, None: None}
