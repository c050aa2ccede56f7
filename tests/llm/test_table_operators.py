"""Exact search, nearest neighbours, source mixing, packing and the pipeline on small tables."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proseloom.llm import ann, mixing, packing, queries, topk

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def _vectors(spark, rows):
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))


def _brute_top_k(rows, k=5):
    out = []
    fine = [(i, np.floor(256 * np.asarray(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, a in fine:
        if q % 50 == 0:
            near = sorted((-int(a @ b), i) for i, b in fine if i != q and len(b) == len(a))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_exact_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]
    rows += [(401, None), (402, [0.1, None, 0, 0, 0, 0]), (403, [NAN] * 6), (450, [INF] * 6), (500, [0.25, -0.5]), (501, [1.0, 1.0]), (None, [0.5] * 6)]
    rows += [(550, []), (551, [])]
    got = topk.exact_top_k(_vectors(spark, rows), F.col("vec_id") % 50 == 0, shard_rows=64, query_rows=4)
    assert sorted(map(tuple, got.collect())) == _brute_top_k(rows)


def test_exact_top_k_small_tables(spark):
    rows = [(0, [0.5, 1.0]), (0, [0.5, 1.0]), (1, [1.0, 0.0])]
    got = topk.exact_top_k(_vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 128 * 256)]
    assert topk.exact_top_k(_vectors(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0


def test_tree_bounds_hold():
    rng = np.random.default_rng(2)
    points, asked = rng.integers(-200, 200, (500, 5)).astype(float), rng.integers(-200, 200, (7, 5)).astype(float)
    tree = topk.KDTree(points, leaf_rows=16)
    bounds = tree.bounds(asked)
    for node, (start, end) in enumerate(tree.span):
        assert (asked @ tree.points[start:end].T <= bounds[:, [node]] + 1e-9).all()
    assert sorted(tree.order.tolist()) == list(range(500))


def _recall(rows, got, k=5):
    x = {i: np.asarray(v, float) / np.linalg.norm(v) for i, v in rows}
    ids = np.array(sorted(x))
    table = np.stack([x[i] for i in ids])
    hits = total = 0
    for q in sorted({r["query_id"] for r in got}):
        s = table @ x[q]
        s[ids == q] = -9
        best = set(ids[np.lexsort((ids, -s))[:k]].tolist())
        hits += len(best & {r["vec_id"] for r in got if r["query_id"] == q})
        total += k
    return hits / total


def test_nearest_neighbours_recall_over_several_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=24)]) for i in range(3_000)]
    vectors = _vectors(spark, rows)
    got = ann.search(ann.build(vectors), vectors.where("vec_id % 50 = 0")).collect()
    assert len(got) == 60 * 5 and _recall(rows, got) >= 0.9
    one = got[0]
    a, b = (np.asarray(dict(rows)[one[c]], float) for c in ("query_id", "vec_id"))
    assert np.isclose(one["score"], a @ b / np.linalg.norm(a) / np.linalg.norm(b), rtol=1e-12)


def test_beam_widens_until_recall_is_reached(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=48)]) for i in range(3_000)]
    vectors = _vectors(spark, rows)
    graph, asked = ann.build(vectors), vectors.where("vec_id % 50 = 0")
    assert _recall(rows, ann.search(graph, asked, beam=4, expand=1).collect()) < 0.9
    got = ann.search_until(graph, asked, beam=4).collect()
    assert len(got) == 60 * 5 and _recall(rows, got) >= 0.9


def test_nearest_neighbours_of_copies_and_odd_vectors(spark):
    same = [(i, [1.0, 2.0]) for i in range(100, 160)]
    rows = same + [(0, [2.0, 1.0]), (50, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [NAN, 1.0]), (4, [1.0, None]), (5, [3.0]), (50, [1.0, 2.0])]
    vectors = _vectors(spark, rows)
    got = ann.search(ann.build(vectors), vectors.where("vec_id % 50 = 0")).collect()
    found = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50, 100, 150)}
    assert found == {0: [50, 100, 101, 102, 103], 50: [100, 101, 102, 103, 104], 100: [50, 101, 102, 103, 104], 150: [50, 100, 101, 102, 103]}
    none = vectors.limit(0)
    assert ann.search(ann.build(none), none).count() == 0


def test_outliers_and_rare_lengths_have_neighbours(spark):
    rng = np.random.default_rng(6)
    cone = rng.normal(size=(5_000, 8)) * 0.01 + 1
    rows = [(i + 1000, [float(np.float32(x)) for x in v]) for i, v in enumerate(cone)]
    rows += [(50 * i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(12)]
    rare = [(50 * i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(14, 20)]
    vectors = _vectors(spark, rows + rare)
    got = ann.search(ann.build(vectors), vectors.where("vec_id % 50 = 0 AND vec_id < 1000")).collect()
    assert len(got) == 18 * 5
    assert _recall(rows, [r for r in got if r["query_id"] < 700]) >= 0.9
    assert _recall(rare, [r for r in got if r["query_id"] >= 700]) == 1


def _brute_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, live = 1.5 * sum(sizes.values()), {}, set(names)
    while live:
        level = left / sum(weights[s] for s in live)
        over = {s for s in live if level * weights[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weights[s] for s in live}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        live -= over
    return target


def test_mix_targets_and_rounding(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), rng.choice(["a", "b", "é", "zz"])) for i in range(3_000)]
    rows += [(5000 + i, "x y\tz", None) for i in range(900)] + [(7, "one two", "a")] * 50 + [(8, None, "b"), (9, "", "")]
    docs = spark.createDataFrame([(a, b, None if c is None else str(c)) for a, b, c in rows], "doc_id long, text string, source string")
    got = mixing.copies(docs.withColumn("size", F.lit("clash"))).collect()
    again = mixing.copies(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    target = _brute_targets(sizes)
    for r in got:
        assert np.isclose(r["target"], target[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 60
    mixed = mixing.mix(docs.withColumn("_x", F.lit(1)))
    assert mixed.columns == [*docs.columns, "_x"] and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.copies(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_rounding_keeps_each_probability(spark):
    items = spark.range(40).select(F.lit("k").alias("key"), F.struct("id").alias("row"), (F.col("id") % 7 + 1).cast("double").alias("words"), F.lit(0.3).alias("p"))
    taken = np.mean([[r["extra"] for r in mixing.round_fractions(items, seed, fan_in=8).orderBy("row").collect()] for seed in range(60)])
    assert abs(taken - 0.3) < 0.05


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = ["", "  ", "a<|endoftext|>b c", "don't I'M we're ÀÉ ﬁ x́y Ⅷ 12ab３", "\x1cab \x85 x　y\x0bz", "ÿ×÷ªº ñÑ ß İ ǅ", "日本語 emoji😀!! a_b", "'s't ~~|`x` K Å ſ"]
    import pyarrow.parquet as pq

    texts += [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    for text in texts:
        assert encoder.ids(text) == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_best_two_fit():
    bins = packing.best_two_fit([6, 3, 3, 2, 5], 10)
    assert sorted(sum(bins, [])) == [0, 1, 2, 3, 4] and len(bins) == 2
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 100, 2_000).tolist()
    bins = packing.best_two_fit(sizes, 100)
    assert sorted(sum(bins, [])) == list(range(2_000)) and max(sum(sizes[i] for i in b) for b in bins) <= 100
    assert len(bins) <= 1.01 * sum(sizes) / 100 + 1
    assert packing.best_two_fit([], 5) == [] and packing.best_two_fit([5, 5], 5) in ([[0], [1]], [[1], [0]])


def test_packing_round_trip(spark):
    docs = spark.createDataFrame([(1, "a b c " * 3_000), (2, None), (3, ""), (4, "Hello"), (4, "Hello"), (None, "x")], "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = packing.pieces(docs, queries.tokenizer_path()).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r["start"]):
        whole.setdefault(r["doc_id"], b"")
        assert len(r["ids"]) == 4 * r["length"] <= 4 * 4096
        if r["doc_id"] == 1:
            assert r["start"] == len(whole[1]) // 4
            whole[1] += r["ids"]
    assert len(whole[1]) == 4 * 9_001 and sum(r["doc_id"] == 1 for r in got) == 3 and sum(r["doc_id"] == 4 for r in got) == 2
    placed = queries.packed_pieces(docs).collect()
    assert len(placed) == len(got) and {r["ids_crc32"] for r in placed} == {crc32(r["ids"]) for r in got}
    for sequence in {r["sequence_id"] for r in placed}:
        at = 0
        for r in sorted((r for r in placed if r["sequence_id"] == sequence), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert queries.packed_pieces(docs.limit(0)).count() == 0


def test_packing_in_several_groups_stays_tight(spark):
    items = spark.range(5_000).select(F.col("id").alias("item"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("length"))
    got = packing.pack(items, capacity=100, group_rows=300, slack=1).join(items, "item").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in got) <= 100 and len(got) <= 1.02 * sum(r["n"] for r in got) / 100 + 1


def test_pipeline_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, None, None, None), (90_001, None, None, None, None), (90_002, "", "en", "src0", 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("copies", F.lit(1))
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] < counts[3]
    assert not docs.where(F.col("text").rlike(r"[A-Za-z0-9]@[a-z0-9]+\.example")).count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_pipeline_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, last.select(columns).collect()))
