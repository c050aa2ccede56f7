"""The queries of the operators for training data, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.llm import (
    ann, crosstok, html, langid, license, mixing, packing, periodic, pii, quality, simhash, topk, urlrules,
)
from proseloom.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
TOKENIZER_FILE = "word_bpe_49k.json"
BYTE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"


def _query(check: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if check:
            CHECKS[run.__name__] = check
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query()
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its length; pages without text give an empty one."""
    text = html.extract(F.col("html"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", text.alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


@_query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest id of its group of near duplicates."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@_query()
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and a digest of the base kinds, and all spans."""
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    digest = F.sha2(pii.joined(F.col("base")), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query(_TOPK_SQL)
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector, exactly."""
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query()
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes of every document, with the targets of its source."""
    taken = mixing.copies(_table(spark, sf_dir, "documents"))
    words = (F.col("copies") * F.col("size")).cast("long")
    return taken.select("doc_id", "size", "source_size", "target", words.alias("taken"))


def packed_pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of the documents with their digests and places in sequences."""
    made = packing.pieces(docs, tokenizer or tokenizer_path())
    made = made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    made = cut_lineage(made.withColumn("item", F.monotonically_increasing_id()))
    return made.join(packing.pack(made), "item").drop("item")


@_query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token pieces, and the place of each in a sequence."""
    return packed_pieces(_table(spark, sf_dir, "documents"))


@_query()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families named in every document, with their spans."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license.scan(docs, license.fit(docs))
    place = lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct("spans.family")), ",").alias("families"),
        F.size("spans").cast("long").alias("n_paragraphs"), F.array_join(F.transform("spans", place), ",").alias("spans"),
        F.coalesce(F.array_max("spans.score"), F.lit(0.0)).alias("score"),
    )


def remainder(id_col: str, divisor: int):
    """crc32 of an id as text, modulo the divisor."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


@_query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the ids."""
    docs = _table(spark, sf_dir, "documents")
    field = langid.fit(docs.where(remainder("doc_id", 3) != 1), "doc_id")
    held = docs.select(F.struct("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")).alias("row"), "text")
    return langid.predict(held, field, "row").select("row.*", "lang_pred", "score")


@_query()
def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate nearest neighbours of every fiftieth vector, widened until drawn queries reach the wanted recall."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search_until(ann.build(vectors), vectors.where(F.col("vec_id") % 50 == 0))


@_query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels of four fifths of the ids."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = quality.fit(docs, labels.where(~held))
    scored = quality.score(docs, model)
    predicted = (F.col("score") >= quality.PREDICT_AT).cast("int")
    return scored.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"))


@_query()
def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two tokenisations of every document meet, and how usual their links are in the corpus."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    met = crosstok.align(docs, tokenizer_path(BYTE_FILE), tokenizer_path(PIECE_FILE))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    # Written once: the tokenizers run once, and rows keep their numbers.
    met = cut_lineage(met.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups",
        digest.alias("groups_sha256"), "links"))
    sums = crosstok.link_sums(met, "row")
    counted = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return met.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", *counted, "groups_sha256")


def planted_repeats(doc_id: str, text: str):
    """Text of which, for a tenth of the ids, all words from one on repeat with a period; other texts as they are.

    A null id plants nothing.
    """
    drawn = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # Nested transforms over one element bind what they compute once.
    bind = lambda value, use: F.transform(F.array(value), use)[0]

    def repeated(w):
        n, g = F.size(w).cast("long"), F.floor(drawn / 10)
        return bind(g % n, lambda a: bind(
            F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)), lambda p: F.array_join(
                F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")))

    return F.when(
        drawn % 10 == 0, bind(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))
    ).otherwise(F.col(text))


@_query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, the strongest of them, and digests of all and of what is left."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", planted_repeats("doc_id", "text").alias("text"))
    found = periodic.periodic_runs(docs)

    def stronger(x, y):
        """Order by length / period downwards, exactly, then start and period."""
        sign = y["length"] * x["period"] - x["length"] * y["period"]
        sign = F.when(sign != 0, sign).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])
        return F.signum(sign).cast("int")

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    found = found.withColumn("best", F.get(F.array_sort("runs", stronger), F.lit(0)))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: The listed rules, fixed values.
URL_RULES = [
    urlrules.Rule("com", "/", urlrules.ALLOW), urlrules.Rule("example.com", "/en/", urlrules.BLOCK),
    urlrules.Rule("www.example.com", "/en/", urlrules.ALLOW), urlrules.Rule("net", "/es/", urlrules.BLOCK),
    urlrules.Rule("net", "/fr/", urlrules.BLOCK),
]


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, verdict) of pages: block where the document a page shows is labelled toxic or of low quality.

    The number that ends a page's path names its document; pages of unlabelled
    documents have a null verdict.
    """
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    number = F.regexp_extract(urlrules.path(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    shown = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), urlrules.BLOCK).when(
        F.coalesce("toxic", "quality").isNotNull(), urlrules.ALLOW)
    # A document labelled twice is blocked if any label says so.
    told = labels.groupBy("doc_id").agg(F.max(bad).alias("verdict"))
    return shown.join(told, "doc_id", "left").select("url", "verdict")


@_query()
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url, by a listed rule or by rules mined from labelled pages."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlrules.filter_urls(pages, page_labels(spark, sf_dir), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")
