"""Url filter: listed rules first, then association rules mined from labelled urls.

Tokens of labelled urls and their verdict are baskets for Spark's FP-growth.  Of
its item sets those that end in a verdict are rules; rules below the wanted
support or confidence, and rules that a shorter one makes useless, are pruned.
Other urls find their rules through an inverted index on each rule's rarest token.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.operators.lookup import salted_lookup
from proseloom.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
#: Least share, and least number, of labelled urls that a rule must hold in.
MIN_SUPPORT = 0.002
MIN_ROWS = 20
#: Least share of a rule's verdict among the labelled urls with its tokens.
MIN_CONFIDENCE = 0.7
#: Rules up to which the index is broadcast (about 10 MB); beyond, it is shuffled.
BROADCAST_RULES = 50_000
_MARK = "verdict="


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", group), F.lit(""))


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return _part(url, 2)


def listed(host_col: Column, path_col: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest fitting rule of a short list, null if none fits.

    A rule fits its host and all subdomains where the path starts with the
    rule's.  Rules of equal length are tried in the order of their names.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host_col == rule.host) | host_col.endswith("." + rule.host)) & path_col.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, host labels, top domain, path parts, file ending, arguments, fragment.

    Path parts of digits alone are one token, so that numbered pages meet.
    Null urls and those without ``://`` have none.
    """
    labels = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    ending = F.regexp_extract(path(url), r"\.([A-Za-z][A-Za-z0-9]*)$", 1)
    pairs = F.filter(F.split(_part(url, 3), "&"), lambda x: x != "")
    named = lambda kind: lambda x: F.concat(F.lit(kind + ":"), x)
    stem = lambda x: F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z][A-Za-z0-9]*$", ""), r"^[0-9]+$", "#")
    one = lambda kind, x: F.when(x != "", F.array(F.concat(F.lit(kind + ":"), x))).otherwise(F.array())
    return F.when(
        F.contains(url, F.lit("://")),
        F.array_distinct(F.concat(
            one("scheme", F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
            F.transform(labels, named("label")), F.transform(F.slice(labels, -1, 1), named("top")),
            F.transform(F.transform(parts, stem), named("part")), one("ending", ending),
            F.transform(pairs, named("argument")),
            F.transform(pairs, lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1))),
            one("fragment", F.regexp_extract(url, r"#(.+)", 1)),
        )),
    ).otherwise(F.array().cast("array<string>"))


def _vocabulary(rows: DataFrame, least: int, total: int) -> DataFrame:
    """(token, n) of the tokens that tell labelled urls apart and are common enough.

    A token of every row tells nothing; of tokens that stand in the very same
    rows the first by name speaks for all.  At most (tokens of a row) / support
    tokens are common enough, whatever the number of rows.
    """
    mark = F.xxhash64("row").cast("decimal(38,0)")
    seen = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.sum(mark).alias("_same"))
    seen = seen.where((F.col("n") >= least) & (F.col("n") < total))
    return seen.groupBy("n", "_same").agg(F.min("token").alias("token")).select("token", "n")


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """(key, rest, size, verdict, confidence, support): rules of a table (tokens, verdict), pruned.

    ``key`` is the rule's rarest token, ``rest`` its others.  A rule is pruned
    if one with one token less has the same verdict and no less confidence, as
    that one fits wherever it does and is preferred.  Rows with a null or other
    verdict are not labelled; repeated rows count each; an empty table gives no
    rules.
    """
    kinds = labelled.where(F.col("verdict").isin(ALLOW, BLOCK))
    rows = cut_lineage(kinds.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"))
    total = rows.count()
    least = max(min_rows, min_support * total)
    vocabulary = cut_lineage(_vocabulary(rows, least, total))
    # Bounded by the support, see _vocabulary.
    chosen = rows.select("row", F.explode("tokens").alias("token")).join(F.broadcast(vocabulary.select("token")), "token")
    baskets = (
        chosen.select("row", "token")
        .unionByName(rows.select("row", F.concat(F.lit(_MARK), "verdict").alias("token")))
        .groupBy("row").agg(F.collect_list("token").alias("items"))
    )
    spread = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    growth = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(1, total)), minConfidence=1.0, numPartitions=spread)
    sets = cut_lineage(growth.fit(baskets).freqItemsets if total else baskets.select("items", F.lit(0).cast("long").alias("freq")))
    of = F.filter("items", lambda x: x.startswith(_MARK))
    plain = F.array_sort(F.filter("items", lambda x: ~x.startswith(_MARK)))
    sets = sets.select(of.alias("of"), plain.alias("items"), "freq").where("size(items) > 0")
    whole = sets.where("size(of) = 0").select("items", F.col("freq").alias("_all"))
    found = sets.where("size(of) = 1").join(whole, "items").select(
        "items", F.substring(F.col("of")[0], len(_MARK) + 1, 100).alias("verdict"),
        (F.col("freq") / F.col("_all")).alias("confidence"), F.col("freq").alias("support"))
    found = cut_lineage(found.where(F.col("confidence") >= min_confidence))
    shorter = found.select("items", "verdict", "confidence", F.posexplode("items").alias("_at", "_token")).select(
        F.col("items").alias("_long"), "verdict", F.array_remove("items", F.col("_token")).alias("items"),
        F.col("confidence").alias("_c"))
    useless = shorter.join(found, ["items", "verdict"]).where("confidence >= _c").select(
        F.col("_long").alias("items"), "verdict").distinct()
    kept = found.join(useless, ["items", "verdict"], "left_anti")
    rarest = kept.select("*", F.explode("items").alias("token")).join(F.broadcast(vocabulary), "token").groupBy(
        "items", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("n", "token")).alias("key"))
    return rarest.select(
        "key", F.array_remove("items", F.col("key")).alias("rest"), F.size("items").alias("size"), "verdict",
        "confidence", "support")


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """(url, verdict, confidence): each distinct url by the most confident mined rule that fits.

    Ties go to the rule with more support, then fewer tokens, then ``allow``.
    Urls that no rule fits, null among them, get ``default`` and a null
    confidence.  ``rules`` is read twice: write it first.
    """
    each = urls.select(F.col(url_col).alias("url")).distinct()
    probes = each.select("url", tokens(F.col("url")).alias("_tokens")).select(
        "url", "_tokens", F.explode("_tokens").alias("key"))
    if rules.count() <= BROADCAST_RULES:
        met = probes.join(F.broadcast(rules), "key")
    else:
        met = salted_lookup(probes, rules, ["key"], ["url"])
    fits = F.forall("rest", lambda x: F.array_contains(F.col("_tokens"), x))
    first = F.struct("confidence", "support", -F.col("size"), F.col("verdict") == ALLOW, "verdict")
    best = met.where(fits).groupBy("url").agg(F.max(first).alias("_best"))
    return each.join(best, "url", "left").select(
        "url", F.coalesce("_best.verdict", F.lit(default)).alias("verdict"), F.col("_best.confidence").alias("confidence"))


def filter_urls(
    pages: DataFrame, labels: DataFrame, listed_rules: Sequence[Rule], url_col: str = "url",
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS,
) -> DataFrame:
    """The columns of ``pages`` and host, path, rule, verdict of every row.

    A listed rule decides where one fits.  Other urls are judged by rules mined
    from ``labels``, a table (url, verdict) that may hold each url several times.
    Listed rules teach nothing: they speak for their hosts alone.  Columns of
    ``pages`` named like a result are replaced.  Null urls and those without
    ``://`` have an empty host and path and the default verdict; rows repeat as given.
    """
    told = labels.select(tokens(F.col("url")).alias("tokens"), "verdict")
    rules = cut_lineage(mine(told, min_support, min_confidence, min_rows))
    url = F.col(url_col)
    results = ("host", "path", "rule", "verdict")
    kept = pages.select(*[c for c in pages.columns if c not in results], host(url).alias("host"), path(url).alias("path"))
    kept = kept.withColumn("_listed", listed(F.col("host"), F.col("path"), listed_rules))
    open_urls = kept.where(F.col("_listed").isNull())
    judged = judge(open_urls, rules, url_col).toDF("_url", "_verdict", "_confidence")
    met = kept.join(judged, F.col(url_col) == F.col("_url"), "left")
    return met.select(
        *[c for c in kept.columns if c != "_listed"], F.col("_listed.rule").alias("rule"),
        F.coalesce("_listed.verdict", "_verdict", F.lit(ALLOW)).alias("verdict"))
