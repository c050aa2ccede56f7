"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius.  Two
fingerprints within the radius share a variant, and all holders of one variant
lie within the radius of each other, so a bucket is bounded by the number of
variants (65 at radius 2) whatever the data: linking each holder to the least
one keeps the connected components without emitting pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseloom.llm.graph import components
from proseloom.session import cut_lineage

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
#: Shingles hashed at once, which bounds the memory a very long text needs.
BLOCK = 1 << 15


def _fingerprint(text: str | None, size: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    total = len(words) - size + 1
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, BLOCK):
        part = words[start : start + BLOCK + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size))))
        hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprint(text, size: int = SHINGLE_WORDS):
    """64-bit SimHash of a text column, as a signed long.

    Words are runs of characters other than ASCII white space after lowering
    A-Z; shingles of ``size`` words count as often as they occur.  Fewer words
    make one shingle; null, empty and blank texts give 0.
    """

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_fingerprint(t, size) for t in texts], dtype="int64")

    return of(text)


def ball_masks(radius: int) -> list[int]:
    """All masks of at most ``radius // 2`` bits, as signed longs."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be an even number, so that both halves meet")
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b), a > b, spanning every group of the distinct ``fp`` given."""
    balls = prints.select("fp", F.explode(F.lit(np.array(ball_masks(radius)))).alias("mask"))
    balls = balls.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = balls.withColumn("b", F.min("fp").over(Window.partitionBy("variant"))).where("fp > b")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius).select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, size: int = SHINGLE_WORDS
) -> DataFrame:
    """One row per input row: its id, ``fp`` and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` differing bits, the row's own included (null only if no row of
    the group has an id).  Null and empty texts share fingerprint 0 and are
    linked like any other; repeated rows are kept; other columns are ignored.
    """
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), size).alias("fp")))
    first = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("first")))
    labels = components(links(first.select("fp"), radius))
    grouped = first.join(labels, first["fp"] == labels["node"]).select("fp", "first", "root")
    least = cut_lineage(grouped.groupBy("root").agg(F.min("first").alias("least")))
    member = cut_lineage(labels.join(least, "root").select(F.col("node").alias("fp"), "least"))
    known = cut_lineage(
        first.join(member, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    )
    return rows.join(known, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the one with the smallest id.

    Rows that repeat the same id are reduced to one of them; rows without an
    id stay, as nothing names them.
    """
    found = cut_lineage(near_duplicates(docs, id_col, text_col, radius))
    twice = found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).count().where("count > 1").select(id_col)
    twice = cut_lineage(twice)
    lost = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    # The ids grow with the input, so they are never broadcast: one plan at every size.
    if twice.isEmpty():
        return docs.join(lost.hint("merge"), id_col, "left_anti").select(*docs.columns)
    stay = docs.join(lost.unionByName(twice).hint("merge"), id_col, "left_anti")
    again = docs.join(twice.hint("merge"), id_col, "left_semi")
    order = Window.partitionBy(id_col).orderBy(*[F.col(c) for c in docs.columns if c != id_col and _ordered(docs, c)])
    once = again.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")
    return stay.unionByName(once).select(*docs.columns)


def _ordered(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, (T.MapType, T.VariantType))
