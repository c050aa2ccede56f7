"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_lookup(
    facts: DataFrame, dim: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join ``facts`` to a one-row-per-key ``dim`` with the keys salted.

    Each dimension row is repeated once per salt and each fact row hashes its
    own id to one salt, so a key owning a third of the facts is served by
    ``salts`` tasks.  Whether the dimension is broadcast instead is left to the
    runtime size check of adaptive execution.
    """
    keys = list(keys)
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return salted_facts.join(salted_dim, [*keys, "_salt"], how).drop("_salt")


#: Points of one range bucket.
WIDTH = 64


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Pairs of equal keys where ``start <= point`` and, if given, ``point <= end``.

    The line of integer points is cut into buckets of ``width``; an interval is
    repeated once per bucket it covers, so rows only meet within a bucket and a
    key with many points and intervals is served by as many tasks as it has
    buckets.  Without ``end`` an interval lasts to the last point of its key.
    Only its first and last bucket hold pairs that the bounds then drop: at most
    ``2 * width`` points per interval are met in vain.  Null points and starts match nothing;
    a null ``end`` is an open one.
    """
    keys = list(keys)
    last = points.groupBy(*keys).agg(F.max(point).alias("_last"))
    bounded = salted_lookup(intervals.where(F.col(start).isNotNull()), last, keys, [start])
    stop = F.col("_last") if end is None else F.least(F.col(end), F.col("_last"))
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    covered = (
        bounded.withColumn("_stop", stop).where(F.col(start) <= F.col("_stop"))
        .withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col("_stop")))))
    )
    placed = points.withColumn("_bucket", bucket(F.col(point)))
    met = placed.join(covered, [*keys, "_bucket"]).where((F.col(start) <= F.col(point)) & (F.col(point) <= F.col("_stop")))
    return met.drop("_bucket", "_stop", "_last")
