"""Bounded samples for fitting, drawn by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the hash range.
PARTS = 1 << 40


def least_by_hash(rows: DataFrame, most: int, by: str) -> DataFrame:
    """At most ``most`` rows for each value of ``by``, the least by the hash of the row.

    Sizes are counted first, so only about twice as many rows as wanted are
    ranked, however large the table.  The values of ``by`` are classes of a
    model, few by their nature, so their sizes are broadcast.  Null classes are
    left out.
    """
    drawn = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(PARTS))
    sizes = rows.groupBy(F.col(by).alias("_class")).agg(F.count("*").alias("_size"))
    few = rows.withColumn("_drawn", drawn).join(F.broadcast(sizes), F.col(by) == F.col("_class"))
    few = few.where(F.col("_drawn") < F.lit(float(PARTS)) * (2.0 * most + 50) / F.col("_size"))
    turn = Window.partitionBy("_class").orderBy("_drawn")
    return few.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= most).select(*rows.columns)
