"""Ordered running values that do not need one task per key.

A plain window sorts all rows of a key in one task.  Here rows are cut into
buckets of the order column; each bucket is scanned on its own, bucket summaries
are scanned per key (thousands of times fewer rows), and the carried value is
joined back.  The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 65536


def running(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, tuple[str, str]], bucket: int = BUCKET
) -> DataFrame:
    """Add running columns over ``keys`` ordered by the unique integer ``order``.

    ``values`` maps a new column to ``(kind, column)`` with kind ``sum``,
    ``max``, ``last`` (last non-null so far) or ``lag`` (value of the row before).
    Rows with a null key form a group; rows with a null order come first.
    """
    keys = list(keys)
    df = df.withColumn("_b", F.floor(F.col(order) / F.lit(bucket)))
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    local, summary, carry, final = {}, [], [], {}
    for name, (kind, column) in values.items():
        c, s, p = F.col(column), f"_s_{name}", f"_p_{name}"
        here = F.col(f"_l_{name}")
        if kind == "sum":
            local[f"_l_{name}"] = F.sum(c).over(so_far)
            summary.append(F.sum(c).alias(s))
            carry.append(F.sum(s).over(before).alias(p))
            final[name] = F.coalesce(here + F.col(p), here, F.col(p))
        elif kind == "max":
            local[f"_l_{name}"] = F.max(c).over(so_far)
            summary.append(F.max(c).alias(s))
            carry.append(F.max(s).over(before).alias(p))
            final[name] = F.greatest(here, F.col(p))
        elif kind == "last":
            local[f"_l_{name}"] = F.last(c, ignorenulls=True).over(so_far)
            summary.append(F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(s))
            carry.append(F.last(s, ignorenulls=True).over(before).alias(p))
            final[name] = F.coalesce(here, F.col(p))
        elif kind == "lag":
            # Wrapped, so a null value differs from having no row before.
            local[f"_l_{name}"] = F.lag(F.struct(c.alias("v"))).over(inside)
            summary.append(F.max_by(F.struct(c.alias("v")), F.col(order)).alias(s))
            carry.append(F.last(s, ignorenulls=True).over(before).alias(p))
            final[name] = F.coalesce(here, F.col(p))["v"]
        else:
            raise ValueError(kind)
    carried = df.groupBy(*keys, "_b").agg(*summary).select(*keys, "_b", *carry)
    marks = [F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "_b"])]
    carried = carried.select(*marks, *[f"_p_{name}" for name in values])
    # Null keys and orders are values like any other.
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, "_b"])]
    out = df.withColumns(local).join(carried, same)
    return out.withColumns(final).select(*[c for c in df.columns if c != "_b"], *values)
