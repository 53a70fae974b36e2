"""Joins that Spark has no plan of its own for: the nearest earlier row, and points in ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, keep: Sequence[str], step: int = 86_400) -> DataFrame:
    """left with, of right, the columns keep of the row of the same key that is latest at or before left_at (null if none).

    Times are timestamps. Both sides are cut into steps of so many seconds. Within a step the last value is carried along by a
    window, and what earlier steps leave is carried over steps by a window over one row per step, so that a key with any
    share of the rows is spread over its steps. Of several rows at one time the one with the largest values is taken.
    """
    names = [f"_r{i}" for i in range(len(keep))]
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(step * 1_000_000))
    at_type = left.schema[left_at].dataType
    value = F.struct(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    r = right.select(*by, F.col(right_at).cast(at_type).alias("_at"), value.alias("_v")).filter("_at is not null")
    steps = r.groupBy(*by, bucket(F.col("_at")).alias("_b")).agg(F.max_by("_v", F.struct("_at", "_v")).alias("_last"))
    lsteps = left.select(*by, bucket(F.col(left_at)).alias("_b")).distinct()
    over = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = lsteps.join(steps, [*by, "_b"], "full_outer").withColumn("_carried", F.last("_last", ignorenulls=True).over(over)).select(*by, "_b", "_carried")
    rows = left.withColumns({"_at": F.col(left_at), "_v": F.lit(None).cast(r.schema["_v"].dataType), "_side": F.lit(1)})
    both = rows.unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True).withColumn("_b", bucket(F.col("_at")))
    inner = Window.partitionBy(*by, "_b").orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(inner)).filter("_side = 1").join(carried, [*by, "_b"], "left")
    found = F.coalesce("_seen", "_carried")
    return filled.select(*left.columns, *[found[n].alias(c) for n, c in zip(names, keep, strict=True)])


def in_range(points: DataFrame, ranges: DataFrame, by: Sequence[str], at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a point and a range of the same key with low <= at < high.

    An equality on key and bucket first: a range is listed in each bucket of ``width`` it touches, a point looks into its own, so
    choose a width about as long as a range.
    """
    b = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    listed = ranges.withColumn("_b", F.explode(F.sequence(b(low), b(high))))
    return points.withColumn("_b", b(at)).join(listed, [*by, "_b"]).filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")
