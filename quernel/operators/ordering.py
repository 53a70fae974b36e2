"""Places within groups of any size: one group may hold any share of the rows, so no group is ever one task's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from quernel.session import checkpointed


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds the place of each row in its group, from 1, in the order given, which should tell rows apart (ties fall in any order).

    Rows are dealt to ranges of (keys, order), so a large group lies in several; each range counts its own rows, and a prefix sum over
    one row per group and range joins them up. Null keys are a group, null values come first.
    """
    dealt = rows.repartitionByRange(*[F.col(c).asc() for c in (*keys, *order)]).withColumn("_range", F.spark_partition_id())
    dealt = checkpointed(dealt)
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_range_n"))
    before = F.coalesce(F.sum("_range_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(*[F.col(c).alias(f"_range_k{i}") for i, c in enumerate(keys)], F.col("_range").alias("_range_of"), before.alias("_range_shift")).filter("_range_shift > 0")
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    same = F.col("_range") == F.col("_range_of")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_range_k{i}"))
    placed = dealt.withColumn("_range_own", own).join(shifts, same, "left")
    return placed.select(*rows.columns, (F.col("_range_own") + F.coalesce("_range_shift", F.lit(0))).cast("bigint").alias(name))


def stretches(rows: DataFrame, keys: Sequence[str], at: str, tie: str, gap_seconds: float, block_seconds: int = 86_400) -> DataFrame:
    """Adds stretch, which counts from 1 the stretches of each group without a gap of more than so many seconds; at is a timestamp.

    Rows are looked at block by block of time; a block's last time and count of gaps go on over one row per block. Rows without a time
    are left out.
    """
    cols = rows.columns
    s = F.unix_micros(F.col(at).cast("timestamp"))
    timed = rows.withColumn("_s", s).filter("_s is not null").withColumn("_b", F.floor(F.col("_s") / F.lit(block_seconds * 1_000_000)))
    over = Window.partitionBy(*keys).orderBy("_b")
    edges = timed.groupBy(*keys, "_b").agg(F.max("_s").alias("_until")).withColumn("_carried", F.lag("_until").over(over)).drop("_until")
    inner = Window.partitionBy(*keys, "_b").orderBy("_s", tie)
    new = F.when(F.col("_s") - F.coalesce(F.lag("_s").over(inner), F.col("_carried")) <= F.lit(int(gap_seconds * 1_000_000)), 0).otherwise(1)
    cut = checkpointed(timed.join(edges, [*keys, "_b"]).withColumn("_new", new).drop("_carried"))
    sums = cut.groupBy(*keys, "_b").agg(F.sum("_new").alias("_n"))
    base = sums.select(*keys, "_b", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    run = F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.withColumn("_run", run).join(base, [*keys, "_b"]).select(*cols, (F.col("_run") + F.col("_base")).alias("stretch"))
