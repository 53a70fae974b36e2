"""Totals over trailing periods of days, for each entity and day, days without activity included."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quernel.functions.times import instant_micros, tidy, utc_day
from quernel.session import checkpointed


def daily_totals(rows: DataFrame, entity: Sequence[str], day: str, sums: Mapping[str, Column]) -> DataFrame:
    """One row per entity and day with activity. Sums are taken partly before the shuffle, so no entity is too large."""
    return rows.groupBy(*entity, F.col(day).alias("day")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def trailing_totals(daily: DataFrame, entity: Sequence[str], names: Sequence[str], windows: Sequence[int], last_day: Column) -> DataFrame:
    """For each entity and each day from its first to last_day, totals over the trailing windows that end that day.

    ``daily`` has one row per entity and day, in columns of the entity, ``day`` (date) and ``names``. Each entity-calendar
    date meets the daily rows within its trailing bounds by a range join; both sides are cut into buckets as long as the longest
    window, so that a date looks into two buckets only, and the join is an equality on entity and bucket first. An entity has as
    many rows as days at most, whatever its share of the calls.

    Columns of the result: entity, day, and ``{name}_{window}`` for each; days before the first count as zero.
    """
    longest = max(windows)
    bucket = lambda c: F.floor(F.unix_date(c) / F.lit(longest)).cast("int")
    first = daily.groupBy(*entity).agg(F.min("day").alias("first"))
    calendar = first.filter(F.col("first") <= last_day).select(*entity, F.explode(F.sequence("first", last_day, F.expr("interval 1 day"))).alias("day"))
    looks = calendar.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.date_sub("day", longest - 1)), bucket(F.col("day"))))))
    held = daily.select(*entity, F.col("day").alias("held_day"), bucket(F.col("day")).alias("bucket"), *names)
    near = looks.join(held, [*entity, "bucket"]).filter((F.col("held_day") <= F.col("day")) & (F.col("held_day") > F.date_sub("day", longest)))
    in_window = lambda n, w: F.when(F.col("held_day") > F.date_sub("day", w), F.col(n)) if w < longest else F.col(n)
    parts = near.select(*entity, "day", *[in_window(n, w).alias(f"{n}_{w}") for w in windows for n in names])
    types = dict(daily.dtypes)
    empty = calendar.select(*entity, "day", *[F.lit(0).cast(types[n]).alias(f"{n}_{w}") for w in windows for n in names])
    return parts.unionByName(empty).groupBy(*entity, "day").agg(*[F.coalesce(F.sum(f"{n}_{w}"), F.lit(0)).alias(f"{n}_{w}") for w in windows for n in names])


def ledger_calls(entries: DataFrame) -> DataFrame:
    """The calls of a cost ledger: provider, model, day and what each call took, written more than once or not.

    Provider and model are trimmed and in lower case; a blank or null provider is anthropic. Lines without a model and
    lines whose time is missing, unreadable, no real date or in year 1 are left out. Lines with the same instant, entity,
    duration_ms and prompt_chars are one call, with the largest cost of them (a null cost counts as zero).
    """
    provider, model = F.lower(tidy(F.col("provider"))), F.lower(tidy(F.col("model")))
    rows = entries.select(
        F.when(provider.isNull() | (provider == ""), "anthropic").otherwise(provider).alias("provider"),
        model.alias("model"),
        instant_micros(F.col("entry_ts")).alias("at"),
        F.col("duration_ms").cast("bigint").alias("duration_ms"),
        F.col("prompt_chars").cast("bigint").alias("prompt_chars"),
        F.col("cost_usd").cast("double").try_cast("decimal(20,6)").alias("cost"),
    )
    year_two = -62_104_060_800 * 1_000_000  # 0002-01-01T00:00:00Z
    good = rows.filter((F.col("model") != "") & (F.col("at") >= year_two))
    calls = good.groupBy("provider", "model", "at", "duration_ms", "prompt_chars").agg(F.max("cost").alias("cost"))
    return calls.select("provider", "model", utc_day(F.col("at")).alias("day"), "duration_ms", F.coalesce("cost", F.lit(0).cast("decimal(20,6)")).alias("cost"))


def ledger_trailing(entries: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Calls, cost and duration of each provider and model over trailing days: totals and daily averages.

    Columns: provider, model, day, and for each window w calls_w, cost_w, duration_ms_w, avg_calls_w, avg_cost_w,
    avg_duration_ms_w. Nulls in any column have the results that ``ledger_calls`` names; an empty ledger gives no rows.
    """
    calls = ledger_calls(entries)
    names = ["calls", "cost", "duration_ms"]
    daily = daily_totals(calls, ["provider", "model"], "day", {"calls": F.lit(1).cast("bigint"), "cost": F.col("cost"), "duration_ms": F.coalesce("duration_ms", F.lit(0))})
    # a row per entity and day with calls, read three times from here on: the ledger itself is read once
    daily = checkpointed(daily)
    last = daily.select(F.max("day")).scalar()
    totals = trailing_totals(daily, ["provider", "model"], names, windows, last)
    out = [F.col("provider"), F.col("model"), F.col("day")]
    for w in windows:
        out += [F.col(f"calls_{w}").cast("bigint").alias(f"calls_{w}"), F.col(f"cost_{w}").cast("double").alias(f"cost_{w}"), F.col(f"duration_ms_{w}").cast("bigint").alias(f"duration_ms_{w}")]
        out += [(F.col(f"{n}_{w}").cast("double") / F.lit(float(w))).alias(f"avg_{n}_{w}") for n in names]
    return totals.select(*out)
