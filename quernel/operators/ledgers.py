"""Ledger reports: calls by model and in grouping sets, metered output by day, newest events by key, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quernel.functions.times import tidy

# Providers whose output isn't metered.
LOCAL = ("ollama", "llamacpp", "llama.cpp")


def with_entity(entries: DataFrame) -> DataFrame:
    """Provider and model trimmed and in lower case; a blank or null provider is anthropic, a blank model null."""
    p, m = F.lower(tidy(F.col("provider"))), F.lower(tidy(F.col("model")))
    return entries.withColumns({"provider": F.when(p.isNull() | (p == ""), "anthropic").otherwise(p), "model": F.when(m != "", m)})


def calls_by(entries: DataFrame, *keys: str) -> DataFrame:
    """Calls, outcomes, time and tokens by any keys of a ledger; nulls of usage count as not measured."""
    err = lambda k: F.count_if(F.col("err_kind") == k)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return entries.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("ok"), err("timeout").alias("timeouts"), err("rate_limit").alias("rate_limits"),
        total("duration_ms"), total("prompt_chars"), total("input_tokens"), total("output_tokens"), F.count("input_tokens").alias("calls_with_usage"),
    )


def calls_grouping_sets(entries: DataFrame) -> DataFrame:
    """Calls and output tokens by model, by provider, by op and in all, in one pass over the ledger."""
    level = F.grouping_id("provider", "model", "op").cast("bigint")
    sets = entries.select("provider", "model", "op", "output_tokens").groupingSets([["model"], ["provider"], ["op"], []], "provider", "model", "op")
    return sets.agg(level.alias("level"), F.count("*").alias("calls"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def metered_output(entries: DataFrame, day: str = "ledger_day") -> DataFrame:
    """Output tokens by day, without local providers; a blank provider is metered."""
    p = F.lower(tidy(F.col("provider")))
    return entries.filter(~F.coalesce(p.isin(*LOCAL), F.lit(False))).groupBy(F.col(day).alias("day")).agg(F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def newest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """For each key, the columns of its row that is last in order; no window, so a hot key is reduced before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("x")).select(*keys, "x.*")
