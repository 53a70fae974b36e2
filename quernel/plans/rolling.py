"""Queries over trailing periods, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernel.operators.rolling import ledger_trailing
from quernel.session import table


def p2_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and daily averages over the last 7 and 30 days for each provider, model and day."""
    return ledger_trailing(table(spark, sf_dir, "cost_entries")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which an entity nearly fell silent: at most a tenth of at least 10 calls of the last 30 days lie in the last 7."""
    totals = ledger_trailing(table(spark, sf_dir, "cost_entries"))
    quiet = totals.filter((F.col("calls_30") >= 10) & (F.col("calls_7") * 10 <= F.col("calls_30")))
    return quiet.select("provider", "model", F.date_format("day", "yyyy-MM-dd").alias("day"))


_SQL = """
with lines as (
  select coalesce(nullif(lower(trim(provider, ' \t\n\r')), ''), 'anthropic') as provider, lower(trim(model, ' \t\n\r')) as model,
         trim(entry_ts, ' \t\n\r') as ts, duration_ms, prompt_chars, cast(cost_usd as decimal(20,6)) as cost
  from cost_entries
), timed as (
  select *, epoch_us(try_cast(case when regexp_matches(ts, '(Z|[+-]\\d{2}:?\\d{2})$') and length(ts) > 16 then ts else ts || 'Z' end as timestamptz)) as us from lines
  where regexp_full_match(ts, '\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2}([.,]\\d{1,9})?)?(Z|[+-]\\d{2}:?\\d{2})?')
), calls as (
  select provider, model, us, duration_ms, prompt_chars, coalesce(max(cost), 0) as cost
  from timed where model <> '' and us >= epoch_us(timestamp '0002-01-01')
  group by provider, model, us, duration_ms, prompt_chars
), daily as (
  select provider, model, cast(make_timestamp(us) as date) as d, count(*) as calls, sum(cost) as cost, sum(coalesce(duration_ms, 0)) as duration_ms
  from calls group by all
), bounds as (
  select provider, model, min(d) as first, (select max(d) from daily) as last from daily group by all
), calendar as (
  select provider, model, cast(unnest(generate_series(first, last, interval 1 day)) as date) as d from bounds
), wide as (
  select c.provider, c.model, c.d, coalesce(t.calls, 0) as calls, coalesce(t.cost, 0) as cost, coalesce(t.duration_ms, 0) as duration_ms
  from calendar c left join daily t using (provider, model, d)
), totals as (
  select provider, model, strftime(d, '%Y-%m-%d') as day,
    cast(sum(calls) over w7 as bigint) as calls_7, cast(sum(cost) over w7 as double) as cost_7, cast(sum(duration_ms) over w7 as bigint) as duration_ms_7,
    cast(sum(calls) over w30 as bigint) as calls_30, cast(sum(cost) over w30 as double) as cost_30, cast(sum(duration_ms) over w30 as bigint) as duration_ms_30
  from wide
  window w7 as (partition by provider, model order by d rows between 6 preceding and current row),
         w30 as (partition by provider, model order by d rows between 29 preceding and current row)
)
"""

QUERIES = {"p2_found": p2_found, "p2_rolling": p2_rolling}
SQL = {
    "p2_found": _SQL + "select provider, model, day from totals where calls_30 >= 10 and calls_7 * 10 <= calls_30",
    "p2_rolling": _SQL
    + "select *, "
    + ", ".join(f"cast({n}_{w} as double) / {float(w)} as avg_{n}_{w}" for w in (7, 30) for n in ("calls", "cost", "duration_ms"))
    + " from totals",
}
