import datetime
import random
from collections import defaultdict

from quernel.functions.times import instant_micros, utc_day
from quernel.operators.rolling import ledger_calls, ledger_trailing, trailing_totals

SCHEMA = "line_id bigint, provider string, model string, entry_ts string, duration_ms bigint, prompt_chars bigint, cost_usd double, day string, at string, cost string"


def entries(spark, rows):
    return spark.createDataFrame([(i, *r, "a", "b", "c") for i, r in enumerate(rows)], SCHEMA)


def test_instants(spark):
    texts = ["2026-01-01T00:00:00Z", " 2026-01-01 00:00:00", "2026-01-01T09:00:00.5+09:00", "2025-12-31T19:00:00-0500", "2026-01-01T00:00Z", "2026-02-30T00:00:00Z", "2026-01-01T25:00:00Z", "2026-04-", "", None, "n/a", "2026-01-01", "2026-01-01T00:00:00,25"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    zero = 1767225600000000
    got = [r[0] for r in df.select(instant_micros(df.t)).collect()]
    assert got == [zero, zero, zero + 500000, zero, zero, None, None, None, None, None, None, None, zero + 250000]
    days = df.select(utc_day(instant_micros(df.t)).alias("d")).filter("d is not null").distinct().collect()
    assert [r.d for r in days] == [datetime.date(2026, 1, 1)]


def test_against_brute_force(spark):
    rng = random.Random(2)
    start = datetime.datetime(2026, 1, 1)
    rows = []
    for _ in range(700):
        at = start + datetime.timedelta(hours=rng.choice([0, 3, 50, 900, 901, 1700]) + rng.randint(0, 400))
        rows.append((rng.choice(["Anthropic ", "anthropic", None, "", "x"]), rng.choice([" Sonnet", "sonnet", "opus", None, ""]), at.isoformat() + "Z", rng.choice([None, 5, 7]), rng.choice([None, 1]), rng.choice([None, 0.25])))
    calls = {}
    for p, m, t, d, c, x in rows:
        if not (m or "").strip():
            continue
        key = ((p or "").strip().lower() or "anthropic", m.strip().lower(), t, d, c)
        calls[key] = max(calls.get(key, 0), x or 0)
    daily = defaultdict(lambda: [0, 0, 0])
    for (p, m, t, d, _), x in calls.items():
        day = daily[p, m, datetime.date.fromisoformat(t[:10])]
        day[0] += 1
        day[1] += x
        day[2] += d or 0
    last = max(k[2] for k in daily)
    want = {}
    for p, m in {k[:2] for k in daily}:
        day = min(k[2] for k in daily if k[:2] == (p, m))
        while day <= last:
            sums = [[sum(daily.get((p, m, day - datetime.timedelta(j)), [0, 0, 0])[i] for j in range(w)) for i in range(3)] for w in (7, 30)]
            want[p, m, day] = sums
            day += datetime.timedelta(1)
    got = {(r.provider, r.model, r.day): [[r.calls_7, r.cost_7, r.duration_ms_7], [r.calls_30, r.cost_30, r.duration_ms_30]] for r in ledger_trailing(entries(spark, rows)).collect()}
    assert got == want


def test_edges(spark):
    assert ledger_trailing(entries(spark, [])).count() == 0
    rows = [(None,) * 6, ("p", "m", None, 1, 1, 1.0), ("p", None, "2026-01-01T00:00:00Z", 1, 1, 1.0), ("p", "m", "0001-01-01T00:00:00Z", 1, 1, 1.0)]
    assert ledger_calls(entries(spark, rows)).count() == 0 and ledger_trailing(entries(spark, rows)).count() == 0
    one = [("p", "m", "2026-01-01T10:00:00Z", None, None, None)] * 3 + [("p", "m" * 5000, "2026-01-03T10:00:00Z", 4, 2, float("nan"))]
    got = ledger_trailing(entries(spark, one)).orderBy("model", "day").collect()
    assert [(len(r.model), r.calls_7, r.avg_calls_7) for r in got] == [(1, 1, 1 / 7)] * 3 + [(5000, 1, 1 / 7)]


def test_windows_of_any_length(spark):
    d = datetime.date
    daily = spark.createDataFrame([("a", d(2026, 1, 1), 1), ("a", d(2026, 1, 4), 2)], "who string, day date, n bigint")
    from pyspark.sql import functions as F

    out = trailing_totals(daily, ["who"], ["n"], [1, 3], F.lit("2026-01-06").cast("date")).orderBy("day").collect()
    assert [(r.n_1, r.n_3) for r in out] == [(1, 1), (0, 1), (0, 1), (2, 2), (0, 2), (0, 2)]
