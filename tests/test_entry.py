import duckdb
import pytest

import __spark_entry__ as entry
from quernel.plans import corpus, logs, pages, relational, rolling

CORE = {k: q for m in (rolling, corpus, relational, pages, logs) for k, q in m.QUERIES.items()}
SQL = {k: q for m in (rolling, corpus, relational, pages, logs) for k, q in m.SQL.items()}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings cost_entries articles fetches queue_entries sessions messages rollout_lines mix_targets".split()


def quoted(df):
    return ', '.join(f'"{c}"' for c in df.columns)


def plain(row):
    return repr([list(x) if isinstance(x, (list, tuple)) else x for x in row])


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, small, name):
    df = CORE[name](spark, small)
    rows = df.collect()
    if name in SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
        want = con.sql(f"select {quoted(df)} from ({SQL[name]})").fetchall()
        assert sorted(map(plain, rows)) == sorted(map(plain, want))


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(CORE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm(monkeypatch):
    monkeypatch.setattr(entry, "LLM", "quernel.gone")
    assert set(entry.queries()) == set(CORE)


def test_with_a_broken_part_of_llm(monkeypatch):
    monkeypatch.setattr(entry.importlib.import_module("quernel.llm"), "QUERY_MODULES", ["quernel.llm.gone"])
    assert set(CORE) == set(entry.queries())
