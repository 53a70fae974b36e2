import datetime

import pytest

from quernel.operators.views import View, compile_filter, markdown_table, run_view

ROW = ("a.md", "Foo", "decision", "active", 10, ["go", "kb"], datetime.date(2026, 4, 1))
SCHEMA = "rel string, title string, type string, status string, weight int, tags array<string>, updated date"
LEAVES = [
    ("type", "eq", "decision", True), ("type", "eq", "research", False), ("type", "ne", "research", True), ("weight", "gt", 5, True), ("weight", "le", 10, True), ("weight", "lt", "9", False),
    ("type", "in", ["decision", "pattern"], True), ("type", "in", ["research"], False), ("tags", "has", "kb", True), ("tags", "has", "rust", False), ("title", "contains", "FO", True),
    ("status", "exists", None, True), ("gone", "exists", None, False), ("gone", "missing", None, True), ("updated", "lt", "2026-05-01", True), ("gone", "ne", "x", False), ("tags", "eq", "go, kb", True),
]


@pytest.mark.parametrize(("field", "op", "value", "want"), LEAVES)
def test_leaves(spark, field, op, value, want):
    df = spark.createDataFrame([ROW], SCHEMA)
    leaf = {"field": field, "op": op} | ({} if value is None else {"value": value})
    assert (df.filter(compile_filter(df, leaf)).count() == 1) is want
    assert (df.filter(compile_filter(df, {"not": leaf})).count() == 0) is want


def test_containers(spark):
    df = spark.createDataFrame([ROW, (None,) * 7], SCHEMA)
    assert df.filter(compile_filter(df, {})).count() == 2
    never, always = {"field": "gone", "op": "exists"}, {"field": "gone", "op": "missing"}
    assert df.filter(compile_filter(df, {"and": [always], "or": [never], "not": always})).count() == 2
    assert df.filter(compile_filter(df, {"or": [never, {"field": "title", "op": "eq", "value": "Foo"}]})).count() == 1


@pytest.mark.parametrize("bad", [{"and": [{}], "field": "a", "op": "eq", "value": 1}, {"field": "a", "op": "matches", "value": 1}, {"field": "a", "op": "eq"}])
def test_invalid(bad):
    with pytest.raises(ValueError):
        View(["a"], bad)


def test_sort_limit_projection(spark):
    rows = [("d", "x", "10"), ("c", "y", "9"), ("b", None, "z"), ("a", "w", None), ("e", "v", "9")]
    df = spark.createDataFrame(rows, "rel string, title string, rank string")
    out = run_view(df, View(["title", "gone"], sort=[("rank", "asc")], limit=4), "rel").collect()
    assert [(r._path, r.title, r.gone) for r in out] == [("c", "y", ""), ("e", "v", ""), ("d", "x", ""), ("a", "w", "")]
    assert run_view(df.limit(0), View(["title"], sort=[("rank", "desc")]), "rel").count() == 0
    assert markdown_table(["a|b"], [["x\ny"]]) == "| a\\|b |\n|---|\n| x y |"


def test_numeric_filters_reach_the_scan(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet")
    plan = run_view(df, View(["o_orderkey"], {"field": "o_totalprice", "op": "gt", "value": 1000}), "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000" in plan and "o_orderdate" not in plan


def test_load_view(tmp_path, spark):
    from quernel.operators.views import load_view, write_view

    view = load_view("columns: [title, weight]\nfilter:\n  and:\n    - field: type\n      op: eq\n      value: decision\n    - not: {field: status, op: missing}\nsort:\n  - field: weight\n    dir: desc\n  - title\nlimit: 3\n")
    assert view.columns == ["title", "weight"] and view.sort == [("weight", "desc"), ("title", "asc")] and view.limit == 3
    rows = run_view(spark.createDataFrame([ROW, ("b.md", 'q "x", y', "decision", None, 3, None, None)], SCHEMA), view, "rel")
    assert [tuple(r) for r in rows.collect()] == [("a.md", "Foo", "10")]
    for kind in ("json", "csv"):
        write_view(rows, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 1
    for bad in ("limit: 3", "columns: []", "columns: [a]\nsort:\n  - {field: a, dir: up}", "columns: [a]\nlimit: -1", "columns: [a]\nfilter: {field: a, op: like, value: 1}"):
        with pytest.raises(ValueError):
            load_view(bad)
