import datetime

import pytest
from pyspark.sql import functions as F

from quernel.functions import lists as L


def one(spark, schema, expr, *values):
    df = spark.createDataFrame([values], schema)
    return df.select(expr(*[F.col(c) for c in df.columns]).alias("x")).first().x


def test_lists(spark):
    two = "a array<string>, b array<string>"
    assert one(spark, two, L.ordered_union, ["x ", "y", "x"], ["y", "z", " ", None]) == ["x ", "y", "z"]
    assert one(spark, two, L.ordered_union, None, ["a"]) == ["a"]
    assert one(spark, "a array<string>", L.sorted_set, ["b", "a", "b"]) == ["a", "b"]
    assert one(spark, "a array<string>", lambda a: L.capped(a, 2), ["a", "b", "c", "d"]) == ["a", "b", "... and 2 more"]
    assert one(spark, "a array<string>", lambda a: L.capped(a, 2), ["a"]) == ["a"]


@pytest.mark.parametrize(("text", "want"), [("a\nb\r\nc\n", "b\nc"), ("a", "a"), ("", "")])
def test_last_lines(spark, text, want):
    assert one(spark, "t string", lambda c: L.last_lines(c, 2), text) == want


def test_texts(spark):
    got = one(spark, "t string", L.dated_entries, "## 2026-01-02 | One \nx\n## 2026-02-30 | Bad\n## 2026-01-03 | Two")
    assert [(r.day, r.title) for r in got] == [(datetime.date(2026, 1, 2), "One"), (datetime.date(2026, 1, 3), "Two")]
    got = one(spark, "t string", L.noted_pairs, "- [B | A] they differ\nnone\n[C|D]")
    assert [tuple(r) for r in got] == [("A", "B", "they differ"), ("C", "D", "")]


def test_spans_and_stamps(spark):
    got = one(spark, "o array<int>, n int", L.chapter_spans, [0, 50, 0, None, 20], 90)
    assert [tuple(r) if r else None for r in got] == [(0, 20), (50, 40), None, None, (20, 30)]
    assert one(spark, "a string, b string", L.later, "2026-01-01T00:00:00Z", "2026-01-01T02:00:00+03:00") == "2026-01-01T00:00:00Z"
    assert one(spark, "a string, b string", L.later, None, "x") == "x" and one(spark, "a string, b string", L.later, "a", "b") == "b"
