"""Ordered sets, capped lists, dated entries and spans, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ordered_union(a: Column, b: Column) -> Column:
    """Elements of a, then those of b, each once by its trimmed form, in the form first seen; blanks are left out."""
    every = F.filter(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    known = lambda acc, x: F.exists(acc, lambda y: F.trim(y) == F.trim(x))
    return F.aggregate(every, F.array().cast("array<string>"), lambda acc, x: F.when(known(acc, x), acc).otherwise(F.array_append(acc, x)))


def sorted_set(a: Column) -> Column:
    """Different elements in order."""
    return F.array_sort(F.array_distinct(a))


def capped(a: Column, most: int) -> Column:
    """The first so many elements and, if there are more, one that says how many."""
    more = F.size(a) - most
    return F.when(more <= 0, a).otherwise(F.array_append(F.slice(a, 1, most), F.concat(F.lit("... and "), more.cast("string"), F.lit(" more"))))


def last_lines(c: Column, n: int) -> Column:
    """The last so many lines; a line end at the end of the text opens no further one."""
    lines = F.split(F.regexp_replace(c, "\\r?\\n\\z", ""), "\\r?\\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")


def dated_entries(c: Column) -> Column:
    """Headings of the form ``## YYYY-MM-DD | title`` with real dates, in order: array of (day, title)."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), c), F.lit("\\n## (\\d{4}-\\d{2}-\\d{2} \\| [^\\r\\n]+)"), F.lit(1))
    rows = F.transform(found, lambda x: F.struct(F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd").alias("day"), F.trim(F.substr(x, F.lit(14))).alias("title")))
    return F.filter(rows, lambda x: x["day"].isNotNull())


def noted_pairs(c: Column) -> Column:
    """Lines of the form ``[A | B] note``: array of (first, second, note), the names in order."""
    lines = F.filter(F.transform(F.split(c, "\\r?\\n"), lambda x: F.regexp_replace(F.trim(x), "^[-*] ", "")), lambda x: x.rlike("^\\[[^\\]|]+\\|[^\\]|]+\\]"))

    def pair(x):  # noqa: ANN001, ANN202
        part = lambda i: F.trim(F.regexp_extract(x, "^\\[([^\\]|]+)\\|([^\\]|]+)\\]\\s*(.*)$", i))
        return F.struct(F.least(part(1), part(2)).alias("first"), F.greatest(part(1), part(2)).alias("second"), part(3).alias("note"))

    return F.transform(lines, pair)


def chapter_spans(offsets: Column, size: Column) -> Column:
    """(start, length) of chapters given their offsets: each reaches to the next greater offset; offset 0 after the first, or null, is unresolved."""
    good = lambda x, i: x.isNotNull() & ((x > 0) | (i == 0))
    marked = F.transform(offsets, lambda x, i: F.when(good(x, i), x))

    def span(x):  # noqa: ANN001, ANN202
        after = F.array_min(F.filter(marked, lambda y: y > x))
        return F.struct(x.alias("start"), (F.coalesce(after, size) - x).alias("length"))

    return F.transform(marked, lambda x: F.when(x.isNotNull(), span(x)))


def later(a: Column, b: Column) -> Column:
    """The later of two stamps, as instants if both can be read, else as text; null only if both are."""
    x, y = a.try_cast("timestamp"), b.try_cast("timestamp")
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), F.when(x >= y, a).otherwise(b)).otherwise(F.greatest(a, b)))
