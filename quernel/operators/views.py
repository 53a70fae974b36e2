"""Declarative views: a filter tree, sort keys, columns and a limit, compiled to one DataFrame plan.

Leaves are two-valued: a missing field fails every operator but ``missing``, and a negation around it holds. Values compare
as numbers if both can be read as such, else as text in byte order. Where column and literal are numbers already, or text
against text that is no number, the plain comparison is emitted, so that it is pushed down to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quernel.functions.frontmatter import parse_front

COMPARE = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}
OPERATORS = (*COMPARE, "in", "has", "exists", "missing", "contains")


@dataclass
class View:
    """columns: names to show; filters: a tree of and/or/not and leaves {field, op, value}; sort: (field, "asc" or "desc")."""

    columns: Sequence[str]
    filters: dict[str, Any] = field(default_factory=dict)
    sort: Sequence[tuple[str, str]] = ()
    limit: int = 0

    def __post_init__(self) -> None:
        if not self.columns:
            raise ValueError("a view needs a column")
        if any(d not in ("asc", "desc") for _, d in self.sort):
            raise ValueError("a sort direction is asc or desc")
        _check(self.filters)


def _check(node: dict[str, Any]) -> None:
    inner = [k for k in ("and", "or", "not") if node.get(k)]
    if inner and "field" in node:
        raise ValueError("a node is either a container or a leaf")
    for k in ("and", "or"):
        for child in node.get(k) or []:
            _check(child)
    if node.get("not"):
        _check(node["not"])
    if "field" in node:
        if node.get("op") not in OPERATORS:
            raise ValueError(f"unknown operator {node.get('op')!r}")
        if node["op"] not in ("exists", "missing") and "value" not in node:
            raise ValueError(f"{node['op']} needs a value")


def _number(v: Any) -> float | None:
    try:
        return None if isinstance(v, bool) else float(v)
    except (TypeError, ValueError):
        return None


def text_of(c: Column, kind: T.DataType) -> Column:
    """A field as a view shows it: lists joined by ", ", nothing as ""."""
    shown = F.array_join(c.cast("array<string>"), ", ") if isinstance(kind, T.ArrayType) else c.cast("string")
    return F.coalesce(shown, F.lit(""))


def _compare(c: Column, kind: T.DataType, op: str, value: Any) -> Column:
    call = COMPARE[op]
    n = _number(value)
    if isinstance(kind, T.NumericType) and n is not None:
        return getattr(c, call)(F.lit(value if not isinstance(value, str) else n))
    s = text_of(c, kind)
    if n is None:
        return getattr(c if isinstance(kind, T.StringType) else s, call)(F.lit(str(value)))
    number = s.try_cast("double")
    return F.when(number.isNotNull(), getattr(number, call)(F.lit(n))).otherwise(getattr(s, call)(F.lit(str(value))))


def _leaf(df: DataFrame, node: dict[str, Any], negated: bool) -> Column:
    name, op, value = node["field"], node["op"], node.get("value")
    if name not in df.columns:
        return F.lit(op == "missing")
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    array = isinstance(kind, T.ArrayType)
    blank = c.isNull() | ((F.size(c) == 0) if array else (F.trim(c.cast("string")) == "") if isinstance(kind, T.StringType) else F.lit(False))
    if op == "missing":
        return F.coalesce(blank, F.lit(True))
    if op == "exists":
        return ~F.coalesce(blank, F.lit(True))
    if op == "in":
        found = reduce(Column.__or__, [_compare(c, kind, "eq", v) for v in value], F.lit(False))
    elif op == "has":
        found = F.exists(c, lambda x: _compare(x, kind.elementType, "eq", value)) if array else _compare(c, kind, "eq", value)
    elif op == "contains":
        found = F.lower(text_of(c, kind)).contains(str(value).lower())
    else:
        found = _compare(c, kind, op, value)
    # a filter drops null like false, so only a leaf under a negation needs a value, and the others stay fit for pushdown
    return F.coalesce(found & c.isNotNull(), F.lit(False)) if negated else found & c.isNotNull()


def compile_filter(df: DataFrame, node: dict[str, Any], negated: bool = False) -> Column:
    """A filter tree as a condition on df. An empty node holds; and comes before or, or before not."""
    if node.get("and"):
        return reduce(Column.__and__, [compile_filter(df, n, negated) for n in node["and"]])
    if node.get("or"):
        return reduce(Column.__or__, [compile_filter(df, n, negated) for n in node["or"]])
    if node.get("not"):
        return ~compile_filter(df, node["not"], True)
    return _leaf(df, node, negated) if "field" in node else F.lit(True)


def run_view(df: DataFrame, view: View, path: str) -> DataFrame:
    """The rows of a view: _path and its columns, as text. Sorted by its keys, then by path; the limit comes last.

    Sort order: values that can be read as numbers first, as numbers, then the others as text, nothing as "".
    """
    rows = df.filter(compile_filter(df, view.filters)) if view.filters else df
    if view.sort:
        keys = []
        for name, direction in view.sort:
            s = text_of(F.col(f"`{name}`"), df.schema[name].dataType) if name in df.columns else F.lit("")
            number = s.try_cast("double")
            order = "desc" if direction == "desc" else "asc"
            keys += [getattr(number.isNull().cast("int"), order)(), getattr(F.coalesce(number, F.lit(0.0)), order)(), getattr(F.when(number.isNull(), s).otherwise(""), order)()]
        rows = rows.orderBy(*keys, F.col(f"`{path}`").asc())
    if view.limit:
        rows = rows.limit(view.limit)
    shown = [text_of(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) if c in df.columns else F.lit("").alias(c) for c in view.columns]
    return rows.select(text_of(F.col(f"`{path}`"), df.schema[path].dataType).alias("_path"), *shown)


def markdown_table(columns: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    """Rows already on the driver (a view's limit bounds them) as a Markdown table."""
    clean = lambda v: str(v).replace("|", "\\|").replace("\r", "").replace("\n", " ")
    lines = ["| " + " | ".join(map(clean, columns)) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(map(clean, r)) + " |" for r in rows])


def load_view(text: str) -> View:
    """A view from its YAML: columns (one at least), filter, sort (a list of {field, dir} or of names, a leading - for descending) and limit.

    Raises ValueError for what isn't one.
    """
    raw = parse_front(text)
    columns = raw.get("columns")
    if not isinstance(columns, list) or not columns:
        raise ValueError("a view needs columns")
    sort = []
    for s in raw.get("sort") or []:
        if isinstance(s, dict):
            name, direction = s.get("field"), s.get("dir", "asc")
        else:
            name, direction = str(s).lstrip("-"), "desc" if str(s).startswith("-") else "asc"
        if not name or direction not in ("asc", "desc"):
            raise ValueError(f"a sort needs a field, and asc or desc: {s!r}")
        sort.append((str(name), direction))
    limit = raw.get("limit") or 0
    if not isinstance(limit, int) or limit < 0:
        raise ValueError("a limit is a number from 0 on")
    return View([str(c) for c in columns], raw.get("filter") or {}, sort, limit)


def write_view(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A view's rows as files: json (a row a line) or csv (with a header), written over what was there."""
    if kind not in ("json", "csv"):
        raise ValueError(f"no sink {kind!r}")
    writer = rows.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).option("escape", '"').csv(path)
