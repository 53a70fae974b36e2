"""Tests and parts of paths, addresses of repositories and durations, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def _glob(pattern: str) -> str:
    out = ""
    for part in re.split(r"(\*\*|\*|\?|\[[^\]]*\])", pattern):
        out += {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, part if part.startswith("[") and part.endswith("]") else re.sub(r"([^\w/\s-])", r"\\\1", part))
    return out


def matches_glob(c: Column, pattern: str) -> Column:
    """Whether a path or one of its ancestors matches a glob (``*`` within a segment, ``**`` across)."""
    return F.coalesce(c.rlike("^" + _glob(pattern.rstrip("/")) + "(?:/.*)?$"), F.lit(False))


def source_allowed(path: Column, remote: Column, exclude: Sequence[str], remotes: Sequence[str], include: Sequence[str]) -> Column:
    """Excluded paths never; else those of an allowed remote, else those included; all if neither list says anything."""
    any_of = lambda ps: reduce(Column.__or__, [matches_glob(path, p) for p in ps], F.lit(False))
    key = remote_key(remote)
    near = reduce(Column.__or__, [F.coalesce((key == r.lower()) | key.startswith(r.lower().rstrip("/") + "/"), F.lit(False)) for r in remotes], F.lit(False))
    open_ = F.lit(not remotes and not include)
    return ~any_of(exclude) & (near | any_of(include) | open_)


def remote_key(c: Column) -> Column:
    """host/path of a repository's address: scheme, user and .git dropped, git@host:path read like an address, lower case."""
    s = F.regexp_replace(F.trim(c), "^[\\w.-]+@([^:/]+):", "$1/")
    s = F.regexp_replace(s, "^\\w+://(?:[^@/]*@)?", "")
    return F.lower(F.regexp_replace(s, "(?:\\.git)?/*$", ""))


def within(path: Column, root: str) -> Column:
    """Whether a path is root or lies under it."""
    r = root.rstrip("/")
    return F.coalesce((path == r) | path.startswith(r + "/"), F.lit(False))


def segments(c: Column) -> Column:
    """The segments of a path that aren't empty."""
    return F.filter(F.split(c, "/"), lambda x: x != "")


def ignored_path(c: Column, listed: Sequence[str] = (), least: int = 4) -> Column:
    """A path of too few segments or at or under a listed one."""
    return reduce(Column.__or__, [within(c, p) for p in listed], F.coalesce(F.size(segments(c)) < least, F.lit(True)))


def base_name(c: Column) -> Column:
    """The last segment."""
    return F.coalesce(F.try_element_at(segments(c), F.lit(-1)), F.lit(""))


def folder(c: Column) -> Column:
    """All but the last segment; empty at the top."""
    return F.regexp_replace(F.when(c.contains("/"), c).otherwise(""), "/[^/]*$", "")


def has_placeholder_name(c: Column) -> Column:
    """A name with a template's {{UPPER}} left in it."""
    return F.coalesce(c.rlike("\\{\\{[A-Z][A-Z0-9_]*\\}\\}"), F.lit(False))


def canonical_of_copy(c: Column) -> Column:
    """For x.md.md and x_md.md the path x.md that it copies; null for other paths."""
    return F.when(c.rlike("(?:\\.md|_md)\\.md$"), F.regexp_replace(c, "(?:\\.md|_md)\\.md$", ".md"))


def safe_target(c: Column, roots: Sequence[str]) -> Column:
    """A relative path under one of the roots, without .. and hidden or underscored names and no .md.md."""
    bad = c.startswith("/") | c.rlike("(^|/)(\\.\\.?|[._][^/]*)(/|$)") | c.endswith(".md.md")
    return F.coalesce(~bad & F.split(c, "/")[0].isin(*roots) & (F.size(segments(c)) > 1), F.lit(False))


def duration_seconds(c: Column) -> Column:
    """Seconds of "90s", "15m", "12h", "1d" or "2w" and sums of them ("1h30m"); null if it is none."""
    unit = {"s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0}
    total = reduce(Column.__add__, [F.coalesce(F.regexp_extract(c, f"(\\d+(?:\\.\\d+)?){u}(?![a-z])", 1).try_cast("double"), F.lit(0.0)) * n for u, n in unit.items()])
    return F.when(c.rlike("^(?:\\d+(?:\\.\\d+)?[smhdw])+$"), total)
