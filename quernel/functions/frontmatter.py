"""Front matter of Markdown files: read as YAML (the part of it that notes use), edited and repaired line by line.

Reading is tolerant: a line that makes no sense is passed over, the last of repeated keys counts, dates stay text. Editing keeps every
line it has no reason to touch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Kinds of typed relations, which are keys of the front matter, and other keys that hold lists.
RELATIONS = ("supersedes", "superseded_by", "contradicts", "applies_to", "derived_from", "instance_of", "specializes", "extends", "cited_by", "informs")
LISTS = ("tags", "related", "sources", "aliases", "stack")
SCALARS = ("title", "type", "created", "updated", "domain", "confidence", "status", "contributor", "verdict", "problem", "depth", "authority", "index_tier", "index_tier_override")
FLAGS = ("rolling", "relations_locked")
FRONT = "(?s)\\A\\x{FEFF}?---[ \\t]*\\r?\\n(.*?)(?:\\A|(?<=\\n))---[ \\t]*(?:\\r?\\n|\\z)"
KEY = re.compile(r"([A-Za-z_][\w.-]*):(?:[ \t]+(.*)|[ \t]*)$")
DATE = re.compile(r"(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})$")


def front_of(c: Column) -> Column:
    """The text between the two lines of dashes that a file begins with; empty if there are none."""
    return F.regexp_extract(c, FRONT, 1)


def body_of(c: Column) -> Column:
    """What follows the front matter; all of a text that has none."""
    return F.regexp_replace(c, FRONT, "")


def fast_title(c: Column) -> Column:
    """The first title line, without quotes and without reading the rest; empty if there is none."""
    return F.regexp_replace(F.trim(F.regexp_extract(c, "(?m)^title:[ \\t]*([^\\r\\n]*)", 1)), "^([\"'])(.*)\\1$", "$2")


def _bare(s: str) -> str:
    """Without a comment at the end."""
    quote = ""
    for i, ch in enumerate(s):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'" and (i == 0 or s[i - 1] in "[{,: "):
            quote = ch
        elif ch == "#" and (i == 0 or s[i - 1] in " \t"):
            return s[:i].rstrip()
    return s.rstrip()


def _parts(s: str) -> list[str]:
    """What commas part, outside quotes and brackets."""
    out, depth, quote, at = [], 0, "", 0
    for i, ch in enumerate(s):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'" and not s[at:i].strip():
            quote = ch
        elif ch in "[{":
            depth += 1
        elif ch in "]}":
            depth -= 1
        elif ch == "," and depth <= 0:
            out.append(s[at:i])
            at = i + 1
    return [p.strip() for p in (*out, s[at:]) if p.strip()]


def _scalar(s: str):  # noqa: ANN202
    s = s.strip()
    if len(s) > 1 and s[0] == s[-1] == '"':
        try:
            return json.loads(s)
        except ValueError:
            return s[1:-1]
    if len(s) > 1 and s[0] == s[-1] == "'":
        return s[1:-1].replace("''", "'")
    if s.startswith("[[") and s.endswith("]]") and s.count("[[") == 1:
        return s  # a link, not a list of a list
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(p) for p in _parts(s[1:-1])]
    if s.startswith("{") and s.endswith("}"):
        pairs = [p.partition(":") for p in _parts(s[1:-1])]
        return {k.strip().strip("\"'"): _scalar(v) for k, _, v in pairs if k.strip()}
    if s in ("", "~", "null", "Null", "NULL"):
        return None
    if s in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return s.lower() == "true"
    if re.fullmatch(r"[-+]?(?:0|[1-9]\d{0,17})", s):
        return int(s)
    if re.fullmatch(r"[-+]?\d+\.\d+(?:[eE][-+]?\d+)?", s):
        return float(s)
    return s


def _block(lines: list[tuple[int, str]], at: int, indent: int, depth: int = 0) -> tuple[object, int]:
    """The list or map of the lines from at on that lie at indent or deeper, and where it ends."""
    if lines[at][1].startswith("- ") or lines[at][1] == "-":
        items: list = []
        while at < len(lines) and lines[at][0] >= indent and (lines[at][1].startswith("- ") or lines[at][1] == "-"):
            inner, text = lines[at][0], lines[at][1][1:].strip()
            m = KEY.match(text)
            if m and not text.startswith(('"', "'", "[", "{")) and depth < 20:
                lines[at] = (inner + 2, text)
                value, at = _block(lines, at, inner + 1, depth + 1)
                items.append(value)
            else:
                items.append(_scalar(_bare(text)))
                at += 1
                while at < len(lines) and lines[at][0] > inner:
                    at += 1
        return items, at
    out: dict = {}
    own = lines[at][0]
    while at < len(lines) and lines[at][0] >= indent:
        if lines[at][0] != own or not (m := KEY.match(lines[at][1])):
            at += 1
            continue
        key, rest = m.group(1), _bare(m.group(2) or "")
        at += 1
        deeper = at < len(lines) and (lines[at][0] > own or (lines[at][0] == own and (lines[at][1].startswith("- ") or lines[at][1] == "-")))
        if re.fullmatch(r"[|>][-+]?", rest):
            texts = []
            while at < len(lines) and lines[at][0] > own:
                texts.append(lines[at][1])
                at += 1
            out[key] = ("\n" if rest[0] == "|" else " ").join(texts)
        elif not rest and deeper and depth < 20:
            out[key], at = _block(lines, at, lines[at][0], depth + 1)
        else:
            out[key] = _scalar(rest)
            while at < len(lines) and lines[at][0] > own:
                at += 1
    return out, at


def parse_front(text: str | None) -> dict:
    """The fields of front matter (the text between the dashes)."""
    lines = []
    for raw in (text or "").replace("\r", "").replace("\t", "  ").split("\n"):
        bare = raw.strip()
        if bare and not bare.startswith("#"):
            lines.append((len(raw) - len(raw.lstrip()), bare))
    if not lines:
        return {}
    got, _ = _block(lines, 0, 0)
    return got if isinstance(got, dict) else {}


def _strings(v) -> list[str]:  # noqa: ANN001
    """A value as a list of strings: a scalar is a list of one, what is no scalar within a list is left out."""
    if v is None:
        return []
    items = v if isinstance(v, list) else [v]
    return [x if isinstance(x, str) else json.dumps(x) for x in items if x is not None and not isinstance(x, (dict, list))]


def _string(v) -> str | None:  # noqa: ANN001
    return None if v is None or isinstance(v, (dict, list)) else v if isinstance(v, str) else json.dumps(v)


FIELDS = T.StructType([*[T.StructField(n, T.StringType()) for n in SCALARS], *[T.StructField(n, T.ArrayType(T.StringType())) for n in (*LISTS, *RELATIONS)], *[T.StructField(n, T.BooleanType()) for n in FLAGS]])


@F.pandas_udf(FIELDS)
def front_fields(front: pd.Series) -> pd.DataFrame:
    """The known fields of front matter, with the types they should have."""
    rows = []
    for text in front:
        d = parse_front(text)
        rows.append((*[_string(d.get(n)) for n in SCALARS], *[_strings(d.get(n)) for n in (*LISTS, *RELATIONS)], *[d.get(n) is True for n in FLAGS]))
    return pd.DataFrame(rows, columns=FIELDS.fieldNames())


@F.pandas_udf(T.StringType())
def front_json(front: pd.Series) -> pd.Series:
    """All fields of front matter as JSON, whatever they are called; ``try_parse_json`` makes a variant of it."""
    return front.map(lambda t: json.dumps(parse_front(t), ensure_ascii=False), na_action="ignore")


# Editing: a file is its front matter's units (a key's line and those below it) and the rest.


def _cut(text: str) -> tuple[str, list[list[str]], str] | None:
    """The opening line, the units and the rest (from the closing line on) of a file with front matter."""
    lines = text.split("\n")
    if not re.fullmatch(r"﻿?---[ \t]*\r?", lines[0]):
        return None
    for k in range(1, len(lines)):
        if re.fullmatch(r"---[ \t]*\r?", lines[k]):
            units: list[list[str]] = []
            for line in lines[1:k]:
                if KEY.match(line.rstrip("\r")) or not units:
                    units.append([line])
                else:
                    units[-1].append(line)
            return lines[0], units, "\n".join(lines[k:])
    return None


def _key(unit: list[str]) -> str:
    m = KEY.match(unit[0].rstrip("\r"))
    return m.group(1) if m else ""


def _joined(head: str, units: list[list[str]], rest: str) -> str:
    return "\n".join([head, *[line for u in units for line in u], rest])


def _quoted(s: str) -> str:
    """A scalar as YAML reads it back."""
    plain = re.fullmatch(r"[\w][\w .,/()+-]*", s) and s == s.strip() and _scalar(s) == s
    return s if plain else json.dumps(s, ensure_ascii=False)


def set_field(text: str, key: str, value: str) -> str:
    """A file with one field set; a key that is missing comes last. A file without front matter gets one."""
    line = f"{key}: {_quoted(value)}"
    cut = _cut(text)
    if cut is None:
        return f"---\n{line}\n---\n{text}"
    head, units, rest = cut
    if any(_key(u) == key for u in units):
        units = [[line] if _key(u) == key else u for u in units]
    else:
        units.append([line])
    return _joined(head, units, rest)


def edit_list(text: str, key: str, add: Sequence[str] = (), remove: Sequence[str] = ()) -> str:
    """A file with items of a list field added or removed, compared trimmed and whatever their case; an empty list's key goes.

    A list that already is as wanted stays as it is written. A file without front matter stays as it is.
    """
    cut = _cut(text)
    if cut is None:
        return text
    head, units, rest = cut
    own = [u for u in units if _key(u) == key]
    have = _strings(parse_front("\n".join(own[-1])).get(key)) if own else []
    gone = {r.strip().casefold() for r in remove}
    kept, seen = [], set()
    for x in [*have, *add]:
        fold = x.strip().casefold()
        if fold and fold not in gone and fold not in seen:
            seen.add(fold)
            kept.append(x.strip())
    if kept == have:
        return text
    new = [f"{key}:", *[f"  - {_quoted(x)}" for x in kept]]
    units = [u for u in units if _key(u) != key or u is own[-1]] if own else [*units, new]
    units = [(new if own and u is own[-1] else u) for u in units]
    return _joined(head, [u for u in units if kept or u is not new], rest)


def repair(text: str) -> tuple[str, list[str]]:
    """A file with what can be repaired in its front matter, and the names of the repairs made.

    nested: a whole front matter under a key ``frontmatter`` is taken out; duplicate-keys: the last one stays; dates: Y/M/D and Y.M.D become
    Y-M-D; lists: a scalar where a list belongs becomes one, at its commas; aliases: repeated ones go, whatever their case. Doing it again changes nothing.
    """
    cut = _cut(text)
    if cut is None:
        return text, []
    head, units, rest = cut
    done = []
    if any(_key(u) == "frontmatter" for u in units):
        units, done = [u for u in units if _key(u) != "frontmatter"], [*done, "nested"]
    last = {_key(u): i for i, u in enumerate(units)}
    if len(once := [u for i, u in enumerate(units) if not _key(u) or last[_key(u)] == i]) < len(units):
        units, done = once, [*done, "duplicate-keys"]
    for i, u in enumerate(units):
        key, value = _key(u), (KEY.match(u[0].rstrip("\r")) or [None, None, ""])[2]
        value = _bare(value or "").strip("\"'")
        if key in ("created", "updated") and (m := DATE.match(value)) and f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}" != value:
            units[i], done = [f"{key}: {m[1]}-{int(m[2]):02d}-{int(m[3]):02d}"], [*done, "dates"]
        elif key in ("tags", "related", "sources") and value and not (KEY.match(u[0].rstrip("\r"))[2] or "").lstrip().startswith("["):
            items = [p.strip().strip("\"'") for p in value.split(",")]
            units[i], done = [f"{key}: [" + ", ".join(_quoted(p) for p in items if p) + "]"], [*done, "lists"]
        elif key == "aliases" and not value:
            have = _strings(parse_front("\n".join(u)).get(key))
            folds = list(dict.fromkeys(x.strip().casefold() for x in have if x.strip()))
            if len(folds) < len(have):
                first = {f: next(x.strip() for x in have if x.strip().casefold() == f) for f in folds}
                units[i], done = ["aliases:", *[f"  - {_quoted(x)}" for x in first.values()]], [*done, "aliases"]
    return (_joined(head, units, rest), list(dict.fromkeys(done))) if done else (text, [])


def see_also(text: str, title: str) -> str:
    """A page with a link to title under "## See Also", which is added at the end if it is missing; a page that has the link stays as it is."""
    if f"[[{title}]]" in text:
        return text
    mark = "\n## See Also\n"
    at = text.find(mark)
    if at < 0:
        return text.rstrip("\n") + f"\n\n## See Also\n\n- [[{title}]]\n"
    at += len(mark)
    end = text.find("\n## ", at)
    end = len(text) if end < 0 else end
    at += len(text[at:end].rstrip("\n"))
    return f"{text[:at]}\n- [[{title}]]{text[at:]}"


def _edited(change: Callable[..., str], *columns: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if x[0] is None else x[0] if any(v is None for v in x[1:]) else change(*x) for x in zip(*series, strict=True)], dtype="object")

    return run(*columns)


def with_edits(text: Column, *edits: Callable[[str], str]) -> Column:
    """Edits of a text, one after the other, in one pass over the column."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            for edit in edits:
                t = edit(t)
            return t

        return texts.map(one, na_action="ignore")

    return run(text)


def with_field(text: Column, key: str, value: Column) -> Column:
    """set_field over a column; a null value changes nothing."""
    return _edited(lambda t, v: set_field(t, key, v), text, value)


def with_items(text: Column, key: str, items: Column) -> Column:
    """edit_list over a column, adding items (an array); a null one changes nothing."""
    return _edited(lambda t, v: edit_list(t, key, add=list(v)), text, items)


def without_items(text: Column, key: str, items: Column) -> Column:
    """edit_list over a column, removing items (an array)."""
    return _edited(lambda t, v: edit_list(t, key, remove=list(v)), text, items)


def with_see_also(text: Column, title: Column) -> Column:
    """see_also over a column."""
    return _edited(see_also, text, title)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("fixes", T.ArrayType(T.StringType()))]))
def repaired(text: pd.Series) -> pd.DataFrame:
    """repair over a column."""
    return pd.DataFrame([repair(t) if t is not None else (None, []) for t in text], columns=["text", "fixes"])
