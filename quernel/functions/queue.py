"""Queue entries as text of ``key: value`` lines, bytes with addresses in them, and small tests of fetched and noted text, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from quernel.functions.text import word_count

# What in a text points to a decision, a measurement, a tool.
DECISION = "(?i)(?:chose|decided|picked|selected).*(?:because|over|instead)"
QUANTITY = "[0-9]+[0-9.]*(?:%|ms|[0-9]s| MB| KB| seconds|x faster|x slower| hours| minutes)"
TOOL = "(?i)(?:uses|integrates with|depends on|powered by|built with|replaced) [A-Z][a-zA-Z]*"
# Forms of mentions.
EMAIL = "\\b[A-Za-z0-9._%+-]{2,}@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b"
HANDLE = "(?:^|\\s)(@[A-Za-z0-9_]{3,30})\\b"
LINK = "\\[\\[([^\\]\\n]+)\\]\\]"


def _line(c: Column) -> Column:
    """A value on one line, null if nothing is left of it."""
    s = F.trim(F.regexp_replace(c, "[\\r\\n]+", " "))
    return F.when(s != "", s)


def queue_text(url: Column, title: Column, tags: Column, domain: Column, fetcher: Column, source: Column, note: Column, queued_at: Column) -> Column:
    """An entry as lines; fields that are missing, and the fetcher auto, have none. A note keeps its line ends, written as \\n."""
    pair = lambda k, v: F.concat(F.lit(k + ": "), v)
    listed = F.array_join(F.filter(F.transform(tags, _line), lambda x: x.isNotNull()), ", ")
    f = _line(fetcher)
    encoded = F.replace(F.replace(F.replace(F.when(note != "", note), F.lit("\\"), F.lit("\\\\")), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.concat_ws("\n", pair("url", _line(url)), pair("title", _line(title)), pair("tags", F.when(listed != "", listed)), pair("domain", _line(domain)), pair("fetcher", F.when(f != "auto", f)), pair("source", _line(source)), pair("note", encoded), pair("queued_at", _line(queued_at)))


def queue_fields(text: Column) -> Column:
    """The fields of an entry as a map; of repeated keys the first counts, lines without a colon and comments are passed over."""
    lines = F.filter(F.transform(F.split(text, "\\r?\\n"), lambda x: F.trim(x)), lambda x: ~x.startswith("#") & x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1))


def queue_note(fields: Column) -> Column:
    """The note of an entry's fields, with its line ends."""
    raw = F.try_element_at(fields, F.lit("note"))
    parts = F.transform(F.split(raw, "\\\\\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(parts, "\\")


def _scan(blob: bytes) -> list[str]:
    out, at = [], 0
    while True:
        starts = [s for s in (blob.find(b"http://", at), blob.find(b"https://", at)) if s >= 0]
        if not starts:
            return out
        start = min(starts)
        end = start + (8 if blob.startswith(b"https://", start) else 7)
        while end < len(blob) and 0x21 <= blob[end] <= 0x7E and blob[end] not in b"\"<>\\^`{|}":
            end += 1
        if end > start + 8:
            out.append(blob[start:end].decode("ascii"))
        at = end


@F.pandas_udf(T.ArrayType(T.StringType()))
def byte_urls(blobs: pd.Series) -> pd.Series:
    """Addresses in bytes, in order, each as long as its bytes may stand in one; a bare scheme is none."""
    return blobs.map(lambda b: _scan(bytes(b)), na_action="ignore")


def is_stub(body: Column, via: Column | None = None, least: int = 60, least_without_links: int = 20) -> Column:
    """Whether a fetched page is a stub: fetched as one, under so many words, or hardly any but addresses."""
    text = F.coalesce(body, F.lit(""))
    bare = F.regexp_replace(text, "https?://\\S+", " ")
    stub = F.coalesce(F.lower(via) == "stub", F.lit(False)) if via is not None else F.lit(False)
    return stub | (word_count(text) < least) | (word_count(bare) < least_without_links)


def subscribed(domain: Column, tags: Column, domains: Sequence[str], wanted: Sequence[str]) -> Column:
    """Whether an article is of a subscribed domain or bears a subscribed tag, whatever the case."""
    of = F.coalesce(F.lower(domain).isin([d.lower() for d in domains if d]), F.lit(False)) if domains else F.lit(False)
    have = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(x))
    return of | (F.arrays_overlap(have, F.array(*[F.lit(t.lower()) for t in wanted if t])) if wanted else F.lit(False))


def knowledge_marks(c: Column) -> tuple[Column, Column, Column]:
    """(decisions, quantities, tools): how often a text says why something was chosen, gives a measurement, names a tool."""
    n = lambda p: F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0))
    return n(DECISION), n(QUANTITY), n(TOOL)


def duration_hours(begin: Column, end: Column) -> Column:
    """Hours from one time to another to a tenth, never below 0, null if either is missing; times are microseconds."""
    hours = (end - begin) / F.lit(3_600_000_000.0)
    return F.round(F.when(hours < 0, 0.0).otherwise(hours), 1)
