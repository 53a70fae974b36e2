"""Sections and chunks of Markdown bodies: per-row functions behind Arrow batches, as both go on from what came before."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

HEADING = re.compile(rb"(?m)^(#{1,3})[ \t]+(?=\S)([^\n]*)")
SECTION = "array<struct<id: string, title: string, level: int, lines: array<int>, bytes: array<int>, tokens: int>>"
CHUNK = "array<struct<title: string, level: int, start: int, end: int>>"


def _anchor(title: str) -> str:
    kept = re.sub(r"[^a-z0-9\s-]+", "", title.lower().strip())
    return re.sub(r"\s+", "-", kept).strip("-") or "section"


def sections_of(body: str) -> list[dict]:
    """The sections of a body: one per heading of level 1 to 3, from it to the next; text before the first is in none.

    Ids are the titles' anchors, with the first unused number from 2 on if taken. Lines count from 1, tokens are bytes / 4.
    """
    raw = body.encode()
    heads = list(HEADING.finditer(raw))
    edges = [m.start() for m in heads] + [len(raw)]
    out: list[dict] = []
    used: set[str] = set()
    line, counted = 1, 0
    for m, start, end in zip(heads, edges, edges[1:], strict=False):
        title = m.group(2).decode().strip()
        anchor = base = _anchor(title)
        k = 1
        while anchor in used:
            k += 1
            anchor = f"{base}-{k}"
        used.add(anchor)
        line += raw.count(b"\n", counted, start)
        counted = start
        last = line + raw.count(b"\n", start, max(start, end - 1))
        out.append({"id": anchor, "title": title, "level": len(m.group(1)), "lines": [line, last], "bytes": [start, end], "tokens": (end - start) // 4})
    return out


def _by_paragraphs(raw: bytes, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Spans of at most ``most`` bytes between start and end, cut between paragraphs; a larger paragraph is cut hard."""
    spans: list[tuple[int, int]] = []
    at = start
    while end - at > most:
        cut = raw.rfind(b"\n\n", at + 1, at + most + 1)
        if cut < 0:
            cut, skip = at + most, 0
            while cut > at + 1 and raw[cut] & 0xC0 == 0x80:
                cut -= 1
        else:
            skip = 2
        spans.append((at, cut))
        at = cut + skip
    return spans + ([(at, end)] if end > at else [])


def chunks_of(body: str, most: int = 24 * 1024, least: int = 6 * 1024) -> list[dict]:
    """Chunks of a body: title, level and byte range.

    Neighbouring sections are joined until a chunk has ``least`` bytes, and a chunk over ``most`` is cut between paragraphs. A
    body without two such groups is one chunk if it fits, else it is cut between paragraphs.
    """
    raw = body.encode()
    heads = [(m.start(), len(m.group(1)), m.group(2).decode().strip()) for m in HEADING.finditer(raw)]
    if heads and heads[0][0] > 0:
        heads.insert(0, (0, 0, "(intro)"))
    groups: list[list] = []
    for (start, level, title), end in zip(heads, [h[0] for h in heads[1:]] + [len(raw)], strict=False):
        if groups and groups[-1][1] - groups[-1][0] < least:
            groups[-1][1] = end
        else:
            groups.append([start, end, level, title])
    spans = []
    for start, end, level, title in groups:
        parts = _by_paragraphs(raw, start, end, most)
        spans += [(title if len(parts) == 1 else f"{title} (part {i}/{len(parts)})", level, a, b) for i, (a, b) in enumerate(parts, 1)]
    if len(spans) < 2:
        parts = _by_paragraphs(raw, 0, len(raw), most) or [(0, 0)]
        spans = [("(body)" if len(parts) == 1 else f"(body) (part {i}/{len(parts)})", 0, a, b) for i, (a, b) in enumerate(parts, 1)]
    return [dict(zip(("title", "level", "start", "end"), s, strict=True)) for s in spans]


def _each(df: DataFrame, id_col: str, body_col: str, make, kind: str) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "x": [make(t) if t is not None else [] for t in b["t"]]})

    rows = df.select(F.col(id_col).alias("k"), F.col(body_col).cast("string").alias("t")).mapInPandas(run, f"k {df.schema[id_col].dataType.simpleString()}, x {kind}")
    return rows.select(F.col("k").alias(id_col), F.posexplode("x").alias("n", "x")).select(id_col, (F.col("n") + 1).alias("n"), "x.*")


def article_sections(articles: DataFrame, id_col: str = "article_id", body_col: str = "body") -> DataFrame:
    """One row per section: id, n from 1 and the section's fields. No shuffle."""
    return _each(articles, id_col, body_col, sections_of, SECTION)


def article_chunks(articles: DataFrame, id_col: str = "article_id", body_col: str = "body") -> DataFrame:
    """One row per chunk: id, n from 1, title, level and byte range. No shuffle."""
    return _each(articles, id_col, body_col, chunks_of, CHUNK)


def toc_chunks_of(body: str, titles: list[str], most: int = 24 * 1024) -> list[dict]:
    """Chunks of a body by a table of contents: each chapter from the line that is its title (a heading's marks don't count) to the next one found.

    Titles are sought in order, each after the one before; fewer than half found gives no chunks, so the caller cuts by headings. Text before
    the first is "(front)"; a chapter over ``most`` bytes is cut between paragraphs.
    """
    raw, at, found = body.encode(), 0, []
    for title in titles:
        want = title.strip()
        m = re.compile(rb"(?m)^(?:#{1,6}[ \t]+)?" + re.escape(want.encode()) + rb"[ \t]*\r?$").search(raw, at) if want else None
        if m:
            found.append((m.start(), want))
            at = m.end()
    if not found or 2 * len(found) < len(titles):
        return []
    if found[0][0] > 0:
        found.insert(0, (0, "(front)"))
    out = []
    for (start, title), end in zip(found, [f[0] for f in found[1:]] + [len(raw)], strict=True):
        parts = _by_paragraphs(raw, start, end, most)
        out += [{"title": title if len(parts) == 1 else f"{title} (part {i}/{len(parts)})", "level": 1, "start": a, "end": b} for i, (a, b) in enumerate(parts, 1)]
    return out


def toc_chunks(articles: DataFrame, id_col: str = "article_id", body_col: str = "body", toc_col: str = "toc") -> DataFrame:
    """One row per chunk of articles with a table of contents (an array of titles); those of which too little is found have none. No shuffle."""
    kind = articles.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [toc_chunks_of(t, [x for x in toc if x]) if t is not None and toc is not None else [] for t, toc in zip(b["t"], b["toc"], strict=True)]
            yield pd.DataFrame({"k": b["k"], "x": made})

    rows = articles.select(F.col(id_col).alias("k"), F.col(body_col).cast("string").alias("t"), F.col(toc_col).alias("toc")).mapInPandas(run, f"k {kind}, x {CHUNK}")
    return rows.select(F.col("k").alias(id_col), F.posexplode("x").alias("n", "x")).select(id_col, (F.col("n") + 1).alias("n"), "x.*")


SIDECAR_VERSION = 1


def write_sidecars(articles: DataFrame, path: str, id_col: str = "rel", body_col: str = "body") -> None:
    """Writes the sections of articles, one row an article, with the version of their form and a digest of the body; articles without
    headings have no row, so theirs from before are gone."""
    sections = article_sections(articles, id_col, body_col)
    rest = [c for c in sections.columns if c not in (id_col, "n")]
    kept = sections.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("n", *rest))).alias("sections"))  # as many as one article has headings
    digests = articles.select(id_col, F.sha2(F.col(body_col), 256).alias("sha")).groupBy(id_col).agg(F.max("sha").alias("sha"))
    kept.join(digests, id_col).withColumn("version", F.lit(SIDECAR_VERSION)).write.mode("overwrite").parquet(path)


def fresh_sidecars(sidecars: DataFrame, articles: DataFrame, id_col: str = "rel", body_col: str = "body") -> DataFrame:
    """Sidecars of this version that are of the body an article has now."""
    now = articles.select(id_col, F.sha2(F.col(body_col), 256).alias("sha")).distinct()
    return sidecars.filter(F.col("version") == SIDECAR_VERSION).join(now, [id_col, "sha"], "left_semi")
