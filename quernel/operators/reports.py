"""Reports as frames: the hot cache, a digest, checks of a corpus's state; promotion of pages to another corpus; messages to oneself."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernel.functions.frontmatter import with_field
from quernel.functions.text import WIKILINK, without_code


def top_of(rows: DataFrame, section: str, key: Column, at: Column, text: Column, most: int, since: str | None = None) -> DataFrame:
    """section, place, key, at, text: the newest row of each key, of these the newest so many: one section of a report, cut at its own limit."""
    kept = rows.select(key.alias("key"), at.cast("string").alias("at"), text.cast("string").alias("text")).filter("key is not null and at is not null")
    if since is not None:
        kept = kept.filter(F.col("at") >= since)
    newest = kept.groupBy("key").agg(F.max_by(F.struct("at", "text"), F.struct("at", "text")).alias("x")).select("key", "x.*").orderBy(F.desc("at"), "key").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("at"), "key"))  # the section's limit bounds it
    return newest.select(F.lit(section).alias("section"), place.alias("place"), "key", "at", "text")


def report(*sections: DataFrame) -> DataFrame:
    """Sections of a report under each other."""
    return reduce(DataFrame.unionByName, sections)


def figures(**counts: DataFrame) -> DataFrame:
    """One row of figures: how many rows each of the given frames has. Each is counted where it lies; only the counts meet."""
    one = [df.agg(F.count("*").alias(name)) for name, df in counts.items()]
    return reduce(lambda a, b: a.join(b, F.lit(True)), one)  # a row each


def checks(figures: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """name, n, status: figures (one row) against the largest number that is still fine."""
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("bigint").alias("n"), F.when(F.col(k) <= b, "ok").otherwise("warn").alias("status")) for k, b in bounds.items()])
    return figures.select(F.explode(each).alias("x")).select("x.*")


def windows_row(windows: DataFrame, days: str, values: Sequence[str]) -> DataFrame:
    """Rows of windows (days and values) as one row of fields, named value_days, by days given as numbers: windows are few and known."""
    kept = windows.select(days, *values)
    names = [r[0] for r in kept.select(days).distinct().orderBy(days).limit(100).collect()]
    return kept.agg(*[F.max(F.when(F.col(days) == d, F.col(v))).alias(f"{v}_{d}d") for d in names for v in values])


def proposal_items(body: Column, flat: Column) -> Column:
    """How many proposals a file holds: its list items if it is a flat list, else its level-3 headings."""
    lines = F.split(F.coalesce(body, F.lit("")), "\\n")
    return F.when(flat, F.size(F.filter(lines, lambda x: F.trim(x).startswith("- ")))).otherwise(F.size(F.filter(lines, lambda x: x.startswith("### "))))


def link_diff(articles: DataFrame, body: str = "body", page: str = "rel") -> DataFrame:
    """page, target, naive, real: links that a scan of the whole text finds and those outside code, where the two differ."""
    found = lambda c: F.regexp_extract_all(c, F.lit(WIKILINK), F.lit(1))
    each = articles.select(F.col(page).alias("page"), F.explode(F.concat(F.transform(found(F.col(body)), lambda x: F.struct(x.alias("t"), F.lit(1).alias("naive"), F.lit(0).alias("real"))), F.transform(found(without_code(F.col(body))), lambda x: F.struct(x.alias("t"), F.lit(0).alias("naive"), F.lit(1).alias("real"))))).alias("x"))
    sums = each.groupBy("page", F.trim("x.t").alias("target")).agg(F.sum("x.naive").alias("naive"), F.sum("x.real").alias("real"))
    return sums.filter("naive <> real")


def raw_tier(override: Column, via: Column, tier: Column) -> Column:
    """Index tier of a raw page: a valid override, else stub for stubs, brief for short posts, else the tier of its text."""
    v, o = F.lower(F.trim(via)), F.trim(override)
    return F.when(o.isin("stub", "brief", "standard", "deep"), o).when(v == "stub", "stub").when(v == "fxtwitter", "brief").otherwise(tier)


def promoted(pages: DataFrame, source: str, at: str, path: str = "rel", text: str = "text") -> DataFrame:
    """Pages as they go to another corpus: with where they come from and when in their front matter; those whose name begins with an underscore don't."""
    marked = with_field(with_field(F.col(text), "promoted_from", F.concat_ws(":", F.lit(source), F.col(path))), "promoted_at", F.lit(at))
    return pages.filter(~F.col(path).rlike("(^|/)_[^/]*$")).withColumn(text, marked)


def missing_in_target(edges: DataFrame, titles: DataFrame) -> DataFrame:
    """src, dst: links of promoted pages whose target has no page in the corpus they go to (titles: title)."""
    return edges.join(titles.select(F.col("title").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


def messages_to_self(messages: DataFrame, chats: DataFrame, handles: DataFrame, own: Sequence[str], since: Column) -> DataFrame:
    """Messages after a time in chats with one's own handles, each once: messages (id, chat, at, ...), chats (chat, handle), handles (handle, address).

    A chat of several such handles gives its messages once.
    """
    mine = handles.filter(F.col("address").isin(list(own))).select("handle")
    wanted = chats.join(mine, "handle", "left_semi").select("chat").distinct()
    return messages.filter(F.col("at") > since).join(wanted, "chat", "left_semi").select(*messages.columns).distinct()


def approved_sessions(sessions: DataFrame, projects: DataFrame, since: Column | None = None, path: str = "project_path") -> DataFrame:
    """Sessions of approved projects (path, status; a missing status is approved), from a time on if it is given."""
    good = projects.filter(F.coalesce("status", F.lit("approved")) == "approved").select(F.col("path").alias(path)).distinct()
    rows = sessions if since is None else sessions.filter(F.col("updated_at") >= since)
    return rows.join(good, path, "left_semi").select(*sessions.columns)


def batch_outcomes(changes: DataFrame, batch: str = "batch", path: str = "path") -> DataFrame:
    """Of each batch how many different files it touched, and the lines added and deleted."""
    return changes.groupBy(batch).agg(F.count_distinct(path).alias("files"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"))
