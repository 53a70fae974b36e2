"""Taking in items: links from messages, bookmarks, file inboxes; activity and merges of what comes from several runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernel.functions.text import urls
from quernel.operators.ordering import numbered


def first_of(rows: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row, in order, of each key: the first of keys that isn't blank. Rows without any key stay."""
    key = F.coalesce(*[F.when(F.trim(k.cast("string")) != "", k.cast("string")) for k in keys])
    keyed = rows.withColumn("_k", key)
    with_key = keyed.filter("_k is not null").groupBy("_k").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_x")).select("_x.*")
    return with_key.unionByName(keyed.filter("_k is null").drop("_k"))


def tag_match(tags: Column, wanted: Sequence[str], mode: str = "any") -> Column:
    """Whether tags, trimmed and in lower case, hold any or all of those wanted; nothing wanted is met by all."""
    have = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    want = F.array(*[F.lit(w.strip().lower()) for w in wanted]).cast("array<string>")
    if not wanted:
        return F.lit(True)
    return F.arrays_overlap(have, want) if mode == "any" else F.size(F.array_except(want, have)) == 0


def skipped_address(url: Column, domains: Sequence[str]) -> Column:
    """Whether an address holds one of the texts to skip."""
    return reduce(Column.__or__, [F.coalesce(url.contains(d), F.lit(False)) for d in domains], F.lit(False))


def pull(items: DataFrame, seen: DataFrame, *, id_col: str, url_col: str, order: Sequence[str], skip: Sequence[str] = (), tags: Sequence[str] = (), mode: str = "any", most: int = 0) -> tuple[DataFrame, bool]:
    """New items of a source: not seen before (by id, or else address), none skipped, with the tags wanted, in order.

    seen has one column, key. The second result is whether the source's cursor may move on: not if ``most`` cut items off.
    """
    fresh = first_of(items, [F.col(id_col), F.col(url_col)], order)
    key = F.coalesce(F.when(F.trim(F.col(id_col).cast("string")) != "", F.col(id_col).cast("string")), F.col(url_col))
    fresh = fresh.withColumn("key", key).join(seen.select("key").distinct(), "key", "left_anti").drop("key")
    fresh = fresh.filter(~skipped_address(F.col(url_col), skip))
    if tags:
        fresh = fresh.filter(tag_match(F.col("tags"), tags, mode))
    if not most:
        return fresh, True
    return fresh.orderBy(*order).limit(most), fresh.limit(most + 1).count() <= most


def captured(messages: DataFrame, known: DataFrame, text_col: str = "text", skip: Sequence[str] = (), least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Links and notes from messages: (url, first id) of addresses not in known (url), and the messages without any that are long enough."""
    found = messages.withColumn("urls", urls(F.col(text_col)))
    links = found.select("id", F.explode("urls").alias("url")).filter(~skipped_address(F.col("url"), skip))
    new = links.groupBy("url").agg(F.min("id").alias("id")).join(known.select("url"), "url", "left_anti")
    notes = found.filter((F.size("urls") == 0) & (F.octet_length(F.trim(text_col)) > least) & ~F.col(text_col).startswith("Liked ")).drop("urls")
    return new, notes


def inbox(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    """Files of a folder whose contents aren't known (sha): path, sha, length, one row per content. Hidden and empty files are left out."""
    raw = spark.read.format("binaryFile").load(folder).filter("length > 0")
    files = raw.select("path", F.sha2("content", 256).alias("sha"), "length").filter(~F.col("path").rlike("/\\.[^/]*$"))
    return files.groupBy("sha").agg(F.min("path").alias("path"), F.first("length").alias("length")).join(known.select("sha"), "sha", "left_anti")


def touches(changes: DataFrame, key: str, item: str) -> DataFrame:
    """Different items touched by key, most first; on a tie in order of key."""
    return changes.groupBy(key).agg(F.count_distinct(item).alias("touched")).orderBy(F.desc("touched"), key)


def author_activity(changes: DataFrame) -> DataFrame:
    """Files added and updated by author (author, path, status A or M); one that an author added isn't also updated."""
    by_file = changes.groupBy("author", "path").agg(F.max(F.col("status") == "A").alias("added"), F.max(F.col("status") == "M").alias("changed"))
    return by_file.groupBy("author").agg(F.count_if("added").alias("added"), F.count_if(F.col("changed") & ~F.col("added")).alias("updated"))


def in_all(rows: DataFrame, key: str, of: str, groups: DataFrame) -> DataFrame:
    """Keys that occur with every group of ``groups`` (a table of few rows, column ``of``): relational division."""
    wanted = groups.select(of).distinct()
    return rows.join(wanted, of, "left_semi").groupBy(key).agg(F.count_distinct(of).alias("n")).filter(F.col("n") == wanted.select(F.count("*")).scalar()).select(key)


def merge_runs(entities: DataFrame) -> DataFrame:
    """Entities of several runs (run, pos, label, claims) by trimmed label, in the order first seen; claims are the union in order."""
    rows = entities.select(F.trim("label").alias("label"), "run", "pos", F.explode_outer("claims").alias("claim")).filter("label <> ''")
    at = F.struct("run", "pos")
    first = rows.groupBy("label", F.trim("claim").alias("claim")).agg(F.min(at).alias("at"))
    merged = first.groupBy("label").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.when(F.coalesce("claim", F.lit("")) != "", F.struct("at", "claim")))).alias("c"))
    return merged.select("label", "first", F.transform("c", lambda x: x["claim"]).alias("claims"))


def number_facts(chapters: DataFrame) -> DataFrame:
    """Facts of chapters (chapter, facts array<string>) with ids by chapter and place: c00-f1, c00-f2, c01-f1."""
    return chapters.select("chapter", F.posexplode("facts").alias("k", "fact")).select("chapter", F.format_string("c%02d-f%d", F.col("chapter"), F.col("k") + 1).alias("id"), "fact")


def group_index(articles: DataFrame, folder_of: Column, title: str) -> DataFrame:
    """Titles by folder, in order: the index of a corpus. A title is one row, so that a folder may hold any number."""
    return numbered(articles.select(folder_of.alias("folder"), F.col(title)).distinct(), ["folder"], [title], "place")
