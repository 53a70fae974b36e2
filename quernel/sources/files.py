"""Sources and sinks: Markdown trees with front matter, JSON-lines ledgers by day, queue files, raw rollout lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Folders of a corpus that hold its articles.
ROOTS = ("wiki", "projects", "research", "solutions", "tools", "decisions", "patterns", "ideas", "people", "sessions")
LEDGER = T.StructType(
    [T.StructField(n, k) for n, k in (
        ("entry_ts", T.StringType()), ("provider", T.StringType()), ("model", T.StringType()), ("op", T.StringType()), ("duration_ms", T.LongType()), ("prompt_chars", T.LongType()),
        ("ok", T.BooleanType()), ("err_kind", T.StringType()), ("input_tokens", T.LongType()), ("output_tokens", T.LongType()), ("cache_read_tokens", T.LongType()), ("cost_usd", T.DoubleType()), ("_corrupt_record", T.StringType()),
    )]
)


def _read_hidden(spark: SparkSession, root: str) -> DataFrame:
    """rel and text of Markdown files whose names begin with an underscore, which Spark's own readers pass over.

    Only names are listed on the driver, as Spark does for any folder; the files are read by tasks.
    """
    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    found = [f.path for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.base_name.startswith("_") and f.base_name.endswith(".md")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        disk, _ = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for b in batches:
            for path in b["path"]:
                with disk.open_input_stream(path) as f:
                    yield pd.DataFrame({"rel": [path[len(base) + 1 :]], "text": [f.read().decode("utf-8", "replace")]})

    paths = spark.createDataFrame([(p,) for p in found], "path string").repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism)))
    return paths.mapInPandas(read, "rel string, text string")


def read_articles(spark: SparkSession, root: str, with_underscored: bool = False) -> DataFrame:
    """rel, front, body of each Markdown file under root, split at the front matter; hidden files are left out.

    Files whose names begin with an underscore come only if asked for.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    rel = F.regexp_replace(F.col("_metadata.file_path"), "^.*?\\Q" + root.rstrip("/") + "/\\E", "")
    rows = raw.select(rel.alias("rel"), F.col("value").alias("text"))
    if with_underscored:
        rows = rows.unionByName(_read_hidden(spark, root))
    rows = rows.filter(~F.col("rel").rlike("(^|/)\\."))
    front = F.regexp_extract("text", "(?s)\\A---\\r?\\n(.*?)\\r?\\n---[ \\t]*(?:\\r?\\n|\\z)", 1)
    return rows.select("rel", front.alias("front"), F.regexp_replace("text", "(?s)\\A---\\r?\\n.*?\\r?\\n---[ \\t]*(?:\\r?\\n|\\z)", "").alias("body"))


def front_field(front: str, key: str):  # noqa: ANN201
    """A scalar field of front matter, the last one if a key is repeated, without quotes; empty if it is missing."""
    every = F.regexp_extract_all(F.concat(F.lit("\n"), F.col(front)), F.lit("\\n" + key + ":[ \\t]*([^\\r\\n]*)"), F.lit(1))
    return F.regexp_replace(F.trim(F.coalesce(F.try_element_at(every, F.lit(-1)), F.lit(""))), "^[\"'](.*)[\"']$", "$1")


def front_list(front: str, key: str):  # noqa: ANN201
    """An inline list of front matter ([a, b]) or a scalar as a list of one; empty if it is missing."""
    inner = F.regexp_replace(front_field(front, key), "^\\[(.*)\\]$", "$1")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"'](.*)[\"']$", "$1")), lambda x: x != "")


def read_ledger(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """Ledger lines under root, where each day is a folder day=YYYY-MM-DD; corrupt lines are kept with their text aside.

    A bound on days prunes folders before anything is read.
    """
    rows = spark.read.schema(LEDGER).option("mode", "PERMISSIVE").option("basePath", root).json(root + "/day=*")
    return rows.filter(F.col("day") >= since) if since else rows


def append_ledger(rows: DataFrame, root: str, day: str = "day") -> None:
    """Appends rows to the ledger's day folders."""
    rows.write.mode("append").partitionBy(day).json(root)


def read_queue(spark: SparkSession, root: str) -> DataFrame:
    """Queue files of ``key: value`` lines as maps; the last value of a repeated key stays."""
    raw = spark.read.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    pairs = F.filter(F.transform(F.split("value", "\\r?\\n"), lambda l: F.split(l, ":\\s*", 2)), lambda p: (F.size(p) == 2) & (F.trim(p[0]) != ""))
    keep = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != F.trim(p[0])), F.create_map(F.trim(p[0]), F.trim(p[1]))))
    return raw.select("path", keep.alias("fields"))
