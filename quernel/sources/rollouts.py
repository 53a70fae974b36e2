"""Rollout files of agents (JSON lines, a folder per day): their first line, the newest of each working directory, those since a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

META = "struct<id:string,cwd:string,originator:string,source:string,model_provider:string,timestamp:string,git:struct<branch:string,commit_hash:string,repository_url:string>>"
MOST = 1 << 20  # a first line longer than this is none


def session_meta(line: Column) -> Column:
    """What a rollout's first line says, null unless it is a session_meta with valid JSON of at most a megabyte."""
    read = F.when(F.octet_length(line) <= MOST, F.try_parse_json(line))
    kind = F.try_variant_get(read, "$.type", "string")
    return F.when(kind == "session_meta", F.from_json(F.to_json(F.try_variant_get(read, "$.payload", "variant")), META))


def read_rollouts(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """path, modified and meta of the rollout files under root; with since, only files modified at or after it.

    Files are pruned by their modification time before they are opened, and of each only its first line is kept. Files that begin with
    no session_meta are left out.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    if since is not None:
        reader = reader.option("modifiedAfter", since)
    lines = reader.text(root).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    first = lines.filter("start = 0").groupBy("path", "modified").agg(F.min_by("value", "n").alias("line"))
    return first.withColumn("meta", session_meta(F.col("line"))).filter("meta is not null").select("path", "modified", "meta")


def newest_of_each(rollouts: DataFrame, key: str = "meta.cwd") -> DataFrame:
    """The newest rollout of each working directory: by time, then by path. Those without a directory are left out."""
    named = rollouts.withColumn("_k", F.col(key)).filter("_k <> ''")
    return named.groupBy("_k").agg(F.max_by(F.struct(*rollouts.columns), F.struct("modified", "path")).alias("x")).select("x.*")
