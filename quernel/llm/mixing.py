"""Mixes sources so that each has its share of all tokens.

Systematic sampling: each document of a source has the same expected number of copies; the documents stand in order of
size, the prefix sum of expected copies runs through it from one random offset per source, and a document is emitted once for
each whole number its step crosses. A document thus comes out the expected number rounded down or up, never more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quernel.functions.times import tidy
from quernel.llm.tokens import TOKENIZER, count_tokens
from quernel.session import checkpointed

ROWS_A_BUCKET = 50_000
FEW = 100_000  # short rows up to this number are sent to every executor, more are joined


def _sent(rows: DataFrame) -> DataFrame:
    """Short rows, marked to be sent to every executor if they are few."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix (id, source, copy_no from 1, tokens) and its report by source.

    Sources are compared trimmed and in lower case. Without total_tokens the mix is as large as it can be with every source
    that has text at its share. With a larger total, a source that falls short gives its documents max_repeats times each and
    the report shows by how much. The report has source, target_share, max_repeats, available_documents, available_tokens, largest_tokens (of a document),
    copies (expected per document), documents (rows emitted), tokens and reached_share (of the tokens emitted).

    Defined results: documents of other sources or null ones, and texts without tokens, are left out; a source without text
    is reported with zeros; several rows of a target add up, with the least max_repeats (null: 1); repeated
    rows are documents of their own.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    norm = lambda c: F.lower(tidy(F.col(c)))
    wanted = targets.select(norm("source").alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)), F.lit(0)).alias("max_repeats"))
    wanted = wanted.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "source": b["source"], "tokens": [count_tokens(t, tokenizer) for t in b["t"]]})

    rows = documents.select(F.col(id_col).alias("k"), norm(source_col).alias("source"), F.col(text_col).cast("string").alias("t")).join(_sent(wanted.select("source")), "source", "left_semi").select("k", "source", "t")
    sized = checkpointed(rows.mapInPandas(count, f"k {kind}, source string, tokens bigint").filter("tokens > 0"))
    have = sized.groupBy("source").agg(F.count("*").alias("available_documents"), F.sum("tokens").alias("available_tokens"), F.max("tokens").alias("largest_tokens"))
    plan = checkpointed(wanted.join(have, "source", "left").fillna(0, ["available_documents", "available_tokens", "largest_tokens"]))  # a row per target
    if total_tokens is None:
        can = F.col("available_tokens") * F.col("max_repeats") / F.col("target_share")
        total_tokens = plan.filter("available_tokens > 0 and max_repeats > 0 and target_share > 0").agg(F.min(can)).first()[0] or 0
    copies = F.when((F.col("available_tokens") > 0) & (F.col("target_share") > 0), F.least(F.col("max_repeats").cast("double"), F.lit(float(total_tokens)) * F.col("target_share") / F.col("available_tokens"))).otherwise(0.0)
    plan = plan.withColumn("copies", copies).withColumn("offset", F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / float(1 << 30))

    # ranks by size, source by source: along sizes, any stretch of copies holds small and large documents in proportion, so
    # the tokens come out near their expectation. They are counted in classes of like sizes, large ones cut by a hash into buckets of a bounded
    # number of rows; the prefix sum runs over a source's classes first (a few hundred rows), then over each class's buckets.
    size = F.floor(F.log2("tokens") * 16).cast("int")
    classes = sized.groupBy("source", size.alias("size")).agg(F.count("*").alias("n"))
    over = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    cuts = F.ceil(F.col("n") / ROWS_A_BUCKET).cast("int")
    classes = checkpointed(classes.select("source", "size", cuts.alias("cuts"), F.coalesce(F.sum("n").over(over("source", "size")), F.lit(0)).alias("base")))
    h = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    placed = sized.withColumn("h", h).withColumn("size", size).join(_sent(classes), ["source", "size"])
    placed = checkpointed(placed.withColumn("cut", F.pmod(F.shiftright("h", 8), F.col("cuts")).cast("int")).drop("cuts"))
    buckets = placed.groupBy("source", "size", "cut", "base").agg(F.count("*").alias("n"))
    shifts = checkpointed(buckets.select("source", "size", "cut", (F.col("base") + F.coalesce(F.sum("n").over(over("source", "size", "cut")), F.lit(0))).alias("shift")))
    inner = F.row_number().over(Window.partitionBy("source", "size", "cut").orderBy("tokens", "h"))
    ranked = placed.withColumn("r", inner).join(_sent(shifts), ["source", "size", "cut"]).join(_sent(plan.select("source", "copies", "offset")), "source")
    rank = F.col("r") + F.col("shift")
    emitted = F.floor(rank * F.col("copies") + F.col("offset")) - F.floor((rank - 1) * F.col("copies") + F.col("offset"))
    mix = ranked.withColumn("times", emitted.cast("int")).filter("times > 0").select(F.col("k").alias(id_col), "source", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_no"), "tokens")
    got = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy())  # a row per target
    report = plan.drop("offset").join(got, "source", "left").fillna(0, ["documents", "tokens"]).withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), whole), F.lit(0.0)))
    return mix, report
