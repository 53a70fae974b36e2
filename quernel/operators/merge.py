"""Keyed merges of two versions of a table, set unions with order, and decisions against a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def newest_wins(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """Union of keys; of two rows of a key the one with the later stamp, ours on a tie. Null stamps are earliest."""
    rest = [c for c in ours.columns if c not in keys]
    both = ours.withColumn("_ours", F.lit(1)).unionByName(theirs.withColumn("_ours", F.lit(0)))
    order = F.struct(F.col(stamp).isNotNull(), F.col(stamp), F.col("_ours"))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def line_union(ours: DataFrame, theirs: DataFrame, line: str = "line") -> DataFrame:
    """All lines of ours, then those of theirs that ours has not; theirs' own repeats stay."""
    new = theirs.join(ours.select(line).distinct(), line, "left_anti")
    return ours.select(F.lit(0).alias("side"), line).unionByName(new.select(F.lit(1).alias("side"), line))


def first_observed(current: DataFrame, prior: DataFrame, keys: Sequence[str], as_of: str) -> DataFrame:
    """Current rows with first_observed kept from the prior ledger and last_seen now; rows that vanished drop out."""
    return current.join(prior.select(*keys, "first_observed"), list(keys), "left").withColumns({"first_observed": F.coalesce("first_observed", F.lit(as_of)), "last_seen": F.lit(as_of)})


def absorb_decision(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """name, decision for incoming (name, sha) against a log (name, sha).

    skip_same: logged under its name with this sha or none; refresh: under its name with another; skip_dup: this sha under
    another name; else run.
    """
    by_name = log.groupBy("name").agg(F.max(F.struct(F.lit(True).alias("there"), "sha")).alias("n"))
    by_sha = log.filter(F.coalesce("sha", F.lit("")) != "").groupBy("sha").agg(F.lit(True).alias("known"))
    j = incoming.select("name", "sha").join(by_name, "name", "left").join(by_sha, "sha", "left")
    stored = F.coalesce("n.sha", F.lit(""))
    d = F.when(F.col("n.there") & ((stored == "") | (stored == F.col("sha"))), "skip_same").when(F.col("n.there"), "refresh").when(F.col("known"), "skip_dup").otherwise("run")
    return j.select("name", d.alias("decision"))


def apply_changes(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Pages (path, body) after an ordered log of changes (path, seq, action, heading, body).

    create replaces nothing that exists, append adds to the end (and creates a page that is missing), replace_section
    replaces the text under a level-2 heading. A page's changes are folded in order in one row; a change that can't be applied is
    skipped and counted in ``failed``.
    """
    step = F.struct("seq", "action", "heading", "body")
    log = changes.groupBy("path").agg(F.array_sort(F.collect_list(step)).alias("log"))
    start = F.struct(F.col("page"), F.lit(0).alias("failed"))

    def apply(acc, c):  # noqa: ANN001, ANN202
        page = acc["page"]
        padded = F.concat(F.lit("\n"), page, F.lit("\n"))
        head = F.concat(F.lit("\n## "), c["heading"], F.lit("\n"))
        at = F.call_function("locate", head, padded)
        tail = F.call_function("substring", padded, at + F.length(head))
        nxt = F.call_function("locate", F.lit("\n## "), F.concat(F.lit("\n"), tail))
        rest = F.when(nxt > 0, F.call_function("substring", tail, nxt)).otherwise(F.lit(""))
        replaced = F.trim(F.concat(F.call_function("substring", padded, F.lit(1), at + F.length(head) - 1), c["body"], F.lit("\n"), rest))
        new = (
            F.when((c["action"] == "create") & page.isNull(), c["body"])
            .when(c["action"] == "append", F.concat_ws("\n", page, c["body"]))
            .when((c["action"] == "replace_section") & page.isNotNull() & (at > 0), replaced)
        )
        return F.struct(F.coalesce(new, page).alias("page"), (acc["failed"] + F.when(new.isNull(), 1).otherwise(0)).alias("failed"))

    joined = log.join(pages.select("path", F.col("body").alias("page")), "path", "full_outer")
    done = F.when(F.col("log").isNull(), start).otherwise(F.aggregate("log", start, apply))
    return joined.select("path", done.alias("x")).select("path", F.col("x.page").alias("body"), F.col("x.failed").alias("failed"))
