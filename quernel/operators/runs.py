"""Ledgers of runs and logs of sessions: when what last went well or wrong, histories, statistics, merges of two versions, queues of what waits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

FINE = ("ok", "degraded")


def provider_of(model: Column) -> Column:
    """What stands before the first slash of a model's name; anthropic if none does."""
    return F.when(F.instr(model, "/") > 1, F.substring_index(model, "/", 1)).otherwise("anthropic")


def run_record(rows: DataFrame, error: str = "error", most: int = 500) -> DataFrame:
    """Rows of a run ledger with secrets in addresses masked (user names, query values) and then errors cut to so many characters."""
    bare = F.regexp_replace(F.regexp_replace(F.col(error), "(\\w+://)[^\\s/@]+@", "$1***@"), "([?&][\\w.-]+=)[^\\s&#]+", "$1***")
    return rows.withColumn(error, F.substring(bare, 1, most))


def error_records(rows: DataFrame, kind: str = "err_kind") -> DataFrame:
    """Failed rows to append to an error ledger; rate limits aren't errors."""
    return rows.filter(F.col(kind).isNotNull() & (F.col(kind) != "rate_limit"))


def last_ok(runs: DataFrame) -> DataFrame:
    """key, at: when each command, and each command with each of its flags (--x), last ended well; degraded runs count.

    runs has command, status, at and args (an array); rows without command or time are left out.
    """
    fine = runs.filter(F.col("status").isin(*FINE) & (F.col("command") != "") & F.col("at").isNotNull())
    flags = F.transform(F.filter(F.coalesce("args", F.array().cast("array<string>")), lambda a: a.startswith("--")), lambda a: F.concat_ws(" ", F.col("command"), a))
    return fine.select("at", F.explode(F.concat(F.array("command"), flags)).alias("key")).groupBy("key").agg(F.max("at").alias("at"))


def last_errors(runs: DataFrame, since: Column | None = None) -> DataFrame:
    """command, at, error, args of the newest failed or degraded run of each command; a degraded one says which phases failed.

    runs has command, status, at, error, args, degraded (an array of phases) and degraded_errors (a map); of runs at one time the one with the larger error stays.
    """
    bad = runs.filter(F.col("status").isin("error", "degraded") & (F.col("command") != "") & F.col("at").isNotNull())
    if since is not None:
        bad = bad.filter(F.col("at") >= since)
    phases = F.coalesce("degraded", F.array().cast("array<string>"))
    why = F.try_element_at(F.col("degraded_errors"), F.get(phases, F.lit(0)))
    partial = F.when(F.size(phases) == 0, "partial failure (phases not recorded)").otherwise(F.concat(F.lit("partial failure in "), F.array_join(phases, ", "), F.when(why != "", F.concat(F.lit(": "), why)).otherwise("")))
    told = bad.withColumn("error", F.when(F.col("status") == "degraded", partial).otherwise(F.col("error")))
    return told.groupBy("command").agg(F.max_by(F.struct("at", "error", "args"), F.struct("at", "error")).alias("x")).select("command", "x.*")


def run_history(runs: DataFrame, command: str, flag: str, mode: str) -> DataFrame:
    """One row: when a command last ran in full (without the flag), and in its mode (with it, if it stayed in that mode)."""
    mine = runs.filter(F.col("status").isin(*FINE) & (F.col("command") == command))
    flagged = F.array_contains(F.coalesce("args", F.array().cast("array<string>")), flag)
    return mine.agg(F.max(F.when(~flagged, F.col("at"))).alias("last_full"), F.max(F.when(flagged & (F.col("mode") == mode), F.col("at"))).alias("last_mode"))


def busiest(counts: DataFrame, key: str, n: str, least: int = 1) -> DataFrame:
    """The key with the largest count, if it is at least so large; of several the first by name: an arg-max without a sort."""
    top = counts.filter(F.col(n) >= least).agg(F.min_by(F.struct(key, n), F.struct((-F.col(n)).alias("n"), F.col(key).alias("k"))).alias("x"))
    return top.filter("x is not null").select("x.*")


def log_stats(log: DataFrame) -> DataFrame:
    """kind (all, project, day), key, extracted, skipped, first, last of a sessions log (project, extracted_at, skipped): in one pass of grouping sets."""
    rows = log.select(F.when(~F.col("skipped"), F.col("project")).alias("project"), F.when(~F.col("skipped"), F.substring("extracted_at", 1, 10)).alias("day"), "skipped", F.when(~F.col("skipped"), F.col("extracted_at")).alias("at"))
    sets = rows.groupingSets([[], ["project"], ["day"]], "project", "day").agg(
        F.grouping_id().alias("g"), F.count_if(~F.col("skipped")).alias("extracted"), F.count_if("skipped").alias("skipped"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "project").otherwise("day")
    return sets.select(kind.alias("kind"), F.coalesce("project", "day", F.lit("")).alias("key"), "extracted", "skipped", "first", "last").filter("kind = 'all' or key <> ''")


def text_score(text: Column, keywords: Mapping[str, Sequence[str]], weights: Mapping[str, int]) -> Column:
    """Weighted sum over categories, each counted once if any of its keywords stands in the text, whatever the case; also within words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda ks: reduce(Column.__or__, [low.contains(k.lower()) for k in ks], F.lit(False))
    return reduce(Column.__add__, [F.when(hit(ks), weights.get(c, 0)).otherwise(0) for c, ks in keywords.items()], F.lit(0))


def first_listed(lists: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several lists by key, each from the first list that has it (pending before triaged, say); of several rows there the smallest."""
    cols = lists[0].columns
    both = reduce(DataFrame.unionByName, [x.select(*cols).withColumn("_l", F.lit(i)) for i, x in enumerate(lists)])
    return both.groupBy(key).agg(F.min(F.struct("_l", *[c for c in cols if c != key])).alias("x")).select(key, *[f"x.{c}" for c in cols if c != key]).select(*cols)


def backfilled(rows: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with a value that is missing or not above 0 looked up in known (key, value); what isn't there stays."""
    look = known.groupBy(key).agg(F.max(value).alias("_v"))
    missing = F.col(value).isNull() | (F.col(value) <= 0)
    joined = rows.join(look, key, "left")
    return joined.select(*[F.when(missing, F.coalesce("_v", value)).otherwise(F.col(value)).alias(value) if c == value else F.col(c) for c in rows.columns])


def merge_logs(ours: DataFrame, theirs: DataFrame, key: str, stamp: str) -> DataFrame:
    """Two versions of a sessions log by key: the entry with the later stamp, ours on a tie and where neither has one.

    Stamps are compared as instants if both can be read, else as text.
    """
    rest = [c for c in ours.columns if c != key]
    a, b = ours.groupBy(key).agg(F.max(F.struct(stamp, *[c for c in rest if c != stamp])).alias("a")), theirs.groupBy(key).agg(F.max(F.struct(stamp, *[c for c in rest if c != stamp])).alias("b"))
    j = a.join(b, key, "full_outer")
    x, y = F.col(f"a.{stamp}").cast("string"), F.col(f"b.{stamp}").cast("string")
    tx, ty = x.try_cast("timestamp"), y.try_cast("timestamp")
    later = F.when(tx.isNotNull() & ty.isNotNull(), ty > tx).otherwise(F.coalesce(y, F.lit("")) > F.coalesce(x, F.lit("")))
    return j.withColumn("x", F.when(F.col("a").isNull() | (F.col("b").isNotNull() & later), F.col("b")).otherwise(F.col("a"))).select(key, *[f"x.{c}" for c in rest])


def merge_lease(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """A lease of two versions: ours unless it is empty."""
    return ours.unionByName(theirs.join(ours.limit(1).select(F.lit(1).alias("_there")), F.lit(True), "left_anti"))


def kept_anyway(skipped: DataFrame, verdicts: DataFrame, key: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """A log of skipped sessions in two: those that stay skipped, and those whose verdict now is keep, which leave it."""
    keep = verdicts.filter("verdict = 'keep'").select(key).distinct()
    return skipped.join(keep, key, "left_anti"), skipped.join(keep, key, "left_semi")


def drained(pending: DataFrame, order: str, key: str = "session_id") -> DataFrame:
    """Entries of a pending queue, each key once by its first entry: what is read twice after a failure counts once."""
    rest = [c for c in pending.columns if c != key]
    return pending.filter(F.coalesce(F.trim(key), F.lit("")) != "").groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("x")).select(key, *[f"x.{c}" for c in rest])


def to_extract(projects: DataFrame, peers: DataFrame) -> DataFrame:
    """Projects (path, sha, last_sha, newest_file, extracted_at) that need extraction: never done, another sha, or newer files; not those whose
    current sha a peer's ledger (path, sha) has already."""
    never = F.coalesce(F.col("extracted_at"), F.lit("")) == ""
    changed = (F.coalesce("sha", F.lit("")) != "") & ~F.col("sha").eqNullSafe(F.col("last_sha"))
    newer = F.coalesce(F.col("newest_file") > F.col("extracted_at"), F.lit(False))
    why = F.when(never, "new").when(changed, "changed").when(newer, "newer")
    done = peers.select("path", "sha").distinct()
    return projects.withColumn("why", why).filter("why is not null").join(done, ["path", "sha"], "left_anti")


def to_contextualise(raw: DataFrame, log: DataFrame, marker: str, key: str = "name", body: str = "body") -> DataFrame:
    """Raw items that neither the log names nor bear the marker: doing the work twice adds nothing."""
    return raw.filter(~F.coalesce(F.col(body).contains(marker), F.lit(False))).join(log.select(key).distinct(), key, "left_anti")


def worth_queueing(sessions: DataFrame, processed: DataFrame, pending: DataFrame, score: str = "score", least_messages: int = 10, least_score: int = 50, most: int = 20) -> DataFrame:
    """Sessions of a micro-batch to enqueue: enough messages, no boilerplate, the newest so many (the watcher's own limit), neither processed by
    all nor pending, with enough score. processed and pending have session_id."""
    fit = sessions.filter((F.col("message_count") >= least_messages) & ~F.coalesce(F.col("summary").startswith("You are working in"), F.lit(False)))
    newest = fit.orderBy(F.col("updated_at").desc_nulls_last(), "session_id").limit(most)
    return newest.join(processed.select("session_id"), "session_id", "left_anti").join(pending.select("session_id"), "session_id", "left_anti").filter(F.col(score) >= least_score)
