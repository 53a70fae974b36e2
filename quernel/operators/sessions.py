"""Sessions and their messages: statistics, keyword scores, neighbours in time, first-before funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernel.functions.markup import head_and_tail
from quernel.functions.text import word_count
from quernel.functions.times import instant_micros, tidy
from quernel.operators.ordering import numbered
from quernel.session import checkpointed


def session_stats(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """For every session: users' messages, characters of text and the largest sequence; zeros where there is no message."""
    m = messages.groupBy(F.col("session_id").alias("id")).agg(
        F.count_if(F.lower(tidy(F.col("type"))) == "user").alias("user_messages"), F.coalesce(F.sum(F.length("text_content")), F.lit(0)).alias("chars"), F.max(F.coalesce("sequence", F.lit(0))).alias("last_sequence")
    )
    joined = sessions.select("id", "session_id").join(m, "id", "left")
    return joined.select("session_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("user_messages", "chars", "last_sequence")])


def session_verdict(stats: DataFrame) -> DataFrame:
    """empty without a user's message or under 500 characters, thin under 3 and 2,000, else keep."""
    v = F.when((F.col("user_messages") < 1) | (F.col("chars") < 500), "empty").when((F.col("user_messages") < 3) & (F.col("chars") < 2000), "thin").otherwise("keep")
    return stats.withColumn("verdict", v)


def _any_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether any term, a word or phrase, stands in the text as whole words; one pass over the text for all terms."""
    alternatives = "|".join("\\Q" + t.lower() + "\\E" for t in terms)
    return F.lower(text).rlike("(?<![\\p{L}\\p{N}])(?:" + alternatives + ")(?![\\p{L}\\p{N}])")


def keyword_scores(sessions: DataFrame, messages: DataFrame, categories: Mapping[str, Sequence[str]], weights: Mapping[str, int], least_messages: int = 6) -> DataFrame:
    """Sessions with a hit: hits by category and their weighted sum; a hit is one matching message, whatever it repeats.

    All categories come from one conditional aggregate over the messages instead of a scan and a join for each.
    """
    hits = messages.groupBy(F.col("session_id").alias("id")).agg(*[F.count_if(_any_term(F.col("text_content"), t)).alias(c) for c, t in categories.items()])
    known = sessions.filter((F.col("message_count") >= least_messages) & ~F.coalesce(F.col("summary").startswith("You are working in"), F.lit(False))).select("id", "session_id", "message_count")
    score = reduce(Column.__add__, [F.col(c) * weights[c] for c in categories])
    return known.join(hits, "id").withColumn("score", score).filter("score > 0").select("session_id", "message_count", *categories, "score")


def score_histogram(scores: DataFrame, edges: Sequence[int] = (50, 20, 10, 5)) -> DataFrame:
    """Sessions by band of score: count, sum and average, highest band first."""
    band = reduce(lambda c, e: c.when(F.col("score") >= e, e), edges[1:], F.when(F.col("score") >= edges[0], edges[0])).otherwise(0)
    return scores.groupBy(band.alias("band")).agg(F.count("*").alias("sessions"), F.sum("score").alias("total"), F.avg("score").alias("mean"))


def related_sessions(sessions: DataFrame, window_days: int = 7, most: int = 5) -> DataFrame:
    """For each session, up to so many others of its project updated within so many days, newest first.

    A band join that meets no more than most + 1 rows a session, however many the project has: a project's sessions are numbered in order of time,
    each session learns the number of the last one before its band ends, and looks up that number and those next below it. Numbers come
    from hours of a project, joined up by a prefix sum over one row per hour.
    """
    width = window_days * 86_400_000_000
    timed = sessions.select("session_id", "project_path", instant_micros(F.col("updated_at")).alias("at")).filter("at is not null and project_path is not null and session_id is not null")
    timed = checkpointed(timed)
    held = timed.select("project_path", "session_id", "at", F.col("at").alias("t"), F.lit(1).alias("held"))
    looks = timed.select("project_path", "session_id", "at", (F.col("at") + F.lit(width)).alias("t"), F.lit(0).alias("held"))
    hour = F.floor(F.col("t") / F.lit(3_600_000_000))
    both = held.unionByName(looks).withColumn("hour", hour)
    order = [F.col("t"), F.col("held"), F.col("session_id").desc()]  # a band ends before what lies on its end; of equal times the smaller name is newer
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy("project_path", "hour").agg(F.sum("held").alias("n")).select("project_path", "hour", F.coalesce(F.sum("n").over(before(Window.partitionBy("project_path").orderBy("hour"))), F.lit(0)).alias("base"))
    own = F.sum("held").over(Window.partitionBy("project_path", "hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = checkpointed(both.withColumn("own", own).join(sums, ["project_path", "hour"]).select("project_path", "session_id", "at", "held", (F.col("own") + F.col("base")).alias("no")))
    wanted = placed.filter("held = 0").select("project_path", "session_id", "at", F.explode(F.sequence(F.greatest(F.col("no") - most, F.lit(1)), F.col("no"))).alias("no")).filter("no > 0")
    others = placed.filter("held = 1").select("project_path", F.col("session_id").alias("other"), F.col("at").alias("other_at"), "no")
    near = wanted.join(others, ["project_path", "no"]).filter((F.col("session_id") != F.col("other")) & (F.abs(F.col("at") - F.col("other_at")) < width))
    w = Window.partitionBy("session_id").orderBy(F.col("other_at").desc(), "other")  # most + 1 rows at most
    return near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("session_id", "other", "place")


def first_before(messages: DataFrame, first: Column, second: Column, most_sequence: int = 300) -> DataFrame:
    """session, has_second and first_leads: whether a first event comes before the first second event among the assistant's messages.

    Positions are compared as (sequence, id), so no rows are numbered and no session is gathered. By the funnel's definition rows of a
    larger sequence than ``most_sequence`` don't count: what comes later is left out, in both events.
    """
    rows = messages.filter((F.lower(tidy(F.col("type"))) == "assistant") & (F.coalesce("sequence", F.lit(0)) <= most_sequence))
    at = F.struct(F.coalesce("sequence", F.lit(0)).alias("s"), F.col("id").alias("i"))
    g = rows.groupBy(F.col("session_id").alias("session")).agg(F.min(F.when(first, at)).alias("f"), F.min(F.when(second, at)).alias("d"))
    return g.select("session", F.col("d").isNotNull().alias("has_second"), F.coalesce(F.col("f") < F.col("d"), F.lit(False)).alias("first_leads"))


def transcript_turns(sessions: DataFrame, messages: DataFrame, most: int = 1200, keep: int = 600) -> DataFrame:
    """session_id, turn, role, text: the turns of each session in order, blank ones left out.

    What was said stays whole. A message without text gives its content (tool use and results), of which more than ``most`` characters
    become the first and last ``keep``; lengths are in characters, so none is broken.
    """
    tool = F.when(F.coalesce("text_content", F.lit("")) == "", head_and_tail(tidy(F.col("content")), most, keep))
    said = messages.select(F.col("session_id").alias("sid"), F.col("id").alias("mid"), F.coalesce("sequence", F.lit(0)).alias("at"), F.lower(F.trim("type")).alias("role"), F.coalesce(tool, "text_content").alias("text"))
    rows = said.filter(word_count(F.col("text")) > 0).join(sessions.select("id", "session_id"), F.col("sid") == F.col("id"))
    return numbered(rows.select("id", "session_id", "at", "mid", "role", "text"), ["id"], ["at", "mid"], "turn").select("session_id", "turn", "role", "text")
