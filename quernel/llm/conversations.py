"""Ordered conversations with a speaker for each turn, rebuilt from message rows, and those to drop.

Rows come from two layouts, both brought to the same lines first: messages of sessions, and raw lines of rollouts whose
payload is JSON. A conversation is a channel (session or rollout), sorted by its own order; where rows bear no such
channel, ``split_at_gaps`` makes one from participants and inactivity gaps.

Conversations may be of any length, so none is gathered: order is looked at within blocks of a thousand numbers, each
block is reduced to its first and last speaker and whether a user's turn in it is followed by another user's, and a second
pass over the blocks' rows joins them up. All else is counts, taken partly before the shuffle.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quernel.functions.times import BLANKS, instant_micros, tidy
from quernel.session import checkpointed

SPEAKERS = ("user", "assistant")
BLOCK = 1_000
ENVIRONMENT = re.compile(r"<environment_context>.*?(?:</environment_context>|\Z)", re.S)
ENVIRONMENT_ANY = r"(?s)<environment_context>.*?(?:</environment_context>|\z)"
PARTS = ("input_text", "output_text")


def _speaks(role: Column, text: Column) -> Column:
    return role.isin(*SPEAKERS) & F.coalesce(tidy(text) != "", F.lit(False))


def session_lines(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Lines of the sessions: conv_id, number (sequence, null as 0), tie (id), role, text, speaks.

    Rows alike in all but id are one, the first; messages without a session are left out. A session whose session_id is
    null is none.
    """
    rows = messages.select(
        F.col("session_id").alias("session"), F.col("id").alias("tie"), F.col("type"), F.col("text_content").alias("text"), F.col("content"),
        F.coalesce(F.col("sequence").cast("bigint"), F.lit(0).cast("bigint")).alias("number"),
    )
    known = sessions.filter(F.col("session_id").isNotNull() & F.col("id").isNotNull()).select(F.col("id").alias("session"), F.col("session_id").alias("conv_id")).distinct()
    same = F.sha2(F.to_json(F.struct("type", "text", "content"), {"ignoreNullFields": "false"}), 256)
    once = rows.filter(F.col("session").isNotNull()).groupBy("session", "number", same.alias("same")).agg(F.min(F.struct("tie", "type", "text")).alias("x"))
    role = F.lower(tidy(F.col("x.type")))
    return once.join(known, "session").select("conv_id", "number", "x.tie", role.alias("role"), "x.text", _speaks(role, F.col("x.text")).alias("speaks"))


def _payload(raw: str | None) -> tuple[bool, str | None, str | None, str | None, str | None]:
    """Whether a payload is valid JSON; its type, role, turn_id and, of a message, the text without environment blocks."""
    try:
        x = json.loads(raw)
    except (ValueError, TypeError, RecursionError):
        return False, None, None, None, None
    if not isinstance(x, dict):
        return True, None, None, None, None
    word = lambda v: v if isinstance(v, str) else None
    text = None
    if x.get("type") == "message" and isinstance(x.get("content"), list):
        parts = [p.get("text") for p in x["content"] if isinstance(p, dict) and p.get("type") in PARTS]
        text = "\n".join(t for p in parts if isinstance(p, str) and (t := ENVIRONMENT.sub("", p) if "<environment_context>" in p else p).strip(BLANKS))
    turn = x.get("turn_id")
    return True, word(x.get("type")), word(x.get("role")), turn if isinstance(turn, str) else None if turn is None else json.dumps(turn), text


READ = T.StructType([T.StructField("valid", T.BooleanType()), *[T.StructField(c, T.StringType()) for c in ("kind", "role", "turn_id", "text")]])


@F.pandas_udf(READ)
def _read_payload(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None,) * 5 if r is None else _payload(r) for r in raw], columns=READ.fieldNames())


def _read(v: Column) -> Column:
    """The same of a payload that has been read as a variant."""
    word = lambda x, path: F.when(F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING", F.try_variant_get(x, path, "string"))
    kind = word(v, "$.type")
    parts = F.transform(F.try_variant_get(v, "$.content", "array<variant>"), lambda x: F.when(word(x, "$.type").isin(*PARTS), F.regexp_replace(word(x, "$.text"), ENVIRONMENT_ANY, "")))
    said = F.array_join(F.filter(parts, lambda t: F.coalesce(tidy(t) != "", F.lit(False))), "\n")
    turn = F.try_variant_get(v, "$.turn_id", "string")
    return F.struct(F.lit(True).alias("valid"), kind.alias("kind"), word(v, "$.role").alias("role"), turn.alias("turn_id"), F.when(kind == "message", said).alias("text"))


def rollout_lines(lines: DataFrame) -> DataFrame:
    """Lines of the rollouts: conv_id, number (line_no), tie, at (line_ts), kind of line, what its payload says, role, text, speaks.

    Lines alike in line_no, type and payload are one, the first. Only lines whose payload matters are read as JSON: response items,
    events and line 0. They are read as variants; what that reader refuses (also repeated keys and very large values) is read
    once more in Python, which decides. A payload that isn't valid JSON says nothing.
    """
    time = F.col("line_ts").cast("string") if "line_ts" in lines.columns else F.lit(None).cast("string")
    rows = lines.filter(F.col("rollout_id").isNotNull()).select(F.col("rollout_id").alias("conv_id"), F.col("line_no").cast("bigint").alias("number"), F.col("line_id").alias("tie"), time.alias("at"), F.col("type").alias("line"), F.col("payload"))
    same = F.sha2(F.to_json(F.struct("line", "payload"), {"ignoreNullFields": "false"}), 256)
    once = rows.groupBy("conv_id", "number", same.alias("same")).agg(F.min(F.struct("tie", "at", "line", "payload")).alias("x")).select("conv_id", "number", "x.*")
    matters = F.col("line").isin("response_item", "event_msg") | (F.col("number") == 0)
    once = once.withColumn("payload", F.when(matters, F.col("payload"))).withColumn("v", F.try_parse_json("payload"))
    read = once.withColumn("again", _read_payload(F.when(F.col("v").isNull(), F.col("payload"))))
    read = read.withColumn("p", F.when(F.col("v").isNotNull(), _read(F.col("v"))).otherwise(F.col("again")))
    role = F.lower(tidy(F.col("p.role")))
    speaks = (F.col("line") == "response_item") & (F.col("p.kind") == "message") & _speaks(role, F.col("p.text"))
    return read.select("conv_id", "number", "tie", "at", "line", F.coalesce("p.valid", F.lit(False)).alias("valid"), "p.kind", "p.turn_id", role.alias("role"), "p.text", F.coalesce(speaks, F.lit(False)).alias("speaks"))


def _block(number: Column, tie: Column) -> Column:
    """Blocks in the order of (number, tie): number 0, which old imports give to all rows, by tie, the others by number."""
    return F.when(number == 0, F.struct(F.lit(0).cast("bigint").alias("a"), (tie / BLOCK).cast("bigint").alias("b"))).otherwise(
        F.struct(F.when(number < 0, F.floor(number / BLOCK) - 1).otherwise(F.floor(number / BLOCK) + 1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    )


def _shapes(lines: DataFrame, *, meta: Column) -> DataFrame:
    """What a conversation's order says, one row each: low and high number, rows, different numbers, whether anyone speaks, whether
    one of the rows is meta, and whether a user's turn opens it and each user's turn is answered.

    Rows are looked at within their block, sorted once; blocks' rows are joined up in a second, short pass.
    """
    by_block = Window.partitionBy("conv_id", "block").orderBy("number", "tie")
    role = F.when(F.col("speaks"), F.col("role"))
    steps = lines.select("conv_id", _block(F.col("number"), F.col("tie")).alias("block"), "number", "tie", "speaks", role.alias("role"), F.coalesce(meta, F.lit(False)).alias("meta"))
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.last("role", ignorenulls=True).over(earlier)).withColumn("new", ~F.col("number").eqNullSafe(F.lag("number").over(by_block)) | (F.row_number().over(by_block) == 1))
    at = F.when(F.col("role").isNotNull(), F.struct("number", "tie"))
    blocks = steps.groupBy("conv_id", "block").agg(
        F.min_by("role", at).alias("first"), F.max_by("role", at).alias("last"), F.max((F.col("role") == "user") & (F.col("before") == "user")).alias("twice"),
        F.count("*").alias("n"), F.count(F.when(F.col("new") & (F.col("number") != 0), 1)).alias("different"), F.count(F.when(F.col("number") == 0, 1)).alias("zeros"), F.count(F.when(F.col("number").isNull(), 1)).alias("unnumbered"),
        F.min("number").alias("low"), F.max("number").alias("high"), F.max("speaks").alias("speaks"), F.max("meta").alias("meta"),
    )
    over = Window.partitionBy("conv_id").orderBy("block")
    carried = F.last("last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.first("first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    joined = blocks.withColumn("earlier", carried).withColumn("later", coming)
    opening = F.col("first").isNotNull() & F.col("earlier").isNull() & (F.col("first") != "user")
    ignored = F.coalesce("twice", F.lit(False)) | F.coalesce((F.col("last") == "user") & (F.coalesce("later", F.lit("")) != "assistant"), F.lit(False))
    return joined.groupBy("conv_id").agg(
        F.sum("n").alias("n"), (F.sum("different") + F.max((F.col("zeros") > 0).cast("int")) + F.max((F.col("unnumbered") > 0).cast("int"))).alias("different"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("unnumbered").alias("unnumbered"), F.max("speaks").alias("speaks"), F.max("meta").alias("meta"), F.max(opening | ignored).alias("unanswered"),
    )


def unanswered(lines: DataFrame) -> DataFrame:
    """conv_id of the conversations that open with no user's turn or leave a user's turn without a reply."""
    return _shapes(lines, meta=F.lit(False)).filter("unanswered").select("conv_id")


def dropped_session_lines(sessions: DataFrame, lines: DataFrame) -> DataFrame:
    """The same as dropped_sessions, of lines that session_lines gave."""
    shape = _shapes(lines, meta=F.lit(False))
    zero = (F.col("low") == 0) & (F.col("high") == 0)
    broken = ~zero & ((F.col("n") != F.col("different")) | (F.col("high") - F.col("low") + 1 != F.col("different")))
    named = sessions.filter(F.col("session_id").isNotNull()).select(F.col("session_id").alias("conv_id")).distinct()
    judged = named.join(shape.withColumn("good", F.col("speaks") & ~broken & ~F.col("unanswered")), "conv_id", "left")
    return judged.filter(~F.coalesce("good", F.lit(False))).select("conv_id")


def dropped_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id of the sessions to drop: no speaking turn, opened by no user, a user's turn without reply, or broken.

    Broken: the numbers of all rows leave a gap or two rows share one, unless all are 0.
    """
    return dropped_session_lines(sessions, session_lines(sessions, messages))


def dropped_rollout_lines(lines: DataFrame) -> DataFrame:
    """The same as dropped_rollouts, of lines that rollout_lines gave."""
    event = F.when((F.col("line") == "event_msg") & F.col("kind").isin("task_started", "task_complete"), F.col("kind"))
    shape = _shapes(lines, meta=(F.col("number") == 0) & (F.col("line") == "session_meta") & F.col("valid"))
    whole = F.col("meta") & (F.col("low") == 0) & (F.col("high") + 1 == F.col("different")) & (F.col("unnumbered") == 0)
    bad = shape.filter(~F.col("speaks") | ~F.coalesce(whole, F.lit(False)) | F.col("unanswered")).select("conv_id")
    tasks = lines.filter(event.isNotNull() & F.col("turn_id").isNotNull()).groupBy("conv_id", "turn_id").agg(F.max(event == "task_started").alias("started"), F.max(event == "task_complete").alias("complete"))
    return bad.unionByName(tasks.filter(F.col("started") & ~F.col("complete")).select("conv_id")).distinct()


def dropped_rollouts(raw: DataFrame) -> DataFrame:
    """conv_id of the rollouts to drop: as sessions, but broken if line_no doesn't run from 0 without gaps (a null one breaks it),
    if line 0 is no session_meta with valid JSON, or if a started task's turn_id has no completed one.
    """
    return dropped_rollout_lines(checkpointed(rollout_lines(raw).drop("text")))


def kept_turns(lines: DataFrame, dropped: DataFrame) -> DataFrame:
    """The speaking turns of conversations that aren't dropped: conv_id, turn_no from 1, role, text.

    Turn numbers are counted within blocks and go on by a prefix sum over the blocks' rows.
    """
    turns = lines.filter("speaks").join(dropped, "conv_id", "left_anti").select("conv_id", _block(F.col("number"), F.col("tie")).alias("block"), "number", "tie", "role", "text")
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("conv_id", "block", before.alias("shift"))
    inner = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("number", "tie"))
    return turns.withColumn("k", inner).join(shifts, ["conv_id", "block"]).select("conv_id", (F.col("k") + F.col("shift")).cast("bigint").alias("turn_no"), "role", F.col("text"))


def split_at_gaps(rows: DataFrame, channel: list[str], at: str, gap_seconds: float | None = None) -> DataFrame:
    """Adds part, which counts the stretches of each channel between inactivity gaps, for rows that bear no conversation.

    Without gap_seconds the gap is calibrated: the smallest of 8 to 4,096 minutes, in doubling steps, beyond which the share of
    waits falls least. A row without a time belongs to part 0. Hours are looked at one by one and joined up.
    """
    seconds = F.unix_micros(at) / 1e6  
    timed = rows.withColumn("_s", seconds).withColumn("_hour", F.floor(F.col("_s") / 3600))
    hours = timed.filter("_s is not null").groupBy(*channel, "_hour").agg(F.max("_s").alias("_until"))
    over = Window.partitionBy(*channel).orderBy("_hour")
    edges = hours.select(*channel, "_hour", F.lag("_until").over(over).alias("_carried"))
    inner = Window.partitionBy(*channel, "_hour").orderBy("_s")
    waits = timed.join(edges, [*channel, "_hour"], "left").withColumn("_wait", F.col("_s") - F.coalesce(F.lag("_s").over(inner), F.col("_carried")))
    if gap_seconds is None:
        steps = [60 * 2**k for k in range(3, 13)]
        counts = waits.agg(*[F.count(F.when((F.col("_wait") > a) & (F.col("_wait") <= 2 * a), 1)).alias(f"s{a}") for a in steps]).first()
        gap_seconds = min(steps, key=lambda a: (counts[f"s{a}"], a))
    cut = waits.withColumn("_new", F.when(F.col("_wait") > gap_seconds, 1).otherwise(0))
    starts = cut.groupBy(*channel, "_hour").agg(F.sum("_new").alias("_n"))
    base = starts.select(*channel, "_hour", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    running = F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    parts = cut.withColumn("_run", running).join(base, [*channel, "_hour"], "left").withColumn("part", F.when(F.col("_s").isNotNull(), F.col("_run") + F.col("_base")).otherwise(0).cast("bigint"))
    return parts.select(*rows.columns, "part")


def rebuilt_at_gaps(rows: DataFrame, channel: list[str], at: str, gap_seconds: float | None = None, minimum_exchanges: int = 1) -> DataFrame:
    """Conversations of message rows that bear no conversation: turns with part, turn_no from 1, speaker and text, in order.

    rows: the channel's columns, at (a timestamp), tie (unique; breaks ties of time), role (may be null), hint (user, assistant or null; what the row's form
    says of its speaker) and text. Stretches between gaps are those of split_at_gaps. A role that is missing is the hint or, failing that, the one
    other than the last known speaker's in the stretch (a user's if there is none). Stretches without at least so many user's turns followed by an
    assistant's are dropped, as are blank texts and rows without a time or a channel. Rows alike in all but tie are one.
    """
    said = F.coalesce(tidy(F.col("text")) != "", F.lit(False))
    clean = rows.dropna(subset=channel).filter(said & F.col(at).isNotNull()).select(*channel, at, "tie", F.lower(tidy(F.col("role"))).alias("role"), "hint", "text")
    once = clean.groupBy(*channel, at, "role", "text").agg(F.min("tie").alias("tie"), F.min("hint").alias("hint"))
    cut = checkpointed(split_at_gaps(once, channel, at, gap_seconds).withColumn("_day", F.floor(F.unix_micros(at) / 86_400_000_000)))
    keys = [*channel, "part", "_day"]
    order = Window.partitionBy(*keys).orderBy(at, "tie")
    days = Window.partitionBy(*channel, "part").orderBy("_day")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)

    # what a row says itself, then what the last row that says something lets one infer, day by day
    told = cut.withColumn("told", F.when(F.col("role").isin(*SPEAKERS), F.col("role")).otherwise(F.when(F.col("role").isNull() | (F.col("role") == ""), F.col("hint")).otherwise(F.lit("other"))))
    known = told.withColumn("_last", F.last("told", ignorenulls=True).over(earlier(order))).withColumn("_k", F.count(F.when(F.col("told").isNotNull(), 1)).over(earlier(order)))
    ends = known.groupBy(*keys).agg(F.max_by("told", F.when(F.col("told").isNotNull(), F.struct(at, "tie"))).alias("_end")).withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier(days)))
    based = known.join(ends.select(*keys, "_carried"), keys).withColumn("_base", F.coalesce("_last", "_carried"))
    # a run of rows that say nothing alternates from the last known speaker on
    run = F.row_number().over(Window.partitionBy(*keys, "_k").orderBy(at, "tie"))
    flips = based.withColumn("_run", run)
    first_user = (F.col("_base") == "assistant") | F.coalesce(F.col("_base") == "other", F.lit(True))
    speaker = F.when(F.col("told").isNotNull(), F.col("told")).when((F.col("_run") % 2 == 1) == F.coalesce(first_user, F.lit(True)), "user").otherwise("assistant")
    turns = checkpointed(flips.withColumn("speaker", speaker).filter("speaker in ('user', 'assistant')").select(*keys, at, "tie", "speaker", "text"))

    paired = turns.withColumn("_next", F.lead("speaker").over(order))
    sums = paired.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count(F.when((F.col("speaker") == "user") & (F.col("_next") == "assistant"), 1)).alias("_pairs"),
        F.min_by("speaker", F.struct(at, "tie")).alias("_first"), F.max_by("speaker", F.struct(at, "tie")).alias("_last"),
    )
    sums = sums.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier(days)), F.lit(0))).withColumn("_after", F.lead("_first").over(days))
    pairs = F.sum(F.col("_pairs") + F.when((F.col("_last") == "user") & (F.col("_after") == "assistant"), 1).otherwise(0)).over(Window.partitionBy(*channel, "part"))
    kept = sums.withColumn("_all", pairs).filter(F.col("_all") >= minimum_exchanges).select(*keys, "_shift")
    numbered = turns.withColumn("_no", F.row_number().over(order)).join(kept, keys)
    return numbered.select(*channel, "part", (F.col("_no") + F.col("_shift")).cast("bigint").alias("turn_no"), at, "speaker", "text")


def rollout_messages(raw: DataFrame) -> DataFrame:
    """Messages of rollouts as rows for rebuilt_at_gaps: channel (rollout_id), at, tie, role, hint from the form of the text's parts, text."""
    hint = F.when(F.col("payload").contains('"output_text"'), "assistant").when(F.col("payload").contains('"input_text"'), "user")
    lines = rollout_lines(raw).filter((F.col("line") == "response_item") & (F.col("kind") == "message"))
    forms = raw.select(F.col("line_id").alias("tie"), hint.alias("hint"))
    at = F.timestamp_micros(instant_micros(F.col("at")))
    return lines.join(forms, "tie").select(F.col("conv_id").alias("channel"), at.alias("at"), "tie", "role", "hint", "text")
