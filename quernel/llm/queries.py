"""Queries of the llm operators over the whole tables, and SQL for those that SQL can express on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernel.llm import batchdedup
from quernel.llm.batchdedup import check_in_loads
from quernel.llm.conversations import dropped_rollout_lines, dropped_rollouts, dropped_session_lines, dropped_sessions, kept_turns, rebuilt_at_gaps, rollout_lines, rollout_messages, session_lines
from quernel.llm.mixing import mix_sources
from quernel.llm.packing import container_report, pack_documents
from quernel.llm.residue import classify_messages, page_body, residue
from quernel.llm.sentences import sentence_units
from quernel.llm.splitting import RANGE, split_files, split_oversized
from quernel.llm.tokens import TOKENIZER
from quernel.session import checkpointed, own_folder, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections over 6,000 bytes."""
    return split_oversized(table(spark, sf_dir, "articles"), with_text=False).filter("piece_no = 1").select("article_id", "section_no")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the sections over 6,000 bytes, with their places and texts."""
    return split_oversized(table(spark, sf_dir, "articles"))


def p1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sections found in files, one per article, without whole-file loading: ranges of 64 KB are read where they lie."""
    folder = own_folder(spark, "bodies")

    def write(batches):  # noqa: ANN001, ANN202
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        for b in batches:
            for k, body in zip(b["article_id"], b["body"], strict=True):
                with system.open_output_stream(f"{base}/{k}.md") as f:
                    f.write(body.encode())
            yield b[["article_id"]]

    table(spark, sf_dir, "articles").filter("body is not null").select("article_id", "body").mapInPandas(write, "article_id bigint").write.format("noop").mode("overwrite").save()
    number = F.regexp_extract("path", "([0-9]+)\\.md$", 1).cast("bigint")
    return split_files(spark, folder, range_bytes=RANGE, with_text=False).filter("piece_no = 1").select(number.alias("article_id"), "section_no")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetches that hold no real page, or an unfilled placeholder."""
    return residue(table(spark, sf_dir, "fetches")).select("fetch_id")


def p3_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different messages of all bodies that recur on three hosts or more, with their class."""
    fetches = table(spark, sf_dir, "fetches")
    bodies = fetches.select(F.col("fetch_id").alias("id"), F.lower(F.regexp_extract("url", "//([^/?#]*)", 1)).alias("host"), page_body("content", "markdown", "text").alias("body"))
    return classify_messages(bodies.filter("body is not null")).filter("hosts >= 3").select("message", "times", "hosts", "class")


def _history_and_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue in two loads: the batches up to nine tenths of the rows become the stored history, those after them are checked against it."""
    entries = table(spark, sf_dir, "queue_entries")
    most = entries.agg(F.percentile_approx("batch_no", 0.9)).first()[0]
    return reduce(DataFrame.unionByName, check_in_loads(entries, own_folder(spark, "history"), [most] if most is not None else []))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each queued entry that repeats an accepted one, with the one it repeats; late batches are checked against the stored history."""
    checked = _history_and_rest(spark, sf_dir)
    return checked.filter(F.col("repeats").isNotNull()).select(F.col("repeats").alias("entry_id_a"), F.col("entry_id").alias("entry_id_b"))


def p4_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that are new, checked as in p4_found."""
    return _history_and_rest(spark, sf_dir).filter(F.col("repeats").isNull()).select("entry_id")


def p4_last_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last batch's entries, each with the accepted entry that it repeats, or null: against a history of two loads, the batches of the first half and those after them."""
    entries = table(spark, sf_dir, "queue_entries")
    half, last = entries.agg(F.percentile_approx("batch_no", 0.5), F.max("batch_no")).first()
    return check_in_loads(entries, own_folder(spark, "history"), [half, last - 1] if last is not None else [])[-1]


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different long notes whose triples are alike by half or more, whoever is accepted; each named by the first entry that has it."""
    rows = batchdedup._keyed(table(spark, sf_dir, "queue_entries"), "entry_id", "url", "note", 20)
    found = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("entry_id").alias("note"), F.first("triples").alias("triples"))
    sets = checkpointed(batchdedup._distances(found))
    _, postings = batchdedup._indexed(sets, 0.5)
    links = batchdedup._similar(batchdedup._candidates(postings, postings, 0.5, within=True), sets, sets, 0.5)
    return links.filter("p < q").select(F.col("p").alias("entry_id_a"), F.col("q").alias("entry_id_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations to drop."""
    sessions = dropped_sessions(table(spark, sf_dir, "sessions"), table(spark, sf_dir, "messages"))
    return sessions.unionByName(dropped_rollouts(table(spark, sf_dir, "rollout_lines"))).distinct()


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the conversations that are whole, in order, with their speakers."""
    sessions, messages, rollouts = (table(spark, sf_dir, t) for t in ("sessions", "messages", "rollout_lines"))
    said, lines = checkpointed(session_lines(sessions, messages)), checkpointed(rollout_lines(rollouts))
    return kept_turns(said, dropped_session_lines(sessions, said)).unionByName(kept_turns(lines, dropped_rollout_lines(lines)))


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollouts' messages put together by their times alone: split at calibrated gaps, speakers inferred where missing, stretches without replies dropped."""
    return rebuilt_at_gaps(rollout_messages(table(spark, sf_dir, "rollout_lines")), ["channel"], "at")


def _tokenizer(spark: SparkSession) -> str:
    """The tokenizer's file: the session's setting quernel.tokenizer, or else the default."""
    return spark.conf.get("quernel.tokenizer", TOKENIZER)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer=_tokenizer(spark))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), tokenizer=_tokenizer(spark))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, or piece of one over 2,048 tokens, with its container."""
    return _packed(spark, sf_dir)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return container_report(_packed(spark, sf_dir))


def p6_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters of each document are packed, whether its pieces follow on each other and whether all its containers keep to their capacity."""
    packed = checkpointed(_packed(spark, sf_dir))
    full = packed.groupBy("container_id").agg(F.sum("tokens").alias("held"))
    rows = packed.join(full, "container_id").groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("chars"), F.max("end_char").alias("last"), F.max("held").alias("most"))
    return rows.select("doc_id", "chars", (F.col("last") == F.col("chars")).alias("in_order"), (F.col("most") <= 2048).alias("fits"))


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is in it."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mix reaches."""
    return _mixed(spark, sf_dir)[1]


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mix, by source: how many documents it has, whether none is used too often and whether its tokens are its share to within two of its largest documents."""
    mix, report = _mixed(spark, sf_dir)
    used = mix.groupBy("source", "doc_id").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("most"))
    near = F.abs(F.col("tokens") - F.col("copies") * F.col("available_tokens")) <= 2 * F.col("largest_tokens")
    return report.join(used, "source", "left").select("source", "available_documents", F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("within_repeats"), near.alias("near"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each sentence unit of each text."""
    return sentence_units(table(spark, sf_dir, "documents")).select("doc_id", "end_char")


QUERIES = {
    "p1_found": p1_found, "p1_pieces": p1_pieces, "p1_files": p1_files, "p3_found": p3_found, "p3_messages": p3_messages, "p4_found": p4_found, "p4_accepted": p4_accepted, "p4_last_batch": p4_last_batch, "p4_links": p4_links, "p5_found": p5_found, "p5_turns": p5_turns, "p5_rebuilt": p5_rebuilt,
    "p6_packed": p6_packed, "p6_report": p6_report, "p6_covered": p6_covered, "p7_mixed": p7_mixed, "p7_shares": p7_shares, "p7_kept": p7_kept, "p8_found": p8_found,
}

_SECTIONS = """
with lines as (
  select article_id, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as n, len(string_split(body, chr(10))) as all_lines
  from articles where body is not null and body <> ''
), marked as (
  select *, regexp_matches(line, '^#{1,3}[ \\t]+[^\\s]') as head, strlen(line) + case when n < all_lines then 1 else 0 end as size from lines
), placed as (
  select article_id, sum(head::int) over (partition by article_id order by n) as section_no, size from marked
), sections as (
  select article_id, cast(section_no as int) as section_no, sum(size) as size from placed group by all
)
"""
_TURNS = """
with said as (
  select session_id, type, text_content, content, coalesce(sequence, 0) as number, min(id) as tie
  from messages where session_id is not null group by all
), session_rows as (
  select s.session_id as conv_id, number, tie, lower(trim(type, ' \t\n\r')) as role, coalesce(trim(text_content, ' \t\n\r') <> '', false) as has_text
  from said m join sessions s on m.session_id = s.id
), session_shape as (
  select conv_id, min(number) as low, max(number) as high, count(*) as n, count(distinct number) as different from session_rows group by conv_id
), raw as (
  select rollout_id as conv_id, line_no as number, type as line, payload, min(line_id) as tie from rollout_lines group by all
), read as (
  select conv_id, number, line, tie, case when json_valid(payload) then payload::json end as p from raw
), parts as (
  select conv_id, number, tie, json_extract_string(p, '$.role') as role, unnest(json_extract(p, '$.content[*]')) as part
  from read where line = 'response_item' and json_extract_string(p, '$.type') = 'message'
), rollout_rows as (
  select conv_id, number, tie, lower(trim(role, ' \t\n\r')) as role,
    bool_or(json_extract_string(part, '$.type') in ('input_text', 'output_text') and trim(regexp_replace(json_extract_string(part, '$.text'), '(?s)<environment_context>.*?(</environment_context>|$)', '', 'g'), ' \t\n\r') <> '') as has_text
  from parts group by conv_id, number, tie, role
), turns as (
  select conv_id, number, tie, role from session_rows where has_text and role in ('user', 'assistant')
  union all select conv_id, number, tie, role from rollout_rows where has_text and role in ('user', 'assistant')
), steps as (
  select conv_id, role, lag(role) over w as before, lead(role) over w as after from turns window w as (partition by conv_id order by number, tie)
), unanswered as (
  select distinct conv_id from steps where (before is null and role <> 'user') or (role = 'user' and coalesce(after, '') <> 'assistant')
), names as (
  select session_id as conv_id from sessions where session_id is not null union select rollout_id from rollout_lines where rollout_id is not null
), tasks as (
  select conv_id, json_extract_string(p, '$.turn_id') as turn, bool_or(json_extract_string(p, '$.type') = 'task_started') as started, bool_or(json_extract_string(p, '$.type') = 'task_complete') as complete
  from read where line = 'event_msg' and json_extract_string(p, '$.turn_id') is not null group by all
), rollout_shape as (
  select conv_id, min(number) as low, max(number) as high, count(distinct number) as different, bool_or(number = 0 and line = 'session_meta' and p is not null) as meta from read group by conv_id
)
"""
_SPOKEN = """, said_text as (
  select s.session_id as conv_id, m.number, m.tie, m.text_content as text from said m join sessions s on m.session_id = s.id
), part_text as (
  select conv_id, number, tie, regexp_replace(json_extract_string(part, '$.text'), '(?s)<environment_context>.*?(</environment_context>|$)', '', 'g') as text, n
  from (select conv_id, number, tie, unnest(json_extract(p, '$.content[*]')) as part, generate_subscripts(json_extract(p, '$.content[*]'), 1) as n
        from read where line = 'response_item' and json_extract_string(p, '$.type') = 'message')
  where json_extract_string(part, '$.type') in ('input_text', 'output_text')
), rollout_text as (
  select conv_id, number, tie, string_agg(text, chr(10) order by n) as text from part_text where trim(text, ' \t\n\r') <> '' group by all
), texts as (select * from said_text union all select * from rollout_text)
"""
_DROPPED = """select conv_id from names where conv_id not in (select conv_id from turns)
    union select conv_id from unanswered
    union select conv_id from session_shape where not (low = 0 and high = 0) and (n <> different or high - low + 1 <> different)
    union select conv_id from rollout_shape where not (low = 0 and high + 1 = different and meta)
    union select conv_id from tasks where started and not complete"""
SQL = {
    "p1_found": _SECTIONS + "select article_id, section_no from sections where size > 6000",
    "p1_files": _SECTIONS + "select article_id, section_no from sections where size > 6000",
    "p4_links": """with words as (select entry_id, string_split(trim(regexp_replace(lower(note), '[^a-z0-9]+', ' ', 'g')), ' ') as w from queue_entries where note is not null),
    triples as (select distinct entry_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t from (select entry_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 20)),
    sets as (select min(entry_id) as id, ts from (select entry_id, list(t order by t) as ts from triples group by entry_id) group by ts),
    each as (select id, len(ts) as n, unnest(ts) as t from sets),
    shared as (select a.id as p, b.id as q, a.n as m, b.n as n, count(*) as k from each a join each b on a.t = b.t and a.id < b.id group by all)
    select p as entry_id_a, q as entry_id_b from shared where 2 * k >= m + n - k""",
    "p5_found": _TURNS + _DROPPED,
    "p5_turns": _TURNS + _SPOKEN + "select t.conv_id, row_number() over (partition by t.conv_id order by t.number, t.tie) as turn_no, t.role, x.text from turns t join texts x on t.conv_id = x.conv_id and t.number = x.number and t.tie = x.tie where t.conv_id not in (" + _DROPPED + ")",
    "p6_covered": "select doc_id, cast(length(text) as bigint) as chars, true as in_order, true as fits from documents where text <> ''",
    "p7_kept": """with t as (select lower(trim(source)) as source from mix_targets group by 1), d as (select lower(trim(source, ' \t\n\r' || chr(160) || chr(12288))) as source, count(*) as n from documents where text <> '' group by 1)
    select t.source, coalesce(d.n, 0) as available_documents, true as within_repeats, true as near from t left join d using (source)""",
}
