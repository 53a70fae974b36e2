"""Queries of run ledgers, session logs, queues and mentions, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernel.functions import queue as Q, text as X
from quernel.functions.markup import looks_like_person
from quernel.functions.times import instant_micros
from quernel.operators import graph, intake, ledgers, reports as P, runs as U, sessions as S
from quernel.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEYWORDS = {"decision": ("decided", "chose", "because"), "bounds": ("limit", "budget"), "thanks": ("thanks",)}
WEIGHTS = {"decision": 3, "bounds": 2, "thanks": 1}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query, with its SQL if SQL can express it."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """The call ledger as one of runs: a call is a run of its op, degraded if it timed out; its provider and model are its flags."""
    c = table(spark, d, "cost_entries")
    status = F.when(F.col("ok"), "ok").when(F.col("err_kind") == "timeout", "degraded").otherwise("error")
    args = F.array_compact(F.array(F.concat(F.lit("--"), "provider"), F.concat(F.lit("--"), "model"), F.lit("plain")))
    phases = F.when(F.col("model").isNotNull(), F.array("model"))
    errors = F.when(F.col("model").isNotNull() & F.col("err_kind").isNotNull(), F.create_map("model", "err_kind"))
    at = F.concat("ledger_day", F.lit("T"), F.lpad(F.col("line_id").cast("string"), 12, "0"))
    return c.select(F.col("op").alias("command"), status.alias("status"), at.alias("at"), F.col("err_kind").alias("error"), args.alias("args"), phases.alias("degraded"), errors.alias("degraded_errors"), F.when(F.col("provider").isNotNull(), "hot").alias("mode"))


_RUNS = """runs as (select op as command, case when ok then 'ok' when err_kind = 'timeout' then 'degraded' else 'error' end as status, ledger_day || 'T' || lpad(cast(line_id as varchar), 12, '0') as "at", err_kind, provider, model from cost_entries)"""


@query(f"""with {_RUNS}, f as (select * from runs where status in ('ok', 'degraded') and command <> '' and "at" is not null) select key, max("at") as "at" from (select command as key, "at" from f union all select command || ' --' || provider, "at" from f where provider is not null union all select command || ' --' || model, "at" from f where model is not null) group by 1""")
def last_ok(spark: SparkSession, d: str) -> DataFrame:
    """When each op, and each op with each of its flags, last ended well."""
    return U.last_ok(_runs(spark, d))


@query(f"""with {_RUNS}, e as (select command, "at", case when status = 'error' then err_kind when model is null then 'partial failure (phases not recorded)' else 'partial failure in ' || model || case when err_kind <> '' then ': ' || err_kind else '' end end as error from runs where status in ('error', 'degraded') and command <> '' and "at" is not null) select command, "at", error from (select *, row_number() over (partition by command order by "at" desc) as k from e) where k = 1""")
def last_errors(spark: SparkSession, d: str) -> DataFrame:
    """The newest failure of each op, of partial ones with the phase."""
    return U.last_errors(_runs(spark, d)).select("command", "at", "error")


@query(f"""with {_RUNS}, f as (select *, coalesce(provider = 'anthropic', false) or coalesce(model = 'anthropic', false) as flagged from runs where status in ('ok', 'degraded') and command = (select min(op) from cost_entries)) select max("at") filter (where not flagged) as last_full, max("at") filter (where flagged and provider is not null) as last_mode from f""")
def run_history(spark: SparkSession, d: str) -> DataFrame:
    """When the first op by name last ran without a provider's flag, and with it."""
    first = table(spark, d, "cost_entries").agg(F.min("op")).first()[0]
    return U.run_history(_runs(spark, d), first or "", "--anthropic", "hot")


@query("select err_kind, substring(regexp_replace(regexp_replace('https://me:pw@a.example/x?key=' || line_id || '&b=2 failed', '(\\w+://)[^\\s/@]+@', '\\1***@', 'g'), '([?&][\\w.-]+=)[^\\s&#]+', '\\1***', 'g'), 1, 40) as error, count(*) as n from cost_entries where err_kind is not null and err_kind <> 'rate_limit' group by 1, 2")
def error_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Failed calls as they go to the error ledger: without rate limits, secrets masked, cut."""
    bad = U.error_records(table(spark, d, "cost_entries")).withColumn("error", F.concat(F.lit("https://me:pw@a.example/x?key="), F.col("line_id").cast("string"), F.lit("&b=2 failed")))
    return U.run_record(bad, most=40).groupBy("err_kind", "error").agg(F.count("*").alias("n"))


@query("select case when instr(model, '/') > 1 then split_part(model, '/', 1) else 'anthropic' end as provider, count(*) as calls, count(*) filter (where ok) as ok from cost_entries where model is not null group by 1")
def calls_by_model_provider(spark: SparkSession, d: str) -> DataFrame:
    """Calls by the provider that a model's name begins with."""
    c = table(spark, d, "cost_entries").filter("model is not null").withColumn("provider", U.provider_of(F.col("model")))
    return ledgers.calls_by(c, "provider").select("provider", "calls", "ok")


@query("select domain, count(distinct rel) as touched from articles where domain is not null group by 1 order by touched desc, domain limit 1")
def hot_domain(spark: SparkSession, d: str) -> DataFrame:
    """The domain with most articles touched, of several the first by name."""
    touched = intake.touches(table(spark, d, "articles").filter("domain is not null"), "domain", "rel")
    return U.busiest(touched, "domain", "touched")


@query("""with l as (select case when summary is not null then project_path end as project, case when summary is not null then updated_at end as "at", summary is null as skipped from sessions)
select 'all' as kind, '' as key, count(*) filter (where not skipped) as extracted, count(*) filter (where skipped) as skipped, min("at") as first, max("at") as last from l
union all select 'project', project, count(*), 0, min("at"), max("at") from l where project <> '' group by 2 union all select 'day', left("at", 10), count(*), 0, min("at"), max("at") from l where left("at", 10) <> '' group by 2""")
def sessions_log(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the sessions log, in all, by project and by day; sessions without a summary count as skipped."""
    s = table(spark, d, "sessions").select(F.col("project_path").alias("project"), F.col("updated_at").alias("extracted_at"), F.col("summary").isNull().alias("skipped"))
    return U.log_stats(s)


_CASES = " + ".join(f"case when {' or '.join(f'''contains(lower(coalesce(text_content, '')), '{k}')''' for k in ks)} then {WEIGHTS[c]} else 0 end" for c, ks in KEYWORDS.items())


@query(f"select score, count(*) as messages from (select {_CASES} as score from messages) group by 1")
def text_scores(spark: SparkSession, d: str) -> DataFrame:
    """Messages by the weighted score of their text, each category counted once."""
    return table(spark, d, "messages").select(U.text_score(F.col("text_content"), KEYWORDS, WEIGHTS).alias("score")).groupBy("score").agg(F.count("*").alias("messages"))


@query("""select session_id, round(greatest((epoch_us(try_cast(updated_at as timestamptz)) - epoch_us(try_cast(created_at as timestamptz))) / 3600000000.0, 0.0), 1) as hours from sessions where try_cast(updated_at as timestamptz) is not null and try_cast(created_at as timestamptz) is not null""")
def session_hours(spark: SparkSession, d: str) -> DataFrame:
    """How long each session lasted, in hours to a tenth."""
    s = table(spark, d, "sessions")
    hours = Q.duration_hours(instant_micros(F.col("created_at")), instant_micros(F.col("updated_at")))
    return s.select("session_id", hours.alias("hours")).filter("hours is not null")


@query("""with c as (select session_id as id, count(*) as n from messages group by 1) select s.session_id, case when message_count is null or message_count <= 0 then coalesce(n, message_count) else message_count end as message_count from sessions s left join c on c.id = s.id""")
def backfilled_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with their number of messages counted where it is missing."""
    counted = table(spark, d, "messages").groupBy(F.col("session_id").alias("id")).agg(F.count("*").cast("int").alias("message_count"))
    return U.backfilled(table(spark, d, "sessions").select("id", "session_id", "message_count"), counted, "id", "message_count").select("session_id", "message_count")


@query("""with p as (select session_id, 'pending' as lane, min(message_count) as message_count from sessions where message_count > 10 group by 1), t as (select session_id, 'triaged' as lane, min(message_count) as message_count from sessions group by 1)
select session_id, lane, message_count from p union all select * from t where session_id not in (select session_id from p)""")
def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pending sessions, then triaged ones that aren't among them."""
    s = table(spark, d, "sessions").select("session_id", "message_count")
    return U.first_listed([s.filter("message_count > 10").select("session_id", F.lit("pending").alias("lane"), "message_count"), s.select("session_id", F.lit("triaged").alias("lane"), "message_count")], "session_id")


@query("""with a as (select session_id, updated_at as stamp, 'ours' as side from sessions where project_path < '/work/n'), b as (select session_id, case when message_count > 8 then '2030-01-01T00:00:00Z' else created_at end as stamp, 'theirs' as side from sessions where project_path > '/work/g')
select coalesce(a.session_id, b.session_id) as session_id, case when a.session_id is null or (b.session_id is not null and case when try_cast(a.stamp as timestamptz) is not null and try_cast(b.stamp as timestamptz) is not null then b.stamp::timestamptz > a.stamp::timestamptz else coalesce(b.stamp, '') > coalesce(a.stamp, '') end) then b.stamp else a.stamp end as stamp,
case when a.session_id is null or (b.session_id is not null and case when try_cast(a.stamp as timestamptz) is not null and try_cast(b.stamp as timestamptz) is not null then b.stamp::timestamptz > a.stamp::timestamptz else coalesce(b.stamp, '') > coalesce(a.stamp, '') end) then 'theirs' else 'ours' end as side from a full join b on a.session_id = b.session_id""")
def merged_logs(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a sessions log, merged: the entry with the later stamp stays."""
    s = table(spark, d, "sessions")
    ours = s.filter("project_path < '/work/n'").select("session_id", F.col("updated_at").alias("stamp"), F.lit("ours").alias("side"))
    theirs = s.filter("project_path > '/work/g'").select("session_id", F.when(F.col("message_count") > 8, "2030-01-01T00:00:00Z").otherwise(F.col("created_at")).alias("stamp"), F.lit("theirs").alias("side"))
    return U.merge_logs(ours, theirs, "session_id", "stamp")


_STATS = """select s.session_id, case when u < 1 or c < 500 then 'empty' when u < 3 and c < 2000 then 'thin' else 'keep' end as verdict from (select s.session_id, count(*) filter (where lower(trim(m.type, ' \t\n')) = 'user') as u, coalesce(sum(length(m.text_content)), 0) as c from sessions s left join messages m on m.session_id = s.id group by s.id, s.session_id) s"""


@query(f"select session_id from sessions where summary is null and session_id in (select session_id from ({_STATS}) where verdict = 'keep')")
def unskipped_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Skipped sessions (those without a summary, say) whose verdict now is keep."""
    s = table(spark, d, "sessions")
    return U.kept_anyway(s.filter("summary is null").select("session_id"), S.session_verdict(S.session_stats(s, table(spark, d, "messages"))))[1]


@query("select session_id, id from (select session_id, id, row_number() over (partition by session_id order by id) as k from (select session_id, id from sessions union all select session_id, id + 1000000 from sessions) where trim(session_id) <> '') where k = 1")
def drained_queue(spark: SparkSession, d: str) -> DataFrame:
    """A pending queue read twice over, each session once by its first entry."""
    s = table(spark, d, "sessions").select("session_id", "id")
    return U.drained(s.union(s.select("session_id", F.col("id") + 1_000_000)), "id")


@query("""with p as (select project_path as path, max(session_id) as sha, max(case when message_count > 5 then session_id end) as last_sha, max(updated_at) as newest, case when count(*) > 1 then min(updated_at) end as done from sessions where project_path is not null group by 1), q as (select project_path as path, session_id as sha from sessions where provider = 'codex')
select path, case when coalesce(done, '') = '' then 'new' when coalesce(sha, '') <> '' and sha is distinct from last_sha then 'changed' else 'newer' end as why from p where (coalesce(done, '') = '' or (coalesce(sha, '') <> '' and sha is distinct from last_sha) or coalesce(newest > done, false)) and (path, sha) not in (select (path, sha) from q where path is not null and sha is not null)""")
def projects_to_extract(spark: SparkSession, d: str) -> DataFrame:
    """Projects that need extraction: new, changed or with newer files, and not done by a peer."""
    s = table(spark, d, "sessions").filter("project_path is not null")
    p = s.groupBy(F.col("project_path").alias("path")).agg(F.max("session_id").alias("sha"), F.max(F.when(F.col("message_count") > 5, F.col("session_id"))).alias("last_sha"), F.max("updated_at").alias("newest_file"), F.when(F.count("*") > 1, F.min("updated_at")).alias("extracted_at"))
    return U.to_extract(p, s.filter("provider = 'codex'").select(F.col("project_path").alias("path"), F.col("session_id").alias("sha"))).select("path", "why")


@query("select distinct rel from articles where not coalesce(contains(body, '[['), false) and rel not in (select rel from articles where type = 'idea')")
def to_contextualise(spark: SparkSession, d: str) -> DataFrame:
    """Articles that neither a log (of ideas) names nor bear a mark (a link, say)."""
    a = table(spark, d, "articles")
    return U.to_contextualise(a, a.filter("type = 'idea'"), "[[", key="rel").select("rel").distinct()


@query("""with f as (select * from sessions where message_count >= 10 and not coalesce(starts_with(summary, 'You are working in'), false) order by updated_at desc nulls last, session_id limit 20)
select session_id from f where session_id not in (select session_id from sessions where provider = 'codex') and message_count * 5 >= 50""")
def worth_queueing(spark: SparkSession, d: str) -> DataFrame:
    """Of the twenty newest sessions fit for it, those to enqueue: the watcher's own limit."""
    s = table(spark, d, "sessions").withColumn("score", F.col("message_count") * 5)
    none = s.select("session_id").filter(F.lit(False))
    return U.worth_queueing(s, s.filter("provider = 'codex'").select("session_id"), none).select("session_id")


@query("""with u as (select distinct id, regexp_replace(u, '[.,;:!?)]+$', '') as url from (select entry_id as id, unnest(regexp_extract_all(coalesce(note, '') || ' ' || coalesce(url, ''), 'https?://[^\\s<>\"''\\)\\]]+')) as u from queue_entries)) select url, min(id) as id from u where not contains(url, 'field-almanac') and url not in (select url from fetches where url is not null) group by 1""")
def captured_links(spark: SparkSession, d: str) -> DataFrame:
    """New addresses from messages (notes and what they link to), each with the first message that has it."""
    said = table(spark, d, "queue_entries").select(F.col("entry_id").alias("id"), F.concat_ws(" ", F.coalesce("note", F.lit("")), F.coalesce("url", F.lit(""))).alias("text"))
    return intake.captured(said, table(spark, d, "fetches").filter("url is not null").select("url").distinct(), skip=["field-almanac"])[0]


@query("select entry_id as id, note as text from queue_entries where not regexp_matches(note, 'https?://') and strlen(trim(note)) > 10 and not starts_with(note, 'Liked ')")
def captured_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes without addresses that are long enough to keep."""
    said = table(spark, d, "queue_entries").select(F.col("entry_id").alias("id"), F.col("note").alias("text"))
    return intake.captured(said, said.select(F.col("text").alias("url")).limit(0))[1].select("id", "text")


@query("""select entry_id, coalesce(trim(regexp_replace(title, '[\\r\\n]+', ' ', 'g')), '') as title, coalesce(note, '') as note, array_to_string(list_filter(list_transform(tags, lambda x: trim(regexp_replace(x, '[\\r\\n]+', ' ', 'g'))), lambda x: x <> ''), ', ') as tags, case when trim(fetcher) <> 'auto' then coalesce(trim(fetcher), '') else '' end as fetcher from (select * replace (coalesce(tags, []) as tags) from queue_entries)""")
def queue_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Entries written as queue files and read back."""
    q = table(spark, d, "queue_entries")
    text = Q.queue_text(*[F.col(c) for c in ("url", "title", "tags", "domain", "fetcher", "source", "note", "queued_at")])
    f = q.select("entry_id", Q.queue_fields(text).alias("f"))
    get = lambda k: F.coalesce(F.try_element_at("f", F.lit(k)), F.lit(""))
    return f.select("entry_id", get("title").alias("title"), F.coalesce(Q.queue_note(F.col("f")), F.lit("")).alias("note"), get("tags").alias("tags"), get("fetcher").alias("fetcher"))


@query("select article_id, list_filter(regexp_extract_all(body, 'https?://[!#-;=?-\\[\\]_a-z~]+'), lambda x: strlen(x) > 8) as urls from articles where body is not null")
def byte_links(spark: SparkSession, d: str) -> DataFrame:
    """Addresses found in the bytes of bodies."""
    a = table(spark, d, "articles").filter("body is not null")
    return a.select("article_id", Q.byte_urls(F.col("body").cast("binary")).alias("urls"))


_CODE = "regexp_replace(text, '(?s)```[^\\n]*\\n.*?```', '', 'g')"


@query(f"""with t as (select doc_id, {_CODE} as s from documents where text is not null), k as (select lower(title) as k from articles where title is not null), m as (
select unnest(regexp_extract_all(s, '\\b[A-Za-z0-9._%+-]{{2,}}@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b')) as form, true as sure from t union all select unnest(regexp_extract_all(s, '(?:^|\\s)(@[A-Za-z0-9_]{{3,30}})\\b', 1)), true from t union all
select trim(unnest(regexp_extract_all(s, '\\[\\[([^\\]\\n]+)\\]\\]', 1))), false from t union all select unnest(regexp_extract_all(s, '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b')), false from t)
select form, count(*) as n from m where lower(form) not in (select k from k) and (sure or (len(string_split(form, ' ')) between 2 and 4 and regexp_matches(form, '^(\\p{{Lu}}[\\p{{L}}.''’-]*)( \\p{{Lu}}[\\p{{L}}.''’-]*)*$') and not regexp_matches(form, '\\p{{Ll}}\\p{{Lu}}'))) group by form, sure having sure or count(*) >= 3""")
def mention_harvest(spark: SparkSession, d: str) -> DataFrame:
    """E-mail addresses, handles, and names (in links, or pairs of words with capitals) that no article has yet; names three times at least."""
    t = table(spark, d, "documents").filter("text is not null").select(F.regexp_replace("text", "(?s)```[^\\n]*\\n.*?```", "").alias("s"))
    found = lambda p, i: F.transform(F.regexp_extract_all("s", F.lit(p), F.lit(i)), lambda x: F.trim(x))
    sure, names = F.concat(found(Q.EMAIL, 0), found(Q.HANDLE, 1)), F.concat(found(Q.LINK, 1), found("\\b[A-Z][a-z]+ [A-Z][a-z]+\\b", 0))
    each = t.select(F.explode(F.concat(F.transform(sure, lambda x: F.struct(x.alias("form"), F.lit(True).alias("sure"))), F.transform(names, lambda x: F.struct(x.alias("form"), F.lit(False).alias("sure"))))).alias("m")).select("m.*")
    counted = each.groupBy("form", "sure").agg(F.count("*").alias("n")).filter((F.col("sure") | (F.col("n") >= 3)) & (F.col("sure") | looks_like_person(F.col("form"))))
    known = table(spark, d, "articles").filter("title is not null").select(F.lower("title").alias("k")).distinct()
    return counted.withColumn("k", F.lower("form")).join(known, "k", "left_anti").select("form", "n")


@query("""with r as (select session_id as session, coalesce(sequence, 0) as s, id, coalesce(contains(content, '"Grep"'), false) as f, coalesce(contains(content, '"Edit"') or contains(content, '"Bash"'), false) as d from messages where lower(trim(type, ' \t\n')) = 'assistant' and coalesce(sequence, 0) <= 300 and session_id is not null),
g as (select session, min(case when f then (s, id) end) as f, min(case when d then (s, id) end) as d from r group by 1) select count(*) filter (where g.d is not null) as decided, count(*) filter (where coalesce(g.f < g.d, false)) as led, count(*) filter (where g.d is null) as excluded from sessions left join g on g.session = sessions.id""")
def adoption_window(spark: SparkSession, d: str) -> DataFrame:
    """Of all sessions, those that change something, those of them that search first, and those that never change anything."""
    has = lambda *names: F.coalesce(F.col("content").rlike("|".join(f'"{n}"' for n in names)), F.lit(False))
    first = S.first_before(table(spark, d, "messages").filter("session_id is not null"), has("Grep"), has("Edit", "Bash"))
    j = table(spark, d, "sessions").select(F.col("id").alias("session")).join(first, "session", "left")
    did = F.coalesce("has_second", F.lit(False))
    return j.agg(F.count_if(did).alias("decided"), F.count_if(F.coalesce("first_leads", F.lit(False))).alias("led"), F.count_if(~did).alias("excluded"))


@query(f"select word, count(*) as n from (select unnest(list_distinct({'regexp_split_to_array(lower(title), chr(32))'})) as word from articles where title is not null) where strlen(word) >= 4 group by 1")
def title_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of titles, of four bytes or more, with how many titles have each."""
    a = table(spark, d, "articles").filter("title is not null").select(F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("word"))
    return a.filter(F.octet_length("word") >= 4).groupBy("word").agg(F.count("*").alias("n"))


@query("select fetch_id, trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')) as text, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) as title from fetches")
def pages_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Fetches wrapped as pages of HTML, stripped to their text and title again."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title><style>p { x: y }</style></head><body><script>let x = '<p>';</script><p>"), safe(F.col("content")), F.lit("</p></body></html>"))
    body = F.regexp_replace(page, "(?is)<title>.*?</title>", "")
    return table(spark, d, "fetches").select("fetch_id", X.strip_html(body).alias("text"), X.html_title(page).alias("title"))


@query("""with s as (select 'session' as section, project_path as key, updated_at as "at", session_id as text from sessions where project_path is not null and updated_at is not null), a as (select 'article', domain, cast(strftime(synced_at, '%Y-%m-%d') as varchar), rel from articles where domain is not null and synced_at is not null),
n as (select *, row_number() over (partition by section, key order by "at" desc, text desc) as k from (select * from s union all select * from a)), p as (select *, row_number() over (partition by section order by "at" desc, key) as place from n where k = 1) select section, place, key, "at", text from p where place <= 5""")
def hot_cache(spark: SparkSession, d: str) -> DataFrame:
    """The hot cache: the five projects and domains touched last, each by its newest session or article; the report's limit."""
    s, a = table(spark, d, "sessions"), table(spark, d, "articles")
    rows = P.report(
        P.top_of(s, "session", F.col("project_path"), F.col("updated_at"), F.col("session_id"), 5), P.top_of(a, "article", F.col("domain"), F.date_format("synced_at", "yyyy-MM-dd"), F.col("rel"), 5)
    )
    return rows.withColumn("place", F.col("place").cast("bigint"))


@query("""with f as (select (select count(*) from sessions where summary is null) as unsummed, (select count(*) from rollout_lines where payload is null or not json_valid(payload)) as broken, (select count(*) from cost_entries where err_kind = 'timeout') as timeouts)
select 'unsummed' as name, unsummed as n, case when unsummed <= 0 then 'ok' else 'warn' end as status from f union all select 'broken', broken, case when broken <= 1000000 then 'ok' else 'warn' end from f union all select 'timeouts', timeouts, case when timeouts <= 10 then 'ok' else 'warn' end from f""")
def doctor_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a corpus's tables against bounds."""
    broken = table(spark, d, "rollout_lines").filter(F.try_parse_json("payload").isNull())
    n = P.figures(unsummed=table(spark, d, "sessions").filter("summary is null"), broken=broken, timeouts=table(spark, d, "cost_entries").filter("err_kind = 'timeout'"))
    return P.checks(n, {"unsummed": 0, "broken": 1_000_000, "timeouts": 10})


@query("""with u as (select cast(l_suppkey as varchar) as author, 'p' || l_partkey as path, case when l_returnflag = 'N' then 'A' else 'M' end as status from lineitem), f as (select author, path, bool_or(status = 'A') as a, bool_or(status = 'M') as m from u group by 1, 2)
select author, count(*) filter (where a) as added, count(*) filter (where m and not a) as updated from f group by 1""")
def digest_activity(spark: SparkSession, d: str) -> DataFrame:
    """A digest's activity: different files added and only updated by author, lines standing for changes."""
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("author"), F.concat(F.lit("p"), "l_partkey").alias("path"), F.when(F.col("l_returnflag") == "N", "A").otherwise("M").alias("status"))
    return intake.author_activity(c)


@query("select l_orderkey as batch, count(distinct l_partkey) as files, cast(sum(l_quantity) as bigint) as added, cast(sum(l_linenumber) as bigint) as deleted from lineitem group by 1")
def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Files and lines by batch, orders standing for batches."""
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("deleted"))
    return P.batch_outcomes(c)


@query("select s.session_id from sessions s where project_path in (select project_path from sessions group by 1 having count(*) > 2) and updated_at >= '2026-03-01'")
def approved_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of approved projects (those with more than two) since a day."""
    s = table(spark, d, "sessions")
    n = s.groupBy(F.col("project_path").alias("path")).agg(F.when(F.count("*") > 2, F.lit(None).cast("string")).otherwise("pending").alias("status"))
    return P.approved_sessions(s, n, F.lit("2026-03-01")).select("session_id")


@query("""with n as (select article_id as page, trim(t) as target, count(*) as n from (select article_id, unnest(regexp_extract_all('`[[Code]]` ' || body, '\\[\\[([^\\]\\[|]+)(?:\\|[^\\]]*)?\\]\\]', 1)) as t from articles) group by 1, 2),
r as (select article_id as page, trim(t) as target, count(*) as n from (select article_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace('`[[Code]]` ' || body, '(?s)```.*?(?:```|\\z)', ' ', 'g'), '``[^`]*``', ' ', 'g'), '`[^`\\n]*`', ' ', 'g'), '\\[\\[([^\\]\\[|]+)(?:\\|[^\\]]*)?\\]\\]', 1)) as t from articles) group by 1, 2)
select n.page, n.target, n.n as naive, coalesce(r.n, 0) as real from n left join r on n.page = r.page and n.target = r.target where n.n <> coalesce(r.n, 0)""")
def link_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Links that only a scan of the whole text finds; each body gets one in code."""
    a = table(spark, d, "articles").withColumn("body", F.concat(F.lit("`[[Code]]` "), "body"))
    return P.link_diff(a, page="article_id")


@query("select fetch_id, case when lower(trim(via)) = 'stub' then 'stub' when lower(trim(via)) = 'fxtwitter' then 'brief' else case when w <= 80 then 'stub' when w <= 199 then 'brief' when w <= 1999 then 'standard' else 'deep' end end as tier from (select fetch_id, via, case when trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' ')) end as w from fetches)")
def raw_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Index tiers of fetched pages, by how they were fetched and how long they are."""
    f = table(spark, d, "fetches")
    return f.select("fetch_id", P.raw_tier(F.lit(None).cast("string"), F.col("via"), X.index_tier(X.word_count(F.col("content")), F.lit(0))).alias("tier"))


@query("select doc_id, case when kind = 'wiki' then len(list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x), '- '))) else len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '### '))) end as items from documents where text is not null")
def proposal_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of documents as files of proposals, flat lists or headed blocks."""
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", P.proposal_items(F.col("text"), F.coalesce(F.col("kind") == "wiki", F.lit(False))).cast("bigint").alias("items"))


@query("select session_id, id from messages where sequence > 3 and session_id in (select id from sessions where provider = 'codex' or starts_with(regexp_extract(project_path, '[^/]*$'), 'l')) and id is not null")
def messages_to_self(spark: SparkSession, d: str) -> DataFrame:
    """Messages after a point in the chats of some handles, of which a chat may have several."""
    s = table(spark, d, "sessions")
    chats = s.select(F.col("id").alias("chat"), F.coalesce("provider", F.lit("none")).alias("handle")).union(s.select("id", F.substring_index("project_path", "/", -1)))
    handles = chats.select("handle").filter("handle is not null").distinct().withColumn("address", F.when((F.col("handle") == "codex") | F.col("handle").startswith("l"), "me").otherwise("other"))
    m = table(spark, d, "messages").select("id", F.col("session_id").alias("chat"), F.col("sequence").alias("at"))
    return P.messages_to_self(m, chats, handles, ["me"], F.lit(3)).select(F.col("chat").alias("session_id"), "id")


@query("with p as (select distinct article_id as src, trim(l) as dst from (select article_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(body, '(?s)```.*?(?:```|\\z)', ' ', 'g'), '``[^`]*``', ' ', 'g'), '`[^`\\n]*`', ' ', 'g'), '\\[\\[([^\\]\\[|]+)(?:\\|[^\\]]*)?\\]\\]', 1)) as l from articles where type = 'decision') where trim(l) <> '') select src, dst from p where dst not in (select title from articles where type <> 'decision' and title is not null)")
def missing_when_promoted(spark: SparkSession, d: str) -> DataFrame:
    """Links of decisions that would lead nowhere in a corpus of all other articles."""
    a = table(spark, d, "articles")
    edges = graph.link_edges(a.filter("type = 'decision'"), src="article_id")
    return P.missing_in_target(edges, a.filter("type <> 'decision' and title is not null"))
