"""Queries of the corpus operators over the articles, sessions, ledgers and documents, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernel.functions import text as X
from quernel.functions.markup import looks_like_person
from quernel.functions.paths import folder, segments, source_allowed
from quernel.operators import dedup, graph, intake, ledgers, merge, segment, sessions as S
from quernel.operators.views import View, run_view
from quernel.session import table

TERMS = {"cause": ("the cause is", "because"), "bounds": ("limit", "budget"), "renames": ("rename", "renamed"), "thanks": ("thanks", "that works"), "checks": ("i checked", "reproduce")}
WEIGHTS = {"cause": 3, "bounds": 2, "renames": 1, "thanks": 1, "checks": 4}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query, with its SQL if SQL can express it."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles")


@query("select cast(article_id as varchar) as _path, coalesce(title, '') as title, coalesce(type, '') as type, coalesce(array_to_string(tags, ', '), '') as tags, coalesce(updated, '') as updated from articles "
       "where type in ('decision', 'pattern', 'research') and (list_contains(tags, 'sync') or contains(lower(title), 'link')) and not coalesce(domain = 'general', false)")
def view_filter_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree of and, or and not over fields of articles."""
    tree = {"and": [{"field": "type", "op": "in", "value": ["decision", "pattern", "research"]}, {"or": [{"field": "tags", "op": "has", "value": "sync"}, {"field": "title", "op": "contains", "value": "LINK"}]}, {"not": {"field": "domain", "op": "eq", "value": "general"}}]}
    return run_view(_articles(spark, d), View(["title", "type", "tags", "updated"], tree), "article_id")


@query("select cast(article_id as varchar) as _path, coalesce(title, '') as title from articles where (title is null or trim(title) = '') or not (tags is null or len(tags) = 0)")
def view_not_missing(spark: SparkSession, d: str) -> DataFrame:
    """Articles without title or with tags; negation of two-valued leaves."""
    tree = {"or": [{"field": "title", "op": "missing"}, {"not": {"field": "tags", "op": "missing"}}]}
    return run_view(_articles(spark, d), View(["title"], tree), "article_id")


@query("select cast(article_id as varchar) as _path, coalesce(updated, '') as updated, coalesce(domain, '') as domain from articles where updated is not null and case when try_cast(updated as double) is not null then false else updated < '2026-03-01' end "
       "order by case when try_cast(updated as double) is null then 1 else 0 end, updated desc, article_id limit 40")
def view_loose_compare(spark: SparkSession, d: str) -> DataFrame:
    """A loose comparison, sorted and cut: the report's own limit of 40 rows."""
    tree = {"field": "updated", "op": "lt", "value": "2026-03-01"}
    return run_view(_articles(spark, d), View(["updated", "domain"], tree, [("updated", "desc")], 40), "article_id")


@query("select cast(o_orderkey as varchar) as _path, c_mktsegment, cast(o_orderkey as varchar) as o_orderkey, o_orderpriority from orders join customer on o_custkey = c_custkey where o_totalprice > 150000 and c_mktsegment in ('BUILDING', 'AUTOMOBILE') and not (o_orderstatus = 'F')")
def view_orders(spark: SparkSession, d: str) -> DataFrame:
    """A view over a join: expensive open orders of two segments."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    tree = {"and": [{"field": "o_totalprice", "op": "gt", "value": 150000}, {"field": "c_mktsegment", "op": "in", "value": ["BUILDING", "AUTOMOBILE"]}, {"not": {"field": "o_orderstatus", "op": "eq", "value": "F"}}]}
    return run_view(rows, View(["o_orderkey", "c_mktsegment", "o_orderpriority"], tree), "o_orderkey")


_ENTITY = "coalesce(nullif(lower(trim(provider, ' \t\n')), ''), 'anthropic') as provider, nullif(lower(trim(model, ' \t\n')), '') as model"


@query(f"select provider, model, count(*) as calls, count(*) filter (where ok) as ok, count(*) filter (where err_kind = 'timeout') as timeouts, count(*) filter (where err_kind = 'rate_limit') as rate_limits, cast(coalesce(sum(duration_ms), 0) as bigint) as duration_ms, cast(coalesce(sum(prompt_chars), 0) as bigint) as prompt_chars, "
       f"cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens, count(input_tokens) as calls_with_usage from (select * exclude (provider, model), {_ENTITY} from cost_entries) group by provider, model")
def cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Calls, outcomes, time and usage by provider and model."""
    return ledgers.calls_by(ledgers.with_entity(table(spark, d, "cost_entries")), "provider", "model")


@query(f"select provider, model, op, cast(grouping(provider, model, op) as bigint) as level, count(*) as calls, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens from (select op, output_tokens, {_ENTITY} from cost_entries) group by grouping sets ((model), (provider), (op), ())")
def cost_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Calls by model, provider, op and in all, in one pass."""
    return ledgers.calls_grouping_sets(ledgers.with_entity(table(spark, d, "cost_entries")))


@query("select ledger_day as day, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens from cost_entries where not coalesce(lower(trim(provider, ' \t\n')) in ('ollama', 'llamacpp', 'llama.cpp'), false) group by 1")
def budget_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Metered output tokens by day of the ledger."""
    return ledgers.metered_output(table(spark, d, "cost_entries"))


@query("select op, line_id, err_kind, ledger_day from (select *, row_number() over (partition by op order by ledger_day desc, line_id desc) as k from cost_entries where not ok and op is not null) where k = 1")
def last_error_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The newest failed call of each operation."""
    failed = table(spark, d, "cost_entries").filter("not ok and op is not null")
    return ledgers.newest_by(failed, ["op"], ["ledger_day", "line_id"], ["line_id", "err_kind", "ledger_day"])


@query("select coalesce(provider, 'claude') as provider, count(*) as sessions, max(updated_at) as newest from sessions group by 1")
def provider_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by provider and the newest of each."""
    return table(spark, d, "sessions").groupBy(F.coalesce("provider", F.lit("claude")).alias("provider")).agg(F.count("*").alias("sessions"), F.max("updated_at").alias("newest"))


_STATS = """select s.session_id, count(*) filter (where lower(trim(m.type, ' \t\n')) = 'user') as user_messages, cast(coalesce(sum(length(m.text_content)), 0) as bigint) as chars, cast(coalesce(max(coalesce(m.sequence, 0)), 0) as bigint) as last_sequence
from sessions s left join messages m on m.session_id = s.id group by s.id, s.session_id"""


@query(f"select *, case when user_messages < 1 or chars < 500 then 'empty' when user_messages < 3 and chars < 2000 then 'thin' else 'keep' end as verdict from ({_STATS})")
def session_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each session and whether it is empty, thin or to keep."""
    return S.session_verdict(S.session_stats(table(spark, d, "sessions"), table(spark, d, "messages")))


def _hit(terms: tuple[str, ...]) -> str:
    return "regexp_matches(lower(text_content), '(^|[^\\p{L}\\p{N}])(" + "|".join(terms) + ")([^\\p{L}\\p{N}]|$)')"


_SCORES = (
    "select session_id, message_count, " + ", ".join(TERMS) + ", " + " + ".join(f"{c} * {w}" for c, w in WEIGHTS.items()) + " as score from sessions join (select session_id as sid, "
    + ", ".join(f"count(*) filter (where {_hit(t)}) as {c}" for c, t in TERMS.items()) + " from messages group by 1) on sid = id where message_count >= 6 and not coalesce(starts_with(summary, 'You are working in'), false) and score > 0"
)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_scores(table(spark, d, "sessions"), table(spark, d, "messages"), TERMS, WEIGHTS)


@query(_SCORES)
def triage_score(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by weighted hits of keyword categories."""
    return _scores(spark, d)


@query(f"select case when score >= 50 then 50 when score >= 20 then 20 when score >= 10 then 10 when score >= 5 then 5 else 0 end as band, count(*) as sessions, cast(sum(score) as bigint) as total, avg(score) as mean from ({_SCORES}) group by 1")
def triage_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by band of their score."""
    return S.score_histogram(_scores(spark, d))


@query("""with t as (select session_id, project_path, epoch_us(try_cast(updated_at as timestamptz)) as at from sessions where project_path is not null and session_id is not null), p as (
select a.session_id, b.session_id as other, row_number() over (partition by a.session_id order by b.at desc, b.session_id) as place from t a join t b on a.project_path = b.project_path and a.session_id <> b.session_id and abs(a.at - b.at) < 604800000000)
select session_id, other, cast(place as int) as place from p where place <= 5""")
def related_sessions_band(spark: SparkSession, d: str) -> DataFrame:
    """Up to five others of a session's project within a week."""
    return S.related_sessions(table(spark, d, "sessions"))


@query("""with r as (select session_id as session, coalesce(sequence, 0) as s, id, coalesce(contains(content, '"Grep"'), false) as f, coalesce(contains(content, '"Edit"') or contains(content, '"Bash"'), false) as d from messages where lower(trim(type, ' \t\n')) = 'assistant' and coalesce(sequence, 0) <= 300)
select session, min(case when d then (s, id) end) is not null as has_second, coalesce(min(case when f then (s, id) end) < min(case when d then (s, id) end), false) as first_leads from r group by 1""")
def adoption_first_before(spark: SparkSession, d: str) -> DataFrame:
    """Whether a session searches before it first changes something."""
    has = lambda *names: F.coalesce(F.col("content").rlike("|".join(f'"{n}"' for n in names)), F.lit(False))
    return S.first_before(table(spark, d, "messages"), has("Grep"), has("Edit", "Bash"))


_WORDS = "case when trim(regexp_replace({c}, '\\s+', ' ', 'g')) = '' or {c} is null then 0 else len(string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' ')) end"
_HEADS = "coalesce(len(regexp_extract_all(chr(10) || regexp_replace({c}, '(?s)```.*?(?:```|\\z)', ' ', 'g'), '\\n#{{2,3}}[ \\t]+\\S')), 0)"
_MEASURED = f"(select doc_id, {_WORDS.format(c='text')} as words, {_HEADS.format(c='text')} as heads from documents)"


@query(f"select doc_id, cast(words as int) as words, cast(heads as int) as heads, case when words >= 2000 or heads >= 4 then 'dense' when words < 500 and heads <= 1 then 'brief' else 'standard' end as density, case when words <= 80 then 'stub' when words <= 199 then 'brief' when words <= 1999 and heads < 5 then 'standard' else 'deep' end as tier from {_MEASURED}")
def density_and_tier(spark: SparkSession, d: str) -> DataFrame:
    """Words, headings, density class and index tier of each document."""
    measured = table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"), X.heading_count(F.col("text")).alias("heads"))
    words, heads = F.col("words"), F.col("heads")
    return measured.select("doc_id", words, heads, X.density_class(words, heads).alias("density"), X.index_tier(words, heads).alias("tier"))


_NORMAL = "trim(lower(regexp_replace(array_to_string(list_filter(list_transform(string_split(replace({c}, chr(13), ''), chr(10)), lambda x: trim(x)), lambda x: not starts_with(x, '<!--') and not starts_with(x, '```')), ' '), '\\s+', ' ', 'g')))"


@query(f"select doc_id, min(doc_id) over (partition by h) as class_id, count(*) over (partition by h) as copies from (select doc_id, sha256({_NORMAL.format(c='text')}) as h from documents where text is not null)")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    """The class of each document among equal bodies, one row per document."""
    return dedup.exact_classes(table(spark, d, "documents"), "doc_id", "text")


@query(f"""with t as (select min(doc_id) as id, n from (select doc_id, {_NORMAL.format(c='text')} as n from documents where text is not null) where n <> '' group by n),
w as (select id, list_filter(regexp_split_to_array(n, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from t),
k as (select id, unnest(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))) as k from w),
c as (select id, count(*) as n from k group by 1), p as (select x.id as a, y.id as b, count(*) as m from k x join k y on x.k = y.k and x.id < y.id group by 1, 2)
select a, b, m / (ca.n + cb.n - m) as similarity from p join c ca on ca.id = a join c cb on cb.id = b where m / (ca.n + cb.n - m) >= 0.8""")
def near_dup_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between representatives of different bodies: runs of five words, similarity 0.8 or more."""
    return dedup.near_links(table(spark, d, "documents"), "doc_id", "text")


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(n, '[^a-z0-9]+'), lambda x: strlen(x) >= 4 and not list_contains(" + str(list(X.STOPWORDS)) + ", x)))"


@query(f"""with t as (select min(doc_id) as id, n from (select doc_id, {_NORMAL.format(c='text')} as n from documents where text is not null) group by n), s as (select id, {_TOKENS} as s from t), w as (select id, len(s) as n, unnest(s) as k from s where len(s) >= 40),
p as (select x.id as a, y.id as b, x.n as m, y.n as n, count(*) as c from w x join w y on x.k = y.k and x.id < y.id and least(x.n, y.n) >= 0.3 * greatest(x.n, y.n) group by all)
select a, b, c as shared, c / (m + n - c) as jaccard, c / least(m, n) as overlap from p where c / (m + n - c) >= 0.55 or (c / least(m, n) >= 0.7 and greatest(m, n) / least(m, n) <= 4 and c / (m + n - c) >= 0.3)""")
def duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose sets of words are alike, or of which one holds most of the other's."""
    return dedup.alike_pairs(table(spark, d, "documents"), "doc_id", "text")


@query(f"with t as (select distinct {_NORMAL.format(c='text')} as n from documents where text is not null), k as (select unnest({_TOKENS}) as token from t) select token, count(*) as held from k group by 1")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """In how many different documents each word of the token sets stands."""
    t = table(spark, d, "documents").filter("text is not null").select(X.dedup_normal(F.col("text")).alias("n")).distinct()
    return t.select(F.explode(X.token_set(F.col("n"))).alias("token")).groupBy("token").agg(F.count("*").alias("held"))


@query("""with t as (select min(entry_id) as id, n from (select entry_id, """ + _NORMAL.format(c="note") + """ as n from queue_entries where note is not null) where n <> '' group by n),
w as (select id, list_filter(regexp_split_to_array(n, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from t),
k as (select id, unnest(list_distinct(list_transform(generate_series(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 2], ' ')))) as k from w),
c as (select id, count(*) as n from k group by 1), p as (select x.id as a, y.id as b, count(*) as m from k x join k y on x.k = y.k and x.id < y.id group by 1, 2)
select a, b, m / (ca.n + cb.n - m) as similarity from p join c ca on ca.id = a join c cb on cb.id = b where m / (ca.n + cb.n - m) >= 0.5""")
def near_dup_notes(spark: SparkSession, d: str) -> DataFrame:
    """Links between different notes of the queue: runs of three words and a similarity of a half, as notes are short."""
    return dedup.near_links(table(spark, d, "queue_entries"), "entry_id", "note", words=3, threshold=0.5)


_EDGES = """edges as (select distinct rel as src, trim(l) as dst from (select rel, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(body, '(?s)```.*?(?:```|\\z)', ' ', 'g'), '``[^`]*``', ' ', 'g'), '`[^`\\n]*`', ' ', 'g'), '\\[\\[([^\\]\\[|]+)(?:\\|[^\\]]*)?\\]\\]', 1)) as l from articles) where trim(l) <> '')"""


@query(f"with {_EDGES} select dst as title, list_sort(list(distinct src)) as sources, count(distinct src) as inbound from edges group by 1")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    """Who links to each linked title."""
    a = _articles(spark, d)
    return graph.backlinks(graph.link_edges(a), a.select(F.col("rel").alias("src"), "title").distinct())


@query(f"with {_EDGES}, titles as (select distinct title from articles where title is not null) select title from titles where title not in (select dst from edges)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Titles to which nothing links."""
    a = _articles(spark, d)
    return graph.orphans(a, graph.link_edges(a))


@query(f"with {_EDGES} select dst as target, count(distinct src) as sources from edges where dst not in (select title from articles where title is not null) group by 1")
def missing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Linked targets that are no article."""
    a = _articles(spark, d)
    return graph.missing_pages(a.select("title"), graph.link_edges(a))


@query(f"with {_EDGES} select coalesce(a.page, b.page) as page, coalesce(inbound, 0) as inbound, coalesce(outbound, 0) as outbound from (select src as page, count(*) as outbound from edges group by 1) a full join (select dst as page, count(*) as inbound from edges group by 1) b on a.page = b.page")
def link_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Links to and from each page: a full outer join."""
    return graph.link_degrees(graph.link_edges(_articles(spark, d)))


@query(f"with {_EDGES} select a.src as a, b.src as b, count(*) as shared from edges a join edges b on a.dst = b.dst and a.src < b.src group by 1, 2 having count(*) >= 2")
def shared_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of articles that link to the same targets."""
    return graph.shared_neighbours(graph.link_edges(_articles(spark, d)))


_TITLE_WORDS = "list_filter(list_transform(regexp_split_to_array(lower(title), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: trim(x, '.,;:!?()[]{}\"''`')), lambda x: strlen(x) >= 4 and not list_contains(" + str(list(graph.SMALL_WORDS)) + ", x))"
_HEAD = "lower(coalesce(" + ", ".join(f"try(decode(encode(body)[1:{n}]))" for n in (2500, 2499, 2498, 2497)) + "))"


@query(f"""with a as (select article_id as page, rel, domain, list_distinct(list_transform(coalesce(tags, []), lambda x: lower(trim(x)))) as tags, coalesce({_TITLE_WORDS}, []) as words, coalesce({_HEAD}, '') as head from articles),
p as (select x.page as orphan, y.page as host, 3 * len(list_intersect(list_filter(x.tags, lambda t: t is not null), y.tags)) + 2 * len(list_filter(x.words, lambda w: contains(y.head, w)))
+ case when x.domain = y.domain and x.domain not in ('general', '') then 5 else 0 end + case when y.rel like '%/overview.md' then 4 else 0 end as score from a x join a y on x.page <> y.page)
select orphan, host, cast(score as bigint) as score from p where score >= 8""")
def host_scores(spark: SparkSession, d: str) -> DataFrame:
    """Articles that each article could be linked from, by tags, domain, words of its title and overviews; a score of 8 at least."""
    a = _articles(spark, d).select(F.col("article_id").alias("page"), "tags", "domain", "title", "body", "rel")
    return graph.host_scores(a, a, least=8)


@query("""with e as (select l_suppkey as src, 'supplies' as kind, l_partkey as dst from lineitem union select l_partkey, 'supplied_by', l_suppkey from lineitem where l_quantity > 48)
select src, kind, dst, 'supplied_by' as inverse from e x where kind = 'supplies' and not exists (select 1 from e y where y.kind = 'supplied_by' and y.src = x.dst and y.dst = x.src)""")
def inverse_gap(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges whose inverse isn't stated."""
    line = table(spark, d, "lineitem")
    out = line.select(F.col("l_suppkey").alias("src"), F.lit("supplies").alias("kind"), F.col("l_partkey").alias("dst"))
    back = line.filter("l_quantity > 48").select(F.col("l_partkey").alias("src"), F.lit("supplied_by").alias("kind"), F.col("l_suppkey").alias("dst"))
    return graph.missing_inverse(out.union(back).distinct(), {"supplies": "supplied_by"})


@query("""with e as (select o_orderkey as src, least(o_custkey, o_orderkey % 500) as first, greatest(o_custkey, o_orderkey % 500) as second from orders)
select first, second, list_sort(list(distinct src)) as sources, case when first % 2 = 0 then '2026-01-01' else '2026-05-07' end as first_observed from e group by first, second""")
def contradiction_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of edges with their sources; when first seen stays from the ledger before."""
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 500).alias("b"))
    prior = edges.select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second")).distinct().filter("first % 2 = 0").withColumn("first_observed", F.lit("2026-01-01"))
    return graph.pair_ledger(edges, prior, "2026-05-07")


_SIDES = "ours as (select o_custkey as k, max(o_orderdate) as at, 'ours' as side from orders where o_orderkey % 2 = 0 group by 1), theirs as (select o_custkey as k, max(o_orderdate) as at, 'theirs' as side from orders where o_orderkey % 2 = 1 group by 1)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), "o_orderkey")
    side = lambda r, n: o.filter(f"o_orderkey % 2 = {r}").groupBy("k").agg(F.max("at").alias("at")).withColumn("side", F.lit(n))
    return side(0, "ours"), side(1, "theirs")


@query(f"with {_SIDES} select coalesce(a.k, b.k) as k, case when b.at is null or a.at >= b.at then a.at else b.at end as at, case when b.at is null or a.at >= b.at then 'ours' else 'theirs' end as side from ours a full join theirs b on a.k = b.k")
def keyed_merge_newest(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a keyed table, merged: the newer row of a key stays."""
    return merge.newest_wins(*_sides(spark, d), ["k"], "at")


@query("select 0 as side, op as line from cost_entries where line_id % 2 = 0 and op is not null union all select 1, op from (select distinct op from cost_entries where line_id % 2 = 1) where op not in (select op from cost_entries where line_id % 2 = 0 and op is not null)")
def line_union(spark: SparkSession, d: str) -> DataFrame:
    """All of one side and what the other adds."""
    ops = table(spark, d, "cost_entries").filter("op is not null").select("line_id", F.col("op").alias("line"))
    return merge.line_union(ops.filter("line_id % 2 = 0").select("line"), ops.filter("line_id % 2 = 1").select("line").distinct())


@query("""with inc as (select rel as name, md5(body) as sha from articles), log as (select rel as name, case when article_id % 3 = 0 then md5(body) when article_id % 3 = 1 then 'old' else '' end as sha from articles where article_id % 4 = 0 union all select 'copy-' || rel, md5(body) from articles where article_id % 4 = 1),
n as (select name, max(coalesce(sha, '')) as sha from log group by 1), s as (select distinct sha from log where coalesce(sha, '') <> '')
select i.name, case when n.name is not null and (n.sha = '' or n.sha = i.sha) then 'skip_same' when n.name is not null then 'refresh' when s.sha is not null then 'skip_dup' else 'run' end as decision from inc i left join n on n.name = i.name left join s on s.sha = i.sha""")
def absorb_decision(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each article, given a log of those taken in before."""
    a = _articles(spark, d)
    sha = F.md5("body")
    logged = a.filter("article_id % 4 = 0").select(F.col("rel").alias("name"), F.when(F.expr("article_id % 3 = 0"), sha).when(F.expr("article_id % 3 = 1"), "old").otherwise("").alias("sha"))
    copied = a.filter("article_id % 4 = 1").select(F.concat(F.lit("copy-"), "rel").alias("name"), sha.alias("sha"))
    return merge.absorb_decision(a.select(F.col("rel").alias("name"), sha.alias("sha")), logged.unionByName(copied))


@query("select u as url, count(distinct article_id) as articles from (select article_id, unnest(list_distinct(list_transform(regexp_extract_all(body, 'https?://[^\\s<>\"''\\)\\]]+'), lambda x: regexp_replace(x, '[.,;:!?)]+$', '')))) as u from articles) group by 1")
def url_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Web addresses in articles, with how many hold each."""
    found = _articles(spark, d).select("article_id", F.explode(X.urls(F.col("body"))).alias("url")).distinct()
    return found.groupBy("url").agg(F.count("*").alias("articles"))


@query("select tag, count(distinct article_id) as articles from (select article_id, unnest(list_transform(tags, lambda x: lower(trim(x)))) as tag from articles) group by 1 having count(distinct article_id) >= 2")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tags of two articles or more."""
    tags = _articles(spark, d).select("article_id", F.explode("tags").alias("tag")).select("article_id", F.lower(F.trim("tag")).alias("tag"))
    return tags.groupBy("tag").agg(F.count_distinct("article_id").alias("articles")).filter("articles >= 2")


@query("select name, count(*) as n from (select unnest(regexp_extract_all(text, '(?:Mr|Mrs|Ms|Mme|Dr|Prof|Hr|Fr|Sr|Sra)\\. (\\p{Lu}\\p{L}+)', 1)) as name from documents) group by 1 having count(*) >= 3")
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    """Names after a title, with how often each is mentioned; three times at least."""
    names = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?:Mr|Mrs|Ms|Mme|Dr|Prof|Hr|Fr|Sr|Sra)\\. (\\p{Lu}\\p{L}+)"), F.lit(1))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).filter("n >= 3")


@query("""with l as (select article_id, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as k, len(string_split(body, chr(10))) as m from articles where body is not null), g as (
select *, regexp_matches(line, '^#{1,3}[ \\t]+[^\\s]') as head, strlen(line) + case when k < m then 1 else 0 end as size from l), p as (
select *, sum(head::int) over w as n, coalesce(sum(size) over (partition by article_id order by k rows between unbounded preceding and 1 preceding), 0) as pos from g window w as (partition by article_id order by k)), s as (
select article_id, n, min(pos) as b0, sum(size) as size, min(k) as l0, any_value(case when head then line end) as t from p where n > 0 group by 1, 2)
select article_id, cast(n as int) as n, length(regexp_extract(t, '^#+')) ::int as level, trim(regexp_replace(t, '^#+', ''), ' \t\r') as title, cast(b0 as int) as start_byte, cast(b0 + size as int) as end_byte, cast(l0 as int) as first_line, cast(size // 4 as int) as tokens from s""")
def sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections of each article: title, level, place and size."""
    s = segment.article_sections(_articles(spark, d))
    return s.select("article_id", "n", "level", "title", F.col("bytes")[0].alias("start_byte"), F.col("bytes")[1].alias("end_byte"), F.col("lines")[0].alias("first_line"), "tokens")


@query(None)
def section_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of sections, unique within an article: rows only, as a taken one counts up."""
    return segment.article_sections(_articles(spark, d)).select("article_id", "n", "id")


@query(None)
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each article by headings and paragraphs: rows only, as sections are joined one after the other."""
    return segment.article_chunks(_articles(spark, d))


@query("select project_path, session_id, summary from (select *, row_number() over (partition by project_path order by updated_at desc, session_id) as k from sessions where project_path is not null and updated_at is not null) where k <= 3")
def hot_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three newest sessions of each project."""
    from pyspark.sql import Window

    w = Window.partitionBy("project_path").orderBy(F.col("updated_at").desc(), "session_id")
    s = table(spark, d, "sessions").filter("project_path is not null and updated_at is not null")
    return s.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("project_path", "session_id", "summary")


@query("select url, min(entry_id) as entry_id from queue_entries where trim(url) <> '' and not contains(url, 'field-almanac') and (list_contains(list_transform(tags, lambda x: lower(trim(x))), 'sync') or list_contains(list_transform(tags, lambda x: lower(trim(x))), 'ops')) "
       "and entry_id in (select min(entry_id) from queue_entries where trim(url) <> '' group by url) group by url")
def bookmark_pull(spark: SparkSession, d: str) -> DataFrame:
    """Queued bookmarks with a wanted tag, each address once, without those of a skipped host."""
    q = table(spark, d, "queue_entries").filter("trim(url) <> ''").withColumn("none", F.lit(""))
    seen = spark.createDataFrame([], "key string")
    fresh, _ = intake.pull(q, seen, id_col="none", url_col="url", order=["entry_id"], skip=["field-almanac"], tags=["Sync", "ops"])
    return fresh.select("url", "entry_id")


@query("select domain, count(distinct rel) as touched from articles where domain is not null group by 1")
def domain_touches(spark: SparkSession, d: str) -> DataFrame:
    """Different articles touched by domain."""
    return intake.touches(_articles(spark, d).filter("domain is not null"), "domain", "rel")


@query("select folder, title, row_number() over (partition by folder order by title) as place from (select distinct case when contains(rel, '/') then regexp_replace(rel, '/[^/]*$', '') else '' end as folder, title from articles where title is not null)")
def corpus_index(spark: SparkSession, d: str) -> DataFrame:
    """Titles by folder, in order."""
    return intake.group_index(_articles(spark, d).filter("title is not null"), folder(F.col("rel")), "title")


@query("select project_path from sessions where provider in (select provider from sessions where provider is not null) and project_path is not null group by 1 having count(distinct provider) = (select count(distinct provider) from sessions where provider is not null)")
def projects_of_all_providers(spark: SparkSession, d: str) -> DataFrame:
    """Projects with sessions of every provider: division."""
    s = table(spark, d, "sessions").filter("provider is not null and project_path is not null")
    return intake.in_all(s, "project_path", "provider", table(spark, d, "sessions").filter("provider is not null"))


@query("select rel, cast(len(list_filter(string_split(rel, '/'), lambda x: x <> '')) as int) as depth, count(*) as copies from articles group by 1, 2 having count(*) > 1")
def repeated_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of several rows, with their depth."""
    return _articles(spark, d).groupBy("rel", F.size(segments(F.col("rel"))).alias("depth")).agg(F.count("*").alias("copies")).filter("copies > 1")


@query("select project_path, count(*) as sessions from sessions where regexp_matches(project_path, '^/work/[a-m][^/]*(/.*)?$') and not regexp_matches(project_path, '^/work/field-[^/]*(/.*)?$') group by 1")
def allowed_projects(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by project, of those that globs include and none excludes."""
    s = table(spark, d, "sessions")
    allowed = source_allowed(F.col("project_path"), F.lit(None).cast("string"), ["/work/field-*"], [], ["/work/[a-m]*"])
    return s.filter(allowed).groupBy("project_path").agg(F.count("*").alias("sessions"))


@query("""with e as (select article_id % 3 as run, article_id as pos, trim(title) as label, tags from articles where trim(title) <> ''), c as (
select label, trim(t) as claim, min((run, pos)) as place from (select *, unnest(tags) as t from e) where trim(t) <> '' group by 1, 2)
select label, coalesce(list(claim order by place, claim) filter (where claim is not null), []) as claims from (select distinct label from e) left join c using (label) group by label""")
def merged_plans(spark: SparkSession, d: str) -> DataFrame:
    """Entities of three runs by label, with the union of their claims in the order first seen."""
    a = _articles(spark, d).select((F.col("article_id") % 3).alias("run"), F.col("article_id").alias("pos"), F.col("title").alias("label"), F.col("tags").alias("claims"))
    return intake.merge_runs(a).select("label", "claims")


@query("select article_id as chapter, 'c' || lpad(cast(article_id as varchar), cast(greatest(2, length(cast(article_id as varchar))) as int), '0') || '-f' || cast(k as varchar) as id, fact from (select article_id, unnest(tags) as fact, generate_subscripts(tags, 1) as k from articles)")
def fact_ids(spark: SparkSession, d: str) -> DataFrame:
    """Facts with ids by chapter and place."""
    return intake.number_facts(_articles(spark, d).select(F.col("article_id").alias("chapter"), F.col("tags").alias("facts")))


@query("""with m as (select session_id as sid, id as mid, coalesce(sequence, 0) as pos, lower(trim(type, ' ')) as role, case when coalesce(text_content, '') <> '' then text_content
when length(trim(content, ' \t\n\r')) <= 1200 then trim(content, ' \t\n\r') else left(trim(content, ' \t\n\r'), 600) || chr(10) || '[...]' || chr(10) || right(trim(content, ' \t\n\r'), 600) end as text from messages)
select s.session_id, row_number() over (partition by s.id order by pos, mid) as turn, role, text from m join sessions s on s.id = m.sid where trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""")
def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each session in order: what was said, whole, and of turns without it the tool text, trimmed to head and tail over 1,200 characters."""
    return S.transcript_turns(table(spark, d, "sessions"), table(spark, d, "messages"))


@query("""select doc_id, case when instr(l, '. ') between 2 and 120 then left(l, instr(l, '. ')) else left(l, 120) end as lead from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(replace(x, chr(13), ''))), lambda x: x <> '' and not starts_with(x, '#') and not starts_with(x, '---'))[1] as l from documents)""")
def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The lead of each document."""
    return table(spark, d, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("lead"))


@query("""select name, count(*) as n from (select unnest(regexp_extract_all(text, '\\p{Lu}\\p{L}+(?: \\p{Lu}\\p{L}+){1,3}')) as name from documents) where not regexp_matches(name, '\\p{Ll}\\p{Lu}') and len(list_filter(string_split(name, ' '), lambda w: regexp_matches(w, '^\\p{Lu}{2,}$'))) <= 2 group by 1 having count(*) >= 3""")
def person_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Two to four words that look like a person's name, in any script with capitals, mentioned three times or more."""
    found = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("\\p{Lu}\\p{L}+(?: \\p{Lu}\\p{L}+){1,3}"), F.lit(0))).alias("name"))
    return found.filter(looks_like_person(F.col("name"))).groupBy("name").agg(F.count("*").alias("n")).filter("n >= 3")


@query(None)
def changed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Articles after a log of changes taken from the queue's notes, dealt over all articles: rows only, as each change goes on from the one before."""
    a = _articles(spark, d)
    pages = a.groupBy(F.col("rel").alias("path")).agg(F.max_by("body", "article_id").alias("body"))
    known = a.select(F.col("article_id").alias("k"), F.col("rel").alias("path"))
    ids = a.agg((F.max("article_id") + 1).alias("ids"))
    notes = table(spark, d, "queue_entries").filter("trim(note) <> ''").crossJoin(ids).select((F.col("entry_id") % F.col("ids")).alias("k"), F.col("entry_id").alias("seq"), F.when(F.expr("entry_id % 3 = 0"), "replace_section").otherwise("append").alias("action"), F.lit("Notes").alias("heading"), F.col("note").alias("body"))
    return merge.apply_changes(pages, notes.join(known, "k").drop("k"))
