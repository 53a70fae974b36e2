"""Queries of articles as files: front matter, typed relations, findings, and what belongs to a corpus, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernel.functions import frontmatter as M, queue as Q, text as X
from quernel.functions.frontmatter import edit_list, see_also, set_field
from quernel.operators import dedup, lint, relations as R, scope, segment
from quernel.plans.corpus import SQL as CORPUS_SQL
from quernel.session import own_folder, table

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


def _scalar(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(c)), "^\\[|\\]$", "")


def _listed(key: str, items: Column) -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("\n  - "), _scalar(x))), "")
    return F.when(F.size(items) > 0, F.concat(F.lit(key + ":"), lines))


RELATION = {"decision": "supersedes", "research": "extends", "pattern": "applies_to", "tool": "derived_from"}


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Articles as files: front matter of their columns, links of the body as typed relations of a kind by type and as related, then the body."""
    a = _articles(spark, d)
    links = F.transform(X.wikilinks(F.col("body")), lambda x: F.concat(F.lit("[["), x, F.lit("]]")))
    one = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(c + ": "), _scalar(F.col(c))))
    typed = [F.when(F.col("type") == t, _listed(k, links)) for t, k in RELATION.items()]
    rest = F.when(~F.coalesce(F.col("type").isin(*RELATION), F.lit(False)), _listed("cited_by", links))
    front = F.concat_ws("\n", one("title"), one("type"), one("domain"), one("updated"), _listed("tags", F.filter("tags", lambda x: x.isNotNull())), *typed, rest, _listed("related", links))
    text = F.concat(F.lit("---\n"), front, F.lit("\n---\n"), F.coalesce("body", F.lit("")))
    return a.select("article_id", "rel", "type", "title", "body", "domain", "tags", text.alias("text"))


def _read(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).withColumn("fields", M.front_fields(M.front_of(F.col("text"))))


_LINK = "regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(body, '(?s)```.*?(?:```|\\z)', ' ', 'g'), '``[^`]*``', ' ', 'g'), '`[^`\\n]*`', ' ', 'g'), '\\[\\[([^\\]\\[|]+)(?:\\|[^\\]]*)?\\]\\]', 1)"
_EDGES = f"""links as (select distinct article_id, type, title, trim(l) as dst from (select article_id, type, title, unnest({_LINK}) as l from articles) where trim(l) <> ''),
edges as (select article_id as src, case type when 'decision' then 'supersedes' when 'research' then 'extends' when 'pattern' then 'applies_to' when 'tool' then 'derived_from' else 'cited_by' end as kind, dst, type from links)"""


@query("select article_id, title, type, domain, updated, list_filter(coalesce(tags, []), lambda x: x is not null) as tags, fast_title from (select *, coalesce(trim(title), '') as fast_title from articles)")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Fields of articles written as front matter and read back from it; the title also without reading the rest."""
    f = _read(spark, d)
    quick = F.coalesce(F.get_json_object(F.concat(F.lit('{"t": "'), M.fast_title(F.col("text")), F.lit('"}')), "$.t"), F.lit(""))
    return f.select("article_id", *[F.col(f"fields.{c}").alias(c) for c in ("title", "type", "domain", "updated", "tags")], F.trim(quick).alias("fast_title"))


@query("select article_id, cast(len(list_filter(coalesce(tags, []), lambda x: x is not null)) as bigint) as tags, coalesce(list_filter(coalesce(tags, []), lambda x: x is not null)[1], '') as first_tag, domain from articles")
def front_variant(spark: SparkSession, d: str) -> DataFrame:
    """Front matter of any fields as a variant, from which paths are taken."""
    v = F.try_parse_json(M.front_json(M.front_of(F.col("text"))))
    rows = _files(spark, d).select("article_id", v.alias("v"))
    tags = F.coalesce(F.try_variant_get("v", "$.tags", "array<string>"), F.array().cast("array<string>"))
    return rows.select("article_id", F.size(tags).cast("bigint").alias("tags"), F.coalesce(F.get(tags, F.lit(0)), F.lit("")).alias("first_tag"), F.try_variant_get("v", "$.domain", "string").alias("domain"))


@query("""select article_id, coalesce(domain, 'none') as domain, list_filter(coalesce(tags, []), lambda x: trim(x) <> '') as tags, updated,
case when len(list_filter(coalesce(tags, []), lambda x: trim(x) <> '')) > 0 then ['duplicate-keys', 'dates', 'lists'] else ['duplicate-keys', 'dates'] end as fixes from (select * exclude (updated), '2026-03-07' as updated from articles)""")
def front_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Front matter with repeated keys, slashes in dates and lists written as scalars, repaired and read."""
    tags = F.array_join(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.trim(x) != ""), ", ")
    front = F.concat_ws("\n", F.lit("domain: wrong"), F.lit("updated: 2026/3/7"), F.when(tags != "", F.concat(F.lit("tags: "), tags)), F.concat(F.lit("domain: "), F.coalesce("domain", F.lit("none"))))
    fixed = _articles(spark, d).select("article_id", M.repaired(F.concat(F.lit("---\n"), front, F.lit("\n---\nbody\n"))).alias("x"))
    fields = fixed.select("article_id", M.front_fields(M.front_of(F.col("x.text"))).alias("f"), "x.fixes")
    return fields.select("article_id", "f.domain", "f.tags", "f.updated", "fixes")


@query("""select article_id, 'deep' as index_tier, list_sort(list_distinct(list_concat(list_transform(list_filter(coalesce(tags, []), lambda x: trim(x) <> ''), lambda x: lower(trim(x))), ['kept']))) as tags,
contains(body, '[[Index]]') or true as linked, cast(len(string_split(coalesce(body, ''), '[[Index]]')) - 1 as bigint) as had from articles""")
def front_edited(spark: SparkSession, d: str) -> DataFrame:
    """Files with a field set, a tag added and another removed, and a link under See Also, done twice over."""
    edits = [
        lambda t: set_field(t, "index_tier", "deep"), lambda t: edit_list(t, "tags", add=["kept", "dropped"]),
        lambda t: edit_list(t, "tags", remove=["Dropped"]), lambda t: see_also(t, "Index"),
    ]
    text = M.with_edits(F.col("text"), *edits, *edits)
    rows = _files(spark, d).select("article_id", "body", text.alias("t"))
    done = rows.select("article_id", "body", "t", M.front_fields(M.front_of(F.col("t"))).alias("f"))
    folds = F.array_sort(F.array_distinct(F.transform("f.tags", lambda x: F.lower(F.trim(x)))))
    return done.select("article_id", "f.index_tier", folds.alias("tags"), F.col("t").contains("[[Index]]").alias("linked"), (F.size(F.split(F.coalesce("body", F.lit("")), "\\[\\[Index\\]\\]")) - 1).cast("bigint").alias("had"))


@query(f"with {_EDGES} select src, kind, dst from edges")
def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Typed relations that front matter states."""
    return R.typed_edges(_read(spark, d), src="article_id")


@query(f"with {_EDGES} select src, type, kind, dst from edges where type in ('person', 'project', 'idea', 'solution') or type not in ('decision', 'research', 'pattern', 'tool', '')")
def relation_errors(spark: SparkSession, d: str) -> DataFrame:
    """Relations that the type of their article doesn't allow."""
    f = _read(spark, d)
    return R.not_allowed(R.typed_edges(f, src="article_id"), f.select(F.col("article_id").alias("src"), "type"))


@query(f"""with {_EDGES} select src as page, 'out' as direction, kind, dst as other from edges
union all select a.article_id, 'in', e.kind, cast(e.src as varchar) from edges e join articles a on lower(a.title) = lower(e.dst) and a.article_id <> e.src""")
def relation_neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    """Relations of every page and to it."""
    f = _read(spark, d)
    e = R.typed_edges(f, src="article_id").withColumn("src", F.col("src").cast("string"))
    near = R.neighbourhoods(e, f.select(F.col("article_id").cast("string").alias("page"), "title"))
    return near.withColumn("page", F.col("page").cast("bigint"))


@query(f"with {_EDGES} select src, list_sort(list(dst)) as targets from edges where coalesce(type, '') <> 'decision' group by src")
def relations_to_type(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose untyped links no sidecar covers yet; those of decisions do."""
    f = _read(spark, d).withColumn("rel", F.col("article_id"))
    sidecars = f.filter("type = 'decision'").select(F.col("rel").alias("src"), F.transform("fields.related", R.link_target).alias("targets"))
    return R.untyped_candidates(f, sidecars).select("src", F.array_sort("targets").alias("targets"))


@query(f"with {_EDGES}, p as (select distinct least(title, dst) as a, greatest(title, dst) as b, type from links where type = 'decision'), l as (select a || ' | ' || b as id, max(type) as type from p group by 1) select id, case when id < 'M' then '2026-06-01' end as resolved_at, case when id < 'M' then 'settled' end as note from l")
def resolved_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of pairs with those settled that notes name."""
    a = _articles(spark, d).filter("type = 'decision'").select("title", F.explode(X.wikilinks(F.col("body"))).alias("dst"))
    ledger = a.select(F.concat_ws(" | ", F.least("title", "dst"), F.greatest("title", "dst")).alias("id")).distinct()
    return R.resolved(ledger, ledger.filter("id < 'M'").withColumn("note", F.lit("settled")), "2026-06-01")


_LINES = "case when coalesce(body, '') = '' then 0 else len(string_split(regexp_replace(body, '\\n\\z', ''), chr(10))) end"
_SIZES = f"""(select 'warn' as severity, 'thin-article' as class, rel as path, n || ' lines' as message from (select rel, {_LINES} as n from articles) where n < 15
union all select 'warn', 'bloated-article', rel, n || ' lines' from (select rel, {_LINES} as n from articles) where n > 150)"""


@query(f"select severity, class, path, message from {_SIZES}")
def lint_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Articles that are thin or bloated."""
    return lint.size_findings(_articles(spark, d), text="body")


_ARTIFACTS = """(with f as (select rel, body from articles union all select regexp_replace(rel, '\\.md$', '.md.md'), '<<<<<<< ours' || chr(10) || body from articles where type = 'idea' union all select 'notes/{{TITLE}}/' || rel, body from articles where type = 'tool')
select 'error' as severity, 'placeholder-path' as class, rel as path, rel as message from f where regexp_matches(rel, '\\{\\{[A-Z][A-Z0-9_]*\\}\\}')
union all select 'error', 'self-ingested-copy', f.rel, 'copy of ' || o.rel from f join (select distinct rel from f) o on o.rel = regexp_replace(f.rel, '(\\.md|_md)\\.md$', '.md') where regexp_matches(f.rel, '(\\.md|_md)\\.md$')
union all select 'warn', 'self-named-dir', rel, rel from f where regexp_matches(rel, '^[^/]+/(.*/)?articles/')
union all select 'error', 'conflict-marker', rel, 'line ' || list_position(list_transform(string_split(body, chr(10)), lambda x: starts_with(x, '<<<<<<< ') or starts_with(x, '>>>>>>> ')), true) from f where list_contains(list_transform(string_split(body, chr(10)), lambda x: starts_with(x, '<<<<<<< ') or starts_with(x, '>>>>>>> ')), true))"""


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d).select("rel", "body", "type")
    copies = a.filter("type = 'idea'").select(F.regexp_replace("rel", "\\.md$", ".md.md").alias("rel"), F.concat(F.lit("<<<<<<< ours\n"), "body").alias("body"))
    named = a.filter("type = 'tool'").select(F.concat(F.lit("notes/{{TITLE}}/"), "rel").alias("rel"), "body")
    return lint.artifact_findings(a.select("rel", "body").unionByName(copies).unionByName(named), names=["Articles"], text="body")


@query(f"select severity, class, path, message from {_ARTIFACTS}")
def lint_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Template marks and corpus names in paths, copies of pages, conflicts left in texts; copies of some articles bear them."""
    return _artifacts(spark, d)


@query(f"select severity, class, count(*) as n from (select severity, class from {_SIZES} union all select severity, class from {_ARTIFACTS}) group by 1, 2")
def lint_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings by class."""
    return lint.class_counts(lint.size_findings(_articles(spark, d), text="body").unionByName(_artifacts(spark, d)))


@query("""select msg, case when contains(msg, 'missing required fields') and contains(msg, 'title') then 'needs-title' when contains(msg, 'missing required fields') then 'fixable' when contains(msg, 'invalid confidence') then 'needs-confidence' when contains(msg, 'invalid domain') then 'fixable'
when contains(msg, 'no frontmatter delimiter') then 'needs-frontmatter' else 'other' end as class, count(*) as n from (select case when title is null or trim(title) = '' then 'missing required fields: title' when len(coalesce(tags, [])) = 0 then 'missing required fields: tags' when domain is null then 'invalid domain'
when body is null or body = '' then 'no frontmatter delimiter' when type is null then 'invalid confidence' else 'fine' end as msg from articles) group by 1, 2""")
def front_error_classes(spark: SparkSession, d: str) -> DataFrame:
    """Messages about front matter by who could repair it."""
    none = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    msg = F.when(none("title"), "missing required fields: title").when(F.size(F.coalesce("tags", F.array())) == 0, "missing required fields: tags").when(F.col("domain").isNull(), "invalid domain").when(F.coalesce("body", F.lit("")) == "", "no frontmatter delimiter").when(F.col("type").isNull(), "invalid confidence").otherwise("fine")
    return _articles(spark, d).select(msg.alias("msg")).groupBy("msg", lint.error_class(F.col("msg")).alias("class")).agg(F.count("*").alias("n"))


@query("""with e as (select rel as path, length(rel) - length(replace(rel, '/', '')) as depth, sha256(text) as h from documents where text is not null and rel is not null), k as (select h, min((depth, path)) as k, count(*) as copies from e group by 1 having count(*) > 1)
select k.k[2] as keep, e.path, copies from e join k using (h) where e.path <> k.k[2]""")
def identical_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the same bytes as one that is kept: the shallowest, then the first by path."""
    return lint.identical_findings(table(spark, d, "documents").filter("rel is not null"))


@query(f"with links as (select distinct trim(l) as dst from (select unnest({_LINK}) as l from articles) where trim(l) <> ''), t as (select distinct title from articles where title is not null) select (select count(*) from t where title not in (select dst from links)) as orphans, (select count(*) from links where dst not in (select title from t)) as missing")
def orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many titles nothing links to, and how many targets are no title."""
    a = _articles(spark, d)
    return lint.orphan_counts(a, a.select(F.explode(X.wikilinks(F.col("body"))).alias("dst")))


@query("select entries, articles, abs(articles - entries) > 3 as drifted from (select cast(coalesce(sum(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '- [[')))), 0) as bigint) as entries from documents), (select count(*) as articles from articles)")
def index_drift(spark: SparkSession, d: str) -> DataFrame:
    """Entries of indexes among the documents against the articles there are."""
    return lint.index_drift(table(spark, d, "documents"), _articles(spark, d))


@query("select coalesce(nullif(trim(kind), ''), 'unknown') as density, count(*) as articles, count(*) filter (where not starts_with(coalesce(text, ''), '---')) as bare from documents group by 1".replace("nullif(trim(kind), '')", "case when trim(kind) <> '' then kind end"))
def status_scoreboard(spark: SparkSession, d: str) -> DataFrame:
    """Documents by kind, with how many have no front matter."""
    return lint.scoreboard(table(spark, d, "documents"), F.col("kind"), F.coalesce(F.col("text").startswith("---"), F.lit(False)))


@query("select row_number() over (order by overlap desc, a, b) as place, a, b, jaccard, overlap, classes from (select * from (" + CORPUS_SQL["duplicate_audit"] + ") order by overlap desc, a, b limit 150), (select count(distinct class_id) as classes from (" + CORPUS_SQL["exact_dup_groups"] + ") where copies > 1)")
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    """The duplicate report: the 150 pairs of most overlap, and how many classes of copies there are."""
    classes = dedup.class_sets(table(spark, d, "documents"), "doc_id", "text")
    return lint.duplicate_report(classes, dedup.alike_classes(classes)).withColumn("place", F.col("place").cast("bigint"))


ALIASES = [("field-almanac", "notes"), ("work/lazy-pier", "tools")]
_PATHS = "(select distinct project_path as path from sessions where project_path is not null)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").select(F.col("project_path").alias("path")).filter("path is not null").distinct()


@query(f"select path, case when regexp_extract(path, '[^/]*$') = 'field-almanac' then 'notes' when path like '%/work/lazy-pier' then 'tools' else 'general' end as domain from {_PATHS}")
def project_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domains of projects by aliases of their names."""
    return scope.domain_of(_paths(spark, d), spark.createDataFrame(ALIASES, "name string, domain string"))


_TWINS = f"(select path from {_PATHS} union select '/code' || path from {_PATHS} where path like '/work/%' union select '/old' || path from {_PATHS} where path like '/work/l%')"


@query(f"""with b as (select path, regexp_extract(path, '[^/]*$') as base, regexp_extract(path, '([^/]*)/[^/]*$', 1) as parent from {_TWINS}), f as (select *, path = min(path) over (partition by base) as lead from b),
n as (select path, case when lead then base else concat_ws('-', nullif(parent, ''), base) end as name from f), k as (select *, row_number() over (partition by name order by path) as k from n) select path, case when k = 1 then name else name || '-' || k end as name from k""")
def project_names(spark: SparkSession, d: str) -> DataFrame:
    """Display names of projects of which several end alike, one of its own for each."""
    p = _paths(spark, d)
    under = lambda root, like: p.filter(F.col("path").like(like)).select(F.concat(F.lit(root), "path").alias("path"))
    return scope.display_names(p.union(under("/code", "/work/%")).union(under("/old", "/work/l%")))


@query(f"select arg, case when is_path then arg when n = 1 then one end as path, case when is_path then 1 else coalesce(n, 0) end as matches from (select a.arg, p.path is not null as is_path, m.n, m.one from (select path as arg from {_PATHS} union select regexp_extract(path, '[^/]*$') from {_PATHS} union select 'nowhere') a left join {_PATHS} p on p.path = a.arg left join (select regexp_extract(path, '[^/]*$') as name, count(distinct path) as n, min(path) as one from {_TWINS} group by 1) m on m.name = a.arg)")
def project_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Projects asked for by path or name, of which a name may be that of several."""
    p = _paths(spark, d)
    under = lambda root, like: p.filter(F.col("path").like(like)).select(F.concat(F.lit(root), "path").alias("path"))
    name = F.regexp_extract("path", "[^/]*$", 0)
    projects = p.union(under("/code", "/work/%")).union(under("/old", "/work/l%")).withColumn("name", name)
    asked = p.select(F.col("path").alias("arg")).union(p.select(name.alias("arg"))).union(spark.createDataFrame([("nowhere",)], "arg string"))
    return scope.resolve_projects(asked, projects)


@query(f"with t as (select path as main, unnest([path || '/.trees/a', path || '/.trees/b']) as worktree from {_PATHS}) select main, main < '/work/m' as known, list_sort(list(worktree)) as worktrees from t where main <> '/work/field-almanac' or worktree not like '%/b' group by main")
def worktree_folds(spark: SparkSession, d: str) -> DataFrame:
    """Worktrees found, folded into their main checkouts; one of them is a project of its own."""
    p = _paths(spark, d)
    found = p.select(F.col("path").alias("main"), F.explode(F.array(F.concat("path", F.lit("/.trees/a")), F.concat("path", F.lit("/.trees/b")))).alias("worktree"))
    projects = p.filter("path < '/work/m'").union(spark.createDataFrame([("/work/field-almanac/.trees/b",)], "path string"))
    return scope.fold_worktrees(found, projects)


@query(f"select path, case when path like '%/.trees/a' then left(path, length(path) - 9) when path like '%/.trees/b' then null else path end as project from (select unnest([path, path || '/.trees/a', path || '/.trees/b']) as path from {_PATHS})")
def project_entries(spark: SparkSession, d: str) -> DataFrame:
    """The project of each path, by its own path or by a worktree it lists."""
    p = _paths(spark, d)
    asked = p.select(F.explode(F.array("path", F.concat("path", F.lit("/.trees/a")), F.concat("path", F.lit("/.trees/b")))).alias("path"))
    return scope.entry_for(asked, p.withColumn("worktrees", F.array(F.concat("path", F.lit("/.trees/a")))))


@query("""with asked as (select rel as arg from articles union select upper(title) from articles where title is not null union select replace(rel, 'wiki/', '') from articles where rel like 'wiki/%' union select 'nothing.md'), t as (select lower(trim(title)) as t, min(rel) as rel from articles where title is not null group by 1)
select arg, case when arg like '%.md' and arg in (select rel from articles) then arg when arg like '%.md' and not starts_with(arg, 'wiki/') and 'wiki/' || arg in (select rel from articles) then 'wiki/' || arg else (select rel from t where t.t = lower(trim(arg))) end as rel from asked""")
def article_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Articles asked for by path, by path without its first folder, or by title in other case."""
    a = _articles(spark, d)
    short = a.filter("rel like 'wiki/%'").select(F.replace("rel", F.lit("wiki/"), F.lit("")).alias("arg"))
    asked = a.select(F.col("rel").alias("arg")).union(a.filter("title is not null").select(F.upper("title"))).union(short).union(spark.createDataFrame([("nothing.md",)], "arg string"))
    return scope.resolve_articles(asked, a)


@query(None)
def sections_by_anchor(spark: SparkSession, d: str) -> DataFrame:
    """The second of two sections of one title in each article, asked for by its anchor: rows only, as anchors count up."""
    s = segment.article_sections(_articles(spark, d))
    asked = s.filter(F.col("id").endswith("-2")).select("article_id", F.concat(F.lit("^"), "id").alias("anchor"))
    return scope.section_by_anchor(s, asked).select("article_id", "n", "title")


@query("select folder, count(*) as files from (select regexp_replace(case when contains(rel, '/') then rel else '' end, '/[^/]*$', '') as folder from articles where rel like '%.md') where not regexp_matches('/' || folder || '/', '/(raw|vendor|dist|build)/') and not regexp_matches('/' || folder, '/\\.') group by 1")
def knowledge_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders that hold Markdown, but for excluded ones."""
    return scope.knowledge_folders(_articles(spark, d), exclude=("raw", "vendor", "dist", "build"))


@query("select split_part(case when contains(rel, '/') then rel else '' end, '/', 1) as folder, count(*) as files, cast(sum(strlen(text)) as bigint) as bytes from documents where rel is not null group by 1")
def folder_stats(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes by first folder."""
    return scope.folder_stats(table(spark, d, "documents").filter("rel is not null").select("rel", F.octet_length("text").alias("size")))


@query("select distinct domain from articles where domain <> '' and domain not in ('general', 'infra')")
def unowned_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domains that no owner is named for."""
    return scope.unowned(_articles(spark, d), spark.createDataFrame([("general",), ("infra",)], "domain string"))


@query("select distinct name from (select lower(trim(title)) as name from articles where title is not null union select lower(trim(unnest(tags))) from articles) where name <> ''")
def known_identities(spark: SparkSession, d: str) -> DataFrame:
    """Titles and aliases in lower case."""
    return scope.known_identities(_articles(spark, d).select("title", F.col("tags").alias("aliases")))


@query("select line_id from rollout_lines where payload is null or not json_valid(payload)")
def broken_json(spark: SparkSession, d: str) -> DataFrame:
    """Rollout lines whose payload is no JSON."""
    return scope.broken_json(table(spark, d, "rollout_lines"), "payload", "line_id")


@query("select article_id, regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') as body from articles")
def comparable_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of files without their front matter and an inserted block of context."""
    split = F.concat(M.front_of(F.col("text")), F.lit("---\n"))
    block = F.lit("<!-- retrieval-context -->\n> Context of this page.\n\n")
    file = F.concat(F.lit("---\n"), split, block, F.coalesce("body", F.lit("")))
    return _files(spark, d).select("article_id", scope.comparable_body(file).alias("body"))


@query("select f.fetch_id from fetches f where f.url is null or f.url not in (select url from queue_entries where url is not null)")
def unprocessed_fetches(spark: SparkSession, d: str) -> DataFrame:
    """Fetches of addresses that the queue doesn't name."""
    return scope.unprocessed(table(spark, d, "fetches"), table(spark, d, "queue_entries"), "url").select("fetch_id")


@query("""with e as (select distinct rel as page, lower(trim(t)) as tag from (select rel, unnest(tags) as t from articles) where trim(t) <> ''), k as (select *, row_number() over (partition by tag order by page) as place, count(*) over (partition by tag) as n from e)
select tag, place, page from k where place <= 5 and n > 1""")
def shared_tags(spark: SparkSession, d: str) -> DataFrame:
    """The first five articles of each tag that two or more bear: the report's limit a tag."""
    return scope.sharing_tags(_articles(spark, d)).withColumn("place", F.col("place").cast("bigint"))


@query("select article_id, synced_at from articles where synced_at is not null order by synced_at desc, article_id limit 60")
def newest_articles(spark: SparkSession, d: str) -> DataFrame:
    """The sixty articles synced last: the report's limit."""
    return scope.newest_first(_articles(spark, d).filter("synced_at is not null"), "synced_at", 60, "article_id").select("article_id", "synced_at")


_COUNT = "case when trim(regexp_replace({c}, '\\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' ')) end"


@query("select fetch_id, coalesce(lower(via) = 'stub', false) or " + _COUNT.format(c="coalesce(content, '')") + " < 60 or " + _COUNT.format(c="regexp_replace(coalesce(content, ''), 'https?://\\S+', ' ', 'g')") + " < 20 as stub from fetches")
def fetched_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Whether each fetch is a stub."""
    return table(spark, d, "fetches").select("fetch_id", Q.is_stub(F.col("content"), F.col("via")).alias("stub"))


@query("select article_id from articles where lower(domain) in ('infra', 'audio') or len(list_intersect(list_transform(coalesce(tags, []), lambda x: lower(x)), ['sync', 'notes'])) > 0")
def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    """Articles of subscribed domains or tags."""
    return _articles(spark, d).filter(Q.subscribed(F.col("domain"), F.col("tags"), ["Infra", "audio"], ["Sync", "notes"])).select("article_id")


@query("select doc_id, len(regexp_extract_all(text, '(?i)(?:chose|decided|picked|selected).*(?:because|over|instead)')) as decisions, len(regexp_extract_all(text, '[0-9]+[0-9.]*(?:%|ms|[0-9]s| MB| KB| seconds|x faster|x slower| hours| minutes)')) as quantities, len(regexp_extract_all(text, '(?i)(?:uses|integrates with|depends on|powered by|built with|replaced) [A-Z][a-zA-Z]*')) as tools from documents where text is not null")
def knowledge_scan(spark: SparkSession, d: str) -> DataFrame:
    """How often each document tells of decisions, measurements and tools."""
    a, b, c = Q.knowledge_marks(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", a.cast("bigint").alias("decisions"), b.cast("bigint").alias("quantities"), c.cast("bigint").alias("tools"))


@query("with s as (select article_id, body, regexp_extract_all(body, '(?m)^#{1,3}[ \\t]+(\\S.*?)[ \\t]*\\r?$', 1) as toc from articles where body is not null) select article_id, len(toc) as titles from s where len(toc) > 0")
def chunks_by_contents(spark: SparkSession, d: str) -> DataFrame:
    """Articles cut by a table of contents, which here lists their own headings: as many chapters as titles."""
    toc = F.regexp_extract_all("body", F.lit("(?m)^#{1,3}[ \\t]+(\\S.*?)[ \\t]*\\r?$"), F.lit(1))
    chunks = segment.toc_chunks(_articles(spark, d).filter("body is not null").withColumn("toc", toc))
    return chunks.filter("title <> '(front)' and not title rlike '[(]part ([2-9]|[0-9]{2,})/[0-9]+[)]$'").groupBy("article_id").agg(F.count("*").alias("titles"))


@query("with n as (select rel, count(*) as rows from articles group by 1), s as (select rel, len(regexp_extract_all(body, '(?:^|\\n)#{1,3}[ \\t]+\\S')) as k from articles where body is not null) select rel, k as sections from s join n using (rel) where rows = 1 and k > 0")
def sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Section sidecars written and read back, of paths that one article has: how many sections each lists."""
    path = own_folder(spark, "sidecars")
    once = _articles(spark, d).groupBy("rel").agg(F.count("*").alias("n"), F.max("body").alias("body")).filter("n = 1").drop("n")
    segment.write_sidecars(once, path)
    return segment.fresh_sidecars(spark.read.parquet(path), once).select("rel", F.size("sections").cast("bigint").alias("sections"))
