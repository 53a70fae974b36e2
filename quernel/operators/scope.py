"""What belongs to a corpus: projects and their names, domains, worktrees, articles found by path or title, files that are new or changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernel.functions.frontmatter import body_of
from quernel.functions.paths import base_name, folder
from quernel.operators.ordering import numbered


def domain_of(projects: DataFrame, aliases: DataFrame, path: str = "path", default: str = "general") -> DataFrame:
    """Adds domain: by an alias (name, domain) of the path's last segment, else of its last two, else the default.

    aliases must hold a name once; a path that is null has the default.
    """
    name = base_name(F.col(path))
    pair = F.concat_ws("/", base_name(folder(F.col(path))), name)
    one, two = aliases.select(F.col("name").alias("_n1"), F.col("domain").alias("_d1")), aliases.select(F.col("name").alias("_n2"), F.col("domain").alias("_d2"))
    joined = projects.withColumn("_n1", name).withColumn("_n2", pair).join(one, "_n1", "left").join(two, "_n2", "left")
    return joined.select(*projects.columns, F.coalesce("_d1", "_d2", F.lit(default)).alias("domain"))


def entry_for(paths: DataFrame, projects: DataFrame, path: str = "path") -> DataFrame:
    """Adds project (null if none): the path of the project that a path is, or else of the one, by path the first, that lists it as a worktree.

    projects has path and worktrees (an array).
    """
    own = projects.select(F.col("path").alias("_p"), F.col("path").alias("_own")).distinct()
    trees = projects.select(F.explode("worktrees").alias("_p"), F.col("path").alias("_of")).groupBy("_p").agg(F.min("_of").alias("_of"))
    joined = paths.withColumn("_p", F.col(path)).join(own, "_p", "left").join(trees, "_p", "left")
    return joined.select(*paths.columns, F.coalesce("_own", "_of").alias("project"))


def fold_worktrees(found: DataFrame, projects: DataFrame) -> DataFrame:
    """Checkouts found (worktree, main), folded: main, known, worktrees (different ones in order), one row per main checkout.

    A worktree that is a project of its own is left alone; known tells a project from one discovered by its worktree.
    """
    mine = projects.select(F.col("path").alias("worktree"))
    main = projects.select(F.col("path").alias("main"), F.lit(True).alias("_k")).distinct()
    each = found.filter("worktree is not null and main is not null and worktree <> main").join(mine, "worktree", "left_anti").select("main", "worktree").distinct()
    folded = each.groupBy("main").agg(F.array_sort(F.collect_list("worktree")).alias("worktrees"))
    return folded.join(main, "main", "left").select("main", F.coalesce("_k", F.lit(False)).alias("known"), "worktrees")


def display_names(projects: DataFrame, path: str = "path") -> DataFrame:
    """Adds name, one of its own for each path: the last segment; of paths that share it all but the first get their folder's before it; of those that still
    collide all but the first get -2, -3, ... by order of path.
    """
    base = base_name(F.col(path))
    first = projects.withColumn("_b", base).groupBy("_b").agg(F.min(path).alias("_first"))
    one = projects.withColumn("_b", base).join(first, "_b")
    name = F.when(F.col(path) == F.col("_first"), F.col("_b")).otherwise(F.concat_ws("-", F.when(base_name(folder(F.col(path))) != "", base_name(folder(F.col(path)))), "_b"))
    named = numbered(one.withColumn("_n", name).select(*projects.columns, "_n"), ["_n"], [path], "_k")
    return named.select(*projects.columns, F.when(F.col("_k") == 1, F.col("_n")).otherwise(F.concat_ws("-", "_n", F.col("_k").cast("string"))).alias("name"))


def resolve_projects(asked: DataFrame, projects: DataFrame) -> DataFrame:
    """asked (arg), answered: arg, path (null if none or several), matches. What has a slash is a path first; else, and if no path is so called, it is a name.

    projects has path and name.
    """
    looks_like_path = F.col("arg").contains("/") | F.col("arg").startswith("~") | F.col("arg").isin(".", "..")
    by_path = projects.select(F.col("path").alias("arg"), F.lit(True).alias("_is")).distinct()
    by_name = projects.groupBy(F.col("name").alias("arg")).agg(F.min("path").alias("_one"), F.count_distinct("path").alias("_n"))
    j = asked.select("arg").distinct().join(by_path, "arg", "left").join(by_name, "arg", "left")
    direct = looks_like_path & F.coalesce("_is", F.lit(False))
    n = F.when(direct, 1).otherwise(F.coalesce("_n", F.lit(0)))
    return j.select("arg", F.when(direct, F.col("arg")).when(F.col("_n") == 1, F.col("_one")).alias("path"), n.cast("bigint").alias("matches"))


def resolve_articles(asked: DataFrame, articles: DataFrame, prefix: str = "wiki/") -> DataFrame:
    """asked (arg), answered: arg, rel. An arg that ends in .md is a path, or one under prefix; else, or if there is none, a title whatever its case, of
    several articles the first by path. articles has rel and title. An arg that nothing answers comes with null.
    """
    a = asked.select("arg").distinct().withColumn("_t", F.lower(F.trim("arg")))
    rel = articles.select(F.col("rel").alias("_p"), F.lit(True).alias("_is")).distinct()
    titles = articles.filter("title is not null").groupBy(F.lower(F.trim("title")).alias("_t")).agg(F.min("rel").alias("_titled"))
    is_path = F.col("arg").endswith(".md")
    j = a.withColumn("_p", F.when(is_path, F.col("arg"))).join(rel.withColumnRenamed("_is", "_direct"), "_p", "left").drop("_p")
    j = j.withColumn("_p", F.when(is_path & ~F.col("arg").startswith(prefix), F.concat(F.lit(prefix), F.col("arg")))).join(rel.withColumnRenamed("_is", "_under"), "_p", "left")
    j = j.join(titles, "_t", "left")
    return j.select("arg", F.when(F.col("_direct"), F.col("arg")).when(F.col("_under"), F.col("_p")).otherwise(F.col("_titled")).alias("rel"))


def section_by_anchor(sections: DataFrame, asked: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Sections (of article_sections) that asked (id, anchor) names; a ^ or # before the anchor is let pass."""
    want = asked.select(id_col, F.regexp_replace("anchor", "^[#^]", "").alias("id")).distinct()
    return sections.join(want, [id_col, "id"], "left_semi")


def knowledge_folders(files: DataFrame, path: str = "rel", exclude: tuple[str, ...] = ("node_modules", "vendor", "dist", "build")) -> DataFrame:
    """folder, files: folders that hold Markdown, without those in or under an excluded or a hidden one."""
    p = F.col(path)
    parts = F.split(folder(p), "/")
    hidden = F.exists(parts, lambda x: x.isin(*exclude) | x.startswith("."))
    return files.filter(p.endswith(".md") & ~hidden).groupBy(folder(p).alias("folder")).agg(F.count("*").alias("files"))


def listed_folders(c: Column) -> Column:
    """Folders of a comma-separated list, trimmed, different ones, blank ones left out."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def newer_than(files: DataFrame, modified: str, cutoff: str | None) -> DataFrame:
    """Files modified after a cutoff (an instant as text). No cutoff: all; one that can't be read: none."""
    if not cutoff:
        return files
    return files.filter(F.coalesce(F.col(modified) > F.lit(cutoff).try_cast("timestamp"), F.lit(False)))


def comparable_body(c: Column, marker: str = "<!-- retrieval-context -->") -> Column:
    """A text without its front matter and the block that a marker opens and a blank line ends, trimmed: for telling whether a source really changed."""
    body = body_of(c)
    at = F.instr(body, marker)
    after = F.substr(body, at + len(marker))
    end = F.instr(after, "\n\n")
    rest = F.when(end > 0, F.substr(after, end + 2)).otherwise("")
    return F.regexp_replace(F.when(at > 0, F.concat(F.substr(body, F.lit(1), at - 1), rest)).otherwise(body), "^\\s+|\\s+$", "")


def changed_paths(*lists: DataFrame, path: str = "path") -> DataFrame:
    """Markdown paths of any of the lists (changed, staged, untracked), each once."""
    return reduce(DataFrame.unionByName, [x.select(path) for x in lists]).filter(F.col(path).endswith(".md")).distinct()


def unprocessed(raw: DataFrame, log: DataFrame, key: str, marked: Column | None = None) -> DataFrame:
    """Raw items that no log entry names and, if marked is given, that bear no mark themselves."""
    rows = raw if marked is None else raw.filter(~F.coalesce(marked, F.lit(False)))
    return rows.join(log.select(key).distinct(), key, "left_anti")


def known_identities(people: DataFrame) -> DataFrame:
    """name: titles and aliases of people (title, aliases) in lower case, each once."""
    names = F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return people.select(names.alias("n")).select(F.lower(F.trim("n")).alias("name")).filter("name <> ''").distinct()


def unowned(domains: DataFrame, owners: DataFrame, key: str = "domain") -> DataFrame:
    """Domains in use that no owner is named for."""
    return domains.select(key).filter(F.col(key).isNotNull() & (F.col(key) != "")).distinct().join(owners.select(key), key, "left_anti")


def folder_stats(files: DataFrame, path: str = "rel", size: str = "size", depth: int = 1) -> DataFrame:
    """folder (the first segments of the path, so many), files, bytes."""
    top = F.array_join(F.slice(F.split(folder(F.col(path)), "/"), 1, depth), "/")
    return files.groupBy(top.alias("folder")).agg(F.count("*").alias("files"), F.sum(size).cast("bigint").alias("bytes"))


def broken_json(files: DataFrame, text: str, path: str) -> DataFrame:
    """Paths whose text is no JSON; a blank text is broken too."""
    return files.filter(F.try_parse_json(F.col(text)).isNull()).select(path)


def identity_blocks(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Blocks of proposals: per level-3 heading its name, and the items of lines "key: a, b" below it as a map; columns of bodies stay, n counts from 1.

    A heading without a line that says anything is left out.
    """
    cut = F.slice(F.split(F.concat(F.lit("\n"), F.regexp_replace(F.col(body), "\\r", "")), "\\n###[ \\t]+"), 2, 1_000_000_000)
    rows = bodies.select(*bodies.columns, F.posexplode(cut).alias("_n", "_b"))
    lines = F.filter(F.slice(F.split("_b", "\\n"), 2, 1_000_000_000), lambda x: x.rlike("^\\s*(?:[-*]\\s+)?\\*{0,2}[A-Za-z_]+\\*{0,2}:\\s*\\S"))
    pair = lambda x: F.struct(F.lower(F.regexp_extract(x, "^\\s*(?:[-*]\\s+)?\\*{0,2}([A-Za-z_]+)", 1)).alias("k"), F.filter(F.transform(F.split(F.regexp_extract(x, ":\\**\\s*(.*)$", 1), ","), lambda y: F.trim(y)), lambda y: y != "").alias("v"))
    said = F.transform(lines, pair)
    keep = F.aggregate(said, F.create_map().cast("map<string,array<string>>"), lambda m, x: F.when(F.map_contains_key(m, x["k"]), m).otherwise(F.map_concat(m, F.create_map(x["k"], x["v"]))))
    return rows.select(*bodies.columns, (F.col("_n") + 1).alias("n"), F.trim(F.get(F.split("_b", "\\n"), F.lit(0))).alias("name"), keep.alias("fields")).filter(F.size("fields") > 0)


def newest_first(rows: DataFrame, order: str, most: int, tie: str, since: str | None = None) -> DataFrame:
    """The newest rows, so many (0: all), from an instant on if it is given: a report's own limit."""
    kept = rows if since is None else rows.filter(F.coalesce(F.col(order) >= F.lit(since), F.lit(False)))
    ranked = kept.orderBy(F.col(order).desc_nulls_last(), tie)
    return ranked.limit(most) if most else ranked


def sharing_tags(articles: DataFrame, page: str = "rel", most: int = 5) -> DataFrame:
    """tag, place, page: the first pages, so many, of each tag that two or more bear; the report's own limit a tag.

    A tag that any share of the pages bears is cut to its first pages before anything is ordered.
    """
    each = articles.select(F.col(page).alias("page"), F.explode(F.transform("tags", lambda x: F.lower(F.trim(x)))).alias("tag")).filter("tag <> ''").distinct()
    part = F.pmod(F.xxhash64("page"), F.lit(256))
    w = lambda *by: Window.partitionBy(*by).orderBy("page")
    few = each.withColumn("_part", part).withColumn("_k", F.row_number().over(w("tag", "_part"))).filter(F.col("_k") <= most)
    top = few.withColumn("place", F.row_number().over(w("tag"))).filter(F.col("place") <= most)
    shared = each.groupBy("tag").agg(F.count("*").alias("_n")).filter("_n > 1")
    return top.join(shared, "tag", "left_semi").select("tag", "place", "page")
