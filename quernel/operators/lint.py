"""Findings about articles as rows (severity, class, path, message), their counts, and figures of a corpus."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernel.functions.markup import conflict_line
from quernel.functions.paths import base_name, canonical_of_copy, has_placeholder_name, segments

# Bounds of sizes in lines, and the drift of an index that is let pass.
THIN, BLOATED, ROLLING, DRIFT = 15, 150, 200, 3
# What messages about front matter say, by the class of error they are, in order of precedence.
ERROR_CLASSES = (
    ("needs-frontmatter", ("no frontmatter delimiter", "no closing frontmatter delimiter", "invalid YAML frontmatter", "fails struct validation", "empty file")),
    ("needs-title", ("title is empty",)),
    ("needs-confidence", ("invalid confidence",)),
    ("fixable", ("invalid domain", "invalid type", "should be a list", "not in YYYY-MM-DD format")),
)


def line_count(c: Column) -> Column:
    """Lines of a text; a line end at its end opens no further one, and an empty text has none."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(F.regexp_replace(c, "\\n\\z", ""), "\\n")))


def error_class(message: Column) -> Column:
    """Class of a message about front matter: who could repair it."""
    missing = message.contains("missing required fields")
    c = F.when(missing & message.contains("title"), "needs-title").when(missing, "fixable")
    for name, phrases in ERROR_CLASSES:
        c = c.when(reduce(Column.__or__, [message.contains(p) for p in phrases]), name)
    return c.otherwise("other")


def _finding(rows: DataFrame, when: Column, severity: str, name: str, message: Column, path: str) -> DataFrame:
    return rows.filter(F.coalesce(when, F.lit(False))).select(F.lit(severity).alias("severity"), F.lit(name).alias("class"), F.col(path).alias("path"), message.alias("message"))


def size_findings(articles: DataFrame, path: str = "rel", text: str = "text", rolling: Column | None = None, tier: Column | None = None) -> DataFrame:
    """Thin and bloated articles, overgrown rolling ones that are no archive, and articles without an index tier (if tier is given).

    One pass: every article gives an array of findings.
    """
    rows = articles.withColumn("_n", line_count(F.col(text))).withColumn("_r", F.coalesce(rolling, F.lit(False)) if rolling is not None else F.lit(False))
    n, r = F.col("_n"), F.col("_r")
    say = lambda when, name, why: F.when(when, F.struct(F.lit("warn").alias("severity"), F.lit(name).alias("class"), F.concat(n.cast("string"), F.lit(why)).alias("message")))
    each = [
        say(r & (n > ROLLING) & ~base_name(F.col(path)).contains("-archive-"), "rolling-overgrown", " lines"),
        say(~r & (n < THIN), "thin-article", " lines"), say(~r & (n > BLOATED), "bloated-article", " lines"),
    ]
    if tier is not None:
        each.append(say(~r & (F.coalesce(F.trim(tier), F.lit("")) == ""), "index-tier-missing", " lines, no index_tier"))
    return rows.select(F.col(path).alias("path"), F.explode(F.array_compact(F.array(*each))).alias("f")).select("f.severity", "f.class", "path", "f.message")


def artifact_findings(articles: DataFrame, names: Sequence[str] = (), path: str = "rel", text: str = "text") -> DataFrame:
    """Names with a template's mark left in them, copies of a page under its own name (x.md.md, x_md.md beside x.md), folders named as the corpus
    itself (names), and merge conflicts left in a text."""
    p = F.col(path)
    known = articles.select(p.alias("_of")).distinct()
    copies = articles.withColumn("_of", canonical_of_copy(p)).join(known, "_of")
    folders = F.slice(segments(p), F.lit(2), F.greatest(F.size(segments(p)) - 2, F.lit(0)))
    named = F.exists(folders, lambda x: F.lower(x).isin([n.lower() for n in names])) if names else F.lit(False)
    return reduce(DataFrame.unionByName, [
        _finding(articles, has_placeholder_name(p), "error", "placeholder-path", p, path),
        _finding(copies, F.lit(True), "error", "self-ingested-copy", F.concat(F.lit("copy of "), "_of"), path),
        _finding(articles, named, "warn", "self-named-dir", p, path),
        _finding(articles, conflict_line(F.col(text)).isNotNull(), "error", "conflict-marker", F.concat(F.lit("line "), conflict_line(F.col(text)).cast("string")), path),
    ])


def identical_findings(articles: DataFrame, path: str = "rel", text: str = "text") -> DataFrame:
    """Files of the same bytes as one that is kept: the one of the least depth, then of the smallest path. keep, path, copies.

    The one to keep is a minimum taken before the shuffle, so a text that a third of all files share is no hot group.
    """
    each = articles.select(F.col(path).alias("path"), F.sha2(text, 256).alias("h")).filter("h is not null")
    rank = F.struct((F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).alias("depth"), F.col("path").alias("keep"))
    kept = each.groupBy("h").agg(F.min(rank).alias("k"), F.count("*").alias("copies")).filter("copies > 1")
    return each.join(kept, "h").filter("path <> k.keep").select("k.keep", "path", "copies")


def class_counts(findings: DataFrame) -> DataFrame:
    """Findings by severity and class, most first, then by name."""
    return findings.groupBy("severity", "class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class")


def orphan_counts(titles: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: titles to which nothing links, and different targets that are no title."""
    t, d = titles.select("title").filter("title is not null").distinct(), edges.select(F.col("dst").alias("title")).distinct()
    both = t.withColumn("a", F.lit(1)).join(d.withColumn("b", F.lit(1)), "title", "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("orphans"), F.count_if(F.col("a").isNull()).alias("missing"))


def index_drift(index_text: DataFrame, articles: DataFrame, text: str = "text", drift: int = DRIFT) -> DataFrame:
    """One row: entries of an index (lines that begin with a listed link), articles there are, and whether they differ by more than drift."""
    entries = F.size(F.filter(F.split(F.col(text), "\\n"), lambda x: x.startswith("- [[")))
    listed, there = index_text.agg(F.coalesce(F.sum(entries), F.lit(0)).alias("entries")), articles.agg(F.count("*").alias("articles"))
    return listed.join(there, F.lit(True)).withColumn("drifted", F.abs(F.col("articles") - F.col("entries")) > drift)  # a row each


def scoreboard(articles: DataFrame, density: Column, has_front: Column) -> DataFrame:
    """Articles by density (a missing one counts as unknown), with how many of them have no front matter."""
    return articles.groupBy(F.coalesce(F.when(F.trim(density) != "", density), F.lit("unknown")).alias("density")).agg(F.count("*").alias("articles"), F.count_if(~has_front).alias("bare"))


def duplicate_report(exact: DataFrame, near: DataFrame, most: int = 150) -> DataFrame:
    """The report's lines: pairs of near duplicates by overlap, then by name, cut to its own limit, each with its place; and how many classes of copies there are.

    exact has class_id and copies; near has a, b, jaccard, overlap.
    """
    top = near.orderBy(F.desc("overlap"), "a", "b").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("overlap"), "a", "b"))  # the report's limit bounds it
    classes = exact.filter("copies > 1").agg(F.count_distinct("class_id").alias("classes"))
    return top.withColumn("place", place).join(classes, F.lit(True)).select("place", "a", "b", "jaccard", "overlap", "classes")
