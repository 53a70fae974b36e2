"""Typed relations between articles: edges from front matter, those not allowed, neighbourhoods, what still waits to be typed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quernel.functions.frontmatter import RELATIONS

# Relations allowed by type of article, and the inverse of each that has one.
ALLOWED = {
    "decision": ("supersedes", "superseded_by", "contradicts", "instance_of", "specializes"),
    "solution": ("applies_to", "derived_from", "instance_of", "specializes"),
    "pattern": ("instance_of", "specializes", "applies_to"),
    "research": ("extends", "cited_by", "informs", "instance_of", "specializes"),
    "tool": ("derived_from", "instance_of", "specializes"),
    "project": ("instance_of", "specializes"),
    "person": (),
    "idea": ("instance_of", "specializes"),
}
INVERSE = {"supersedes": "superseded_by", "superseded_by": "supersedes", "contradicts": "contradicts", "instance_of": "specializes", "specializes": "instance_of"}


def link_target(c: Column) -> Column:
    """The title in a link: brackets and what is shown for it dropped."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), "^\\[\\[", ""), "\\]\\]$", "")
    return F.when(t.contains("|"), F.substring_index(t, "|", 1)).otherwise(t)


def typed_edges(articles: DataFrame, fields: str = "fields", src: str = "rel") -> DataFrame:
    """src, kind, dst: one row per typed relation that an article's fields (``front_fields``) state; repeated ones stay."""
    def edges(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(f"{fields}.{kind}"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), link_target(x).alias("dst")))

    return articles.select(F.col(src).alias("src"), F.explode(F.flatten(F.array(*map(edges, RELATIONS)))).alias("e")).select("src", "e.kind", "e.dst").filter("dst <> ''")


def not_allowed(edges: DataFrame, types: DataFrame, allowed: Mapping[str, Sequence[str]] = ALLOWED) -> DataFrame:
    """Edges of a kind that the type of their article doesn't allow: src, type, kind, dst. A blank type allows all, an unknown one none.

    types has src and type, one row a source.
    """
    lists = F.create_map(*[x for t, ks in allowed.items() for x in (F.lit(t), F.array(*map(F.lit, ks)).cast("array<string>"))])
    known = F.coalesce(F.try_element_at(lists, F.col("type")), F.array().cast("array<string>"))
    ok = (F.coalesce(F.col("type"), F.lit("")) == "") | F.array_contains(known, F.col("kind"))
    return edges.join(types.select("src", "type"), "src").filter(~ok).select("src", "type", "kind", "dst")


def neighbourhoods(edges: DataFrame, titles: DataFrame) -> DataFrame:
    """page, direction (out or in), kind, other: the relations of every page, those to it by its title whatever the case.

    titles has page and title. Edges of a page to its own title are outbound only.
    """
    out = edges.select(F.col("src").alias("page"), F.lit("out").alias("direction"), "kind", F.col("dst").alias("other"))
    named = titles.filter("title is not null").select("page", F.lower("title").alias("_t"))
    into = edges.withColumn("_t", F.lower("dst")).join(named, "_t").filter("src <> page").select("page", F.lit("in").alias("direction"), "kind", F.col("src").alias("other"))
    return out.unionByName(into)


def untyped_candidates(articles: DataFrame, sidecars: DataFrame, fields: str = "fields", src: str = "rel") -> DataFrame:
    """src, targets: articles with untyped links (related) that aren't locked and have no sidecar of just these links.

    sidecars has src and targets (as an array).
    """
    links = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(f"{fields}.related"), F.array().cast("array<string>")), link_target), lambda x: x != ""))
    open_ = articles.filter(~F.coalesce(F.col(f"{fields}.relations_locked"), F.lit(False))).select(F.col(src).alias("src"), links.alias("targets")).filter(F.size("targets") > 0)
    fresh = sidecars.select("src", F.array_sort("targets").alias("_t"))
    return open_.withColumn("_t", F.array_sort("targets")).join(fresh, ["src", "_t"], "left_anti").select("src", "targets")


def resolved(ledger: DataFrame, notes: DataFrame, at: str) -> DataFrame:
    """A ledger of pairs with resolved_at and note set where notes (id, note) names them; others keep theirs."""
    had = lambda c: F.col(c) if c in ledger.columns else F.lit(None).cast("string")
    joined = ledger.join(notes.groupBy("id").agg(F.max("note").alias("_note")), "id", "left")
    named = F.col("_note").isNotNull()
    rest = [c for c in ledger.columns if c not in ("resolved_at", "note")]
    return joined.select(*rest, F.when(named, F.lit(at)).otherwise(had("resolved_at")).alias("resolved_at"), F.when(named, F.col("_note")).otherwise(had("note")).alias("note"))


def any_of(columns: Sequence[Column]) -> Column:
    """Whether any of the conditions holds; null counts as no."""
    return reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in columns], F.lit(False))
