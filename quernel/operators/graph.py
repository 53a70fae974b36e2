"""The link graph of articles: edges, backlinks, orphans, missing pages, hosts for orphans, typed edges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from quernel.functions.text import wikilinks
from quernel.session import checkpointed


def link_edges(articles: DataFrame, src: str = "rel", body: str = "body") -> DataFrame:
    """src, dst: one row per different link of each article."""
    return articles.select(F.col(src).alias("src"), F.explode(wikilinks(F.col(body))).alias("dst")).distinct()


def backlinks(edges: DataFrame, titles: DataFrame) -> DataFrame:
    """title, sources, inbound: who links to each title that is linked, leaving out links of an article to its own title.

    edges has src and dst, titles has src and title. Sources are in order. The list of a target is as long as its in-degree;
    ``inbound`` of ``link_degrees`` is the count without a list, for targets of any degree.
    """
    foreign = edges.join(titles, "src", "left").filter(~F.col("title").eqNullSafe(F.col("dst")))
    return foreign.groupBy(F.col("dst").alias("title")).agg(F.array_sort(F.collect_set("src")).alias("sources"), F.count_distinct("src").alias("inbound"))


def link_degrees(edges: DataFrame) -> DataFrame:
    """page, inbound, outbound of every page that has a link either way."""
    out = edges.groupBy(F.col("src").alias("page")).agg(F.count("*").alias("outbound"))
    into = edges.groupBy(F.col("dst").alias("page")).agg(F.count("*").alias("inbound"))
    return out.join(into, "page", "full_outer").select("page", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"))


def orphans(titles: DataFrame, edges: DataFrame) -> DataFrame:
    """Titles (and aliases, if titles lists them) to which nothing links."""
    return titles.select("title").filter("title is not null").distinct().join(edges.select(F.col("dst").alias("title")), "title", "left_anti")


def missing_pages(titles: DataFrame, edges: DataFrame) -> DataFrame:
    """Linked targets that are no title, with how many pages link to them."""
    return edges.join(titles.select(F.col("title").alias("dst")), "dst", "left_anti").groupBy(F.col("dst").alias("target")).agg(F.count_distinct("src").alias("sources"))


BLANKS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SMALL_WORDS = "with from that this into when what where which their them they your about over under more most some than then have been were will would should could".split()


def title_hits(orphan: DataFrame, hosts: DataFrame, first: int = 2500) -> DataFrame:
    """orphan, host, hits: words of an orphan's title (4 bytes or more, no small words) that stand in the first bytes of a host's body, as often as the title has them.

    orphan has page and title, hosts has page and body. A word stands in a body also as part of another. Titles' words have no blanks, so they
    are sought once in each different word of the bodies: candidates share up to four characters, then the whole is looked for.
    """
    word = F.btrim(F.col("w"), F.lit(".,;:!?()[]{}\"'`"))
    said = orphan.select(F.col("page").alias("orphan"), F.explode(F.split(F.lower("title"), BLANKS)).alias("w")).select("orphan", word.alias("term"))
    said = said.filter((F.octet_length("term") >= 4) & ~F.col("term").isin(SMALL_WORDS)).groupBy("orphan", "term").agg(F.count("*").alias("n"))
    head = F.substring(F.col("body").cast("binary"), 1, first).cast("string")
    held = hosts.select(F.col("page").alias("host"), F.explode(F.array_distinct(F.split(F.lower(head), BLANKS))).alias("word")).filter(F.octet_length("word") >= 4)
    starts = F.sequence(F.lit(1), F.length("word"))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.substr(F.col("word"), i, k)))))
    words = held.select("word").distinct().select("word", F.explode(grams).alias("gram"))
    terms = said.select("term", F.substring("term", 1, 4).alias("gram")).distinct()
    within = words.join(terms, "gram").filter(F.contains("word", "term")).select("term", "word")
    found = held.join(within, "word").select("term", "host").distinct()
    return found.join(said, "term").filter("orphan <> host").groupBy("orphan", "host").agg(F.sum("n").alias("hits"))


def host_scores(
    orphan: DataFrame, hosts: DataFrame, tag_weight: int = 3, domain_weight: int = 5, general: str = "general", least: int = 6, term_weight: int = 2, overview_weight: int = 4
) -> DataFrame:
    """orphan, host, score: pages that an orphan could be linked from, by shared tags, domain, words of its title and overviews.

    Both tables have page, tags and domain. Words of the title count (``title_hits``) if orphan has title and hosts has body, overview pages if
    hosts has rel. A domain or an overview can't reach ``least`` alone, so candidates share a tag or a word of the title, or are
    overviews of the same domain; pass a lower least only with tags enough to tell pages apart.
    """
    overviews = "rel" in hosts.columns
    if least <= max(domain_weight, overview_weight * overviews):
        raise ValueError("least must be above the weights of the domain and of overviews, or all pages of either are candidates")
    tags = lambda df, name: df.select(F.col("page").alias(name), F.explode(F.array_distinct(F.transform("tags", lambda x: F.lower(F.trim(x))))).alias("tag"))
    zero = F.lit(0).cast("bigint")
    overview = F.col("rel").endswith("/overview.md") if overviews else F.lit(False)
    a = orphan.select(F.col("page").alias("orphan"), F.col("domain").alias("a"))
    b = hosts.select(F.col("page").alias("host"), F.col("domain").alias("b"), F.coalesce(overview, F.lit(False)).alias("overview"))
    same = (F.col("a") == F.col("b")) & ~F.col("a").isin(general, "")
    points = tags(orphan, "orphan").join(tags(hosts, "host"), "tag").filter("orphan <> host").groupBy("orphan", "host").agg((F.count("*") * tag_weight).alias("points"))
    if "title" in orphan.columns and "body" in hosts.columns:
        points = points.unionByName(title_hits(orphan, hosts).select("orphan", "host", (F.col("hits") * term_weight).alias("points")))
    if overviews:
        points = points.unionByName(a.join(b.filter("overview"), same & (F.col("orphan") != F.col("host"))).select("orphan", "host", zero.alias("points")))
    both = points.groupBy("orphan", "host").agg(F.sum("points").alias("points")).join(a, "orphan").join(b, "host")
    score = F.col("points") + F.when(same, domain_weight).otherwise(0) + F.when(F.col("overview"), overview_weight).otherwise(0)
    return both.select("orphan", "host", score.cast("bigint").alias("score")).filter(F.col("score") >= least)


def shared_neighbours(edges: DataFrame, least: int = 2) -> DataFrame:
    """a, b, shared: pages that link to at least so many of the same targets, each pair once.

    Pages that share ``least`` targets share one of all but the last least - 1 of each page's targets in an order from seldom to often linked. So a
    page is met through its seldom linked targets, and one that a large share of pages links to brings pairs together only where nothing else
    could. What meets is then counted over whole lists.
    """
    e = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    often = e.groupBy("dst").agg(F.count("*").alias("n")).filter("n > 1")
    lists = e.join(often, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("n", "dst"))).alias("x")).filter(F.size("x") >= least)
    lists = checkpointed(lists.select("src", F.transform("x", lambda s: s["dst"]).alias("targets")))
    met = lists.select("src", F.explode(F.slice("targets", F.lit(1), F.size("targets") - (least - 1))).alias("dst"))
    pairs = met.select(F.col("src").alias("a"), "dst").join(met.select(F.col("src").alias("b"), "dst"), "dst").filter("a < b").select("a", "b").distinct()
    side = lambda n: lists.select(F.col("src").alias(n), F.col("targets").alias(f"t{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("bigint").alias("shared")).filter(F.col("shared") >= least)


def missing_inverse(edges: DataFrame, inverse: Mapping[str, str]) -> DataFrame:
    """Typed edges (src, kind, dst) whose kind has an inverse that the target doesn't state."""
    kinds = F.create_map(*[F.lit(x) for pair in inverse.items() for x in pair])
    wanted = edges.withColumn("inverse", kinds[F.col("kind")]).filter("inverse is not null")
    stated = edges.select(F.col("src").alias("dst"), F.col("kind").alias("inverse"), F.col("dst").alias("src"))
    return wanted.join(stated, ["src", "inverse", "dst"], "left_anti").select("src", "kind", "dst", "inverse")


def pair_ledger(edges: DataFrame, prior: DataFrame, as_of: str) -> DataFrame:
    """Unordered pairs of a symmetric edge: first, second, sources, and when they were first seen, kept from the prior ledger.

    edges has src, a, b (an edge between a and b stated by src); prior has first, second, first_observed.
    """
    now = edges.groupBy(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second")).agg(F.array_sort(F.collect_set("src")).alias("sources"))
    kept = prior.select("first", "second", "first_observed")
    return now.join(kept, ["first", "second"], "left").select("first", "second", "sources", F.coalesce("first_observed", F.lit(as_of)).alias("first_observed"))
