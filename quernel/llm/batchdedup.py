"""Checks each new batch of queued pages against everything accepted before it.

Two entries repeat each other if their addresses lead to the same page or if their notes share at least half of
their word triples. Entries count in order of id: one that repeats no accepted entry is accepted, any other isn't.

The history is kept as tables (``History``), to which a batch only adds rows:

* ``entries``: entry_id, page key and set of each accepted entry;
* ``notes``: each different set of triples once, named by the first entry that had it, with its distances to fixed pivots;
* ``postings``: the prefix of each set in one order of triples, the index a new batch probes;
* ``order``: that order, rare triples first, so that triples that many notes share don't bring all of them together. An index
  loses nothing under any order that both sides use, so it may be out of date; it is made anew when the sets have grown
  threefold, lest triples that became common since count as rare.

A batch of few keys is sent to the stored tables, which are read where they lie; a large one is joined.

Pivots and distances. The metric is the size of the symmetric difference of two sets; the pivots are the empty set
and, for k hash classes, the set of all triples of the class. The distance of a set to a pivot is then known up to a
constant from how many of its triples are in the class, and by the triangle inequality the classes' differences add up to a
lower bound of the distance between two sets. Jaccard of at least t means a distance of at most
(1-t)/(1+t) * (|A|+|B|), so a pair beyond this bound is pruned before its sets are fetched; what is left is verified.

Pivot distances alone don't bring candidates together: at this radius nearly every pair of notes passes every single
pivot's range (see the README for figures), so a join on ranges would be a join of all pairs. Candidates therefore
come from the prefixes (two sets that similar share a triple among the first n - ceil(t*n) + 1 of each in one order,
which loses nothing); the pivots prune them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quernel.session import checkpointed

PIVOTS = 16
#: So many keys of a batch, some dozens of bytes each, are sent to every executor; beyond that, joins shuffle.
FEW = 100_000
# Parameters that only record where a click came from.
TRACKING = frozenset(
    """fbclid gclid gclsrc dclid gbraid wbraid igshid igsh mc_cid mc_eid msclkid yclid twclid ttclid li_fat_id _hsenc _hsmi __hssc
    __hstc hsctatracking mkt_tok vero_id vero_conv oly_anon_id oly_enc_id s_cid ncid cmpid wt_mc spm _ga _gl _openstat srsltid epik""".split()
)
TRACKING_PREFIXES = ("utm_", "pk_", "mtm_", "piwik_", "hsa_")
# Parameters in which a redirecting address holds the one it leads to, and the paths of such addresses.
CARRIERS = ("url", "to", "u", "q", "target", "dest", "destination", "redirect", "redirect_url", "redirect_uri", "link", "goto", "out")
RELAYS = frozenset(["", "/", "/r", "/url", "/out", "/go", "/link", "/redirect", "/away", "/l.php", "/l", "/jump", "/to", "/click"])
INDEX_PAGE = re.compile("/(?:index|default)\\.(?:html?|php|aspx?|jsp)$", re.I)
UNRESERVED = re.compile("%([0-9A-Fa-f]{2})")


def _plain(s: str) -> str:
    """Percent-escapes in one form: unreserved characters bare, all others in upper case."""

    def one(m: re.Match) -> str:
        ch = chr(int(m.group(1), 16))
        return ch if ch.isascii() and (ch.isalnum() or ch in "-._~") else m.group(0).upper()

    return quote(UNRESERVED.sub(one, s), safe="/:@!$&'()*+,;=~%[]|^{}<>\"\\` #?")


def page_key(url: str | None, depth: int = 0) -> str | None:
    """What selects the page in an address; None for a null or blank one.

    Left out: scheme (a page is taken to be the same under http and https), case and default port of the host, www. and the names of mobile
    versions (m., mobile., amp.) before a host of two parts or more, user names, relays that carry the address in a parameter (also a front
    page, though not by its q, which is a search), repeated slashes, dot segments, index pages, trailing slashes, order and repetition of parameters,
    tracking parameters and fragments within a page. Kept: path case, all other parameters and routes in the fragment.
    """
    if url is None:
        return None
    u = url.strip().strip("<>\"'“”").strip()
    if not u:
        return None
    if u.startswith("//"):
        u = "https:" + u
    if "://" not in u[:12] and re.match("[\\w-]+(\\.[\\w-]+)+([/:?#]|$)", u):
        u = "https://" + u
    try:
        parts = urlsplit(re.sub("[\t\r\n]", "", u))
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return u
    if not host:
        return u
    query = [p for p in re.split("[&]", parts.query.replace("&amp;", "&")) if p]
    if depth < 5 and parts.path.rstrip("/").lower() in RELAYS:
        for p in query:
            name, _, value = p.partition("=")
            if name.lower() in CARRIERS and not (name.lower() == "q" and parts.path.strip("/") == ""):
                inner = unquote(value)
                while inner != (again := unquote(inner)) and not re.match("https?://", inner, re.I):
                    inner = again
                if re.match("https?://", inner, re.I):
                    return page_key(inner, depth + 1)
    for prefix in ("www.", "m.", "mobile.", "amp."):
        while host.startswith(prefix) and host.count(".") > 1:
            host = host[len(prefix) :]
    try:
        host = host.encode("idna").decode() if not host.isascii() else host
    except UnicodeError:
        pass
    if port not in (None, 80, 443):
        host += f":{port}"
    path: list[str] = []
    for seg in _plain(parts.path).split("/"):
        if seg == "..":
            path[-1:] = []
        elif seg and seg != ".":
            path.append(seg)
    joined = INDEX_PAGE.sub("", "/" + "/".join(path)).rstrip("/")
    kept = set()
    for p in query:
        name, eq, value = p.partition("=")
        low = name.lower()
        if low in TRACKING or low.startswith(TRACKING_PREFIXES):
            continue
        kept.add(_plain(name.replace("+", "%20")) + eq + _plain(value.replace("+", "%20")))
    key = host + joined + ("?" + "&".join(sorted(kept)) if kept else "")
    frag = parts.fragment
    if frag.startswith(("!", "/")):
        key += "#" + _plain(frag.rstrip("/"))
    return key


@F.pandas_udf(T.StringType())
def _page_key(urls: pd.Series) -> pd.Series:
    return urls.map(page_key, na_action="ignore")


@dataclass
class History:
    """What has been accepted so far; see the module's text. ``added`` has the rows of the last batch by table.

    ``made_of`` is the number of sets that the order was made of, ``sets`` that of all sets; ``version`` names the index on disk.
    """

    entries: DataFrame
    notes: DataFrame
    postings: DataFrame
    order: DataFrame
    added: dict[str, DataFrame] = field(default_factory=dict)
    made_of: int = 0
    sets: int = 0
    version: int = 0

    def append(self, path: str, batch: str) -> None:
        """Writes the last batch's rows under path, as folders of their own; written again, they replace themselves.

        Rows lie sorted by the key that later batches look up, so row groups without a wanted key are passed over. An index
        made anew is a version of its own; its size is written last, and only a version that has one is ever opened.
        """
        keys = {"entries": "entry_id", "notes": "key", "postings": "t", "order": "t"}
        for name, rows in self.added.items():
            folder = f"{path}/{name}" if name in ("entries", "notes") else f"{path}/{name}-{self.version}"
            rows.sortWithinPartitions(keys[name]).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        spark = self.entries.sparkSession
        spark.createDataFrame([(self.version, self.made_of, self.sets)], "version int, made_of bigint, sets bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes/batch={batch}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The history written under path. A batch whose keys are few enough to be broadcast probes it without a shuffle of the history."""
        last = spark.read.parquet(f"{path}/sizes").agg(F.max_by(F.struct("version", "made_of", "sets"), F.struct("version", "sets")).alias("x")).select("x.*").first()
        read = lambda name: spark.read.parquet(f"{path}/{name}").drop("batch")
        return cls(read("entries"), read("notes"), read(f"postings-{last.version}"), read(f"order-{last.version}"), {}, last.made_of, last.sets, last.version)


def _keyed(batch: DataFrame, id_col: str, url_col: str, note_col: str, least_words: int) -> DataFrame:
    """entry_id, page key, the note's distinct triples (null if it is too short) and a digest of that set."""
    text = F.regexp_replace(F.lower(F.col(note_col)), "[^a-z0-9]+", " ")
    words = F.split(F.trim(text), " ")
    rows = batch.select(F.col(id_col).cast("bigint").alias("entry_id"), _page_key(F.col(url_col).cast("string")).alias("page"), words.alias("w"))
    triple = lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2))
    enough = F.size("w") >= F.lit(max(3, least_words))
    triples = F.when(enough, F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), triple))))
    rows = rows.filter(F.col("entry_id").isNotNull()).select("entry_id", "page", triples.alias("triples"))
    digest = F.substring(F.unhex(F.sha2(F.to_csv(F.struct(F.array_join("triples", " "))), 256)), 1, 16)
    return rows.withColumn("key", F.when(F.col("triples").isNotNull(), digest))


def _distances(sets: DataFrame) -> DataFrame:
    """Sets (note, key, triples) with their size and their distances to the pivots, each capped at 127, which keeps them lower bounds."""

    def in_class(k: int) -> Column:
        return F.least(F.size(F.filter("triples", lambda x: x.bitwiseAND(F.lit(PIVOTS - 1)) == k)), F.lit(127)).cast("tinyint")

    return sets.select("note", "key", F.size("triples").alias("n"), F.array(*map(in_class, range(PIVOTS))).alias("pivots"), "triples")


def _order(sets: DataFrame) -> DataFrame:
    """The order of an index: how many sets hold each triple, for those held by more than one; all others count as rare."""
    return sets.select(F.explode("triples").alias("t")).groupBy("t").agg(F.count("*").alias("held")).filter("held > 1")


def _few(keys: DataFrame) -> bool:
    """Whether keys are few enough to be sent to every executor: FEW rows of a few dozen bytes, whatever the history's size."""
    return keys.limit(FEW + 1).count() <= FEW


def _known(stored: DataFrame, keys: DataFrame, on: str, few: bool) -> DataFrame:
    """The stored rows with one of the keys: if these are few, by a look at each stored row where it lies, else by a join."""
    keys = keys.filter(F.col(on).isNotNull()).select(on)
    return stored.join(F.broadcast(keys) if few else keys.distinct(), on, "left_semi")


def _prefixes(sets: DataFrame, order: DataFrame, threshold: float) -> DataFrame:
    """The first n - ceil(threshold * n) + 1 triples of each set, rare ones first, with their places."""
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)).cast("int") + 1
    ranked = sets.select("note", F.explode("triples").alias("t")).join(order, "t", "left").select("note", F.struct(F.coalesce("held", F.lit(0)).alias("held"), "t").alias("x"))
    sorted_ = ranked.groupBy("note").agg(F.array_sort(F.collect_list("x")).alias("xs")).join(sets.select("note", "n", "pivots"), "note")
    return sorted_.select("note", "n", "pivots", F.posexplode(F.slice("xs", F.lit(1), length)).alias("place", "x")).select(F.col("x.t").alias("t"), "note", "n", "place", "pivots")


def _candidates(a: DataFrame, b: DataFrame, threshold: float, within: bool) -> DataFrame:
    """Pairs (p of a, q of b) of different sets whose prefixes meet and that no distance to a pivot tells apart; within one table, each pair once."""
    na, nb = F.col("a.n"), F.col("b.n")
    overlap = F.ceil(F.lit(threshold / (1 + threshold)) * (na + nb) - F.lit(1e-9))
    apart = F.aggregate(F.zip_with("a.pivots", "b.pivots", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    differ = F.col("a.note") < F.col("b.note") if within else F.col("a.note") != F.col("b.note")
    return (
        a.alias("a").join(b.alias("b"), (F.col("a.t") == F.col("b.t")) & differ)
        .filter((nb >= F.lit(threshold) * na - F.lit(1e-9)) & (na >= F.lit(threshold) * nb - F.lit(1e-9)))
        .filter(F.least(na - F.col("a.place"), nb - F.col("b.place")) >= overlap)
        .filter(apart <= na + nb - 2 * overlap)
        .select(F.col("a.note").alias("p"), F.col("b.note").alias("q"))
        .distinct()
    )


def _similar(pairs: DataFrame, p_sets: DataFrame, q_sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs whose sets are as similar as the threshold asks, both ways round."""
    both = pairs.join(p_sets.select(F.col("note").alias("p"), F.col("triples").alias("tp")), "p").join(q_sets.select(F.col("note").alias("q"), F.col("triples").alias("tq")), "q")
    need = F.lit(threshold / (1 + threshold)) * (F.size("tp") + F.size("tq")) - F.lit(1e-9)
    similar = both.filter(F.size(F.array_intersect("tp", "tq")) >= need)
    return similar.select(F.explode(F.array(F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q")))).alias("x")).select("x.*")


def _resolve(kinds: DataFrame, links: DataFrame, taken_pages: DataFrame | None, taken_notes: DataFrame | None) -> DataFrame:
    """Takes kinds (entry_id, page, note) in order of id; gives the smallest accepted id that each repeats (null: accepted).

    An entry reads the hubs it could be stopped by (its page, its note's set, similar sets) and writes to its own two.
    In each round, an entry that sees an accepted smaller id in a hub is out, and one that sees no open smaller id is accepted.
    Rounds are as many as the longest chain of decisions that wait for each other; each looks at the open entries only.
    """
    # accepted entries don't repeat each other, so a hub holds at most one of them; a hub is named by the least id in it
    pages = kinds.filter(F.col("page").isNotNull()).groupBy("page").agg((2 * F.min("entry_id")).alias("hub"), F.count("*").alias("members"))
    pages = pages.join(taken_pages, "page", "left") if taken_pages is not None else pages.withColumn("taken", F.lit(None).cast("bigint"))
    pages = pages.filter((F.col("members") > 1) | F.col("taken").isNotNull())
    by_page = kinds.join(pages, "page").select("entry_id", "hub", "taken", F.lit(True).alias("own"))
    noted = kinds.filter(F.col("note").isNotNull()).select("entry_id", "note")
    reads = noted.withColumn("own", F.lit(True)).unionByName(noted.join(links.select(F.col("p").alias("note"), "q"), "note").select("entry_id", F.col("q").alias("note"), F.lit(False).alias("own")))
    sizes = reads.groupBy("note").agg(F.count("*").alias("members"))
    sizes = sizes.join(taken_notes, "note", "left") if taken_notes is not None else sizes.withColumn("taken", F.lit(None).cast("bigint"))
    by_note = reads.join(sizes.filter((F.col("members") > 1) | F.col("taken").isNotNull()), "note").select("entry_id", (2 * F.col("note") + 1).alias("hub"), "taken", "own")
    reads = checkpointed(by_page.unionByName(by_note))
    writes = reads.filter("own").select("entry_id", "hub")

    state = reads.select("entry_id").distinct().withColumn("status", F.lit(0))
    while True:
        hubs = writes.join(state, "entry_id").groupBy("hub").agg(F.min(F.when(F.col("status") == 1, F.col("entry_id"))).alias("got"), F.min(F.when(F.col("status") == 0, F.col("entry_id"))).alias("open"))
        waiting = reads.join(state.filter("status = 0").select("entry_id"), "entry_id", "left_semi")
        seen = waiting.join(hubs, "hub", "left").groupBy("entry_id").agg(F.min(F.least("taken", "got")).alias("got"), F.min("open").alias("open"))
        decided = F.when(F.col("status") != 0, F.col("status")).when(F.col("got") < F.col("entry_id"), 2).when(F.col("open") < F.col("entry_id"), 0).otherwise(1)
        state = checkpointed(state.join(seen, "entry_id", "left").select("entry_id", decided.alias("status")))
        if state.filter("status = 0").isEmpty():
            break
    # one look more, as a smaller accepted id may have been found after an entry was out
    hubs = writes.join(state.filter("status = 1"), "entry_id").groupBy("hub").agg(F.min("entry_id").alias("got"))
    out = reads.join(state.filter("status = 2"), "entry_id", "left_semi")
    return out.join(hubs, "hub", "left").groupBy("entry_id").agg(F.min(F.least("taken", "got")).alias("repeats"))


def _indexed(notes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Order and postings of an index over all notes."""
    order = checkpointed(_order(notes))
    return order, checkpointed(_prefixes(notes, order, threshold))


def check_batch(batch: DataFrame, history: History | None = None, *, id_col: str = "entry_id", url_col: str = "url", note_col: str = "note", threshold: float = 0.5, least_words: int = 20) -> tuple[DataFrame, History]:
    """Checks a batch against the history and itself.

    Returns (entry_id, repeats), where repeats is the smallest accepted id that the entry repeats and null for an accepted
    entry, and the history with the accepted rows added. Ids of a batch must be above those of its history.

    The index keeps the order of triples it was made with; once the sets are three times those that the order was made of, order and index are
    made anew (so each set is indexed again a bounded number of times, however many batches come).

    Defined results: an entry without address and long note is accepted; rows without id are left out; rows that share an
    id count once, as the smallest page and note; other columns of the batch are ignored; an empty batch gives no rows.
    """
    rows = checkpointed(_keyed(batch, id_col, url_col, note_col, least_words))
    ids = rows.groupBy("entry_id").agg(F.min("page").alias("page"), F.min("key").alias("key"))
    found = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("entry_id").alias("note"), F.first("triples").alias("triples"))
    known = None
    if history is not None:
        few = _few(rows)
        known = checkpointed(_known(history.notes, rows, "key", few))  # sets of the history that the batch has again
        found = found.join(known.select("key"), "key", "left_anti")
    sets = checkpointed(_distances(found))
    mine = sets if known is None else sets.unionByName(known)
    if history is None:
        order, postings = _indexed(sets, threshold)
        pairs = checkpointed(_candidates(postings, postings, threshold, within=True))
        links = checkpointed(_similar(pairs, sets, sets, threshold))
        taken_pages = taken_notes = None
        count = sets.count()
        after = {"entries": None, "notes": sets, "postings": postings, "order": order}
        state = (count, count, 0)
    else:
        triples = mine.select(F.explode("triples").alias("t"))
        order = checkpointed(_known(history.order, triples, "t", few and _few(triples)))
        postings = checkpointed(_prefixes(sets, order, threshold))
        probes = postings.unionByName(checkpointed(_prefixes(known, order, threshold)))
        inner = checkpointed(_candidates(postings, postings, threshold, within=True))
        few_probes = few and _few(probes)
        outer = checkpointed(_candidates(F.broadcast(probes) if few_probes else probes, history.postings, threshold, within=False))
        met = _known(history.notes.select("note", "triples"), outer.select(F.col("q").alias("note")), "note", few and _few(outer))
        links = checkpointed(_similar(inner, sets, sets, threshold).unionByName(_similar(outer, mine, met, threshold)).distinct())
        hubs = mine.select("note").unionByName(links.select(F.col("q").alias("note")))
        taken_pages = _known(history.entries, rows.select("page"), "page", few).select("page", F.col("entry_id").alias("taken"))
        taken_notes = _known(history.entries, hubs, "note", few and _few(hubs)).select("note", F.col("entry_id").alias("taken"))
        count = history.sets + sets.count()
        after = {"entries": None, "notes": sets, "postings": postings}
        state = (history.made_of, count, history.version)
    kinds = ids.filter(F.col("page").isNotNull() | F.col("key").isNotNull())
    noted = kinds.filter(F.col("key").isNotNull()).join(mine.select("key", "note"), "key").select("entry_id", "page", "note")
    keyed = checkpointed(noted.unionByName(kinds.filter(F.col("key").isNull()).select("entry_id", "page", F.lit(None).cast("bigint").alias("note"))))
    # entries alike in page and note share their fate but for the first, so that hubs hold each kind once
    alike = keyed.groupBy("page", "note").agg(F.min("entry_id").alias("entry_id"), F.count("*").alias("copies"))
    nodes = alike.join(_resolve(alike, links, taken_pages, taken_notes), "entry_id", "left")
    lone = nodes.filter("copies = 1").select("entry_id", "page", "note", "repeats")
    first = F.col("k.entry_id")
    repeats = F.coalesce(F.col("k.repeats"), F.when(F.col("r.entry_id") != first, first))
    same = F.col("r.page").eqNullSafe(F.col("k.page")) & F.col("r.note").eqNullSafe(F.col("k.note"))
    copies = keyed.alias("r").join(nodes.filter("copies > 1").alias("k"), same).select("r.entry_id", "r.page", "r.note", repeats.alias("repeats"))
    result = checkpointed(lone.unionByName(copies))
    entries = result.filter(F.col("repeats").isNull()).select("entry_id", "page", "note")
    bare = ids.filter(F.col("page").isNull() & F.col("key").isNull()).select("entry_id", F.lit(None).cast("bigint").alias("repeats"))
    added = after | {"entries": entries}
    if history is None:
        grown = History(entries, sets, postings, order, added, *state)
    else:
        notes = history.notes.unionByName(sets)
        grown = History(history.entries.unionByName(entries), notes, history.postings.unionByName(postings), history.order, added, *state)
        if count > 3 * history.made_of:
            order, postings = _indexed(notes, threshold)
            grown = History(grown.entries, notes, postings, order, added | {"postings": postings, "order": order}, count, count, history.version + 1)
    return result.select("entry_id", "repeats").unionByName(bare), grown


def check_in_loads(entries: DataFrame, path: str, bounds: list[int], batch_col: str = "batch_no", **columns: str) -> list[DataFrame]:
    """The results of check_batch for loads of batches, each against the history that the loads before it left under path.

    A load takes the batches up to its bound that no load before it took, and one more load the rest; batches without a number go with the first. The
    history is written after each load and opened from there for the next, as by jobs of their own; nothing else passes between them.
    """
    spark, out, low = entries.sparkSession, [], None
    number = F.col(batch_col)
    for k, bound in enumerate([*bounds, None]):
        part = entries
        if bound is not None:
            part = part.filter((number <= bound) | number.isNull() if low is None else number <= bound)
        if low is not None:
            part = part.filter(number > low)
        checked, history = check_batch(part, History.open(spark, path) if k else None, **columns)
        history.append(path, f"{k:05d}")
        out.append(checked)
        low = bound
    return out
