"""Exact and near duplicates of documents: classes of equal bodies, and links between the classes' representatives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quernel.functions.text import dedup_normal, token_set
from quernel.session import checkpointed

SENT = 4_000_000  # sets of so many words in all, 8 bytes each, are sent to every executor; larger ones are joined
HEAD = 8192  # so many of the most common words have numbers of two bytes
BLOCK, BLOCKS = 8192, 32  # sets are dealt to blocks of about so many, at most so many blocks
TILE = 4096  # sets are counted against so many at a time
RICH = 50  # where words bring fewer pairs together than a share of 1 / RICH of all there are, the words are joined


def exact_classes(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, class_id (the smallest id with an equal normal form) and copies (the class's size).

    Null texts form no class and are left out. A class may hold any share of the rows: its size and smallest id are taken partly
    before the shuffle, and go back by the body's hash.
    """
    hashed = documents.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(dedup_normal(F.col(text_col)), 256).alias("h"))
    classes = hashed.groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return hashed.join(classes, "h").select(F.col("id").alias(id_col), "class_id", "copies")


def with_shingles(texts: DataFrame, text_col: str, n: int) -> DataFrame:
    """Adds s, the different runs of n words in a row, hashed; a shorter text is one run."""
    words = F.filter(F.split(F.col(text_col), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    # the words are a column of their own, so that they aren't split again for every run
    cut = texts.withColumn("_w", words)
    last = F.greatest(F.size("_w") - n + 1, F.lit(1))
    run = lambda i: F.xxhash64(F.array_join(F.slice("_w", i, F.lit(n)), " "))
    return cut.withColumn("s", F.array_distinct(F.transform(F.sequence(F.lit(1), last), run))).drop("_w")


def near_links(documents: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """a, b, similarity: links between representatives of different bodies whose runs of words overlap enough.

    Jaccard similarity of shingle sets, all pairs at or above the threshold. Each body stands for its copies (see
    ``exact_classes``), so copies bring no pairs. Candidates share one of the rarest n - ceil(t*n) + 1 shingles of both,
    in one order by frequency, which loses no pair; sizes and places prune them before sets are compared.
    """
    texts = documents.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), dedup_normal(F.col(text_col)).alias("t"))
    reps = texts.filter("t <> ''").groupBy(F.sha2("t", 256).alias("h")).agg(F.min(F.struct("id", "t")).alias("x"))
    sets = checkpointed(with_shingles(reps.select("x.id", "x.t"), "t", words).select("id", "s", F.size("s").alias("n")))
    held = sets.select(F.explode("s").alias("k")).groupBy("k").agg(F.count("*").alias("held")).filter("held > 1")
    ranked = sets.select("id", "n", F.explode("s").alias("k")).join(held, "k", "left")
    length = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1).cast("int")
    order = ranked.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "k"))).alias("o"))
    prefix = order.select("id", "n", F.posexplode(F.slice("o", F.lit(1), length)).alias("place", "x")).select("id", "n", "place", "x.k", "x.held").filter("held > 1")
    a, b = prefix.alias("a"), prefix.alias("b")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) - F.lit(1e-9))
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id")))
    pairs = pairs.filter((F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9))
    pairs = pairs.filter(F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) >= need)
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    m, n, shared = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    near = both.filter(shared >= F.lit(threshold / (1 + threshold)) * (m + n) - F.lit(1e-9)).select("a", "b", shared.cast("double").alias("shared"), (m + n).alias("both"))
    return near.select("a", "b", (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity"))


def _counted_by_words(sets: DataFrame, held: DataFrame, c: float, floor: float, need: Callable) -> DataFrame:
    """a, b, shared, m, n of alike pairs, by a join of words.

    The smaller set shares c of its words at least. So of the (1 - c) n + k words of it that fewest bodies hold, the larger one has k or more, for any k;
    with k a tenth of n few pairs get so far by chance, and those are compared in full.
    """
    order = sets.select("id", "n", F.explode("s").alias("k")).join(held, "k").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("held", "k"))).alias("o"))
    placed = checkpointed(order.select("id", "n", F.posexplode("o").alias("place", "x")).select("id", "n", "place", "x.k", "x.held").filter("held > 1"))
    more = F.ceil(F.lit(0.1) * F.col("n"))
    small = placed.filter(F.col("place") <= F.col("n") - F.ceil(F.lit(c) * F.col("n") - F.lit(1e-9)) + more - 1).withColumn("more", more).alias("a")
    large = placed.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    smaller = (na < nb) | ((na == nb) & (F.col("a.id") < F.col("b.id")))
    met = small.join(large, (F.col("a.k") == F.col("b.k")) & smaller & (na >= F.lit(floor) * nb - 1e-9)).groupBy(F.col("a.id").alias("p"), F.col("b.id").alias("q"), "a.more").agg(F.count("*").alias("m"))
    pairs = met.filter("m >= more").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    few = (sets.agg(F.sum("n")).first()[0] or 0) <= SENT
    sent = lambda df: F.broadcast(df) if few else df
    side = lambda n: sent(sets.select(F.col("id").alias(n), F.col("s").alias(f"s{n}")))
    m, n = F.size("sa"), F.size("sb")
    least = need(m, n, F.least, F.greatest, lambda when, x, y: F.when(when, x).otherwise(y))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.size(F.array_intersect("sa", "sb")) >= least)
    return both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("shared"), m.alias("m"), n.alias("n"))


def _counted_in_blocks(sets: DataFrame, held: DataFrame, in_all: int, near: float, need: Callable) -> DataFrame:
    """a, b, shared, m, n of alike pairs, by counting what each two sets share whose sizes are within near.

    Sets in order of size are dealt to blocks, and each two blocks with sizes near enough are a task's, which counts word by word: a common word is a
    column of ones and noughts over the larger sets, a rare one a list of those that hold it. So a pair costs a few additions of bytes, and no row is
    made for what isn't alike. A set goes to as many tasks as there are blocks, its common words as numbers of two bytes.
    """
    blocks = 1
    while blocks < BLOCKS and blocks * BLOCK < in_all:
        blocks *= 2
    # by size; those of one size by a hash, so that no size can make a block uneven
    placed = sets.select("id", "s", (F.col("n") + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(1 << 20)).alias("v"))
    cuts = placed.agg(F.percentile_approx("v", [k / blocks for k in range(1, blocks)], 10000)).first()[0] if blocks > 1 else []
    edges = [0, *cuts, float("inf")]
    tasks = [(i, j) for j in range(blocks) for i in range(j + 1) if edges[i + 1] >= near * int(edges[j])]
    of = [[k for k, t in enumerate(tasks) if x in t] for x in range(blocks)]
    head = np.array([r.k for r in held.orderBy(F.desc("held"), "k").limit(HEAD).collect()], np.int64)
    number = np.argsort(head).astype(np.uint16)
    head, size, tile = head[number], HEAD, TILE
    kind = sets.schema["id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, v = b.column("s"), b.column("v").to_numpy()
            words, row = s.flatten().to_numpy(), np.repeat(np.arange(len(s)), s.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(head, words), len(head) - 1)
            common = head[at] == words
            ends = lambda which: np.concatenate([[0], np.cumsum(np.bincount(row[which], minlength=len(s)))]).astype(np.int32)  # noqa: B023, E731
            numbers = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends(common) * 2), pa.py_buffer(number[at[common]].tobytes())])
            block = np.searchsorted(cuts, v, side="right")
            cols = [b.column("id"), b.column("v"), pa.array(block, pa.int32()), numbers, pa.ListArray.from_arrays(pa.array(ends(~common)), pa.array(words[~common])), pa.array([of[x] for x in block], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "v", "block", "numbers", "others", "tasks"])

    def side(t: pa.Table, block: int) -> tuple:
        """Of a block's sets, in order of size: ids, sizes, numbers and other words, each with where a set's begin."""
        v, rows = t.column("v").to_numpy(), np.flatnonzero(t.column("block").to_numpy() == block)
        t = t.take(pa.array(rows[np.argsort(v[rows], kind="stable")])).combine_chunks()
        numbers, others = t.column("numbers").to_pylist(), t.column("others").chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int64()))
        ends = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        sizes = np.floor(t.column("v").to_numpy()).astype(np.int64)
        return t.column("id"), sizes, np.frombuffer(b"".join(numbers), np.uint16), ends([len(x) // 2 for x in numbers]), others.flatten().to_numpy(), ends(others.value_lengths().to_numpy())

    def holders(words: np.ndarray, col: np.ndarray) -> tuple:
        """Different words in order, where each one's columns begin and how many they are, and the columns."""
        order = np.argsort(words, kind="stable")
        keys, first, n = np.unique(words[order], return_index=True, return_counts=True)
        return keys, first, n, col[order]

    def met(words: np.ndarray, row: np.ndarray, by: tuple) -> np.ndarray:
        """The cells (row, column) at which a word of the row is the column's too."""
        keys, first, n, col = by
        if not len(keys) or not len(words):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        same = keys[at] == words
        at, row = at[same], row[same]
        times = n[at]
        return np.repeat(row * tile, times) + col[np.repeat(first[at] - np.cumsum(times) + times, times) + np.arange(times.sum())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got)
        i, j = tasks[t.column("task")[0].as_py()]
        a = side(t, i)
        b = a if i == j else side(t, j)
        (ids, sizes, numbers, ends, others, others_ends), (ids_b, sizes_b, numbers_b, ends_b, others_b, others_ends_b) = a, b
        found: list[tuple] = []
        pending = 0

        def batch() -> pa.RecordBatch:
            p, q, shared = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(p)).combine_chunks(), ids_b.take(pa.array(q)).combine_chunks(), *(pa.array(x, pa.int32()) for x in (shared, sizes[p], sizes_b[q]))], ["p", "q", "shared", "m", "n"])

        for start in range(0, len(sizes_b), tile):
            stop = min(start + tile, len(sizes_b))
            width, large = stop - start, sizes_b[start:stop]
            words, col = numbers_b[ends_b[start] : ends_b[stop]], np.repeat(np.arange(width), np.diff(ends_b[start : stop + 1]))
            often = np.bincount(words, minlength=size) * 256 >= width
            slot = np.where(often, np.cumsum(often) - 1, -1)
            columns = np.zeros((often.sum(), width), np.uint8)
            dense = often[words]
            columns[slot[words[dense]], col[dense]] = 1
            rare = holders(words[~dense], col[~dense])
            rest = holders(others_b[others_ends_b[start] : others_ends_b[stop]], np.repeat(np.arange(width), np.diff(others_ends_b[start : stop + 1])))
            at, last, least = np.searchsorted(sizes, near * large[0] - 1e-6), stop - 1 if i == j else len(sizes), None
            for low in range(at, last, 256):
                high = min(low + 256, last)
                words, row = numbers[ends[low] : ends[high]], np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
                dense = often[words]
                slots, begin = slot[words[dense]], np.concatenate([[0], np.cumsum(np.bincount(row[dense], minlength=high - low))])
                cells = np.concatenate([met(words[~dense], row[~dense], rare), met(others[others_ends[low] : others_ends[high]], np.repeat(np.arange(high - low), np.diff(others_ends[low : high + 1])), rest)])
                more = np.bincount(cells, minlength=(high - low) * tile).astype(np.uint16).reshape(high - low, tile) if len(cells) else None
                for r in range(low, high):
                    if least is None or sizes[r] != m:
                        m = sizes[r]
                        narrow = np.uint8 if m < 255 else np.uint16
                        least = np.clip(np.ceil(need(m, large, np.minimum, np.maximum, np.where)), 0, 255 if m < 255 else 65535).astype(narrow)
                    shared = np.add.reduce(columns.take(slots[begin[r - low] : begin[r - low + 1]], axis=0), axis=0, dtype=narrow)
                    if more is not None:
                        shared += more[r - low, :width].astype(narrow)
                    after = max(0, r + 1 - start) if i == j else 0
                    hits = np.flatnonzero(shared[after:] >= least[after:]) + after
                    if len(hits):
                        found.append((np.full(len(hits), r), hits + start, shared[hits]))
                        pending += len(hits)
                if pending > 100_000:
                    yield batch()
                    found, pending = [], 0
        if found:
            yield batch()

    coded = placed.mapInArrow(code, f"id {kind}, v double, block int, numbers binary, others array<bigint>, tasks array<int>").select("id", "v", "block", "numbers", "others", F.explode("tasks").alias("task"))
    pairs = coded.repartitionById(len(tasks), "task").mapInArrow(count, f"p {kind}, q {kind}, shared int, m int, n int")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared", "m", "n")


def class_sets(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per class of equal bodies, stored: class_id and copies (as in ``exact_classes``), s (the hashed words of ``token_set``) and n (how many)."""
    texts = documents.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), dedup_normal(F.col(text_col)).alias("t"))
    classes = texts.groupBy(F.sha2("t", 256).alias("h")).agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.first("t").alias("t"))
    hashed = F.array_distinct(F.transform(token_set(F.col("t")), lambda w: F.xxhash64(w)))
    return checkpointed(classes.select("class_id", "copies", hashed.alias("s")).withColumn("n", F.size("s")))


def alike_pairs(documents: DataFrame, id_col: str, text_col: str, jaccard: float = 0.55, overlap: float = 0.70, ratio: float = 4.0, floor: float = 0.30, least_tokens: int = 40) -> DataFrame:
    """a, b, shared, jaccard, overlap: pairs of different bodies whose sets of words are alike, see ``alike_classes``."""
    return alike_classes(class_sets(documents, id_col, text_col), jaccard, overlap, ratio, floor, least_tokens)


def alike_classes(classes: DataFrame, jaccard: float = 0.55, overlap: float = 0.70, ratio: float = 4.0, floor: float = 0.30, least_tokens: int = 40) -> DataFrame:
    """a, b, shared, jaccard, overlap: pairs of ``class_sets`` that are alike.

    Alike are sets of ``least_tokens`` or more with a Jaccard similarity of jaccard, or with overlap of the smaller one's words, sizes within ratio and
    a similarity of floor. No pair is lost, and no word is passed over for being common. Where words bring most sets together, as in a small vocabulary,
    all pairs of near enough sizes are counted in blocks (``_counted_in_blocks``); where few, the words are joined (``_counted_by_words``).
    Each body stands for its copies by its smallest id; a null id is none.
    """
    sets = classes.filter(F.col("class_id").isNotNull() & (F.col("n") >= least_tokens)).select(F.col("class_id").alias("id"), "s", "n")
    held = checkpointed(sets.select(F.explode("s").alias("k")).groupBy("k").agg(F.count("*").alias("held")))

    def need(m, n, least, most, pick):  # noqa: ANN001, ANN202
        """Words that sets of m and n words share at least if they are alike: what they must share follows from the sizes alone."""
        small, large = least(m, n), most(m, n)
        one, other = (m + n) * (jaccard / (1 + jaccard)), most(small * overlap, (m + n) * (floor / (1 + floor)))
        return pick(large <= small * ratio, least(one, other), one) - 1e-9

    in_all, met = sets.count(), held.agg(F.sum(F.col("held").cast("double") * F.col("held"))).first()[0] or 0
    if met * RICH < in_all * in_all:
        counted = _counted_by_words(sets, held, min(overlap, 2 * jaccard / (1 + jaccard)), floor, need)
    else:
        counted = _counted_in_blocks(sets, held, in_all, min(jaccard, max(floor, 1 / ratio)), need)
    j, o = F.col("shared") / (F.col("m") + F.col("n") - F.col("shared")), F.col("shared") / F.least("m", "n")
    return counted.select("a", "b", F.col("shared").cast("bigint").alias("shared"), j.alias("jaccard"), o.alias("overlap"))
