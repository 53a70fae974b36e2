"""Cuts sections that are too large into pieces at natural boundaries, without loading whole bodies.

A body is a run of bytes, divided into cells of a fixed length. Soon after each cell's start lies a joint, the best natural boundary there, and
no piece crosses one; so where a piece ends depends on the cell it begins in and on nothing before it. Workers take ranges of whole cells, each with
a halo on both sides, and find in them the headings, the line ends and the joints. What a range can't know by itself - how many
headings and lines lie before it, where the section it starts in began, where the section it ends in goes on to, where the
next joint is - comes from prefix sums over one short row per range. Each range then emits the pieces between its
joint and the next one by offset. The pieces are the same whatever the length of ranges; a body that fits in one needs no stitching.

Within a section, a piece reaches as far as the limit allows, back to the last end of a paragraph in its second half, or
else of a line, of a sentence; then the same in its first half; then white space, and last a character's end. The
next piece begins about ``overlap`` bytes earlier, at the start of a line, sentence or word if one lies in the first half of the
overlap, else of a character.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quernel.session import checkpointed

CELL = 32_768
RANGE = 65_536
JOINT = 2_048  # a cell's joint is sought in so many bytes after its start
FEW = 100_000  # short rows up to this number are sent to every executor, more are joined
HEADING = re.compile(rb"(?:(?<=\n)|\A)#{1,3}[ \t]+[^\s]")
SENTENCE = re.compile(rb"(?:[.!?]|\xe2\x80\xa6)[\"'\x29\x5d]*(?:\xe2\x80[\x99\x9d]|\xc2\xbb)?[ \t]+|(?:\xe3\x80\x82|\xef\xbc[\x81\x9f]|\xe0\xa5\xa4|\xd8\x9f[ ])(?:\xe2\x80\x9d|\xe3\x80[\x8d\x8f])?[ \t]*")
BLANK = re.compile(rb"[ \t\n\r]|\xe3\x80\x80")
PIECE = "section_no int, piece_no int, start_byte bigint, end_byte bigint, overlap_bytes int, first_line bigint, last_line bigint, tokens int, text string"


def _char_start(data: bytes, at: int) -> int:
    """at, or the start of the next character if it lies within one."""
    for _ in range(3):
        if at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
    return at


def _natural(data: bytes, lo: int, hi: int) -> int | None:
    """The last natural boundary in (lo, hi], by rank."""
    for mark in (b"\n\n", b"\r\n\r\n"):
        at = data.rfind(mark, lo, hi)
        if at >= 0 and at + len(mark) > lo:
            return at + len(mark)
    at = data.rfind(b"\n", lo, hi)
    if at >= 0:
        return at + 1
    last = None
    for m in SENTENCE.finditer(data, lo, hi):
        if m.end() > lo:
            last = m.end()
    return last


def _cut(data: bytes, at: int, most: int) -> int:
    """Where a piece that begins at at ends, at + most at the latest."""
    hi, half = at + most, at + most // 2
    for lo, up in ((half, hi), (at + most // 8, half)):
        if (found := _natural(data, lo, up)) is not None:
            return found
    last = None
    for m in BLANK.finditer(data, half, hi):
        last = m.end()
    if last is not None:
        return last
    while hi > at + 1 and hi < len(data) and data[hi] & 0xC0 == 0x80:
        hi -= 1
    return hi


def _joint(data: bytes, at: int, end: int) -> int:
    """The first end of a paragraph in the bytes after at, else of a line, a sentence or a word, else a character's start."""
    stop = min(end, at + JOINT)
    for mark in (b"\n\n", b"\r\n\r\n", b"\n"):
        found = data.find(mark, at, stop)
        if found >= 0:
            return found + len(mark)
    m = SENTENCE.search(data, at, stop) or BLANK.search(data, at, stop)
    return m.end() if m else _char_start(data, at)


def _overlap_start(data: bytes, lo: int, at: int) -> int:
    """Where the overlap before at begins: a line's, sentence's or word's start in the first half from lo on, else a character's."""
    half = lo + (at - lo) // 2
    line = data.find(b"\n", max(0, lo - 1), half)
    if line >= 0:
        return line + 1
    m = SENTENCE.search(data, max(0, lo - 1), half) or BLANK.search(data, max(0, lo - 1), half)
    return m.end() if m and lo <= m.end() <= half else _char_start(data, lo)


def _cell_joint(data: bytes, left: int, cell: int, heads: list[int]) -> int:
    """The joint of the cell that begins at cell; a section that ends before it makes way, as the cell before is to finish it."""
    joint = _joint(data, cell - left, len(data)) + left
    k = bisect_left(heads, cell)
    return heads[k] if k < len(heads) and heads[k] <= joint else joint


def _headings(data: bytes, left: int, start: int, end: int) -> list[int]:
    return [m.start() + left for m in HEADING.finditer(data, max(0, start - left)) if start <= m.start() + left < end]


def range_summary(data: bytes, left: int, start: int, end: int) -> tuple[int, int | None, int | None, int, int | None]:
    """Headings (count, first, last), line ends and first joint of the range [start, end) of a body; data begins at left."""
    heads = _headings(data, left, start, end)
    lines = data.count(b"\n", start - left, end - left)
    joint = _cell_joint(data, left, start, heads) if start > 0 else None
    return len(heads), heads[0] if heads else None, heads[-1] if heads else None, lines, joint


def range_pieces(data: bytes, left: int, start: int, end: int, cell: int, known: tuple[int, int, int, int, int, int], limit: int, overlap: int) -> Iterator[tuple]:
    """The pieces of sections over the limit that begin between a range's joint and the next one.

    known: headings and lines before the range, start of the section open at its start, start of the first section after
    it (size if none), its joint and the next range's (start and size where there is none). Piece numbers count from 1
    within this range.
    """
    heads_before, lines_before, open_start, after, joint, next_joint = known
    heads = _headings(data, left, start, end)
    joints = [joint, *(_cell_joint(data, left, c, heads) for c in range(start + cell, end, cell)), next_joint]
    bounds = [open_start, *heads, after]
    lines, counted = lines_before, start
    for k in range(len(bounds) - 1):
        first, last = bounds[k], bounds[k + 1]
        if last - first <= limit:
            continue
        at, stop, n = max(first, joint), min(last, next_joint), 0
        c = bisect_right(joints, at)
        while at < stop:
            while c < len(joints) and joints[c] <= at:
                c += 1
            to_joint = min(stop, joints[c]) if c < len(joints) else stop
            back = at
            if at > first and overlap:
                back = _overlap_start(data, max(first, at - overlap) - left, at - left) + left
            room = limit - (at - back)
            if to_joint - at <= room:
                to = to_joint
            else:
                to = min(_cut(data, at - left, room) + left, to_joint)
            n += 1
            lines += data.count(b"\n", counted - left, back - left) if back >= counted else -data.count(b"\n", back - left, counted - left)
            counted = back
            line = lines + 1
            yield heads_before + k, n, back, to, at - back, line, line + data.count(b"\n", back - left, max(back, to - 1) - left), (to - back) // 4, data[back - left : to - left]
            at = to


def _slices(bodies: DataFrame, range_bytes: int, halo: int) -> DataFrame:
    """One row per range of each body: row, k, size, start and the bytes with halo; ranges are cut without going back to the whole body."""
    sized = bodies.select("row", "k", F.octet_length("body").cast("bigint").alias("size"), "body").filter("size > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))

    def piece(s):  # noqa: ANN001, ANN202
        left = F.greatest(s - halo, F.lit(0))
        return F.struct(s.alias("start"), F.substring("body", (left + 1).cast("int"), (s - left + range_bytes + halo).cast("int")).alias("data"))

    return sized.select("row", "k", "size", F.explode(F.transform(starts, piece)).alias("r")).select("row", "k", "size", "r.start", "r.data")


def _file_ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """One row per range of files given row, k (path) and size; nothing is read."""
    return files.filter("size > 0").select("row", "k", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))


def _read_ranges(ranges: DataFrame, row_kind: str, range_bytes: int, halo: int) -> DataFrame:
    """Adds data to the ranges of files: each task reads its range with halo and no more."""
    extra = [(f.name, f.dataType.simpleString()) for f in ranges.schema]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for k in range(len(batch)):
                one = batch.iloc[k : k + 1].reset_index(drop=True)
                system, path = fs.FileSystem.from_uri(one["k"][0])
                start = int(one["start"][0])
                left = max(0, start - halo)
                with system.open_input_file(path) as f:
                    f.seek(left)
                    one["data"] = [f.read(start - left + range_bytes + halo)]
                yield one

    return ranges.mapInPandas(read, ", ".join(f"{n} {t}" for n, t in extra) + ", data binary")


KNOWN = ("heads_before", "lines_before", "open_start", "after", "joint", "next_joint")


def _split(whole: DataFrame, many: Callable[[], DataFrame], joined: Callable[[DataFrame], DataFrame], kind: str, row_kind: str, sizes: tuple[int, int, int, int, int], with_text: bool) -> DataFrame:
    """The pieces of the slices of bodies that fit in one range (whole) and of larger ones; row tells bodies of one k, or of none, apart.

    many gives the slices of the larger ones; joined gives them once more with the columns of a table of stitched ranges.
    """
    range_bytes, halo, cell, limit, overlap = sizes

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [range_summary(bytes(d), max(0, s - halo), s, min(n, s + range_bytes)) for d, s, n in zip(b["data"], b["start"], b["size"], strict=True)]
            yield pd.concat([b[["row", "size", "start"]].reset_index(drop=True), pd.DataFrame(rows, columns=["heads", "first", "last", "lines", "joint"], dtype="object")], axis=1)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for r in b.itertuples(index=False):
                known = (r.heads_before, r.lines_before, r.open_start, r.after, r.joint, r.next_joint)
                for p in range_pieces(bytes(r.data), max(0, r.start - halo), r.start, min(r.size, r.start + range_bytes), cell, known, limit, overlap):
                    out.append((r.row, r.k, r.start, *p[:-1], p[-1].decode("utf-8", "replace") if with_text else None))
            yield pd.DataFrame(out, columns=["row", "k", "range_start", *[c.split()[0] for c in PIECE.split(", ")]])

    schema = f"row {row_kind}, k {kind}, range_start bigint, {PIECE}"
    zero = F.lit(0).cast("bigint")
    alone = whole.select("row", "k", "size", "start", "data", zero.alias("heads_before"), zero.alias("lines_before"), zero.alias("open_start"), F.col("size").alias("after"), zero.alias("joint"), F.col("size").alias("next_joint"))
    done = alone.mapInPandas(emit, schema)

    table = many().mapInPandas(summarise, f"row {row_kind}, size bigint, start bigint, heads bigint, first bigint, last bigint, lines bigint, joint bigint")
    w = Window.partitionBy("row").orderBy("start")
    before, following = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    stitched = checkpointed(table.select(
        "row", "start",
        F.coalesce(F.sum("heads").over(before), zero).alias("heads_before"), F.coalesce(F.sum("lines").over(before), zero).alias("lines_before"),
        F.coalesce(F.max("last").over(before), zero).alias("open_start"), F.coalesce(F.min("first").over(following), F.col("size")).alias("after"),
        F.coalesce("joint", zero).alias("joint"), F.coalesce(F.lead("joint").over(w), F.col("size")).alias("next_joint"),
    ))
    pieces = checkpointed(joined(_sent(stitched)).select("row", "k", "size", "start", "data", *KNOWN).mapInPandas(emit, schema))
    # piece numbers go on over ranges: one row per range and section is enough to know by how much; only these rows move
    counts = pieces.groupBy("row", "section_no", "range_start").agg(F.count("*").alias("n"))
    shift = counts.select("row", "section_no", "range_start", F.coalesce(F.sum("n").over(Window.partitionBy("row", "section_no").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("shift"))
    shift = _sent(checkpointed(shift.filter("shift > 0")))
    numbered = pieces.join(shift, ["row", "section_no", "range_start"], "left").withColumn("piece_no", (F.col("piece_no") + F.coalesce("shift", zero)).cast("int")).select(done.columns)
    return done.unionByName(numbered).drop("row", "range_start")


def _sent(rows: DataFrame) -> DataFrame:
    """Short rows, marked to be sent to every executor if they are few."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def _sizes(limit: int, overlap: int, range_bytes: int) -> tuple[int, int, int, int, int]:
    """Length of ranges (whole cells), halo and cell (over twice the halo), limit and overlap."""
    if not 0 <= overlap < limit // 2 or limit < 16:
        raise ValueError("limit must be 16 bytes or more and overlap under half of it")
    halo = limit + 2 * JOINT
    cell = CELL * max(1, -(-2 * halo // CELL))
    return cell * max(1, -(-range_bytes // cell)), halo, cell, limit, overlap


def split_oversized(articles: DataFrame, id_col: str = "article_id", body_col: str = "body", limit: int = 6000, overlap: int = 300, with_text: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """Pieces of the sections longer than limit bytes, each at most limit bytes with about overlap bytes of the one before.

    A section begins at a line of one to three ``#``, blanks and text and reaches to the next such line; section_no counts from
    1, and the text before the first one is section 0. Columns: id, section_no, piece_no, start_byte and end_byte in the
    body (start with the overlap), overlap_bytes, first_line, last_line, tokens (a quarter of the bytes) and text. range_bytes is rounded up
    to whole cells; it changes who does the work, not the pieces.

    Defined results: null and empty bodies give no rows; rows with a null id or a repeated one are split each by itself, so repeated rows give their pieces again; a section of exactly limit
    bytes isn't cut; bytes that aren't UTF-8 are cut anywhere; blanks between ``#`` and text are looked through for a halo's length.
    """
    sizes = range_bytes, halo, *_ = _sizes(limit, overlap, range_bytes)
    kind = articles.schema[id_col].dataType.simpleString()
    bodies = articles.select(F.col(id_col).alias("k"), F.col(body_col).cast("binary").alias("body"))
    size = F.octet_length("body")
    # what is stitched goes by a number of its row, written down before the row is cut
    large = checkpointed(bodies.filter(size > range_bytes).withColumn("row", F.monotonically_increasing_id()))
    small = bodies.filter(size <= range_bytes).withColumn("row", F.lit(0).cast("bigint"))
    slices = lambda: _slices(large, range_bytes, halo)
    pieces = _split(_slices(small, range_bytes, halo), slices, lambda known: slices().join(known, ["row", "start"]), kind, "bigint", sizes, with_text)
    return pieces.withColumnRenamed("k", id_col)


def split_files(spark: SparkSession, path: str, limit: int = 6000, overlap: int = 300, range_bytes: int = 64 << 20, with_text: bool = True) -> DataFrame:
    """The same for files of any size, each a body; the id is the path. No task reads more than a range and its halos.

    A file of one range is read once, a larger one twice: for the boundary table, and to emit its pieces by offset. No text is shuffled.
    """
    sizes = range_bytes, halo, *_ = _sizes(limit, overlap, range_bytes)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("row"), F.col("path").alias("k"), F.col("length").alias("size"))
    spread = lambda ranges: ranges.repartition("k", "start")  # noqa: E731  names and numbers only
    read = lambda ranges: _read_ranges(ranges, "string", range_bytes, halo)
    large = _file_ranges(files.filter(F.col("size") > range_bytes), range_bytes)
    whole = read(spread(_file_ranges(files.filter(F.col("size") <= range_bytes), range_bytes)))
    pieces = _split(whole, lambda: read(spread(large)), lambda known: read(spread(large.join(known, ["row", "start"]))), "string", "string", sizes, with_text)
    return pieces.withColumnRenamed("k", "path")
