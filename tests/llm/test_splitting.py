import random

import pytest

from quernel.llm import splitting as s

SCHEMA = "article_id bigint, body string, k string, size string, start int"


def brute(body: str, limit: int) -> list[tuple[int, int, int]]:
    """Sections over the limit as (number, start, end), line by line."""
    at, heads = 0, []
    for line in body.encode().splitlines(keepends=True) if "\r" not in body.replace("\r\n", "") else [body.encode()]:
        stripped = line.lstrip(b"#")
        level = len(line) - len(stripped)
        if 1 <= level <= 3 and stripped[:1] in (b" ", b"\t") and stripped.strip():
            heads.append(at)
        at += len(line)
    edges = [0, *heads, len(body.encode())]
    return [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b - a > limit]


def text(rng: random.Random, n: int) -> str:
    parts = ["# Heading\n", "## Kopf é\r\n", "#### deep\n", "A sentence here. ", "句子在这里。", "word ", "\n", "\n\n", "\r\n\r\n", "#nohead\n", "x" * 700, "ü" * 300, "# \n"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("range_bytes", [1, 1 << 20])
def test_pieces_cover_sections(spark, range_bytes):
    rng = random.Random(5)
    rows = [(i, text(rng, 900)) for i in range(6)] + [(7, None), (8, ""), (9, "plain"), (10, "y" * 30_000), (11, "# a\n" + "字" * 9000)]
    limit, overlap = 1000, 60
    df = spark.createDataFrame([(i, b, "c", "d", 1) for i, b in rows], SCHEMA)
    got = {}
    for p in s.split_oversized(df, limit=limit, overlap=overlap, range_bytes=range_bytes).collect():
        got.setdefault((p.article_id, p.section_no), []).append(p)
    want = {(i, k): (a, b) for i, body in rows if body for k, a, b in brute(body, limit)}
    assert set(got) == set(want)
    for key, (a, b) in want.items():
        raw = dict(rows)[key[0]].encode()
        at = a
        for n, p in enumerate(sorted(got[key], key=lambda p: p.piece_no), 1):
            assert p.piece_no == n and p.end_byte - p.start_byte <= limit
            assert p.start_byte + p.overlap_bytes == at and p.text.encode() == raw[p.start_byte : p.end_byte]
            assert p.overlap_bytes == 0 if n == 1 else min(overlap // 2, at - a) - 3 <= p.overlap_bytes <= overlap
            assert p.first_line == raw.count(b"\n", 0, p.start_byte) + 1
            at = p.end_byte
        assert at == b


def test_cuts_at_paragraphs(spark):
    body = "# t\n" + "\n\n".join(f"Paragraph {i} " + "w " * 100 for i in range(60))
    pieces = s.split_oversized(spark.createDataFrame([(1, body, "", "", 0)], SCHEMA)).orderBy("piece_no").collect()
    raw = body.encode()
    assert len(pieces) > 2 and all(raw[: p.end_byte].endswith(b"\n\n") for p in pieces[:-1])


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert s.split_oversized(empty).count() == 0
    exact = spark.createDataFrame([(1, "z" * 6000, "", "", 0), (1, "z" * 6001, "", "", 0), (1, "z" * 6001, "", "", 0)], SCHEMA)
    assert s.split_oversized(exact).filter("piece_no = 1").count() == 2
    with pytest.raises(ValueError, match="limit"):
        s.split_oversized(empty, limit=10)


def test_files(spark, tmp_path):
    body = "# one\n" + "Line of text. " * 3000 + "\n## two\n" + "short\n" + "# three\n" + "para\n\n" * 4000
    (tmp_path / "a.md").write_text(body)
    rows = s.split_files(spark, str(tmp_path / "a.md"), range_bytes=20_000).collect()
    assert sorted({r.section_no for r in rows}) == [1, 3]
    for n in (1, 3):
        own = sorted((r for r in rows if r.section_no == n), key=lambda r: r.piece_no)
        assert "".join(r.text.encode()[r.overlap_bytes :].decode() for r in own) == body.encode()[own[0].start_byte : own[-1].end_byte].decode()


def test_null_and_repeated_ids(spark):
    rng = random.Random(7)
    bodies = [text(rng, 900) for _ in range(3)]
    rows = [(None, bodies[0]), (None, bodies[1]), (3, bodies[0]), (3, bodies[2]), (4, bodies[1]), (4, bodies[1])]
    split = lambda rows: s.split_oversized(spark.createDataFrame([(i, b, "", "", 0) for i, b in rows], SCHEMA), limit=1000, overlap=60, range_bytes=1).collect()
    own = {b: sorted(tuple(p)[1:] for p in split([(9, b)])) for b in bodies}
    assert all(len(b.encode()) > 2 * (1000 + 2 * s.JOINT) and own[b] for b in bodies)
    got = split(rows)
    for i in (None, 3, 4):
        assert sorted(tuple(p)[1:] for p in got if p.article_id == i) == sorted(p for k, b in rows if k == i for p in own[b])


def test_the_length_of_ranges_changes_nothing(spark):
    rng = random.Random(11)
    bodies = ["# one\n" + "word " * 60_000, text(rng, 2500), "# a\n" + "字" * 60_000, "".join(f"Sentence {i} of a long section. " for i in range(9000))]
    rows = spark.createDataFrame([(k, b, "", "", 0) for k, b in enumerate(bodies)], SCHEMA)
    cut = lambda n: sorted(map(tuple, s.split_oversized(rows, range_bytes=n).collect()))
    one = cut(1)
    assert all(len(b.encode()) > 2 * s.CELL for b in bodies) and len(one) > 100
    assert one == cut(2 * s.CELL) == cut(1 << 22)


def test_overlaps_begin_at_words(spark):
    body = "# t\n" + "alpha beta gamma delta " * 2000
    for p in s.split_oversized(spark.createDataFrame([(1, body, "", "", 0)], SCHEMA), range_bytes=1).collect():
        assert p.start_byte == 0 or body[p.start_byte - 1] == " "
