import random

import pytest
from hypothesis import given, settings, strategies as st

from quernel.llm.mixing import mix_sources
from quernel.llm.packing import container_report, fill, pack, pack_documents
from quernel.llm.tokens import TOKENIZER, count_tokens, cut_tokens, encoding

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no tokenizer here")
DOCS = "doc_id bigint, text string, source string, k string, tokens string, container_id string"


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_fill(sizes):
    held = fill(sizes, 64)
    room = {}
    for s, c in zip(sizes, held):
        room[c] = room.get(c, 0) + s
    assert len(held) == len(sizes) and all(v <= 64 for v in room.values()) and set(room) == set(range(len(room)))
    assert len(room) <= max(1, 1.7 * sum(sizes) / 64 + 2)


def texts():
    rng = random.Random(3)
    words = ["alpha", "βήτα", "слово", "文字", "ไทย", "naïve", "🚀", "x" * 50]
    return [" ".join(rng.choice(words) for _ in range(n)) for n in [0, 1, 5, 300, 900, 4000]] + [None, "", "字" * 5000, "z" * 9000]


@pytest.mark.parametrize("most", [16, 512])
def test_cut_tokens(most):
    for t in texts():
        pieces = cut_tokens(t, most)
        if not t:
            assert pieces == []
            continue
        assert pieces[0][0] == 0 and pieces[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
        assert all(n == count_tokens(t[a:b]) <= most for a, b, n in pieces)
        assert len(pieces) == 1 or count_tokens(t) > most
        assert encoding().decode(encoding().encode_ordinary(t)) == t


def test_pack_documents(spark):
    rows = [(i, t, "s", "k", "t", "c") for i, t in enumerate(texts() * 3)] + [(None, "null id", None, None, None, None)] * 2
    packed = pack_documents(spark.createDataFrame(rows, DOCS), capacity=512)
    out = packed.collect()
    room = {}
    for r in out:
        room[r.container_id] = room.get(r.container_id, 0) + r.tokens
    assert max(room.values()) <= 512
    want = sum(count_tokens(r[1]) for r in rows)
    assert abs(sum(room.values()) - want) <= 0.02 * want
    assert sum(r.doc_id is None for r in out) == 2
    report = container_report(packed, 512).first()
    assert report.containers == len(room) and report.containers <= report.least_containers * 1.15 + 1
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_pack_refuses_what_cannot_fit(spark):
    with pytest.raises(ValueError, match="larger"):
        pack(spark.createDataFrame([(1, 9)], "i int, tokens int"), 8)


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(1, 60), rng.choice(["Big ", "big", "BIG", "small", "tiny", None, "other"]) if i > 30 else "tiny", "", "", "") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.1, 2), ("gone", 0.1, None)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(docs, targets)
    out = mix.collect()
    used = {}
    for r in out:
        used[r.doc_id] = max(used.get(r.doc_id, 0), r.copy_no)
    repeats = {"big": 1, "small": 3, "tiny": 2}
    assert all(r.copy_no <= repeats[r.source] for r in out) and len(out) == sum(used.values())
    got = {r.source: r for r in report.collect()}
    assert got["gone"].tokens == 0 and abs(sum(r.reached_share for r in got.values()) - 1) < 1e-9
    for s, share in (("big", 0.5), ("small", 0.3), ("tiny", 0.1)):
        assert got[s].reached_share == pytest.approx(share / 0.9, rel=0.05)
    assert [sorted(mix_sources(docs, targets)[0].collect()) == sorted(out)] == [True]
    _, short = mix_sources(docs, targets, total_tokens=10**7)
    assert all(r.documents == r.available_documents * r.max_repeats for r in short.collect())


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(spark.createDataFrame([], DOCS), targets)
    assert mix.count() == 0 and report.first().reached_share == 0.0
    mix, report = mix_sources(spark.createDataFrame([(1, "x", "a", "", "", "")], DOCS), targets.limit(0))
    assert mix.count() == 0 and report.count() == 0
