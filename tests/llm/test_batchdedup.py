import random
import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from quernel.llm import batchdedup
from quernel.llm.batchdedup import History, check_batch, check_in_loads, page_key
from quernel.session import checkpointed

SCHEMA = "entry_id bigint, url string, note string, page string, triples string"


def brute(rows):
    pages, held, sets, out = {}, defaultdict(list), {}, {}
    for i, u, n in sorted(rows):
        key, hits = page_key(u), []
        if key is not None and key in pages:
            hits.append(pages[key])
        w = re.findall("[a-z0-9]+", (n or "").lower())
        mine = set(zip(w, w[1:], w[2:])) if len(w) >= 20 else set()
        shared = Counter(a for x in mine for a in held[x])
        hits += [a for a, m in shared.items() if m >= 0.5 * (len(mine) + len(sets[a]) - m)]
        out[i] = min(hits, default=None)
        if not hits:
            if key is not None:
                pages[key] = i
            if mine:
                sets[i] = mine
                for x in mine:
                    held[x].append(i)
    return out


def rows_of(seed, n, first=0):
    rng = random.Random(seed)
    notes = [[rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(18, 40))] for _ in range(25)]
    rows = []
    for i in range(first, first + n):
        note = list(rng.choice(notes))
        for _ in range(rng.randint(0, 9)):
            note[rng.randrange(len(note))] = rng.choice("pqrs")
        url = rng.choice([None, "", f"https://h{rng.randint(0, 40)}.example/a", f"http://www.h{rng.randint(0, 40)}.example/a/?utm_source=x"])
        rows.append((i, url, rng.choice([None, "", " ".join(note), "short note"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "t") for r in rows], SCHEMA)


def test_as_brute_force_in_one_batch_and_in_three(spark):
    rows = rows_of(1, 400)
    want = brute(rows)
    got, _ = check_batch(frame(spark, rows))
    assert {r.entry_id: r.repeats for r in got.collect()} == want
    history, parts = None, {}
    for a, b in ((0, 150), (150, 151), (151, 400)):
        got, history = check_batch(frame(spark, rows[a:b]), history)
        parts |= {r.entry_id: r.repeats for r in got.collect()}
    assert parts == want


def test_history_on_disk(spark, tmp_path):
    rows, path = rows_of(2, 240), str(tmp_path / "history")
    got, history = check_batch(frame(spark, rows[:120]))
    out = {r.entry_id: r.repeats for r in got.collect()}
    history.append(path, "1")
    history.append(path, "1")  # a batch run again after a failure adds nothing twice
    for k, part in ((2, rows[120:200]), (3, rows[200:])):
        got, history = check_batch(frame(spark, part), History.open(spark, path))
        out |= {r.entry_id: r.repeats for r in got.collect()}
        history.append(path, str(k))
    assert out == brute(rows)
    assert sorted(r.entry_id for r in History.open(spark, path).entries.collect()) == sorted(i for i, a in out.items() if a is None and any(x for x in rows[i][1:]) and (page_key(rows[i][1]) or len((rows[i][2] or "").split()) >= 20))


def test_edges(spark):
    empty, history = check_batch(frame(spark, []))
    assert empty.count() == 0
    rows = [(1, "https://a.example/x", None), (1, "https://a.example/x", None), (2, "https://A.example:443/x/#top", None), (3, None, None), (4, "", " "), (None, "https://a.example/x", None)]
    long = " ".join(f"w{i}" for i in range(20_000))
    rows += [(5, None, long), (6, None, long + " tail")]
    got, _ = check_batch(frame(spark, rows), history)
    assert {r.entry_id: r.repeats for r in got.collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: 5}


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("https://a.example/p?b=2&a=1", "http://www.a.example:80/p/?a=1&b=2&fbclid=q", True),
        ("https://go.x.example/r?to=https%3A%2F%2Fa.example%2Fp%3Fid%3D1", "https://a.example/p?id=1", True),
        (" <https://m.a.example//x/./y/index.html#top> ", "https://a.example/x/y", True),
        ("https://a.example/%7Ejo", "https://a.example/~jo", True),
        ("https://a.example/list?page=1", "https://a.example/list?page=2", False),
        ("https://a.example/list?ref=v2.1", "https://a.example/list", False),
        ("https://a.example/P", "https://a.example/p", False),
        ("https://a.example/#/route", "https://a.example/", False),
    ],
)
def test_page_key(a, b, same):
    assert (page_key(a) == page_key(b)) is same


def test_page_key_of_anything():
    for u in (None, "", "  ", "not a url", "http://[bad", "mailto:x@y.z", "//a.example/x", "https://ünï.example/ä", "https://a.example:99999/"):
        assert page_key(u) is None or isinstance(page_key(u), str)


def test_loads_through_the_stored_history(spark, tmp_path):
    """Many loads, of which some are single rows; the index is made anew on the way; batches without a number go first."""
    rows, path = rows_of(3, 300), str(tmp_path / "history")
    batch_no = F.when(F.col("entry_id") < 5, None).otherwise(F.floor(F.col("entry_id") / 10))
    parts = check_in_loads(frame(spark, rows).withColumn("batch_no", batch_no), path, [1, 2, 6, 15])
    out = {r.entry_id: r.repeats for p in parts for r in p.collect()}
    assert out == brute(rows)
    history = History.open(spark, path)
    assert history.version >= 1 and history.sets <= 3 * history.made_of
    assert history.notes.count() == history.notes.select("key").distinct().count() == history.sets


def test_small_batches_leave_the_history_where_it_lies(spark, tmp_path):
    """No stored table is shuffled or sorted for a batch of few keys."""
    rows, path = rows_of(4, 300), str(tmp_path / "history")
    _, history = check_batch(frame(spark, rows[:290]))
    history.append(path, "1")
    stored = History.open(spark, path)
    batch = checkpointed(batchdedup._keyed(frame(spark, rows[290:]), "entry_id", "url", "note", 20))
    sets = batchdedup._distances(batch.filter("key is not null").selectExpr("key", "entry_id as note", "triples"))
    probes = checkpointed(batchdedup._prefixes(sets, checkpointed(stored.order), 0.5))
    assert batchdedup._few(probes)
    plans = [batchdedup._known(stored.notes, batch, "key", True), batchdedup._known(stored.entries, batch, "page", True)]
    for df in plans:
        assert "hashpartitioning" not in df._jdf.queryExecution().sparkPlan().toString() and "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x and "Broadcast" not in x]
    found = batchdedup._candidates(F.broadcast(probes), stored.postings, 0.5, within=False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in found and "BroadcastHashJoin" in found


def test_a_search_is_no_relay():
    assert page_key("https://a.example/?q=https%3A%2F%2Fb.example%2Fp") != page_key("https://b.example/p")
    assert page_key("https://a.example/?url=https%3A%2F%2Fb.example%2Fp") == page_key("https://a.example/url?q=https%3A%2F%2Fb.example%2Fp") == page_key("https://b.example/p")
