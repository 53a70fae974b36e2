import datetime
import random

import pytest
from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.operators import dedup, graph, ledgers, merge, segment, sessions as S
from quernel.operators.joins import as_of, in_range


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("expr", "text", "want"),
    [
        (X.word_count, " a  b\nc ", 3), (X.word_count, "", 0), (X.word_count, None, 0), (X.heading_count, "## a\n```\n## b\n```\n### c\n# d", 2),
        (X.wikilinks, "[[A]] `[[x]]` [[B|b]] [[A]]\n```\n[[y]]\n```", ["A", "B"]), (X.wikilinks, None, []), (X.urls, "see https://a.b/c). and http://d.e", ["https://a.b/c", "http://d.e"]),
        (X.dedup_normal, " A\n<!-- x -->\n```js\nB  C\n```", "a b c"), (X.anchor_slug, "Trade-offs & more!", "trade-offs-more"), (X.anchor_slug, "?!", "section"),
        (X.first_sentence, "# h\n\nOne two. Three", "One two."), (X.strip_html, "<p>a &amp; b</p><script>x</script>", "a & b"), (X.html_title, "<TITLE> x\n y </title>", "x y"),
        (X.iso_date, "2026/1/5", datetime.date(2026, 1, 5)), (X.iso_date, "2026.13.40", None), (lambda c: X.masked_words(c, ["ab", "c.d"]), "AB abc c.d", "[redacted] abc [redacted]"),
    ],
)
def test_text(spark, expr, text, want):
    assert one(spark, expr, text) == want


@pytest.mark.parametrize(("words", "heads", "density", "tier"), [(0, 0, "brief", "stub"), (80, 0, "brief", "stub"), (81, 0, "brief", "brief"), (199, 0, "brief", "brief"), (200, 0, "brief", "standard"), (1000, 1, "standard", "standard"), (500, 5, "dense", "deep"), (2000, 0, "dense", "deep")])
def test_density(spark, words, heads, density, tier):
    r = spark.range(1).select(X.density_class(F.lit(words), F.lit(heads)).alias("d"), X.index_tier(F.lit(words), F.lit(heads)).alias("t")).first()
    assert (r.d, r.t) == (density, tier)


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def test_graph(spark):
    e = edges(spark, [("a", "B"), ("b", "A"), ("c", "A"), ("a", "A"), ("c", "Z")])
    titles = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", None)], "src string, title string")
    assert {r.title: r.sources for r in graph.backlinks(e, titles).collect()} == {"A": ["b", "c"], "B": ["a"], "Z": ["c"]}
    assert [r.title for r in graph.orphans(titles, e).collect()] == ["C"]
    assert [tuple(r) for r in graph.missing_pages(titles, e).collect()] == [("Z", 1)]
    assert [tuple(r) for r in graph.shared_neighbours(e, 1).orderBy("a", "b").collect()] == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1)]
    typed = spark.createDataFrame([("x", "supersedes", "y"), ("y", "superseded_by", "x"), ("x", "supersedes", "z"), ("x", "related", "z")], "src string, kind string, dst string")
    assert [r.dst for r in graph.missing_inverse(typed, {"supersedes": "superseded_by"}).collect()] == ["z"]
    assert graph.backlinks(edges(spark, []), titles).count() == 0


def test_host_scores_whole(spark):
    rows = [
        ("o", ["a"], "x", "Queue (Limits) and 句子!", "", "w/o.md"), ("tag", ["a"], "x", "t", "", "w/p.md"), ("words", [], "y", "t", "The queues\u00a0x-limits:句子", "w/q.md"), ("domain", [], "x", "t", "limits 句子。", "w/r.md"),
        ("over", [], "x", "t", "", "w/overview.md"), ("late", [], "x", "t", "z" * 2496 + " queue limits", "w/s.md"), ("one", [], "x", "t", "queue", "w/t.md"), ("else", ["a"], "general", "t", None, None),
        ("mix", [], "y", "t", "queue limits", "w/n/overview.md"),
    ]
    df = spark.createDataFrame(rows, "page string, tags array<string>, domain string, title string, body string, rel string")
    got = {r.host: r.score for r in graph.host_scores(df.filter("page = 'o'"), df, least=8).collect()}
    assert got == {"tag": 8, "domain": 9, "over": 9, "mix": 8}
    assert {r.host: r.hits for r in graph.title_hits(df.filter("page = 'o'"), df).collect()} == {"words": 3, "domain": 2, "one": 1, "mix": 2}


def test_host_scores(spark):
    rows = [("o", ["a", "b"], "x"), ("p", ["A ", "b"], "y"), ("q", ["a"], "x"), ("r", ["a", "a"], "general"), ("s", None, None)]
    df = spark.createDataFrame(rows, "page string, tags array<string>, domain string")
    got = {(r.orphan, r.host): r.score for r in graph.host_scores(df.filter("page = 'o'"), df).collect()}
    assert got == {("o", "p"): 6, ("o", "q"): 8}
    with pytest.raises(ValueError, match="least"):
        graph.host_scores(df, df, least=5)


def test_pair_ledger(spark):
    e = spark.createDataFrame([("m", "a", "b"), ("n", "b", "a"), ("m", "c", "d")], "src string, a string, b string")
    prior = spark.createDataFrame([("a", "b", "2026-01-01"), ("x", "y", "2026-01-01")], "first string, second string, first_observed string")
    got = graph.pair_ledger(e, prior, "2026-05-07").orderBy("first").collect()
    assert [(r.first, r.second, r.sources, r.first_observed) for r in got] == [("a", "b", ["m", "n"], "2026-01-01"), ("c", "d", ["m"], "2026-05-07")]


def test_exact_and_near(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(60)] for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for cut in (1, 2, 6):
            c = list(b)
            c[cut] = "changed"
            c = c[: 60 - cut]
            rows.append((100 + 10 * i + cut, " ".join(c)))
    rows += [(900, rows[0][1].upper() + "\n"), (901, None), (902, ""), (903, "two words"), (904, "two words")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, s string")
    classes = {r.doc_id: (r.class_id, r.copies) for r in dedup.exact_classes(df, "doc_id", "text").collect()}
    assert classes[900] == (0, 2) and classes[904] == (903, 2) and 901 not in classes and classes[902] == (902, 1)
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if w and " ".join(w) not in {x for x, _ in sets.values()}:
            sets[i] = (" ".join(w), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1])}
    assert len(want) > 5
    assert {(r.a, r.b) for r in dedup.near_links(df, "doc_id", "text").collect()} == want
    assert dedup.near_links(df.limit(0), "doc_id", "text").count() == 0


def test_sections():
    got = segment.sections_of("intro\n# Setup\na\n## Setup\r\nb\n### Setup 2\n#### no\n# ?!\n")
    assert [(s["id"], s["title"], s["level"]) for s in got] == [("setup", "Setup", 1), ("setup-2", "Setup", 2), ("setup-2-2", "Setup 2", 3), ("section", "?!", 1)]
    assert got[0]["bytes"][0] == 6 and all(a["bytes"][1] == b["bytes"][0] for a, b in zip(got, got[1:])) and got[0]["lines"] == [2, 3]
    assert segment.sections_of("") == []


def test_chunks():
    body = "intro\n\n" + "".join(f"# h{i}\n" + ("para. " * 200 + "\n\n") * (1 + 12 * (i % 3 == 0)) for i in range(9))
    got = segment.chunks_of(body, most=5000, least=2000)
    raw = body.encode()
    assert got[0]["title"].startswith("(intro)") and all(0 < c["end"] - c["start"] <= 5000 for c in got)
    kept = b"".join(raw[c["start"] : c["end"]] for c in got)
    assert kept.replace(b"\n", b"") == raw.replace(b"\n", b"")
    assert segment.chunks_of("") == [{"title": "(body)", "level": 0, "start": 0, "end": 0}]
    assert len(segment.chunks_of("字" * 5000, most=4000)) > 3


def test_merges(spark):
    t = "k int, at string, v string"
    got = merge.newest_wins(spark.createDataFrame([(1, "b", "ours"), (2, None, "ours"), (3, "a", "ours")], t), spark.createDataFrame([(1, "b", "theirs"), (2, "a", "theirs"), (4, None, "theirs")], t), ["k"], "at")
    assert {r.k: r.v for r in got.collect()} == {1: "ours", 2: "theirs", 3: "ours", 4: "theirs"}
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    assert sorted(r.line for r in merge.line_union(lines("a", "b", "b"), lines("b", "c", "c")).collect()) == ["a", "b", "b", "c", "c"]
    log = spark.createDataFrame([("a", "1"), ("b", ""), ("c", "3")], "name string, sha string")
    new = spark.createDataFrame([("a", "1"), ("a2", "1"), ("b", "9"), ("c", "4"), ("d", "5")], "name string, sha string")
    assert {r.name: r.decision for r in merge.absorb_decision(new, log).collect()} == {"a": "skip_same", "a2": "skip_dup", "b": "skip_same", "c": "refresh", "d": "run"}


def test_apply_changes(spark):
    pages = spark.createDataFrame([("p", "# P\n\n## One\nold\n\n## Two\nkeep"), ("q", "untouched")], "path string, body string")
    log = [("p", 2, "replace_section", "One", "new"), ("p", 1, "append", None, "tail"), ("p", 3, "create", None, "x"), ("n", 1, "create", None, "made"), ("n", 2, "replace_section", "No", "y")]
    got = {r.path: (r.body, r.failed) for r in merge.apply_changes(pages, spark.createDataFrame(log, "path string, seq int, action string, heading string, body string")).collect()}
    assert got["q"] == ("untouched", 0) and got["n"] == ("made", 1) and got["p"][1] == 1
    assert "## One\nnew" in got["p"][0] and "old" not in got["p"][0] and "## Two\nkeep\ntail" in got["p"][0]


def test_sessions(spark):
    s = spark.createDataFrame([(1, "a", "/p", 9, "2026-06-10", None), (2, "b", "/p", 2, "2026-06-09T01:00:00Z", None)], "id bigint, session_id string, project_path string, message_count int, updated_at string, summary string")
    m = spark.createDataFrame([(1, 1, "User ", "x" * 600 + " Limit", None, 3), (2, 1, "assistant", None, '"Grep"', 4), (3, 1, "assistant", "because", '"Edit"', 4)], "id bigint, session_id bigint, type string, text_content string, content string, sequence int")
    got = {r.session_id: r.verdict for r in S.session_verdict(S.session_stats(s, m)).collect()}
    assert got == {"a": "thin", "b": "empty"}
    score = S.keyword_scores(s, m, {"c": ["because"], "l": ["limit", "no such"]}, {"c": 3, "l": 2}).collect()
    assert [(r.session_id, r.c, r.l, r.score) for r in score] == [("a", 1, 1, 5)]
    has = lambda n: F.coalesce(F.col("content").contains(n), F.lit(False))
    assert S.first_before(m, has("Grep"), has("Edit")).first().first_leads is True
    near = spark.createDataFrame([(1, "a", "/p", 9, "2026-06-10T00:00:00Z", None), (2, "b", "/p", 2, "2026-06-09T01:00:00Z", None), (3, "c", "/q", 2, "2026-06-09T01:00:00Z", None), (4, "d", "/p", 2, "2026-04-01T00:00:00Z", None)], s.schema)
    assert {(r.session_id, r.other) for r in S.related_sessions(near).collect()} == {("a", "b"), ("b", "a")}


def test_ledgers(spark):
    rows = [("d1", "ollama", 5), ("d1", " Anthropic", 7), ("d1", None, 2), ("d2", "LLAMA.CPP", 9), ("d3", "x", None)]
    df = spark.createDataFrame(rows, "ledger_day string, provider string, output_tokens bigint")
    assert {r.day: r.output_tokens for r in ledgers.metered_output(df).collect()} == {"d1": 9, "d3": 0}
    newest = ledgers.newest_by(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string"), ["k"], ["at"], ["v"])
    assert {r.k: r.v for r in newest.collect()} == {"a": "y", "b": "z"}


def test_as_of_and_ranges(spark):
    rng = random.Random(4)
    t0 = datetime.datetime(2026, 1, 1)
    left = [(rng.choice("ab"), t0 + datetime.timedelta(hours=rng.randint(0, 300)), i) for i in range(80)]
    right = [(rng.choice("abc"), t0 + datetime.timedelta(hours=rng.randint(0, 300)), i) for i in range(40)] + [("a", None, 99)]
    l = spark.createDataFrame(left, "k string, at timestamp, i int")  # noqa: E741
    r = spark.createDataFrame(right, "k string, seen timestamp, v int")
    got = {x.i: x.v for x in as_of(l, r, ["k"], "at", "seen", ["v"]).collect()}
    want = {i: max(((s, v) for q, s, v in right if q == k and s and s <= at), default=(0, None))[1] for k, at, i in left}
    assert got == want
    ranges = spark.createDataFrame([("a", 5, 25), ("a", 24, 24), ("b", 0, 10)], "k string, low bigint, high bigint")
    points = spark.createDataFrame([("a", x) for x in (4, 5, 24, 25)] + [("b", 0)], "k string, x bigint")
    assert sorted((p.k, p.x) for p in in_range(points, ranges, ["k"], "x", "low", "high", 10.0).collect()) == [("a", 5), ("a", 24), ("b", 0)]


def test_transcript_turns(spark):
    said, tool = "".join(f"{i} " for i in range(900)), "{" + "é" * 1300 + "}"
    sessions = spark.createDataFrame([(1, "s")], "id bigint, session_id string")
    rows = [(4, 1, " User", said, None, 0), (5, 1, "assistant", "", tool, 1), (6, 1, "tool", None, " x ", 1), (7, 1, "tool", " \n", "unused", 2), (8, 1, "tool", "", "", 3), (9, 2, "user", "gone", None, 0), (3, 1, "system", "first", "unused", None)]
    messages = spark.createDataFrame(rows, "id bigint, session_id bigint, type string, text_content string, content string, sequence int")
    got = [tuple(r) for r in S.transcript_turns(sessions, messages).orderBy("turn").collect()]
    cut = "{" + "é" * 599 + "\n[...]\n" + "é" * 599 + "}"
    assert got == [("s", 1, "system", "first"), ("s", 2, "user", said), ("s", 3, "assistant", cut), ("s", 4, "tool", "x")]
