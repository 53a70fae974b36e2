"""Edges of the operators of corpus scope, runs, findings and relations: nulls, ties, repeats, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from quernel.functions import queue as Q
from quernel.operators import dedup, graph, lint, ordering, relations as R, runs as U, scope, sessions as S
from quernel.plans import pages


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_numbered(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 1), (None, None), ("b", 7), ("b", 7)], "g string, v int")
    got = rows(ordering.numbered(df, ["g"], ["v"], "place"))
    assert [(v, p) for g, v, p in got if g == "a"] == sorted((i, i + 1) for i in range(50)) or {(v, p) for g, v, p in got if g == "a"} == {(i, i + 1) for i in range(50)}
    assert {(v, p) for g, v, p in got if g is None} == {(None, 1), (1, 2)} and {p for g, v, p in got if g == "b"} == {1, 2}
    assert ordering.numbered(df.limit(0), ["g"], ["v"], "place").count() == 0


def test_stretches(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 100, 2), ("a", 100, 3), ("a", 90_000, 4), ("a", 90_050, 5), ("a", 400_000, 6), ("a", None, 7), ("b", 5, 8)], "u string, t bigint, k int").select("u", F.timestamp_seconds("t").alias("ts"), "k", F.lit(1).alias("n"))
    got = {r.k: r.stretch for r in ordering.stretches(df, ["u"], "ts", "k", 600).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 8: 1}


def test_related_sessions_as_brute_force(spark):
    import random

    rng = random.Random(3)
    data = [(f"s{i:03d}", rng.choice(["/p", "/q", None]), f"2026-01-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}:00:00Z" if rng.random() > 0.1 else None) for i in range(200)]
    got = {(r.session_id, r.place): r.other for r in S.related_sessions(spark.createDataFrame(data, "session_id string, project_path string, updated_at string")).collect()}
    hour = lambda t: int(t[8:10]) * 24 + int(t[11:13])
    want = {}
    for a, p, t in data:
        near = sorted((-hour(u), b) for b, q, u in data if p and t and u and q == p and b != a and abs(hour(u) - hour(t)) < 168)
        want |= {(a, k): b for k, (_, b) in enumerate(near[:5], 1)}
    assert got == want


def test_shared_neighbours_as_brute_force(spark):
    import random
    from collections import defaultdict

    rng = random.Random(4)
    edges = {(f"p{rng.randint(0, 40)}", f"t{rng.randint(0, 25)}") for _ in range(300)} | {(f"p{i}", "hot") for i in range(41)}
    links = defaultdict(set)
    for a, b in edges:
        links[a].add(b)
    for least in (1, 2, 4):
        want = sorted((a, b, n) for a in links for b in links if a < b and (n := len(links[a] & links[b])) >= least)
        got = graph.shared_neighbours(spark.createDataFrame([*edges, (None, "x"), ("p1", None)], "src string, dst string"), least)
        assert sorted(map(tuple, got.collect())) == want


def test_alike_pairs_as_brute_force(spark):
    import random

    rng = random.Random(5)
    words = [f"word{i:04d}" for i in range(400)]
    base = [rng.sample(words, rng.randint(45, 160)) for _ in range(12)]
    docs = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 30)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, " ".join(w[: rng.randint(30, len(w))] if rng.random() < 0.4 and len(w) > 40 else w)))
    docs += [(200, docs[0][1]), (201, None), (202, ""), (203, "short text")]
    first = {}
    for i, t in docs:
        if t:
            first.setdefault(t, i)
    sets = {i: set(t.split()) for t, i in first.items() if len(set(t.split())) >= 40}
    want = set()
    for a in sets:
        for b in sets:
            if a < b:
                m, n, c = len(sets[a]), len(sets[b]), len(sets[a] & sets[b])
                j, o = c / (m + n - c), c / min(m, n)
                if j >= 0.55 or (o >= 0.7 and max(m, n) / min(m, n) <= 4 and j >= 0.3):
                    want.add((a, b, c))
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id int, text string, n int, s int")
    got = {(r.a, r.b, r.shared) for r in dedup.alike_pairs(df, "doc_id", "text").collect()}
    assert got == want and len(want) > 50
    assert dedup.alike_pairs(df.limit(0), "doc_id", "text").count() == 0


def _alike(docs):
    """Brute force: a, b, shared of (id, text) by different texts' smallest ids."""
    first = {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        first.setdefault(t, i)
    sets = sorted((i, s) for t, i in first.items() if len(s := set(t.split())) >= 40)
    want = set()
    for a, x in sets:
        for b, y in sets:
            if a < b:
                m, n, c = len(x), len(y), len(x & y)
                if c / (m + n - c) >= 0.55 or (c / min(m, n) >= 0.7 and max(m, n) / min(m, n) <= 4 and c / (m + n - c) >= 0.3):
                    want.add((a, b, c))
    return want


def _versions(rng, words, size, bases, n):
    """Texts of random words, some of them versions of a few."""
    base, docs = [rng.sample(words, rng.randint(45, size)) for _ in range(bases)], []
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.7 else rng.sample(words, rng.randint(45, size))
        for _ in range(rng.randint(0, 30)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((f"d{i:04d}", " ".join(w[: rng.randint(30, len(w))] if rng.random() < 0.4 else w)))
    return docs


def test_alike_pairs_of_few_words_join_no_words(spark, monkeypatch):
    import random

    docs = _versions(random.Random(7), [f"word{i:04d}" for i in range(700)], 420, 20, 400)
    docs += [(None, docs[0][1]), (None, "null id " * 50)]
    df = spark.createDataFrame(docs, "k string, text string")
    want = _alike(docs)
    assert len(want) > 500 and any(c > 255 for _, _, c in want)
    for block, tile, head in ((8192, 4096, 8192), (60, 37, 300), (8192, 4096, 1)):
        for name, value in (("BLOCK", block), ("TILE", tile), ("HEAD", head)):
            monkeypatch.setattr(dedup, name, value, raising=False)
        pairs = dedup.alike_pairs(df, "k", "text")
        assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
        got = [(r.a, r.b, r.shared) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_alike_pairs_of_one_size_and_of_many_words(spark, monkeypatch):
    import random

    rng = random.Random(8)
    words = [f"word{i:05d}" for i in range(90)]
    docs = [(f"d{i:03d}", " ".join(rng.sample(words, 60))) for i in range(150)]
    monkeypatch.setattr(dedup, "BLOCK", 20, raising=False)
    pairs = lambda: {(r.a, r.b, r.shared) for r in dedup.alike_pairs(spark.createDataFrame(docs, "k string, text string"), "k", "text").collect()}
    assert pairs() == _alike(docs) and len(_alike(docs)) > 500
    docs = [(f"{g}-{k}", t) for g in range(40) for k, t in _versions(rng, [f"word{g}x{i:04d}" for i in range(400)], 60, 1, 5)]
    monkeypatch.setattr(dedup, "RICH", 1, raising=False)  # each word is in a few texts only: they are joined
    assert pairs() == _alike(docs) and len(_alike(docs)) > 20


def test_duplicate_report_reads_texts_once(spark, tmp_path):
    import random

    docs = _versions(random.Random(9), [f"word{i:04d}" for i in range(300)], 200, 5, 60)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    docs += [(100 + i, docs[i][1]) for i in range(4)] + [(None, docs[0][1]), (None, docs[5][1]), (None, "no id"), (None, "no id"), (200, None), (201, None)]
    spark.createDataFrame(docs, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    report = pages.duplicate_report(spark, str(tmp_path))
    assert "FileScan" not in report._jdf.queryExecution().executedPlan().toString()
    want = sorted(_alike([(i, t) for i, t in docs if t]))
    got = report.collect()
    assert [r.place for r in got] == [*range(1, 1 + min(150, len(want)))] and got == sorted(got, key=lambda r: (-r.overlap, r.a, r.b))
    assert {(r.a, r.b) for r in got} <= {(a, b) for a, b, _ in want} and {r.classes for r in got} == {5}


def test_names_and_lookups(spark):
    paths = spark.createDataFrame([("/a/x",), ("/b/x",), ("/c/b/x",), ("/a/y",), ("/x",)], "path string")
    names = {r.path: r.name for r in scope.display_names(paths).collect()}
    assert len(set(names.values())) == 5 and names["/a/x"] == "x" and names["/b/x"] == "b-x" and names["/c/b/x"] == "b-x-2" and names["/a/y"] == "y"
    projects = spark.createDataFrame([("/a/x", "x"), ("/b/x", "x"), ("/a/y", "y")], "path string, name string")
    asked = spark.createDataFrame([("x",), ("y",), ("/b/x",), ("/no",), (None,), ("y",)], "arg string")
    assert rows(scope.resolve_projects(asked, projects)) == rows(spark.createDataFrame([("x", None, 2), ("y", "/a/y", 1), ("/b/x", "/b/x", 1), ("/no", None, 0), (None, None, 0)], "a string, p string, n bigint"))
    articles = spark.createDataFrame([("wiki/a.md", "The Title"), ("wiki/b.md", "the title"), ("c.md", None)], "rel string, title string")
    got = {r.arg: r.rel for r in scope.resolve_articles(spark.createDataFrame([("a.md",), ("THE TITLE",), ("c.md",), ("no.md",), ("",)], "arg string"), articles).collect()}
    assert got == {"a.md": "wiki/a.md", "THE TITLE": "wiki/a.md", "c.md": "c.md", "no.md": None, "": None}


def test_texts_of_scope(spark):
    df = spark.createDataFrame([("---\nt: 1\n---\n<!-- retrieval-context -->\n> c\n\nbody \n",), (" body",), (None,), ("<!-- retrieval-context --> cut",)], "t string")
    assert [r[0] for r in df.select(scope.comparable_body(F.col("t"))).collect()] == ["body", "body", None, ""]
    blocks = scope.identity_blocks(spark.createDataFrame([("x\n### Jo Doe\n- aliases: jo, @jd\n- email: a@b.c\naliases: again\n### Empty\ntext\n###   Al\n**Forms:** A, , B", 7), (None, 8), ("", 9)], "body string, n0 int"))
    assert [(r.n, r.name, r.fields) for r in blocks.orderBy("n").collect()] == [(1, "Jo Doe", {"aliases": ["jo", "@jd"], "email": ["a@b.c"]}), (3, "Al", {"forms": ["A", "B"]})]
    assert spark.range(1).select(scope.listed_folders(F.lit(" a, b,,a "))).first()[0] == ["a", "b"]
    files = spark.createDataFrame([("a.md", "2026-01-02 00:00:00"), ("b.md", None)], "path string, m string").select("path", F.col("m").cast("timestamp").alias("m"))
    assert [scope.newer_than(files, "m", c).count() for c in (None, "", "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z", "no time")] == [2, 2, 1, 0, 0]
    assert rows(scope.changed_paths(files.select("path"), spark.createDataFrame([("a.md",), ("c.txt",), ("d.md",)], "path string"))) == [("a.md",), ("b.md",), ("d.md",)]
    assert rows(scope.broken_json(spark.createDataFrame([("a", "{}"), ("b", "{"), ("c", None), ("d", " ")], "p string, t string"), "t", "p")) == [("b",), ("c",), ("d",)]


def test_relations(spark):
    f = spark.createDataFrame([("a", "decision"), ("b", None), ("c", "person"), ("d", "unheard")], "src string, type string")
    e = spark.createDataFrame([("a", "supersedes", "B"), ("a", "extends", "B"), ("b", "extends", "A"), ("c", "extends", "A"), ("d", "extends", "A"), ("gone", "extends", "A")], "src string, kind string, dst string")
    assert rows(R.not_allowed(e, f)) == [("a", "decision", "extends", "B"), ("c", "person", "extends", "A"), ("d", "unheard", "extends", "A")]
    near = R.neighbourhoods(e, spark.createDataFrame([("a", "A"), ("b", "b"), ("n", None)], "page string, title string"))
    assert ("b", "in", "extends", "a") in rows(near) and ("a", "in", "extends", "b") in rows(near) and near.filter("page = 'n'").count() == 0
    assert [r[0] for r in spark.createDataFrame([("[[X|y]]",), (" [[Z]] ",), ("plain",), (None,)], "t string").select(R.link_target(F.col("t"))).collect()] == ["X", "Z", "plain", None]
    ledger = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, first string")
    assert rows(R.resolved(ledger, ledger.filter("id = '1'").select("id", F.lit("done").alias("note")), "now")) == [("1", "x", "now", "done"), ("2", "y", None, None)]


def test_findings(spark):
    a = spark.createDataFrame([("x.md", "a\n" * 20, True), ("x.md.md", "", False), ("y/own/z.md", "<<<<<<< ours\nb", False), ("t-{{NAME}}.md", None, False), ("r-archive-2025.md", "a\n" * 300, True), ("r.md", "a\n" * 201, True), ("long.md", "a\n" * 151, False)], "rel string, text string, rolling boolean")
    got = {(r["class"], r.path) for r in lint.size_findings(a, rolling=F.col("rolling")).collect()}
    assert got == {("thin-article", "x.md.md"), ("thin-article", "y/own/z.md"), ("thin-article", "t-{{NAME}}.md"), ("rolling-overgrown", "r.md"), ("bloated-article", "long.md")}
    found = {(r["class"], r.path) for r in lint.artifact_findings(a, names=["Own"]).collect()}
    assert found == {("placeholder-path", "t-{{NAME}}.md"), ("self-ingested-copy", "x.md.md"), ("self-named-dir", "y/own/z.md"), ("conflict-marker", "y/own/z.md")}
    same = spark.createDataFrame([("b/c/x.md", "t"), ("b/x.md", "t"), ("a/x.md", "t"), ("u.md", "u"), ("n.md", None), ("m.md", None)], "rel string, text string")
    assert rows(lint.identical_findings(same)) == [("a/x.md", "b/c/x.md", 3), ("a/x.md", "b/x.md", 3)]
    assert lint.size_findings(a.limit(0)).count() == lint.identical_findings(same.limit(0)).count() == 0
    says = ["missing required fields: title", "missing required fields: tags", "title is empty", "invalid confidence x", "invalid domain", "empty file", "what", None]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in says], "m string").select(lint.error_class(F.col("m"))).collect()] == ["needs-title", "fixable", "needs-title", "needs-confidence", "fixable", "needs-frontmatter", "other", "other"]


def test_runs(spark):
    schema = "command string, status string, at string, error string, args array<string>, degraded array<string>, degraded_errors map<string,string>, mode string"
    runs = spark.createDataFrame([
        ("sync", "ok", "1", None, ["--a", "x"], None, None, None), ("sync", "degraded", "2", None, ["--a"], ["p", "q"], {"p": "why"}, None), ("sync", "error", "3", "bad", None, None, None, None),
        ("dream", "ok", "4", None, ["--hot"], None, None, "hot"), ("dream", "ok", "5", None, ["--hot"], None, None, "full"), ("dream", "degraded", "6", None, None, [], None, None), (None, "ok", "9", None, None, None, None, None), ("x", "ok", None, None, None, None, None, None),
    ], schema)
    assert {r.key: r.at for r in U.last_ok(runs).collect()} == {"dream": "6", "dream --hot": "5", "sync": "2", "sync --a": "2"}
    assert {r.command: (r.at, r.error) for r in U.last_errors(runs).collect()} == {"sync": ("3", "bad"), "dream": ("6", "partial failure (phases not recorded)")}
    assert U.last_errors(runs.filter("at < '3'")).first().error == "partial failure in p, q: why"
    assert rows(U.run_history(runs, "dream", "--hot", "hot")) == [("6", "4")] and rows(U.run_history(runs.limit(0), "dream", "--hot", "hot")) == [(None, None)]
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("c", 1)], "k string, n int")
    assert rows(U.busiest(counts, "k", "n")) == [("a", 3)] and U.busiest(counts, "k", "n", least=9).count() == 0
    assert [r[0] for r in spark.createDataFrame([("a/b",), ("/b",), ("b",), (None,)], "m string").select(U.provider_of(F.col("m"))).collect()] == ["a", "anthropic", "anthropic", "anthropic"]
    lease = lambda *r: spark.createDataFrame(list(r), "holder string")
    assert rows(U.merge_lease(lease(("us",)), lease(("them",)))) == [("us",)] and rows(U.merge_lease(lease(), lease(("them",)))) == [("them",)]


@pytest.mark.parametrize("note", [None, "", "a", "two\nlines", "back\\slash", "\\n literal", "a\\\\\nb\r\nc"])
def test_queue_notes_come_back(spark, note):
    text = Q.queue_text(F.lit("https://a.example/x:1"), F.lit("T"), F.array(F.lit("a"), F.lit("")), F.lit("d"), F.lit("auto"), F.lit(None).cast("string"), F.lit(note).cast("string"), F.lit("now"))
    got = spark.range(1).select(Q.queue_fields(text).alias("f")).select("f", Q.queue_note(F.col("f")).alias("n")).first()
    assert got.n == (note or None) and got.f["url"] == "https://a.example/x:1" and "fetcher" not in got.f and got.f["tags"] == "a"


def test_queue_fields_of_anything(spark):
    df = spark.createDataFrame([("# c\nurl: a\nurl: b\nno colon\n : x\n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(Q.queue_fields(F.col("t"))).collect()] == [{"url": "a", "": "x"}, {}, None]
    blobs = spark.createDataFrame([(b"\x00https://a.example/p\x01http://b.c\xffhttps:// http://",), (b"",), (None,)], "b binary")
    assert [r[0] for r in blobs.select(Q.byte_urls("b")).collect()] == [["https://a.example/p", "http://b.c"], [], None]
