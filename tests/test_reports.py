import pytest
from pyspark.sql import functions as F

from quernel.operators import reports as P, segment
from quernel.sources.pulled import with_retry
from quernel.streaming.watch import Heartbeat


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sections_of_a_report(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "2", "z"), ("b", "2", "zz"), ("c", None, "n"), (None, "9", "n"), ("d", "0", None)], "k string, at string, t string")
    got = P.top_of(df, "s", F.col("k"), F.col("at"), F.col("t"), 2)
    assert rows(got) == [("s", 1, "a", "2", "y"), ("s", 2, "b", "2", "zz")]
    assert P.report(got, P.top_of(df, "u", F.col("k"), F.col("at"), F.col("t"), 9, since="2")).count() == 4
    assert P.top_of(df.limit(0), "s", F.col("k"), F.col("at"), F.col("t"), 2).count() == 0


def test_figures_and_windows(spark):
    df = spark.range(5)
    assert rows(P.checks(P.figures(a=df, b=df.limit(0)), {"a": 4, "b": 0})) == [("a", 5, "warn"), ("b", 0, "ok")]
    w = spark.createDataFrame([(7, 1, 2), (30, 3, None)], "days int, led int, decided int")
    assert P.windows_row(w, "days", ["led", "decided"]).first().asDict() == {"led_7d": 1, "decided_7d": 2, "led_30d": 3, "decided_30d": None}


def test_texts(spark):
    df = spark.createDataFrame([("- a\n  - b\n### c\n### d", True), ("- a\n### c", False), (None, True)], "t string, flat boolean")
    assert [r[0] for r in df.select(P.proposal_items(F.col("t"), F.col("flat"))).collect()] == [2, 1, 0]
    t = spark.createDataFrame([("deep ", "stub"), ("none", " Stub"), (None, "fxTwitter"), (None, None)], "o string, v string")
    assert [r[0] for r in t.select(P.raw_tier(F.col("o"), F.col("v"), F.lit("standard"))).collect()] == ["deep", "stub", "brief", "standard"]
    a = spark.createDataFrame([("p", "[[A]] `[[A]]` [[B]]"), ("q", None)], "rel string, body string")
    assert rows(P.link_diff(a)) == [("p", "A", 2, 1)]
    pages = spark.createDataFrame([("a/x.md", "---\ntitle: T\n---\nb"), ("a/_index.md", "x"), ("y.md", None)], "rel string, text string")
    got = {r.rel: r.text for r in P.promoted(pages, "here", "2026-01-01").collect()}
    assert set(got) == {"a/x.md", "y.md"} and got["y.md"] is None
    assert 'promoted_from: "here:a/x.md"\npromoted_at: 2026-01-01\n---\nb' in got["a/x.md"]


def test_chats_and_projects(spark):
    m = spark.createDataFrame([(1, "c", 5), (1, "c", 5), (2, "c", 1), (3, "d", 9), (4, None, 9)], "id int, chat string, at int")
    chats = spark.createDataFrame([("c", "h1"), ("c", "h2"), ("d", "h3"), (None, "h1")], "chat string, handle string")
    handles = spark.createDataFrame([("h1", "me"), ("h2", "me"), ("h3", "you"), (None, "me")], "handle string, address string")
    assert rows(P.messages_to_self(m, chats, handles, ["me"], F.lit(2))) == [(1, "c", 5)]
    s = spark.createDataFrame([("s1", "/a", "2"), ("s2", "/b", "2"), ("s3", "/a", "0"), ("s4", None, "9")], "session_id string, project_path string, updated_at string")
    p = spark.createDataFrame([("/a", None), ("/b", "pending")], "path string, status string")
    assert sorted(r.session_id for r in P.approved_sessions(s, p, F.lit("1")).collect()) == ["s1"]


def test_retry():
    waits, calls = [], []

    def ask():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "got"

    assert with_retry(ask, wait=waits.append) == "got" and len(waits) == 2 and 0.1 <= waits[0] <= 0.3 <= 2 * waits[1]
    with pytest.raises(ValueError, match="no"):
        with_retry(lambda: (_ for _ in ()).throw(ValueError("no")), wait=waits.append)
    with pytest.raises(ConnectionError):
        with_retry(lambda: (_ for _ in ()).throw(ConnectionError()), attempts=2, wait=lambda _: None)


def test_heartbeat(spark, tmp_path):
    said = []
    beat = Heartbeat(lambda *x: said.append(x))
    spark.streams.addListener(beat)
    try:
        spark.range(3).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")).writeStream.queryName("beat").format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        for _ in range(50):
            if any(x[1] == 0 for x in said):
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(beat)
    assert ("beat", -1, 0, 0.0) in said and any(x[:3] == ("beat", 0, 3) for x in said)


def test_chunks_by_contents(spark, tmp_path):
    body = "front\n\n# One\ntext\n\n## Two \nmore\n\nThree\n" + "para\n\n" * 30
    assert [(c["title"], body.encode()[c["start"] : c["end"]][:6]) for c in segment.toc_chunks_of(body, ["One", "Two", "gone", "Three"])] == [("(front)", b"front\n"), ("One", b"# One\n"), ("Two", b"## Two"), ("Three", b"Three\n")]
    assert segment.toc_chunks_of(body, ["One", "x", "y"]) == [] and segment.toc_chunks_of("", []) == [] and segment.toc_chunks_of(body, [""]) == []
    cut = segment.toc_chunks_of(body, ["Three"], most=60)
    assert cut[1]["title"].startswith("Three (part 1/") and all(c["end"] - c["start"] <= 60 for c in cut)
    df = spark.createDataFrame([(1, body, ["One", None]), (2, None, ["x"]), (3, body, None)], "article_id int, body string, toc array<string>")
    assert {r.article_id for r in segment.toc_chunks(df).collect()} == {1}
    pages = spark.createDataFrame([("a", "# x\n# x\n"), ("b", "no heads"), ("c", None)], "rel string, body string")
    segment.write_sidecars(pages, str(tmp_path / "s"))
    read = spark.read.parquet(str(tmp_path / "s"))
    assert [(r.rel, [s.id for s in r.sections]) for r in segment.fresh_sidecars(read, pages).collect()] == [("a", ["x", "x-2"])]
    assert segment.fresh_sidecars(read, pages.withColumn("body", F.concat("body", F.lit("!")))).count() == 0
