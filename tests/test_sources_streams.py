import datetime

from pyspark.sql import functions as F

from quernel.session import checkpointed
from quernel.sources.files import append_ledger, front_field, front_list, read_articles, read_ledger, read_queue
from quernel.streaming.watch import file_stream, user_sessions, watch, windowed_counts


def test_articles(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki/a.md").write_text('---\ntitle: "Old"\ntitle: New: one\ntags: [x, "y"]\n---\n# Body\n')
    (tmp_path / "wiki/_skip.md").write_text("x")
    (tmp_path / "wiki/b.md").write_text("no front matter")
    rows = {r.rel: r for r in read_articles(spark, str(tmp_path)).select("rel", "body", front_field("front", "title").alias("t"), front_list("front", "tags").alias("tags")).collect()}
    assert set(rows) == {"wiki/a.md", "wiki/b.md"}
    assert rows["wiki/a.md"].t == "New: one" and rows["wiki/a.md"].tags == ["x", "y"] and rows["wiki/a.md"].body == "# Body\n"
    assert rows["wiki/b.md"].t == "" and rows["wiki/b.md"].body == "no front matter"
    assert read_articles(spark, str(tmp_path), with_underscored=True).count() == 3


def test_ledger_and_queue(spark, tmp_path):
    root = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("2026-01-01", "m", True), ("2026-01-02", "n", False)], "day string, model string, ok boolean")
    append_ledger(rows, root)
    (tmp_path / "ledger/day=2026-01-01/late.json").write_text('{"model": "cut\n')
    back = read_ledger(spark, root)
    assert back.count() == 3 and sum(r._corrupt_record is not None for r in back.collect()) == 1
    assert [r.model for r in read_ledger(spark, root, since="2026-01-02").collect()] == ["n"]
    (tmp_path / "q.txt").write_text("url: https://a.b/c:d\nnote: x\nnote: y\nnothing\n")
    assert read_queue(spark, str(tmp_path / "q.txt")).first().fields == {"url": "https://a.b/c:d", "note": "y"}


EVENTS = "key string, ts timestamp, event_type string, user_id bigint, value double"


def write(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_watch(spark, tmp_path):
    t = datetime.datetime(2026, 1, 1)
    src = str(tmp_path / "in")
    write(spark, src, [("a", t, "x", 1, 1.0), ("a", t, "x", 1, 1.0)])
    schema = spark.read.parquet(src).schema
    run = lambda: watch(file_stream(spark, src, schema, 1), str(tmp_path / "cp"), str(tmp_path / "seen"), "key", lambda df: df.filter("value > 0"), str(tmp_path / "out"), "0 seconds")
    for more in ([("b", t, "x", 1, 1.0), ("a", t, "x", 1, 2.0)], [("c", t, "x", 1, 0.0)]):
        q = run()
        q.processAllAvailable()
        q.stop()
        write(spark, src, more)
    q = run()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_windows(spark, tmp_path):
    t = datetime.datetime(2026, 1, 1)
    src = str(tmp_path / "in")
    write(spark, src, [(str(i), t + datetime.timedelta(minutes=20 * i), "x", i % 2, 1.0) for i in range(30)])
    schema = spark.read.parquet(src).schema
    for make, name in ((windowed_counts, "w1"), (lambda d: windowed_counts(d, slide="30 minutes"), "w2"), (user_sessions, "w3")):
        q = make(file_stream(spark, src, schema)).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("w1").filter("span.start = timestamp '2026-01-01 01:00:00'").first().events == 3
    assert spark.table("w2").count() > spark.table("w1").count()


def test_checkpointed(spark):
    df = checkpointed(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90 and spark.sparkContext.getCheckpointDir()
