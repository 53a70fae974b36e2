import pytest
from pyspark.sql import functions as F

from quernel.functions import markup as M, paths as P
from quernel.operators import intake


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values)))
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first().x


ROOTS = ("wiki", "tools")


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (lambda c: P.matches_glob(c, "/work/*/drafts"), "/work/a/drafts/x/y", True), (lambda c: P.matches_glob(c, "/work/*"), "/home/a", False), (lambda c: P.matches_glob(c, "a.b?"), "aXbc", False), (lambda c: P.matches_glob(c, "**/z"), "a/b/z", True),
        (P.remote_key, "git@Host.example:Team/repo.git", "host.example/team/repo"), (P.remote_key, "https://u:p@host.example/team/repo/", "host.example/team/repo"),
        (lambda c: P.within(c, "/a/b/"), "/a/bc", False), (lambda c: P.within(c, "/a/b"), "/a/b/c", True), (lambda c: P.ignored_path(c, ["/w/a/b/c"]), "/w/a/b/c/d", True), (P.ignored_path, "/w/a/b/d", False), (P.ignored_path, None, True),
        (P.base_name, "/a/b/", "b"), (P.folder, "a/b/c.md", "a/b"), (P.folder, "c.md", ""), (P.has_placeholder_name, "a/{{TITLE}}.md", True), (P.canonical_of_copy, "a/x_md.md", "a/x.md"), (P.canonical_of_copy, "a/x.md", None),
        (lambda c: P.safe_target(c, ROOTS), "wiki/a.md", True), (lambda c: P.safe_target(c, ROOTS), "wiki/../a.md", False), (lambda c: P.safe_target(c, ROOTS), "/wiki/a.md", False), (lambda c: P.safe_target(c, ROOTS), "wiki/_a.md", False), (lambda c: P.safe_target(c, ROOTS), None, False),
        (P.duration_seconds, "1h30m", 5400.0), (P.duration_seconds, "1.5d", 129600.0), (P.duration_seconds, "soon", None),
        (M.conflict_line, "a\n<<<<<<< x\nb", 2), (M.conflict_line, "a", None), (lambda c: M.cut_outside_links(c, 8), "abc [[long link]] d", "abc"), (lambda c: M.cut_outside_links(c, 8), "abcdefghij", "abcdefgh"), (lambda c: M.cut_outside_links(c, 8), "abc", "abc"),
        (M.looks_like_person, "Orlin Vask", True), (M.looks_like_person, "orlin Vask", False), (M.looks_like_person, "OpenAlpha Works", False), (M.looks_like_person, "One", False),
        (M.plain_paragraph, "Here is the text:\n\na\nb ", "a b"), (lambda c: M.head_and_tail(c, 5, 2), "abcdefgh", "ab\n[...]\ngh"), (M.first_object, 'x {"a": "}\\"", "b": {}} {', '{"a": "}\\"", "b": {}}'), (M.first_object, "none {", None),
        (lambda c: M.bytes_shown(c.cast("bigint")), "1536", "1.5 KB"), (lambda c: M.bytes_shown(c.cast("bigint")), "12", "12 B"),
    ],
)
def test_columns(spark, expr, value, want):
    assert one(spark, expr, value) == want


def test_more_columns(spark):
    assert one(spark, M.strip_citations, "a [c01-f1] b [c02-f9]", ["c01-f1"]) == "a [c01-f1] b "
    assert one(spark, M.weak_context, "too short", "x") == "short"
    long = " ".join(["word"] * 30)
    assert one(spark, M.weak_context, long, "x") == "unfinished" and one(spark, M.weak_context, long + ".", f"a {long}. b") == "echo" and one(spark, M.weak_context, long + ".", "x") is None
    held = lambda c: M.hold_or_mask(c, ["secret"], ["name"])[0]
    shown = lambda c: M.hold_or_mask(c, ["secret"], ["name"])[1]
    assert one(spark, held, "a Secret") and not one(spark, held, "a secret allow-stop-word") and one(spark, shown, "my Name\nname allow-stop-word") == "my [redacted]\nname allow-stop-word"
    allowed = lambda p, r: P.source_allowed(p, r, ["/work/private"], ["host/team"], ["/work/open"])
    assert [one(spark, allowed, p, r) for p, r in (("/work/private/a", "host/team/x"), ("/x", "https://host/team/x.git"), ("/work/open/b", None), ("/x", "host/teams/x"))] == [False, True, True, False]


def test_pull(spark):
    rows = [(1, "i1", "https://a/1", ["X "]), (2, "i1", "https://a/2", ["x"]), (3, None, "https://a/3", ["y"]), (4, "", "https://a/3", ["x"]), (5, "i5", "https://skip/5", ["x"]), (6, "i6", "https://a/6", None), (7, None, None, None)]
    items = spark.createDataFrame(rows, "n int, id string, url string, tags array<string>")
    seen = spark.createDataFrame([("i6",)], "key string")
    run = lambda **k: intake.pull(items, seen, id_col="id", url_col="url", order=["n"], **k)
    assert sorted(r.n for r in run(skip=["skip"])[0].collect()) == [1, 3, 7]
    assert [r.n for r in run(tags=["x", "z"])[0].orderBy("n").collect()] == [1, 5] and run(tags=["x", "z"], mode="all")[0].count() == 0
    capped, moves = run(most=2)
    assert [r.n for r in capped.collect()] == [1, 3] and not moves and run(most=9)[1]


def test_captured_and_inbox(spark, tmp_path):
    m = spark.createDataFrame([(1, "see https://a/x. and https://b/y"), (2, "https://a/x again"), (3, "a note of some length"), (4, "Liked something long"), (5, "short"), (6, None)], "id int, text string")
    links, notes = intake.captured(m, spark.createDataFrame([("https://b/y",)], "url string"))
    assert [tuple(r) for r in links.collect()] == [("https://a/x", 1)] and [r.id for r in notes.collect()] == [3]
    for name, data in (("a.txt", b"x"), ("b.txt", b"x"), ("c.txt", b""), ("d.txt", b"y")):
        (tmp_path / name).write_bytes(data)
    got = intake.inbox(spark, str(tmp_path), spark.createDataFrame([], "sha string")).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["a.txt", "d.txt"]
    assert intake.inbox(spark, str(tmp_path), spark.createDataFrame([(r.sha,) for r in got], "sha string")).count() == 0


def test_activity_and_merges(spark):
    ch = spark.createDataFrame([("u", "a", "A"), ("u", "a", "M"), ("u", "b", "M"), ("v", "a", "M")], "author string, path string, status string")
    assert {r.author: (r.added, r.updated) for r in intake.author_activity(ch).collect()} == {"u": (1, 1), "v": (0, 1)}
    assert [tuple(r) for r in intake.touches(ch, "author", "path").collect()] == [("u", 2), ("v", 1)]
    assert [r.path for r in intake.in_all(ch, "path", "author", ch).collect()] == ["a"]
    e = spark.createDataFrame([(0, 0, " A ", ["x", "y"]), (1, 0, "A", ["y ", "z"]), (1, 1, "B", None), (1, 2, " ", ["q"])], "run int, pos int, label string, claims array<string>")
    assert [(r.label, r.claims) for r in intake.merge_runs(e).orderBy("first").collect()] == [("A", ["x", "y", "z"]), ("B", [])]
    facts = intake.number_facts(spark.createDataFrame([(0, ["a", "b"]), (1, ["c"]), (2, [])], "chapter int, facts array<string>"))
    assert sorted(r.id for r in facts.collect()) == ["c00-f1", "c00-f2", "c01-f1"]
