import io
import json
import os
import zipfile

import pytest

from quernel.sources import convert as C, pulled, rollouts


def packed(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = packed(**{"word__document_dot_xml": f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""})
EPUB = packed(**{
    "META-INF__container_dot_xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
    "o__p_dot_opf": '<package><manifest><item id="b" href="two%20b.xhtml"/><item id="a" href="a.xhtml#x"/><item id="c" href="gone.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="c"/></spine></package>',
    "o__two b_dot_xhtml": "<html><body><h1>B</h1><p>first</p></body></html>", "o__a_dot_xhtml": "<html><body><h2>A</h2></body></html>",
})


@pytest.mark.parametrize(
    ("name", "data", "markdown"),
    [
        ("a.md", "x é".encode(), "x é"),
        ("a.HTML", b"<h1>Top &amp; all</h1><p>A <b>bold</b> <a href='u'>link</a>.</p><ul><li>one<ul><li>in</li></ul></li><li>two</li></ul><script>no()</script>", "# Top & all\n\nA **bold** [link](u).\n\n- one\n  - in\n- two"),
        ("a.html", b"<pre>a\n  b</pre><ol><li>x<li>y</ol><table><tr><td>1</td><td>2</td></tr></table>", "```\na\n  b\n```\n\n1. x\n2. y\n\n| 1 | 2 |"),
        ("d.docx", DOCX, "# Top\n\nSome text\n\n- item\n\n| a | b |"),
        ("b.epub", EPUB, "# B\n\nfirst\n\n## A"),
    ],
)
def test_convert(name, data, markdown):
    assert C.convert(name, data) == (markdown, None)


@pytest.mark.parametrize(("name", "data"), [("a.docx", b"no zip"), ("a.epub", packed(x="y")), ("a.pdf", b"%PDF"), ("none", b"x"), ("a.docx", packed(**{"word__document_dot_xml": "<!DOCTYPE a [<!ENTITY b 'c'>]><a/>"})), ("a.docx", packed(**{"word__document_dot_xml": "<a"}))])
def test_convert_says_why_not(name, data):
    markdown, error = C.convert(name, data)
    assert markdown is None and error


def test_converted_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("t")
    (tmp_path / "b.docx").write_bytes(DOCX)
    (tmp_path / "c.bin").write_bytes(b"\x00")
    got = {os.path.basename(r.path): (r.markdown, r.error) for r in C.read_converted(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("t", None) and got["b.docx"][0].startswith("# Top") and got["c.bin"][1]


def meta(cwd, **extra):
    return json.dumps({"timestamp": "t", "type": "session_meta", "payload": {"id": cwd, "cwd": cwd, "git": {"branch": "main"}} | extra})


def test_rollouts(spark, tmp_path):
    for k, (name, first) in enumerate([("2026/01/01/a.jsonl", meta("/w/x")), ("2026/01/02/b.jsonl", meta("/w/x")), ("2026/01/02/c.jsonl", meta("/w/y")), ("d.jsonl", '{"type":"other"}'), ("e.jsonl", "{broken"), ("f.jsonl", meta("")), ("g.jsonl", "")]):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(first + '\n{"type":"response_item"}\n')
        os.utime(f, (1_700_000_000 + 86_400 * k,) * 2)
    every = rollouts.read_rollouts(spark, str(tmp_path))
    assert sorted(r.meta.cwd for r in every.collect()) == ["", "/w/x", "/w/x", "/w/y"]
    newest = rollouts.newest_of_each(every).collect()
    assert sorted(os.path.basename(r.path) for r in newest) == ["b.jsonl", "c.jsonl"]
    late = rollouts.read_rollouts(spark, str(tmp_path), since="2023-11-16T00:00:00").collect()
    assert sorted(os.path.basename(r.path) for r in late) == ["c.jsonl", "f.jsonl"]


def test_pulled_batch_and_stream(spark, tmp_path):
    pulled.register(spark)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    item = lambda k: {"id": str(k), "url": f"https://a.example/{k}", "title": None, "tags": ["t"], "added": None, "public": True}
    (folder / "1.json").write_text(json.dumps([item(1), item(2)]))
    (folder / "2.json").write_text(json.dumps([item(3)]))
    rows = spark.read.format("pulled").option("service", "folder").option("path", str(folder)).option("pageSize", "1").load()
    assert sorted(r.id for r in rows.collect()) == ["1", "2", "3"]
    assert [r.id for r in spark.read.format("pulled").option("path", str(folder)).option("cursor", "1.json").load().collect()] == ["3"]

    def run():
        stream = spark.readStream.format("pulled").option("path", str(folder)).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start(out)
        q.processAllAvailable()
        q.stop()
        return sorted(r.id for r in spark.read.schema(pulled.SCHEMA).parquet(out).collect())

    assert run() == ["1", "2", "3"]
    (folder / "3.json").write_text(json.dumps([item(4)]))
    assert run() == ["1", "2", "3", "4"]
