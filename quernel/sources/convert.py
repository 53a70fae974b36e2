"""Files of several formats as Markdown: text as it is, HTML, DOCX and EPUB by what the standard library reads; the rest says why not."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}
SILENT = frozenset(["script", "style", "noscript", "template", "head", "svg", "iframe"])
BLOCKS = frozenset(["p", "div", "section", "article", "header", "footer", "main", "table", "tr", "ul", "ol", "dl", "dt", "dd", "figure", "figcaption", "address", "form", "nav", "aside"])
MOST_XML = 256 << 20  # a member of an archive that unpacks to more is refused


class _Markdown(HTMLParser):
    """Collects Markdown from a page's events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.lists: list[list] = []
        self.links: list[str] = []
        self.pre = 0
        self.cells = 0

    def _break(self, n: int = 2) -> None:
        """At least so many line ends, but none at the beginning."""
        if self.pre:
            return
        tail = "".join(self.out[-4:])
        if any(x.strip() for x in self.out[-8:]):
            self.out.append("\n" * max(0, n - (len(tail) - len(tail.rstrip("\n")))))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        if self.silent:
            return
        if tag in HEADINGS:
            self._break()
            self.out.append(HEADINGS[tag] + " ")
        elif tag in ("ul", "ol"):
            self._break(1 if self.lists else 2)
            self.lists.append([tag, 0])
        elif tag == "li":
            self._break(1)
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "
            self.out.append("  " * max(0, len(self.lists) - 1) + mark)
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self._break()
            self.out.append("---")
            self._break()
        elif tag == "pre":
            self._break()
            self.out.append("```\n")
            self.pre += 1
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "blockquote":
            self._break()
            self.out.append("> ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "img":
            a = dict(attrs)
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "tr":
            self._break(1)
            self.cells = 0
        elif tag in ("td", "th"):
            self.out.append("| " if not self.cells else " | ")
            self.cells += 1
        elif tag in BLOCKS:
            self._break()

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if self.silent:
            return
        if tag in HEADINGS or tag == "blockquote":
            self._break()
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._break(1 if self.lists else 2)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```")
            self._break()
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            href = self.links.pop() if self.links else ""
            self.out.append(f"]({href})" if href else "]")
        elif tag == "tr" and self.cells:
            self.out.append(" |")
        elif tag in BLOCKS:
            self._break()

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.pre:
            self.out.append(data)
        elif text := re.sub(r"\s+", " ", data):
            begins = not self.out or "".join(self.out[-2:]).endswith("\n")
            self.out.append(text.lstrip() if begins else text)

    def text(self) -> str:
        """The page, without blanks at the ends of lines and with no more than one empty line in a row, code left as it is."""
        parts = re.split(r"(```\n.*?\n```)", "".join(self.out), flags=re.S)
        return "".join(p if p.startswith("```") else re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", p)) for p in parts).strip()


def html_to_markdown(html: str) -> str:
    """Markdown of a page: headings, lists, links, emphasis, code, quotations, rows of tables; scripts and styles dropped."""
    reader = _Markdown()
    reader.feed(html)
    reader.close()
    return reader.text()


def _member(archive: zipfile.ZipFile, name: str) -> bytes:
    info = archive.getinfo(name)
    if info.file_size > MOST_XML:
        raise ValueError(f"{name} unpacks to {info.file_size} bytes")
    return archive.read(info)


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in data[:4096]:
        raise ValueError("entities are not read")
    return ElementTree.fromstring(data)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def docx_to_markdown(data: bytes) -> str:
    """Markdown of a word-processor file: paragraphs, headings by style, list items, rows of tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = _xml(_member(archive, "word/document.xml"))

    def said(p: ElementTree.Element) -> str:
        out = []
        for e in p.iter():
            name = _local(e)
            out.append((e.text or "") if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else "")
        return "".join(out).strip()

    def paragraph(p: ElementTree.Element) -> str:
        text, style, listed = said(p), "", False
        for e in p.iter():
            if _local(e) == "pStyle":
                style = next((v for k, v in e.attrib.items() if k.endswith("val")), "")
            listed = listed or _local(e) == "numPr"
        m = re.fullmatch(r"(?i)heading ?([1-6])", style)
        if not text:
            return ""
        return f"{'#' * int(m[1])} {text}" if m else f"# {text}" if style.lower() == "title" else f"- {text}" if listed else text

    body = next((e for e in root.iter() if _local(e) == "body"), root)
    blocks = []
    for e in body:
        if _local(e) == "p":
            blocks.append(paragraph(e))
        elif _local(e) == "tbl":
            rows = [[said(c) for c in r if _local(c) == "tc"] for r in e.iter() if _local(r) == "tr"]
            blocks.append("\n".join("| " + " | ".join(x.replace("\n", " ") for x in r) + " |" for r in rows))
    return "\n\n".join(b for b in blocks if b)


def epub_to_markdown(data: bytes) -> str:
    """Markdown of a book's chapters in the order of its spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        box = _xml(_member(archive, "META-INF/container.xml"))
        package = next(e.attrib["full-path"] for e in box.iter() if _local(e) == "rootfile")
        root = _xml(_member(archive, package))
        items = {e.attrib.get("id"): e.attrib.get("href", "") for e in root.iter() if _local(e) == "item"}
        out = []
        for e in root.iter():
            if _local(e) == "itemref" and (href := items.get(e.attrib.get("idref"))):
                name = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(href.split("#")[0])))
                if name in names:
                    out.append(html_to_markdown(_member(archive, name).decode("utf-8", "replace")))
    return "\n\n".join(x for x in out if x)


def convert(name: str, data: bytes) -> tuple[str | None, str | None]:
    """(Markdown, None) or (None, why not) of a file by its name's ending."""
    ending = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    try:
        if ending in ("md", "markdown", "txt"):
            return data.decode("utf-8", "replace"), None
        if ending in ("html", "htm", "xhtml"):
            return html_to_markdown(data.decode("utf-8", "replace")), None
        if ending == "docx":
            return docx_to_markdown(data), None
        if ending == "epub":
            return epub_to_markdown(data), None
    except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, RuntimeError) as e:
        return None, f"{type(e).__name__}: {e}"
    return None, f"no converter for .{ending}" if ending else "no ending"


@F.pandas_udf(T.StructType([T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType())]))
def converted(name: pd.Series, data: pd.Series) -> pd.DataFrame:
    """convert over columns of names and bytes."""
    return pd.DataFrame([convert(n or "", bytes(d)) if d is not None else (None, "no data") for n, d in zip(name, data, strict=True)], columns=["markdown", "error"])


@F.pandas_udf(T.StringType())
def markdown_of_html(html: pd.Series) -> pd.Series:
    """html_to_markdown over a column."""
    return html.map(html_to_markdown, na_action="ignore")


def read_converted(spark: SparkSession, folder: str) -> DataFrame:
    """path, markdown and error of each file of a folder; a file that can't be read is a row with its error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path", converted("path", "content").alias("x")).select("path", "x.*")
