"""Text measures and normal forms as Column expressions, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words left out of token sets.
STOPWORDS = tuple(
    """this that with from have will when then than your they them what which into over more most some such also only very much each about would could
    should their there these those because while""".split()
)
FENCES = "(?s)```.*?(?:```|\\z)"
WIKILINK = "\\[\\[([^\\]\\[|]+)(?:\\|[^\\]]*)?\\]\\]"
URL = "https?://[^\\s<>\"'\\)\\]]+"


def word_count(c: Column) -> Column:
    """Words between white space; 0 for a blank or null text."""
    t = F.trim(F.regexp_replace(c, "\\s+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(F.size(F.split(t, " ")))


def without_code(c: Column) -> Column:
    """Without fenced, double- and single-backtick code."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, FENCES, " "), "``[^`]*``", " "), "`[^`\\n]*`", " ")


def heading_count(c: Column) -> Column:
    """Headings of level 2 and 3 outside fences."""
    return F.coalesce(F.regexp_count(F.concat(F.lit("\n"), F.regexp_replace(c, FENCES, " ")), F.lit("\\n#{2,3}[ \\t]+\\S")), F.lit(0))


def wikilinks(c: Column) -> Column:
    """Targets of [[target]] and [[target|shown]] outside code: trimmed, different ones, in order."""
    found = F.regexp_extract_all(without_code(c), F.lit(WIKILINK), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))


def urls(c: Column) -> Column:
    """Web addresses without closing punctuation, different ones, in order."""
    found = F.regexp_extract_all(c, F.lit(URL), F.lit(0))
    return F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, "[.,;:!?)]+$", "")))


def dedup_normal(c: Column) -> Column:
    """For comparing bodies: lines trimmed, comment and fence lines dropped, white space collapsed, lower case."""
    lines = F.transform(F.split(F.regexp_replace(c, "\\r", ""), "\\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: ~x.startswith("<!--") & ~x.startswith("```"))
    return F.trim(F.lower(F.regexp_replace(F.array_join(kept, " "), "\\s+", " ")))


def token_set(c: Column, least: int = 4) -> Column:
    """Different words of [a-z0-9] of a normal form, at least so long, without stop words."""
    words = F.split(c, "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda x: (F.length(x) >= least) & ~x.isin(*STOPWORDS)))


def anchor_slug(c: Column) -> Column:
    """Anchor of a title: lower case, only a-z, 0-9, blanks and hyphens kept, blanks to hyphens; "section" if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9\\s-]", ""), "\\s+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", "section").otherwise(s)


def density_class(words: Column, heads: Column) -> Column:
    """dense from 2,000 words or 4 headings, brief under 500 words with at most one heading, else standard."""
    return F.when((words >= 2000) | (heads >= 4), "dense").when((words < 500) & (heads <= 1), "brief").otherwise("standard")


def index_tier(words: Column, sections: Column) -> Column:
    """stub to 80 words, brief to 199, standard to 1,999 (deep with 5 sections or more), else deep."""
    return F.when(words <= 80, "stub").when(words <= 199, "brief").when((words <= 1999) & (sections < 5), "standard").otherwise("deep")


def iso_date(c: Column) -> Column:
    """Y/M/D, Y.M.D and Y-M-D, one digit or two, as a date; null if it is none."""
    parts = lambda i: F.regexp_extract(F.trim(c), "^(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})", i)
    return F.try_to_date(F.concat_ws("-", parts(1), F.lpad(parts(2), 2, "0"), F.lpad(parts(3), 2, "0")), "yyyy-MM-dd")


def first_sentence(c: Column, most: int = 120) -> Column:
    """The first line of prose up to its first full stop and blank, or its first characters."""
    lines = F.filter(F.transform(F.split(c, "\\n"), lambda x: F.trim(F.regexp_replace(x, "\\r", ""))), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("---"))
    line = F.get(lines, F.lit(0))
    stop = F.instr(line, ". ")
    return F.when((stop > 1) & (stop <= most), F.substring(line, F.lit(1), stop)).otherwise(F.substring(line, 1, most))


def strip_html(c: Column) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags dropped, the common entities resolved, blanks collapsed."""
    s = F.regexp_replace(c, "(?is)<(script|style|noscript)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    s = F.regexp_replace(s, "(?s)<[^>]+>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(s, "\\s+", " "))


def html_title(c: Column) -> Column:
    """The first title element, trimmed; empty if there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1), "\\s+", " "))


def masked_words(c: Column, words: list[str], by: str = "[redacted]") -> Column:
    """Whole words, whatever their case, replaced."""
    pattern = "(?i)(?<![a-z0-9_])(?:" + "|".join("\\Q" + w + "\\E" for w in words) + ")(?![a-z0-9_])"
    return F.regexp_replace(c, pattern, by) if words else c
