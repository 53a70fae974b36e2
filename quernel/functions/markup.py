"""Small analyses of Markdown and generated text, as Column expressions (one Arrow batch function where brackets must balance)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from quernel.functions.text import masked_words, word_count


def conflict_line(c: Column) -> Column:
    """The number, from 1, of the first line that opens or closes a merge conflict; null if there is none."""
    lines = F.transform(F.split(c, "\\n"), lambda x, i: F.struct(i.alias("i"), (x.startswith("<<<<<<< ") | x.startswith(">>>>>>> ")).alias("m")))
    return F.get(F.filter(lines, lambda x: x["m"]), F.lit(0))["i"] + 1


def cut_outside_links(c: Column, most: int) -> Column:
    """At most so many characters, but never within a [[link]]: then up to before it."""
    head = F.substring(c, 1, most)
    opened = F.length(head) - F.length(F.regexp_replace(head, "(?s)^(.*)\\[\\[(?:(?!\\]\\]).)*$", "$1"))
    return F.when(F.length(c) <= most, c).otherwise(F.rtrim(F.substr(head, F.lit(1), F.length(head) - opened)))


def strip_citations(c: Column, valid: Column) -> Column:
    """Text without the citations ([c01-f2]) whose ids aren't in the array valid."""
    cited = F.array_distinct(F.regexp_extract_all(c, F.lit("\\[(c\\d+-f\\d+)\\]"), F.lit(1)))
    return F.aggregate(F.array_except(cited, valid), c, lambda s, x: F.replace(s, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))


def weak_context(text: Column, body: Column, least: int = 25) -> Column:
    """Why a paragraph of context is of no use: short, unfinished, or an echo of the body; null if it is good."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(word_count(t) < least, "short").when(~t.rlike("[.!?]"), "unfinished").when(body.contains(t), "echo")


def plain_paragraph(c: Column) -> Column:
    """One paragraph: fences and opening phrases dropped, soft wraps joined."""
    s = F.regexp_replace(c, "(?m)^```\\w*[ \\t]*$", "")
    s = F.regexp_replace(F.trim(s), "(?i)^(?:here is|here's|sure)[^:\\n]{0,80}:\\s*", "")
    return F.trim(F.regexp_replace(s, "\\s+", " "))


def looks_like_person(c: Column) -> Column:
    """Two to four words with capitals, no two of them all capitals, none in camel case."""
    w = F.split(F.trim(c), "\\s+")
    shaped = F.forall(w, lambda x: x.rlike("^\\p{Lu}[\\p{L}.'’-]*$") & ~x.rlike("\\p{Ll}\\p{Lu}"))
    shouted = F.size(F.filter(w, lambda x: x.rlike("^\\p{Lu}{2,}$")))
    return F.coalesce(F.size(w).between(2, 4) & shaped & (shouted <= 2), F.lit(False))


def hold_or_mask(c: Column, hold: Sequence[str], mask: Sequence[str], allow: str = "allow-stop-word") -> tuple[Column, Column]:
    """(held, text): whether a line without the allow marker holds a word to hold, and the text with the words to mask redacted in such lines."""
    lines = F.split(c, "\\n")
    free = F.filter(lines, lambda x: ~x.contains(allow))
    words = "(?i)(?<![a-z0-9_])(?:" + "|".join("\\Q" + w + "\\E" for w in hold) + ")(?![a-z0-9_])"
    held = F.exists(free, lambda x: x.rlike(words)) if hold else F.lit(False)
    shown = F.array_join(F.transform(lines, lambda x: F.when(x.contains(allow), x).otherwise(masked_words(x, list(mask)))), "\n")
    return F.coalesce(held, F.lit(False)), F.when(held, c).otherwise(shown)


def head_and_tail(c: Column, most: int, keep: int) -> Column:
    """A text of more than ``most`` characters as its first and last ``keep``, with a mark between."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, keep), F.lit("\n[...]\n"), F.substr(c, F.length(c) - keep + 1)))


def _object(text: str | None) -> str | None:
    start = (text or "").find("{")
    if start < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)):
        ch = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{}":
            depth += 1 if ch == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first {...} of a text whose brackets balance, strings and escapes heeded; null if none does."""
    return texts.map(_object, na_action="ignore")


def bytes_shown(c: Column) -> Column:
    """A number of bytes for people: B, KB, MB or GB with one digit."""
    shown = lambda k, u: F.concat(F.format_number(c / float(1 << k), 1), F.lit(u))
    return F.when(c < 1 << 10, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1 << 20, shown(10, " KB")).when(c < 1 << 30, shown(20, " MB")).otherwise(shown(30, " GB"))
