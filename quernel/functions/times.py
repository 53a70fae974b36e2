"""Instants written in several ways, as Column expressions that don't depend on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
INSTANT = "^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}(?:[.,]\\d{1,9})?(?:Z|[+-]\\d{2}:?\\d{2})?$"


def tidy(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.trim(c, F.lit(BLANKS))


def instant_micros(c: Column) -> Column:
    """Microseconds since 1970 in UTC; null if missing, unreadable or no real date or time.

    Seconds may be missing. A time without an offset is UTC. Digits beyond microseconds are cut off. An offset is ``Z``, ``+09:00`` or ``+0900``,
    up to 18 hours.
    """
    s = tidy(c)
    s = F.when(F.substring(s, 17, 1) == ":", s).otherwise(F.concat(F.substring(s, 1, 16), F.lit(":00"), F.substr(s, F.lit(17))))
    offset = (F.substring(s, -1, 1) == "Z") | F.substring(s, -6, 1).isin("+", "-") | F.substring(s, -5, 1).isin("+", "-")
    zoned = F.concat(F.translate(s, ",", "."), F.when(offset & (F.length(s) > 16), "").otherwise("Z"))
    return F.unix_micros(F.when(s.rlike(INSTANT), zoned).try_cast("timestamp"))


def utc_day(micros: Column) -> Column:
    """The UTC date of an instant."""
    return F.date_from_unix_date(((micros - F.pmod(micros, F.lit(86_400_000_000))) / 86_400_000_000).cast("int"))
