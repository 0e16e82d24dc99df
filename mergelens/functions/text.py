"""Scalar expressions over text, numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergelens.schemas import SEVERITIES


def estimate_tokens(s: Column) -> Column:
    """Bytes of the text over four, rounded up."""
    return F.floor((F.octet_length(s) + 3) / 4).cast("long")


def split_budget(budget: int) -> tuple[int, int]:
    """Tokens for the context and for the answer: three quarters and the rest, which is 128 at least; 12,000 in all where
    none are given."""
    budget = budget if budget > 0 else 12_000
    context = budget * 3 // 4
    return context, max(128, budget - context)


def nullable_line(line: Column) -> Column:
    return F.when(line > 0, line)


def severity_weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, weight in SEVERITIES.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out


def normal_severity(severity: Column) -> Column:
    """Lower-cased and trimmed; ``warning`` where it is none of the four."""
    s = F.lower(F.trim(F.coalesce(severity, F.lit(""))))
    return F.when(s.isin(*SEVERITIES), s).otherwise("warning")


def quoted(s: Column) -> Column:
    """Double-quoted, with backslashes, quotes and control characters escaped."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), s, F.lit('"'))


def whole_seconds(ts: Column) -> Column:
    return F.date_trunc("SECOND", ts)


def rfc3339(ts: Column) -> Column:
    """A time as text to the second, for a session in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def lines_of(text: Column) -> Column:
    """Lines of a text; one line feed at its end doesn't begin another."""
    whole = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.split(whole, "\n", -1)
