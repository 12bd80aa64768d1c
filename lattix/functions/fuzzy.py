"""Approximate search of a subsequence, in Arrow batches: no built-in counts edits within a window."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import functions as F

HIT = "start int, stop int, matched string, num_errors int"


def _spans(text: str, query: str, e: int) -> list[tuple[int, int]]:
    """Where matches with at most e errors may be: one of e + 1 pieces of the query is whole in each, so each place of a piece gives a span, as wide as e errors allow; spans that meet are one. Finding pieces is far faster than counting edits everywhere."""
    n, found = len(query), []
    if e >= n:
        return [(0, len(text))]
    for i in range(e + 1):
        a, b = n * i // (e + 1), n * (i + 1) // (e + 1)
        at = text.find(query[a:b])
        while at >= 0:
            found.append((max(0, at - a - e), min(len(text), at + n - a + e)))
            at = text.find(query[a:b], at + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def first_match(text: str | None, query: str, error_rate: float = 0.1, start: int | None = None, stop: int | None = None) -> tuple:
    """The leftmost match with the fewest errors allowed: exact, else with 1, 2, ... errors up to the rate; bounds may be negative."""
    if text is None:
        return -1, -1, None, -1
    n = len(text)
    lo = 0 if start is None else max(0, start + n if start < 0 else start)
    hi = n if stop is None else min(n, stop + n if stop < 0 else stop)
    at = text.find(query, lo, max(lo, hi))
    if at >= 0:
        return at, at + len(query), query, 0
    for e in range(1, int(len(query) * error_rate) + 1):
        part = text[lo:hi]
        for a, b in _spans(part, query, e):
            m = regex.search(f"(?:{regex.escape(query)}){{e<={e}}}", part, pos=a, endpos=b)
            if m:
                return lo + m.start(), lo + m.end(), m[0], sum(m.fuzzy_counts)
    return -1, -1, None, -1


def all_matches(text: str | None, query: str, error_rate: float = 0.1, least: int = 0) -> list[tuple]:
    """Matches that don't overlap: those with the fewest errors first, then more in what lies between."""
    text = text or ""
    out, open_ = [], [(0, len(text))]
    for e in range(least, int(len(query) * error_rate) + 1):
        rest = []
        for lo, hi in open_:
            at = lo
            pattern = regex.escape(query) if not e else f"(?:{regex.escape(query)}){{e<={e}}}"
            part = text[lo:hi]
            for m in (m for a, b in _spans(part, query, e) for m in regex.finditer(pattern, part, pos=a, endpos=b)):
                if m.end() > m.start():
                    out.append((lo + m.start(), lo + m.end(), m[0], sum(m.fuzzy_counts) if e else 0))
                    rest.append((at, lo + m.start()))
                    at = lo + m.end()
            rest.append((at, hi))
        open_ = [(a, b) for a, b in rest if b > a]
    return sorted(out)


def search(query: str, error_rate: float = 0.1, start: int | None = None, stop: int | None = None):
    @F.pandas_udf(HIT)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_match(t, query, error_rate, start, stop) for t in x], columns=["start", "stop", "matched", "num_errors"])

    return run


def search_all(query: str, error_rate: float = 0.1):
    @F.pandas_udf(f"array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>")
    def run(x: pd.Series) -> pd.Series:
        names = ("start", "stop", "matched", "num_errors")
        return pd.Series([[dict(zip(names, m)) for m in all_matches(t, query, error_rate)] for t in x])

    return run
