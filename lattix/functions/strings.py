"""String functions as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are replaced, and by what.
WORDS = {"%": "_Percent_", "+": "_Plus_", "-": "_Minus_", "&": "_and_", "=": "_Equal_"}
NOT_IN_NAMES = ' ?()/,:.[]#\n"\\|*'
NOT_IN_PATHS = "\n:\"/\\|?* ;"
NOT_IN_WINDOW_PATHS = "\n:\"/\\|?*"
RESERVED = '<>:/\\|?*"'


def _translated(x: Column, chars: str) -> Column:
    return F.translate(x, chars, "_" * len(chars))


def python_safe(x: Column, words: dict[str, str] = WORDS) -> Column:
    for a, b in words.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return _translated(x, NOT_IN_NAMES)


def path_safe(x: Column) -> Column:
    return _translated(x, NOT_IN_PATHS)


def window_path_safe(x: Column) -> Column:
    return _translated(x, NOT_IN_WINDOW_PATHS)


def escaped_path(x: Column, reserved: str = RESERVED, most_bytes: int = 255, strict: bool = True) -> Column:
    """Reserved characters as ((code)); an error (or, unless strict, null) where the name takes more than most_bytes."""
    for c in reserved:
        x = F.replace(x, F.lit(c), F.lit(f"(({ord(c)}))"))
    long = F.raise_error(F.lit(f"a name of more than {most_bytes} bytes")) if strict else F.lit(None).cast("string")
    return F.when(F.octet_length(x) > most_bytes, long).otherwise(x)


def insert_every(x: Column, n: int = 20, sep: str = "\n") -> Column:
    return F.regexp_replace(x, f"(?s)(.{{{n}}})(?!$)", "$1" + re.sub(r"([\\$])", r"\\\1", sep))


def replace_at(x: Column, i: int, by: str) -> Column:
    return F.overlay(x, F.lit(by), F.lit(i + 1), F.lit(1))


def replace_every(x: Column, n: int = 11, by: str = "") -> Column:
    """Every n-th character replaced; a full last piece loses its last one without a replacement."""
    pieces = F.ceil(F.length(x) / F.lit(n)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(x, i * n + 1, F.lit(n - 1)))
    return F.when(F.length(x) == 0, x).otherwise(F.array_join(cut, by))


def all_positions(x: Column, sub: str, overlapping: bool = True) -> Column:
    """0-based positions of a substring, as an array."""
    n = len(sub)
    last = F.length(x) - n
    every = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(x, i + 1, F.lit(n)) == sub)).otherwise(F.array().cast("array<int>"))
    if overlapping:
        return every
    keep = F.aggregate(every, F.struct(F.array().cast("array<int>").alias("kept"), F.lit(-n).alias("last")), lambda a, i: F.when(i >= a.last + n, F.struct(F.array_append(a.kept, i).alias("kept"), i.alias("last"))).otherwise(a))
    return keep.kept


def last_position(x: Column, sub: str) -> Column:
    """The 0-based position of the last occurrence, or -1."""
    found = F.instr(F.reverse(x), sub[::-1])
    return F.when(found > 0, F.length(x) - found - len(sub) + 1).otherwise(F.lit(-1))


def stretches(x: Column, char: str, least: int = 1) -> Column:
    """Runs of a character, as an array of (start, stop, n)."""
    chars = F.split(x, "")
    fresh = F.struct(F.array().cast("array<struct<start:int,stop:int,n:int>>").alias("runs"), F.lit(0).alias("at"), F.lit(0).alias("n"))
    closed = lambda a: F.when(a.n >= least, F.array_append(a.runs, F.struct((a.at - a.n).alias("start"), a.at.alias("stop"), a.n.alias("n")))).otherwise(a.runs)
    step = lambda a, c: F.when(c == char, F.struct(a.runs.alias("runs"), (a.at + 1).alias("at"), (a.n + 1).alias("n"))).otherwise(F.struct(F.when(a.n > 0, closed(a)).otherwise(a.runs).alias("runs"), (a.at + 1).alias("at"), F.lit(0).alias("n")))
    return F.aggregate(F.when(F.length(x) > 0, chars).otherwise(F.array().cast("array<string>")), fresh, step, lambda a: F.when(a.n > 0, closed(a)).otherwise(a.runs))


def fields(x: Column, field: str = "-") -> Column:
    """(start, stop) of the runs of the field character, as in the ruler line of a printed table."""
    return F.transform(stretches(x, field), lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop")))


def with_affixes(x: Column, prefix: str = "", suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), x, F.lit(suffix))


def mapped(x: Column, table: dict, keep: bool = False) -> Column:
    """A value by a small literal table; a miss is null, or the value itself."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    got = F.try_element_at(F.create_map(*pairs), x) if pairs else F.lit(None).cast("string")
    return F.coalesce(got, x) if keep else got


def is_s3_url(x: Column) -> Column:
    return F.coalesce(x.startswith("s3://"), F.lit(False))


def is_http_url(x: Column) -> Column:
    return F.coalesce(x.startswith("http://") | x.startswith("https://"), F.lit(False))


def is_remote_url(x: Column) -> Column:
    return is_s3_url(x) | is_http_url(x)


def new_id() -> Column:
    """A random id of 32 hex digits for each row."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def timestamp(readable: bool = False) -> Column:
    return F.date_format(F.current_timestamp(), "yyyy/MM/dd HH:mm" if readable else "yyyyMMdd_HHmm")
