"""Charts as HTML pages with inline SVG, drawn from aggregates: Spark counts, the driver draws a row a mark."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks that a chart may have.
MOST = 20_000
SHADES = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377", "#bbbbbb")


def binned(rows: DataFrame, x: Column, y: Column, color: Column, width: float, box: tuple | None = None) -> DataFrame:
    """(x, y, color, n): points counted by bins of a width; box (x_min, x_max, y_min, y_max), None for no bound, is inclusive."""
    a, b, c, d = box or (None,) * 4
    for cond in (x >= a if a is not None else None, x <= b if b is not None else None, y >= c if c is not None else None, y <= d if d is not None else None):
        rows = rows if cond is None else rows.where(cond)
    at = lambda v: F.floor(v / F.lit(float(width))).cast("long")
    return rows.select(at(x).alias("x"), at(y).alias("y"), color.alias("color")).groupBy("x", "y", "color").agg(F.count("*").alias("n"))


def _collected(df: DataFrame) -> list:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} marks: take wider bins")
    return rows


def _page(title: str, body: str, font_size: int, wide: int) -> str:
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>body{{font:{font_size}px sans-serif}}svg{{width:{wide}%}}</style></head><body><h1>{escape(title)}</h1><svg viewBox="0 0 640 480">{body}</svg></body></html>'


def scatter(bins: DataFrame, title: str, width: float, font_size: int = 12, wide: int = 95) -> str:
    """A page with a circle a bin, its area by its count; wide is the percentage of the page's width."""
    rows = sorted(map(tuple, _collected(bins.select("x", "y", "color", "n"))), key=str)
    if not rows:
        return _page(title, "", font_size, wide)
    xs, ys = [r[0] for r in rows], [r[1] for r in rows]
    scale = lambda v, vs, size: 20 + (size - 40) * (v - min(vs) + 0.5) / (max(vs) - min(vs) + 1)
    shades = {c: SHADES[i % len(SHADES)] for i, c in enumerate(sorted({r[2] for r in rows}, key=str))}
    top = max(r[3] for r in rows)
    marks = "".join(f'<circle cx="{scale(x, xs, 640):.1f}" cy="{480 - scale(y, ys, 480):.1f}" r="{1 + 9 * (n / top) ** 0.5:.1f}" fill="{shades[c]}" fill-opacity="0.6"><title>{escape(str(c))}: {n} at {x * width:.4g}, {y * width:.4g}</title></circle>' for x, y, c, n in rows)
    return _page(title, marks, font_size, wide)


def sankey(pairs: DataFrame, left: str, right: str, title: str, font_size: int = 12, wide: int = 95) -> str:
    """A page with a band for each pair of labels (left, right, n), as wide as its count."""
    rows = sorted(((str(r[0]), str(r[1]), r[2]) for r in _collected(pairs.select(left, right, "n"))))
    total, at, marks = sum(r[2] for r in rows) or 1, {}, ""
    for side in (0, 1):
        y = 0.0
        for name in sorted({r[side] for r in rows}):
            at[side, name] = y
            y += 480 * sum(r[2] for r in rows if r[side] == name) / total
    for a, b, n in rows:
        w = 480 * n / total
        y, z = at[0, a] + w / 2, at[1, b] + w / 2
        at[0, a], at[1, b] = at[0, a] + w, at[1, b] + w
        marks += f'<path d="M0 {y:.1f} C320 {y:.1f} 320 {z:.1f} 640 {z:.1f}" stroke="{SHADES[hash_of(a) % len(SHADES)]}" stroke-opacity="0.5" fill="none" stroke-width="{max(w, 0.5):.1f}"><title>{escape(a)} to {escape(b)}: {n}</title></path>'
    return _page(title, marks, font_size, wide)


def hash_of(name: str) -> int:
    return sum(name.encode())


def save(spark: SparkSession, page: str, path: str) -> None:
    from ..sources.files import write_bytes

    write_bytes(spark, path, page.encode())
