"""Geometry of boxes [x0, y0, x1, y1] (origin top left) as Column expressions, in doubles throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 0.07


def box(x0, y0, x1, y1) -> Column:
    return F.array(*[c.cast("double") for c in (x0, y0, x1, y1)])


def x0(b: Column) -> Column:
    return b[0]


def y0(b: Column) -> Column:
    return b[1]


def x1(b: Column) -> Column:
    return b[2]


def y1(b: Column) -> Column:
    return b[3]


def width(b: Column) -> Column:
    return b[2] - b[0]


def height(b: Column) -> Column:
    return b[3] - b[1]


def x_center(b: Column) -> Column:
    return (b[0] + b[2]) / 2


def y_center(b: Column) -> Column:
    return (b[1] + b[3]) / 2


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def rounded(b: Column, digits: int = 2) -> Column:
    """Each coordinate rounded half to even."""
    return F.transform(b, lambda v: F.bround(v, digits))


def area(b: Column) -> Column:
    return clamped(width(b)) * clamped(height(b))


def union(a: Column, b: Column) -> Column:
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def union_all(boxes: Column) -> Column:
    """Union of an array of boxes; zeros for none."""
    edge = lambda k, f: f(F.transform(boxes, lambda b: b[k]))
    return F.when(F.size(boxes) == 0, F.array(*[F.lit(0.0)] * 4)).otherwise(F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max)))


def _shared(a: Column, b: Column, lo: int, hi: int) -> Column:
    return clamped(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))


def intersection_ratio(a: Column, b: Column) -> Column:
    """Shared area over the smaller area, which counts as 1 at least."""
    return _shared(a, b, 0, 2) * _shared(a, b, 1, 3) / F.greatest(F.lit(1.0), F.least(area(a), area(b)))


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width over the smaller width, which counts as 1 at least."""
    return _shared(a, b, 0, 2) / F.greatest(F.lit(1.0), F.least(width(a), width(b)))


def vertical_overlap(a: Column, b: Column) -> Column:
    return _shared(a, b, 1, 3) / F.greatest(F.lit(1.0), F.least(height(a), height(b)))


def strict_horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width over the smaller width; 0 where a box has none."""
    return F.when((width(a) <= 0) | (width(b) <= 0), 0.0).otherwise(_shared(a, b, 0, 2) / F.least(width(a), width(b)))


def strict_vertical_overlap(a: Column, b: Column) -> Column:
    return F.when((height(a) <= 0) | (height(b) <= 0), 0.0).otherwise(_shared(a, b, 1, 3) / F.least(height(a), height(b)))


def strict_area_overlap(a: Column, b: Column) -> Column:
    """Shared area over the smaller area; 0 where a box has none."""
    least = F.least(area(a), area(b))
    return F.when(least <= 0, 0.0).otherwise(_shared(a, b, 0, 2) * _shared(a, b, 1, 3) / least)


def center_inside(a: Column, b: Column) -> Column:
    """Whether the centre of a is in b."""
    return x_center(a).between(b[0], b[2]) & y_center(a).between(b[1], b[3])


def within(b: Column, region: Column, margin: float) -> Column:
    return (b[0] >= region[0] - margin) & (b[1] >= region[1] - margin) & (b[2] <= region[2] + margin) & (b[3] <= region[3] + margin)


def compact_choice(kept: Column, other: Column) -> Column:
    """The box that is at least 15 % less tall, else the first."""
    return F.when(height(other) < height(kept) * 0.85, other).otherwise(kept)


def close(a: Column, b: Column) -> Column:
    """Whether two boxes touch or overlap sideways.  One of the two gaps is always 0, so it always holds."""
    return (horizontal_overlap(a, b) >= 0.05) | (clamped(b[0] - a[2]) <= 4.0) | (clamped(a[0] - b[2]) <= 4.0)


def any_path(drawings: Column, b: Column, least: float = 0.2) -> Column:
    """Whether a drawing (array of boxes) covers ``least`` of the box."""
    return F.exists(drawings, lambda d: intersection_ratio(d, b) >= least)


def column_signature(n: Column) -> Column:
    """Evenly spaced centres of n columns, 3 digits."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround((i + F.lit(0.5)) / n, 3))).otherwise(F.array().cast("array<double>"))


def column_similarity(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Share of the first signature's centres near any of the second's, over the longer length."""
    near = F.filter(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= tolerance))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0) | a.isNull() | b.isNull(), 0.0).otherwise(F.size(near) / F.greatest(F.size(a), F.size(b)))


def column_hash(signature: Column) -> Column:
    text = F.array_join(F.transform(signature, lambda v: F.format_string("%.3f", F.bround(v, 3))), ",")
    return F.substring(F.sha1(text), 1, 16)


def header_similarity(a: Column, b: Column) -> Column:
    """Shared distinct lower-case texts over the larger number of them."""
    texts = lambda h: F.array_distinct(F.filter(F.transform(h, lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    ta, tb = texts(F.coalesce(a, F.array().cast("array<string>"))), texts(F.coalesce(b, F.array().cast("array<string>")))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(ta), F.size(tb)))


def row_height(b: Column, rows: Column) -> Column:
    return F.when(rows > 0, clamped(height(b)) / rows).otherwise(0.0)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def is_horizontal_line(w: Column, h: Column) -> Column:
    return (w > h * 3) & (h < 5)


def is_vertical_line(w: Column, h: Column) -> Column:
    return (h > w * 3) & (w < 5)


def is_rectangle(w: Column, h: Column) -> Column:
    return ~is_horizontal_line(w, h) & ~is_vertical_line(w, h) & (w > 5) & (h > 5)


def drawing_kind(items: Column, w: Column, h: Column) -> Column:
    """Kind of a drawing by its first known item (l line, c curve, re rectangle), else by its size."""
    known = F.filter(items, lambda i: i.isin("l", "c", "re"))
    first = F.get(known, F.lit(0))
    return F.when(first == "l", "line").when(first == "c", "curve").when(first == "re", "rectangle").when((w < 5) | (h < 5), "line").otherwise("unknown")


def filled(cells: Column) -> Column:
    """Positions (from 0) of the cells that hold text."""
    return F.filter(F.transform(cells, lambda c, i: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", i)), lambda i: i.isNotNull())


def filled_count(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))


def nearest(centers: Column, x: Column, tolerance: float = 50.0) -> Column:
    """Position of the nearest centre, the first on ties; null beyond the tolerance."""
    best = F.array_min(F.transform(centers, lambda c, i: F.struct(F.abs(x - c).alias("d"), i.alias("i"))))
    return F.when(best["d"] <= tolerance, best["i"])
