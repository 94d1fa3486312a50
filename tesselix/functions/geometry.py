"""Boxes and points as column expressions; everything stays in generated code.

A box is a pair of lists of columns (low, high), one a dimension; a point is a list of columns. Products are written as
products, never as powers, so that results agree with other engines bit by bit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

Point = list[Column]
Box = tuple[list[Column], list[Column]]


def box(prefix: str = "", dims: tuple[str, ...] = ("x", "y")) -> Box:
    return [F.col(f"{prefix}{d}_min") for d in dims], [F.col(f"{prefix}{d}_max") for d in dims]


def point_box(point: Point) -> Box:
    return point, point


def literal_box(low, high) -> Box:
    return [F.lit(float(v)) for v in low], [F.lit(float(v)) for v in high]


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def area(b: Box) -> Column:
    return reduce(lambda p, q: p * q, (h - lo for lo, h in zip(*b, strict=True)))


def margin(b: Box) -> Column:
    return _sum(F.lit(2.0) * (h - lo) for lo, h in zip(*b, strict=True))


def union(a: Box, b: Box) -> Box:
    return [F.least(p, q) for p, q in zip(a[0], b[0], strict=True)], [F.greatest(p, q) for p, q in zip(a[1], b[1], strict=True)]


def enlargement(a: Box, b: Box) -> Column:
    return area(union(a, b)) - area(a)


def overlaps(a: Box, b: Box) -> Column:
    """Closed boxes: touching edges count."""
    return reduce(lambda p, q: p & q, ((ah >= bl) & (bh >= al) for al, ah, bl, bh in zip(*a, *b, strict=True)))


def contained(a: Box, b: Box) -> Column:
    """a in b, edges included."""
    return reduce(lambda p, q: p & q, ((al >= bl) & (ah <= bh) for al, ah, bl, bh in zip(*a, *b, strict=True)))


def min_dist2(b: Box, point: Point) -> Column:
    gaps = [F.greatest(lo - q, F.lit(0.0), q - h) for lo, h, q in zip(*b, point, strict=True)]
    return _sum(g * g for g in gaps)


def min_dist(b: Box, point: Point) -> Column:
    return F.sqrt(min_dist2(b, point))


def max_dist2(b: Box, point: Point) -> Column:
    """To the farthest corner."""
    gaps = [F.greatest(F.abs(lo - q), F.abs(h - q)) for lo, h, q in zip(*b, point, strict=True)]
    return _sum(g * g for g in gaps)


def dist2(a: Point, b: Point) -> Column:
    return _sum((p - q) * (p - q) for p, q in zip(a, b, strict=True))


def dist(a: Point, b: Point) -> Column:
    return F.sqrt(dist2(a, b))


def array_dist(a: Column, b: Column) -> Column:
    """L2 distance of two arrays of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def dominates(a: Point, b: Point) -> Column:
    """a is at most b in every dimension and less in one."""
    at_most = reduce(lambda p, q: p & q, (p <= q for p, q in zip(a, b, strict=True)))
    less = reduce(lambda p, q: p | q, (p < q for p, q in zip(a, b, strict=True)))
    return at_most & less


def centre(b: Box) -> list[Column]:
    return [(lo + h) / F.lit(2.0) for lo, h in zip(*b, strict=True)]
