"""Sampling positions, boxes, similarity and tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def interior_positions(total: Column, n: int = 8) -> Column:
    """n frame positions inside a video of total frames, ends left out; all frames if total <= n."""
    every = F.sequence(F.lit(0).cast("long"), total - 1)
    if n == 1:
        some = F.array(F.floor(total / 2).cast("long"))
    else:
        some = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.greatest(F.lit(0).cast("long"), F.least(total - 1, F.rint(i / F.lit(float(n + 1)) * (total - 1)).cast("long"))))
    return F.when(total <= 0, F.array().cast("array<bigint>")).when(total <= n, every).otherwise(F.array_distinct(some))


def endpoint_positions(total: Column, n: int = 12) -> Column:
    """n frame positions from the first to the last frame, distinct and sorted."""
    some = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (total - 1) / F.lit(float(n - 1))).cast("long"))
    return F.when(total <= 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(some)))


def bbox(polygon: Column) -> Column:
    """[xmin, ymin, xmax, ymax] of a polygon with three points or more, else null."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    good = (F.size(polygon) >= 3) & F.forall(polygon, lambda p: (F.size(p) == 2) & finite(F.get(p, F.lit(0))) & finite(F.get(p, F.lit(1))))
    return F.when(good, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def box_of(*points: tuple[Column, Column]) -> Column:
    """[xmin, ymin, xmax, ymax] of a fixed number of points in columns; one pass without lambdas."""
    xs, ys = zip(*points)
    return F.struct(F.least(*xs).alias("xmin"), F.least(*ys).alias("ymin"), F.greatest(*xs).alias("xmax"), F.greatest(*ys).alias("ymax"))


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(TOLERANCE) * F.greatest(F.abs(a), F.abs(b)), F.lit(TOLERANCE))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12))
    return dot(a, b) / (norm(a) * norm(b))


def effective_limit(configured: Column, *others: Column) -> Column:
    """The least of a configured limit, which always counts, and of the others that lie between 0 and a million."""
    return F.least(configured, *[F.when((x > 0) & (x < 1_000_000), x) for x in others]) if others else configured
