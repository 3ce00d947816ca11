"""Means of doubles that are right to the last bit at any partitioning."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Doubles are summed by classes of exponents, WIDTH powers of two wide; a value is then a whole number of at most 2**(54 + WIDTH).
WIDTH = 32
LOW, HIGH = -1074 // WIDTH - 1, 1024 // WIDTH + 1


def _parts(x: Column) -> tuple[Column, Column, Column]:
    """(class, high, low): |x| is (high * 2**34 + low) * 2**(WIDTH * class - 54), exactly.

    The class comes from a logarithm that may be off by one at its borders; high
    and low have room for that.
    """
    size = F.abs(x)
    c = F.when(size > 0, F.floor(F.log2(size) / WIDTH)).otherwise(0).cast("int")
    # a power of two so large or small that it takes two steps
    half = F.element_at(F.array(*[F.lit(2.0 ** (-WIDTH * k // 2)) for k in range(LOW, HIGH + 1)]), c - LOW + 1)
    scaled = size * half * half * F.lit(float(1 << 20))
    high = F.floor(scaled)
    low = ((scaled - high) * F.lit(float(1 << 34))).cast("bigint")
    return c, high, low


@F.pandas_udf(DoubleType())
def _rounded(classes: pd.Series, n: pd.Series) -> pd.Series:
    """The quotient of an exact sum and a count, rounded once."""
    out = []
    for parts, count in zip(classes, n):
        if not count:
            out.append(None)
            continue
        total = sum(((int(p["high"]) << 34) + int(p["low"])) * Fraction(2) ** (WIDTH * p["c"] - 54) for p in parts)
        out.append(float(Fraction(total) / count))
    return pd.Series(out, dtype="float64")


def exact_means(df: DataFrame, keys: list[str], value: str, name: str = "mean") -> DataFrame:
    """keys, name, n: the mean of a column of doubles by key, as if it were worked out without rounding and rounded once.

    Each value is split into two whole numbers by the class of its exponent; these are
    summed as decimals, first in place and then by key and class, so the order of the
    rows and a key with any share of them don't matter. A key has a few classes (66 at
    most), whose quotient an Arrow UDF rounds. Nulls don't count (n is the number of
    others; a key with none has a null mean). With a NaN, or infinities of both signs, the mean is NaN; with
    others, that infinity.
    """
    x = F.col(value).cast("double")
    finite = F.abs(x) < float("inf")
    c, high, low = _parts(F.when(finite, x))
    sign = F.when(x < 0, -1).otherwise(1)
    rows = df.select(*keys, x.alias("__x"), finite.alias("__f"), c.alias("__c"), (sign * high).alias("__high"), (sign * low).alias("__low"))
    whole = lambda name: F.sum(F.col(name).cast("decimal(38,0)"))
    by_class = rows.groupBy(*keys, "__c").agg(whole("__high").alias("high"), whole("__low").alias("low"), F.count("__x").alias("n"), F.sum(F.when(~F.col("__f"), F.col("__x"))).alias("odd"))
    one = F.when(F.col("high").isNotNull(), F.struct(F.col("__c").alias("c"), F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low")))
    per = by_class.groupBy(*keys).agg(F.collect_list(one).alias("parts"), F.sum("n").alias("n"), F.sum("odd").alias("odd"))
    mean = F.coalesce(F.col("odd"), _rounded("parts", "n"))
    return per.select(*keys, mean.alias(name), "n")


def exact_mean(x: Column) -> Column:
    """An aggregate: the exact mean, rounded once, of doubles from 0.5 to 1 (multiples of 2**-53); of others the mean of decimals.

    Nearest of two neighbours, ties to the even one.
    """
    unit = float(1 << 53)
    inside = F.min(x.between(0.5, 1.0))
    # between 0.5 and 1 the sum in units is exact, and so is the quotient's whole part
    total, n = F.sum((x * unit).cast("bigint").cast("decimal(38,0)")), F.count(x).cast("decimal(20,0)")
    below = F.floor(total / n)
    below = F.when(below * n > total, below - 1).when((below + 1) * n <= total, below + 1).otherwise(below).cast("decimal(20,0)")
    twice = (total - below * n) * 2
    up = (twice > n) | ((twice == n) & (below % 2 == 1))
    return F.when(inside, (below + F.when(up, 1).otherwise(0)).cast("bigint").cast("double") / unit).otherwise(F.avg(x.cast("decimal(28,18)")).cast("double"))
