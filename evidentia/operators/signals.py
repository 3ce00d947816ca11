"""Signals that come in pieces: put in order, cut at a limit, clipped and measured without being joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Running counts go over so many places at a time, then over the blocks.
BLOCK = 4096


def clipped(x: Column) -> Column:
    """A sample within -1 and 1; null where it is no finite number."""
    y = x.cast("double")
    return F.when(F.abs(y) < float("inf"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y)))


def assembled(pieces: DataFrame, limit: int | None = None, by: str = "case_id", block: int = BLOCK) -> DataFrame:
    """by, ordinal, offset, total, samples: each piece with its place in the signal, cut where the signal reaches limit samples.

    pieces: by, ordinal, samples. The offset is the number of samples before a piece, summed
    within blocks of ordinals and over the blocks' totals, so that a signal of any number of
    pieces is spread; equal ordinals follow each other by length, then by their samples. Samples are clipped
    (see clipped). A null piece is empty; pieces beyond the limit stay as empty ones. total
    is the number of samples of the piece before the cut. A negative limit is an error.
    """
    if limit is not None and limit < 0:
        raise ValueError("a limit isn't negative")
    kind = pieces.schema["samples"].dataType.simpleString()
    rows = pieces.select(by, F.col("ordinal").cast("bigint").alias("ordinal"), F.coalesce("samples", F.array().cast(kind)).alias("samples"))
    rows = rows.withColumns({"total": F.size("samples").cast("bigint"), "__block": F.floor(F.col("ordinal") / block)})
    totals = rows.groupBy(by, "__block").agg(F.sum("total").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col(by).alias("__by"), F.col("__block").alias("__b"), before.alias("__before"))
    inside = F.sum("total").over(Window.partitionBy(by, "__block").orderBy("ordinal", "total", "samples").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__inside", F.coalesce(inside, F.lit(0)))
    rows = rows.join(starts, F.col(by).eqNullSafe(F.col("__by")) & F.col("__block").eqNullSafe(F.col("__b"))).withColumn("offset", F.col("__before") + F.col("__inside"))
    keep = F.col("total") if limit is None else F.greatest(F.lit(0), F.least(F.col("total"), F.lit(limit) - F.col("offset")))
    return rows.select(by, "ordinal", "offset", "total", F.transform(F.slice("samples", F.lit(1), keep.cast("int")), clipped).alias("samples"))


def measured(pieces: DataFrame, rate: int, limit: int | None = None, by: str = "case_id") -> DataFrame:
    """by, sample_count, seconds, low, high, cut, violation: what a signal is like, from its assembled pieces.

    seconds is samples by rate; low and high are those of the clipped samples, null in an empty
    signal; cut says whether samples lie beyond the limit. A signal with a sample that is no finite
    number within the limit has just its violation. A rate of zero or less is an error.
    """
    if rate <= 0:
        raise ValueError("a rate is positive")
    rows = assembled(pieces, limit, by)
    per = rows.groupBy(by).agg(
        F.sum(F.size("samples")).alias("n"), F.min(F.array_min("samples")).alias("low"), F.max(F.array_max("samples")).alias("high"), F.max(F.size("samples") < F.col("total")).alias("cut"),
        F.max(F.exists("samples", lambda x: x.isNull())).alias("odd"),
    )
    ok = ~F.col("odd")
    return per.select(by, *[F.when(ok, c).alias(n) for n, c in (("sample_count", F.col("n")), ("seconds", F.col("n") / F.lit(rate)), ("low", F.col("low")), ("high", F.col("high")), ("cut", F.col("cut")))], F.when(~ok, "sample_not_finite").alias("violation"))
