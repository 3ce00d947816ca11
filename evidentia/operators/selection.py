"""Bounded, ordered selection within cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n(df: DataFrame, n: int, *order, by: str = "case_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def ranked(df: DataFrame, *order, by: str = "case_id", name: str = "rank") -> DataFrame:
    """A 1-based rank without ties: order must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def top_then_restore(df: DataFrame, n: int, best: list[Column], restore: list[Column], by: str = "case_id") -> DataFrame:
    """The n best rows of each case, numbered from 0 in the restored order (`ordinal`)."""
    kept = first_n(df, n, *best, by=by)
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(*restore)) - 1)


def keep_best(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def balanced_buckets(df: DataFrame, groups: int, order: str = "ordinal", by: str = "case_id") -> DataFrame:
    """`bucket` of each row: group g holds rows g*n//G up to (g+1)*n//G; a row each if n <= G."""
    i = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(by))
    return df.withColumn("__i", i).withColumn("__c", n).withColumn("bucket", F.when(F.col("__c") <= groups, F.col("__i")).otherwise(F.floor(((F.col("__i") + 1) * groups - 1) / F.col("__c"))).cast("long")).drop("__i", "__c")


def merged_buckets(df: DataFrame, groups: int, order: str = "ordinal", by: str = "case_id") -> DataFrame:
    """One row a bucket: joined text in order, first start, last end, member ids in order."""
    cut = balanced_buckets(df, groups, order, by)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"), F.col("unit_id").alias("u"))))
    out = cut.groupBy(by, "bucket").agg(rows.alias("r"), F.min_by("start_time", order).alias("start_time"), F.max_by("end_time", order).alias("end_time"), F.count("*").alias("n_units"))
    return out.select(by, "bucket", F.array_join(F.transform("r", lambda s: s["t"]), " ").alias("text"), "start_time", "end_time", F.transform("r", lambda s: s["u"]).alias("unit_ids"), "n_units")


def chronology(ts: str, idx: str, path: str) -> list[Column]:
    return [F.col(ts).asc_nulls_last(), F.col(idx).asc(), F.col(path).asc()]
