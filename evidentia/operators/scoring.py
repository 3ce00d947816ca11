"""Scores, class-wise pooling and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import hashing as H

MAX_UNITS = 24
TOP_K = 5


def hash_scores(units: DataFrame, claim: Column) -> DataFrame:
    """units with selection_score, fake and real from the digest of claim and unit."""
    d = H.unit_digest(claim, F.col("unit_id"), F.col("source_type"), F.col("text"))
    return units.withColumn("__d", d).withColumn("selection_score", H.selection_score(F.col("__d"))).withColumn("fake", H.logit(F.col("__d"), "fake")).withColumn("real", H.logit(F.col("__d"), "real")).drop("__d")


def pooled(scored: DataFrame, by: str = "case_id") -> DataFrame:
    """by, fake, real, fake_winner, real_winner, n_units: class-wise maxima; ties go to the largest unit id."""
    best = lambda c: F.max(F.struct(F.col(c).alias("x"), F.col("unit_id").alias("u")))
    out = scored.groupBy(by).agg(best("fake").alias("f"), best("real").alias("r"), F.count("*").alias("n_units"))
    return out.select(by, F.col("f.x").alias("fake"), F.col("r.x").alias("real"), F.col("f.u").alias("fake_winner"), F.col("r.u").alias("real_winner"), "n_units")


def verdict_columns() -> list[Column]:
    """A case's verdict from its pooled scores: fake, real, their winners and n_units (null where no unit was scored)."""
    m = F.greatest("fake", "real")
    ef, er = F.exp(F.col("fake") - m), F.exp(F.col("real") - m)
    run = F.col("n_units").isNotNull()
    word = F.when(F.col("fake") >= F.col("real"), "fake").otherwise("real")
    return [
        F.col("fake"), F.col("real"), F.round(ef / (ef + er), 12).alias("p_fake"), F.round(er / (ef + er), 12).alias("p_real"), F.col("fake_winner"), F.col("real_winner"),
        F.when(run, word).otherwise("not_run").alias("model_verdict"), F.when(run, F.when(word == "fake", fixed.DISPLAY["fake"]).otherwise(fixed.DISPLAY["real"])).otherwise(fixed.DISPLAY["not_run"]).alias("display_verdict"),
        F.when(run, "sufficient").otherwise("insufficient").alias("evidence_status"), F.coalesce("n_units", F.lit(0)).alias("n_units"),
    ]


def verdicts(cases: DataFrame, pool: DataFrame, by: str = "case_id") -> DataFrame:
    """A row for every case; cases without a scored unit are not run and insufficient."""
    return cases.select(by).join(pool, by, "left").select(by, *verdict_columns())


def attach(units: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """units with their scores; units without one keep nulls."""
    return units.join(scores, keys, "left")


def warnings(visual: Column, truncated: Column) -> Column:
    """The scorer's warnings of a case."""
    return F.array_compact(F.array(F.when(visual, F.lit(fixed.VISUAL_EXCLUDED)), F.when(truncated, F.lit(fixed.TRUNCATED))))


def explained(cases: DataFrame, units: DataFrame, by: str = "case_id") -> DataFrame:
    """by, position, unit_id and the unit's fields for the ids of cases' top_k, in their own order (an inner join)."""
    ids = cases.select(by, F.posexplode("top_k").alias("position", "unit_id"))
    return ids.join(units, [by, "unit_id"])


def scored_result(cases: DataFrame, units: DataFrame, outputs: DataFrame, by: str = "case_id") -> DataFrame:
    """Every case's units with all earlier scores cleared and the scorer's attached, and the case's warnings.

    units may carry scores of an earlier run; outputs: by, unit_id, selection_score, fake, real.
    """
    plain = units.drop("selection_score", "fake", "real")
    got = attach(plain, outputs.select(by, "unit_id", "selection_score", "fake", "real"), [by, "unit_id"])
    sent = (F.col("source_type") != fixed.VISUAL) & F.col("eligible")
    per = got.groupBy(by).agg(F.max(F.col("source_type") == fixed.VISUAL).alias("visual"), (F.count_if(F.col("selection_score").isNotNull()) < F.count_if(sent)).alias("cut"))
    said = cases.select(by).join(per, by, "left").select(by, warnings(F.coalesce("visual", F.lit(False)), F.coalesce("cut", F.lit(False))).alias("warnings"))
    return got.join(said, by)
