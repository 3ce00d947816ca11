"""Contracts: each gives an array of violations in the order in which they are checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions.numeric import bbox, finite, is_close


def violations(*checks: tuple[Column, str]) -> Column:
    """Names of the checks whose condition is true; [0] is the first.

    By concatenation, which is compiled with its conditions; a filter with a lambda has all that stands below it interpreted.
    """
    none = F.array().cast("array<string>")
    return F.concat(none, *[F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(n))).otherwise(none) for c, n in checks])


def timestamps(start: Column, end: Column) -> Column:
    bad = lambda x: x.isNotNull() & ~(finite(x) & (x >= 0))
    return violations((bad(start), "invalid_start"), (bad(end), "invalid_end"), (end < start, "end_before_start"))


def monotonic(chunks: DataFrame, by: str = "case_id") -> DataFrame:
    """chunks that aren't blank, with violations where a time lies before the last known one."""
    w = Window.partitionBy(by).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    rows = chunks.filter(~T.is_blank(F.col("text")))
    return rows.withColumn("violations", violations((F.col("start_time") < last("start_time"), "start_not_monotonic"), (F.col("end_time") < last("end_time"), "end_not_monotonic")))


def units(df: DataFrame, by: str = "case_id") -> DataFrame:
    twice = F.count("*").over(Window.partitionBy(by, "unit_id")) > 1
    return df.withColumn("violations", violations((twice, "duplicate_unit_id"), ((F.col("source_type") == fixed.VISUAL) & F.col("eligible"), "visual_unit_eligible"), (F.col("eligible") & T.is_blank(F.col("text")), "blank_eligible_text")))


def detection(confidence: Column, polygon: Column, given: Column) -> Column:
    box = bbox(polygon)
    return violations((~(finite(confidence) & confidence.between(0, 1)), "invalid_confidence"), (box.isNull(), "invalid_polygon"), (given.isNotNull() & ~given.eqNullSafe(box), "bbox_mismatch"))


def result(df: DataFrame) -> DataFrame:
    """Invariants of verdict rows: model_verdict, display_verdict, evidence_status, fake, real, perhaps p_fake and p_real (both or none, and there just where the scores are)."""
    p = [F.col(c).isNull() for c in ("p_fake", "p_real") if c in df.columns]
    odd = (p[0] != p[1]) | (p[0] != F.col("fake").isNull()) if len(p) == 2 else F.lit(False)
    model, shown, status = F.col("model_verdict"), F.col("display_verdict"), F.col("evidence_status")
    off = model == "not_run"
    return df.withColumn("violations", violations(
        (F.col("fake").isNull() != F.col("real").isNull(), "class_keys_incomplete"),
        (odd, "probability_keys"),
        (~off & (F.lower(shown) != model), "display_differs_from_model"),
        (off & (F.col("fake").isNotNull() | F.col("real").isNotNull()), "scores_without_run"),
        (off & (status != "insufficient"), "not_run_but_sufficient"),
        (off & (shown != "NEI"), "not_run_display"),
        (~off & F.col("fake").isNull(), "run_without_scores"),
    ))


def response(predictions: DataFrame, outputs: DataFrame, submitted: DataFrame, by: str = "case_id") -> DataFrame:
    """by, violations of each prediction against its unit outputs and the units submitted.

    predictions: by, prediction, prediction_id, fake, real, input_count,
    exposed_count, truncated_count, top_k array<string>, fake_winner, real_winner.
    outputs: by, unit_id, modality, selection_score, fake, real. submitted: by, unit_id.
    """
    sent = submitted.select(by, "unit_id", F.lit(1).alias("sent")).distinct()
    sizes = submitted.groupBy(by).agg(F.count("*").alias("n_sent"))
    rows = outputs.join(sent, [by, "unit_id"], "left").join(predictions.select(by, "fake_winner", "real_winner"), by, "left")
    at = lambda label: F.max(F.when(F.col("unit_id") == F.col(f"{label}_winner"), F.col(label)))
    bad = lambda c: F.count_if(~finite(F.col(c)))
    per = rows.groupBy(by).agg(
        F.count("*").alias("n_out"), F.count_distinct("unit_id").alias("n_ids"), F.count_if(F.col("sent").isNull()).alias("n_unknown"),
        F.count_if(~F.coalesce(F.col("modality").isin("text", "ocr"), F.lit(False))).alias("n_modality"), (bad("selection_score") + bad("fake") + bad("real")).alias("n_odd"),
        F.max("fake").alias("max_fake"), F.max("real").alias("max_real"), at("fake").alias("at_fake"), at("real").alias("at_real"), F.collect_set("unit_id").alias("ids"),
    )
    j = predictions.join(per, by, "left").join(sizes, by, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    off = lambda a, b: F.coalesce(~is_close(F.col(a), F.col(b)), F.lit(True))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return j.select(by, violations(
        (~F.coalesce(F.col("prediction").isin("fake", "real"), F.lit(False)), "prediction"),
        (~F.coalesce(F.col("prediction_id") == F.when(F.col("prediction") == "fake", 0).otherwise(1), F.lit(False)), "prediction_id"),
        (~finite(F.col("fake")) | ~finite(F.col("real")), "sample_logits"),
        (z("input_count") != z("n_sent"), "input_count"),
        (z("n_unknown") > 0, "unknown_unit"), (z("n_ids") != z("n_out"), "duplicate_unit"), (z("n_modality") > 0, "modality"), (z("n_odd") > 0, "unit_scores"),
        (z("exposed_count") != z("n_out"), "exposed_count"), (z("truncated_count") != z("n_sent") - z("n_out"), "truncated_count"), (z("n_out") == 0, "nothing_exposed"),
        (F.size("top_k") > 5, "top_k_size"), (F.size(F.array_distinct("top_k")) != F.size("top_k"), "top_k_duplicate"), (F.size(F.array_except("top_k", ids)) > 0, "top_k_unknown"),
        (off("at_fake", "fake") | off("at_real", "real"), "winner"), (off("max_fake", "fake") | off("max_real", "real"), "sample_maximum"),
    ).alias("violations"))


def positional(requested: DataFrame, returned: DataFrame, by: str = "case_id") -> DataFrame:
    """Rows of both lists by position, with violations where one is missing or differs."""
    a, b = requested.select(by, "ordinal", F.col("frame_id").alias("asked")), returned.select(by, "ordinal", F.col("frame_id").alias("got"))
    j = a.join(b, [by, "ordinal"], "full")
    return j.withColumn("violations", violations((F.col("got").isNull(), "missing"), (F.col("asked").isNull(), "unexpected"), (F.col("asked") != F.col("got"), "different")))
