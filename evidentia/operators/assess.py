"""Structural sufficiency of a completed case: preconditions in order, then a decision with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .validate import violations

SCORER_SOURCES = (fixed.TEXT, fixed.TRANSCRIPT, fixed.OCR)


def assessed(cases: DataFrame) -> DataFrame:
    """cases with violations (the first one counts) and the assessment: null where there is a violation.

    cases, a row each: session_id, claim; exposure and visual, arrays of units
    (unit_id, source_type, eligible, selection_score, fake, real, confidence); all_ids;
    verification: session_id, claim, model_verdict, display_verdict,
    evidence_status, all_ids, top_k (array of units).
    """
    shown, visual, v = F.col("exposure"), F.col("visual"), F.col("verification")
    any_ = lambda units, test: F.exists(units, lambda u: F.coalesce(test(u), F.lit(False)))
    ids = lambda units: F.transform(units, lambda u: u["unit_id"])
    composed = F.concat(ids(shown), ids(visual))
    run = F.size(shown) > 0
    model, display, status = v["model_verdict"], v["display_verdict"], v["evidence_status"]
    wanted = F.when(model == "fake", fixed.DISPLAY["fake"]).otherwise(fixed.DISPLAY["real"])
    differs = lambda a, b: ~a.eqNullSafe(b)
    shown_ids = ids(shown)
    checks = (
        (any_(shown, lambda u: ~u["source_type"].isin(*SCORER_SOURCES) | ~u["eligible"]), "exposure_not_eligible_or_visual"),
        (any_(visual, lambda u: u["source_type"] != fixed.VISUAL), "visual_of_another_source"),
        (any_(visual, lambda u: u["eligible"]), "visual_eligible"),
        (any_(visual, lambda u: u["selection_score"].isNotNull()), "visual_selection_score"),
        (any_(visual, lambda u: u["fake"].isNotNull() | u["real"].isNotNull()), "visual_logits"),
        (any_(visual, lambda u: u["confidence"].isNotNull()), "visual_confidence"),
        (F.size(F.array_distinct(composed)) != F.size(composed), "unit_ids_not_unique"),
        (differs(F.col("all_ids"), composed), "all_units_differ"),
        (differs(v["all_ids"], composed), "verified_units_differ"),
        (any_(v["top_k"], lambda u: ~F.array_contains(shown_ids, u["unit_id"]) | (u["source_type"] == fixed.VISUAL) | ~u["eligible"]), "top_k_outside_exposure"),
        (differs(F.col("session_id"), v["session_id"]), "session_id_differs"),
        (differs(F.col("claim"), v["claim"]), "claim_differs"),
        (run & ~F.coalesce(model.isin("fake", "real"), F.lit(False)), "evidence_without_binary_verdict"),
        (run & differs(status, F.lit("sufficient")), "evidence_without_sufficient_status"),
        (run & differs(display, wanted), "display_differs_from_verdict"),
        (~run & differs(model, F.lit("not_run")), "verdict_without_evidence"),
        (~run & differs(status, F.lit("insufficient")), "sufficient_without_evidence"),
        (~run & differs(display, F.lit(fixed.DISPLAY["not_run"])), "display_without_evidence"),
    )
    count = lambda units, kind: F.size(F.filter(units, lambda u: u["source_type"] == kind)).cast("long")
    found = cases.withColumn("violations", violations(*checks))
    return found.withColumn("sufficiency", F.when(F.size("violations") == 0, assessment(
        run, F.size(shown).cast("long"), count(shown, fixed.TRANSCRIPT), count(shown, fixed.OCR), F.size(visual).cast("long"), F.size(v["top_k"]).cast("long"),
    )))


def assessment(run: Column, exposed: Column, transcript: Column, ocr: Column, visual: Column, top_k: Column) -> Column:
    """The decision, its reason and counts, fields in the order of their names."""
    return F.struct(
        exposed.alias("g1_exposure_count"), run.alias("model_was_run"), ocr.alias("ocr_exposure_count"),
        F.when(run, fixed.SUFFICIENT_REASON).otherwise(fixed.INSUFFICIENT_REASON).alias("reason_code"), F.when(run, "sufficient").otherwise("insufficient").alias("status"),
        (visual > 0).alias("supplemental_visual_present"), top_k.alias("top_k_count"), transcript.alias("transcript_exposure_count"), visual.alias("visual_unit_count"),
    )
