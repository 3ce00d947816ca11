"""Whole cases as one plan: units, exposure, scores, pooling, sufficiency and the published result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from . import assess, exposure, observe, package, quarantine, retrieve, scoring
from .validate import violations

#: units (case_id, claim, unit_id, source_type, text, ...) -> case_id, unit_id, selection_score, fake, real
Scorer = Callable[[DataFrame], DataFrame]


def digest_scorer(shown: DataFrame) -> DataFrame:
    """Scores from the digest of claim and unit: what stands for a model where there is none."""
    return scoring.hash_scores(shown, F.col("claim")).select("case_id", "unit_id", "selection_score", "fake", "real")


def request_violations(cases: DataFrame) -> DataFrame:
    """cases with violations of what was asked: an unsafe or missing session id, a blank claim, no medium (where they name one)."""
    safe = F.coalesce(F.col("session_id").rlike("\\A[A-Za-z0-9_.-]{1,80}\\z"), F.lit(False))
    checks = [(~safe, "session_id"), (T.is_blank(F.col("claim")), "claim")]
    if "media_path" in cases.columns:
        checks.append((F.coalesce("media_path", F.lit("")) == "", "media_path"))
    return cases.withColumn("violations", violations(*checks))


def _marked(transcripts: DataFrame, texts: DataFrame, visual: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """transcripts and visual with their units' own failures, and case_id, text_failure of the cases with a text that mustn't be shown."""
    first = lambda stage: quarantine.failure(stage, F.get("violations", F.lit(0)), F.col("ordinal"))
    blank = quarantine.failure("transcripts", F.when(T.is_blank(F.col("text")), "blank_transcript"), F.col("ordinal"))
    a = exposure.guarded(transcripts, fixed.TRANSCRIPT).withColumn("failure", F.coalesce(blank, first("transcript_exposure"))).drop("violations")
    b = exposure.guarded(texts, fixed.OCR).filter(F.size("violations") > 0).groupBy("case_id").agg(F.min(first("text_exposure")).alias("text_failure"))
    return a, b, visual.withColumn("failure", first("visual")).drop("violations")


def verified(cases: DataFrame, transcripts: DataFrame, texts: DataFrame, visual: DataFrame, scorer: Scorer = digest_scorer) -> DataFrame:
    """A row for each case: exposure, visual units, verification, warnings, sufficiency, violations, failure and the published document.

    cases: case_id, session_id, claim and perhaps media_path; transcripts, texts and visual: their units,
    visual ones with violations of their own (see observe.visual_units). Only what
    is shown is scored; a case with nothing to show is not run. All joins are by case_id.

    A case fails alone. What its request, units, composition or scorer does wrong is
    a failure of the run (`failure` says at which stage and why, `failed_stage` is runtime) and the case
    has no further stages; what goes wrong after that is a failure of its packaging.
    scorer may give a column failure, the name of an exception, for units it couldn't
    score; such a unit fails its case. A failed case has no document.
    """
    spoken, odd_texts, seen = _marked(transcripts, texts, visual)
    everything = exposure.composed(exposure.exposure(spoken, texts), seen)
    # the earliest failure of a case, on each of its rows
    everything = everything.withColumn("failure", F.least(F.min("failure").over(Window.partitionBy("case_id")), exposure.composed_failure()))
    sent = everything.filter(F.col("shown") & F.col("failure").isNull()).drop("selection_score", "fake", "real", "failure")
    scores = scorer(sent.join(cases.select("case_id", "claim"), "case_id"))
    error = F.col("failure") if "failure" in scores.columns else F.lit(None).cast("string")
    scores = scores.select("case_id", "unit_id", "selection_score", "fake", "real", error.alias("model_error"))
    # where a case has composed wrongly its ids may not be unique, and it has no scores to join
    everything = everything.drop("selection_score", "fake", "real").join(scores, ["case_id", "unit_id"], "left")
    model_failure = quarantine.failure("scorer", F.when(F.col("model_error").isNotNull(), "model_error"), F.col("position"), F.col("model_error"))
    everything = everything.withColumn("failure", F.least("failure", model_failure))
    plain = ("unit_id", "source_type", "eligible", "selection_score", "fake", "real", "confidence")
    rows = package.public_units(everything, (*plain, "failure"))
    scored = F.col("shown") & F.col("fake").isNotNull()
    best = lambda c: F.max(F.when(scored, F.struct(F.col(c).alias("x"), F.col("unit_id").alias("u"))))
    # one pass over a case's units: arrays in their order, pooled maxima
    per = rows.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "shown", *plain))).alias("units"), F.array_sort(F.collect_list(F.struct("position", "shown", "unit", F.col("violations").alias("wrong")))).alias("published"),
        best("fake").alias("f"), best("real").alias("r"), F.count_if(scored).alias("n"), F.min("failure").alias("late"),
    )
    kinds = {c: per.schema[c].dataType for c in ("units", "published")}
    asked = quarantine.failure("request", F.get("violations", F.lit(0)))
    j = request_violations(cases).join(per, "case_id", "left").join(odd_texts, "case_id", "left").withColumns({c: F.coalesce(F.col(c), F.array().cast(k)) for c, k in kinds.items()})
    j = j.withColumns({"fake": F.col("f.x"), "real": F.col("r.x"), "fake_winner": F.col("f.u"), "real_winner": F.col("r.u"), "n_units": F.when(F.col("n") > 0, F.col("n")), "failure": F.least(asked, F.col("text_failure"), F.col("late"))})
    j = j.select("case_id", "session_id", "claim", "units", "published", "failure", *scoring.verdict_columns())
    by_score = F.array_sort(F.transform(F.filter("units", lambda u: u["shown"] & u["selection_score"].isNotNull()), lambda u: F.struct((-u["selection_score"]).alias("s"), u["unit_id"].alias("id"))))
    j = j.withColumn("top_k_ids", F.transform(F.slice(by_score, 1, scoring.TOP_K), lambda t: t["id"]))
    side = lambda c, shown: F.filter(c, lambda u: u["shown"] == F.lit(shown))
    ids = F.transform("units", lambda u: u["unit_id"])
    top_units = F.filter("units", lambda u: F.array_contains(F.col("top_k_ids"), u["unit_id"]))
    has_visual = F.exists("units", lambda u: ~u["shown"])
    has_shown = F.exists("units", lambda u: u["shown"])
    said = F.array_compact(F.array(F.when(has_shown & has_visual, F.lit(fixed.VISUAL_EXCLUDED)), F.when(~has_shown, F.lit(fixed.NO_EVIDENCE)), F.when(~has_shown, F.lit(fixed.VISUAL_ONLY))))
    verification = F.struct("session_id", "claim", "model_verdict", "display_verdict", "evidence_status", ids.alias("all_ids"), top_units.alias("top_k"), "fake", "real", "p_fake", "p_real", "fake_winner", "real_winner", F.when(has_shown, fixed.RESPONSE["checkpoint_sha256"]).alias("checkpoint_sha256"))
    j = j.select("case_id", "session_id", "claim", "failure", side("units", True).alias("exposure"), side("units", False).alias("visual"), ids.alias("all_ids"), "top_k_ids", said.alias("warnings"), verification.alias("verification"), "published")
    j = assess.assessed(j)
    wrong = F.flatten(F.transform("published", lambda u: u["wrong"]))
    ran = F.col("failure").isNull()
    j = j.withColumn("violations", F.when(ran, F.concat("violations", wrong)).otherwise(F.array(F.col("failure.violation"))))
    public = lambda shown: F.transform(side("published", shown), lambda u: u["unit"])
    j = j.withColumns({"public_exposure": public(True), "public_visual": public(False), "runtime_ms": F.lit(0.0)}).drop("published")
    j = j.withColumn("failed_stage", F.when(~ran, "runtime").when(F.size("violations") > 0, "result_packaging"))
    out = package.with_public_document(j).withColumn("document", F.when(F.col("failed_stage").isNull(), F.col("document")))
    # what a failed run would have found out isn't told
    gone = {c: F.when(ran, F.col(c)) for c in ("exposure", "visual", "all_ids", "top_k_ids", "warnings", "verification", "sufficiency", "public_exposure", "public_visual")}
    return out.withColumns(gone).withColumn("outcome", package.outcome_json(F.col("failed_stage"), F.coalesce("failure.exception_type", F.lit("ValueError")), F.col("document")))


def visual_runs(cases: DataFrame, frames: DataFrame, replies: DataFrame, n: int = 4) -> tuple[DataFrame, DataFrame]:
    """(runs, units): from a claim's embedding to supplemental units, as one plan.

    cases: case_id, session_id, claim, embedding; frames: case_id, frame_id, frame_index (unique in its case),
    timestamp, frame_path, embedding; replies: case_id, raw, what an observer said of
    the frames it was shown. Each claim's n best frames are retrieved; the observations of its reply are
    recovered, judged against just these frames, and the sound ones become units. runs has a row a case:
    violation (blank session or claim, a reply of no usable shape, a unit that breaks
    its contract), frames, accepted and rejected observations, warnings. A case without frames isn't
    observed, which is a warning; a case without a reply has no observations.
    """
    found = retrieve.retrieved_for_claims(cases.select("case_id", F.lit(0).alias("claim_id"), "embedding"), frames, n).drop("claim_id", "ordinal", "frame_path", "timestamp")
    seen = found.withColumnRenamed("score", "retrieval_score").join(frames.drop("embedding"), ["case_id", "frame_index"])
    shown = seen.groupBy("case_id").agg(F.collect_set("frame_id").alias("known"), F.count("*").alias("n_frames"))
    said = replies.join(shown, "case_id")
    judged = observe.filtered(observe.parsed(said).join(shown.select("case_id", "known"), "case_id"), F.col("known")).drop("known")
    units = observe.visual_units(judged.filter(F.size("reasons") == 0), seen)
    counts = judged.groupBy("case_id").agg(F.count_if(F.size("reasons") == 0).alias("n_accepted"), F.count_if(F.size("reasons") > 0).alias("n_rejected"))
    broken = units.filter(F.size("violations") > 0).groupBy("case_id").agg(F.min(F.get("violations", F.lit(0))).alias("broken"))
    mode = said.select("case_id", observe.recovery_mode(F.col("raw")).alias("mode"))
    j = cases.select("case_id", "session_id", "claim").join(shown.drop("known"), "case_id", "left").join(mode, "case_id", "left").join(counts, "case_id", "left").join(broken, "case_id", "left")
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_frames", "n_accepted", "n_rejected")})
    unusable = ~F.col("mode").isin(fixed.CANONICAL, fixed.ARRAY, fixed.SINGLE)
    wrong = F.when(T.is_blank(F.col("session_id")), "session_id").when(T.is_blank(F.col("claim")), "claim").when(unusable, F.concat(F.lit("reply_"), "mode")).otherwise(F.col("broken"))
    rejected = F.format_string("rejected %d unsafe visual observations", "n_rejected")
    warned = F.array_compact(F.array(F.when(F.col("n_frames") == 0, fixed.NO_FRAMES), F.when(F.col("n_rejected") > 0, rejected)))
    return j.select("case_id", "session_id", wrong.alias("violation"), "n_frames", "n_accepted", "n_rejected", warned.alias("warnings")), units
