"""Sufficiency, public projection, outcomes and stage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.canonical import with_document
from ..functions.hashing import canonical_json
from .validate import violations


def sufficiency(cases: DataFrame, units: DataFrame, by: str = "case_id") -> DataFrame:
    """Every case with its counts by source, its structural status and the reason."""
    shown = (F.col("source_type") != fixed.VISUAL) & F.col("eligible")
    per = units.groupBy(by).agg(F.count_if(shown).alias("exposed"), F.count_if(shown & (F.col("source_type") == fixed.TRANSCRIPT)).alias("transcript"), F.count_if(shown & (F.col("source_type") == fixed.OCR)).alias("ocr"), F.count_if(F.col("source_type") == fixed.VISUAL).alias("visual"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    j = cases.select(by).distinct().join(per, by, "left").select(by, *map(z, ("exposed", "transcript", "ocr", "visual")))
    ok = F.col("exposed") > 0
    reason = F.when(ok, fixed.SUFFICIENT_REASON).otherwise(fixed.INSUFFICIENT_REASON)
    return j.withColumns({"status": F.when(ok, "sufficient").otherwise("insufficient"), "reason_code": reason, "model_was_run": ok, "supplemental_visual": F.col("visual") > 0})


#: The fields of a published unit, in the order of their names.
PUBLIC = ("bbox", "confidence", "eligible_for_frozen_g1", "end_time", "evidence_refs", "extraction_method", "frame_id", "frame_ids", "logits", "observation_type", "producer", "selection_score", "source_index", "source_type", "source_unit_ids", "start_time", "text", "unit_id")
LISTS = ("frame_ids", "evidence_refs", "source_unit_ids")


def _list_field(details: Column, name: str) -> tuple[Column, Column]:
    """(list, wrong): a list of strings in free-form details (JSON). Absent: empty; null, a scalar or a mixed list: wrong."""
    keys = F.coalesce(F.json_object_keys(details), F.array().cast("array<string>"))
    there = F.array_contains(keys, name)
    value = F.try_variant_get(F.try_parse_json(details), f"$.{name}", "variant")
    items = F.try_variant_get(value, "$", "array<variant>")
    # of an empty array the schema has no element type
    strings = items.isNotNull() & F.forall(items, lambda x: F.schema_of_variant(x) == "STRING")
    ok = ~there | F.coalesce(F.schema_of_variant(value).startswith("ARRAY") & strings, F.lit(False))
    found = F.when(there & ok, F.try_variant_get(value, "$", "array<string>")).otherwise(F.array().cast("array<string>"))
    return found, ~ok


def public_units(units: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """case_id, position, unit, violations and the columns in keep: each unit with just the published fields.

    units: unit_id, source_type, text, start_time, end_time, frame_id, bbox,
    confidence, producer, eligible, selection_score, fake, real, extraction_method,
    source_index and details (JSON). Paths, sources and whatever else details hold
    are left out. Columns that units lacks are null.
    """
    kinds = {"bbox": "array<double>", "source_index": "int", "details": "string", "eligible": "boolean", **dict.fromkeys(("start_time", "end_time", "confidence", "selection_score", "fake", "real"), "double")}
    opt = lambda c: F.col(c) if c in units.columns else F.lit(None).cast(kinds.get(c, "string"))
    details = F.coalesce(opt("details"), F.lit("{}"))
    lists = {c: _list_field(details, c) for c in LISTS}
    kind = F.try_variant_get(F.try_parse_json(details), "$.observation_type", "variant")
    wrong_kind = kind.isNotNull() & ~F.coalesce(F.schema_of_variant(kind).isin("STRING", "VOID"), F.lit(False))
    fields = {c: opt(c) for c in PUBLIC}
    fields |= {c: x[0] for c, x in lists.items()}
    fields["eligible_for_frozen_g1"] = opt("eligible")
    fields["observation_type"] = F.try_variant_get(kind, "$", "string")
    fields["logits"] = F.when(opt("fake").isNotNull() | opt("real").isNotNull(), F.struct(opt("fake").alias("fake"), opt("real").alias("real")))
    if "source_unit_ids" in units.columns:
        fields["source_unit_ids"] = F.coalesce(F.col("source_unit_ids"), F.array().cast("array<string>"))
    wrong = violations(*[(x[1], f"{c}_not_strings") for c, x in lists.items()], (wrong_kind, "observation_type_not_string"))
    place = [c for c in ("case_id", "position", "shown") if c in units.columns]
    return units.select(*place, *keep, F.struct(*[fields[c].alias(c) for c in PUBLIC]).alias("unit"), wrong.alias("violations"))


def with_public_document(cases: DataFrame) -> DataFrame:
    """cases with their result as canonical JSON (`document`), with nested verdict, sufficiency and evidence.

    cases: session_id, claim, verification (model_verdict, display_verdict,
    evidence_status, fake, real, p_fake, p_real, fake_winner, real_winner,
    checkpoint_sha256), sufficiency, public_exposure and public_visual (arrays of
    published units), top_k_ids, runtime_ms. Warnings and paths aren't published.
    """
    v = F.col("verification")
    # a class map of a case that wasn't run has no keys
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    pair = lambda a, b, kind="double": F.when(v[a].isNotNull(), F.create_map(F.lit("fake"), v[a].cast(kind), F.lit("real"), v[b].cast(kind))).otherwise(none.cast(f"map<string,{kind}>"))
    verdict = F.struct(v["checkpoint_sha256"].alias("checkpoint_sha256"), pair("fake_winner", "real_winner", "string").alias("class_winners"), v["display_verdict"].alias("display_verdict"), v["evidence_status"].alias("evidence_status"), v["model_verdict"].alias("model_verdict"), pair("p_fake", "p_real").alias("probabilities"), pair("fake", "real").alias("sample_logits"))
    evidence = F.struct(F.col("top_k_ids").alias("g1_top_k_explanation_unit_ids"), F.col("public_exposure").alias("g1_exposure_units"), F.col("public_visual").alias("visual_supplemental_units"))
    evidence = F.struct(evidence["g1_exposure_units"].alias("g1_exposure_units"), evidence["g1_top_k_explanation_unit_ids"].alias("g1_top_k_explanation_unit_ids"), evidence["visual_supplemental_units"].alias("visual_supplemental_units"))
    result = F.struct("claim", evidence.alias("evidence"), "runtime_ms", F.lit(fixed.SCHEMA_VERSION).alias("schema_version"), "session_id", "sufficiency", verdict.alias("verdict"))
    return with_document(cases, "document", result)


def outcome(failed_stage: Column, exception: Column) -> Column:
    """status, code, stage, exception_type, public_message: success, or the fixed code and message of the stage that failed."""
    pick = lambda i: F.coalesce(*[F.when(failed_stage == k, x[i]) for k, x in fixed.FAILURES.items()])
    return F.struct(F.when(failed_stage.isNull(), "success").otherwise("failure").alias("status"), pick(0).alias("code"), failed_stage.alias("stage"), F.when(failed_stage.isNotNull(), exception).alias("exception_type"), pick(1).alias("public_message"))


def outcome_violations(status: Column, has_result: Column, stage: Column, code: Column, message: Column, exception: Column) -> Column:
    """Success has a result and no failure, failure the other way round; code and message are those of the stage."""
    failed, ok = status == "failure", status == "success"
    wrong = lambda x, i: failed & ~F.coalesce(*[F.when(stage == k, x.eqNullSafe(F.lit(v[i]))) for k, v in fixed.FAILURES.items()], F.lit(False))
    return violations(
        (~ok & ~failed, "status"), (ok & (~has_result | stage.isNotNull()), "success_without_result_or_with_failure"), (failed & (has_result | stage.isNull()), "failure_with_result_or_without_failure"),
        (failed & stage.isNotNull() & ~stage.isin(*fixed.FAILURES), "stage"), (wrong(code, 0), "code_of_another_stage"), (wrong(message, 1), "message_of_another_stage"), (failed & (F.coalesce(exception, F.lit("")) == ""), "exception_type"),
    )


def outcome_json(failed_stage: Column, exception: Column, document: Column) -> Column:
    """The published outcome of a case as canonical JSON: its result document, or a failure that says no more than its type."""
    o = outcome(failed_stage, exception)
    failure = canonical_json(**{x: o[x] for x in ("code", "exception_type", "public_message", "stage")})
    ok = failed_stage.isNull()
    return F.concat(F.lit('{"failure":'), F.when(ok, "null").otherwise(failure), F.lit(',"result":'), F.when(ok, document).otherwise("null"), F.lit(f',"schema_version":{fixed.SCHEMA_VERSION},"status":"'), o["status"], F.lit('"}'))


def stage_events(cases: DataFrame, by: str = "case_id") -> DataFrame:
    """Nine completed stages for every case."""
    s = F.posexplode(F.array(*map(F.lit, fixed.STAGES))).alias("sequence", "name")
    return cases.select(by, s).select(by, (F.col("sequence") + 1).alias("sequence"), "name", F.lit("completed").alias("status"), F.lit(0.0).alias("runtime_ms"))


def transition_ok(before: Column, after: Column) -> Column:
    """Whether a stage may go from one status to the next."""
    return ((before == "pending") & after.isin("running", "skipped")) | ((before == "running") & after.isin("completed", "failed"))


def stage_order(events: DataFrame, by: str = "case_id") -> DataFrame:
    """by, violations of stage events (by, sequence, name, statuses: the statuses a stage went through).

    Stages come one after another in their fixed order, and each from pending
    through running (or to skipped) to completed or failed.
    """
    expected = F.element_at(F.array(*map(F.lit, fixed.STAGES)), F.least(F.col("sequence").cast("int"), F.lit(len(fixed.STAGES))))
    steps = F.zip_with(F.slice("statuses", F.lit(1), F.greatest(F.size("statuses") - 1, F.lit(0))), F.slice("statuses", F.lit(2), F.greatest(F.size("statuses") - 1, F.lit(0))), transition_ok)
    bad = ~F.forall(steps, lambda x: F.coalesce(x, F.lit(False))) | (F.col("statuses")[0] != "pending")
    wrong = (F.col("name") != expected) | (F.col("sequence") > len(fixed.STAGES))
    per = events.groupBy(by).agg(F.max(wrong).alias("order"), F.max(bad).alias("transition"), (F.count("*") != F.max("sequence")).alias("missing"))
    return per.select(by, violations((F.col("order") | F.col("missing"), "stage_order"), (F.col("transition"), "stage_transition")).alias("violations"))


def stage_details(cases: DataFrame) -> DataFrame:
    """case_id, sequence, name, detail of the nine stages; cases: case_id, transcript, ocr, visual, total, evaluated (counts)."""
    said = []
    for text in fixed.STAGE_DETAILS:
        head, _, rest = text.partition("{")
        count, _, tail = rest.partition("}")
        said.append(F.concat(F.col(count).cast("string"), F.lit(tail)) if count else F.lit(head))
    stages = F.array(*[F.struct(F.lit(i + 1).alias("sequence"), F.lit(n).alias("name"), d.alias("detail")) for i, (n, d) in enumerate(zip(fixed.STAGES, said))])
    return cases.select("case_id", F.explode(stages).alias("s")).select("case_id", "s.*")
