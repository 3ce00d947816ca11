"""Observations: recovery of the JSON's shape, safety filter with reasons, visual units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import hashing as H
from ..functions import text as T
from .validate import violations

#: Fixed values.
TYPES = ("entity", "action", "scene", "object_state", "spatial_relation", "temporal_change")
#: Substrings that mark inference, speech, captions or judgement.
PHRASES = (
    "probably", "likely", "seems", "appears", "appears to", "suggests", "because", "causes", "intends", "wants",
    "speaking about", "talking about", "discussing", "discusses", "mentions", "the topic", "topic", "speaking", "talking",
    "the text reads", "the text says", "subtitle", "logo", "watermark", "misinformation", "fake", "false", "true",
    "veracity", "claim", "proves", "disproves", "contradicts", "supports",
)
#: The fields of a single observation.
FIELDS = ("observation_type", "observation", "frame_ids", "evidence_refs")
MAX_ACCEPTED = 8


def recovery_mode(raw: Column) -> Column:
    """The reply's shape: canonical_object, top_level_array_wrapped or single_observation_object_wrapped; else not_json or unsupported.

    Whatever is taken for the list of observations must be an array of objects.
    """
    return _recovered(raw)[0]


def recovered(raw: Column) -> Column:
    """The observations of a reply as an array of JSON values; null where it has no usable shape."""
    mode, found = _recovered(raw)
    return F.when(mode.isin(fixed.CANONICAL, fixed.ARRAY, fixed.SINGLE), found)


def _recovered(raw: Column) -> tuple[Column, Column]:
    t = T.drop_code_fence(raw)
    # the parser takes the first value and leaves what follows; inside brackets nothing may follow
    whole = F.coalesce(F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1, F.lit(False))
    v = F.when(whole, F.try_parse_json(t))
    kind = F.schema_of_variant(v)
    keys = F.json_object_keys(t)
    inner = F.try_variant_get(v, "$.observations", "array<variant>")
    outer = F.try_variant_get(v, "$", "array<variant>")
    objects = lambda items: F.coalesce(F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))), F.lit(False))
    lists = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.observations", "variant")).startswith("ARRAY"), F.lit(False))
    one = F.size(F.array_intersect(keys, F.array(*map(F.lit, FIELDS)))) == len(FIELDS)
    mode = (
        F.when(v.isNull(), "not_json")
        .when(kind.startswith("ARRAY"), F.when(objects(outer), fixed.ARRAY).otherwise("unsupported"))
        .when(~kind.startswith("OBJECT"), "unsupported")
        .when(F.array_contains(keys, "observations"), F.when(lists & objects(inner), fixed.CANONICAL).otherwise("unsupported"))
        .when(one, fixed.SINGLE).otherwise("unsupported")
    )
    text = lambda items: F.transform(items, lambda x: F.to_json(x))
    return mode, F.when(mode == fixed.ARRAY, text(outer)).when(mode == fixed.CANONICAL, text(inner)).otherwise(F.array(F.to_json(v)))


def string_list(item: Column, name: str) -> Column:
    """A field of a JSON object that is a list of one or more strings, none empty; else null."""
    value = F.try_variant_get(F.try_parse_json(item), f"$.{name}", "variant")
    items = F.try_variant_get(value, "$", "array<variant>")
    good = F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False)) & (F.size(items) > 0) & F.forall(items, lambda x: F.coalesce((F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") != ""), F.lit(False)))
    return F.when(good, F.try_variant_get(value, "$", "array<string>"))


def parsed(replies: DataFrame, by: str = "case_id") -> DataFrame:
    """by, ordinal, recovery_mode and the fields of each observation in replies (by, raw); is_object is false for items that are none."""
    items = replies.select(by, recovery_mode(F.col("raw")).alias("recovery_mode"), F.sha2("raw", 256).alias("raw_sha256"), F.posexplode(recovered(F.col("raw"))).alias("ordinal", "item"))
    text = lambda c: F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json("item"), f"$.{c}", "variant")) == "STRING", F.get_json_object("item", f"$.{c}"))
    return items.select(by, "ordinal", "recovery_mode", "raw_sha256", F.col("item").startswith("{").alias("is_object"), text("observation_type").alias("observation_type"), text("observation").alias("observation"), string_list(F.col("item"), "frame_ids").alias("frame_ids"), string_list(F.col("item"), "evidence_refs").alias("evidence_refs"))


def reasons(kind: Column, text: Column, frames: Column, refs: Column, known: Column, is_object: Column | None = None, lowered: Column | None = None) -> Column:
    """All row-local reasons against an observation, in a fixed order; something that is no object has just that reason.

    lowered: the text in lower case, where it is a column already.
    """
    t = F.coalesce(T.strip(text), F.lit(""))
    empty = lambda a: a.isNull() | (F.size(a) == 0) | F.exists(a, lambda x: F.coalesce(x, F.lit("")) == "")
    unknown = lambda a: ~empty(a) & (F.size(F.array_except(a, known)) > 0)
    found = F.array_compact(F.array(
        F.when(~F.coalesce(kind.isin(*TYPES), F.lit(False)), "invalid_observation_type"),
        F.when(~F.length(t).between(5, 280), "invalid_observation_length"),
        F.when(empty(frames), "invalid_frame_ids").when(unknown(frames), "unknown_frame_ids"),
        F.when(empty(refs), "invalid_evidence_refs").when(unknown(refs), "unknown_evidence_refs"),
        F.when(T.contains_any(F.lower(t) if lowered is None else lowered, PHRASES), "risky_inference_or_ocr_language"),
        F.when((kind == "temporal_change") & (F.when(empty(frames), 0).otherwise(F.size(F.array_distinct(frames))) < 2), "temporal_change_requires_two_frame_ids"),
    ))
    return found if is_object is None else F.when(~is_object, F.array(F.lit("observation_not_object"))).otherwise(found)


def filtered(observations: DataFrame, known: Column, by: str = "case_id") -> DataFrame:
    """observations with `reasons`; otherwise valid ones beyond the eighth of a case get the cap's reason."""
    is_object = F.col("is_object") if "is_object" in observations.columns else None
    found = observations.withColumn("__lower", F.lower(F.coalesce("observation", F.lit(""))))
    found = found.withColumn("reasons", reasons(F.col("observation_type"), F.col("observation"), F.col("frame_ids"), F.col("evidence_refs"), known, is_object, F.col("__lower"))).drop("__lower")
    w = Window.partitionBy(by).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    valid = F.sum(F.when(F.size("reasons") == 0, 1).otherwise(0)).over(w)
    over = (F.size("reasons") == 0) & (valid > MAX_ACCEPTED)
    return found.withColumn("reasons", F.when(over, F.array(F.lit("maximum_observations_exceeded"))).otherwise(F.col("reasons")))


def with_frames(observations: DataFrame, frames: DataFrame, by: str = "case_id") -> DataFrame:
    """case, ordinal, primary_frame, start_time, end_time, unknown, referenced_frames: what an observation's frames say of its time, and they themselves in chronology.

    Its frames are those of frame_ids and evidence_refs together; the first in
    time (unknown times last, then index, then path) is the primary one. Ones that are
    unknown are counted in `unknown`: such an observation makes no unit.
    """
    refs = observations.select(by, "ordinal", F.explode(F.array_distinct(F.concat("frame_ids", "evidence_refs"))).alias("frame_id"))
    kinds = {"frame_path": "string", "frame_rank": "int", "image_sha256": "string", "retrieval_score": "double", "retrieval_rank": "int"}
    opt = [F.col(c) if c in frames.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    hit = refs.join(frames.select(by, "frame_id", "timestamp", "frame_index", *opt).withColumn("known", F.lit(1)), [by, "frame_id"], "left")
    # chronology first, then all that is told of a frame
    told = F.struct("frame_id", "frame_index", "frame_path", "frame_rank", "image_sha256", "retrieval_rank", "retrieval_score", F.col("timestamp").alias("timestamp_sec"))
    one = F.when(F.col("known") == 1, F.struct(F.col("timestamp").isNull().alias("n"), "timestamp", "frame_index", "frame_path", told.alias("told")))
    per = hit.groupBy(by, "ordinal").agg(F.array_sort(F.collect_list(one)).alias("f"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count_if(F.col("known").isNull()).alias("unknown"))
    first = F.get("f", F.lit(0))["told"]
    return per.select(by, "ordinal", first["frame_id"].alias("primary_frame"), first["frame_path"].alias("primary_path"), "start_time", "end_time", "unknown", F.transform("f", lambda x: x["told"]).alias("referenced_frames"))


def visual_units(accepted: DataFrame, frames: DataFrame, by: str = "case_id") -> DataFrame:
    """Accepted observations as supplemental units, never eligible and without scores or confidence, with violations.

    accepted: by, ordinal, observation_type, observation, frame_ids, evidence_refs,
    optional recovery_mode and raw_sha256. index counts a case's accepted ones from 0
    and is part of the hashed id. A unit with an unknown frame, without any frame, or with an
    id that comes twice has violations.
    """
    index = F.row_number().over(Window.partitionBy(by).orderBy("ordinal")) - 1
    rows = accepted.withColumn("index", index.cast("int")).drop("ordinal").withColumn("ordinal", F.col("index"))
    opt = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    text = T.strip(F.col("observation"))
    unit_id = H.visual_unit_id(index=F.col("index"), observation_type=F.col("observation_type"), observation=text, frame_ids=F.col("frame_ids"), evidence_refs=F.col("evidence_refs"))
    rows = rows.withColumns({"text": text, "unit_id": unit_id})
    at = with_frames(rows, frames, by)
    out = rows.join(at, [by, "ordinal"], "left")
    twice = F.count("*").over(Window.partitionBy(by, "unit_id")) > 1
    details = F.to_json(F.struct("evidence_refs", "frame_ids", "observation_type", F.lit(fixed.PROMPT_POLICY).alias("prompt_policy"), F.lit(fixed.QWEN[0]).alias("qwen_model_id"), F.lit(fixed.QWEN[1]).alias("qwen_revision"), opt("raw_sha256").alias("raw_generation_sha256"), opt("recovery_mode").alias("recovery_mode"), F.coalesce("referenced_frames", F.array().cast(out.schema["referenced_frames"].dataType)).alias("referenced_frames"), F.lit(fixed.SIGLIP[0]).alias("siglip_model_id"), F.lit(fixed.SIGLIP[1]).alias("siglip_revision")), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("double")
    return out.select(
        by, "ordinal", "unit_id", F.lit(fixed.VISUAL).alias("source_type"), "text", "start_time", "end_time", F.col("primary_frame").alias("frame_id"), F.col("primary_path").alias("frame_path"),
        none.alias("confidence"), F.lit(fixed.QWEN[0]).alias("producer"), F.col("index").alias("source_index"), F.lit("qwen_claim_blind_visual_observer").alias("extraction_method"), details.alias("details"),
        F.lit(False).alias("eligible"), none.alias("selection_score"), none.alias("fake"), none.alias("real"),
        violations((F.coalesce("unknown", F.lit(0)) > 0, "unknown_frame"), (F.col("primary_frame").isNull(), "no_frame"), (twice, "duplicate_unit_id")).alias("violations"),
    )
