"""Evidence units: transcript segments, text detections, observations and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import VISUAL
from ..functions import text as T
from ..functions.canonical import with_document
from .validate import violations


#: What a transcript's provenance says of its model, as canonical JSON.
DETAILS = f'{{"frozen_revision":"{fixed.WHISPER[1]}","model_id":"{fixed.WHISPER[0]}"}}'


def transcript_units(segments: DataFrame, order: str = "ordinal", keep: tuple[str, ...] = ()) -> DataFrame:
    """Transcript segments as units: case_id, ordinal, unit_id, source_type, text, times, confidence, eligible and where they come from.

    segments: case_id, an ordinal column, text and optional start_time, end_time,
    segment_index and source_uri. Blank segments stay and aren't eligible, so that
    their case fails (see cases.input_failures); ids count from zero a case; source_index is the segment's own or its place. keep
    names columns that stay.
    """
    w = Window.partitionBy("case_id").orderBy(order)
    n = F.row_number().over(w) - 1
    opt = lambda c, kind="double": F.col(c) if c in segments.columns else F.lit(None).cast(kind)
    source = F.coalesce(opt("segment_index", "int"), n).cast("int").alias("source_index")
    return segments.select("case_id", n.alias("ordinal"), F.format_string("asr_%04d", n).alias("unit_id"), F.lit("transcript").alias("source_type"), T.strip(F.col("text")).alias("text"), opt("start_time").alias("start_time"), opt("end_time").alias("end_time"), F.lit(None).cast("double").alias("confidence"), (~T.is_blank(F.col("text"))).alias("eligible"), F.lit(fixed.WHISPER[0]).alias("producer"), opt("source_uri", "string").alias("source_uri"), source, F.lit("whisper_asr").alias("extraction_method"), F.lit(DETAILS).alias("details"), *keep)


#: Id prefix and field of the text of each kind of supplied item.
MOCK = {fixed.TRANSCRIPT: ("transcript", "text"), fixed.OCR: ("ocr", "text"), VISUAL: ("visual", "observation")}


def mock_units(items: DataFrame, kind: str) -> DataFrame:
    """Supplied items (case_id, ordinal, item: JSON, media_path) as units of one kind, numbered by position.

    Blank ones stay, not eligible; visual ones never are. Times and confidences that
    are no numbers are null and violations. A transcript's confidence is 1
    only where the field is absent: a null stays null. A text's source is its frame's
    path, or the medium where that is absent or empty.
    """
    prefix, field = MOCK[kind]
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("ordinal")) - 1
    at = lambda name, cast="string": F.get_json_object("item", f"$.{name}").try_cast(cast)
    text = T.strip(F.coalesce(at(field), F.lit("")))
    has = F.array_contains(F.json_object_keys("item"), "confidence")
    number = F.get_json_object("item", "$.confidence").try_cast("double")
    confidence = number if kind != fixed.TRANSCRIPT else F.when(has, number).otherwise(1.0)
    path = F.nullif(at("frame_path"), F.lit(""))
    source = {fixed.TRANSCRIPT: F.col("media_path"), fixed.OCR: F.coalesce(path, F.col("media_path")), VISUAL: at("frame_path")}[kind]
    none = lambda c: F.lit(None).cast(c)
    timed = kind == fixed.TRANSCRIPT
    method = {fixed.TRANSCRIPT: "mock_asr", fixed.OCR: "mock_ocr", VISUAL: "mock_vlm"}[kind]
    return items.select(
        "case_id", n.alias("ordinal"), F.format_string(f"{prefix}-%03d", n).alias("unit_id"), F.lit(kind).alias("source_type"), text.alias("text"),
        (at("start_time", "double") if timed else none("double")).alias("start_time"), (at("end_time", "double") if timed else none("double")).alias("end_time"),
        (none("string") if timed else at("frame_id")).alias("frame_id"), (none("string") if timed else at("frame_path")).alias("frame_path"),
        (F.from_json(F.get_json_object("item", "$.bbox"), "array<double>") if kind == fixed.OCR else none("array<double>")).alias("bbox"), confidence.alias("confidence"),
        F.lit(method).alias("producer"), source.alias("source_uri"), n.alias("source_index"), F.lit(method).alias("extraction_method"),
        (n if kind == VISUAL else none("int")).alias("retrieval_rank"), (F.lit(kind != VISUAL) & (text != "")).alias("eligible"),
        violations(*[(F.get_json_object("item", f"$.{c}").isNotNull() & at(c, "double").isNull(), f"{c}_not_a_number") for c in ("start_time", "end_time", "confidence")]).alias("violations"),
    )


def without_scores(units: DataFrame) -> DataFrame:
    """units with their scores cleared, where they have any."""
    kinds = {"selection_score": "double", "fake": "double", "real": "double"}
    return units.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})


def modality(source_type: Column) -> Column:
    return F.when(source_type == "ocr", "ocr").when(source_type.isin("text", "transcript"), "text")


def eligible(units: DataFrame) -> DataFrame:
    """Units that a scorer may see."""
    return units.filter((F.col("source_type") != VISUAL) & F.col("eligible"))


def pool(*parts: DataFrame) -> DataFrame:
    """The parts' units one after another: case_id, source_rank, ordinal, position and the rest."""
    out = parts[0].withColumn("source_rank", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("source_rank", F.lit(k)), allowMissingColumns=True)
    w = Window.partitionBy("case_id").orderBy("source_rank", "ordinal")
    return out.withColumn("position", F.row_number().over(w) - 1)


def request_units(units: DataFrame) -> DataFrame:
    """case_id, units, violations: what a scorer is sent, eligible units in order with their type, modality and whole text, none cut off."""
    one = F.struct("ordinal", "unit_id", F.col("source_type").alias("unit_type"), modality(F.col("source_type")).alias("modality"), "text")
    rows = eligible(units).groupBy("case_id").agg(F.array_sort(F.collect_list(one)).alias("u"), F.count_if(T.is_blank(F.col("text"))).alias("blank"), (F.count("*") - F.count_distinct("unit_id")).alias("twice"))
    why = F.array_compact(F.array(F.when(F.col("blank") > 0, "blank_text"), F.when(F.col("twice") > 0, "duplicate_unit_id")))
    return rows.select("case_id", F.transform("u", lambda s: F.struct(*[s[c].alias(c) for c in ("unit_id", "unit_type", "modality", "text")])).alias("units"), why.alias("violations"))


def scorer_requests(cases: DataFrame, units: DataFrame, dataset: str = "external") -> DataFrame:
    """case_id, violations, document: each case's request to a scorer as canonical JSON; null where it has violations.

    cases: case_id, session_id, claim. A case without eligible units has an empty list; there is no limit on
    their number here. What is blank or comes twice is a violation.
    """
    j = cases.join(request_units(units), "case_id", "left")
    none = F.array().cast(j.schema["units"].dataType)
    request = F.struct(F.coalesce("units", none).alias("candidate_units"), F.col("session_id").alias("case_id"), "claim", F.lit(dataset).alias("dataset"))
    ok = F.size(F.coalesce("violations", F.array().cast("array<string>"))) == 0
    out = with_document(j, "document", request).withColumn("document", F.when(ok, F.col("document")))
    return out.select("case_id", F.coalesce("violations", F.array().cast("array<string>")).alias("violations"), "document")
