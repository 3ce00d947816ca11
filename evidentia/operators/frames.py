"""On-screen text: raw detections, frames, reading order, and frames as units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions.numeric import bbox
from .means import exact_mean
from .selection import keep_best, top_then_restore
from .validate import violations

MIN_CONFIDENCE, MIN_CHARACTERS, MAX_UNITS = 0.5, 3, 6


def timestamp(index: Column, fps: Column) -> Column:
    """Seconds of a frame; null where the rate isn't positive."""
    return F.when(fps > 0, index / fps)


def _is_object(v: Column, path: str = "$") -> Column:
    """Whether a JSON object stands at path of v; copies nothing of it."""
    return F.try_variant_get(v, path, "struct<_:boolean>").isNotNull()


def raw_detections(replies: DataFrame, by: str = "case_id") -> DataFrame:
    """by, frame, ordinal, text, confidence, polygon, box and violations from replies (by, frame, raw).

    The payload of a reply (JSON text) is what stands in `res`, else the object itself; anything else is malformed.
    Texts, scores and polygons are parallel arrays (rec_texts, rec_scores, rec_polys or
    dt_polys); unequal lengths are a violation of the whole reply, in a row without
    a detection. Blank texts are dropped.
    """
    # each step is read more than once, so Spark keeps it as a column; nothing is filtered before the generator,
    # as the optimizer would write out all steps in the filter once for each time they are read
    inner = F.when(_is_object(F.col("v"), "$.res"), "res").when(F.try_variant_get("v", "$.res", "variant").isNull() & _is_object(F.col("v")), "whole")
    p = replies.withColumn("v", F.try_parse_json("raw")).withColumn("payload", inner)
    get = lambda name, kind: F.when(F.col("payload") == "res", F.try_variant_get("v", f"$.res.{name}", kind)).when(F.col("payload") == "whole", F.try_variant_get("v", f"$.{name}", kind))
    none = lambda kind: F.array().cast(kind)
    p = p.select(by, "frame", F.col("payload").isNull().alias("malformed"), F.coalesce(get("rec_texts", "array<string>"), none("array<string>")).alias("texts"), F.coalesce(get("rec_scores", "array<double>"), none("array<double>")).alias("scores"), F.coalesce(get("rec_polys", "array<array<array<double>>>"), get("dt_polys", "array<array<array<double>>>"), none("array<array<array<double>>>")).alias("polygons"))
    uneven = (F.size("texts") != F.size("scores")) | (F.size("texts") != F.size("polygons"))
    p = p.withColumn("why", violations((F.col("malformed"), "malformed_payload"), (uneven, "arrays_of_unequal_length")))
    one = F.arrays_zip(F.col("texts").alias("text"), F.col("scores").alias("confidence"), F.col("polygons").alias("polygon"))
    # a reply at fault has one row; outer, so that no filter on the array is inferred
    rows = p.select(by, "frame", "why", F.posexplode_outer(F.when(F.size("why") == 0, one)).alias("ordinal", "d"))
    good = F.size("why") == 0
    rows = rows.filter(~good | ~T.is_blank(F.col("d.text"))).select(by, "frame", F.when(good, F.col("ordinal")).alias("ordinal"), "d.*", "why").withColumn("box", bbox(F.col("polygon")))
    checked = violations((~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "invalid_confidence"), (F.col("box").isNull(), "invalid_polygon"))
    return rows.select(by, "frame", "ordinal", "text", "confidence", "polygon", "box", F.when(F.size("why") > 0, F.col("why")).otherwise(checked).alias("violations"))


def frame_candidates(detections: DataFrame, by: str = "case_id") -> DataFrame:
    """A row for each frame with an accepted detection: joined text in reading order, mean confidence, union of boxes, counts, texts, the accepted detections as they came.

    detections: by, frame (its rank), ordinal, text, confidence, box, perhaps polygon. A detection is
    accepted with a confidence of at least 0.5 and three letters or digits after normalising.
    """
    d = detections.withColumn("norm", T.normalized("text"))
    ok = (F.col("confidence") >= MIN_CONFIDENCE) & (T.alnum_count(F.col("norm")) >= MIN_CHARACTERS)
    d = d.withColumn("ok", F.coalesce(ok, F.lit(False)))
    box = F.col("box")
    polygon = F.col("polygon") if "polygon" in detections.columns else F.lit(None).cast("array<array<double>>")
    order = F.struct(*[box[i].alias(f"b{i}") for i in (1, 0, 3, 2)], F.col("ordinal"), F.col("norm").alias("t"), F.struct(F.col("confidence"), polygon.alias("polygon"), box.alias("runtime_bbox"), F.col("text")).alias("raw"))
    g = d.groupBy(by, "frame").agg(
        F.count("*").alias("raw_count"), F.count_if("ok").alias("accepted_count"), F.array_sort(F.collect_list(F.when(F.col("ok"), order))).alias("read"), exact_mean(F.when(F.col("ok"), F.col("confidence"))).alias("confidence"),
        *[f(F.when(F.col("ok"), box[i])).alias(n) for f, i, n in ((F.min, 0, "xmin"), (F.min, 1, "ymin"), (F.max, 2, "xmax"), (F.max, 3, "ymax"))],
    ).filter("accepted_count > 0")
    texts = F.transform("read", lambda s: s["t"])
    return g.select(by, "frame", "raw_count", "accepted_count", "confidence", F.array("xmin", "ymin", "xmax", "ymax").alias("bbox"), F.array_join(texts, " ").alias("text"), texts.alias("texts"), F.transform("read", lambda s: s["raw"]).alias("accepted_detections"))


def text_units(candidates: DataFrame, frames: DataFrame, by: str = "case_id", n: int = MAX_UNITS) -> DataFrame:
    """A case's n best frames with text, one for each folded text, as units in order of their rank.

    candidates: see frame_candidates; frames: by, frame, frame_id, frame_index,
    frame_path, timestamp. Best by mean confidence, then detections, then rank. Folded texts are compared by a
    digest, so that keys stay short.
    """
    quality = [F.desc("confidence"), F.desc("raw_count"), F.asc("frame")]
    keyed = candidates.withColumn("folded", T.fold_key("text")).withColumn("key", F.sha2("folded", 256)).drop("folded")
    top = top_then_restore(keep_best(keyed, [by, "key"], *quality), n, quality, [F.asc("frame")], by=by)
    out = top.join(frames, [by, "frame"])
    accepted = [F.col("accepted_detections")] if "accepted_detections" in candidates.columns else []
    details = F.to_json(F.struct(*accepted, F.lit(fixed.DETECTOR[0]).alias("detector_model_id"), F.lit(fixed.DETECTOR[1]).alias("detector_revision"), F.col("frame").alias("frame_rank"), F.col("texts").alias("normalized_detection_texts"), F.col("raw_count").alias("raw_detection_count"), F.lit(fixed.RECOGNIZER[0]).alias("recognizer_model_id"), F.lit(fixed.RECOGNIZER[1]).alias("recognizer_revision")), {"ignoreNullFields": "false"})
    return out.select(
        by, "ordinal", F.format_string("ocr_%04d", "ordinal").alias("unit_id"), F.lit(fixed.OCR).alias("source_type"), "text", F.col("timestamp").alias("start_time"), F.col("timestamp").alias("end_time"), "frame_id", "frame_path", "bbox", "confidence",
        F.lit(fixed.OCR_PRODUCER).alias("producer"), F.col("frame_index").cast("int").alias("source_index"), F.lit("paddleocr_v5_frame").alias("extraction_method"), details.alias("details"), F.lit(True).alias("eligible"), "raw_count", "accepted_count", F.col("frame").alias("frame_rank"),
    )


def zipped(frames: DataFrame, scores: DataFrame, by: str = "case_id") -> DataFrame:
    """by, frames' columns, score, violations: a case's list of scores against its frames by position; lengths must match."""
    s = scores.select(by, F.posexplode("scores").alias("ordinal", "score"))
    n = frames.groupBy(by).agg(F.count("*").alias("n")).join(scores.select(by, F.size("scores").alias("m")), by, "full")
    bad = n.select(by, violations((~F.col("n").eqNullSafe(F.col("m")), "scores_and_frames_differ_in_number")).alias("violations"))
    numbered = frames.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy("frame_index")) - 1)
    return numbered.join(s, [by, "ordinal"], "left").join(bad, by)
