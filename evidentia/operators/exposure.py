"""What the scorer is shown: at most twelve transcript units and six text units a case, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from . import quarantine
from .selection import balanced_buckets, top_then_restore
from .units import without_scores
from .validate import violations

TRANSCRIPTS, TEXTS = 12, 6
SHOWN = ("unit_id", "source_type", "text", "start_time", "end_time", "confidence", "producer", "source_uri", "source_index", "extraction_method", "source_unit_ids", "source_producers", "eligible")


def guarded(units: DataFrame, kind: str) -> DataFrame:
    """units with violations: of another kind than the exposure takes, or not eligible."""
    return units.withColumn("violations", violations((~F.col("source_type").eqNullSafe(F.lit(kind)), f"{kind}_exposure_accepts_only_{kind}_units"), (~F.coalesce("eligible", F.lit(False)), f"{kind}_exposure_units_must_be_eligible")))


def transcript_exposure(units: DataFrame, groups: int = TRANSCRIPTS) -> DataFrame:
    """case_id, ordinal and SHOWN: a case's transcript units in order, merged into groups where there are more.

    A group has its units' texts joined by a space, the first one's start and source,
    the last one's end, and lists of their ids and producers. A case with no more
    units than groups keeps them as they are. Scores are cleared. A
    group is eligible if all its units are, and a transcript if all of them are; a column
    failure is that of the unit that failed first.
    """
    if groups <= 0:
        raise ValueError("exposure limits must be positive")
    cut = balanced_buckets(units, groups).withColumn("many", F.count("*").over(Window.partitionBy("case_id")) > groups)
    names = ["unit_id", "text", "start_time", "end_time", "confidence", "producer", "source_uri", "source_index", "extraction_method", "eligible", "source_type"]
    own = ["failure"] if "failure" in units.columns else []
    per = cut.groupBy("case_id", "bucket", "many").agg(F.array_sort(F.collect_list(F.struct("ordinal", *names, *own))).alias("u"))
    first, last = F.col("u")[0], F.element_at("u", -1)
    each = lambda c: F.transform("u", lambda x: x[c])
    many = lambda a, b: F.when(F.col("many"), a).otherwise(b)
    none = F.array().cast("array<string>")
    out = per.select(
        "case_id", F.col("bucket").alias("ordinal"), many(F.format_string("transcript_exposure_%04d", "bucket"), first["unit_id"]).alias("unit_id"), F.coalesce(F.array_min(F.filter(each("source_type"), lambda x: x != fixed.TRANSCRIPT)), F.lit(fixed.TRANSCRIPT)).alias("source_type"),
        F.array_join(each("text"), " ").alias("text"), first["start_time"].alias("start_time"), last["end_time"].alias("end_time"), many(F.lit(None).cast("double"), first["confidence"]).alias("confidence"),
        many(F.lit(fixed.EXPOSURE_PRODUCER), first["producer"]).alias("producer"), first["source_uri"].alias("source_uri"), many(F.col("bucket").cast("int"), first["source_index"]).alias("source_index"),
        many(F.lit(fixed.EXPOSURE_METHOD), first["extraction_method"]).alias("extraction_method"), many(each("unit_id"), none).alias("source_unit_ids"), many(each("producer"), none).alias("source_producers"), F.forall(each("eligible"), lambda x: F.coalesce(x, F.lit(False))).alias("eligible"), *[F.array_min(each(c)).alias(c) for c in own],
    )
    return without_scores(out)


def text_exposure(units: DataFrame, n: int = TEXTS) -> DataFrame:
    """A case's n best text units, restored in time (unknown times last, then by id), numbered from 0.

    Best by confidence (null: -1), then detections (raw_count, else accepted_count, else
    0), then frame_rank (else source_index, else 0), then the given order.
    """
    if n <= 0:
        raise ValueError("exposure limits must be positive")
    opt = lambda c: F.col(c) if c in units.columns else F.lit(None).cast("int")
    best = [F.coalesce("confidence", F.lit(-1.0)).desc(), F.coalesce(opt("raw_count"), opt("accepted_count"), F.lit(0)).desc(), F.coalesce(opt("frame_rank"), opt("source_index"), F.lit(0)).asc(), F.asc("ordinal")]
    top = top_then_restore(units, n, best, [F.col("start_time").asc_nulls_last(), F.asc("unit_id")])
    return without_scores(top)


def exposure(transcripts: DataFrame, texts: DataFrame, groups: int = TRANSCRIPTS, n: int = TEXTS) -> DataFrame:
    """case_id, position and SHOWN: transcript exposure, then text exposure."""
    a = transcript_exposure(transcripts, groups).withColumn("part", F.lit(0))
    b = text_exposure(texts, n).withColumn("part", F.lit(1))
    out = a.unionByName(b, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("part", "ordinal")) - 1
    none = F.array().cast("array<string>")
    keep = [F.coalesce(c, none).alias(c) if c.startswith("source_unit") or c == "source_producers" else F.col(c) for c in out.columns if c not in ("part", "ordinal", "bucket")]
    return out.withColumn("position", place).select("position", *keep)


def composed(shown: DataFrame, visual: DataFrame) -> DataFrame:
    """All evidence of a case: what is shown to the scorer, then its visual units; `shown` tells them apart."""
    both = shown.withColumn("shown", F.lit(True)).unionByName(visual.withColumns({"shown": F.lit(False), "position": F.col("ordinal")}).drop("ordinal"), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("shown"), "position")) - 1
    return both.withColumn("position", place)


def composed_failure(size: int = TRANSCRIPTS + TEXTS) -> Column:
    """The first thing wrong with a case's composed evidence (see composed), on each of its rows; null where nothing is.

    Ids must be unique where something is shown, for the scorer's answer comes by them.
    """
    case = Window.partitionBy("case_id")
    opt = lambda c: F.coalesce(F.col(c), F.lit(False))
    visual = F.col("source_type") == fixed.VISUAL
    scored = F.col("selection_score").isNotNull() | F.col("fake").isNotNull() | F.col("real").isNotNull()
    odd = ~F.col("shown") & (~visual | opt("eligible") | scored | F.col("confidence").isNotNull())
    any_ = lambda c: F.max(c).over(case)
    ids = F.collect_list("unit_id").over(case)
    twice = any_(F.col("shown")) & (F.size(F.array_distinct(ids)) < F.size(ids))
    wrong = F.when(any_(F.col("shown") & visual), "visual_in_exposure").when(any_(odd), "invalid_visual_unit").when(F.sum(F.col("shown").cast("int")).over(case) > size, "exposure_too_large")
    return F.coalesce(quarantine.failure("composition", wrong), quarantine.failure("scorer", F.when(twice, "duplicate_unit_id")))
