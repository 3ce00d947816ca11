"""Replies of a speech recogniser, normalised inside their own row, and runs made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from .units import transcript_units

SEGMENT = "struct<text:string,start_time:double,end_time:double>"
NUMBERS = "\\A(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _spoken(holder: Column) -> Column:
    """The stripped text of an object: "" where it is absent; what is no string is spelt out (null as None, lists and objects as JSON)."""
    v = F.try_variant_get(holder, "$.text", "variant")
    kind = F.schema_of_variant(v)
    plain = F.try_variant_get(v, "$", "string")
    said = F.when(v.isNull(), "").when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(plain)).otherwise(F.coalesce(plain, F.to_json(v)))
    return T.strip(said)


def _pair(v: Column) -> tuple[Column, Column, Column]:
    """violation, start, end of a timestamp: null, or a list of two numbers or nulls, none negative, the end not before the start."""
    items = F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    at = lambda i: F.get(items, F.lit(i))
    number = lambda x: F.try_variant_get(x, "$", "double")
    void = _kind(v) == "VOID"

    def fault(x: Column) -> Column:
        value = number(x)
        good = F.coalesce(~F.isnan(value) & (value >= 0) & (value < float("inf")), F.lit(False))
        return F.when(_kind(x) == "VOID", None).when(~_kind(x).rlike(NUMBERS), "timestamp_not_numeric").when(~good, "timestamp_not_finite_and_nonnegative")

    start, end = number(at(0)), number(at(1))
    wrong = F.when(void, None).when(items.isNull() | (F.size(items) != 2), "timestamp_not_a_pair").otherwise(F.coalesce(fault(at(0)), fault(at(1)), F.when(end < start, "end_before_start")))
    return wrong, F.when(wrong.isNull() & ~void, start), F.when(wrong.isNull() & ~void, end)


def normalized(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """replies with segments (text, start_time, end_time, in order) and violation, the first thing wrong; one of them is null.

    A reply is {text, chunks: [{text, timestamp: [start, end]}]} as JSON. Without
    chunks (absent or null) its whole text is one segment without times. Blank chunks
    are dropped unread. A known start may not lie before the last known start, an
    end not before the last known end; unknown times are passed over. The chunks of a
    reply are walked once, with the last known times and the first violation as
    state, so nothing is exploded, sorted or shuffled. What is no JSON is a violation.
    """
    v = F.try_parse_json(F.col(raw))
    rows = replies.withColumn("__v", v).withColumn("__kind", _kind(F.col("__v"))).withColumn("__chunks", F.try_variant_get("__v", "$.chunks", "variant"))
    chunks, text = F.col("__chunks"), _spoken(F.col("__v"))
    bare = _kind(chunks) == "VOID"

    def one(c: Column) -> Column:
        wrong, start, end = _pair(F.try_variant_get(c, "$.timestamp", "variant"))
        there = _kind(c).startswith("OBJECT")
        return F.struct(_spoken(c).alias("text"), start.alias("start_time"), end.alias("end_time"), F.when(~there, "chunk_not_an_object").otherwise(wrong).alias("wrong"), there.alias("there"))

    listed = F.filter(F.transform(F.try_variant_get(chunks, "$", "array<variant>"), one), lambda x: ~x["there"] | (x["text"] != ""))
    rows = rows.withColumn("__listed", listed)
    state = "struct<start:double,end:double,wrong:string>"
    none = F.struct(F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("string").alias("wrong")).cast(state)

    def step(s: Column, x: Column) -> Column:
        back = F.when(x["start_time"] < s["start"], "start_not_monotonic").when(x["end_time"] < s["end"], "end_not_monotonic")
        return F.struct(F.coalesce(x["start_time"], s["start"]).alias("start"), F.coalesce(x["end_time"], s["end"]).alias("end"), F.coalesce(s["wrong"], x["wrong"], back).alias("wrong")).cast(state)

    walked = F.aggregate("__listed", none, step, lambda s: s["wrong"])
    wrong = (
        F.when(F.col("__v").isNull(), "not_json").when(~F.col("__kind").startswith("OBJECT"), "output_not_an_object").when(bare, None)
        .when(~_kind(chunks).startswith("ARRAY"), "chunks_not_a_list").otherwise(walked)
    )
    only = F.when(text == "", F.array()).otherwise(F.array(F.struct(text.alias("text"), F.lit(None).cast("double").alias("start_time"), F.lit(None).cast("double").alias("end_time"))))
    plain = F.transform("__listed", lambda x: F.struct(x["text"].alias("text"), x["start_time"].alias("start_time"), x["end_time"].alias("end_time")))
    found = F.when(bare, only.cast(f"array<{SEGMENT}>")).otherwise(plain.cast(f"array<{SEGMENT}>"))
    rows = rows.withColumn("violation", wrong)
    return rows.withColumn("segments", F.when(F.col("violation").isNull(), found)).drop("__v", "__kind", "__chunks", "__listed")


def units_of(normal: DataFrame) -> DataFrame:
    """Units of the segments of accepted replies (case_id, segments, optional path), in their order."""
    path = F.col("path") if "path" in normal.columns else F.lit(None).cast("string")
    rows = normal.filter(F.col("violation").isNull()).select("case_id", path.alias("source_uri"), F.posexplode("segments").alias("ordinal", "s"))
    return transcript_units(rows.select("case_id", "source_uri", "ordinal", F.col("ordinal").alias("segment_index"), "s.*"))


def runs(normal: DataFrame) -> DataFrame:
    """A row a case: its joined text, segments, metadata of its sound, warnings, and the fixed insufficiency result where it has no segment.

    normal: case_id, session_id, claim, path, file_size_bytes, sample_count, sample_rate
    beside what normalized gives. A case whose ids are blank or whose reply has a violation
    has only its violation. Duration is samples by rate.
    """
    blank = lambda c: T.is_blank(F.col(c))
    wrong = F.when(blank("session_id"), "session_id").when(blank("claim"), "claim").when(F.col("sample_rate") <= 0, "sample_rate").otherwise(F.col("violation"))
    ok = wrong.isNull()
    empty = F.size("segments") == 0
    metadata = F.struct("path", F.col("file_size_bytes").cast("long").alias("file_size_bytes"), (F.col("sample_count") / F.col("sample_rate")).alias("audio_duration_seconds"), F.col("sample_rate").cast("int").alias("audio_sample_rate"), F.col("sample_count").cast("long").alias("audio_sample_count"))
    result = F.struct(F.lit("not_run").alias("model_verdict"), F.lit(fixed.DISPLAY["not_run"]).alias("display_verdict"), F.lit("insufficient").alias("evidence_status"))
    said = F.when(empty, F.array(F.lit(fixed.NO_TRANSCRIPT))).otherwise(F.array().cast("array<string>"))
    return normal.select(
        "case_id", "session_id", wrong.alias("violation"), F.when(ok, F.array_join(F.transform("segments", lambda s: s["text"]), " ")).alias("asr_text"), F.when(ok, F.size("segments")).alias("n_segments"),
        F.when(ok, metadata).alias("metadata"), F.when(ok, said).alias("warnings"), F.when(ok & empty, result).alias("result"),
    )
