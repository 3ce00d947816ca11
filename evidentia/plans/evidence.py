"""Queries of documents' bytes, failing cases, recognisers' replies and stores, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import canonical
from ..operators import cases, claims, manifests, means, replies, retrieve, rules, signals, stages, units
from ..sources import records, store
from ..streaming import stages as stage_streams
from .registry import registered, table

STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"

# ---------------------------------------------------------------- canonical JSON


def sql_quoted(x: str) -> str:
    """SQL of the canonical JSON string of x."""
    x = rf"""replace(replace({x}, '\', '\\'), '"', '\"')"""
    for i in range(1, 32):
        x = f"replace({x}, chr({i}), '{canonical.SHORT.get(chr(i), rf'\u{i:04x}')}')"
    return f"""'"' || {x} || '"'"""


# powers of ten from 1e-20 to 1e19, and both zeros, so that every notation occurs
SPREAD = "CASE WHEN event_id % 97 = 0 THEN -(value - value) ELSE value * CAST('1e' || (event_id % 40 - 20) AS DOUBLE) END"


@registered(f"SELECT event_id, '[' || CAST(x AS VARCHAR) || ',' || CAST(-x AS VARCHAR) || ']' AS document FROM (SELECT event_id, {SPREAD} AS x FROM events)")
def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles of all sizes in their shortest spelling."""
    e = table(spark, sf_dir, "events")
    x = F.when(F.col("event_id") % 97 == 0, -(F.col("value") - F.col("value"))).otherwise(F.col("value") * F.concat(F.lit("1e"), (F.col("event_id") % 40 - 20).cast("string")).cast("double"))
    return canonical.with_document(e.select("event_id", x.alias("x")), "document", F.array("x", -F.col("x"))).select("event_id", "document")


# every control character and both escapes occur
ODD_TEXT = "chr(CAST(1 + turn * 5 % 31 AS INT)) || '\"\\' || text"


@registered(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, regexp_replace(" + ODD_TEXT + r""", '^[\x09-\x0d\x1c-\x20]+|[\x09-\x0d\x1c-\x20]+$', '', 'g') AS x FROM conversations) """
    f"""SELECT conv_id AS case_id, '{{"claim":"case ' || conv_id || '","session_id":"session-' || conv_id || '","units":[' || string_agg('{{"bbox":null,"confidence":null,"eligible_for_frozen_g1":true,"end_time":' || CAST(CAST(turn AS DOUBLE) * 1e16 AS VARCHAR) || ',"frame_id":null,"frame_path":null,"logits":null,"producer":"{fixed.WHISPER[0]}","provenance":{{"details":{{"frozen_revision":"{fixed.WHISPER[1]}","model_id":"{fixed.WHISPER[0]}"}},"extraction_method":"whisper_asr","source_index":' || n || ',"source_uri":null}},"selection_score":null,"source_type":"transcript","start_time":' || CAST(CAST(turn AS DOUBLE) * 1e-6 AS VARCHAR) || ',"text":' || {sql_quoted("x")} || ',"unit_id":"asr_' || lpad(CAST(n AS VARCHAR), 4, '0') || '"}}', ',' ORDER BY n) || ']}}' AS document FROM r GROUP BY conv_id"""
)
def unit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's units as a payload, byte for byte, after reading it and writing it again."""
    t = table(spark, sf_dir, "conversations")
    text = F.concat(F.char(1 + F.col("turn") * 5 % 31), F.lit('"\\'), "text")
    rows = units.transcript_units(t.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("ordinal"), text.alias("text"), (F.col("turn") * F.lit(1e-6)).alias("start_time"), (F.col("turn") * F.lit(1e16)).alias("end_time")))
    c = t.select(F.col("conv_id").alias("case_id")).distinct()
    c = c.select("case_id", F.concat(F.lit("session-"), F.col("case_id").cast("string")).alias("session_id"), F.concat(F.lit("case "), F.col("case_id").cast("string")).alias("claim"))
    written = records.payloads(c, rows)
    read = records.units_of(written.select("document"), "document")
    again = records.payloads(read.select(F.col("case_id").alias("session_id"), "claim").distinct().withColumn("case_id", F.col("session_id")), read)
    return again.select(F.substring_index("session_id", "-", -1).cast("long").alias("case_id"), "document")


# ---------------------------------------------------------------- cases that fail alone

FAILED = (
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations), "
    r"t AS (SELECT conv_id, n, CASE WHEN (conv_id * 7 + turn * 3) % 131 = 5 THEN '' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS text, role = 'system' AND conv_id % 4 = 1 AS other, (conv_id + turn) % 137 = 9 AS barred FROM r), "
    "o AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 2 AND turn = 1 THEN 'asr_0000' ELSE 'ocr_' || turn END AS unit_id, text FROM conversations WHERE role = 'assistant'), "
    "s AS (SELECT conv_id, 'asr_' || lpad(CAST(n AS VARCHAR), 4, '0') AS unit_id, text FROM t UNION ALL SELECT conv_id, unit_id, text FROM o), "
    "m AS (SELECT conv_id, count(*) - count(DISTINCT unit_id) AS twice, bool_or(length(text) % 241 = 7) AS error, max(length(text) * 7 % 101) AS fake, max(length(text) * 13 % 103) AS real, count(*) AS shown FROM s GROUP BY conv_id), "
    "g AS (SELECT conv_id, bool_or(text = '') AS blank, arg_min(CASE WHEN other THEN 'transcript_exposure_accepts_only_transcript_units' ELSE 'transcript_exposure_units_must_be_eligible' END, n) FILTER (WHERE other OR barred) AS guard FROM t GROUP BY conv_id), "
    "w AS (SELECT conv_id, CASE WHEN conv_id % 17 = 3 THEN 'request' WHEN blank THEN 'transcripts' WHEN guard IS NOT NULL THEN 'transcript_exposure' WHEN conv_id % 21 = 6 THEN 'visual' WHEN twice > 0 OR error THEN 'scorer' END AS stage, "
    "CASE WHEN conv_id % 17 = 3 THEN 'session_id' WHEN blank THEN 'blank_transcript' WHEN guard IS NOT NULL THEN guard WHEN conv_id % 21 = 6 THEN 'unknown_frame' WHEN twice > 0 THEN 'duplicate_unit_id' WHEN error THEN 'model_error' END AS violation, twice > 0 AS dup, fake, real, shown FROM g JOIN m USING (conv_id)) "
    "SELECT conv_id AS case_id, CASE WHEN stage IS NULL THEN 'success' ELSE 'failure' END AS status, CASE WHEN stage IS NOT NULL THEN 'runtime_execution_failed' END AS code, stage, violation, CASE WHEN violation = 'model_error' THEN 'ArithmeticError' WHEN stage IS NOT NULL THEN 'ValueError' END AS exception_type, "
    "CASE WHEN stage IS NULL THEN CASE WHEN fake >= real THEN 'Fake' ELSE 'Real' END END AS display_verdict, CASE WHEN stage IS NULL THEN shown END AS exposed, CASE WHEN stage IS NULL THEN CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END END AS visual FROM w"
)


def length_model() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """A model that raises on some texts: scores from lengths, as a stand-in that can fail."""

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(t) for t in b["text"].to_pylist()]
        if any(x % 241 == 7 for x in n):
            raise ArithmeticError("a text of a bad length")
        return pa.RecordBatch.from_pydict({"selection_score": [x % 100 / 100 for x in n], "fake": [x * 7 % 101 / 1 for x in n], "real": [x * 13 % 103 / 1 for x in n]})

    return score


@registered(FAILED)
def failed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a case, with blank, barred and misplaced transcripts, ids that come twice, broken visual units and a model that raises: each fails its own case."""
    t = table(spark, sf_dir, "conversations").withColumn("case_id", F.col("conv_id"))
    c = t.select("case_id").distinct()
    c = c.select("case_id", F.when(F.col("case_id") % 17 == 3, "bad id").otherwise(F.concat(F.lit("session-"), F.col("case_id").cast("string"))).alias("session_id"), F.concat(F.lit("case "), F.col("case_id").cast("string")).alias("claim"))
    said = F.when((F.col("conv_id") * 7 + F.col("turn") * 3) % 131 == 5, " \n").otherwise(F.col("text"))
    spoken = units.transcript_units(t.select("case_id", F.col("turn").alias("ordinal"), said.alias("text"), "turn", "role"), keep=("turn", "role"))
    spoken = spoken.withColumns({"eligible": F.col("eligible") & ((F.col("case_id") + F.col("turn")) % 137 != 9), "source_type": F.when((F.col("role") == "system") & (F.col("case_id") % 4 == 1), fixed.TEXT).otherwise(F.col("source_type"))}).drop("turn", "role")
    name = F.when((F.col("case_id") % 11 == 2) & (F.col("turn") == 1), "asr_0000").otherwise(F.concat(F.lit("ocr_"), F.col("turn").cast("string")))
    read = t.filter("role = 'assistant'").select(
        "case_id", F.col("turn").alias("ordinal"), name.alias("unit_id"), F.lit(fixed.OCR).alias("source_type"), "text", F.col("turn").cast("double").alias("start_time"), F.col("turn").cast("double").alias("end_time"), F.lit(0.9).alias("confidence"),
        F.lit(fixed.OCR_PRODUCER).alias("producer"), F.col("turn").cast("int").alias("source_index"), F.lit("paddleocr_v5_frame").alias("extraction_method"), F.lit(True).alias("eligible"),
    )
    none = F.lit(None).cast("double")
    seen = c.filter("case_id % 3 = 0").select(
        "case_id", F.lit(0).cast("long").alias("ordinal"), F.lit("visual_0").alias("unit_id"), F.lit(fixed.VISUAL).alias("source_type"), F.lit("a red car").alias("text"), none.alias("start_time"), none.alias("end_time"), none.alias("confidence"),
        F.lit(False).alias("eligible"), none.alias("selection_score"), none.alias("fake"), none.alias("real"), F.when(F.col("case_id") % 21 == 6, F.array(F.lit("unknown_frame"))).otherwise(F.array().cast("array<string>")).alias("violations"),
    )
    v = cases.verified(c, spoken, read, seen, stages.scorer(length_model))
    at = lambda path, kind="string": F.get_json_object("outcome", f"$.{path}").cast(kind)
    return v.select(
        "case_id", at("status").alias("status"), at("failure.code").alias("code"), "failure.stage", "failure.violation", at("failure.exception_type").alias("exception_type"), at("result.verdict.display_verdict").alias("display_verdict"),
        at("result.sufficiency.g1_exposure_count", "long").alias("exposed"), at("result.sufficiency.visual_unit_count", "long").alias("visual"),
    )


# ---------------------------------------------------------------- recognisers' replies

# faults by conversation: what stands in one of its chunks, or in the place of the chunks
REPLY_STARTS = "CASE WHEN k = 4 AND turn = 2 THEN 0.25 WHEN k = 5 THEN NULL WHEN k = 8 AND turn = 1 THEN -1.0 ELSE turn * 1.5 END"
REPLY_ENDS = "CASE WHEN k = 3 AND turn = 1 THEN 0.5 WHEN k = 5 AND turn = 1 THEN 0.125 ELSE turn * 1.5 + 1.0 END"
REPLIES = (
    f"WITH t AS (SELECT conv_id, conv_id % 13 AS k, turn, (conv_id + turn) % 5 = 0 AS blank, {STRIP} AS text, CAST({REPLY_STARTS} AS DOUBLE) AS s, CAST({REPLY_ENDS} AS DOUBLE) AS e FROM (SELECT *, conv_id % 13 AS k FROM conversations)), "
    "n AS (SELECT *, last_value(CASE WHEN k <> 6 THEN s END IGNORE NULLS) OVER w AS ls, last_value(CASE WHEN k <> 6 THEN e END IGNORE NULLS) OVER w AS le FROM t WHERE NOT blank OR (k = 9 AND turn = 1) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "v AS (SELECT *, CASE WHEN k = 9 AND turn = 1 THEN 'chunk_not_an_object' WHEN k = 6 THEN NULL WHEN k = 2 AND turn = 1 THEN 'timestamp_not_a_pair' WHEN k = 1 AND turn = 1 THEN 'timestamp_not_numeric' WHEN s < 0 THEN 'timestamp_not_finite_and_nonnegative' WHEN e < s THEN 'end_before_start' WHEN s < ls THEN 'start_not_monotonic' WHEN e < le THEN 'end_not_monotonic' END AS bad FROM n), "
    "f AS (SELECT c.conv_id, c.conv_id % 13 AS k, arg_min(bad, turn) FILTER (WHERE bad IS NOT NULL) AS bad, count(v.conv_id) AS n, coalesce(string_agg(text, ' ' ORDER BY turn), '') AS words, max(e) AS last_end FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN v USING (conv_id) GROUP BY c.conv_id), "
    "a AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS whole FROM t GROUP BY conv_id), "
    "r AS (SELECT conv_id, CASE WHEN k = 10 THEN 'chunks_not_a_list' WHEN k = 12 THEN 'output_not_an_object' WHEN k NOT IN (7, 11) THEN bad END AS violation, CASE WHEN k = 7 THEN whole WHEN k = 11 THEN '' ELSE words END AS words, CASE WHEN k = 7 THEN 1 WHEN k = 11 THEN 0 ELSE n END AS n, CASE WHEN k NOT IN (6, 7) THEN last_end END AS last_end FROM f JOIN a USING (conv_id)) "
    "SELECT conv_id AS case_id, violation, CASE WHEN violation IS NULL THEN words END AS asr_text, CASE WHEN violation IS NULL THEN n END AS n_segments, CASE WHEN violation IS NULL THEN (conv_id * 800 + 8000) / 16000.0::DOUBLE END AS seconds, CASE WHEN violation IS NULL THEN CASE WHEN n = 0 THEN 'NEI' ELSE '' END END AS shown FROM r"
)


@registered(REPLIES)
def recogniser_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a recogniser's reply with faults of many kinds, normalised and run."""
    t = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") % 13)
    k, turn = F.col("k"), F.col("turn")
    start = F.when((k == 4) & (turn == 2), 0.25).when(k == 5, None).when((k == 8) & (turn == 1), -1.0).otherwise(turn * 1.5)
    end = F.when((k == 3) & (turn == 1), 0.5).when((k == 5) & (turn == 1), 0.125).otherwise(turn * 1.5 + 1.0)
    spelt = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    stamp = F.when((k == 1) & (turn == 1), "[true,1]").when((k == 2) & (turn == 1), "[0,1,2]").when(k == 6, "null").otherwise(F.concat(F.lit("["), spelt(start), F.lit(","), spelt(end), F.lit("]")))
    said = F.when((F.col("conv_id") + turn) % 5 == 0, F.lit("\n ")).otherwise(F.concat(F.lit(" "), "text", F.lit("\t")))
    chunk = F.when((k == 9) & (turn == 1), "5").otherwise(F.concat(F.lit('{"text":'), canonical.quoted(said), F.lit(',"timestamp":'), stamp, F.lit("}")))
    per = t.groupBy("conv_id", "k").agg(F.array_sort(F.collect_list(F.struct("turn", chunk.alias("chunk"), "text"))).alias("c"))
    chunks = F.concat(F.lit("["), F.array_join(F.transform("c", lambda x: x["chunk"]), ","), F.lit("]"))
    whole = canonical.quoted(F.array_join(F.transform("c", lambda x: F.trim(x["text"])), " "))
    raw = (
        F.when(k == 7, F.concat(F.lit('{"text":'), whole, F.lit("}"))).when(k == 11, '{"text":" ","chunks":null}').when(k == 10, '{"chunks":{}}').when(k == 12, chunks)
        .otherwise(F.concat(F.lit('{"text":"","chunks":'), chunks, F.lit("}")))
    )
    case = per.select(F.col("conv_id").alias("case_id"), F.lit("s").alias("session_id"), F.lit("c").alias("claim"), raw.alias("raw"), F.lit("/v").alias("path"), F.lit(1).alias("file_size_bytes"), (F.col("conv_id") * 800 + 8000).alias("sample_count"), F.lit(16000).alias("sample_rate"))
    r = replies.runs(replies.normalized(case))
    return r.select("case_id", "violation", "asr_text", "n_segments", F.col("metadata.audio_duration_seconds").alias("seconds"), F.when(F.col("violation").isNull(), F.coalesce("result.display_verdict", F.lit(""))).alias("shown"))


# ---------------------------------------------------------------- exact means

# values are multiples of 2**-59 and below 2**20: their sum is a whole number, the quotient is rounded once, with a sticky bit
SHIFTS = " ".join(f"WHEN s < n * CAST({1 << (59 + k + 1)} AS HUGEINT) THEN {k}" for k in range(-8, 20))
EXACT = (
    "WITH v AS (SELECT user_id, event_type, CAST(value * CAST(576460752303423488 AS DOUBLE) AS HUGEINT) AS m FROM events), "
    "g AS (SELECT user_id, event_type, sum(m)::HUGEINT AS s, count(*)::HUGEINT AS n FROM v GROUP BY ALL), "
    f"k AS (SELECT *, CASE {SHIFTS} END AS b FROM g), "
    # the quotient s / n by 2**(b - 1), so that it has 60 or 61 bits
    "q AS (SELECT *, CASE WHEN b >= 1 THEN s // (n * (1::HUGEINT << (b - 1)::INT)) ELSE (s << (1 - b)::INT) // n END AS t, CASE WHEN b >= 1 THEN s % (n * (1::HUGEINT << (b - 1)::INT)) ELSE (s << (1 - b)::INT) % n END AS r FROM k) "
    "SELECT user_id, event_type, CAST(CAST(CASE WHEN r > 0 AND t % 2 = 0 THEN t + 1 ELSE t END AS BIGINT) AS DOUBLE) * power(2.0::DOUBLE, b - 60) AS mean, CAST(n AS BIGINT) AS n FROM q"
)


@registered(EXACT)
def exact_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means that are right to the last bit, however the rows are split."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    m = means.exact_means(e, ["user_id", "event_type"], "value")
    return m.select("user_id", "event_type", "mean", "n")


# ---------------------------------------------------------------- many claims against many frames

FRAME_TIME = "CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST(vec_id % 10 AS DOUBLE) END"


@registered(
    f"WITH f AS (SELECT label AS case_id, vec_id AS frame_index, {FRAME_TIME} AS ts, 'f' || vec_id % 3 AS path, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT label AS case_id, vec_id AS claim_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0), "
    "p AS (SELECT c.case_id, claim_id, frame_index, ts, path, round(list_cosine_similarity(c.e, f.e), 9) AS score FROM c JOIN f USING (case_id)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY case_id, claim_id ORDER BY score DESC, ts NULLS LAST, frame_index, path) AS retrieval_rank FROM p) "
    "SELECT case_id, claim_id, retrieval_rank, row_number() OVER (PARTITION BY case_id, claim_id ORDER BY ts NULLS LAST, frame_index, path) - 1 AS ordinal, frame_index, round(score, 6) AS score FROM r WHERE retrieval_rank <= 4"
)
def claims_against_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 as a claim, against all vectors of its label."""
    e = table(spark, sf_dir, "embeddings").withColumn("case_id", F.col("label"))
    claims = e.filter("vec_id % 20 = 0").select("case_id", F.col("vec_id").alias("claim_id"), "embedding")
    frames = e.select("case_id", F.col("vec_id").alias("frame_index"), F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") % 10).cast("double")).alias("timestamp"), F.concat(F.lit("f"), (F.col("vec_id") % 3).cast("string")).alias("frame_path"), "embedding")
    r = retrieve.retrieved_for_claims(claims, frames)
    return r.select("case_id", "claim_id", F.col("retrieval_rank").cast("long").alias("retrieval_rank"), F.col("ordinal").cast("long").alias("ordinal"), "frame_index", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- stores and manifests


@registered(
    "SELECT source AS \"group\", count(*) AS n_files, sha256('[' || string_agg('{\"path\":\"' || doc_id % 7 || '/' || doc_id || '.txt\",\"sha256\":\"' || sha256(text) || '\",\"size\":' || strlen(text) || '}', ',' ORDER BY doc_id % 7 || '/' || doc_id || '.txt') || ']') AS manifest_sha256 FROM documents GROUP BY source"
)
def source_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents as the files of a tree, under one digest."""
    d = table(spark, sf_dir, "documents")
    path = F.concat((F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return manifests.manifest_digests(d.select(F.col("source").alias("group"), path.alias("path"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256")))


@registered(
    "SELECT 'turn-' || conv_id || '-' || turn AS key, sha256(CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN 'second ' || text ELSE text END) AS value_sha256 FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 1) OR (conv_id % 3 = 0 AND turn % 2 = 0)"
)
def keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as documents by key: all are put, some replaced, some removed, and one batch comes twice."""
    t = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key")
    s = store.Store(spark, f"{store.scratch(spark)}/keyed-{uuid.uuid4().hex}", 16)
    s.commit(t.select(key, F.col("text").alias("value")), "turns", 1)
    s.commit(t.filter("conv_id % 5 = 0 and turn = 1").select(key, F.lit(None).cast("string").alias("value")), "turns", 2)
    s.commit(t.filter("conv_id % 3 = 0 and turn % 2 = 0").select(key, F.concat(F.lit("second "), "text").alias("value")), "turns", 3)
    s.commit(t.select(key, F.lit("late").alias("value")), "turns", 1)
    return s.read().select("key", F.sha2("value", 256).alias("value_sha256"))


# ---------------------------------------------------------------- stages as a stream

STAGE_LIST = "[" + ",".join(f"'{x}'" for x in fixed.STAGES) + "]"


@registered(
    f"WITH e AS (SELECT event_id // 27 AS case_id, event_id AS n, CAST(event_id % 27 // 3 + 1 AS INT) AS seq, CASE WHEN event_id % 101 = 0 THEN 'other' ELSE {STAGE_LIST}[CAST(event_id % 27 // 3 + 1 AS INT)] END AS name, CASE WHEN event_type = 'error' AND event_id % 13 = 0 THEN 'failed' ELSE ['pending','running','completed'][CAST(event_id % 3 AS INT) + 1] END AS status FROM events WHERE event_id % 89 <> 0), "
    f"t AS (SELECT case_id, seq, bool_or(name <> {STAGE_LIST}[seq]) AS named, list(status ORDER BY n) AS st FROM e GROUP BY case_id, seq), "
    "m AS (SELECT case_id, seq, named, st[1] <> 'pending' OR len(list_filter(range(1, len(st)), lambda i: NOT ((st[i] = 'pending' AND st[i + 1] IN ('running', 'skipped')) OR (st[i] = 'running' AND st[i + 1] IN ('completed', 'failed'))))) > 0 AS moved, seq = 9 AND st[-1] IN ('completed', 'skipped') AS done, len(st) AS k FROM t) "
    "SELECT case_id, concat_ws(',', CASE WHEN bool_or(named) OR count(*) <> max(seq) THEN 'stage_order' END, CASE WHEN bool_or(moved) THEN 'stage_transition' END) AS violations, CAST(sum(k) AS BIGINT) AS n_events, bool_or(done) AS completed FROM m GROUP BY case_id"
)
def streamed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stages of cases, 27 a case, read as a stream; the last row of each case."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 4)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    rows = e.parquet(f"{sf_dir}/events.parquet") if folder else e.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    i = F.col("event_id")
    sequence = F.floor(i % 27 / 3) + 1
    name = F.when(i % 101 == 0, "other").otherwise(F.element_at(F.array(*map(F.lit, fixed.STAGES)), sequence.cast("int")))
    status = F.when((F.col("event_type") == "error") & (i % 13 == 0), "failed").otherwise(F.element_at(F.array(*map(F.lit, ("pending", "running", "completed"))), (i % 3 + 1).cast("int")))
    rows = rows.filter(i % 89 != 0).select(F.floor(i / 27).alias("case_id"), i.alias("event_no"), sequence.alias("sequence"), name.alias("name"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    at = f"{store.scratch(spark)}/stages-{uuid.uuid4().hex}"
    each = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{at}/rows/epoch={epoch}")
    stream = stage_streams.stage_stream(rows.withWatermark("ts", "10000 days"))
    stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(f"case_id bigint, {stage_streams.OUTPUT}, epoch int").parquet(f"{at}/rows")
    last = out.groupBy("case_id").agg(F.max_by(F.struct("violations", "n_events", "completed"), "epoch").alias("x"))
    return last.select("case_id", F.array_join("x.violations", ",").alias("violations"), F.col("x.n_events").cast("long").alias("n_events"), "x.completed")


# ---------------------------------------------------------------- closed documents by rules


@registered(
    "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '$.siglip:unknown_fields' WHEN event_id % 13 = 0 THEN '$.qwen:missing_fields' WHEN event_id % 4 = 3 AND event_type <> 'view' THEN '$.whisper.dtype:not_one_of' WHEN event_id % 7 = 0 THEN '$.ocr.device:not_a_nonblank_string' "
    "WHEN value - 5 <= 0 THEN '$.ocr.timeout_seconds:not_above_0' WHEN event_id % 19 = 0 THEN '$.frozen_g1.timeout_seconds:not_above_0' WHEN event_id % 17 = 0 THEN '$.schema_version:not_equal' WHEN event_type = 'error' THEN '$.profile:not_equal' WHEN event_id % 5 = 0 THEN '$:roots_not_distinct' ELSE 'ok' END AS first_violation FROM events"
)
def settings_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a run a event, with faults of many kinds; the first rule that is broken."""
    e = table(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    pick = lambda c, a, b: F.when(c, a).otherwise(b)
    dtype = F.when(i % 4 == 3, pick(kind == "view", "float16", "int8")).otherwise(F.element_at(F.array(*map(F.lit, ("float16", "float32", "bfloat16"))), (i % 4 + 1).cast("int") % 3 + 1))
    parts = (
        '{"cache_root":"a/b","output_root":"', pick(i % 5 == 0, "x/../a/./b", "out"), '","whisper":{"model_path":"m","device":"cpu","dtype":"', dtype, '"},"ocr":{"detector_model_path":"d","recognizer_model_path":"r","cudnn8_library_path":"c","python_executable":"p","device":"',
        pick(i % 7 == 0, " ", "gpu:0"), '","timeout_seconds":', (F.col("value") - 5).cast("string"), '},"siglip":{"model_path":"m","device":"cpu"', pick(i % 11 == 0, ',"more":1', ""), '},"qwen":{"model_path":"m"', pick(i % 13 == 0, "", ',"device":"cpu"'),
        '},"frozen_g1":{"unirumor_root":"u","phase4a_infer":"i","phase4a_config":"c","python_executable":"p","device":"cpu","timeout_seconds":', pick(i % 19 == 0, "true", "300"), '},"schema_version":', pick(i % 17 == 0, "true", "1"), ',"profile":"', pick(kind == "error", "test", "production"), '"}',
    )
    d = e.select("event_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("document"))
    return rules.settings(d, "/base").select("event_id", F.coalesce(F.get("violations", F.lit(0)), F.lit("ok")).alias("first_violation"))


@registered(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations), "
    "g AS (SELECT conv_id, max(k) AS k, arg_min(CASE WHEN length(text) % 50 = 3 THEN '$.frames[].timestamp_sec:mismatch' ELSE '$.frames[].frame_id:mismatch' END, n) FILTER (WHERE length(text) % 50 IN (3, 4)) AS moved FROM r GROUP BY conv_id) "
    "SELECT conv_id AS case_id, CASE WHEN conv_id % 10 = 1 THEN '$.status:not_equal' WHEN conv_id % 12 = 5 THEN '$.session_id:mismatch' WHEN conv_id % 9 = 4 THEN '$.frames:not_as_many' WHEN moved IS NOT NULL THEN moved ELSE 'ok' END AS first_violation FROM g"
)
def recogniser_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a text recogniser against the frames that were asked for, a conversation's turns being its frames."""
    t = table(spark, sf_dir, "conversations")
    n, turn = F.length("text") % 50, F.col("turn")
    asked = F.struct(turn.alias("frame_rank"), (turn * 25).alias("frame_index"), (turn / 2).alias("timestamp_sec"), F.concat(F.lit("F"), turn.cast("string")).alias("frame_id"), F.concat(F.lit("/f/"), turn.cast("string")).alias("frame_path"))
    back = F.struct(turn.alias("frame_rank"), (turn * 25).alias("frame_index"), (turn / 2 + F.when(n == 3, 0.25).otherwise(0.0)).alias("timestamp_sec"), F.concat(F.when(n == 4, "G").otherwise("F"), turn.cast("string")).alias("frame_id"), F.concat(F.lit("/f/"), turn.cast("string")).alias("frame_path"))
    per = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(asked)).alias("requested"), F.array_sort(F.collect_list(back)).alias("frames"))
    i = F.col("conv_id")
    frames = F.when(i % 9 == 4, F.slice("frames", F.lit(1), F.size("frames") - 1)).otherwise(F.col("frames"))
    name = F.concat(F.lit("s"), i.cast("string"))
    reply = F.struct(F.lit(1).alias("schema_version"), F.when(i % 10 == 1, "failed").otherwise("ok").alias("status"), F.when(i % 12 == 5, "other").otherwise(name).alias("session_id"), F.struct(F.lit("d").alias("detector")).alias("models"), frames.alias("frames"))
    d = per.select(i.alias("case_id"), name.alias("session_id"), "requested", F.to_json(reply).alias("document"))
    return rules.recognised(d, '{"detector":"d"}').select("case_id", F.coalesce(F.get("violations", F.lit(0)), F.lit("ok")).alias("first_violation"))


@registered(
    "SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 1 THEN 'not_json' WHEN 2 THEN 'not_an_object' WHEN 3 THEN CASE WHEN event_type = 'view' THEN 'session_id' ELSE 'ok' END WHEN 4 THEN 'claim' WHEN 5 THEN CASE WHEN user_id % 2 = 0 THEN 'units' ELSE 'ok' END WHEN 6 THEN 'unit_id' ELSE 'ok' END AS first_violation, CASE WHEN event_id % 8 IN (0, 7) OR (event_id % 8 = 3 AND event_type <> 'view') OR (event_id % 8 = 5 AND user_id % 2 = 1) THEN 1 ELSE 0 END AS n_units FROM events"
)
def payload_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads a event, some of them malformed: each is a row with its first violation, the sound ones with their units."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id") % 8
    session = F.when((i == 3) & (F.col("event_type") == "view"), "5").otherwise(F.concat(F.lit('"e'), F.col("event_id").cast("string"), F.lit('"')))
    units_ = F.when((i == 5) & (F.col("user_id") % 2 == 0), '{"a":1}').when(i == 6, '[{"unit_id":7}]').otherwise('[{"unit_id":"u","source_type":"ocr","text":"t"}]')
    sound = F.concat(F.lit('{"session_id":'), session, F.when(i == 4, "").otherwise(',"claim":"c"'), F.lit(',"units":'), units_, F.lit("}"))
    d = records.payload_violations(e.select("event_id", F.when(i == 1, "{").when(i == 2, "[]").otherwise(sound).alias("value")))
    n = records.units_of(d.filter(F.size("violations") == 0)).groupBy("case_id").agg(F.count("*").alias("n_units"))
    j = d.withColumn("case_id", F.concat(F.lit("e"), F.col("event_id").cast("string"))).join(n, "case_id", "left")
    return j.select("event_id", F.coalesce(F.get("violations", F.lit(0)), F.lit("ok")).alias("first_violation"), F.coalesce("n_units", F.lit(0)).cast("int").alias("n_units"))


# ---------------------------------------------------------------- signals in pieces


@registered(
    "WITH p AS (SELECT label AS case_id, vec_id, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS n FROM embeddings), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY case_id ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p), "
    "c AS (SELECT *, greatest(0, least(n, 2500 - off)) AS k FROM o), s AS (SELECT case_id, n, k, list_transform(e[1:k], lambda x: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x * 8))) AS x FROM c) "
    "SELECT case_id, CAST(sum(k) AS BIGINT) AS sample_count, sum(k) / 1000.0::DOUBLE AS seconds, min(list_min(x)) AS low, max(list_max(x)) AS high, bool_or(k < n) AS cut FROM s GROUP BY case_id"
)
def signal_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors as the pieces of a signal, louder than allowed, cut after two and a half seconds."""
    e = table(spark, sf_dir, "embeddings")
    pieces = e.select(F.col("label").alias("case_id"), F.col("vec_id").alias("ordinal"), F.transform("embedding", lambda x: x.cast("double") * 8).alias("samples"))
    return signals.measured(pieces, 1000, 2500).drop("violation")


# ---------------------------------------------------------------- from claims to visual units

VISUAL = (
    "WITH q AS (SELECT label AS case_id, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS e FROM embeddings GROUP BY label), "
    "s AS (SELECT case_id, vec_id, round(list_cosine_similarity(q.e, CAST(f.embedding AS DOUBLE[])), 9) AS score FROM q JOIN embeddings f ON f.label = q.case_id), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, vec_id) AS r FROM s), "
    "k AS (SELECT case_id, vec_id, row_number() OVER (PARTITION BY case_id ORDER BY vec_id) - 1 AS i FROM t WHERE r <= 4 AND vec_id % 3 > 0) "
)


@registered(
    VISUAL + """SELECT case_id, i AS ordinal, 'visual_' || substr(sha256('{"evidence_refs":["F' || vec_id || '"],"frame_ids":["F' || vec_id || '"],"index":' || i || ',"observation":"a thing at ' || vec_id || '","observation_type":"scene"}'), 1, 20) AS unit_id, CAST(vec_id AS DOUBLE) AS start_time, 'F' || vec_id AS frame_id FROM k WHERE case_id % 4 <> 3"""
)
def visual_run_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors as frames, its first one as the claim, an observation of every frame: those of the four best frames that say nothing risky become units."""
    return _visual_runs(spark, sf_dir)[1].select("case_id", F.col("ordinal").cast("long").alias("ordinal"), "unit_id", "start_time", "frame_id")


@registered(
    VISUAL + "SELECT n.case_id, CASE WHEN n.case_id % 4 = 3 THEN 'reply_unsupported' END AS violation, least(n, 4) AS n_frames, CASE WHEN n.case_id % 4 = 3 THEN 0 ELSE a END AS n_accepted, CASE WHEN n.case_id % 4 = 3 THEN 0 ELSE n - a END AS n_rejected, CASE WHEN n.case_id % 4 <> 3 AND n > a THEN 'rejected ' || n - a || ' unsafe visual observations' ELSE '' END AS warnings "
    "FROM (SELECT label AS case_id, count(*) AS n FROM embeddings GROUP BY label) n JOIN (SELECT s.case_id, count(k.vec_id) AS a FROM (SELECT DISTINCT case_id FROM s) s LEFT JOIN k USING (case_id) GROUP BY s.case_id) USING (case_id)"
)
def visual_run_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of visual_run_units: what was retrieved, accepted and rejected of each case."""
    r = _visual_runs(spark, sf_dir)[0]
    return r.select("case_id", "violation", F.col("n_frames").cast("long").alias("n_frames"), F.col("n_accepted").cast("long").alias("n_accepted"), F.col("n_rejected").cast("long").alias("n_rejected"), F.array_join("warnings", ";").alias("warnings"))


def _visual_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").withColumn("case_id", F.col("label"))
    c = e.groupBy("case_id").agg(F.min_by("embedding", "vec_id").alias("embedding")).select("case_id", F.lit("s").alias("session_id"), F.lit("c").alias("claim"), "embedding")
    name = F.concat(F.lit("F"), F.col("vec_id").cast("string"))
    seen = e.select("case_id", name.alias("frame_id"), F.col("vec_id").alias("frame_index"), F.col("vec_id").cast("double").alias("timestamp"), F.concat(F.lit("/f/"), name).alias("frame_path"), "embedding")
    thing = F.concat(F.when(F.col("vec_id") % 3 == 0, "probably a thing at ").otherwise("a thing at "), F.col("vec_id").cast("string"))
    one = F.struct("vec_id", F.struct(F.array(name).alias("evidence_refs"), F.array(name).alias("frame_ids"), thing.alias("observation"), F.lit("scene").alias("observation_type")).alias("o"))
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["o"]))
    said = e.groupBy("case_id").agg(listed.alias("listed"))
    raw = F.when(F.col("case_id") % 4 == 3, '"no list"').when(F.col("case_id") % 2 == 1, F.col("listed")).otherwise(F.concat(F.lit('{"observations":'), "listed", F.lit("}")))
    return cases.visual_runs(c, seen, said.select("case_id", raw.alias("raw")))


# ---------------------------------------------------------------- claims in tokens


def word_tokenizer() -> Callable[[list[str]], list[int]]:
    """A tokenizer that counts words and an end mark, as a stand-in."""
    return lambda texts: [len(t.split(" ")) + 1 for t in texts]


@registered(
    "WITH c AS (SELECT conv_id AS case_id, text, CASE WHEN conv_id % 6 = 5 THEN NULL ELSE len(string_split(text, ' ')) + 1 END AS n FROM conversations WHERE turn = 0) "
    "SELECT case_id, '{\"claim_sha256\":\"' || sha256(text) || '\",\"configured_max_length\":64,\"effective_max_length\":' || CASE WHEN n IS NULL THEN 64 ELSE 40 END || ',\"model_input_token_count\":' || coalesce(least(n, 40), 0) || ',\"original_claim_preserved_for_mdu\":true,\"original_token_count\":' || coalesce(CAST(n AS VARCHAR), 'null') || ',\"padding\":\"max_length\",\"policy\":\"right_truncate_for_siglip_retrieval_only\",\"truncated\":' || CASE WHEN n > 40 THEN 'true' ELSE 'false' END || '}' AS document FROM c"
)
def claim_token_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns as claims: their tokens under a configured limit of 64, a model's of 40 and a tokenizer's that means none."""
    t = table(spark, sf_dir, "conversations").filter("turn = 0")
    c = t.select(F.col("conv_id").alias("case_id"), F.col("text").alias("claim"), F.when(F.col("conv_id") % 6 == 5, 0).otherwise(4).alias("n_frames"))
    return claims.token_audits(c, word_tokenizer, 64, 40, 10**9).select("case_id", "document")


# ---------------------------------------------------------------- requests to a scorer


@registered(
    rf"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, {STRIP} AS x FROM conversations) SELECT conv_id AS case_id, '{{"candidate_units":[' || coalesce(string_agg('{{"modality":"text","text":' || {sql_quoted("x")} || ',"unit_id":"asr_' || lpad(CAST(n AS VARCHAR), 4, '0') || '","unit_type":"transcript"}}', ',' ORDER BY n) FILTER (WHERE role <> 'system'), '') || '],"case_id":"session-' || conv_id || '","claim":"case ' || conv_id || '","dataset":"external"}}' AS document FROM r GROUP BY conv_id"""
)
def scorer_request_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's request to a scorer, byte for byte; what the system says may not be seen."""
    t = table(spark, sf_dir, "conversations")
    u = units.transcript_units(t.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("ordinal"), "text", "role"), keep=("role",)).withColumn("eligible", F.col("eligible") & (F.col("role") != "system"))
    c = t.select(F.col("conv_id").alias("case_id")).distinct()
    c = c.select("case_id", F.concat(F.lit("session-"), F.col("case_id").cast("string")).alias("session_id"), F.concat(F.lit("case "), F.col("case_id").cast("string")).alias("claim"))
    return units.scorer_requests(c, u).select("case_id", "document")
