"""JSON sources and sinks of requests, units, results and logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.canonical import with_document
from ..operators.validate import violations
from .store import Store

REQUEST = "claim string, request_id string, media_path string, transcript_segments array<struct<text:string,start_time:double,end_time:double,confidence:double>>, ocr_observations array<struct<text:string,frame_id:string,frame_path:string,bbox:array<double>,confidence:double>>, visual_inputs array<struct<frame_id:string,frame_path:string,observation:string,confidence:double>>, metadata variant"
UNIT = "struct<unit_id:string,source_type:string,text:string,start_time:double,end_time:double,frame_id:string,frame_path:string,bbox:array<double>,confidence:double,producer:string,provenance:struct<source_uri:string,source_index:int,extraction_method:string,details:variant>,eligible_for_frozen_g1:boolean,selection_score:double,logits:struct<fake:double,real:double>>"
RESULT = f"session_id string, claim string, model_verdict string, display_verdict string, evidence_status string, sample_logits struct<fake:double,real:double>, probabilities struct<fake:double,real:double>, all_units array<{UNIT}>, top_k_units array<{UNIT}>, class_winners struct<fake:string,real:string>, pipeline_stages array<struct<name:string,sequence:int,status:string,runtime_ms:double,detail:string>>, warnings array<string>, checkpoint_sha256 string, runtime_ms double"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One request a file."""
    return spark.read.schema(REQUEST).option("multiLine", True).json(path)


def _units(exploded: DataFrame) -> DataFrame:
    u = exploded.select(*[c for c in exploded.columns if c != "u"], "u.*").withColumnRenamed(fixed.ELIGIBLE, "eligible")
    p, logits = F.col("provenance"), F.col("logits")
    u = u.withColumns({c: p[c] for c in ("source_uri", "source_index", "extraction_method", "details")} | {c: logits[c] for c in ("fake", "real")}).drop("provenance", "logits")
    return u.withColumns({"text": F.coalesce("text", F.lit("")), "producer": F.coalesce("producer", F.lit("unknown")), "eligible": F.coalesce("eligible", F.lit(False))})


def units_of(payloads: DataFrame, column: str = "value") -> DataFrame:
    """case_id, claim, ordinal and the fields of each unit of {session_id, claim, units} documents. Malformed ones give none; payload_violations tells them."""
    p = payloads.select(F.from_json(column, f"session_id string, claim string, units array<{UNIT}>").alias("p"))
    return _units(p.select(F.col("p.session_id").alias("case_id"), "p.claim", F.posexplode("p.units").alias("ordinal", "u")))


def payload_violations(payloads: DataFrame, column: str = "value") -> DataFrame:
    """payloads with violations of their shape, so that a malformed document is a row and not lost: no JSON object, no session id or claim, units that are no list of objects."""
    v = F.try_parse_json(column)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("ABSENT"))
    items = F.try_variant_get(v, "$.units", "array<variant>")
    objects = kind("$.units").startswith("ARRAY") & F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("")).startswith("OBJECT"))
    named = F.forall(items, lambda x: F.coalesce(F.schema_of_variant(F.try_variant_get(x, "$.unit_id", "variant")), F.lit("")) == "STRING")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    checks = ((v.isNull(), "not_json"), (no(kind("$").startswith("OBJECT")), "not_an_object"), (kind("$.session_id") != "STRING", "session_id"), (kind("$.claim") != "STRING", "claim"), (no(objects), "units"), (no(named), "unit_id"))
    return payloads.withColumn("violations", violations(*checks))


def array_units_of(payloads: DataFrame, column: str = "value") -> DataFrame:
    """As units_of, for documents that are an array of units, of which case_id is a column of its own."""
    return _units(payloads.select("case_id", F.posexplode(F.from_json(column, f"array<{UNIT}>")).alias("ordinal", "u")))


def unit_struct(units: DataFrame) -> Column:
    """A unit's record from flat columns (details: JSON); columns that units lacks are null."""
    kinds = {"bbox": "array<double>", "source_index": "int", "eligible": "boolean", **dict.fromkeys(("start_time", "end_time", "confidence", "selection_score", "fake", "real"), "double")}
    opt = lambda c: F.col(c) if c in units.columns else F.lit(None).cast(kinds.get(c, "string"))
    details = F.coalesce(opt("details") if dict(units.dtypes).get("details") == "variant" else F.parse_json(opt("details")), F.parse_json(F.lit("{}")))
    provenance = F.struct(opt("source_uri").alias("source_uri"), opt("source_index").alias("source_index"), opt("extraction_method").alias("extraction_method"), details.alias("details"))
    logits = F.when(opt("fake").isNotNull() | opt("real").isNotNull(), F.struct(opt("fake").alias("fake"), opt("real").alias("real")))
    plain = ("unit_id", "source_type", "text", "start_time", "end_time", "frame_id", "frame_path", "bbox", "confidence", "producer", "selection_score")
    return F.struct(*[opt(c).alias(c) for c in plain], provenance.alias("provenance"), opt("eligible").alias(fixed.ELIGIBLE), logits.alias("logits"))


def payloads(cases: DataFrame, units: DataFrame) -> DataFrame:
    """case_id, session_id, document: each case's {session_id, claim, units} as canonical JSON, units in order of ordinal. units_of reads it."""
    # a VARIANT can't be sorted, so the units are put in order by their places
    rows = units.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("ordinal", unit_struct(units).alias("unit")))).alias("at"))
    per = rows.select("case_id", F.transform(F.array_sort(F.map_keys("at")), lambda k: F.element_at("at", k)).alias("units"))
    rows = cases.join(per, "case_id", "left")
    none = F.array().cast(rows.schema["units"].dataType)
    return with_document(rows, "document", F.struct("claim", "session_id", F.coalesce("units", none).alias("units"))).select("case_id", "session_id", "document")


def results_of(documents: DataFrame, column: str = "value") -> DataFrame:
    return documents.select(F.from_json(column, RESULT).alias("r")).select("r.*")


#: Fixed value: a safe category of documents.
SAFE = re.compile(r"[A-Za-z0-9_.-]{1,100}")


def _safe_root(root: str, category: str) -> str:
    if not SAFE.fullmatch(category) or set(category) <= {"."}:
        raise ValueError(f"unsafe category: {category!r}")
    return f"{root.rstrip('/')}/{category}"


def put_documents(df: DataFrame, root: str, category: str, key: str) -> int:
    """Put JSON documents by key below root/category, in a store with snapshots (see store.Store); the version they are in.

    df: key and one column more, the document as canonical JSON text. Unsafe keys are an error
    and nothing is kept; a key that comes again is replaced, other keys' documents stay. Of rows with
    one key the last by the document's text stays.
    """
    document = next(c for c in df.columns if c != key)
    return Store(df.sparkSession, _safe_root(root, category)).commit(df.select(F.col(key).alias("key"), F.col(document).alias("value")))


def documents_of(spark: SparkSession, root: str, category: str) -> DataFrame:
    """key, value of the documents below root/category."""
    return Store(spark, _safe_root(root, category)).read()


def append_log(events: DataFrame, path: str) -> None:
    """event, payload and case_id as JSON lines with sorted keys, appended; a case's lines are found by their case_id."""
    events.select(*sorted(events.columns)).write.mode("append").json(path)


def write_results(results: DataFrame, root: str) -> None:
    """Results as documents by session id, and a log line for each."""
    put_documents(results.select("session_id", "document"), root, "results", "session_id")
    append_log(results.select(F.col("session_id").alias("case_id"), F.lit("result_created").alias("event"), F.to_json(F.struct(F.concat(F.lit("results/"), "session_id").alias("path"))).alias("payload")), f"{root.rstrip('/')}/logs")


def stdout_lines(outcomes: DataFrame, column: str = "outcome") -> Iterator[tuple[str, int]]:
    """Each outcome as one line of compact JSON with its exit code, a partition at a time."""
    for r in outcomes.select(column, F.when(F.get_json_object(column, "$.status") == "success", 0).otherwise(1).alias("code")).toLocalIterator():
        yield r[0], r[1]
