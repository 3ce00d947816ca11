"""Registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import numeric as N
from ..functions import text as T
from .. import fixed
from ..operators import assess, cases, exposure, frames, observe, package, response, retrieve, scoring, selection, units, validate
from .registry import oracle_sql, queries, registered, table

# ---------------------------------------------------------------- conversations as cases

STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
UNITS = f"u AS (SELECT conv_id AS case_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, 'asr_' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS VARCHAR), 4, '0') AS unit_id, 'transcript' AS source_type, {STRIP} AS text, turn FROM conversations)"
PART = "CAST(CAST('0x' || substr(h, {at}, 16) AS UBIGINT) AS DOUBLE) / CAST(18446744073709551615 AS DOUBLE)"
SCORED = (
    f"WITH {UNITS}, d AS (SELECT *, sha256('case ' || case_id || chr(31) || unit_id || chr(31) || source_type || chr(31) || text) AS h FROM u WHERE ordinal < 24), "
    f"s AS (SELECT case_id, ordinal, unit_id, text, round({PART.format(at=1)}, 12) AS selection_score, round({PART.format(at=17)} * 4.0 - 2.0, 12) AS fake, round({PART.format(at=33)} * 4.0 - 2.0, 12) AS real FROM d) "
)
POOLED = SCORED + ", p AS (SELECT case_id, max(fake) AS fake, max(real) AS real, arg_max(unit_id, (fake, unit_id)) AS fake_winner, arg_max(unit_id, (real, unit_id)) AS real_winner, count(*) AS n_units FROM s GROUP BY case_id) "


def conversation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("ordinal"), "text")
    return units.transcript_units(t).withColumn("ordinal", F.col("ordinal").cast("long"))


def scored_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units.eligible(conversation_units(spark, sf_dir)).filter(F.col("ordinal") < scoring.MAX_UNITS)
    return scoring.hash_scores(u, F.concat(F.lit("case "), F.col("case_id").cast("string")))


@registered(POOLED + "SELECT case_id, fake, real, round(exp(fake - greatest(fake, real)) / (exp(fake - greatest(fake, real)) + exp(real - greatest(fake, real))), 9) AS p_fake, fake_winner, real_winner, CASE WHEN fake >= real THEN 'fake' ELSE 'real' END AS model_verdict, CASE WHEN fake >= real THEN 'Fake' ELSE 'Real' END AS display_verdict, 'sufficient' AS evidence_status, n_units FROM p")
def verdict_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases scored by digest, pooled by class, with a verdict each."""
    s = scored_units(spark, sf_dir)
    v = scoring.verdicts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id")).distinct(), scoring.pooled(s))
    return v.withColumn("p_fake", F.round("p_fake", 9)).drop("p_real")


@registered(SCORED + "SELECT case_id, rank, unit_id, selection_score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY selection_score DESC, unit_id) AS rank FROM s) WHERE rank <= 5")
def topk_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = selection.ranked(scored_units(spark, sf_dir), F.desc("selection_score"), F.asc("unit_id"))
    return r.filter(F.col("rank") <= scoring.TOP_K).select("case_id", F.col("rank").cast("long").alias("rank"), "unit_id", "selection_score")


@registered(POOLED + "SELECT case_id, fake_winner, real_winner, fake, real FROM p")
def class_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pooled(scored_units(spark, sf_dir)).select("case_id", "fake_winner", "real_winner", "fake", "real")


LONG = "l AS (SELECT conv_id // 10 AS case_id, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn) - 1 AS ordinal, text, count(*) OVER (PARTITION BY conv_id // 10) AS n FROM conversations)"


def long_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    case = F.floor(F.col("conv_id") / 10)
    w = Window.partitionBy(case).orderBy("conv_id", "turn")
    return c.select(case.alias("case_id"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"), "text").withColumn("unit_id", F.format_string("asr_%04d", "ordinal")).withColumn("start_time", F.col("ordinal").cast("double")).withColumn("end_time", F.col("ordinal") + 1.0)


@registered(f"WITH {LONG} SELECT case_id, ordinal, text FROM l WHERE ordinal < 24")
def first_n_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_n(long_cases(spark, sf_dir), scoring.MAX_UNITS, "ordinal").select("case_id", "ordinal", "text")


@registered(f"WITH {LONG} SELECT case_id, CASE WHEN n <= 12 THEN ordinal ELSE ((ordinal + 1) * 12 - 1) // n END AS bucket, string_agg(text, ' ' ORDER BY ordinal) AS text, CAST(min(ordinal) AS DOUBLE) AS start_time, max(ordinal) + CAST(1.0 AS DOUBLE) AS end_time, count(*) AS n_units FROM l GROUP BY ALL")
def balanced_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.merged_buckets(long_cases(spark, sf_dir), 12).drop("unit_ids")


POOL = "p AS (SELECT conv_id AS case_id, 0 AS source_rank, turn AS ordinal, 'transcript' AS source_type, true AS eligible FROM conversations UNION ALL SELECT doc_id, 1, 0, 'ocr', n_chars >= 200 FROM documents UNION ALL SELECT user_id, 2, event_id, 'visual_observation', false FROM events)"


def all_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = conversation_units(spark, sf_dir).select("case_id", "ordinal", "source_type", "eligible")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit(0).cast("long").alias("ordinal"), F.lit("ocr").alias("source_type"), (F.col("n_chars") >= 200).alias("eligible"))
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("ordinal"), F.lit(fixed.VISUAL).alias("source_type"), F.lit(False).alias("eligible"))
    return units.pool(a, d, v)


@registered(f"WITH {POOL} SELECT case_id, source_type, count(*) AS n_units, CAST(min(pos) AS BIGINT) AS first_position FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY source_rank, ordinal) - 1 AS pos FROM p) GROUP BY ALL")
def unit_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered union of three sources, counted by case and source."""
    return all_units(spark, sf_dir).groupBy("case_id", "source_type").agg(F.count("*").alias("n_units"), F.min("position").cast("long").alias("first_position"))


@registered(f"WITH {POOL} SELECT case_id, CASE source_type WHEN 'ocr' THEN 'ocr' ELSE 'text' END AS modality, count(*) AS n FROM p WHERE eligible AND source_type <> 'visual_observation' GROUP BY ALL")
def eligible_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.eligible(all_units(spark, sf_dir)).groupBy("case_id", units.modality(F.col("source_type")).alias("modality")).agg(F.count("*").alias("n"))


@registered(f"WITH {POOL} SELECT e.case_id, count(*) AS n, sum(CASE WHEN p2.eligible THEN 1 ELSE 0 END)::BIGINT AS n_eligible, CASE WHEN count(*) FILTER (WHERE p2.eligible AND p2.source_type <> 'visual_observation') > 0 THEN 'sufficient' ELSE 'insufficient' END AS status, count(*) FILTER (WHERE p2.source_type = 'visual_observation') AS visual FROM (SELECT DISTINCT case_id FROM p) e JOIN p p2 USING (case_id) GROUP BY e.case_id")
def sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = all_units(spark, sf_dir)
    s = package.sufficiency(u.select("case_id"), u)
    n = u.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"))
    return s.join(n, "case_id").select("case_id", "n", "n_eligible", "status", "visual")


# ---------------------------------------------------------------- on-screen text

OCR = r"o AS (SELECT source AS case_id, doc_id AS frame, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key, (n_chars % 101) / 100.0::DOUBLE AS conf, len(regexp_extract_all(text, '[\p{L}\p{N}]')) AS alnum, n_chars FROM documents)"


def text_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("case_id"), F.col("doc_id").alias("frame"), "text", F.sha2(F.lower(T.collapse(F.col("text"))), 256).alias("key"), (F.col("n_chars") % 101 / 100.0).alias("conf"), T.alnum_count(F.col("text")).cast("long").alias("alnum"), "n_chars")


def accepted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_frames(spark, sf_dir).filter((F.col("conf") >= 0.5) & (F.col("alnum") >= 3))


@registered(f"WITH {OCR} SELECT case_id, frame, conf, alnum FROM o WHERE conf >= 0.5 AND alnum >= 3")
def ocr_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted_frames(spark, sf_dir).select("case_id", "frame", "conf", "alnum")


BEST = f"WITH {OCR}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, key ORDER BY conf DESC, n_chars DESC, frame) AS r FROM o WHERE conf >= 0.5 AND alnum >= 3) WHERE r = 1) "


def best_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.keep_best(accepted_frames(spark, sf_dir), ["case_id", "key"], F.desc("conf"), F.desc("n_chars"), "frame")


@registered(BEST + "SELECT case_id, frame, conf FROM b")
def ocr_dedup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_frames(spark, sf_dir).select("case_id", "frame", "conf")


@registered()
def ocr_dedup_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ocr_dedup_best, by the compatibility-folded key, for which SQL has no function."""
    rows = accepted_frames(spark, sf_dir).withColumn("folded", T.fold_key("text")).withColumn("key", F.sha2("folded", 256))
    return selection.keep_best(rows, ["case_id", "key"], F.desc("conf"), F.desc("n_chars"), "frame").select("case_id", "frame", "conf")


@registered(BEST + "SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY frame) - 1 AS ordinal, frame, 'ocr_' || lpad(CAST(row_number() OVER (PARTITION BY case_id ORDER BY frame) - 1 AS VARCHAR), 4, '0') AS unit_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY conf DESC, n_chars DESC, frame) AS q FROM b) WHERE q <= 6")
def ocr_top6_chrono(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = selection.top_then_restore(best_frames(spark, sf_dir), 6, [F.desc("conf"), F.desc("n_chars"), F.asc("frame")], [F.asc("frame")])
    return top.select("case_id", F.col("ordinal").cast("long").alias("ordinal"), "frame", F.format_string("ocr_%04d", "ordinal").alias("unit_id"))


@registered("SELECT source AS case_id, row_number() OVER (PARTITION BY source ORDER BY start NULLS LAST, unit_id) - 1 AS ordinal, unit_id FROM (SELECT source, nullif(doc_id % 7, 0) AS start, 'ocr_' || doc_id AS unit_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(nullif(n_chars % 11, 0), -1) DESC, coalesce(nullif(n_chars % 5, 0), 1) DESC, doc_id) AS q FROM documents) WHERE q <= 6")
def exposure_ocr_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six best by confidence and count with fallbacks for nulls, restored in time, unknown times last."""
    zero = F.lit(0).cast("long")
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.nullif(F.col("doc_id") % 7, zero).alias("start"), F.concat(F.lit("ocr_"), F.col("doc_id").cast("string")).alias("unit_id"), F.nullif(F.col("n_chars") % 11, zero).alias("conf"), F.nullif(F.col("n_chars") % 5, zero).alias("raw"), "doc_id")
    top = selection.top_then_restore(d, 6, [F.coalesce("conf", F.lit(-1)).desc(), F.coalesce("raw", F.lit(1)).desc(), F.asc("doc_id")], [F.col("start").asc_nulls_last(), F.asc("unit_id")])
    return top.select("case_id", F.col("ordinal").cast("long").alias("ordinal"), "unit_id")


@registered("SELECT user_id AS case_id, event_type AS frame, round(CAST(avg(CAST(value AS DECIMAL(28,9))) AS DOUBLE), 6) AS mean_conf, count(*) AS n FROM events GROUP BY ALL")
def frame_mean_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("frame"))
    return e.agg(F.round(F.avg(F.col("value").cast("decimal(28,9)")).cast("double"), 6).alias("mean_conf"), F.count("*").alias("n"))


@registered("SELECT l_orderkey AS case_id, min(l_discount) AS xmin, min(l_tax) AS ymin, max(l_discount + l_quantity) AS xmax, max(l_tax + l_extendedprice) AS ymax FROM lineitem GROUP BY l_orderkey")
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    far = F.col("l_discount") + F.col("l_quantity"), F.col("l_tax") + F.col("l_extendedprice")
    b = li.select(F.col("l_orderkey").alias("case_id"), N.box_of((F.col("l_discount"), F.col("l_tax")), far).alias("b"))
    return b.groupBy("case_id").agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


@registered("SELECT conv_id AS case_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY conv_id")
def transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's text in order (on its own turns, however many)."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("case_id"))
    return c.agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY turn)").alias("text"), F.count("*").alias("n"))


# ---------------------------------------------------------------- retrieval

FRAMES = "f AS (SELECT label AS case_id, vec_id AS frame_index, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, frame_index) AS retrieval_rank FROM f)"


def case_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    query = e.filter("vec_id = 0").select("embedding").scalar()  # one row
    f = e.select(F.col("label").alias("case_id"), F.col("vec_id").alias("frame_index"), "embedding", query.alias("query"))
    return retrieve.scored_frames(f, F.col("query")).select("case_id", "frame_index", "score")


@registered(f"WITH {FRAMES} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY frame_index) - 1 AS ordinal, frame_index, retrieval_rank, round(score, 6) AS score FROM r WHERE retrieval_rank <= 4")
def visual_top4_chrono(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieve.retrieved(case_frames(spark, sf_dir))
    w = Window.partitionBy("case_id").orderBy("frame_index")
    return top.select("case_id", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), "frame_index", F.col("retrieval_rank").cast("long").alias("retrieval_rank"), F.round("score", 6).alias("score"))


@registered(f"WITH {FRAMES} SELECT case_id, frame_index, CASE WHEN retrieval_rank <= 4 THEN retrieval_rank END AS retrieval_rank FROM r")
def retrieval_rank_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = case_frames(spark, sf_dir)
    return retrieve.backfilled(f, retrieve.retrieved(f), ["case_id", "frame_index"]).select("case_id", "frame_index", F.col("retrieval_rank").cast("long").alias("retrieval_rank"))


@registered("SELECT o_orderkey, CASE WHEN n <= 8 THEN list_transform(range(n), lambda i: i) ELSE list_distinct_ordered END AS positions FROM (SELECT o_orderkey, o_orderkey % 3000 + 1 AS n, list_sort(list_distinct(list_transform(range(8), lambda i: CAST(round_even((i + 1) / 9.0::DOUBLE * (o_orderkey % 3000), 0) AS BIGINT)))) AS list_distinct_ordered FROM orders)")
def frame_sampler_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 3000 + 1).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.interior_positions(n).alias("positions"))


@registered("SELECT o_orderkey, list_sort(list_distinct(list_transform(range(12), lambda i: CAST(round_even(i * (o_orderkey % 3000) / 11.0::DOUBLE, 0) AS BIGINT)))) AS positions FROM orders")
def frame_sampler_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 3000 + 1).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.endpoint_positions(n).alias("positions"))


# ---------------------------------------------------------------- observations

OBS_TYPES = "['entity','action','scene','object_state','spatial_relation','temporal_change','opinion']"
# every whole line of every document is an observation
OBS = (
    f"o AS (SELECT doc_id AS case_id, i - 1 AS ordinal, {OBS_TYPES}[CAST((i - 1) % 7 AS INT) + 1] AS kind, "
    + "lines[i] AS raw, ['F' || (i - 1) % 5, 'F' || (i - 1) % 3] AS frame_ids FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i))"
)
RISK = "|".join(observe.PHRASES)
OBS_REASONS = (
    r"r AS (SELECT *, list_filter([CASE WHEN kind NOT IN ('entity','action','scene','object_state','spatial_relation','temporal_change') THEN 'invalid_observation_type' END, "
    r"CASE WHEN length(regexp_replace(raw, '^\s+|\s+$', '', 'g')) NOT BETWEEN 5 AND 280 THEN 'invalid_observation_length' END, "
    r"CASE WHEN len(list_filter(frame_ids, lambda x: x NOT IN ('F0','F1','F2','F3'))) > 0 THEN 'unknown_frame_ids' END, "
    r"CASE WHEN len(list_filter(frame_ids, lambda x: x NOT IN ('F0','F1','F2','F3'))) > 0 THEN 'unknown_evidence_refs' END, "
    rf"CASE WHEN regexp_matches(lower(raw), '{RISK}') THEN 'risky_inference_or_ocr_language' END, "
    r"CASE WHEN kind = 'temporal_change' AND len(list_distinct(frame_ids)) < 2 THEN 'temporal_change_requires_two_frame_ids' END], lambda x: x IS NOT NULL) AS why FROM o)"
)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, (*observe.TYPES, "opinion")))
    f = lambda n: F.concat(F.lit("F"), (F.col("ordinal") % n).cast("string"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "observation"))
    d = d.select("case_id", F.col("ordinal").cast("long").alias("ordinal"), F.element_at(kinds, (F.col("ordinal") % 7 + 1).cast("int")).alias("observation_type"), "observation", F.array(f(5), f(3)).alias("frame_ids"))
    return observe.filtered(d.withColumn("evidence_refs", F.col("frame_ids")), F.array(*[F.lit(f"F{i}") for i in range(4)]))


@registered(f"WITH {OBS}, {OBS_REASONS} SELECT case_id, ordinal, array_to_string(why, ',') AS reasons FROM r WHERE len(why) > 0")
def observation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).filter((F.size("reasons") > 0) & ~F.array_contains("reasons", "maximum_observations_exceeded"))
    return o.select("case_id", "ordinal", F.array_join("reasons", ",").alias("reasons"))


@registered(f"WITH {OBS}, {OBS_REASONS}, k AS (SELECT *, sum(CASE WHEN len(why) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY ordinal) AS v FROM r) SELECT case_id, ordinal, CASE WHEN v <= 8 THEN 'accepted' ELSE 'maximum_observations_exceeded' END AS fate FROM k WHERE len(why) = 0")
def observation_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    cap = F.array_contains("reasons", "maximum_observations_exceeded")
    return o.filter((F.size("reasons") == 0) | cap).select("case_id", "ordinal", F.when(cap, "maximum_observations_exceeded").otherwise("accepted").alias("fate"))


@registered("SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'canonical_object' WHEN 1 THEN 'top_level_array_wrapped' WHEN 2 THEN 'single_observation_object_wrapped' WHEN 3 THEN 'not_json' WHEN 4 THEN 'canonical_object' ELSE 'unsupported' END AS mode FROM events")
def json_recovery_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event properties in six wrappings, told apart by shape."""
    p, k = F.col("props"), F.col("event_id") % 6
    one = F.concat(F.lit('{"observation_type":"scene","observation":"x","frame_ids":[],"evidence_refs":['), p, F.lit("]}"))
    raw = F.when(k == 0, F.concat(F.lit('{"observations":['), p, F.lit("]}"))).when(k == 1, F.concat(F.lit("["), p, F.lit("]"))).when(k == 2, one)
    raw = raw.when(k == 3, F.concat(p, F.lit("}"))).when(k == 4, F.concat(F.lit('```json\n{"observations":['), p, F.lit("]}\n```"))).otherwise(p)
    return table(spark, sf_dir, "events").select("event_id", observe.recovery_mode(raw).alias("mode"))


@registered("SELECT doc_id, 'visual_' || substr(sha256('{\"evidence_refs\":[\"F' || doc_id % 3 || '\"],\"frame_ids\":[\"F' || doc_id % 5 || '\"],\"index\":' || doc_id || ',\"observation\":\"' || source || '\",\"observation_type\":\"scene\"}'), 1, 20) AS unit_id FROM documents")
def visual_unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda n: F.array(F.concat(F.lit("F"), (F.col("doc_id") % n).cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", H.visual_unit_id(index=F.col("doc_id"), observation_type=F.lit("scene"), observation=F.col("source"), frame_ids=f(5), evidence_refs=f(3)).alias("unit_id"))


@registered("WITH o AS (SELECT source AS case_id, doc_id AS ordinal, unnest(list_distinct([doc_id % 40, doc_id % 23])) AS vec_id FROM documents) SELECT case_id, ordinal, CAST(min(CASE WHEN vec_id < 30 THEN vec_id END) AS DOUBLE) AS start_time, CAST(max(CASE WHEN vec_id < 30 THEN vec_id END) AS DOUBLE) AS end_time, arg_min(vec_id, vec_id) FILTER (WHERE vec_id < 30) AS primary_index, count(*) FILTER (WHERE vec_id >= 30) AS unknown FROM o GROUP BY ALL")
def observation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations joined with their frames: earliest frame, first and last time, unknown references."""
    name = lambda c: F.format_string("F%03d", c)
    d = table(spark, sf_dir, "documents")
    o = d.select(F.col("source").alias("case_id"), F.col("doc_id").alias("ordinal"), F.array(name(F.col("doc_id") % 40)).alias("frame_ids"), F.array(name(F.col("doc_id") % 23)).alias("evidence_refs"))
    frames = d.select(F.col("source").alias("case_id")).distinct().select("case_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("frame_index"))
    frames = frames.select("case_id", "frame_index", name(F.col("frame_index")).alias("frame_id"), F.col("frame_index").cast("double").alias("timestamp"))
    got = observe.with_frames(o, frames)
    return got.select("case_id", "ordinal", "start_time", "end_time", F.substring("primary_frame", 2, 9).cast("long").alias("primary_index"), "unknown")


# ---------------------------------------------------------------- contracts

@registered("SELECT event_id, CASE WHEN s < 0 THEN 'invalid_start' WHEN e < s THEN 'end_before_start' ELSE 'ok' END AS first_violation FROM (SELECT event_id, value - 5 AS s, value - 5 + (event_id % 4) - 1 AS e FROM events) WHERE NOT (s >= 0 AND e < 0) OR e >= s UNION ALL SELECT event_id, 'invalid_end' FROM (SELECT event_id, value - 5 AS s, value - 5 + (event_id % 4) - 1 AS e FROM events) WHERE s >= 0 AND e < 0 AND e < s")
def timestamp_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("value") - 5
    v = validate.timestamps(s, s + (F.col("event_id") % 4) - 1)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get(v, F.lit(0)), F.lit("ok")).alias("first_violation"))


@registered("SELECT case_id, ordinal, start_time < last_start AS goes_back FROM (SELECT *, last_value(start_time IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_start FROM (SELECT user_id AS case_id, event_id AS ordinal, CASE WHEN event_id % 5 > 0 THEN value END AS start_time FROM events)) WHERE start_time < last_start")
def monotonic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.when(F.col("event_id") % 5 > 0, F.col("value"))
    c = e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("text"), t.alias("start_time"), F.lit(None).cast("double").alias("end_time"))
    return validate.monotonic(c).filter(F.size("violations") > 0).select("case_id", "ordinal", F.array_contains("violations", "start_not_monotonic").alias("goes_back"))


FAULT = "SELECT case_id, CASE CAST(case_id % 8 AS INT) WHEN 1 THEN 'prediction_id' WHEN 2 THEN 'input_count' WHEN 3 THEN 'unknown_unit' WHEN 4 THEN 'exposed_count' WHEN 5 THEN 'top_k_size' WHEN 6 THEN 'winner' WHEN 7 THEN 'modality' ELSE 'ok' END AS first_violation FROM (SELECT DISTINCT conv_id AS case_id FROM conversations)"


@registered(FAULT)
def response_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all cases, seven of eight with a fault of one kind, and the first violation found."""
    s = scored_units(spark, sf_dir)
    k = F.col("case_id") % 8
    p = scoring.pooled(s)
    fake = F.col("fake") >= F.col("real")
    p = p.select(
        "case_id", F.when(fake, "fake").otherwise("real").alias("prediction"), (F.when(fake, 0).otherwise(1) + F.when(k == 1, 1).otherwise(0)).alias("prediction_id"), "fake", "real",
        (F.col("n_units") + F.when(k == 2, 1).otherwise(0)).alias("input_count"), (F.col("n_units") + F.when(k == 4, 1).otherwise(0)).alias("exposed_count"), F.lit(0).alias("truncated_count"),
        F.when(k == 5, F.array(*[F.lit(f"x{i}") for i in range(6)])).otherwise(F.array("fake_winner")).alias("top_k"), F.when(k == 6, "none").otherwise(F.col("fake_winner")).alias("fake_winner"), "real_winner",
    )
    sent = s.select("case_id", F.when((k == 3) & (F.col("ordinal") == 0), "other").otherwise(F.col("unit_id")).alias("unit_id"))
    out = s.select("case_id", "unit_id", F.when(k == 7, "video").otherwise("text").alias("modality"), "selection_score", "fake", "real")
    v = validate.response(p, out, sent)
    return v.select("case_id", F.coalesce(F.get("violations", F.lit(0)), F.lit("ok")).alias("first_violation"))


@registered(SCORED + "SELECT u.case_id, u.unit_id, s.selection_score FROM (SELECT case_id, unit_id, ordinal FROM u) u LEFT JOIN (SELECT * FROM s WHERE fake >= real) s USING (case_id, unit_id)")
def attach_scores_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scored_units(spark, sf_dir).filter("fake >= real").select("case_id", "unit_id", "selection_score")
    return scoring.attach(conversation_units(spark, sf_dir).select("case_id", "unit_id"), got, ["case_id", "unit_id"])


@registered(f"WITH {UNITS} SELECT case_id, unit_id FROM u WHERE (case_id, ordinal) NOT IN (SELECT conv_id, turn FROM conversations WHERE role = 'user')")
def unknown_ids_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("ordinal"))
    return conversation_units(spark, sf_dir).join(c, ["case_id", "ordinal"], "left_anti").select("case_id", "unit_id")


@registered(f"WITH {UNITS} SELECT case_id, unit_id FROM u WHERE (case_id, ordinal) IN (SELECT conv_id, turn FROM conversations WHERE role = 'user')")
def exposed_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("ordinal"))
    return conversation_units(spark, sf_dir).join(c, ["case_id", "ordinal"], "left_semi").select("case_id", "unit_id")


@registered("WITH d AS (SELECT doc_id // 20 AS case_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS ordinal, doc_id, lang, n_chars FROM documents) SELECT a.case_id, a.ordinal, CASE WHEN b.ordinal IS NULL THEN 'missing' WHEN a.doc_id <> b.f THEN 'different' ELSE 'ok' END AS state FROM d a LEFT JOIN (SELECT case_id, ordinal, CASE WHEN lang = 'de' THEN -1 ELSE doc_id END AS f FROM d WHERE n_chars >= 300) b ON a.case_id = b.case_id AND a.ordinal = b.ordinal")
def positional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames asked for against frames returned, by position."""
    d = table(spark, sf_dir, "documents")
    case = F.floor(F.col("doc_id") / 20)
    w = Window.partitionBy(case).orderBy("doc_id")
    d = d.select(case.alias("case_id"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"), "doc_id", "lang", "n_chars")
    back = d.filter("n_chars >= 300").select("case_id", "ordinal", F.when(F.col("lang") == "de", -1).otherwise(F.col("doc_id")).alias("frame_id"))
    v = validate.positional(d.withColumn("frame_id", F.col("doc_id")), back)
    return v.select("case_id", "ordinal", F.coalesce(F.get("violations", F.lit(0)), F.lit("ok")).alias("state"))


@registered("SELECT case_id, CASE WHEN m <> 'not_run' AND lower(d) <> m THEN 'display_differs_from_model' WHEN m = 'not_run' AND has THEN 'scores_without_run' WHEN m = 'not_run' AND st <> 'insufficient' THEN 'not_run_but_sufficient' WHEN m = 'not_run' AND d <> 'NEI' THEN 'not_run_display' WHEN m <> 'not_run' AND NOT has THEN 'run_without_scores' ELSE 'ok' END AS first_violation FROM (SELECT doc_id AS case_id, ['fake','real','not_run'][CAST(doc_id % 3 AS INT) + 1] AS m, ['Fake','Real','NEI'][CAST(n_chars % 3 AS INT) + 1] AS d, CASE WHEN doc_id % 2 = 0 THEN 'sufficient' ELSE 'insufficient' END AS st, n_chars % 5 > 0 AS has FROM documents)")
def verdict_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c % 3 + 1).cast("int"))
    score = F.when(F.col("n_chars") % 5 > 0, F.lit(1.0))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), pick(("fake", "real", "not_run"), F.col("doc_id")).alias("model_verdict"), pick(("Fake", "Real", "NEI"), F.col("n_chars")).alias("display_verdict"), F.when(F.col("doc_id") % 2 == 0, "sufficient").otherwise("insufficient").alias("evidence_status"), score.alias("fake"), score.alias("real"))
    return validate.result(d).select("case_id", F.coalesce(F.get("violations", F.lit(0)), F.lit("ok")).alias("first_violation"))


@registered(f"WITH {POOL}, n AS (SELECT case_id, ordinal, source_type, count(*) OVER (PARTITION BY case_id, source_type) AS c FROM p WHERE source_type <> 'visual_observation') SELECT case_id, count(*) AS duplicates FROM n WHERE c > 1 GROUP BY case_id")
def duplicate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a case that carry the same id (here their source)."""
    u = all_units(spark, sf_dir).filter("source_type <> 'visual_observation'").withColumn("unit_id", F.col("source_type")).withColumn("text", F.lit("x"))
    return validate.units(u).filter(F.array_contains("violations", "duplicate_unit_id")).groupBy("case_id").agg(F.count("*").alias("duplicates"))


# ---------------------------------------------------------------- sessions, packaging

@registered("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'page-' || page_id ELSE 'session-' || substr(sha256('{\"url\":\"' || url || '\"}'), 1, 16) END AS session_id FROM pages")
def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe requested ids stay, others (here: URLs) are replaced by a digest."""
    p = table(spark, sf_dir, "pages")
    asked = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("page-"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return p.select("page_id", H.session_id(asked, H.canonical_json(url=F.col("url"))).alias("session_id"))


@registered("SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_.-]{1,100}') AS safe FROM customer")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", H.safe_component(F.col("c_name")).alias("safe"))


@registered(f"WITH {UNITS} SELECT case_id, unit_id, source_type, text FROM u")
def public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = conversation_units(spark, sf_dir).select("case_id", "unit_id", "source_type", "text").withColumn("frame_path", F.lit("/secret")).withColumn("source_uri", F.lit("file:///secret"))
    return package.public_units(u).select("case_id", "unit.unit_id", "unit.source_type", "unit.text")


@registered("SELECT conv_id AS case_id, i AS sequence, ['request','session','asr','ocr','visual_retrieval','vlm','runtime_unit_pool','mock_g1','result'][i] AS name, 'completed' AS status, 0.0::DOUBLE AS runtime_ms FROM (SELECT DISTINCT conv_id FROM conversations) CROSS JOIN (SELECT CAST(unnest(range(1, 10)) AS INT) AS i)")
def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.stage_events(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id")).distinct())


@registered("SELECT doc_id, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'success' ELSE 'failure' END AS status, CASE CAST(doc_id % 3 AS INT) WHEN 1 THEN 'runtime_execution_failed' WHEN 2 THEN 'result_packaging_failed' END AS code FROM documents")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("doc_id") % 3 == 1, "runtime").when(F.col("doc_id") % 3 == 2, "result_packaging")
    o = package.outcome(stage, F.lit("ValueError"))
    return table(spark, sf_dir, "documents").select("doc_id", o["status"].alias("status"), o["code"].alias("code"))


@registered("SELECT l_orderkey AS case_id, max(f) AS fake, max(r) AS real, arg_max(u, (f, u)) AS fake_winner, arg_max(u, (r, u)) AS real_winner, count(*) AS n_units FROM (SELECT l_orderkey, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS u, l_extendedprice / 10000 AS f, l_quantity / 10 AS r FROM lineitem) GROUP BY l_orderkey")
def pool_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-wise pooling over all line items, a case an order."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.format_string("%02d", "l_linenumber").alias("unit_id"), (F.col("l_extendedprice") / 10000).alias("fake"), (F.col("l_quantity") / 10).alias("real"))
    return scoring.pooled(li)


# ---------------------------------------------------------------- exposure, sufficiency, whole cases

SHOWN = (
    f"{LONG}, t AS (SELECT case_id, CASE WHEN n <= 12 THEN ordinal ELSE ((ordinal + 1) * 12 - 1) // n END AS bucket, n, ordinal, 'asr_' || lpad(CAST(ordinal AS VARCHAR), 4, '0') AS uid, text FROM l), "
    "tx AS (SELECT case_id, 0 AS part, bucket AS ord, CASE WHEN max(n) > 12 THEN 'transcript_exposure_' || lpad(CAST(bucket AS VARCHAR), 4, '0') ELSE min(uid) END AS unit_id, 'transcript' AS source_type, string_agg(text, ' ' ORDER BY ordinal) AS text, CAST(min(ordinal) AS DOUBLE) AS start_time, CASE WHEN max(n) > 12 THEN string_agg(uid, ',' ORDER BY ordinal) ELSE '' END AS members FROM t GROUP BY case_id, bucket), "
    "o AS (SELECT doc_id % 120 AS case_id, 'ocr_' || doc_id AS unit_id, text, nullif(n_chars % 11, 0) / 10.0::DOUBLE AS conf, nullif(doc_id % 7, 0) AS start, doc_id, n_chars % 5 AS raw FROM documents), "
    "q AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(conf, -1) DESC, raw DESC, doc_id) AS r FROM o), "
    "ox AS (SELECT case_id, 1 AS part, row_number() OVER (PARTITION BY case_id ORDER BY start NULLS LAST, unit_id) AS ord, unit_id, 'ocr' AS source_type, text, CAST(start AS DOUBLE) AS start_time, '' AS members FROM q WHERE r <= 6), "
    "e AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY part, ord) - 1 AS position FROM (SELECT * FROM tx UNION ALL SELECT * FROM ox)) "
)


def case_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.transcript_units(long_cases(spark, sf_dir).select("case_id", "ordinal", "text", "start_time", "end_time"))


def case_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    d = table(spark, sf_dir, "documents")
    return d.select(
        (F.col("doc_id") % 120).alias("case_id"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("ocr_"), F.col("doc_id").cast("string")).alias("unit_id"), F.lit(fixed.OCR).alias("source_type"), "text",
        F.nullif(F.col("doc_id") % 7, zero).cast("double").alias("start_time"), (F.nullif(F.col("n_chars") % 11, zero) / 10.0).alias("confidence"), (F.col("n_chars") % 5).cast("int").alias("raw_count"), F.col("doc_id").cast("int").alias("source_index"),
        F.lit(fixed.OCR_PRODUCER).alias("producer"), F.lit("paddleocr_v5_frame").alias("extraction_method"), F.lit(True).alias("eligible"),
    )


@registered(f"WITH {SHOWN} SELECT case_id, position, unit_id, source_type, text, start_time, members FROM e")
def scorer_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scorer is shown: merged transcripts with their members' ids, then the best texts in time."""
    e = exposure.exposure(case_transcripts(spark, sf_dir), case_texts(spark, sf_dir))
    return e.select("case_id", F.col("position").cast("long").alias("position"), "unit_id", "source_type", "text", "start_time", F.array_join("source_unit_ids", ",").alias("members"))


@registered("SELECT doc_id, CASE WHEN source_type <> 'transcript' THEN 'transcript_exposure_accepts_only_transcript_units' WHEN NOT eligible THEN 'transcript_exposure_units_must_be_eligible' ELSE 'ok' END AS first_violation FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'ocr' ELSE 'transcript' END AS source_type, n_chars >= 200 AS eligible FROM documents)")
def exposure_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "de", fixed.OCR).otherwise(fixed.TRANSCRIPT).alias("source_type"), (F.col("n_chars") >= 200).alias("eligible"))
    return exposure.guarded(d, fixed.TRANSCRIPT).select("doc_id", F.coalesce(F.get("violations", F.lit(0)), F.lit("ok")).alias("first_violation"))


VERIFIED = (
    f"WITH {SHOWN}, h AS (SELECT *, sha256('claim ' || case_id || chr(31) || unit_id || chr(31) || source_type || chr(31) || text) AS h FROM e), "
    f"s AS (SELECT case_id, unit_id, source_type, position, round({PART.format(at=1)}, 12) AS score, round({PART.format(at=17)} * 4.0 - 2.0, 12) AS fake, round({PART.format(at=33)} * 4.0 - 2.0, 12) AS real FROM h), "
    "p AS (SELECT case_id, max(fake) AS fake, max(real) AS real, count(*) AS exposed, count(*) FILTER (WHERE source_type = 'ocr') AS ocr FROM s GROUP BY case_id), "
    "k AS (SELECT case_id, string_agg(unit_id, ',' ORDER BY score DESC, unit_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, unit_id) AS r FROM s) WHERE r <= 5 GROUP BY case_id), "
    "v AS (SELECT doc_id % 150 AS case_id, count(*) AS visual FROM documents WHERE lang = 'es' GROUP BY ALL), "
    "c AS (SELECT DISTINCT doc_id % 150 AS case_id FROM documents) "
    "SELECT c.case_id, 'session-' || c.case_id AS session_id, CASE WHEN p.case_id IS NULL THEN 'NEI' WHEN fake >= real THEN 'Fake' ELSE 'Real' END AS display_verdict, "
    "CASE WHEN p.case_id IS NULL THEN 'no_frozen_g1_eligible_evidence' ELSE 'frozen_g1_evidence_available_and_model_completed' END AS reason_code, "
    "coalesce(exposed, 0) AS exposed, coalesce(ocr, 0) AS ocr, coalesce(visual, 0) AS visual, coalesce(top, '') AS top, round(fake, 9) AS fake, 'success' AS status FROM c LEFT JOIN p USING (case_id) LEFT JOIN k USING (case_id) LEFT JOIN v USING (case_id)"
)


def case_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("lang = 'es'")
    name = F.concat(F.lit("F"), F.col("doc_id").cast("string"))
    case = (F.col("doc_id") % 150).alias("case_id")
    rows = d.select(case, F.col("doc_id").alias("ordinal"), F.lit("scene").alias("observation_type"), F.col("source").alias("observation"), F.array(name).alias("frame_ids"), F.array(name).alias("evidence_refs"))
    seen = d.select(case, name.alias("frame_id"), F.col("doc_id").cast("double").alias("timestamp"), F.col("doc_id").alias("frame_index"))
    return observe.visual_units(rows, seen)


@registered(VERIFIED)
def verified_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cases, read back from their published documents: 120 with evidence for the scorer, the rest with visual units or none."""
    c = table(spark, sf_dir, "documents").select((F.col("doc_id") % 150).alias("case_id")).distinct()
    c = c.select("case_id", F.concat(F.lit("session-"), F.col("case_id").cast("string")).alias("session_id"), F.concat(F.lit("claim "), F.col("case_id").cast("string")).alias("claim"))
    v = cases.verified(c, case_transcripts(spark, sf_dir), case_texts(spark, sf_dir), case_visuals(spark, sf_dir))
    at = lambda path, kind="string": F.get_json_object("outcome", f"$.{path}").cast(kind)
    r = "result."
    top = F.from_json(at(f"{r}evidence.g1_top_k_explanation_unit_ids"), "array<string>")
    return v.select(
        "case_id", at(f"{r}session_id").alias("session_id"), at(f"{r}verdict.display_verdict").alias("display_verdict"), at(f"{r}sufficiency.reason_code").alias("reason_code"), at(f"{r}sufficiency.g1_exposure_count", "long").alias("exposed"),
        at(f"{r}sufficiency.ocr_exposure_count", "long").alias("ocr"), at(f"{r}sufficiency.visual_unit_count", "long").alias("visual"), F.array_join(top, ",").alias("top"), F.round(at(f"{r}verdict.sample_logits.fake", "double"), 9).alias("fake"), at("status").alias("status"),
    )


@registered("SELECT doc_id, CASE WHEN NOT regexp_full_match(sid, '[A-Za-z0-9_.-]{1,80}') THEN 'session_id' WHEN trim(claim) = '' THEN 'claim' WHEN media = '' THEN 'media_path' ELSE 'ok' END AS first_violation FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'a b' ELSE source END AS sid, CASE WHEN n_chars < 100 THEN '  ' ELSE 'c' END AS claim, CASE WHEN lang = 'de' THEN '' ELSE 'm' END AS media FROM documents)")
def request_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "fr", "a b").otherwise(F.col("source")).alias("session_id"), F.when(F.col("n_chars") < 100, "  ").otherwise("c").alias("claim"), F.when(F.col("lang") == "de", "").otherwise("m").alias("media_path"))
    return cases.request_violations(d).select("doc_id", F.coalesce(F.get("violations", F.lit(0)), F.lit("ok")).alias("first_violation"))


@registered("SELECT case_id, CASE WHEN src = 'visual_observation' AND shown THEN 'exposure_not_eligible_or_visual' WHEN dup THEN 'unit_ids_not_unique' WHEN sid THEN 'session_id_differs' WHEN st <> 'sufficient' THEN 'evidence_without_sufficient_status' WHEN d <> 'Fake' THEN 'display_differs_from_verdict' ELSE 'ok' END AS first_violation FROM (SELECT doc_id AS case_id, CASE WHEN lang = 'es' THEN 'visual_observation' ELSE 'ocr' END AS src, true AS shown, n_chars % 7 = 0 AS dup, n_chars % 5 = 0 AS sid, CASE WHEN lang = 'de' THEN 'insufficient' ELSE 'sufficient' END AS st, CASE WHEN n_chars % 3 = 0 THEN 'Real' ELSE 'Fake' END AS d FROM documents)")
def sufficiency_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case a document, with faults that follow from its fields; the first precondition that fails."""
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("double")
    unit = lambda i, kind, ok: F.struct(i.alias("unit_id"), kind.alias("source_type"), ok.alias("eligible"), none.alias("selection_score"), none.alias("fake"), none.alias("real"), none.alias("confidence"))
    kind = F.when(F.col("lang") == "es", fixed.VISUAL).otherwise(fixed.OCR)
    second = F.when(F.col("n_chars") % 7 == 0, "a").otherwise("v")
    shown, seen = F.array(unit(F.lit("a"), kind, F.lit(True))), F.array(unit(second, F.lit(fixed.VISUAL), F.lit(False)))
    ids = F.array(F.lit("a"), second)
    v = F.struct(
        F.when(F.col("n_chars") % 5 == 0, "other").otherwise("s").alias("session_id"), F.lit("c").alias("claim"), F.lit("fake").alias("model_verdict"), F.when(F.col("n_chars") % 3 == 0, "Real").otherwise("Fake").alias("display_verdict"),
        F.when(F.col("lang") == "de", "insufficient").otherwise("sufficient").alias("evidence_status"), ids.alias("all_ids"), shown.alias("top_k"),
    )
    c = d.select(F.col("doc_id").alias("case_id"), F.lit("s").alias("session_id"), F.lit("c").alias("claim"), shown.alias("exposure"), seen.alias("visual"), ids.alias("all_ids"), v.alias("verification"))
    return assess.assessed(c).select("case_id", F.coalesce(F.get("violations", F.lit(0)), F.lit("ok")).alias("first_violation"))


@registered("SELECT doc_id, CASE WHEN lang = 'de' THEN 'frame_ids_not_strings' WHEN lang = 'fr' THEN 'evidence_refs_not_strings' WHEN lang = 'es' THEN 'observation_type_not_string' ELSE 'ok' END AS first_violation, CASE WHEN lang = 'de' THEN 0 ELSE 2 END AS n_frames, text, CASE lang WHEN 'es' THEN NULL ELSE 'scene' END AS observation_type FROM documents")
def public_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published fields of a unit a document, with free-form details of the right and of wrong types."""
    frames_, refs = F.when(F.col("lang") == "de", "null").otherwise('["F1","F2"]'), F.when(F.col("lang") == "fr", '["F1",2]').otherwise("[]")
    kind = F.when(F.col("lang") == "es", "5").otherwise('"scene"')
    details = F.concat(F.lit('{"frame_ids":'), frames_, F.lit(',"evidence_refs":'), refs, F.lit(',"observation_type":'), kind, F.lit(',"path":"/secret"}'))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("unit_id"), F.lit(fixed.VISUAL).alias("source_type"), "text", F.lit(False).alias("eligible"), details.alias("details"))
    p = package.public_units(d.withColumnRenamed("doc_id", "case_id"))
    return p.select(F.col("case_id").alias("doc_id"), F.coalesce(F.get("violations", F.lit(0)), F.lit("ok")).alias("first_violation"), F.size("unit.frame_ids").alias("n_frames"), "unit.text", F.when(F.array_contains("violations", "observation_type_not_string"), None).otherwise(F.col("unit.observation_type")).alias("observation_type"))


# ---------------------------------------------------------------- text frames, whole responses

@registered("SELECT doc_id AS case_id, count(*) AS n, string_agg(x, '|' ORDER BY y, x0, i) AS read FROM (SELECT doc_id, i, lines[i] AS x, (i * 7) % 5 AS y, (i * 3) % 4 AS x0 FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i)) WHERE regexp_matches(x, '[^\\x09-\\x0d\\x1c-\\x20]') GROUP BY doc_id")
def raw_text_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a recogniser with parallel arrays, read top to bottom and left to right; every line is a detection."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.split("text", "\n").alias("rec_texts"))
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    at = lambda i: ((i + 1) * 3 % 4, (i + 1) * 7 % 5)
    polygons = F.transform("rec_texts", lambda t, i: F.array(point(*at(i)), point(at(i)[0] + 9, at(i)[1]), point(at(i)[0], at(i)[1] + 9)))
    reply = F.to_json(F.struct(F.struct("rec_texts", F.transform("rec_texts", lambda t: F.lit(0.5)).alias("rec_scores"), polygons.alias("dt_polys")).alias("res")))
    rows = frames.raw_detections(d.select("case_id", F.lit(0).alias("frame"), reply.alias("raw")))
    order = F.struct(F.col("box")[1].alias("a"), F.col("box")[0].alias("b"), "ordinal", "text")
    return rows.groupBy("case_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["text"]), "|").alias("read"))


@registered("SELECT doc_id // 20 AS case_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY frame) - 1 AS ordinal, frame, round(conf, 9) AS confidence FROM (SELECT doc_id, frame, conf, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY conf DESC, frame) AS q FROM (SELECT doc_id, doc_id AS frame, conf, row_number() OVER (PARTITION BY doc_id // 20, key ORDER BY conf DESC, doc_id) AS r FROM (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key, 0.5 + (n_chars % 50) / 100.0::DOUBLE AS conf FROM documents WHERE len(regexp_extract_all(text, '[\\p{L}\\p{N}]')) >= 3)) WHERE r = 1) WHERE q <= 6")
def text_frame_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with text as units: normalised, one for each folded text, the six best in order of rank."""
    d = table(spark, sf_dir, "documents")
    case = F.floor(F.col("doc_id") / 20).alias("case_id")
    box = F.array(*[F.lit(float(x)) for x in (0, 0, 1, 1)])
    det = d.select(case, F.col("doc_id").alias("frame"), F.lit(0).alias("ordinal"), "text", (0.5 + F.col("n_chars") % 50 / 100.0).alias("confidence"), box.alias("box"))
    seen = d.select(case, F.col("doc_id").alias("frame"), F.col("source").alias("frame_id"), F.col("doc_id").alias("frame_index"), F.col("source").alias("frame_path"), frames.timestamp(F.col("doc_id"), F.lit(25.0)).alias("timestamp"))
    u = frames.text_units(frames.frame_candidates(det), seen)
    return u.select("case_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("frame_rank").alias("frame"), F.round("confidence", 9).alias("confidence"))


@registered("SELECT label AS case_id, CASE WHEN label = 3 THEN 'scores_and_frames_differ_in_number' ELSE 'ok' END AS state, vec_id AS frame_index FROM embeddings")
def scores_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of scores against frames by position; one case has a score too few."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("case_id"), F.col("vec_id").alias("frame_index"))
    s = e.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list("frame_index")), lambda x: x.cast("double")).alias("scores"))
    s = s.withColumn("scores", F.when(F.col("case_id").cast("string") == "3", F.slice("scores", F.lit(1), F.size("scores") - 1)).otherwise(F.col("scores")))
    z = frames.zipped(e, s)
    wrong = F.get("violations", F.lit(0))
    matched = F.col("score").isNull() | (F.col("score") == F.col("frame_index"))
    return z.select("case_id", F.coalesce(wrong, F.when(matched, "ok"), F.lit("misplaced")).alias("state"), "frame_index")


RESPONSES = (
    POOLED + ", c AS (SELECT case_id, case_id % 9 AS k FROM p) SELECT case_id, CASE k WHEN 1 THEN 'max_length' WHEN 2 THEN 'claim' WHEN 3 THEN 'prediction_id' WHEN 4 THEN 'unknown_unit' WHEN 5 THEN 'selection_score' WHEN 6 THEN 'truncated_count' WHEN 7 THEN 'top_k_unknown' WHEN 8 THEN 'winner_fake_logit' ELSE 'ok' END AS first_violation FROM c"
)


@registered(RESPONSES)
def response_json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as JSON, built from scored cases; eight of nine with a fault of one kind, and what is found first."""
    s = scored_units(spark, sf_dir)
    k = F.col("case_id") % 9
    logits = lambda f, r: F.struct(f.alias("fake"), r.alias("real"))
    item = F.struct("ordinal", F.when((k == 4) & (F.col("ordinal") == 0), "none").otherwise(F.col("unit_id")).alias("unit_id"), F.lit("text").alias("modality"), F.when(k == 5, F.lit(None)).otherwise(F.col("selection_score")).alias("selection_score"), logits(F.col("fake"), F.col("real")).alias("veracity_logits"))
    per = s.groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("o"), F.array_sort(F.collect_list(F.struct("ordinal", "unit_id"))).alias("u")).join(scoring.pooled(s), "case_id")
    fake = F.col("fake") >= F.col("real")
    n = F.col("n_units")
    won = lambda label, at: F.struct(F.col(f"{label}_winner").alias("unit_id"), at.alias("veracity_logits"))
    winners = F.struct(won("fake", logits(F.when(k == 8, F.col("fake") + 1).otherwise(F.col("fake")), F.lit(0.0))).alias("fake"), won("real", logits(F.lit(0.0), F.col("real"))).alias("real"))
    constants = [F.lit(512 if c == "max_length" else v).alias(c) if c != "max_length" else F.when(k == 1, 512).otherwise(v).alias(c) for c, v in fixed.RESPONSE.items()]
    payload = F.struct(
        *constants, F.concat(F.lit("case-"), F.col("case_id").cast("string")).alias("case_id"), F.when(k == 2, "other").otherwise("c").alias("claim"), F.when(fake, "fake").otherwise("real").alias("prediction"),
        F.when(fake, F.when(k == 3, 1).otherwise(0)).otherwise(F.when(k == 3, 0).otherwise(1)).alias("prediction_id"), logits(F.col("fake"), F.col("real")).alias("sample_logits"), logits(F.lit(0.5), F.lit(0.5)).alias("probabilities"),
        n.alias("input_unit_count_before_contract"), F.transform("o", lambda x: x.dropFields("ordinal")).alias("unit_outputs"), n.alias("model_exposed_unit_count"), F.when(k == 6, 1).otherwise(0).alias("truncated_unit_count"),
        F.array(F.struct(F.when(k == 7, "none").otherwise(F.col("fake_winner")).alias("unit_id"))).alias("top_k_selection_units"), winners.alias("max_pool_winner_by_class"),
    )
    c = per.select("case_id", F.concat(F.lit("case-"), F.col("case_id").cast("string")).alias("session_id"), F.lit("c").alias("claim"), F.transform("u", lambda x: x["unit_id"]).alias("submitted"), F.to_json(payload).alias("payload"))
    return response.checked(c).select("case_id", F.coalesce(F.get("violations", F.lit(0)), F.lit("ok")).alias("first_violation"))


@registered(SCORED + "SELECT case_id, r - 1 AS position, unit_id, text FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY selection_score DESC, unit_id) AS r FROM s) WHERE r <= 5")
def explained_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units behind the ids of a case's explanation, in the order of the ids."""
    s = scored_units(spark, sf_dir)
    top = s.groupBy("case_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("selection_score")).alias("n"), "unit_id"))), 1, 5), lambda x: x["unit_id"]).alias("top_k"))
    return scoring.explained(top, conversation_units(spark, sf_dir)).select("case_id", F.col("position").cast("long").alias("position"), "unit_id", "text")


@registered(f"WITH {UNITS}, n AS (SELECT conv_id AS case_id, role FROM conversations) SELECT case_id, sequence, name, detail FROM (SELECT case_id, count(*) AS t FROM u GROUP BY case_id), (SELECT unnest(range(1, 10)) AS sequence), (SELECT 1) x, LATERAL (SELECT ['request','session','asr','ocr','visual_retrieval','vlm','runtime_unit_pool','mock_g1','result'][sequence] AS name, ['request accepted','deterministic session created', t || ' transcript units', '0 OCR units', '0 visual candidates', '0 visual observations', t || ' total units', least(t, 24) || ' eligible units evaluated', 'result assembled'][sequence] AS detail) d")
def stage_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = conversation_units(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("transcript"))
    zero = F.lit(0)
    c = n.withColumns({"ocr": zero, "visual": zero, "total": F.col("transcript"), "evaluated": F.least(F.col("transcript"), F.lit(scoring.MAX_UNITS))})
    return package.stage_details(c).select("case_id", F.col("sequence").cast("long").alias("sequence"), "name", "detail")


@registered("SELECT doc_id, CASE WHEN lang = 'en' THEN 'ok' WHEN lang = 'de' THEN 'failure_with_result_or_without_failure' WHEN lang = 'fr' THEN 'message_of_another_stage' ELSE 'exception_type' END AS first_violation FROM documents")
def outcome_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("lang")
    code, message = fixed.FAILURES["runtime"]
    v = package.outcome_violations(F.when(lang == "en", "success").otherwise("failure"), (lang == "en") | (lang == "de"), F.when(lang != "en", "runtime"), F.when(lang != "en", code), F.when(lang == "fr", "x").when(lang != "en", message), F.when(lang == "es", "").when(lang != "en", "ValueError"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.get(v, F.lit(0)), F.lit("ok")).alias("first_violation"))


from . import evidence  # noqa: E402, F401  registers its queries
