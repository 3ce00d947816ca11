"""Golden values of the scalar functions and operators."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import hashing, numeric, text
from evidentia.operators import observe, package, scoring, selection, units, validate
from evidentia.sources import config, records


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_samplers(spark):
    n = lambda x: F.lit(x).cast("long")
    assert one(spark, numeric.interior_positions(n(100))) == [11, 22, 33, 44, 55, 66, 77, 88]
    assert one(spark, numeric.interior_positions(n(5))) == [0, 1, 2, 3, 4]
    assert one(spark, numeric.interior_positions(n(10), 1)) == [5]
    assert one(spark, numeric.endpoint_positions(n(2661))) == [0, 242, 484, 725, 967, 1209, 1451, 1693, 1935, 2176, 2418, 2660]
    assert one(spark, numeric.endpoint_positions(n(0))) == []


def test_box(spark):
    p = F.lit(None)
    p = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((8, 2), (12, 4), (10, 9), (4, 7))])
    assert one(spark, numeric.bbox(p)) == [4.0, 2.0, 12.0, 9.0]
    assert one(spark, numeric.bbox(F.slice(p, 1, 2))) is None


def test_text(spark):
    assert one(spark, text.strip(F.lit("　\x1c a b "))) == "a b"
    assert one(spark, text.drop_code_fence(F.lit("```json\n[1]\n```"))) == "[1]"
    assert one(spark, text.drop_code_fence(F.lit("```json\n[1]"))) == "```json\n[1]"
    assert one(spark, text.fold_key(F.lit("ＡＢＣ  Straße"))) == "abc strasse"
    assert one(spark, text.alnum_count(F.lit("a-1 é漢"))) == 4


def test_session_ids(spark):
    j = F.lit("{}")
    assert one(spark, hashing.session_id(F.lit("ok-1"), j)) == "ok-1"
    assert one(spark, hashing.session_id(F.lit("bad\n"), j)).startswith("session-")
    assert one(spark, hashing.session_id(F.lit(None).cast("string"), j)).startswith("session-")


@pytest.mark.parametrize("n,sizes", [(31, [2, 3, 2, 3, 2, 3, 3, 2, 3, 2, 3, 3]), (5, [1] * 5)])
def test_buckets(spark, n, sizes):
    d = spark.range(n).select(F.lit(1).alias("case_id"), F.col("id").alias("ordinal"))
    got = selection.balanced_buckets(d, 12).groupBy("bucket").count().orderBy("bucket").collect()
    assert [r["count"] for r in got] == sizes


def test_empty_case_is_insufficient(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    s = spark.createDataFrame([(1, "u0", 1.0, 1.0), (1, "u1", 1.0, 0.5)], "case_id long, unit_id string, fake double, real double")
    v = {r["case_id"]: r for r in scoring.verdicts(cases, scoring.pooled(s)).collect()}
    assert (v[1]["fake_winner"], v[1]["model_verdict"], v[1]["p_fake"]) == ("u1", "fake", 0.5)
    assert (v[2]["model_verdict"], v[2]["display_verdict"], v[2]["evidence_status"]) == ("not_run", "NEI", "insufficient")


def test_visual_units_are_never_eligible(spark):
    d = spark.createDataFrame([(1, 0, '{"observation":"x"}', "m"), (1, 1, '{"text":" y ","confidence":null}', "m"), (1, 2, '{"text":"  ","frame_path":""}', "m")], "case_id long, ordinal int, item string, media_path string")
    seen = units.mock_units(d, "visual_observation").orderBy("ordinal").collect()
    assert [(r["unit_id"], r["text"], r["eligible"], r["retrieval_rank"]) for r in seen] == [("visual-000", "x", False, 0), ("visual-001", "", False, 1), ("visual-002", "", False, 2)]
    said = units.mock_units(d, "transcript").orderBy("ordinal").collect()
    assert [(r["text"], r["eligible"], r["confidence"]) for r in said] == [("", False, 1.0), ("y", True, None), ("", False, 1.0)]
    assert [r["source_uri"] for r in units.mock_units(d, "ocr").orderBy("ordinal").collect()] == ["m", "m", "m"]


def test_shapes(spark):
    mode = lambda s: one(spark, observe.recovery_mode(F.lit(s)))
    assert mode('{"observations": []}') == "canonical_object"
    assert mode('{"observations": null}') == "unsupported"
    assert mode("[]") == "top_level_array_wrapped"
    assert mode("[1, 2]") == "unsupported"
    assert mode('{"observations": [{}, 3]}') == "unsupported"
    assert mode('{"observation_type":"x","observation":1,"frame_ids":0,"evidence_refs":null}') == "single_observation_object_wrapped"
    assert mode("3") == "unsupported"
    assert mode("[1") == "not_json"
    assert mode("[1] x") == "not_json"


def test_transitions(spark):
    ok = lambda a, b: one(spark, package.transition_ok(F.lit(a), F.lit(b)))
    assert ok("pending", "running") and ok("running", "failed") and not ok("completed", "running")


def test_detection(spark):
    p = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((0, 0), (1, 0), (1, 1))])
    assert one(spark, validate.detection(F.lit(0.5), p, F.array(*[F.lit(float(x)) for x in (0, 0, 1, 1)]))) == []
    assert one(spark, validate.detection(F.lit(1.5), p, F.array(*[F.lit(float(x)) for x in (0, 0, 1, 2)]))) == ["invalid_confidence", "bbox_mismatch"]


def test_records(spark, tmp_path):
    doc = '{"session_id":"s","claim":"c","units":[{"unit_id":"a","eligible_for_frozen_g1":true},{"unit_id":"b","text":"t"}]}'
    u = records.units_of(spark.createDataFrame([(doc,)], "value string")).orderBy("ordinal").collect()
    assert [(r["unit_id"], r["text"], r["producer"], r["eligible"]) for r in u] == [("a", "", "unknown", True), ("b", "t", "unknown", False)]
    root = f"file://{tmp_path}"
    put = lambda *rows: records.put_documents(spark.createDataFrame(list(rows), "name string, document string"), root, "units", "name")
    put(("a", '{"x":1}'), ("b", "{}"))
    put(("b", '{"y":2}'))
    assert sorted(map(tuple, records.documents_of(spark, root, "units").collect())) == [("a", '{"x":1}'), ("b", '{"y":2}')]
    for bad in ("../x", "..", "a/b", ""):
        with pytest.raises(Exception, match="unsafe"):
            put((bad, "{}"))
    for bad in ("..", "a/b", "é", ""):
        with pytest.raises(ValueError, match="unsafe"):
            records.documents_of(spark, root, bad)
    results = spark.createDataFrame([("s1", '{"session_id":"s1"}')], "session_id string, document string")
    records.write_results(results, root)
    assert records.documents_of(spark, root, "results").count() == 1
    assert spark.read.json(f"{root}/logs").select("case_id", "event").first() == ("s1", "result_created")


def test_settings():
    assert config.flat("a: 1\n# c\nb: true\nc: 'x'\n") == {"a": 1, "b": True, "c": "x"}
    with pytest.raises(ValueError):
        config.RunSettings({"top_k": 6})
    with pytest.raises(ValueError):
        config.closed({"a": {"timeout_seconds": True}}, {"a": {"timeout_seconds"}})
    with pytest.raises(ValueError):
        config.closed({"a": {}, "b": {}}, {"a": set()})


def test_settings_files(tmp_path):
    (tmp_path / "configs").mkdir()
    f = tmp_path / "configs" / "run.yaml"
    f.write_text("# a run\n\ncache_root: 'cache'\noutput_root: /out/x/..\nmax_units: 24\nprofile: test\n")
    got = config.RunSettings.from_file(str(f)).values
    assert (got["cache_root"], got["output_root"], got["profile"], got["top_k"]) == (str(tmp_path / "cache"), "/out", "test", 5)
    for bad in ("cache_root: a\n", "cache_root: a\noutput_root: ./a\n", "cache_root: a\noutput_root: b\nmore: 1\n", "cache_root: a\noutput_root: b\nmax_length: 512\n", "cache_root a\n"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            config.RunSettings.from_file(str(f))


def test_effective_limits(spark):
    n = lambda *x: one(spark, numeric.effective_limit(*map(F.lit, x)))
    assert (n(64), n(64, 40), n(64, 0, -1, 1_000_000), n(5_000_000, 10**9), n(64, 99, 12)) == (64, 40, 64, 5_000_000, 12)


def test_verdicts_have_probabilities_where_they_have_scores(spark):
    rows = [(1, 0.5, 0.25, 0.6, 0.4), (2, 0.5, 0.25, 0.6, None), (3, 0.5, 0.25, None, None), (4, None, None, 0.5, 0.5), (5, None, None, None, None)]
    d = spark.createDataFrame(rows, "i int, fake double, real double, p_fake double, p_real double")
    d = d.withColumns({"model_verdict": F.when(F.col("fake").isNull(), "not_run").otherwise("fake"), "display_verdict": F.when(F.col("fake").isNull(), "NEI").otherwise("Fake"), "evidence_status": F.when(F.col("fake").isNull(), "insufficient").otherwise("sufficient")})
    assert {r["i"]: r["violations"] for r in validate.result(d).collect()} == {1: [], 2: ["probability_keys"], 3: ["probability_keys"], 4: ["probability_keys"], 5: []}
    assert {r["i"]: r["violations"] for r in validate.result(d.drop("p_real")).collect()} == dict.fromkeys(range(1, 6), [])
