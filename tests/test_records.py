"""Records as they are read and written: requests, payloads, arrays of units, results, lines for the console, scored results."""

import json

from pyspark.sql import functions as F

from evidentia import fixed
from evidentia.operators import scoring, units
from evidentia.sources import records

UNIT = {"unit_id": "u1", "source_type": "ocr", "text": None, "start_time": 0.5, "bbox": [0, 1, 2, 3], "provenance": {"source_uri": "/v", "source_index": 3, "extraction_method": "m", "details": {"b": [1, "x"], "a": None}}, "eligible_for_frozen_g1": True, "logits": {"fake": 1e-05, "real": 2}}


def test_payloads_are_read_written_and_read(spark):
    given = {"session_id": "s", "claim": 'c"\n', "units": [UNIT, {"unit_id": "u2", "source_type": "transcript", "text": "t"}]}
    read = records.units_of(spark.createDataFrame([(json.dumps(given),), ("{",)], "value string"))
    rows = {r["unit_id"]: r for r in read.collect()}
    assert (rows["u1"]["text"], rows["u1"]["producer"], rows["u1"]["source_index"], rows["u1"]["fake"], rows["u1"]["bbox"]) == ("", "unknown", 3, 1e-05, [0.0, 1.0, 2.0, 3.0])
    assert (rows["u2"]["eligible"], rows["u2"]["ordinal"]) == (False, 1)
    c = spark.createDataFrame([("s", "s", 'c"\n'), ("none", "n", "x")], "case_id string, session_id string, claim string")
    out = {r["case_id"]: r["document"] for r in records.payloads(c, read).collect()}
    assert out["none"] == '{"claim":"x","session_id":"n","units":[]}'
    got = json.loads(out["s"])
    assert out["s"] == json.dumps(got, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got["units"][0]["provenance"] == UNIT["provenance"] and got["units"][0]["logits"] == {"fake": 1e-05, "real": 2.0} and got["units"][1]["logits"] is None
    again = records.units_of(spark.createDataFrame([(out["s"],)], "value string"))
    assert sorted(map(str, again.drop("details").collect())) == sorted(map(str, read.drop("details").collect()))


def test_arrays_of_units_and_malformed_payloads(spark):
    rows = [("a", json.dumps([UNIT])), ("b", "[]")]
    got = records.array_units_of(spark.createDataFrame(rows, "case_id string, value string")).collect()
    assert [(r["case_id"], r["unit_id"], r["eligible"]) for r in got] == [("a", "u1", True)]
    texts = ["{", "[1]", "{}", '{"session_id":"s","claim":1}', '{"session_id":"s","claim":"c","units":[1]}', '{"session_id":"s","claim":"c","units":[{}]}', '{"session_id":"s","claim":"c","units":[]}', None]
    d = records.payload_violations(spark.createDataFrame(list(enumerate(texts)), "i int, value string"))
    assert {r["i"]: (r["violations"] or [""])[0] for r in d.collect()} == {0: "not_json", 1: "not_an_object", 2: "session_id", 3: "claim", 4: "units", 5: "unit_id", 6: "", 7: "not_json"}


def test_requests_and_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r.json").write_text(json.dumps({"claim": "c", "request_id": "r", "media_path": "/m", "transcript_segments": [{"text": "t", "start_time": 1}], "metadata": {"x": [1]}}, indent=1))
    r = records.read_requests(spark, f"file://{tmp_path}/in").select("claim", "request_id", "transcript_segments", F.to_json("metadata").alias("m"), "visual_inputs").first()
    assert (r["claim"], r["request_id"], r["transcript_segments"][0]["start_time"], r["m"], r["visual_inputs"]) == ("c", "r", 1.0, '{"x":[1]}', None)
    result = {"session_id": "s", "claim": "c", "model_verdict": "fake", "sample_logits": {"fake": 1.5, "real": 0.5}, "top_k_units": [UNIT], "warnings": ["w"], "pipeline_stages": [{"name": "request", "sequence": 1}], "runtime_ms": 2.5}
    got = records.results_of(spark.createDataFrame([(json.dumps(result),)], "value string")).first()
    assert (got["session_id"], got["sample_logits"]["fake"], got["top_k_units"][0]["unit_id"], got["warnings"], got["pipeline_stages"][0]["name"], got["runtime_ms"]) == ("s", 1.5, "u1", ["w"], "request", 2.5)


def test_lines_for_the_console(spark):
    d = spark.createDataFrame([('{"status":"success"}',), ('{"status":"failure"}',)], "outcome string").coalesce(1)
    assert list(records.stdout_lines(d)) == [('{"status":"success"}', 0), ('{"status":"failure"}', 1)]


def test_requests_of_a_scorer_and_its_results(spark):
    rows = [("a", i, f"u{i}", k, t, e, 9.0) for i, (k, t, e) in enumerate([(fixed.TRANSCRIPT, "one", True), (fixed.OCR, "two", True), (fixed.VISUAL, "three", False), (fixed.OCR, "four", False)])]
    rows += [("b", 0, "v", fixed.OCR, " ", True, 9.0), ("b", 1, "v", fixed.OCR, "x", True, 9.0), ("c", 0, "w", fixed.VISUAL, "y", False, 9.0)]
    u = spark.createDataFrame(rows, "case_id string, ordinal int, unit_id string, source_type string, text string, eligible boolean, fake double").withColumns({"real": F.col("fake"), "selection_score": F.col("fake")})
    got = {r["case_id"]: ([tuple(x) for x in r["units"]], r["violations"]) for r in units.request_units(u).collect()}
    assert got == {"a": ([("u0", "transcript", "text", "one"), ("u1", "ocr", "ocr", "two")], []), "b": ([("v", "ocr", "ocr", " "), ("v", "ocr", "ocr", "x")], ["blank_text", "duplicate_unit_id"])}
    asked = spark.createDataFrame([("a", "sa", "ca"), ("b", "sb", "cb"), ("c", "sc", "cc")], "case_id string, session_id string, claim string")
    sent = {r["case_id"]: (r["violations"], r["document"]) for r in units.scorer_requests(asked, u).collect()}
    one = {"case_id": "sa", "claim": "ca", "dataset": "external", "candidate_units": [{"unit_id": "u0", "unit_type": "transcript", "modality": "text", "text": "one"}, {"unit_id": "u1", "unit_type": "ocr", "modality": "ocr", "text": "two"}]}
    assert sent["a"] == ([], json.dumps(one, sort_keys=True, separators=(",", ":")))
    assert sent["b"] == (["blank_text", "duplicate_unit_id"], None) and json.loads(sent["c"][1])["candidate_units"] == []
    outputs = spark.createDataFrame([("a", "u0", 0.5, 1.0, 2.0)], "case_id string, unit_id string, selection_score double, fake double, real double")
    c = spark.createDataFrame([("a",), ("c",)], "case_id string")
    back = {(r["case_id"], r["unit_id"]): (r["fake"], r["warnings"]) for r in scoring.scored_result(c, u, outputs).collect()}
    both = [fixed.VISUAL_EXCLUDED, fixed.TRUNCATED]
    assert back == {("a", "u0"): (1.0, both), ("a", "u1"): (None, both), ("a", "u2"): (None, both), ("a", "u3"): (None, both), ("c", "w"): (None, [fixed.VISUAL_EXCLUDED])}
