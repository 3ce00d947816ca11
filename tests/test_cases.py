"""Whole cases, responses, exposure and packaging on small documents."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia import fixed
from evidentia.operators import cases, exposure, frames, observe, package, response, stages, units


def obs(**kw):
    return {"observation_type": "scene", "observation": "a red car stands there", "frame_ids": ["F000"], "evidence_refs": ["F000"]} | kw


@pytest.fixture(scope="module")
def transcripts(spark):
    rows = [("c1", i, f"seg {i}", float(i), i + 1.0) for i in range(31)] + [("c2", 0, "only", None, None)]
    return units.transcript_units(spark.createDataFrame(rows, "case_id string, ordinal int, text string, start_time double, end_time double"))


@pytest.fixture(scope="module")
def texts(spark):
    pay = {"res": {"rec_texts": ["Hello world", "  ", "low down"], "rec_scores": [0.9, 0.8, 0.7], "rec_polys": [[[5, 5], [6, 5], [6, 9]], [[0, 0], [1, 0], [1, 1]], [[1, 1], [2, 1], [2, 2]]]}}
    replies = spark.createDataFrame([("c1", 0, json.dumps(pay)), ("c1", 1, json.dumps({"rec_texts": ["a"], "rec_scores": []})), ("c1", 2, "[]")], "case_id string, frame int, raw string")
    found = frames.raw_detections(replies)
    assert sorted((r["frame"], tuple(r["violations"])) for r in found.filter("text is null").collect()) == [(1, ("arrays_of_unequal_length",)), (2, ("malformed_payload",))]
    seen = spark.createDataFrame([("c1", 0, "frame_0000_000000", 0, "/p", 1.5)], "case_id string, frame int, frame_id string, frame_index int, frame_path string, timestamp double")
    return frames.text_units(frames.frame_candidates(found.filter("text is not null")), seen)


@pytest.fixture(scope="module")
def visual(spark):
    replies = [("c1", json.dumps({"observations": [obs(), 3]})), ("c2", json.dumps([obs(observation="it ſeems to be red"), obs(frame_ids=[], evidence_refs=["F009"])])), ("c3", "[1, 2]"), ("c4", "```json\r\n" + json.dumps(obs()) + "\r\n```"), ("c5", json.dumps([obs(frame_ids=["F001", "F000"])]))]
    found = observe.parsed(spark.createDataFrame(replies, "case_id string, raw string"))
    kept = observe.filtered(found, F.array(F.lit("F000"), F.lit("F001")))
    why = {(r["case_id"], r["ordinal"]): r["reasons"] for r in kept.collect()}
    assert why == {("c2", 0): ["risky_inference_or_ocr_language"], ("c2", 1): ["invalid_frame_ids", "unknown_evidence_refs"], ("c4", 0): [], ("c5", 0): []}
    seen = spark.createDataFrame([(c, "F000", 2.0, 5, "/f0") for c in ("c4", "c5")] + [("c5", "F001", None, 3, "/f1")], "case_id string, frame_id string, timestamp double, frame_index int, frame_path string")
    return observe.visual_units(kept.filter("size(reasons) = 0"), seen)


ODD = [
    {"res": {"_": "x", "rec_texts": ["a", None, " "], "rec_scores": [0.5, 1, 2], "dt_polys": [[[0, 0], [1, 0], [1, 1]]] * 3}}, {"_": 1, "rec_texts": ["b", "c"], "rec_scores": [2, 0.5], "rec_polys": None, "dt_polys": [[[0, 0], [1, 0], [1, 1]], [[0, 0]]]},
    {"res": None, "rec_texts": []}, {"res": [], "rec_texts": []}, {"res": {}}, {}, 5, {"res": {"rec_texts": ["d"]}},
]


def test_raw_detections_parse_once(spark):
    found = frames.raw_detections(spark.createDataFrame([(i, 0, json.dumps(x)) for i, x in enumerate(ODD)] + [(8, 0, "{"), (9, 0, None)], "case_id int, frame int, raw string"))
    got = sorted(((r["case_id"], r["ordinal"], r["text"], r["box"], r["violations"]) for r in found.collect()), key=str)
    bad = lambda i, why: (i, None, None, None, [why])
    box = [0.0, 0.0, 1.0, 1.0]
    assert got == [(0, 0, "a", box, []), (1, 0, "b", box, ["invalid_confidence"]), (1, 1, "c", None, ["invalid_polygon"]), *[bad(i, "malformed_payload") for i in (2, 3, 6)], bad(7, "arrays_of_unequal_length"), bad(8, "malformed_payload"), bad(9, "malformed_payload")]
    # the optimizer may not write the parsing out again wherever it is read
    few = found.groupBy("case_id").agg(F.count("*").alias("n"), F.max("box").alias("box"))
    assert few._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1


def test_text_units(texts):
    r = texts.first()
    assert (r["unit_id"], r["text"], r["bbox"], r["confidence"], r["raw_count"], r["source_type"]) == ("ocr_0000", "low down Hello world", [1.0, 1.0, 6.0, 9.0], 0.8, 2, "ocr")


def test_units_say_where_they_come_from(texts, visual):
    told = json.loads(texts.first()["details"])
    assert [(d["text"], d["confidence"], d["polygon"], d["runtime_bbox"]) for d in told["accepted_detections"]] == [("low down", 0.7, [[1, 1], [2, 1], [2, 2]], [1, 1, 2, 2]), ("Hello world", 0.9, [[5, 5], [6, 5], [6, 9]], [5, 5, 6, 9])]
    assert told["normalized_detection_texts"] == ["low down", "Hello world"]
    seen = {r["case_id"]: json.loads(r["details"])["referenced_frames"] for r in visual.collect()}
    assert [(f["frame_id"], f["timestamp_sec"], f["frame_index"], f["frame_path"]) for f in seen["c5"]] == [("F000", 2.0, 5, "/f0"), ("F001", None, 3, "/f1")]
    assert set(seen["c4"][0]) == {"frame_id", "frame_path", "frame_index", "timestamp_sec", "frame_rank", "image_sha256", "retrieval_score", "retrieval_rank"}


def test_visual_units(visual):
    got = {r["case_id"]: r for r in visual.collect()}
    assert set(got) == {"c4", "c5"}
    assert (got["c5"]["frame_id"], got["c5"]["start_time"], got["c5"]["eligible"], got["c5"]["violations"]) == ("F000", 2.0, False, [])
    assert got["c4"]["unit_id"].startswith("visual_") and len(got["c4"]["unit_id"]) == 27


def test_unknown_frames_make_no_unit(spark):
    o = spark.createDataFrame([("c", 0, "scene", "something there", ["F9"], ["F9"])], "case_id string, ordinal int, observation_type string, observation string, frame_ids array<string>, evidence_refs array<string>")
    seen = spark.createDataFrame([("c", "F0", 1.0, 0)], "case_id string, frame_id string, timestamp double, frame_index int")
    assert observe.visual_units(o, seen).first()["violations"] == ["unknown_frame", "no_frame"]


def test_exposure(transcripts, texts):
    e = [r for r in exposure.exposure(transcripts, texts).orderBy("case_id", "position").collect()]
    assert [len(r["source_unit_ids"]) for r in e if r["case_id"] == "c1"] == [2, 3, 2, 3, 2, 3, 3, 2, 3, 2, 3, 3, 0]
    assert [(r["unit_id"], r["producer"]) for r in e if r["case_id"] == "c2"] == [("asr_0000", fixed.WHISPER[0])]
    assert e[0]["source_producers"] == [fixed.WHISPER[0]] * 2 and e[0]["producer"] == fixed.EXPOSURE_PRODUCER
    with pytest.raises(ValueError):
        exposure.exposure(transcripts, texts, groups=0)


def test_whole_cases(spark, transcripts, texts, visual):
    c = spark.createDataFrame([(f"c{i}", f"s{i}", f"claim {i}") for i in range(1, 6)], "case_id string, session_id string, claim string")
    got = {r["case_id"]: r for r in cases.verified(c, transcripts, texts, visual).collect()}
    assert {k: r["violations"] for k, r in got.items()} == {f"c{i}": [] for i in range(1, 6)}
    for k, r in got.items():
        out = json.loads(r["outcome"])
        assert r["outcome"] == json.dumps(out, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert out["status"] == "success" and out["failure"] is None
        result = out["result"]
        run = k in ("c1", "c2")
        assert result["sufficiency"]["model_was_run"] is run and (result["verdict"]["display_verdict"] in ("Fake", "Real")) is run
        assert set(result["verdict"]["sample_logits"]) == ({"fake", "real"} if run else set())
        assert len(result["evidence"]["visual_supplemental_units"]) == (k in ("c4", "c5"))
        for u in result["evidence"]["g1_exposure_units"] + result["evidence"]["visual_supplemental_units"]:
            assert set(u) == set(package.PUBLIC)
    assert got["c3"]["warnings"] == [fixed.NO_EVIDENCE, fixed.VISUAL_ONLY]
    assert len(json.loads(got["c1"]["document"])["evidence"]["g1_top_k_explanation_unit_ids"]) == 5


def payload(**kw):
    unit = lambda i, f, r: {"unit_id": i, "modality": "text", "selection_score": 0.5, "veracity_logits": {"fake": f, "real": r}}
    won = lambda i, f, r: {"unit_id": i, "veracity_logits": {"fake": f, "real": r}}
    return json.dumps(fixed.RESPONSE | {
        "case_id": "s", "claim": "c", "prediction": "fake", "prediction_id": 0, "sample_logits": {"fake": 2.0, "real": 1.0}, "probabilities": {"fake": 0.7, "real": 0.3}, "input_unit_count_before_contract": 3,
        "unit_outputs": [unit("a", 2.0, -1.0), unit("b", 0, 1.0)], "model_exposed_unit_count": 2, "truncated_unit_count": 1, "top_k_selection_units": [{"unit_id": "b"}, {"unit_id": "a"}],
        "max_pool_winner_by_class": {"fake": won("a", 2.0, 0.0), "real": won("b", 0.0, 1.0)},
    } | kw)


FAULTS = {
    None: {}, "max_length": {"max_length": 256.0}, "dropped_visual_unit_count": {"dropped_visual_unit_count": False}, "case_id": {"case_id": "x"}, "prediction": {"prediction": "maybe"}, "prediction_id": {"prediction_id": False},
    "sample_logits": {"sample_logits": {"fake": 2.0}}, "probabilities": {"probabilities": {"fake": True, "real": 0.3}}, "input_count": {"input_unit_count_before_contract": 3.0}, "unit_outputs": {"unit_outputs": {}}, "exposed_count": {"model_exposed_unit_count": -2},
    "truncated_count": {"truncated_unit_count": 0}, "top_k": {"top_k_selection_units": None}, "top_k_duplicate": {"top_k_selection_units": [{"unit_id": "a"}, {"unit_id": "a"}]}, "top_k_unit_id": {"top_k_selection_units": [{"unit_id": 3}]},
    "top_k_unknown": {"top_k_selection_units": [{"unit_id": "c"}]}, "winners": {"max_pool_winner_by_class": {"fake": {"unit_id": "a", "veracity_logits": {"fake": 2.0, "real": 0.0}}}},
}


def test_responses(spark):
    rows = [(str(k), "s", "c", ["a", "b", "c"], payload(**kw)) for k, kw in FAULTS.items()] + [("payload", "s", "c", ["a"], "nope")]
    d = spark.createDataFrame(rows, "case_id string, session_id string, claim string, submitted array<string>, payload string")
    got = {r["case_id"]: r["violations"] for r in response.checked(d).collect()}
    assert {k: (v or ["None"])[0] for k, v in got.items()} == {k: k for k in got}
    assert {(r["unit_id"], r["fake"]) for r in response.unit_outputs(d).collect()} == {("a", 2.0), ("b", 0.0)}


def test_unit_faults_come_in_order(spark):
    bad = [{"unit_id": "z", "modality": "text", "selection_score": 1, "veracity_logits": {"fake": 1, "real": 1}}, {"unit_id": "a", "modality": "video", "selection_score": True, "veracity_logits": {"fake": 1, "real": 1, "x": 1}}, {"unit_id": "a", "modality": "ocr", "selection_score": 1, "veracity_logits": {"fake": 1, "real": 1}}]
    d = spark.createDataFrame([("k", "s", "c", ["a", "b", "c"], payload(unit_outputs=bad))], "case_id string, session_id string, claim string, submitted array<string>, payload string")
    assert response.checked(d).first()["violations"][:5] == ["unknown_unit", "modality", "selection_score", "veracity_logits", "duplicate_unit"]


def test_public_units_hide_and_check(spark):
    d = spark.createDataFrame([(1, '{"frame_ids":["a"],"secret":1}'), (2, '{"frame_ids":null}'), (3, '{"evidence_refs":["a",1]}'), (4, '{"observation_type":4}'), (5, None), (6, '{"frame_ids":[]}')], "case_id int, details string")
    u = d.withColumns({"unit_id": F.lit("u"), "source_type": F.lit("ocr"), "text": F.lit("t"), "frame_path": F.lit("/secret"), "eligible": F.lit(True)})
    got = {r["case_id"]: (r["violations"], r["unit"]["frame_ids"]) for r in package.public_units(u).collect()}
    assert got == {1: ([], ["a"]), 2: (["frame_ids_not_strings"], []), 3: (["evidence_refs_not_strings"], []), 4: (["observation_type_not_string"], []), 5: ([], []), 6: ([], [])}
    assert "secret" not in package.public_units(u).select(F.to_json("unit").alias("j")).first()["j"]


def test_stage_order(spark):
    full = ["pending", "running", "completed"]
    rows = [("a", i + 1, n, full) for i, n in enumerate(fixed.STAGES)] + [("b", 1, "session", full)] + [("c", 1, "request", ["pending", "completed"])] + [("d", 2, "session", full)]
    d = spark.createDataFrame(rows, "case_id string, sequence int, name string, statuses array<string>")
    got = {r["case_id"]: r["violations"] for r in package.stage_order(d).collect()}
    assert got == {"a": [], "b": ["stage_order"], "c": ["stage_transition"], "d": ["stage_order"]}


def test_stages_load_once_and_report_failures(spark):
    import pyarrow as pa

    rows = spark.createDataFrame([("a", "x"), ("b", "boom")], "key string, text string").coalesce(1)
    got = stages.staged(rows, stages.digest_embedder(4), "key string, embedding array<float>").collect()
    assert [len(r["embedding"]) for r in got] == [4, 4] and abs(sum(x * x for x in got[0]["embedding"]) - 1) < 1e-5

    def load():
        def work(b):
            raise ValueError("no model")

        return work

    failed = lambda b, e: pa.RecordBatch.from_arrays([b.column(0), pa.array([type(e).__name__] * b.num_rows)], names=["key", "failure"])
    assert {r["failure"] for r in stages.staged(rows, load, "key string, failure string", failed).collect()} == {"ValueError"}


def test_requests(spark):
    d = spark.createDataFrame([(1, "ok", "c", "/m"), (2, "a b", " ", None), (3, None, "c", "/m")], "case_id int, session_id string, claim string, media_path string")
    assert {r["case_id"]: r["violations"] for r in cases.request_violations(d).collect()} == {1: [], 2: ["session_id", "claim", "media_path"], 3: ["session_id"]}


def test_request_stream(spark, tmp_path):
    from evidentia.streaming.cases import verify_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"claim": "c", "request_id": "r1", "transcript_segments": [{"text": "hello"}]}))
    q = verify_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/chk", lambda b: b.select("request_id", F.size("transcript_segments").alias("n")))
    q.awaitTermination(120)
    assert spark.read.json(f"file://{tmp_path}/out").select("request_id", "n").first() == ("r1", 1)


def test_a_failing_row_fails_alone(spark):
    import pyarrow as pa

    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def model(b):
            if "boom" in b["text"].to_pylist():
                raise ArithmeticError("boom")
            n = b.num_rows
            return pa.RecordBatch.from_pydict({"selection_score": [0.5] * n, "fake": [1.0] * n, "real": [2] * n})

        return model

    rows = spark.createDataFrame([(i // 10, f"u{i}", "c", "ocr", "boom" if i in (7, 500) else "fine") for i in range(1000)], "case_id int, unit_id string, claim string, source_type string, text string").coalesce(1)
    got = stages.scorer(load)(rows).collect()
    assert len(got) == 1000 and loads.value == 1
    assert {r["unit_id"]: (r["case_id"], r["failure"], r["fake"]) for r in got if r["failure"]} == {"u7": (0, "ArithmeticError", None), "u500": (50, "ArithmeticError", None)}
    assert {(r["selection_score"], r["fake"], r["real"]) for r in got if not r["failure"]} == {(0.5, 1.0, 2.0)}

    def no_load():
        raise OSError("no asset")

    assert {r["failure"] for r in stages.scorer(no_load)(rows).collect()} == {"OSError"}


def test_cases_fail_by_themselves(spark, texts, visual):
    segments = [("c1", 0, "fine", True, "transcript"), ("c1", 1, " ", True, "transcript"), ("c2", 0, "barred", False, "transcript"), ("c3", 0, "misplaced", True, "ocr"), ("c6", 0, "good", True, "transcript"), ("c4", 0, "good", True, "transcript")]
    s = spark.createDataFrame(segments, "case_id string, ordinal int, text string, ok boolean, kind string")
    t = units.transcript_units(s, keep=("ok", "kind")).withColumns({"eligible": F.col("eligible") & F.col("ok"), "source_type": F.col("kind")}).drop("ok", "kind")
    c = spark.createDataFrame([(f"c{i}", f"s{i}" if i < 7 else "no id", f"claim {i}") for i in range(1, 8)], "case_id string, session_id string, claim string")
    got = {r["case_id"]: r for r in cases.verified(c, t, texts.filter("false"), visual).collect()}
    assert {k: (r["failure"]["stage"], r["failure"]["violation"]) for k, r in got.items() if r["failure"]} == {
        "c1": ("transcripts", "blank_transcript"), "c2": ("transcript_exposure", "transcript_exposure_units_must_be_eligible"), "c3": ("transcript_exposure", "transcript_exposure_accepts_only_transcript_units"), "c7": ("request", "session_id"),
    }
    assert {k for k, r in got.items() if json.loads(r["outcome"])["status"] == "success"} == {"c4", "c5", "c6"}
    out = json.loads(got["c2"]["outcome"])
    assert out["result"] is None and out["failure"] == {"code": "runtime_execution_failed", "exception_type": "ValueError", "public_message": fixed.FAILURES["runtime"][1], "stage": "runtime"}
    assert got["c2"]["document"] is None and got["c2"]["verification"] is None
