"""Rules against plain checks of the same documents."""

import copy
import json

from evidentia.operators import rules

GOOD = {
    "schema_version": 1, "profile": "production", "cache_root": "cache", "output_root": "out", "whisper": {"model_path": "m", "device": "cpu", "dtype": "float16"},
    "ocr": {"detector_model_path": "d", "recognizer_model_path": "r", "python_executable": "py", "device": "gpu:0", "cudnn8_library_path": "c", "timeout_seconds": 300}, "siglip": {"model_path": "m", "device": "cpu"}, "qwen": {"model_path": "m", "device": "cpu"},
    "frozen_g1": {"unirumor_root": "u", "python_executable": "py", "phase4a_infer": "i", "phase4a_config": "c", "device": "cpu", "timeout_seconds": 1.5},
}


def with_(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


SETTINGS = [
    (json.dumps(GOOD), []), ("nope", ["not_json"]), ("[]", ["$:not_an_object"]), (with_(["x"], 1), ["$:unknown_fields"]), (with_(["qwen"], KeyError), ["$:missing_fields"]), (with_(["qwen"], 1), ["$.qwen:not_an_object"]),
    (with_(["ocr", "y"], 1), ["$.ocr:unknown_fields"]), (with_(["ocr", "device"], KeyError), ["$.ocr:missing_fields"]), (with_(["ocr", "device"], " 　"), ["$.ocr.device:not_a_nonblank_string"]), (with_(["ocr", "device"], 5), ["$.ocr.device:not_a_nonblank_string"]),
    (with_(["whisper", "dtype"], "int8"), ["$.whisper.dtype:not_one_of"]), (with_(["whisper", "dtype"], None), ["$.whisper.dtype:not_one_of"]), (with_(["ocr", "timeout_seconds"], True), ["$.ocr.timeout_seconds:not_above_0"]), (with_(["ocr", "timeout_seconds"], 0), ["$.ocr.timeout_seconds:not_above_0"]),
    (with_(["ocr", "timeout_seconds"], "5"), ["$.ocr.timeout_seconds:not_above_0"]), (with_(["schema_version"], 1.0), ["$.schema_version:not_equal"]), (with_(["schema_version"], True), ["$.schema_version:not_equal"]), (with_(["profile"], "test"), ["$.profile:not_equal"]),
    (with_(["output_root"], "/base/x/../cache/."), ["$:roots_not_distinct"]), (with_(["output_root"], "./cache//"), ["$:roots_not_distinct"]), (with_(["output_root"], "../cache"), []),
]


def test_settings(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(SETTINGS)], "i int, document string")
    got = {r["i"]: r["violations"][:1] for r in rules.settings(df, "/base").collect()}
    assert {i: got[i] for i in got} == {i: v for i, (_, v) in enumerate(SETTINGS)}


def test_recognised_outputs(spark):
    asked = [(0, 5, 0.5, "f0", "/p0"), (1, 9, 1.0, "f1", "/p1")]
    names = list(rules.CARRIED)
    frames = [dict(zip(names, a)) | {"detections": []} for a in asked]
    good = {"schema_version": 1, "status": "ok", "session_id": "s", "models": {"b": 1, "a": {"y": "2", "x": "1"}}, "frames": frames, "more": 1}
    moved = [frames[0], frames[1] | {"frame_id": "f2", "timestamp_sec": 2.0}]
    rows = [
        (good, []), (good | {"status": "no", "frames": []}, ["$.status:not_equal", "$.frames:not_as_many"]), (good | {"session_id": "t"}, ["$.session_id:mismatch"]), (good | {"models": {}}, ["$.models:not_the_same"]),
        (good | {"frames": moved}, ["$.frames[].timestamp_sec:mismatch", "$.frames[].frame_id:mismatch"]), (good | {"frames": [frames[0], 3]}, ["$.frames[]:not_an_object"]), ([1], ["$:not_an_object"]),
    ]
    df = spark.createDataFrame([(i, "s", asked, json.dumps(d)) for i, (d, _) in enumerate(rows)], "i int, session_id string, requested array<struct<frame_rank:bigint,frame_index:bigint,timestamp_sec:double,frame_id:string,frame_path:string>>, document string")
    got = {r["i"]: r["violations"] for r in rules.recognised(df, '{"a":{"x":"1","y":"2"},"b":1}').collect()}
    assert {i: got[i][: len(v) or 1] for i, (_, v) in enumerate(rows)} == {i: v for i, (_, v) in enumerate(rows)}


def test_checks_are_compiled(spark):
    """No check may stand below a filter with a lambda, which Spark interprets with all that is in it, and no section is looked at again for each field."""
    rows = rules.settings(spark.createDataFrame([(json.dumps(GOOD),)], "document string"), "/base")
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "filter(" not in plan and "variantget($" not in plan and plan.count("map<string,variant>") + plan.count("maptype") <= 6
    assert rows.first()["violations"] == [] and rows.columns == ["document", "violations"]
