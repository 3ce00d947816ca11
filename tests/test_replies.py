"""Recogniser replies against a plain version that follows the rules one chunk at a time."""

import json
import math
import random

from pyspark.sql import functions as F

from evidentia import fixed
from evidentia.operators import replies


def plain(raw):
    """(segments, violation) by the rules, in order."""
    try:
        out = json.loads(raw) if raw is not None else None
    except ValueError:
        return None, "not_json"
    if raw is None:
        return None, "not_json"
    if not isinstance(out, dict):
        return None, "output_not_an_object"
    chunks = out.get("chunks")
    if chunks is None:
        text = str(out.get("text", "")).strip()
        return ([(text, None, None)] if text else []), None
    if not isinstance(chunks, list):
        return None, "chunks_not_a_list"
    found, last = [], [None, None]
    for c in chunks:
        if not isinstance(c, dict):
            return None, "chunk_not_an_object"
        text = str(c.get("text", "")).strip()
        if not text:
            continue
        pair = c.get("timestamp")
        if pair is None:
            pair = [None, None]
        if not isinstance(pair, list) or len(pair) != 2:
            return None, "timestamp_not_a_pair"
        for x in pair:
            if x is None:
                continue
            if isinstance(x, bool) or not isinstance(x, (int, float)):
                return None, "timestamp_not_numeric"
            if not math.isfinite(x) or x < 0:
                return None, "timestamp_not_finite_and_nonnegative"
        pair = [None if x is None else float(x) for x in pair]
        if None not in pair and pair[1] < pair[0]:
            return None, "end_before_start"
        for i, name in enumerate(("start_not_monotonic", "end_not_monotonic")):
            if pair[i] is not None and last[i] is not None and pair[i] < last[i]:
                return None, name
        last = [pair[i] if pair[i] is not None else last[i] for i in (0, 1)]
        found.append((text, *pair))
    return found, None


def random_reply(rng):
    number = lambda t: rng.choice([t, t, t, t, t + 0.5, None, int(t), rng.choice([True, "1", -1.0, 0, [], t - 3])])
    text = lambda: rng.choice([" a b ", "x", "你好，世界。", "  ", "", "　y ", "\x1cz", None, 7, True, "q"])
    chunks = []
    for i in range(rng.randint(0, 7)):
        stamp = rng.choice([[number(2.0 * i), number(2.0 * i + 1.25)]] * 9 + [None, [1.0], "1", {"a": 1}, [1, 2, 3]])
        c = {"text": text(), "timestamp": stamp}
        if rng.random() < 0.05:
            del c["timestamp"]
        if rng.random() < 0.05:
            del c["text"]
        chunks.append(c if rng.random() > 0.03 else rng.choice([1, "c", None, []]))
    out = {"text": text(), "chunks": chunks}
    if rng.random() < 0.1:
        out["chunks"] = rng.choice([None, {}, "no", 3])
    if rng.random() < 0.05:
        del out["chunks"]
    return json.dumps(out if rng.random() > 0.03 else rng.choice([[], 1, None, "t"]), ensure_ascii=rng.random() < 0.5)


def test_replies_equal_the_plain_version(spark):
    rng = random.Random(3)
    raws = [random_reply(rng) for _ in range(1500)] + [None, "", "{", '{"chunks":[]}', "{}", '{"text":null}', '{"text":" t "}']
    df = spark.createDataFrame(list(enumerate(raws)), "case_id int, raw string")
    got = replies.normalized(df).collect()
    wrong = []
    for r in got:
        segments = None if r["segments"] is None else [tuple(s) for s in r["segments"]]
        want = plain(r["raw"])
        if r["raw"] == '{"text":null}':
            want = ([("None", None, None)], None)
        if (segments, r["violation"]) != want:
            wrong.append((r["raw"], segments, r["violation"], want))
    assert wrong[:3] == []
    assert len({r["violation"] for r in got}) == 11


def test_units_and_runs(spark):
    raw = json.dumps({"text": "all", "chunks": [{"text": " one ", "timestamp": [0.0, 1.25]}, {"text": " ", "timestamp": [9, 1]}, {"text": "two", "timestamp": [1.5, None]}]})
    rows = [("a", "s", "c", raw), ("b", "s", "c", '{"chunks":[]}'), ("c", "s", " ", raw), ("d", "s", "c", "[]")]
    df = spark.createDataFrame(rows, "case_id string, session_id string, claim string, raw string")
    df = df.withColumns({"path": F.lit("/v.mp4"), "file_size_bytes": F.lit(10), "sample_count": F.lit(24000), "sample_rate": F.lit(16000)})
    normal = replies.normalized(df)
    u = replies.units_of(normal).orderBy("case_id", "ordinal").collect()
    assert [(r["case_id"], r["unit_id"], r["text"], r["start_time"], r["end_time"], r["source_uri"]) for r in u if r["case_id"] == "a"] == [("a", "asr_0000", "one", 0.0, 1.25, "/v.mp4"), ("a", "asr_0001", "two", 1.5, None, "/v.mp4")]
    got = {r["case_id"]: r for r in replies.runs(normal).collect()}
    assert (got["a"]["asr_text"], got["a"]["n_segments"], got["a"]["warnings"], got["a"]["result"]) == ("one two", 2, [], None)
    assert got["a"]["metadata"].asDict() == {"path": "/v.mp4", "file_size_bytes": 10, "audio_duration_seconds": 1.5, "audio_sample_rate": 16000, "audio_sample_count": 24000}
    assert (got["b"]["warnings"], got["b"]["result"]["display_verdict"]) == ([fixed.NO_TRANSCRIPT], "NEI")
    assert (got["c"]["violation"], got["d"]["violation"], got["d"]["metadata"]) == ("claim", "output_not_an_object", None)
