"""The stage stream in batches of any split against the batch operator."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia import fixed
from evidentia.operators import package
from evidentia.streaming import stages

SCHEMA = "case_id long, event_no long, sequence long, name string, status string, ts timestamp"
START = datetime.datetime(2024, 1, 1)


def events(rng):
    rows = []
    for case in range(40):
        for s, name in enumerate(fixed.STAGES, 1):
            for k, status in enumerate(("pending", "running", "completed")):
                number = 3 * s + k
                if rng.random() < 0.01:
                    continue
                rows.append((case, number, s, name if rng.random() > 0.01 else "other", status if rng.random() > 0.01 else "failed", START + datetime.timedelta(seconds=number)))
    return rows


def run(spark, tmp_path, parts, late):
    """The rows of each epoch of a stream of the parts, one file a batch."""
    seen = []
    (tmp_path / "in").mkdir()
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, SCHEMA).coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/raw{i}")
        next((tmp_path / f"raw{i}").glob("part-*.parquet")).rename(tmp_path / "in" / f"{i:03d}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", late)
    q = stages.stage_stream(stream, 60_000).writeStream.outputMode("update").foreachBatch(lambda b, e: seen.extend((e, r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_equals_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = events(rng)
    df = spark.createDataFrame(rows, SCHEMA)
    per = df.groupBy("case_id", "sequence").agg(F.min("name").alias("low"), F.max("name").alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("event_no", "status"))), lambda x: x["status"]).alias("statuses"))
    per = per.withColumn("name", F.when(F.col("low") == F.col("name"), F.col("name")).otherwise("mixed"))
    want = {r["case_id"]: r["violations"] for r in package.stage_order(per).collect()}
    again = rows + rng.sample(rows, 100)
    rng.shuffle(again)
    cut = sorted(rng.sample(range(len(again)), 3))
    seen = run(spark, tmp_path, [again[a:b] for a, b in zip([0, *cut], [*cut, len(again)])], "1 hour")
    last = {r["case_id"]: r["violations"] for _, r in sorted(seen, key=lambda x: x[0])}
    assert last == want and len({str(v) for v in want.values()}) > 1


def test_cases_that_stop_are_given_out_once(spark, tmp_path):
    at = lambda s: START + datetime.timedelta(seconds=s)
    first = [(1, 1, 1, "request", "pending", at(0)), (2, 1, 9, "result", "pending", at(0)), (2, 2, 9, "result", "running", at(1)), (2, 3, 9, "result", "completed", at(2))]
    seen = run(spark, tmp_path, [first, [(3, 1, 1, "request", "pending", at(500))], [(3, 2, 1, "request", "running", at(501))]], "1 second")
    assert [(r["case_id"], r["stopped"]) for _, r in seen if r["case_id"] == 1] == [(1, False), (1, True)]
    assert [(r["stopped"], r["completed"], r["violations"]) for _, r in seen if r["case_id"] == 2][-1] == (False, True, ["stage_order"])


def test_too_many_events_are_said(spark):
    many = {n: (1, "request", "pending") for n in range(3)}
    assert stages.judged(many, True)[0] == ["stage_transition", "too_many_events"]


class State:
    exists, hasTimedOut = False, False

    def update(self, x):
        self.kept = x

    def setTimeoutTimestamp(self, x):
        self.until = x

    def getCurrentWatermarkMs(self):
        return 0


def test_a_step_reads_columns(monkeypatch):
    """Rows of a case come as whole columns: no frame or time is made for each; odd values stay what they were."""
    monkeypatch.setattr(pd.DataFrame, "itertuples", None)
    us = [int(t) for t in range(1704067200_000_001, 1704067200_000_001 + 997 * 1009, 1009)] + [-1_500]
    assert stages._millis(pd.Series(np.array(us, "datetime64[us]").astype("datetime64[ns]"))) == [int(t / 1000) for t in us]
    frame = pd.DataFrame({"event_no": [2, 1, 1], "sequence": [1.0, None, 1.0], "name": ["request", None, "request"], "status": ["running", "pending", "completed"], "ts": pd.to_datetime(["2024-01-01 00:00:01", None, None])})
    state = State()
    (out,) = stages._step(("c",), iter([frame, frame]), state, 1000)
    assert [out[c].tolist() for c in out.columns] == [["c"], [["stage_order", "stage_transition"]], [2], [False], [False]]
    assert state.kept == ([2, 1], [1, None], ["request", None], ["running", "pending"], 1704067201000, False) and state.until == 1704067202000
    many = pd.DataFrame({"event_no": range(70, 0, -1), "sequence": 1, "name": "request", "status": "pending", "ts": pd.Timestamp("2024-01-01")})
    (out,) = stages._step(("c",), iter([many]), state, 1000)
    assert sorted(state.kept[0]) == list(range(1, 65)) and out["violations"][0] == ["stage_transition", "too_many_events"]
