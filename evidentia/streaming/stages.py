"""Stages of cases as a stream: what has come of a case so far, judged as if it had come at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .. import fixed

#: A case has nine stages of at most four statuses; one with more events than this has a violation and keeps the first ones.
MOST = 64
NEXT = {("pending", "running"), ("pending", "skipped"), ("running", "completed"), ("running", "failed")}
STATE = "numbers array<bigint>, sequences array<bigint>, names array<string>, statuses array<string>, latest bigint, overflow boolean"
OUTPUT = "violations array<string>, n_events int, completed boolean, stopped boolean"


def _millis(ts: pd.Series) -> list[int | None]:
    """Milliseconds since 1970, rounded towards zero; null where there is none."""
    if getattr(ts.dtype, "kind", "") != "M":
        return [None if pd.isna(x) else int(x.timestamp() * 1000) for x in ts]
    x = ts.to_numpy().astype("datetime64[us]")
    none = np.isnat(x)
    at = np.trunc(x.astype(np.int64) / 1000).astype(np.int64).tolist()
    return [None if n else v for n, v in zip(none.tolist(), at)] if none.any() else at


def judged(events: dict[int, tuple], overflow: bool = False) -> tuple[list[str], bool]:
    """violations and whether the last stage is complete, of events number -> (sequence, name, status)."""
    stages: dict[int, tuple[set, list]] = {}
    for number in sorted(events):
        sequence, name, status = events[number]
        names, statuses = stages.get(sequence) or stages.setdefault(sequence, (set(), []))
        names.add(name)
        statuses.append(status)
    expected = lambda s: fixed.STAGES[s - 1] if s is not None and 1 <= s <= len(fixed.STAGES) else None
    order = any(names != {expected(s)} for s, (names, _) in stages.items()) or set(stages) != set(range(1, len(stages) + 1))
    moved = any(x[0] != "pending" or any(pair not in NEXT for pair in zip(x, x[1:])) for _, x in stages.values())
    last = stages.get(len(fixed.STAGES), (set(), []))[1]
    return [n for n, bad in (("stage_order", order), ("stage_transition", moved), ("too_many_events", overflow)) if bad], bool(last) and last[-1] in ("completed", "skipped")


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: Any, idle_ms: int) -> Iterator[pd.DataFrame]:
    numbers, sequences, names, statuses, latest, overflow = state.get if state.exists else ([], [], [], [], 0, False)
    events = {n: (s, m, t) for n, s, m, t in zip(numbers, sequences, names, statuses)}
    stopped = state.hasTimedOut
    if not stopped:
        for f in frames:
            # whole columns as lists: a case has a few events, and a frame or a time of its own for each costs more than all the rest
            for number, sequence, name, status, at in zip(*(f[c].tolist() for c in ("event_no", "sequence", "name", "status")), _millis(f["ts"])):
                if number not in events and len(events) >= MOST:
                    overflow = True
                    # the smallest numbers stay, so that the order of arrival doesn't matter
                    if number > max(events):
                        continue
                    events.pop(max(events))
                events.setdefault(int(number), (None if sequence is None or sequence != sequence else int(sequence), name, status))
                if at is not None:
                    latest = max(latest, at)
    violations, completed = judged(events, overflow)
    if stopped:
        state.remove()
    else:
        state.update(([*events], [e[0] for e in events.values()], [e[1] for e in events.values()], [e[2] for e in events.values()], latest, overflow))
        state.setTimeoutTimestamp(max(latest + idle_ms, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"case_id": [key[0]], "violations": [violations], "n_events": [len(events)], "completed": [completed], "stopped": [stopped and not completed]})


def stage_stream(events: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """case_id, violations, n_events, completed, stopped: a row for each case that a batch says something of; the last one holds.

    events, a stream: case_id, event_no (its place in the case), sequence, name and
    status of a stage, ts (with a watermark). A case's state is its events by number, so
    batches may split them anyhow and in any order; an event that comes again changes
    nothing, and one that is later than the watermark allows is left out by Spark. After
    idle_ms of event time without news a case is given out once more, stopped
    if its last stage isn't complete, and forgotten; what comes after that starts the case anew.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = events.schema["case_id"].dataType.simpleString()
    rows = events.select("case_id", "event_no", "sequence", "name", "status", "ts")
    return rows.groupBy("case_id").applyInPandasWithState(partial(_step, idle_ms=idle_ms), f"case_id {kind}, {OUTPUT}", STATE, "update", GroupStateTimeout.EventTimeTimeout)
