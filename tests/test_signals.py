"""Signals in pieces against plain lists."""

import math
import random

import pytest

from evidentia.operators import signals

SCHEMA = "case_id string, ordinal long, samples array<double>"


@pytest.mark.parametrize(("block", "limit"), [(4096, None), (3, 25), (2, 0), (5, 10**6)])
def test_signals_equal_joined_lists(spark, block, limit):
    rng = random.Random(10)
    rows = [("a" if i % 3 else None, i * rng.choice([1, 7]), rng.choice([None, [], [rng.uniform(-2, 2) for _ in range(rng.randint(0, 5))]])) for i in range(60)] + [("one", 0, [3.0]), ("a", 14, [0.5]), ("a", 14, [0.25, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = {}
    for case in {r[0] for r in rows}:
        mine = sorted((r[1], len(r[2] or []), r[2] or []) for r in rows if r[0] == case)
        whole = [max(-1.0, min(1.0, x)) for _, _, s in mine for x in s]
        want[case] = whole if limit is None else whole[:limit]
    got = {}
    for r in sorted(signals.assembled(df, limit, block=block).collect(), key=lambda r: (str(r["case_id"]), r["offset"], r["ordinal"], r["total"])):
        at = got.setdefault(r["case_id"], [])
        assert not r["samples"] or r["offset"] == len(at)
        at.extend(r["samples"])
    assert got == want


def test_measures(spark):
    rows = [("a", 0, [0.5, 2.0, -0.25]), ("a", 1, [-3.0, 0.0]), ("b", 0, []), ("c", 0, [0.1, math.nan]), ("d", 0, [0.1, 0.2, 0.3, 0.4, None])]
    got = {r["case_id"]: tuple(r)[1:] for r in signals.measured(spark.createDataFrame(rows, SCHEMA), 2, 4).collect()}
    assert got == {"a": (4, 2.0, -1.0, 1.0, True, None), "b": (0, 0.0, None, None, False, None), "c": (None, None, None, None, None, "sample_not_finite"), "d": (4, 2.0, 0.1, 0.4, True, None)}
    for bad in ((0, 1), (1, -1)):
        with pytest.raises(ValueError):
            signals.measured(spark.createDataFrame(rows, SCHEMA), *bad)
