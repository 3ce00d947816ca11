"""Exact means against the standard library's."""

import math
import random
import statistics

from pyspark.sql import functions as F

from evidentia.operators import means


def groups(rng):
    out = {}
    for k in range(300):
        kind = k % 6
        n = rng.randint(1, 40)
        if kind == 0:
            x = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(n)]
        elif kind == 1:
            x = [rng.random() for _ in range(n)]
        elif kind == 2:
            x = [math.ldexp(rng.choice([1.0, -1.0, 1 + 2**-52, 1 - 2**-53]), rng.randint(-70, 70)) for _ in range(n)]
        elif kind == 3:
            x = [rng.choice([5e-324, -5e-324, 0.0, -0.0, 2.2250738585072014e-308, 1e-310]) for _ in range(n)]
        elif kind == 4:
            x = [1e16, 1.0, -1e16] * n
        else:
            x = [math.ldexp(1.0, rng.choice([31, 32, 33, 63, 64, -32, -33])) - rng.choice([0.0, 2**-21]) for _ in range(n)]
        out[k] = x
    return out


def test_means_are_exact_at_any_partitioning(spark):
    rng = random.Random(4)
    want = groups(rng)
    rows = [(k, x) for k, v in want.items() for x in v] + [(0, None), (1000, None), (1001, float("nan")), (1001, 1.0), (1002, float("inf")), (1002, 1.0), (1003, float("inf")), (1003, -float("inf"))]
    rng.shuffle(rows)
    for parts in (1, 7):
        got = {r["k"]: (r["mean"], r["n"]) for r in means.exact_means(spark.createDataFrame(rows, "k int, x double").repartition(parts), ["k"], "x").collect()}
        assert {k: got[k] for k in want} == {k: (statistics.mean(v), len(v)) for k, v in want.items()}
        assert got[1000] == (None, 0) and got[1002] == (math.inf, 2)
        assert math.isnan(got[1001][0]) and math.isnan(got[1003][0])


def test_means_of_confidences_as_an_aggregate(spark):
    rng = random.Random(5)
    want = {k: [rng.choice([rng.uniform(0.5, 1), round(rng.uniform(0.5, 1), 2), 0.5, 1.0]) for _ in range(rng.randint(1, 9))] for k in range(500)}
    rows = [(k, x) for k, v in want.items() for x in v] + [(0, None), (600, 3.0), (600, 0.25)]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(means.exact_mean(F.col("x")).alias("m")).collect()}
    assert got == {k: statistics.mean(v) for k, v in want.items()} | {600: 1.625}
