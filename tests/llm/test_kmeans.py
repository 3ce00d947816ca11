"""Clustering against a plain version in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import kmeans, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, dim, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((far(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = [place(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), x in zip(kept, at) if x == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *place(v)) for i, v in kept]
    of = [sum(d for _, d, x in last if x == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, of[j], sum(of), sha[j]) for i, d, j in last), key=str)


def rows_of(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [None] + [0.1] * 63), (1004, [float("nan")] + [0.1] * 63), (1005, [float("inf")] * 64), (None, [0.25] * 64), (1006, [-0.25] * 64), (7, [0.1] * 64), (7, [-0.1] * 64)]
    more = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    table = table.select("vec_id", "embedding").unionByName(more).withColumn("key", F.lit(1)).withColumn("v", F.lit(1)).withColumn("a.b", F.lit(1))
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()], 64, 8, 10)
    assert rows_of(queries.op12_centroid_clustering(spark, str(tmp_path))) == want


@pytest.mark.parametrize(("seed", "scale", "dim"), [(1, 0.01, 2), (2, 1.0, 3), (3, 5000.0, 5), (4, 0.003, 1)])
def test_ties_copies_and_large_components(spark, seed, scale, dim):
    """Few distinct values, so many ties and copies; close groups, so whole nodes are assigned; large components, beyond exact doubles."""
    rng = np.random.default_rng(seed)
    middle = rng.integers(-3, 4, (6, dim)) * 3
    rows = [(int(i), ((middle[rng.integers(6)] + rng.integers(-1, 2, dim)) * scale).tolist()) for i in range(900)]
    rows += rows[:300]
    got, centroids = kmeans.clusters(spark.createDataFrame(rows, SCHEMA), dim, 8, 4)
    assert rows_of(got) == brute(rows, dim, 8, 4)
    assert len(centroids) == 8


def test_whole_nodes_are_assigned():
    """The filter does assign nodes as a whole where groups lie apart, and agrees with all distances."""
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.integers(-50, 50, (400, 4)) + 5000 * g for g in range(4)]).astype(np.int64)
    order, levels = kmeans._order(v)
    v = v[order]
    c = np.array([[5000 * g] * 4 for g in range(4)] + [[1] * 4], np.int64)
    out, whole = np.full(len(v), -1), 0
    for a, b, j, node in kmeans._filtered(v, [len(s) for s, _ in levels], kmeans._nodes(v, levels), c):
        if node is None:
            out[a] = b
        else:
            out[a:b] = j
            whole += b - a
    assert whole > 1100
    assert (out == ((v[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()


def test_no_vectors_and_few(spark):
    none = spark.createDataFrame([(1, None)], SCHEMA)
    got, centroids = kmeans.clusters(none)
    assert (got.count(), centroids) == (0, [])
    few = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [1.0, -1.0])]
    got, _ = kmeans.clusters(spark.createDataFrame(few, SCHEMA), 2)
    assert rows_of(got) == brute(few, 2, 8, 10)


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="components must lie"):
        kmeans.clusters(spark.createDataFrame([(1, [1e9, 0.0])], SCHEMA), 2)
