"""Centroid clustering with whole numbers: Lloyd's rounds filtered through kd-trees.

Each task builds kd-trees over the vectors that lie in it and saves them once:
a tree is a row with the vectors in the tree's order and, for each node, its
count, sums, sum of squares and bounding box. A round walks the trees from the
root with all centroids as candidates. At a node a candidate goes if another one
is strictly nearer at every point of the node's box; a node with one candidate
left is assigned as a whole from its sums, and in a leaf every vector is compared
with the candidates left, smaller numbers winning ties. So a round moves one row
a task and cluster, and its result is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, saved

#: A component is floor(SCALE * x); it must lie within -LIMIT and LIMIT, so that whatever is compared over 64 components fits into a long.
SCALE, LIMIT = 1024, 1 << 26
#: A tree holds at most so many vectors, a leaf at most LEAF.
TREE, LEAF = 4096, 32
#: Sums of products of components up to EXACT are whole numbers that doubles hold exactly.
EXACT = 1 << 20


def vectors(table: DataFrame, dim: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """key, v: rows whose vector has exactly dim components, none null, NaN or infinite, as arrays of floor(SCALE * x)."""
    x = F.transform(column(value), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select(column(key).alias("key"), x.alias("x")).filter((F.size("x") == dim) & whole)
    return rows.select("key", F.transform("x", lambda c: F.floor(c * float(SCALE))).alias("v"))


def _order(v: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The order of v's rows in a balanced kd-tree, and the starts and ends of the nodes of each level."""
    order = np.arange(len(v))
    level = [(0, len(v))]
    levels = []
    while True:
        levels.append((np.array([s for s, _ in level]), np.array([e for _, e in level])))
        if max(e - s for s, e in level) <= LEAF:
            return order, levels
        below = []
        for s, e in level:
            part = v[order[s:e]]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            half = (e - s) // 2
            order[s:e] = order[s:e][np.argpartition(part[:, axis], half)]
            below += [(s, s + half), (s + half, e)]
        level = below


def _nodes(v: np.ndarray, levels: list) -> dict[str, np.ndarray]:
    """What the nodes hold, level by level. v is in the tree's order; nodes of one level lie side by side."""
    squares = (v * v).sum(1)
    count, sums, square, low, high = [], [], [], [], []
    for starts, ends in levels:
        count.append(ends - starts)
        sums.append(np.add.reduceat(v, starts))
        square.append(np.add.reduceat(squares, starts))
        low.append(np.minimum.reduceat(v, starts))
        high.append(np.maximum.reduceat(v, starts))
    return {n: np.concatenate(x) for n, x in (("count", count), ("sums", sums), ("square", square), ("low", low), ("high", high))}


def _grow(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Trees over the vectors of a task."""

    def tree(keys: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        if np.abs(v).max() > LIMIT:
            raise ValueError(f"components must lie within {LIMIT / SCALE:.0f} of zero")
        order, levels = _order(v)
        v = v[order]
        nodes = _nodes(v, levels)
        sizes = [len(s) for s, _ in levels]
        keys = keys.take(pa.array(order))
        cols = [pa.array([len(v)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([v.astype("<i4").tobytes()], pa.binary()), pa.array([sizes], pa.list_(pa.int32()))]
        cols += [pa.array([nodes[n].astype(k).tobytes()], pa.binary()) for n, k in NODES]
        return pa.RecordBatch.from_arrays(cols, names=["n", "keys", "v", "sizes", *(n for n, _ in NODES)])

    keys: list[pa.Array] = []
    parts: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, TREE):
            piece = batch.slice(at, TREE)
            keys.append(piece["key"])
            parts.append(piece["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            held += piece.num_rows
            while held >= TREE:
                k, v = pa.concat_arrays(keys), np.concatenate(parts)
                yield tree(k.slice(0, TREE), v[:TREE])
                keys, parts, held = [k.slice(TREE)], [v[TREE:]], held - TREE
    if held:
        yield tree(pa.concat_arrays(keys), np.concatenate(parts))


#: What a node holds and how it is stored.
NODES = (("count", "<i8"), ("sums", "<i8"), ("square", "<i8"), ("low", "<i4"), ("high", "<i4"))


def _trees(batch: pa.RecordBatch, dim: int) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        wide = lambda name, kind: np.frombuffer(batch[name][i].as_py(), kind).astype(np.int64)
        v = wide("v", "<i4").reshape(-1, dim)
        nodes = {n: wide(n, k) for n, k in NODES}
        nodes |= {n: nodes[n].reshape(-1, dim) for n in ("sums", "low", "high")}
        yield i, v, batch["sizes"][i].as_py(), nodes


def _distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of v to each row of c, exact."""
    if max(np.abs(v).max(), np.abs(c).max()) <= EXACT:
        product = (v.astype(float) @ c.T.astype(float)).astype(np.int64)
        return (v * v).sum(1)[:, None] - 2 * product + (c * c).sum(1)[None]
    return np.stack([((v - x) ** 2).sum(1) for x in c], 1)


def _filtered(v: np.ndarray, sizes: list[int], nodes: dict, c: np.ndarray) -> Iterator[tuple]:
    """(start, end, cluster, node) for nodes assigned whole, (rows, clusters, distances, None) for the vectors of leaves."""
    k = len(c)
    open_nodes = np.zeros(1, np.int64)
    masks = np.ones((1, k), bool)
    starts = np.zeros(1, np.int64)
    base = 0
    for level, size in enumerate(sizes):
        low, high, count = (nodes[n][base + open_nodes] for n in ("low", "high", "count"))
        middle = _distances(low + high, 2 * c)
        middle[~masks] = np.iinfo(np.int64).max
        near = c[middle.argmin(1)]
        step = c[None] - near[:, None]
        corner = np.where(step > 0, high[:, None], low[:, None])
        # dist(c) - dist(near) at the corner of the box where it is smallest
        masks &= (step * (c[None] + near[:, None] - 2 * corner)).sum(2) <= 0
        single = masks.sum(1) == 1
        for j in np.flatnonzero(single):
            yield starts[j], starts[j] + count[j], int(masks[j].argmax()), base + int(open_nodes[j])
        rest = np.flatnonzero(~single)
        if not len(rest):
            return
        if level == len(sizes) - 1:
            rows = np.concatenate([np.arange(starts[j], starts[j] + count[j]) for j in rest])
            d = _distances(v[rows], c)
            d[~np.repeat(masks[rest], count[rest], 0)] = np.iinfo(np.int64).max
            best = d.argmin(1)
            yield rows, best, d[np.arange(len(rows)), best], None
            return
        base += size
        left = nodes["count"][base + 2 * open_nodes[rest]]
        open_nodes = np.stack([2 * open_nodes[rest], 2 * open_nodes[rest] + 1], 1).ravel()
        starts = np.stack([starts[rest], starts[rest] + left], 1).ravel()
        masks = np.repeat(masks[rest], 2, 0)


def _totals(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], dim: int) -> Iterator[pa.RecordBatch]:
    """A task's count, summed distance and summed components for each cluster."""
    c = np.array(centroids, np.int64)
    n, far, sums = [0] * len(c), [0] * len(c), [[0] * dim for _ in c]

    def add(j: int, count: int, distance: int, s: np.ndarray) -> None:
        n[j] += count
        far[j] += distance
        sums[j] = [a + b for a, b in zip(sums[j], s.tolist())]

    for batch in batches:
        for _, v, sizes, nodes in _trees(batch, dim):
            for a, b, j, node in _filtered(v, sizes, nodes, c):
                if node is not None:
                    count, s = int(nodes["count"][node]), nodes["sums"][node]
                    add(j, count, int(nodes["square"][node]) - 2 * sum(int(x) * int(y) for x, y in zip(s, c[j])) + count * sum(int(x) ** 2 for x in c[j]), s)
                    continue
                for x in np.unique(b).tolist():
                    here = a[b == x], j[b == x]
                    add(x, len(here[0]), sum(here[1].tolist()), v[here[0]].sum(0))
    used = [j for j in range(len(c)) if n[j]]
    cols = [pa.array(used, pa.int32()), pa.array([n[j] for j in used], pa.int64()), pa.array([str(far[j]) for j in used], pa.string()), *(pa.array([sums[j][i] for j in used], pa.int64()) for i in range(dim))]
    yield pa.RecordBatch.from_arrays(cols, names=["cluster", "n", "far", *(f"s{i}" for i in range(dim))])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], dim: int) -> Iterator[pa.RecordBatch]:
    """key, cluster, distance of every vector, a batch a tree."""
    c = np.array(centroids, np.int64)
    for batch in batches:
        for i, v, sizes, nodes in _trees(batch, dim):
            cluster, distance = np.zeros(len(v), np.int32), np.zeros(len(v), np.int64)
            for a, b, j, node in _filtered(v, sizes, nodes, c):
                if node is not None:
                    cluster[a:b], distance[a:b] = j, ((v[a:b] - c[j]) ** 2).sum(1)
                else:
                    cluster[a], distance[a] = b, j
            keys = batch["keys"][i].values
            yield pa.RecordBatch.from_arrays([keys, pa.array(cluster), pa.array(distance)], names=["key", "cluster", "distance"])


def _sums(trees: DataFrame, centroids: list[list[int]], dim: int) -> dict[int, tuple]:
    """cluster -> (count, summed distance, summed components), as Python's whole numbers. One row a cluster comes to the driver."""
    kinds = "cluster int, n long, far string, " + ", ".join(f"s{i} long" for i in range(dim))
    parts = trees.mapInArrow(partial(_totals, centroids=centroids, dim=dim), kinds)
    total = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    rows = parts.groupBy("cluster").agg(*(total(x) for x in ["n", "far", *(f"s{i}" for i in range(dim))])).collect()
    return {r["cluster"]: (int(r["n"]), int(r["far"]), [int(r[f"s{i}"]) for i in range(dim)]) for r in rows}


def clusters(table: DataFrame, dim: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, key: str = "vec_id", value: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """A row a vector: key, cluster, distance, cluster_inertia, inertia (longs), centroid_sha256; and the final centroids.

    The first centroids are the k vectors with the smallest SHA-256 of
    "<seed>:<key>"; equal keys are taken by their components, a null key is the
    empty string. With fewer than k vectors there are as many clusters; with none
    the result is empty. Vectors of another length or with a null, NaN or infinite
    component are left out; repeated rows count as often as they stand there.
    A component beyond LIMIT / SCALE is an error, as distances wouldn't fit into a
    long; inertias that don't fit are null. Columns of the table apart from key
    and value don't matter.
    """
    spark = table.sparkSession
    rows = vectors(table, dim, key, value)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    centroids = [r["v"] for r in rows.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    kind = rows.schema["key"].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    about = T.StructType([T.StructField("cluster", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("cluster_inertia", "inertia")), T.StructField("centroid_sha256", T.StringType())])
    if not centroids:
        return spark.createDataFrame([], out).join(F.broadcast(spark.createDataFrame([], about)), "cluster"), []
    kinds = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("v", T.BinaryType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), *(T.StructField(n, T.BinaryType()) for n, _ in NODES)])
    trees = saved(rows.mapInArrow(partial(_grow, dim=dim), kinds), "kd-trees")
    for _ in range(rounds):
        sums = _sums(trees, centroids, dim)
        centroids = [[s // sums[j][0] for s in sums[j][2]] if j in sums else c for j, c in enumerate(centroids)]
    sums = _sums(trees, centroids, dim)
    fits = lambda x: x if x < 1 << 63 else None
    inertia = fits(sum(s[1] for s in sums.values()))
    facts = [(j, fits(s[1]), inertia, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, s in sums.items()]
    each = trees.mapInArrow(partial(_assigned, centroids=centroids, dim=dim), T.StructType([T.StructField("key", kind), *out.fields[1:]]))
    # one row a cluster
    found = each.withColumnRenamed("key", key).join(F.broadcast(spark.createDataFrame(facts, about)), "cluster")
    return found.select(column(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
