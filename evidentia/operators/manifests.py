"""Digests of manifests: the files of a group in order, as canonical JSON, under one SHA-256."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .validate import violations

#: A run has at most so many files.
RUN = 1024


def _runs(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """Sorted files of a range as runs: the entries of one group in a row, joined."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    kind = None

    def row(group: object, held: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([",".join(held)], pa.string())], names=["group", "part", "run", "n", "entries"])

    group, held = None, []
    for batch in batches:
        kind = batch["group"].type
        for g, path, size, digest in zip(*(batch[c].to_pylist() for c in ("group", "path", "size", "sha256"))):
            if held and (g != group or len(held) >= run):
                yield row(group, held)
                number, held = number + 1, []
            group = g
            held.append(json.dumps({"path": path, "sha256": digest, "size": size}, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    if held:
        yield row(group, held)


def _fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a group: its digest, fed run by run in order."""
    kind = None
    group, digest, n = None, None, 0

    def row() -> pa.RecordBatch:
        digest.update(b"]")
        return pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([n], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["group", "n_files", "manifest_sha256"])

    for batch in batches:
        kind = batch["group"].type
        for g, count, entries in zip(*(batch[c].to_pylist() for c in ("group", "n", "entries"))):
            if digest is None or g != group:
                if digest is not None:
                    yield row()
                group, digest, n = g, hashlib.sha256(b"["), 0
            digest.update((("," if n else "") + entries).encode())
            n += count
    if digest is not None:
        yield row()


def manifest_digests(files: DataFrame, by: str = "group", run: int = RUN) -> DataFrame:
    """by, n_files, manifest_sha256: the SHA-256 of a group's manifest, its files (path, size, sha256) as canonical JSON in order of path.

    Files are sorted over all tasks by group and path and joined into runs where
    they lie; a group's runs are then fed to its digest one after another. So a group of any
    number of files is in no row and no memory, and only its runs meet in one
    task. Rows with equal paths follow each other by digest and size; a null group is one.
    """
    rows = files.select(F.col(by).alias("group"), "path", F.col("size").cast("bigint").alias("size"), "sha256")
    kind = rows.schema["group"].dataType.simpleString()
    order = ["group", "path", "sha256", "size"]
    runs = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_runs, run=run), f"group {kind}, part int, run bigint, n bigint, entries string")
    fed = runs.repartition("group").sortWithinPartitions("group", "part", "run").mapInArrow(_fed, f"group {kind}, n_files bigint, manifest_sha256 string")
    return fed.withColumnRenamed("group", by)


def identity_violations(digests: DataFrame, expected: DataFrame, by: str = "group") -> DataFrame:
    """by, violations: expected groups (by, sha256) whose manifest is missing or another one."""
    j = expected.select(by, F.lower("sha256").alias("__want")).join(digests, by, "left")
    return j.select(by, violations((F.col("manifest_sha256").isNull(), "missing"), (F.col("manifest_sha256") != F.col("__want"), "sha256_mismatch")).alias("violations"))
