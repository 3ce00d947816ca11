"""Model stages as Arrow iterators: whatever recognises, embeds, observes or scores is plugged in behind one shape."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Makes the worker of a task once, when its first batch comes: checks the assets, loads the model, picks device and number type.
Load = Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]


def staged(rows: DataFrame, load: Load, schema: str, failed: Callable[[pa.RecordBatch, Exception], pa.RecordBatch] | None = None) -> DataFrame:
    """rows through a model: load() is called once a task and only if there are rows, its result for every batch.

    schema is that of the batches given out. A batch that raises fails the job, or,
    with failed, is halved again and again until the rows that raise stand alone: failed
    makes rows of their batch, and all others get their result (a row's failure is neither its
    batch's nor the job's). A model that can't be loaded fails every row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = None

        def halved(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal worker
            loaded = worker is not None
            try:
                worker = worker or load()
                loaded = True
                done = worker(b)
            except Exception as e:
                if failed is None:
                    raise
                if b.num_rows == 1 or not loaded:
                    yield failed(b, e)
                    return
                half = b.num_rows // 2
                yield from halved(b.slice(0, half))
                yield from halved(b.slice(half))
                return
            yield done

        for b in batches:
            if b.num_rows:
                yield from halved(b)

    return rows.mapInArrow(run, schema)


def scorer(load: Load) -> Callable[[DataFrame], DataFrame]:
    """A scorer of whole cases from a model: load() gives what makes selection_score, fake, real of batches of claim, source_type, text.

    A unit on which the model raises has the exception's name as its failure.
    """

    def score(shown: DataFrame) -> DataFrame:
        rows = shown.select("case_id", "unit_id", "claim", "source_type", "text")
        keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("case_id", "unit_id"))

        def wrapped() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            model = load()
            return lambda b: _scored(b, model(b.select(["claim", "source_type", "text"])), None)

        return staged(rows, wrapped, f"{keys}, selection_score double, fake double, real double, failure string", lambda b, e: _scored(b, None, type(e).__name__))

    return score


def _scored(b: pa.RecordBatch, scores: pa.RecordBatch | None, failure: str | None) -> pa.RecordBatch:
    names = ["selection_score", "fake", "real"]
    found = [pa.nulls(b.num_rows, pa.float64()) if scores is None else scores[n].cast(pa.float64()) for n in names]
    return pa.RecordBatch.from_arrays([b["case_id"], b["unit_id"], *found, pa.array([failure] * b.num_rows, pa.string())], names=["case_id", "unit_id", *names, "failure"])


def digest_embedder(size: int = 8) -> Load:
    """Unit vectors from a text's digest, in the place of an embedding model: key, embedding for batches of key, text."""

    def load() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        import hashlib

        import numpy as np

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for t in b.column(1).to_pylist():
                x = np.frombuffer(hashlib.sha512((t or "").encode()).digest()[: 2 * size], "<i2").astype(np.float32)
                rows.append(x / max(1e-12, float(np.linalg.norm(x))))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["key", "embedding"])

        return work

    return load
