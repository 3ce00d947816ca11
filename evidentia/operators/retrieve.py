"""Frame retrieval by embedding similarity: one query for all frames, or many claims against the many frames of their cases."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cosine
from .selection import chronology, first_n, ranked

#: A block holds about so many frames, a pack so many claims of a case.
BLOCK, PACK = 2048, 256
#: Norms are never less.
LEAST = 1e-12


def scored_frames(frames: DataFrame, query: Column) -> DataFrame:
    """frames with the cosine of their embedding to query, rounded to 9 places."""
    return frames.withColumn("score", F.round(cosine(F.col("embedding"), query), 9))


def retrieved(scored: DataFrame, n: int = 4, by: str = "case_id") -> DataFrame:
    """Each case's n best frames with their retrieval rank; equal scores by chronology (see in_time)."""
    return first_n(ranked(scored, F.desc("score"), *in_time(scored), by=by, name="retrieval_rank"), n, F.col("retrieval_rank"), by=by)


def in_time(frames: DataFrame) -> list[Column]:
    """Chronology: time (unknown last), index, path; columns that frames lacks don't count."""
    return [c for n, c in zip(("timestamp", "frame_index", "frame_path"), chronology("timestamp", "frame_index", "frame_path")) if n in frames.columns]


def backfilled(candidates: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """All candidates with the rank of those that have one."""
    return candidates.join(ranks.select(*keys, "retrieval_rank"), keys, "left")


FRAME = "struct<frame_index:bigint,timestamp:double,frame_path:string,embedding:array<double>>"
CLAIM = "struct<claim_id:bigint,embedding:array<double>>"


def _dealt(rows: DataFrame, by: str, size: int, key: str, what: Column) -> DataFrame:
    """by, slot, items: a case's rows dealt into packs of about size, by a hash of key."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / F.lit(size)).alias("slots"))
    dealt = rows.join(sizes, by).withColumn("slot", F.pmod(F.xxhash64(key), "slots"))
    return dealt.groupBy(by, "slots", "slot").agg(F.collect_list(what).alias("items"))


def _best(batches: Iterator[pa.RecordBatch], n: int, by: str) -> Iterator[pa.RecordBatch]:
    """Every claim's n best frames of a block, by one matrix product a block and pack."""

    def matrix(items: pa.StructArray) -> np.ndarray:
        e = items.field("embedding")
        m = e.flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)
        return m / np.maximum(np.sqrt((m * m).sum(1)), LEAST)[:, None]

    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("claim_id", "frame_index", "timestamp", "frame_path", "score")}
        cases = []
        for i in range(batch.num_rows):
            claims, frames = batch["claims"][i].values, batch["frames"][i].values
            score = np.round(matrix(claims) @ matrix(frames).T, 9)
            index, time, path = (frames.field(c).to_pylist() for c in ("frame_index", "timestamp", "frame_path"))
            k = min(n, len(frames))
            least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            for c, claim in enumerate(claims.field("claim_id").to_pylist()):
                tied = np.flatnonzero(score[c] >= least[c]).tolist()
                order = sorted(tied, key=lambda j: (-score[c, j], time[j] is None, time[j] or 0.0, index[j], path[j] or ""))  # noqa: B023
                for j in order[:k]:
                    cases.append(batch[by][i].as_py())
                    for name, x in zip(out, (claim, index[j], time[j], path[j], float(score[c, j]))):
                        out[name].append(x)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(cases, batch[by].type), *(pa.array(v, t) for v, t in zip(out.values(), kinds))], names=[by, *out])


def retrieved_for_claims(claims: DataFrame, frames: DataFrame, n: int = 4, by: str = "case_id", block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """by, claim_id, retrieval_rank, ordinal, frame_index, timestamp, frame_path, score: every claim's n best frames of its case.

    claims: by, claim_id, embedding; frames: by, frame_index, timestamp, frame_path,
    embedding. Score is the cosine, rounded to 9 places; equal ones are ranked by
    chronology (unknown times last, then index, then path), and ordinal numbers a claim's frames in
    chronology. A case's frames are dealt into blocks and its claims into packs of
    bounded size; each pack meets each block once, in whatever task, as a matrix product with every
    vector's norm worked out once, and gives only n rows a claim. So a case of any
    size is spread, and the last ranking sees n rows a claim and block. Rows with a null or
    empty embedding or with null or non-finite components are left out; all embeddings of a case have one length.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    good = (F.size("embedding") > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    claim = F.struct(F.col("claim_id").cast("bigint").alias("claim_id"), vector.alias("embedding")).cast(CLAIM)
    frame = F.struct(F.col("frame_index").cast("bigint").alias("frame_index"), F.col("timestamp").cast("double").alias("timestamp"), F.col("frame_path").alias("frame_path"), vector.alias("embedding")).cast(FRAME)
    packs = _dealt(claims.filter(good), by, pack, "claim_id", claim).select(by, F.col("items").alias("claims"))
    blocks = _dealt(frames.filter(good), by, block, "frame_index", frame).select(by, "slot", F.col("items").alias("frames"))
    # every pack goes to the slots of its case's blocks, so that no key has more than a block and the case's packs
    slots = blocks.groupBy(by).agg(F.collect_set("slot").alias("slots"))
    spread = packs.join(slots, by).select(by, "claims", F.explode("slots").alias("slot"))
    pairs = spread.join(blocks, [by, "slot"]).select(by, "claims", "frames")
    kind = pairs.schema[by].dataType.simpleString()
    best = pairs.mapInArrow(partial(_best, n=n, by=by), f"{by} {kind}, claim_id bigint, frame_index bigint, timestamp double, frame_path string, score double")
    top = first_n(ranked(best.withColumn("__claim", F.struct(by, "claim_id")), F.desc("score"), *in_time(best), by="__claim", name="retrieval_rank"), n, F.col("retrieval_rank"), by="__claim")
    return ranked(top, *in_time(best), by="__claim", name="ordinal").withColumn("ordinal", F.col("ordinal") - 1).drop("__claim")
