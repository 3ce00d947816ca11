"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

#: One paragraph in so many ends a section, by its hash.
SECTION = 4
#: One character in so many ends a piece, by the hash of the last REACH characters of its paragraph.
PIECE = 40
REACH = 8
#: Characters of a node in a fingerprint: its level and 48 bits of its hash.
NODE = 9
MIX = np.uint64(0x9E3779B97F4A7C15)


def _cuts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of a text end (without line ends), and which of these ends is a paragraph's."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(code)
    at = np.arange(n)
    feed = code == 10
    start = np.maximum.accumulate(np.where(np.concatenate([[True], feed[:-1]]), at, 0)) if n else at
    h = np.zeros(n, np.uint64)
    for d in range(min(REACH, n)):
        h[d:] += np.where(at[d:] - d >= start[d:], (code[: n - d] + np.uint64(1)) * (MIX ** np.uint64(2 * d + 1)), np.uint64(0))
    h ^= h >> np.uint64(31)
    ends = np.flatnonzero(((h * MIX) >> np.uint64(33)) % np.uint64(PIECE) == 0) + 1
    close = np.append(np.flatnonzero(feed), n)
    ends = np.union1d(ends[~feed[ends - 1]], close)
    return ends, np.isin(ends, close)


def tree(text: str) -> dict:
    """The tree of a text: root, sections, their paragraphs, their leaves (64-bit hashes, in order).

    Every node is the hash of its children's hashes in order, so equal texts
    have equal roots and an edit changes only the branches above it. Lines are
    paragraphs. A paragraph is cut into pieces by its own characters, whatever its
    length or script, and a section ends after a paragraph whose hash is a
    multiple of SECTION, so an insertion moves no cut behind it.
    """
    sections: list[dict] = []
    paragraphs: list[dict] = []
    leaves: list[int] = []
    digest = xxhash.xxh64_intdigest

    def node(hashes: list[int]) -> int:
        return digest(np.array(hashes, "<u8").tobytes(), 1)

    begin = 0
    for end, closes in zip(*(x.tolist() for x in _cuts(text))):
        if end > begin or not leaves:
            leaves.append(digest(text[begin:end].encode("utf-8", "surrogatepass"), 0))
        begin = end
        if closes:
            begin += 1  # the line end
            paragraphs.append({"hash": node(leaves), "leaves": leaves})
            leaves = []
            if paragraphs[-1]["hash"] % SECTION == 0:
                sections.append({"hash": node([p["hash"] for p in paragraphs]), "paragraphs": paragraphs})
                paragraphs = []
    if paragraphs:
        sections.append({"hash": node([p["hash"] for p in paragraphs]), "paragraphs": paragraphs})
    top = hashlib.sha256(np.array([s["hash"] for s in sections], "<u8").tobytes() + len(text).to_bytes(8, "little"))
    return {"root": top.hexdigest()[:32], "sections": sections}


def written(t: dict) -> str:
    """A tree as its fingerprint: the root's 32 hex digits, then every node below in order: s, p or l and 48 bits of its hash."""
    levels, hashes = [], []
    for s in t["sections"]:
        levels.append("s")
        hashes.append(s["hash"])
        for p in s["paragraphs"]:
            levels.append("p" + "l" * len(p["leaves"]))
            hashes.append(p["hash"])
            hashes += p["leaves"]
    raw = np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    code = base64.urlsafe_b64encode(raw).decode()
    return t["root"] + "".join(k + code[8 * i : 8 * i + 8] for i, k in enumerate("".join(levels)))


def read(fingerprint: str) -> dict:
    """The tree that a fingerprint holds, with hashes as written."""
    sections: list[dict] = []
    for i in range(32, len(fingerprint), NODE):
        kind, h = fingerprint[i], fingerprint[i + 1 : i + NODE]
        if kind == "s":
            sections.append({"hash": h, "paragraphs": []})
        elif kind == "p":
            sections[-1]["paragraphs"].append({"hash": h, "leaves": []})
        else:
            sections[-1]["paragraphs"][-1]["leaves"].append(h)
    return {"root": fingerprint[:32], "sections": sections}


def fingerprint(text: str) -> str:
    return written(tree(text))


def _differing(a: list[dict], b: list[dict]) -> tuple[list[dict], list[dict], list[dict]]:
    """The branches that a and b share (each as often as in both), and what is left of either, in order."""
    there = Counter(x["hash"] for x in b)
    shared, left = [], []
    for x in a:
        if there[x["hash"]] > 0:
            there[x["hash"]] -= 1
            shared.append(x)
        else:
            left.append(x)
    rest = []
    for x in reversed(b):
        if there[x["hash"]] > 0:
            there[x["hash"]] -= 1
            rest.append(x)
    return shared, left, rest[::-1]


def compared(x: dict, y: dict) -> tuple[float, list[tuple[int, int]]]:
    """Likeness of two trees, and the ranges (first, end) of x's paragraphs that lie under branches which y lacks.

    Roots first, then sections, only differing sections by paragraph, only
    differing paragraphs by leaf. Likeness is the share of leaves in common: those
    under equal branches and equal leaves under differing ones, against the leaves of both.
    """
    size = lambda paragraphs: sum(len(p["leaves"]) for p in paragraphs)
    if x["root"] == y["root"]:
        return 1.0, []
    whole = [p for s in x["sections"] for p in s["paragraphs"]], [p for s in y["sections"] for p in s["paragraphs"]]
    same, left, right = _differing(x["sections"], y["sections"])
    common = sum(size(s["paragraphs"]) for s in same)
    same, left, right = _differing([p for s in left for p in s["paragraphs"]], [p for s in right for p in s["paragraphs"]])
    common += size(same)
    p, q = (Counter(h for part in side for h in part["leaves"]) for side in (left, right))
    common += (p & q).total()
    gone, out = {id(part) for part in left}, []
    for at, part in enumerate(whole[0]):
        if id(part) in gone:
            if out and out[-1][1] == at:
                out[-1][1] = at + 1
            else:
                out.append([at, at + 1])
    return common / (size(whole[0]) + size(whole[1]) - common), [(a, b) for a, b in out]


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Ranges of a's paragraphs under branches that b lacks, for two texts."""
    return compared(tree(a), tree(b))[1]


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1 (1 for equal roots)."""
    return compared(read(a), read(b))[0]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint for every row of docs; null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t or "") for t in part.column(1).to_pylist()], pa.string())], names=[key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(column(key), column(text)).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def in_ranges(docs: DataFrame, key: str, text: str, ranges: int) -> DataFrame:
    """Each row of docs in its range of keys, and with each range the row that follows its last one, marked as extra.

    Columns salt, bucket, k, h, t, extra. The order is by key, descending, null last;
    rows that repeat a key follow each other by their texts' hashes h, so a key with
    a third of all rows is split like any other. Bounds are those of Spark's own
    range partitioning of keys and hashes (one row a range comes to the driver); only
    a range's first row is sent twice. The range after the last is the first, so
    the whole is a ring. salt deals each range to a partition of its own.
    """
    spark = docs.sparkSession
    ids = docs.select(column(key).alias("k"), F.xxhash64(column(text)).alias("h"))
    n = max(1, ranges)
    place = F.struct("k", "h")
    lows = ids.repartitionByRange(n, "k", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(place).alias("low")).select("low").sort("low").collect()
    kind = ids.schema["k"].dataType
    bounds = F.array(*[F.struct(F.lit(r["low"]["k"]).cast(kind).alias("k"), F.lit(r["low"]["h"]).alias("h")) for r in lows[1:]]) if len(lows) > 1 else None
    bucket = (F.size(F.filter(bounds, lambda c: c <= place)) if bounds is not None else F.lit(0)).cast("int")
    heads = {r["bucket"]: (r["head"]["k"], r["head"]["h"]) for r in ids.withColumn("bucket", bucket).groupBy("bucket").agg(F.max(place).alias("head")).collect()}
    # in descending order the head of a range follows the last row of the next higher one; the highest one's head follows the lowest one's last
    order = sorted(heads)
    above = dict(zip(order, [*order[1:], *order[:1]]))
    is_head = F.lit(False)
    for b, (k, h) in heads.items():
        is_head = is_head | ((F.col("bucket") == b) & F.col("k").eqNullSafe(F.lit(k).cast(kind)) & (F.col("h") == h))
    to = F.create_map(*[F.lit(x) for pair in above.items() for x in pair]) if above else F.create_map(F.lit(0), F.lit(0))
    found = spark.range(64 * n).select(F.col("id").cast("int").alias("s")).groupBy(F.pmod(F.hash("s"), F.lit(n)).alias("p")).agg(F.min("s").alias("s")).collect()
    salts = F.create_map(*[F.lit(x) for r in found for x in (r["p"], r["s"])])
    rows = docs.select(column(key).alias("k"), F.xxhash64(column(text)).alias("h"), F.coalesce(column(text), F.lit("")).alias("t")).withColumn("bucket", bucket)
    own = F.struct("bucket", F.lit(0).alias("extra"))
    twice = F.when(is_head, F.array(own, F.struct(F.element_at(to, F.col("bucket")).alias("bucket"), F.lit(1).alias("extra")))).otherwise(F.array(own))
    rows = rows.withColumn("c", F.explode(twice)).select("c.bucket", "k", "h", "t", "c.extra")
    return rows.withColumn("salt", F.element_at(salts, F.col("bucket")))


def with_successors(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """For every row of docs: its fingerprint, that of its edited text, their likenesses, and where the edit is.

    The edited text is the text with its last third (floor of code points)
    replaced by the beginning of the next row's text, in descending order of key;
    after the last comes the first. Columns: key, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, n_edited_paragraphs (of
    the text's paragraphs, those under branches that the edited text lacks).

    Texts cross the network once, dealt by ranges of keys; a task reads its
    range in order and holds two texts. Keys may be of any type with an order, repeat
    (such rows follow each other by their texts' hashes, descending) or be null (these come
    last). Null texts are empty. A single row follows itself; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = in_ranges(docs, key, text, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        rows: list[tuple] = []
        held: tuple | None = None  # bucket, key, text, tree
        closed: set = set()
        kind = None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows))
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.string()) for c in cols[1:4]], *[pa.array(c, pa.float64()) for c in cols[4:6]], pa.array(cols[6], pa.int64())],
                names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_edited_paragraphs"],
            )
            keys.clear(), rows.clear()
            return out

        for b in batches:
            kind = b.column(1).type
            for s in range(0, b.num_rows, 256):
                for bucket, k, t, extra in zip(*(b.column(i).slice(s, 256).to_pylist() for i in range(4))):
                    if bucket in closed:  # repeats of the row that follows, already met
                        continue
                    mark = tree(t)
                    if held is not None and held[0] == bucket:
                        _, hk, ht, hf = held
                        cut = len(ht) // 3
                        edited = ht[: len(ht) - cut] + t[:cut]
                        ef = tree(edited)
                        near, where = compared(hf, ef)
                        keys.append(hk)
                        rows.append((len(ht), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(hf), written(ef), near, compared(hf, mark)[0], sum(e - a for a, e in where)))
                        if len(rows) >= 256:
                            yield flush()
                    held = (bucket, k, t, mark)
                    if extra:
                        closed.add(bucket)
        if rows:
            yield flush()

    dealt = placed.repartition(n, "salt").sortWithinPartitions(F.col("bucket"), F.col("extra"), F.col("k").desc_nulls_last(), F.col("h").desc()).select("bucket", "k", "t", "extra")
    columns = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_edited_paragraphs long"
    return dealt.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {columns}")
