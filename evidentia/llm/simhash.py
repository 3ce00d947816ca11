"""SimHash near-duplicates by a popcount embedding and a Manhattan grid join."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import column, components, in_batches, linked_in_cells, marked, saved

SHINGLE = 3
SEED = 42
#: Links differ in at most so many bits.
RADIUS = 3
#: The 32 two-bit segments fall into so many groups; RADIUS of them can differ.
GROUPS = 6
LOW = 0x5555555555555555


def fingerprint_hashes(text: str, width: int = SHINGLE) -> list[int]:
    """XXH64 of each word shingle of a text, A-Z lower-cased, repeats included.

    On bytes, lower() and split() know ASCII letters and white space only.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return [digest(joined, SEED)]
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens)
    starts = (ends - lens).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends - 1).tolist()[width - 1 :])]


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of one text's hashes: a bit is 1 if set in over half."""
    ones = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 65_536):
        rows = hashes[s : s + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash_texts(texts: list[str | None]) -> np.ndarray:
    """A fingerprint for each text; zero for null or no words."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        if text and (h := fingerprint_hashes(text)):
            out[k] = bits_of(np.array(h, np.uint64))
    return out


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; maps, which can't be hashed, as JSON."""
    return F.xxhash64(*[F.to_json(column(f.name)) if isinstance(f.dataType, MapType) else column(f.name) for f in docs.schema])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row (a hash of all its columns), fp (the 64 bits as a long) for each row of docs; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                fp = simhash_texts(part.column(2).to_pylist()).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp)], names=["key", "row", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return in_batches(docs.select(column(key).alias("key"), row_hash(docs).alias("row"), column(text).alias("text"))).mapInArrow(run, f"key {kind}, row long, fp long")


def group_masks() -> list[int]:
    """For each choice of GROUPS - RADIUS groups, the bits of their segments."""
    bounds = [round(32 * k / GROUPS) for k in range(GROUPS + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(bounds, bounds[1:])]
    return [sum(c) for c in combinations(masks, GROUPS - RADIUS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedded(fp) -> F.Column:
    """Each two-bit segment's popcount in unary (00, 01, 11).

    The Manhattan distance of two vectors of segment counts is then the number
    of bits in which these codes differ.
    """
    x, y = F.col(fp), F.shiftrightunsigned(F.col(fp), 1)
    low = x.bitwiseOR(y).bitwiseAND(F.lit(LOW))
    high = x.bitwiseAND(y).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(F.shiftleft(high, 1))


def grid_cells(nodes: DataFrame) -> DataFrame:
    """Each fingerprint in the 20 cells in which a neighbour within RADIUS must meet it.

    A Manhattan distance of at most 3 over six groups of segments leaves three
    groups with equal counts, so two neighbours share the grid cell of those
    three groups' counts: an exact range join without looking at other cells.
    """
    cells = F.array(*[F.struct(F.lit(k).cast("long").alias("cell_a"), F.col("code").bitwiseAND(F.lit(signed(m))).alias("cell_b")) for k, m in enumerate(group_masks())])
    return nodes.withColumn("code", embedded("fp")).select(F.explode(cells).alias("c"), F.col("fp").alias("id"), F.col("fp").alias("load")).select("c.cell_a", "c.cell_b", "id", "load")


def _unary(x: np.ndarray) -> np.ndarray:
    y, low, one = x >> np.uint64(1), np.uint64(LOW), np.uint64(1)
    return ((x | y) & low) | (((x & y) & low) << one)


def near(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Pairs whose segment counts lie within RADIUS, verified on all bits."""
    x, y = (np.asarray(v).view(np.uint64) for v in (a, b))
    close = np.bitwise_count(_unary(x)[:, None] ^ _unary(y)[None, :]) <= RADIUS
    i, j = np.nonzero(close)
    close[i, j] = np.bitwise_count(x[i] ^ y[j]) <= RADIUS
    return close


def _named(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, row, fp of each row; fp, root of each fingerprint), both saved: root is the smallest fingerprint reachable."""
    fps = saved(fingerprints(docs, key, text), "simhash-fp")
    nodes = saved(fps.select("fp").distinct(), "simhash-nodes")
    edges = linked_in_cells(grid_cells(nodes), near, "simhash")
    roots = components(edges, "simhash")
    named = saved(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-named")
    return fps, named


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint, component_id for every row of docs.

    Rows whose fingerprints differ in at most 3 bits are linked; component_id
    is the smallest key reachable. Equal fingerprints are one node, so groups
    of copies cost nothing. Null, empty and wordless texts have fingerprint
    zero. Rows with a null key keep a row but take part only by fingerprint
    (component_id is null where no row of the group has a key); rows that repeat
    a key each keep theirs. An empty table gives an empty result.
    """
    fps, named = _named(docs, key, text)
    lows = fps.groupBy("fp").agg(F.min("key").alias("low")).join(named, "fp")
    lowest = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = named.join(lowest, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(of_fp, "fp").select(F.col("key").alias(key), hexed, "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked rows, with docs' columns.

    It is the first by key (null last), and among rows of that key by a hash of
    all columns, so rows that repeat a key, or have none, are told apart by what
    else is in them. Of rows equal in every column one stays.
    """
    fps, named = _named(docs, key, text)
    order = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    # per fingerprint first, then per group: both with partial minima
    first = fps.groupBy("fp").agg(F.min(order).alias("first")).join(named, "fp").groupBy("root").agg(F.min("first").alias("first"))
    first = saved(first.select(F.col("first.key").alias("key"), F.col("first.row").alias("row")), "simhash-first")
    mark = f"__{uuid.uuid4().hex}"
    at = first.select(F.col("key").alias(f"{mark}k"), F.col("row").alias(f"{mark}r"))
    same = column(key).eqNullSafe(F.col(f"{mark}k")) & (F.col(mark) == F.col(f"{mark}r"))
    rows = docs.withColumn(mark, row_hash(docs))
    # rows equal in every column: thinned out before they are shuffled by what they share
    copies = fps.groupBy("key", "row").agg(F.count("*").alias("n")).filter("n > 1")
    copies = saved(copies.select("row").join(first, "row", "left_semi").distinct(), "simhash-copies")
    if copies.isEmpty():
        kept = rows.join(at, same, "left_semi")
    else:
        maybe = f"{mark}m"
        flagged = marked(rows, copies, [mark], ["row"], maybe)
        once = flagged.filter(column(maybe)).dropDuplicates([mark])
        kept = flagged.filter(~column(maybe)).unionByName(once).join(at, same, "left_semi")
    return kept.select(*map(column, docs.columns))
