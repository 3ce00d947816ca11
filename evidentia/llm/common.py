"""Scratch tables, word rules, block-wise linking and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule shared by the operators: runs of anything but space and \t-\r.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
WORD_RUN = "[^\\x20\\x09-\\x0D]+"
#: Rows that can be skipped are known by a bit for each of 2**k hash buckets; k lies between these, by how many rows are wanted.
FILTER_BITS = (12, 24)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts go to Python in Arrow batches of at most so many rows.
BATCH_ROWS = 1024


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir.

    Only in a local session without that setting (as in tests) a temporary
    folder is made and kept in it; on a cluster its absence is an error, since
    executors couldn't see a folder of the driver.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Write df to the shared folder and read it again; this cuts lineage. options are the writer's."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more, and let Spark delete the shuffle files of ended steps.

    Spark's cleaner deletes shuffle files once the driver has collected the
    objects that stand for them; without a collection they stay for as long as
    the driver's heap isn't full.
    """
    jvm = spark._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def in_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have at most BATCH_ROWS rows.

    A worker holds two batches and its JVM builds a third; with Spark's 10,000
    rows these are some 60 MB each where a text has 6 KB.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, with as many of them made one as it takes to have rows rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held.clear()
    if held:
        yield pa.concat_batches(held)


def column(name: str) -> Column:
    """A column by its whole name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores behind it as it takes to clash with none of taken."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def dense(marks: DataFrame, buckets: int, kind: str) -> DataFrame:
    """One row, one column x: an array of numbers for the buckets 0 to buckets - 1, from marks (bucket, level), zero where there is none.

    Its size is fixed by buckets; the array is built from 256 parts, so that no
    task meets more than buckets / 256 numbers or 256 parts.
    """
    part = max(1, buckets >> 8)
    zero = marks.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast(kind).alias("level"))
    full = marks.select(F.col("bucket").cast("long").alias("bucket"), F.col("level").cast(kind).alias("level")).unionByName(zero).groupBy("bucket").agg(F.bit_or("level").alias("level"))
    parts = full.groupBy(F.floor(F.col("bucket") / part).alias("part")).agg(F.sort_array(F.collect_list(F.struct("bucket", "level"))).alias("x"))
    parts = parts.select("part", F.transform("x", lambda s: s["level"]).alias("x"))
    return parts.agg(F.sort_array(F.collect_list(F.struct("part", "x"))).alias("x")).select(F.flatten(F.transform("x", lambda s: s["x"])).alias("x"))


def marked(rows: DataFrame, wanted: DataFrame, here: list[str], there: list[str], name: str) -> DataFrame:
    """rows with a boolean column name: whether its columns here may be among wanted's columns there. A filter of bounded size, before any shuffle.

    A bit for each hash bucket, about eight for each wanted row within
    FILTER_BITS; beyond that it lets more rows through, and what follows stays exact.
    """
    low, high = FILTER_BITS
    bits = min(high, max(low, (8 * wanted.count()).bit_length()))
    place = lambda names: F.pmod(F.xxhash64(*map(column, names)), F.lit(1 << bits))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    marks = wanted.select(place(there).alias("at")).groupBy(F.shiftright("at", 6).alias("bucket")).agg(F.bit_or(one(F.col("at"))).alias("level"))
    words = dense(marks, 1 << (bits - 6), "long").scalar()
    return rows.withColumn(name, words[F.shiftright(place(here), 6).cast("int")].bitwiseAND(one(place(here))) != 0)


def few(rows: DataFrame, wanted: DataFrame, here: list[str], there: list[str]) -> DataFrame:
    """The rows whose columns here may be among wanted's columns there, see marked."""
    name = f"__{uuid.uuid4().hex}"
    return marked(rows, wanted, here, there, name).filter(column(name)).drop(name)


def forest(ids: np.ndarray, left: np.ndarray, right: np.ndarray, parent: dict) -> list[tuple]:
    """Edges of (left, right) positions in ids that join two trees of parent."""
    out = []
    for i, j in zip(left.tolist(), right.tolist()):
        a, b = i, j
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent.setdefault(b, b) != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


#: link(payload_of_a_block, payload_of_another) -> matrix of linked pairs
Link = Callable[[list, list], np.ndarray]


def _cell_edges(ids: np.ndarray, load: pa.Array, link: Link, step: int) -> list[tuple]:
    parent: dict = {}
    out = []
    for a in range(0, len(ids), step):
        for b in range(a, len(ids), step):
            m = link(load.slice(a, step), load.slice(b, step))
            if a == b:
                m = np.triu(m, 1)
            i, j = np.nonzero(m)
            out += forest(ids, i + a, j + b, parent)
    return out


def linked_in_cells(cells: DataFrame, link: Link, label: str, cap: int = 2048) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links inside each cell.

    cells has cell_a, cell_b (long: the cell's key), id (long) and load (what
    link compares). A cell of up to cap rows is compared where it lies.
    Rows of a larger one are passed on, dealt into blocks of about cap / 2 rows and
    compared block against block in tasks of their own, so that no task holds
    more than a fixed number of rows of a cell and no comparison is left out.
    Only edges that join two trees are given out: fewer than a cell has rows.
    """
    schema = "cell_a long, cell_b long, id long, load {}, other long".format(cells.schema["load"].dataType.simpleString())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list[pa.Table] = []
        over = None  # the key of a cell that has grown too large

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(keep).combine_chunks()
            keep.clear()
            ids = t["id"].to_numpy()
            if len(ids) > 1:
                found = _cell_edges(ids, t["load"].combine_chunks(), link, 512)
                if found:
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.nulls(n, t["load"].type), pa.array([x[1] for x in found], pa.int64())],
                        names=["cell_a", "cell_b", "id", "load", "other"],
                    )

        def passed(t: pa.Table) -> Iterator[pa.RecordBatch]:
            # built anew, so that all batches of the stream have nullable fields alike
            for b in t.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64())], names=[*b.schema.names, "other"])

        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            a, b = batch["cell_a"].to_numpy(), batch["cell_b"].to_numpy()
            cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            starts = np.concatenate([[0], cut])
            ends = np.concatenate([cut, [len(a)]])
            # Runs of one row inside a batch are whole cells without a pair.
            use = (ends - starts > 1) | (starts == 0) | (ends == len(a))
            for s, e in zip(starts[use].tolist(), ends[use].tolist()):
                key = (a[s], b[s])
                if key != last:
                    if held > 1:
                        yield from close()
                    keep.clear()
                    last, held, over = key, 0, None
                part = t.slice(s, e - s)
                if over == key:
                    yield from passed(part)
                    continue
                keep.append(part)
                held += e - s
                if held > cap:
                    yield from passed(pa.concat_tables(keep))
                    keep.clear()
                    held, over = 0, key
        if held > 1:
            yield from close()

    spread = cells.repartition("cell_a", "cell_b").sortWithinPartitions("cell_a", "cell_b")
    first = saved(spread.mapInArrow(walk, schema), f"{label}-cells")
    edges = first.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    large = first.filter("other is null")
    sizes = large.groupBy("cell_a", "cell_b").agg(F.ceil(F.count("*") / F.lit(cap // 2)).alias("blocks"))
    dealt = (
        large.drop("other").join(sizes, ["cell_a", "cell_b"])
        .withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
        .withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("cell_a", "cell_b", F.least("own", "mate").alias("row"), F.greatest("own", "mate").alias("col"), "id", "load")
    )

    def block(t: pa.Table) -> pa.Table:
        found = _cell_edges(t["id"].to_numpy(), t["load"].combine_chunks(), link, 512)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    rest = dealt.groupBy("cell_a", "cell_b", "row", "col").applyInArrow(block, "a long, b long")
    out = saved(edges.unionByName(rest), f"{label}-edges")
    dropped(cells.sparkSession, first)
    return out


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's edges as stars around the smallest node of each of their trees."""
    parent: dict[int, int] = {}
    for batch in batches:
        ids, place = np.unique(np.concatenate([batch["a"].to_numpy(), batch["b"].to_numpy()]), return_inverse=True)
        ids = ids.tolist()
        for i, j in place.reshape(2, -1).T.tolist():
            a, b = ids[i], ids[j]
            while parent.setdefault(a, a) != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            while parent.setdefault(b, b) != b:
                parent[b] = parent[parent[b]]
                b = parent[b]
            parent[max(a, b)] = min(a, b)
    nodes, roots = [], []
    for a in parent:
        b = a
        while parent[b] != b:
            b = parent[b]
        if a != b:
            nodes.append(a)
            roots.append(b)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])


#: Edges are dealt into parts of about so many before the first star step.
PART = 200_000


def components(edges: DataFrame, label: str) -> DataFrame:
    """node, root for each node of edges (a, b): root is the smallest node reachable.

    Edges are first dealt into parts of about PART, whatever their nodes, and each
    part becomes a forest of stars; this shortens chains and needs memory of fixed size.
    Then large-star and small-star steps alternate until nothing changes. Each
    step is a partial minimum and a join, so a node with a third of all edges
    is neither collected nor met in one task; each round's edges are a table
    in the shared folder. Loops and repeated edges don't matter.
    """
    spark = edges.sparkSession
    given = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-star")
    now = saved(given.repartition(-(-given.count() // PART) or 1).mapInArrow(_stars, "a long, b long").distinct(), f"{label}-star")
    dropped(spark, given)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.filter("a <> b").distinct(), f"{label}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        last, now = now, saved(small.distinct(), f"{label}-star")
        dropped(spark, last, large)
        new = _state(now)
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and two order-free sums over all edges: equal only if nothing changed."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))).first()
    return tuple(r)
