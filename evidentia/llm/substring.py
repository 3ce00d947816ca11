"""Substring dedup: MinHash bands over paragraphs, exact verification, components; and every run of 50 words that repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, components, dropped, few, in_batches, linked_in_cells, marked, saved

SHINGLE = 5
#: Jaccard similarity of shingle sets, in tenths.
TENTHS = 8
#: 5 bands of 2: two paragraphs of similarity 0.8 meet with probability 0.994.
BANDS, ROWS = 5, 2
#: A word that is smallest by hash among so many on either side starts a paragraph inside a long line.
REACH = 8
#: A run of so many words that repeats exactly is found wherever it starts.
RUN = 50
#: Runs meet by the smallest hash among their grams of so many words.
GRAM = 26
MIX = np.uint64(0x9E3779B97F4A7C15)


P1, P2, P3, P4, P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 5


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    """The bits of x turned left by n."""
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def word_hashes(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 (seed SEED) of the words raw[start:end], worked out side by side; raw has at least 8 bytes behind the last word.

    Words of 32 bytes and more, for which XXH64 has another form, go to the library.
    """
    size = end - start
    out = np.empty(len(start), np.uint64)
    for i in np.flatnonzero(size >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]], SEED)
    lanes = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    # by length, so that the words that have a step are one slice
    order = np.argsort(np.minimum(size, 32).astype(np.uint8), kind="stable")
    at, size = start[order], size[order]
    n = np.searchsorted(size, np.arange(33))  # the first word of each length
    at, size = at[: n[32]], size[: n[32]].view(np.uint64)
    h = size + (P5 + np.uint64(SEED))
    left = lanes[at]  # the eight bytes from the first one not used yet
    for k in range(1, 4):
        s = slice(n[8 * k], None)
        if n[8 * k] == len(at):
            break
        h[s] = _turned(h[s] ^ _turned(left[s] * P2, 31) * P1, 27) * P1 + P4
        left[s] = lanes[at[s] + 8 * k]
    rest = size & np.uint64(7)
    four = np.flatnonzero(rest >= 4)
    h[four] = _turned(h[four] ^ (left[four] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    left[four] >>= np.uint64(32)
    rest &= np.uint64(3)
    for k in range(1, 4):
        one = np.flatnonzero(rest >= k)
        h[one] = _turned(h[one] ^ (left[one] & np.uint64(255)) * P5, 11) * P1
        left[one] >>= np.uint64(8)
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    out[order[: n[32]]] = h ^ (h >> np.uint64(32))
    return out


class Cutter:
    """Cuts texts into paragraphs.

    Lines are paragraphs; long lines are cut where a word's hash is a local
    minimum, so the same passage is cut alike wherever in a line it stands.
    """

    @staticmethod
    def read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, line and text of every word."""
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        begin = np.cumsum([1, *(len(x) + 1 for x in raws)])[:-1]
        raw = b"\n".join([b"", *raws, b" " * 8])
        x = np.frombuffer(raw, np.uint8)
        space = (x == 32) | (x - np.uint8(9) < 5)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # raw begins and ends with white space
        start, end = edge[::2], edge[1::2]
        line = np.searchsorted(np.flatnonzero(x == 10), start)
        # lines without a word aren't numbered
        line = np.cumsum(np.diff(line, prepend=line[:1]) != 0)
        return word_hashes(raw, start, end), line, np.searchsorted(begin, start, side="right") - 1

    @staticmethod
    def cut(h: np.ndarray, line: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
        """For what read() gives: text, start (in words), size, hash of each paragraph, and the paragraphs' places among all words."""
        n = len(h)
        if not n:
            e = np.zeros(0, np.int64)
            return e, e, e, np.zeros(0, np.uint64), e
        low = np.ones(n, bool)
        for d in range(1, REACH + 1):
            if d >= n:
                break
            same = line[d:] == line[:-d]
            less = h[d:] < h[:-d]
            low[d:] &= less & same  # both sides must lie in the line
            low[:-d] &= (h[:-d] <= h[d:]) & same
            low[:d] = False
            low[n - d :] = False
        start = low.copy()
        start[0] = True
        start[1:] |= line[1:] != line[:-1]
        at = np.flatnonzero(start)
        size = np.diff(np.concatenate([at, [n]]))
        place = np.arange(n) - at[np.cumsum(start) - 1]
        # hash of a paragraph: its words' hashes, mixed with their places
        mixed = (h ^ (place.astype(np.uint64) + np.uint64(1)) * MIX) * MIX
        mixed ^= mixed >> np.uint64(31)
        whole = np.add.reduceat(mixed * MIX, at)
        first = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1])
        word_of = np.arange(n) - first[np.searchsorted(first, at, side="right") - 1][np.cumsum(start) - 1]
        return text[at], word_of[at], size, whole, at


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word shingles that start at each word (runs over the end are not used)."""
    if len(h) < SHINGLE:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for d in range(SHINGLE):
        out = (out ^ h[d : len(h) - SHINGLE + 1 + d]) * MIX
        out ^= out >> np.uint64(32)
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs."""
    out = (a ^ (b * MIX + (b >> np.uint64(29)))) * np.uint64(0xA24BAED4963EE407)
    return out ^ (out >> np.uint64(32))


def _over(pick: np.ufunc, x: np.ndarray, span: int) -> np.ndarray:
    """The smallest or largest (pick) of each span values that follow each other, by windows of doubled length."""
    size = 1
    while size < span:
        step = min(size, span - size)
        x = pick(x[: len(x) - step], x[step:])
        size += step
    return x


def windows(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words' hashes and texts: place, hash and mark of each run of RUN words in a text, and the places of all marked grams.

    The mark is the smallest hash of the run's grams, so equal runs have equal
    marks, and neighbouring runs mostly share theirs.
    """
    e = np.zeros(0, np.int64)
    if len(h) < RUN:
        return e, np.zeros(0, np.uint64), np.zeros(0, np.uint64), e
    n = len(h) - RUN + 1
    g = [h]
    for k in range(5):  # g[k]: runs of 2 ** k words
        g.append(_joined(g[k][: -(1 << k)], g[k][1 << k :]) if len(g[k]) > 1 << k else g[k][:0])
    whole = _joined(g[5][:n], g[5][RUN - 32 :][:n])
    gram = _joined(g[4][: len(h) - GRAM + 1], g[4][GRAM - 16 :])
    span = RUN - GRAM + 1  # grams in a run
    mark = _over(np.minimum, gram, span)
    ok = text[:n] == text[RUN - 1 :]
    # a gram is marked if it is the smallest of any run it lies in, that is, of the run with the largest mark
    padded = np.concatenate([np.zeros(span - 1, np.uint64), np.where(ok, mark, np.uint64(0)), np.zeros(span - 1, np.uint64)])
    marked = np.flatnonzero(_over(np.maximum, padded, span) == gram)
    at = np.flatnonzero(ok)
    return at, whole[at], mark[at], np.stack([marked, gram[marked].view(np.int64)])


def _shingles_of(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of paragraphs that have one, one paragraph after another; where each one's end; their numbers."""
    sh = shingles(words)
    n = size - SHINGLE + 1
    ends = np.cumsum(n)
    return sh[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], ends, n


def distinct_shingles(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For paragraphs that have a shingle: the number of their distinct shingles, and these, one paragraph after another."""
    flat, _, n = _shingles_of(words, at, size)
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((flat, of))
    flat, of = flat[order], of[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
    return np.bincount(of[new], minlength=len(n)), flat[new]


def bands(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The MinHash bands of paragraphs that have a shingle, a row each; a band's number is mixed into its value."""
    flat, ends, n = _shingles_of(words, at, size)
    low = []
    for k in range(BANDS * ROWS):
        x = (flat ^ np.uint64(0xA24BAED4963EE407 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * MIX
        low.append(np.minimum.reduceat(x ^ (x >> np.uint64(29)), ends - n) if len(ends) else np.zeros(0, np.uint64))
    return np.stack([((low[ROWS * k] * MIX) ^ low[ROWS * k + 1]) * MIX + np.uint64(k) for k in range(BANDS)])


VALUES = [f"v{k}" for k in range(BANDS)]


def parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, th, start, size, h, v0, ... of each paragraph, and doc, th, h of each text's marks of runs (size is null there). One pass over the texts.

    A document is its key and its text's hash th. Paragraphs without a shingle
    have no band values; they meet by their hash h alone.
    """
    names = ["doc", "th", "start", "size", "h", *VALUES]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Cutter()
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                words, line, of = c.read(part.column(2).to_pylist())
                if not len(words):
                    continue
                t, start, size, h, at = c.cut(words, line, of)
                use = size >= SHINGLE
                values = np.zeros((BANDS, len(h)), np.int64)
                values[:, use] = bands(words, at[use], size[use]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t)), part.column(1).take(pa.array(t)), pa.array(start), pa.array(size), pa.array(h.view(np.int64)), *(pa.array(v, mask=~use) for v in values)], names=names)
                *_, marked = windows(words, of)
                if marked.size:
                    t, n = of[marked[0]], marked.shape[1]
                    none = pa.nulls(n, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t)), part.column(1).take(pa.array(t)), none, none, pa.array(marked[1]), *[none] * BANDS], names=names)

    rows = docs.select(column(key).alias("doc"), F.xxhash64(column(text)).alias("th"), column(text))
    return in_batches(rows).mapInArrow(run, f"doc {kind}, th long, start long, size long, h long, {', '.join(f'{v} long' for v in VALUES)}")


def _texts_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """doc, th, t, hs: the documents of wanted (doc, th, h) with their text and the list of their h (at most a document's words)."""
    of = wanted.groupBy(F.col("doc").alias("of"), F.col("th").alias("oh")).agg(F.collect_set("h").alias("hs"))
    rows = few(docs.select(column(key).alias("doc"), F.xxhash64(column(text)).alias("th"), column(text).alias("t")), wanted, ["doc", "th"], ["doc", "th"])
    return rows.join(of, F.col("doc").eqNullSafe(F.col("of")) & (F.col("th") == F.col("oh"))).select("doc", "th", "t", "hs")


def _place() -> Column:
    """The order of places: by key, null last, then text's hash."""
    return F.struct(F.col("doc").isNull().alias("none"), "doc", "th", "start")


def stretches(at: np.ndarray, whole: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs by place, hash and mark: first run, number of runs, hash of each stretch, and whether a run stands in it twice.

    A stretch is as many runs as follow each other and have one mark.
    """
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (mark[1:] != mark[:-1])]))
    n = np.diff(np.concatenate([first, [len(at)]]))
    of = np.repeat(np.arange(len(first)), n)
    mixed = (whole ^ (np.arange(len(at)) - first[of] + 1).astype(np.uint64) * MIX) * MIX
    mixed ^= mixed >> np.uint64(31)
    order = np.lexsort((whole, of))
    twice = (np.diff(of[order]) == 0) & (whole[order][1:] == whole[order][:-1])
    loop = np.zeros(len(first), bool)
    loop[of[order][1:][twice]] = True
    return first, n, np.add.reduceat(mixed * MIX, first), loop


def repeated_runs(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, th, start, size, keeper, first for every run of RUN words that stands in docs more than once, across lines too; runs that follow each other may be one row.

    found are the parts of docs. keeper is the first key with the run, and first
    marks its first place there. Only runs whose mark is that of two or more grams
    are looked at, which loses none: equal runs have equal marks. They are told
    apart as stretches: equal stretches are one class, and where all stretches of a mark
    are equal their runs stand nowhere else. Only the other classes are spelled out in runs,
    each class once, however many places it has.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    marks = found.filter("size is null").select("doc", "th", "h")
    twice = saved(marks.groupBy("h").count().filter("count > 1").select("h"), "run-twice")
    wanted = saved(few(marks, twice, ["h"], ["h"]).join(twice, "h", "left_semi").distinct(), "run-wanted")
    dropped(spark, twice)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Cutter()
        for b in batches:
            for s in range(0, b.num_rows, 64):
                part = b.slice(s, 64)
                h, _, of = c.read(part.column(2).to_pylist())
                at, whole, mark, _ = windows(h, of)
                use = np.isin(mark.view(np.int64), part.column(3).flatten().to_numpy(zero_copy_only=False))
                at, whole, mark = at[use], whole[use], mark[use]
                if not len(at):
                    continue
                first, n, value, loop = stretches(at, whole, mark)
                begin = np.searchsorted(of, np.arange(part.num_rows))  # each text's first word
                t = of[at[first]]
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(whole.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(t)), part.column(1).take(pa.array(t)), pa.array(at[first] - begin[t]), pa.array(n), pa.array(mark[first].view(np.int64)), pa.array(value.view(np.int64)), pa.array(loop), runs],
                    names=["doc", "th", "start", "n", "mark", "value", "loop", "runs"],
                )

    rows = saved(_texts_of(docs, wanted, key, text).mapInArrow(cut, f"doc {kind}, th long, start long, n long, mark long, value long, loop boolean, runs array<long>"), "run-stretches")
    dropped(spark, wanted)
    # rows equal in key and text are one document, so places are held against each other, not counted
    classes = rows.groupBy("value").agg(F.min(_place()).alias("head"), F.max(_place()).alias("last"), F.first("n").alias("n"), F.first("mark").alias("mark"), F.first("loop").alias("loop"))
    classes = saved(classes.select("value", "head", (~F.col("head").eqNullSafe(F.col("last"))).alias("again"), "n", "mark", "loop"), "run-classes")
    several = classes.groupBy("mark").count().filter("count > 1").select("mark", F.lit(True).alias("several"))
    classes, given = saved(classes.join(several, "mark", "left").withColumn("open", F.col("several").isNotNull() | F.col("loop")).drop("mark", "loop", "several"), "run-classes"), classes
    dropped(spark, given)
    todo = classes.filter("open").select("value", "head", "again")
    at = ["value", "th", "start"]
    one = few(rows, todo.select("value", "head.th", "head.start"), at, at).join(todo, "value").filter(_place().eqNullSafe(F.col("head"))).dropDuplicates(["value"])
    one = one.select("value", "head", "again", "doc", "th", F.col("start").alias("from"), F.posexplode("runs").alias("i", "h"))
    one = saved(one.select("value", "head", "again", "doc", "th", (F.col("from") + F.col("i")).alias("start"), "i", "h"), "run-rows")
    heads = one.groupBy("h").agg(F.min(_place()).alias("to"), F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n"))
    heads = saved(heads.filter("n > 1").select("h", "to"), "run-heads")
    each = few(one, heads, ["h"], ["h"]).join(heads, "h").select("value", "head", "i", F.col("to.doc").alias("keeper"), _place().eqNullSafe(F.col("to")).alias("first"))
    # runs of a class that follow each other and have one keeper are one row
    nth = F.row_number().over(Window.partitionBy("value", "keeper", "first").orderBy("i"))
    spans = each.withColumn("row", F.col("i") - nth).groupBy("value", "keeper", "first", "row").agg(F.first("head").alias("head"), F.min("i").alias("i"), (F.max("i") - F.min("i") + RUN).alias("size"))
    names = ["value", "head", "i", "size", "keeper", "first"]
    plain = classes.filter("again and not open").select("value", "head", F.lit(0).alias("i"), (F.col("n") - 1 + RUN).alias("size"), F.col("head.doc").alias("keeper"), F.lit(True).alias("first"))
    spans = saved(spans.select(*names).unionByName(plain), "run-spans")
    dropped(spark, one, heads, classes)
    each = few(rows.select("doc", "th", "start", "value"), spans, ["value"], ["value"]).distinct().join(spans, "value")
    out = saved(each.select("doc", "th", (F.col("start") + F.col("i")).alias("start"), F.col("size").cast("long").alias("size"), "keeper", (F.col("first") & _place().eqNullSafe(F.col("head"))).alias("first")), "run-places")
    dropped(spark, rows, spans)
    return out


def _sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """h, s: the shingles of the paragraphs whose hashes are in ids (h)."""
    wanted = saved(few(classes, ids, ["h"], ["h"]).join(ids, "h", "left_semi").select("h", F.col("at.doc").alias("doc"), F.col("at.th").alias("th")), "sub-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Cutter()
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                words, line, of = c.read(part.column(2).to_pylist())
                _, _, size, h, at = c.cut(words, line, of)
                h = h.view(np.int64)
                hs, first = np.unique(h, return_index=True)
                # a paragraph that another text of the slice was read for is as good
                use = np.isin(hs, part.column(3).flatten().to_numpy(zero_copy_only=False)) & (size[first] >= SHINGLE)
                sizes, values = distinct_shingles(words, at[first[use]], size[first[use]])
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(hs[use]), sets], names=["h", "s"])

    out = saved(_texts_of(docs, wanted, key, text).mapInArrow(run, "h long, s array<long>").dropDuplicates(["h"]), "sub-sets")
    dropped(docs.sparkSession, wanted)
    return out


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of paragraphs with a Jaccard similarity of shingles (sets: h, s) of at least 0.8."""
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("y")), "b")
    both = both.withColumn("n", F.size(F.array_intersect("x", "y")))
    return saved(both.filter(F.col("n") * (10 + TENTHS) >= (F.size("x") + F.size("y")) * TENTHS).select("a", "b"), "sub-links")


def left_open(met: DataFrame, near: DataFrame) -> DataFrame:
    """value, h: what is still to be compared, of met (h, value, lead) when near has the links of leads.

    A lead has been held against all others of its bucket. So it isn't compared again,
    and a bucket is open only if one of at least two others failed.
    """
    others = met.filter("h <> lead")
    linked = near.select(F.col("a").alias("lead"), F.col("b").alias("h"), F.lit(True).alias("linked"))
    open_ = others.join(linked, ["lead", "h"], "left").groupBy("value").agg(F.count("*").alias("n"), F.count("linked").alias("linked")).filter("n > 1 and linked < n").select("value")
    return others.join(open_, "value").select("value", "h")


def alike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Pairs of shingle sets with a Jaccard similarity of at least 0.8."""
    x, y = a.flatten().to_numpy(zero_copy_only=False), b.flatten().to_numpy(zero_copy_only=False)
    kinds, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    n, m = (np.asarray(v.value_lengths().to_numpy(zero_copy_only=False), np.int64) for v in (a, b))
    rows, cols = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
    shared = np.zeros((len(n), len(m)), np.float32)
    for s in range(0, len(kinds), 4096):  # the incidence of so many shingles at a time
        p, q = np.zeros((len(n), 4096), np.float32), np.zeros((len(m), 4096), np.float32)
        i, j = at[: len(x)] - s, at[len(x) :] - s
        ok, ko = (i >= 0) & (i < 4096), (j >= 0) & (j < 4096)
        p[rows[ok], i[ok]] = 1
        q[cols[ko], j[ko]] = 1
        shared += p @ q.T
    return shared * (10 + TENTHS) >= (n[:, None] + m[None, :]) * TENTHS


def repeated_paragraphs(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, th, start, size, component, keeper, first for every paragraph that repeats exactly or nearly.

    found are the parts of docs. component is the smallest paragraph hash
    reachable; keeper is the first key in the component, and first marks the one
    paragraph that stays (the first of the first document). Paragraphs of the
    same hash are one node. Band values are shuffled once, with each value's
    smallest and largest paragraph; what follows reads only values that two
    different paragraphs share. In each such bucket all are held against the
    smallest; in buckets in which some fail the others are compared throughout, block by block, so
    components are those of all colliding pairs without spelling them out.
    """
    spark = docs.sparkSession
    # rows equal in key and text are one document
    own = found.filter("size is not null").select("doc", "th", "start", "size", "h")
    places = own.groupBy("h").agg(F.min(_place()).alias("at"), F.max(_place()).alias("end"))
    classes = saved(places.select("h", "at", (~F.col("at").eqNullSafe(F.col("end"))).alias("again")), "sub-classes")
    dropped(spark)
    values = found.filter(f"{VALUES[0]} is not null").select("h", F.explode(F.array(*VALUES)).alias("value"))
    by = values.groupBy("value").agg(F.min("h").alias("lead"), F.max("h").alias("last")).filter("lead <> last").select("value", "lead")
    by = saved(by, "sub-values")
    dropped(spark)
    met = saved(few(values, by, ["value"], ["value"]).join(by, "value").distinct(), "sub-bands")
    star = saved(met.filter("h <> lead").select(F.col("lead").alias("a"), F.col("h").alias("b")).distinct(), "sub-star")
    dropped(spark, by)
    sets = _sets(docs, classes, met.select("h").distinct(), key, text)
    near = _verified(sets, star)
    cells = saved(left_open(met, near), "sub-open")
    dropped(spark, met, star)
    loads = cells.join(sets, "h").select(F.lit(0).cast("long").alias("cell_a"), F.col("value").alias("cell_b"), F.col("h").alias("id"), F.col("s").alias("load"))
    far = linked_in_cells(loads, alike, "sub")
    dropped(spark, cells, sets)
    roots = saved(components(near.unionByName(far), "sub").select(F.col("node").alias("h"), "root"), "sub-roots")
    flagged = marked(classes, roots, ["h"], ["h"], "linked").filter("linked or again")
    named = flagged.join(roots, "h", "left").select("h", F.coalesce("root", "h").alias("component"), "again", "at")
    # a component of one paragraph without another place is none
    groups = named.groupBy("component").agg(F.min("at").alias("head"), F.count("*").alias("n"), F.max("again").alias("again")).filter("n > 1 or again").select("component", "head")
    named = saved(named.select("h", "component").join(groups, "component"), "sub-named")
    dropped(spark, classes, roots)
    rows = few(own, named, ["h"], ["h"]).join(named, "h").distinct()
    out = saved(rows.select("doc", "th", "start", "size", "component", F.col("head.doc").alias("keeper"), _place().eqNullSafe(F.col("head")).alias("first")), "sub-places")
    dropped(spark, named)
    return out


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keeper, n_paragraphs, n_words, n_removed_words for each pair of documents that share paragraphs or runs of RUN words.

    keeper is the document that comes first (by key, null last, then text's
    hash) in a paragraph's component, or with a run; a document that keeps the passage
    itself has a row with keeper = key. n_paragraphs counts paragraphs only (0 where
    runs alone are shared), n_words each word once. Words of the first place of a
    run don't count as removed by runs that overlap it. A pair has a row however
    few words it shares. Rows that repeat a key with other texts are documents of
    their own, summed up under their key; rows equal in key and text are one
    document that is given more than once. Null keys are a key like any other; null,
    empty and wordless texts share nothing; an empty table gives an empty result.
    """
    found = saved(parts(docs, key, text), "sub-parts")
    # kinds: 0 a paragraph's first place, 1 another one, 2 a run's first place, 3 another one
    kinds = ((0, repeated_paragraphs(docs, found, key, text)), (2, repeated_runs(docs, found, key, text)))
    dropped(docs.sparkSession, found)
    spans = [x.select("doc", "th", "keeper", "start", (F.col("start") + F.col("size")).alias("end"), F.when(F.col("first"), k).otherwise(k + 1).alias("kind")) for k, x in kinds]
    before = Window.partitionBy("doc", "th", "keeper").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    unions = {"u0": (0, 1, 2, 3), "u1": (1, 2, 3), "u2": (1, 2), "u3": (1,)}
    end = {u: F.when(F.col("kind").isin(*k), F.col("end")) for u, k in unions.items()}
    # words of a span behind the end of all earlier ones of the union; null outside it
    new = [F.greatest(F.lit(0), end[u] - F.greatest("start", F.coalesce(F.max(end[u]).over(before), "start"))).alias(u) for u in unions]
    new = [F.when(end[u].isNotNull(), x).otherwise(0).alias(u) for u, x in zip(unions, new)]
    out = spans[0].unionByName(spans[1]).select("doc", "keeper", "kind", *new).groupBy(F.col("doc").alias(key), F.col("keeper").alias(f"keeper_{key}"))
    # removed: other places of paragraphs, and of runs but for the words of runs' first places
    return out.agg(F.count_if(F.col("kind") < 2).alias("n_paragraphs"), F.sum("u0").alias("n_words"), (F.sum("u1") - F.sum("u2") + F.sum("u3")).alias("n_removed_words"))
