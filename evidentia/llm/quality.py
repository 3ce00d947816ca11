"""Quality rules: counted limits, then a calibrated n-gram logistic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of the hashed features.
BITS = 18
#: Labelled documents that the classifier is fitted on at most (a sample by hash of the key).
FIT_ROWS = 2500
EPOCHS = 80
SCALE = 30.0
#: Fixed limits.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_PROBABILITY = 0.5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
KEEP_WORDS = 400_000
MASK = np.uint64((1 << BITS) - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Numbers words; keeps each one's hash and the buckets of its own features."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hash = np.zeros(0, np.uint64)
        self.buckets = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)

    def rows(self, texts: list[str | None]) -> list[list[int]]:
        number = self.number
        out = []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").split() if t else []
            row = [number.get(w) for w in words]
            if None in row:
                row = [number.setdefault(w, len(number)) for w in words]
            out.append(row)
        self._learn()
        return out

    def _learn(self) -> None:
        new = list(self.number)[len(self.hash) :]
        if not new:
            return
        digest = xxhash.xxh64_intdigest
        self.hash = np.concatenate([self.hash, np.array([digest(w, 1) for w in new], np.uint64)])
        raw = np.frombuffer(b"".join(b"<%b>" % w for w in new), np.uint8).astype(np.uint64)
        size = np.array([len(w) + 2 for w in new])
        of = np.repeat(np.arange(len(new)), size)
        gram = (raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16)) + np.uint64(1 << 40)
        inside = of[:-2] == of[2:]
        gram = (gram[inside] * MIX >> np.uint64(64 - BITS)).astype(np.int64)
        own = (self.hash[-len(new) :] >> np.uint64(64 - BITS)).astype(np.int64)
        # each word: its own bucket, then those of its character trigrams
        which = np.concatenate([np.arange(len(new)), of[:-2][inside]])
        order = np.argsort(which, kind="stable")
        self.buckets = np.concatenate([self.buckets, np.concatenate([own, gram])[order]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.bincount(which, minlength=len(new)))])

    def pairs(self, row: np.ndarray) -> np.ndarray:
        """Buckets of the word bigrams of one text."""
        h = self.hash[row]
        return (((h[:-1] * MIX) ^ h[1:]) * MIX >> np.uint64(64 - BITS)).astype(np.int64)


class Classifier:
    """Weights, bias and calibration of the logistic regression."""

    def __init__(self) -> None:
        self.w, self.b = np.zeros(1 << BITS), 0.0
        self.slope, self.shift = 1.0, 0.0

    def fit(self, texts: list[str], labels: np.ndarray) -> Classifier:
        """Full-batch Adam on three quarters of the rows; the rest calibrates."""
        words = Words()
        rows = [np.array(r, np.int64) for r in words.rows(texts)]
        at, col = [], []
        for k, row in enumerate(rows):
            if len(row):
                own = np.concatenate([words.buckets[words.starts[c] : words.starts[c + 1]] for c in row] + [words.pairs(row)])
                at.append(np.full(len(own), k))
                col.append(own)
        if not at or labels.min() == labels.max():
            self.b = 0.0 if not len(labels) else 4.0 * (2 * float(labels.mean()) - 1)
            return self
        i, j = np.concatenate(at), np.concatenate(col)
        keys, n = np.unique(i << BITS | j, return_counts=True)
        i, j = keys >> BITS, keys & ((1 << BITS) - 1)
        size = np.array([max(1, len(r)) for r in rows])
        x = SCALE * n / size[i]
        test = np.arange(len(rows)) % 4 == 3
        share = labels[~test].mean()
        weight = np.where(test, 0.0, np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)))
        m, v, mb, vb = np.zeros_like(self.w), np.zeros_like(self.w), 0.0, 0.0
        for t in range(1, EPOCHS + 1):
            z = np.bincount(i, x * self.w[j], len(rows)) + self.b
            d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / max(1, (~test).sum())
            g, gb = np.bincount(j, x * d[i], len(self.w)) + 1e-6 * self.w, d.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            self.w -= 0.02 * (m / c1) / (np.sqrt(v / c2) + 1e-9)
            self.b -= 0.02 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
        z = np.bincount(i, x * self.w[j], len(rows)) + self.b
        self._calibrate(z[test], labels[test])
        return self

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Platt's two numbers by Newton steps, with smoothed targets."""
        if not len(z) or y.min() == y.max():
            return
        hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
        t, ab = np.where(y == 1, hi, lo), np.array([1.0, 0.0])
        f = np.stack([z, np.ones_like(z)], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ ab, -30, 30)))
            h = f.T @ (f * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, f.T @ (t - p) - 1e-3 * (ab - [1.0, 0.0]))
            ab = ab + np.clip(step, -1, 1)
        if ab[0] > 0:
            self.slope, self.shift = float(ab[0]), float(ab[1])


class Scorer:
    """Probabilities of texts; a word's own share is summed once while it is kept."""

    def __init__(self, model: Classifier) -> None:
        self.m, self.words, self.own = model, Words(), np.zeros(0)

    def score(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        if len(self.words.number) > KEEP_WORDS:
            self.words, self.own = Words(), np.zeros(0)
        words, w = self.words, self.m.w
        rows = [np.array(r, np.int64) for r in words.rows(texts)]
        done = len(self.own)
        if done < len(words.hash):
            sums = np.add.reduceat(w[words.buckets[words.starts[done] :]], words.starts[done:-1] - words.starts[done])
            self.own = np.concatenate([self.own, sums])
        z = np.array([self.own[r].sum() + w[words.pairs(r)].sum() if len(r) else 0.0 for r in rows])
        z = SCALE * z / np.array([max(1, len(r)) for r in rows]) + self.m.b
        return rows, 1 / (1 + np.exp(-np.clip(self.m.slope * z + self.m.shift, -30, 30)))


def repeated_words(row: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    if len(row) < 4:
        return 0
    kinds, local = np.unique(row, return_inverse=True)
    n = np.int64(len(kinds))
    a, b, c = local[:-2].astype(np.int64), local[1:-1].astype(np.int64), local[2:].astype(np.int64)
    if n < 2_000_000:
        key = (a * n + b) * n + c
    else:  # pairs first, so that the numbers fit
        pair = np.unique(a * n + b, return_inverse=True)[1].astype(np.int64)
        key = pair * n + c
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    inside = np.zeros(len(row), bool)
    inside[:-2] |= twice
    inside[1:-1] |= twice
    inside[2:] |= twice
    return int(inside.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Classifier:
    """Fit on at most rows labelled documents, drawn by a hash of their key."""
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).dropDuplicates(["k"])
    n = known.count()
    place = F.pmod(F.xxhash64(F.lit("quality sample"), "k"), F.lit(1_000_000))
    drawn = known.filter(place < int(1_000_000 * min(1.0, rows / max(1, n))))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null")
    got = texts.join(F.broadcast(drawn.limit(2 * rows)), "k").limit(2 * rows).collect()
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["k"])), r["t"]))
    return Classifier().fit([r["t"] for r in got], np.array([r["y"] for r in got], float))


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def judge(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the counts, base_failed, probability, kept for every row of docs.

    Null texts have no words and fail. base_failed: fewer than MIN_WORDS words,
    or over MAX_REPEAT_PERCENT of the words repeat. kept: not failed and a
    calibrated probability of good quality of at least MIN_PROBABILITY.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [key, *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows, p = scorer.score(texts)
                n = np.array([len(r) for r in rows])
                repeats = np.array([repeated_words(r) for r in rows])
                failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
                chars = [len(t) - sum(map(t.count, SPACES)) for t in texts]
                symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
                lines = [duplicate_lines(t) for t in texts]
                cols = [part.column(0), *(pa.array(x, pa.int64()) for x in (n, chars, symbols, lines, repeats)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= MIN_PROBABILITY))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {COLUMNS}")
