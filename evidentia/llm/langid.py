"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, dropped, gathered, in_batches, saved

LETTERS = regex.compile(r"\p{L}+")
ORDER = 4
DISCOUNT = 0.75
#: Training reads about so many documents of each language (a sample by hash), whatever their number.
PER_LANG = 1500
#: Of the sample, one document in so many calibrates confidence and rejection and is not counted.
FOLDS = 5
#: Share of the calibration texts of learned languages that may be rejected at most.
LOST = 0.001
#: Confidence is sharpened by one of these.
SHARPNESS = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0]
UNKNOWN = "und"
#: Languages whose tables are held side by side.
BLOCK = 8
#: Numbers kept of words a task has met: one for each language and word.
KEEP = 1_600_000
#: So many words are scored side by side.
SCORED = 4096
#: The words of so many texts, and the grams of so many words, are counted before they are given out.
COUNTED = 10_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: str = "doc_id") -> F.Column:
    """Whether crc32 of the key as text leaves no remainder by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the 1- to ORDER-grams that end at each place of the words.

    A word is \\x02, its letters, \\x03. Returns the hashes by order (zero where
    the gram would begin before its word), each place's word, and whether a
    place is predicted (all but \\x02).
    """
    text = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = code == 2
    word = np.cumsum(first) - 1
    at = np.arange(len(code))
    depth = at - np.flatnonzero(first)[word] if len(code) else at
    out = []
    h = np.zeros(len(code), np.uint64)
    for k in range(ORDER):
        # The hash of a gram: its letters from the last to the first.
        shifted = np.concatenate([np.zeros(k, np.uint64), code])[: len(code)]
        h = (h ^ (shifted + np.uint64(1))) * MIX
        h = h ^ (h >> np.uint64(29))
        out.append(np.where(depth >= k, h, np.uint64(0)))
    return out, word, ~first


def _rows(words: list[str], weight: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each order the distinct grams of words with: the gram before their last letter, the gram without their first letter, whether they begin their word, weight."""
    grams, word, real = _grams(words)
    first = np.concatenate([[0], np.cumsum(np.bincount(word))[:-1]])[word] if len(word) else word
    depth = np.arange(len(word)) - first
    none = np.zeros(len(word), np.uint64)
    out = []
    for k in range(ORDER):
        use = real & (grams[k] != 0)
        before = np.concatenate([none[:1], grams[k - 1][:-1]]) if k and len(word) else none
        shorter = grams[k - 1] if k else none
        keys, at, inverse = np.unique(grams[k][use], return_index=True, return_inverse=True)
        out.append((keys, before[use][at], shorter[use][at], (depth == k)[use][at], np.bincount(inverse, weight[word][use], len(keys))))
    return out


class Tables:
    """One language: by order the sorted gram hashes, their discounted probability and their back-off weight."""

    def __init__(self, rows: list[tuple[np.ndarray, ...]]) -> None:
        self.keys, self.prob, self.back = [], [], []
        contexts: list[tuple[np.ndarray, np.ndarray]] = []
        shares: list[np.ndarray] = []
        for k, (keys, before, _, begins, n) in enumerate(rows):
            count = n.astype(float)
            if k < ORDER - 1:
                # Below the highest order: how many letters precede the gram; one that begins its word has none before it and keeps its own count.
                longer = np.bincount(np.searchsorted(keys, rows[k + 1][2]), minlength=len(keys)).astype(float)
                count = np.where(begins, count, np.maximum(longer, 1.0))
            ctx, ci = np.unique(before, return_inverse=True)
            total = np.bincount(ci, count, len(ctx))
            d = np.minimum(DISCOUNT, count)
            shares.append((count - d) / total[ci])
            contexts.append((ctx, np.bincount(ci, d, len(ctx)) / total))
        # Weight of the uniform distribution below the single letters.
        self.floor = max(float(contexts[0][1][0]) if len(contexts[0][1]) else 1.0, 1e-6) / 4096.0
        for k in range(ORDER):
            ctx, weight = contexts[k + 1] if k + 1 < ORDER else (np.empty(0, np.uint64), np.empty(0))
            keys = np.union1d(rows[k][0], ctx)
            prob, back = np.zeros(len(keys) + 1), np.ones(len(keys) + 1)
            prob[np.searchsorted(keys, rows[k][0])] = shares[k]
            back[np.searchsorted(keys, ctx)] = weight
            self.keys.append(keys)
            self.prob.append(prob)
            self.back.append(back)


class Block:
    """Up to BLOCK languages side by side: by order the hashes that any of them has, and a column a language of what each gives them."""

    def __init__(self, tables: list[Tables]) -> None:
        self.floor = np.array([t.floor for t in tables])
        self.keys, self.prob, self.back = [], [], []
        for k in range(ORDER):
            keys = np.unique(np.concatenate([t.keys[k] for t in tables]))
            prob, back = np.zeros((len(keys) + 1, len(tables))), np.ones((len(keys) + 1, len(tables)))
            for j, t in enumerate(tables):
                at = np.searchsorted(keys, t.keys[k])
                prob[at, j], back[at, j] = t.prob[k][:-1], t.back[k][:-1]
            self.keys.append(keys)
            self.prob.append(prob)
            self.back.append(back)

    def probabilities(self, grams: list[np.ndarray]) -> np.ndarray:
        """A column a language: the probability of the letter at each place."""
        p, last = np.tile(self.floor, (len(grams[0]), 1)), np.zeros(0, np.int64)
        for k in range(ORDER):
            keys = self.keys[k]
            at = np.searchsorted(keys, grams[k])
            at = np.where(keys[np.minimum(at, len(keys) - 1)] == grams[k], at, len(keys)) if len(keys) else np.zeros(len(p), np.int64)
            if k:
                context = np.concatenate([[len(self.keys[k - 1])], last[:-1]])
                p = np.where((grams[k] != 0)[:, None], self.prob[k][at] + self.back[k - 1][context] * p, p)
            else:
                p = p + self.prob[0][at]
            last = at
        return p


class Model:
    """The languages' tables, the sharpness of the confidence, and when a text is rejected.

    A text of n letters is rejected if its cross-entropy under the best language
    is over bound + spread / sqrt(n): short texts scatter more.
    """

    def __init__(self, grams: dict[str, list[tuple[np.ndarray, ...]]]) -> None:
        self.langs = sorted(grams)
        tables = [Tables(grams[x]) for x in self.langs]
        # by blocks, so that the size follows the languages' own grams and not grams times languages
        self.blocks = [Block(tables[i : i + BLOCK]) for i in range(0, len(tables), BLOCK)]
        self.bound, self.spread, self.scale = np.inf, 0.0, 1.0

    @classmethod
    def of_words(cls, counts: dict[str, Counter]) -> Model:
        return cls({k: _rows(list(c), np.array(list(c.values()), float)) for k, c in counts.items()})

    def bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its bits under each language, and its number of predicted letters."""
        if not words:
            return np.zeros((0, len(self.langs))), np.zeros(0)
        each = [self._bits(words[i : i + SCORED]) for i in range(0, len(words), SCORED)]
        return np.concatenate([x for x, _ in each]), np.concatenate([n for _, n in each])

    def _bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        grams, word, real = _grams(words)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        cost = [np.add.reduceat(np.where(real[:, None], -np.log2(np.maximum(b.probabilities(grams), 1e-12)), 0.0), starts, axis=0) for b in self.blocks]
        return np.concatenate(cost, axis=1), np.add.reduceat(real.astype(float), starts)

    def rejects(self, low: np.ndarray, letters: np.ndarray) -> np.ndarray:
        return (letters == 0) | (low > self.bound + self.spread / np.sqrt(np.maximum(letters, 1)))


class Scorer:
    """Cross-entropies of texts; a word's bits are worked out once while it is kept."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self._fresh()

    def _fresh(self) -> None:
        self.number: dict[str, int] = {}
        self.cost = np.zeros((0, len(self.m.langs)))
        self.size = np.zeros(0)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a letter under each language for each text, and its letters (0: none)."""
        if len(self.number) * len(self.m.langs) > KEEP:
            self._fresh()
        number = self.number
        rows = []
        for t in texts:
            chunks = t.split() if t else []
            row = [number.get(c) for c in chunks]
            for k, c in enumerate(row):
                if c is None:
                    row[k] = number.setdefault(chunks[k], len(number))
            rows.append(row)
        fresh = list(number)[len(self.cost) :]
        if fresh:
            found = [LETTERS.findall(c.lower()) for c in fresh]
            per = np.array([len(x) for x in found])
            cost, size = self.m.bits([w for x in found for w in x])
            of = np.repeat(np.arange(len(fresh)), per)
            self.cost = np.concatenate([self.cost, np.stack([np.bincount(of, cost[:, j], len(fresh)) for j in range(cost.shape[1])], axis=1)])
            self.size = np.concatenate([self.size, np.bincount(of, size, len(fresh))])
        sizes = np.array([len(r) for r in rows])
        flat = np.array([c for r in rows for c in r], np.int64)
        of = np.repeat(np.arange(len(rows)), sizes)
        letters = np.bincount(of, self.size[flat], len(rows))
        bits = np.stack([np.bincount(of, self.cost[flat, j], len(rows)) for j in range(len(self.m.langs))], axis=1)
        return bits / np.maximum(letters, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, confidence, bits a letter, rejected."""
        m = self.m
        if not m.langs:
            n = len(texts)
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        x, letters = self.entropies(texts)
        best = x.argmin(axis=1)
        low = x.min(axis=1)
        score = 1.0 / np.exp(-m.scale * np.minimum(letters, 200)[:, None] * (x - low[:, None])).sum(axis=1)
        none = letters == 0
        names = [UNKNOWN if no else m.langs[b] for b, no in zip(best.tolist(), none.tolist())]
        return names, np.where(none, 0.0, score), np.where(none, 0.0, low), m.rejects(low, letters)


def _noise(text: str) -> str:
    """The text with all its letters in another order, by a seed that is its hash: letters of a language, but no words of one."""
    chars = np.array(list(text.lower()))
    at = np.array([i for m in LETTERS.finditer("".join(chars)) for i in range(m.start(), m.end())], np.int64) if len(chars) else np.zeros(0, np.int64)
    at = at[at < len(chars)]
    chars[at] = np.random.default_rng(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).permutation(chars[at])
    return "".join(chars)


def _checked(rows: DataFrame, model: Model) -> np.ndarray:
    """A row for each calibration text: letters, bits under the best language, under the best other one, of its letters in another order, and the loss for each sharpness."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, scorer = shared.value, Scorer(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 64):
                langs, texts = (c.to_pylist() for c in b.slice(s, 64).columns)
                x, letters = scorer.entropies(texts)
                noise = scorer.entropies([_noise(t) for t in texts])[0].min(axis=1)
                truth = np.array([m.langs.index(k) for k in langs])
                other = x.copy()
                other[np.arange(len(x)), truth] = np.inf
                gap = -(x - x.min(axis=1)[:, None]) * np.minimum(letters, 200)[:, None]
                loss = [np.log(np.exp(c * gap).sum(axis=1)) - c * gap[np.arange(len(x)), truth] for c in SHARPNESS]
                out = np.stack([letters, x.min(axis=1), other.min(axis=1), noise, *loss], axis=1)[letters > 0]
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.list_(pa.float64()))], names=["x"])

    found = in_batches(rows.select("l", "t")).mapInArrow(run, "x array<double>").toArrow()
    return np.array(found["x"].to_pylist(), float).reshape(-1, 4 + len(SHARPNESS))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Fit the models on about per_lang documents of each language that aren't held out.

    The sample is drawn by a hash of key and text, and equal texts of a language
    count once. One in FOLDS calibrates; a language of which nothing else is
    drawn is learned from all of its sample. Words and then grams are counted in
    tasks; the driver gets a row for each gram of a language, of which a
    language has a bounded number (letters to the power ORDER), and eleven numbers for
    each calibration text. Null texts and languages aren't learned from.

    Rejection is calibrated on texts of no learned language: each calibration
    text under the best of the other languages, and with its letters in
    another order. The bound lies halfway between these and the texts of learned
    languages where they part, and loses at most LOST of the latter where not.
    """
    known = docs.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    place = F.pmod(F.xxhash64(F.lit("language sample"), "k", "t"), F.lit(1_000_000))
    # a row for each language, joined by its own name
    per = known.groupBy("l").agg(F.count("*").alias("n")).select("l", F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n")).alias("share"))
    per = saved(per, "languages")
    drawn = known.withColumn("place", place).join(F.broadcast(per) if per.count() <= 100_000 else per, "l").filter(F.col("place") < F.col("share") * 1_000_000)
    drawn = saved(drawn.select("l", "t", (F.pmod(F.xxhash64(F.lit("language fold"), "t"), F.lit(FOLDS)) == 0).alias("check")).dropDuplicates(["l", "t"]), "language-sample")
    only = [r["l"] for r in drawn.groupBy("l").agg(F.min("check").alias("all")).filter("all").collect()]
    learned = drawn.filter(~F.col("check") | F.col("l").isin(only))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, COUNTED):
            counts: dict[str, Counter] = {}
            for k, t in zip(*(c.to_pylist() for c in b.columns)):
                counts.setdefault(k, Counter()).update(LETTERS.findall(t.lower()))
            for k, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["l", "w", "n"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, COUNTED):
            langs, counts = np.array(b.column(0).to_pylist(), object), b.column(2).to_numpy()
            for k in np.unique(langs.astype(str)):
                own = np.flatnonzero(langs == k)
                for order, (g, before, shorter, begins, n) in enumerate(_rows(b.column(1).take(pa.array(own)).to_pylist(), counts[own])):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(np.full(len(g), order, np.int32)), *(pa.array(x.view(np.int64)) for x in (g, before, shorter)), pa.array(begins), pa.array(n.astype(np.int64))], names=["l", "k", "g", "before", "shorter", "begins", "n"])

    counted = in_batches(learned.select("l", "t")).mapInArrow(words, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    rows = counted.mapInArrow(grams, "l string, k int, g long, before long, shorter long, begins boolean, n long")
    table = rows.groupBy("l", "k", "g").agg(F.min("before").alias("before"), F.min("shorter").alias("shorter"), F.max("begins").alias("begins"), F.sum("n").alias("n")).toArrow()
    langs, order = table["l"].to_numpy(), table["k"].to_numpy()
    g, before, shorter = (table[c].to_numpy().view(np.uint64) for c in ("g", "before", "shorter"))
    begins, n = table["begins"].to_numpy(), table["n"].to_numpy()
    found: dict[str, list] = {}
    for k in sorted(set(langs.tolist())):
        found[k] = []
        for o in range(ORDER):
            own = np.flatnonzero((langs == k) & (order == o))
            own = own[np.argsort(g[own])]
            found[k].append((g[own], before[own], shorter[own], begins[own].astype(bool), n[own]))
    model = Model(found)
    checks = drawn.filter(F.col("check") & F.col("l").isin(model.langs)) if model.langs else None
    x = _checked(checks, model) if checks is not None else np.zeros((0, 4))
    if len(x):
        letters, low, unknown = x[:, 0], x[:, 1], np.concatenate([x[:, 2], x[:, 3]])
        model.scale = SHARPNESS[int(np.argmin(x[:, 4:].mean(axis=0)))]
        root = np.sqrt(letters)
        model.spread = float(np.quantile(np.maximum(low - np.median(low), 0) * root, 1 - LOST))
        least = low - model.spread / root
        unknown = (unknown - model.spread / np.concatenate([root, root]))[np.isfinite(unknown)]
        known_top, unknown_low = np.quantile(least, 1 - LOST), np.quantile(unknown, 0.02) if len(unknown) else np.inf
        model.bound = float((known_top + unknown_low) / 2 if known_top < unknown_low < np.inf else known_top)
    dropped(docs.sparkSession, drawn, per)
    return model


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, bits, rejected for every row of docs.

    lang_pred has the lowest cross-entropy a letter, and is `und` (score 0,
    rejected) where the text is null or has no letter. Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                names, score, bits, no = scorer.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(bits), pa.array(no)], names=[key, "lang_pred", "score", "bits", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    return in_batches(docs.select(column(key), column(text).alias("text"))).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, bits double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, with docs' columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                *_, no = scorer.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_struct_array(part.to_struct_array().filter(pa.array(~no)))

    # by names without dots, which would be read as fields
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return in_batches(plain).mapInArrow(run, plain.schema).toDF(*docs.columns)
