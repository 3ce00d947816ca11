"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import in_batches

#: White space as the vocabulary's normaliser takes it; str.split() takes \x1c-\x1f too.
SPACE = re.compile("[\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
ODD = re.compile("[\\x1c-\\x1f]")
NO_PAIR = np.int64(1 << 62)
#: Distinct words whose ids a worker keeps; beyond that it starts afresh.
KEEP_WORDS = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Arrays of a word-end BPE file: symbols, pair ranks, merged ids, specials."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        vocab = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (vocab | self.special).items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.cut = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that don't merge."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after another, and each word's number of ids.

    All words of a size class walk their segment trees together.
    A leaf holds rank << 24 | position of the pair that starts there, so the
    root of a word's tree is its leftmost pair of the lowest rank. A merge
    changes three leaves, each carried to the root in log steps; a word is
    done when its root holds no pair.
    """
    size = np.array([len(w) for w in words])
    width = (2 ** np.ceil(np.log2(np.maximum(size, 1)))).astype(np.int64)
    parts, counts, order = [], [], []
    for p in np.unique(width).tolist():
        members = np.flatnonzero(width == p)
        step = max(1, 250_000 // p)
        for s in range(0, len(members), step):
            own = members[s : s + step]
            kept, n = _merge_class([words[i] for i in own.tolist()], p, v)
            parts.append(kept)
            counts.append(n)
            order.append(own)
    flat, n, order = np.concatenate(parts), np.concatenate(counts), np.concatenate(order)
    start = np.cumsum(n) - n
    back = np.argsort(order, kind="stable")
    n, start = n[back], start[back]
    where = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(flat))
    return flat[where].astype(np.int32), n


def _merge_class(words: list[bytes], p: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(w) for w in words])
    rows = np.arange(len(words))
    raw = np.frombuffer(b"".join(w.ljust(p, b"\0") for w in words), np.uint8).reshape(-1, p)
    symbol = v.inner[raw]
    symbol[rows, n - 1] = v.last[raw[rows, n - 1]]
    place = np.arange(p)
    alive = place[None, :] < n[:, None]
    after = np.tile(place + 1, (len(words), 1))
    before = np.tile(place - 1, (len(words), 1))
    tree = np.full((len(words), 2 * p), NO_PAIR, np.int64)
    if p > 1:
        rank = v.rank(symbol[:, :-1], symbol[:, 1:])
        ok = (rank >= 0) & alive[:, 1:]
        tree[:, p : 2 * p - 1] = np.where(ok, rank << 24 | place[:-1], NO_PAIR)
    half = p
    while half > 1:
        tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
        half //= 2

    def put(r: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + p
        tree[r, node] = value
        while node.size and node[0] > 1:
            node = node >> 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

    live = rows[tree[:, 1] < NO_PAIR]
    while live.size:
        best = tree[live, 1]
        at = best & 0xFFFFFF
        right = after[live, at]
        symbol[live, at] = v.merged[best >> 24]
        alive[live, right] = False
        nxt, prv = after[live, right], before[live, at]
        after[live, at] = nxt
        more = nxt < n[live]
        before[live[more], nxt[more]] = at[more]
        put(live, right, np.full(live.size, NO_PAIR))
        value = np.full(live.size, NO_PAIR)
        rank = v.rank(symbol[live[more], at[more]], symbol[live[more], nxt[more]])
        value[more] = np.where(rank >= 0, rank << 24 | at[more], NO_PAIR)
        put(live, at, value)
        has = prv >= 0
        rank = v.rank(symbol[live[has], prv[has]], symbol[live[has], at[has]])
        put(live[has], prv[has], np.where(rank >= 0, rank << 24 | prv[has], NO_PAIR))
        live = live[tree[live, 1] < NO_PAIR]
    return symbol[alive], alive.sum(axis=1)


class _Numbers(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Ragged:
    """Rows of whole numbers of unequal length, added at the end, read many at once."""

    def __init__(self) -> None:
        self.flat = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.rows = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        at, n = int(self.ends[self.rows]), self.rows
        while at + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(sizes) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[at : at + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(sizes)] = at + np.cumsum(sizes)
        self.rows += len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the given rows one after another, and each row's size."""
        start = self.ends[rows]
        sizes = self.ends[rows + 1] - start
        where = np.repeat(start - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        return self.flat[where], sizes


class Encoder:
    """Encodes texts batch by batch; each distinct piece is merged once while it is kept."""

    def __init__(self, vocabulary: Vocabulary, keep: int = KEEP_WORDS) -> None:
        self.v, self.keep = vocabulary, keep
        self._fresh()

    def _fresh(self) -> None:
        self.number, self.piece = _Numbers(), _Numbers()  # of words between white space, of pieces
        self.pieces, self.ids = _Ragged(), _Ragged()  # of each word, of each piece
        for mark, i in self.v.special.items():
            # In a tuple, so that no word equals it.
            self.pieces.add(np.array([self.piece[(mark,)]]), np.array([1]))
            self.ids.add(np.array([i]), np.array([1]))
            assert self.number[(mark,)] == self.pieces.rows - 1

    def _words(self, text: str) -> list:
        if "<|" in text:
            out: list = []
            at = 0
            for m in self.v.marks.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append((m.group(),))
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if ODD.search(text):
            return [w for w in SPACE.split(text) if w]
        return text.split()

    def _learn(self) -> None:
        """Cut and merge the words that have come since the last call."""
        new = list(self.number)[self.pieces.rows :]
        if not new:
            return
        piece, cut = self.piece, self.v.cut.findall
        flat: list[int] = []
        sizes: list[int] = []
        for word in new:
            if not word.isascii():
                word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
            word = word.lower()
            if word.isalpha():
                flat.append(piece[word])
                sizes.append(1)
            elif word[-1] in ".,!" and word[:-1].isalpha():
                flat.append(piece[word[:-1]])
                flat.append(piece[word[-1]])
                sizes.append(2)
            else:
                found = cut(word)
                flat += [piece[x] for x in found]
                sizes.append(len(found))
        self.pieces.add(np.array(flat, np.int32), np.array(sizes, np.int64))
        fresh = [x.encode("utf-8", "surrogatepass") for x in list(piece)[self.ids.rows :]]
        if fresh:
            self.ids.add(*merge_words(fresh, self.v))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids (uint32) of each text; null is empty."""
        if len(self.number) > self.keep:
            self._fresh()
        number = self.number
        codes = [[number[c] for c in self._words(t)] if t else [] for t in texts]
        self._learn()
        words = np.array([c for row in codes for c in row], np.int64)
        pieces, per_word = self.pieces.take(words)
        ids, per_piece = self.ids.take(pieces)
        ends = np.concatenate([[0], np.cumsum(per_piece)])[np.concatenate([[0], np.cumsum(per_word)])]
        ends = ends[np.concatenate([[0], np.cumsum([len(row) for row in codes])]).astype(np.int64)].tolist()
        ids = ids.astype("<u4")
        return [ids[a:b] for a, b in zip(ends, ends[1:])]


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    """The tokens of ids with a space between each two; ids outside the vocabulary are left out."""
    tokens = v.tokens
    try:
        return " ".join([tokens[i] for i in ids])
    except IndexError:
        return " ".join([tokens[i] for i in ids if i < len(tokens)])


def _load(path: str | None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for s in range(0, batch.num_rows, rows):
        yield batch.slice(s, rows)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, ids (array<int>) for every row of docs: the whole text's token ids.

    Null and empty texts have no ids. The vocabulary file is read on the driver
    (about 2 MB, of fixed size) and sent with the task.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(Vocabulary(spec.value))
        for b in batches:
            for part in _slices(b):
                ids = [x.astype(np.int32) for x in enc.encode(part.column(1).to_pylist())]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return in_batches(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """key, text: what the ids stand for; null ids give the empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(_load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(spec.value)
        for b in batches:
            for part in _slices(b):
                texts = [decode_ids(x or [], v) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return in_batches(encoded.select(key, ids)).mapInArrow(run, f"`{key}` {kind}, text string")


def token_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 for every row of docs.

    Encodes each whole text and decodes it again in the same pass, so the ids
    are never written. Null and empty texts: no tokens, digests of nothing.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(Vocabulary(spec.value))
        for b in batches:
            for part in _slices(b):
                n, ids, back = [], [], []
                for x in enc.encode(part.column(1).to_pylist()):
                    n.append(len(x))
                    ids.append(hashlib.sha256(x.tobytes()).hexdigest())
                    back.append(hashlib.sha256(decode_ids(x.tolist(), enc.v).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return in_batches(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
