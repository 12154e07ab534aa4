"""Operator 7: byte-pair encoding by a segment tree over adjacent pair ranks, and decoding.

A piece of text starts as its bytes. Each leaf of a segment tree holds the merge
rank of one symbol with the symbol after it, joined with its place; inner nodes
hold the least of their two children. The root therefore names the leftmost pair
of lowest rank. Merging it changes three leaves, each updated along one path to the
root, until the root says that no pair can be merged.

Pieces of like length are worked on together, one tree per row of a numpy array;
pieces over `LONG` bytes have a tree of their own, in plain lists. Pieces met before come from a
bounded cache.

Defined results: null text is empty text (no ids). A special token's string in a
text becomes that token's id. Repeated rows give repeated results; other columns
are ignored. No text is cut.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretoken
from .store import bounded_batches, in_chunks, texts_of

LONG = 256
#: Some 100 MB, kept by the worker process.
CACHE_ENTRIES = 400_000
NEVER = np.int64(1) << 62
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, and back."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        ids: dict[str, int] = told["model"]["vocab"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for word, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = ids[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        pairs = left << 32 | right
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order
        self.rank_of = dict(zip(pairs.tolist(), range(len(pairs))))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; NEVER where there is none (right < 0: no neighbour)."""
        pairs = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pairs) & (right >= 0), self.ranks[at], NEVER)


def merge_rows(vocabulary: Vocabulary, words: Sequence[bytes]) -> list[bytes]:
    """Ids of words whose lengths share one power of two; one segment tree per row."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    width = 1 << max(1, int(lengths.max() - 1).bit_length())
    row = np.arange(n)
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
    symbol = vocabulary.first[flat]
    place = np.arange(width)
    used = place < lengths[:, None]
    following = np.where(place + 1 < lengths[:, None], place + 1, -1)
    before = np.tile(place - 1, (n, 1))
    shift = width.bit_length() - 1
    right = np.where(following >= 0, np.roll(symbol, -1, axis=1), -1)
    rank = np.where(used, vocabulary.rank(symbol, right), NEVER)
    tree = np.full((n, 2 * width), NEVER, np.int64)
    tree[:, width:] = np.where(rank < NEVER, rank << shift | place, NEVER)
    level = width >> 1
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level >>= 1

    def renew(rows: np.ndarray, at: np.ndarray) -> None:
        """Renews the paths from these leaves to the root, one level of all rows at a time."""
        node = rows * (2 * width) + ((at + width) >> 1)
        for _ in range(shift):
            child = node + (node - rows * (2 * width))
            flat_tree[node] = np.minimum(flat_tree[child], flat_tree[child + 1])
            node = (node + rows * (2 * width)) >> 1

    flat_tree = tree.reshape(-1)
    live = row[tree[:, 1] < NEVER]
    while len(live):
        root = tree[live, 1]
        i = root & (width - 1)
        j = following[live, i]
        after = following[live, j]
        symbol[live, i] = vocabulary.made[root >> shift]
        used[live, j] = False
        following[live, i] = after
        some = after >= 0
        before[live[some], after[some]] = i[some]
        tree[live, j + width] = NEVER
        mine = symbol[live, i]
        r = vocabulary.rank(mine, np.where(some, symbol[live, np.maximum(after, 0)], -1))
        tree[live, i + width] = np.where(r < NEVER, r << shift | i, NEVER)
        p = before[live, i]
        some = np.flatnonzero(p >= 0)
        rows, p = live[some], p[some]
        r = vocabulary.rank(symbol[rows, p], mine[some])
        tree[rows, p + width] = np.where(r < NEVER, r << shift | p, NEVER)
        renew(np.concatenate([live, live, rows]), np.concatenate([i, j, p]))
        live = live[tree[live, 1] < NEVER]
    ids = symbol[used].astype("<u4").tobytes()
    ends = (4 * np.cumsum(used.sum(axis=1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


def merge_long(vocabulary: Vocabulary, word: bytes) -> bytes:
    """Ids of one long word, by the same tree in plain lists."""
    symbol: list[int] = vocabulary.first[np.frombuffer(word, np.uint8)].tolist()
    n = len(symbol)
    width = 1 << (n - 1).bit_length()
    none, rank_of, made = 1 << 62, vocabulary.rank_of, vocabulary.made.tolist()
    following, before = [*range(1, n), -1], [*range(-1, n - 1)]
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = rank_of.get(symbol[i] << 32 | symbol[i + 1])
        if r is not None:
            tree[width + i] = r * width + i
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(at: int, value: int) -> None:
        k = width + at
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    def pair(i: int) -> int:
        j = following[i]
        r = rank_of.get(symbol[i] << 32 | symbol[j]) if j >= 0 else None
        return none if r is None else r * width + i

    while (root := tree[1]) < none:
        r, i = divmod(root, width)
        j = following[i]
        symbol[i], symbol[j] = made[r], -1
        after = following[i] = following[j]
        if after >= 0:
            before[after] = i
        put(j, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    return np.array([s for s in symbol if s >= 0], "<u4").tobytes()


class Encoder:
    """Encodes whole texts to ids, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None) -> None:
        self.vocabulary = Vocabulary(path or default_path())
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts the ids of pieces not met before into the cache."""
        new = list(set(pieces).difference(self.known))
        raw = [piece.encode() for piece in new]
        by_width: dict[int, list[int]] = {}
        for k, word in enumerate(raw):
            by_width.setdefault((len(word) - 1).bit_length(), []).append(k)
        for width, some in by_width.items():
            if 1 << width > LONG:
                self.known.update((new[k], merge_long(self.vocabulary, raw[k])) for k in some)
                continue
            step = (1 << 18) >> width
            for at in range(0, len(some), step):
                part = some[at : at + step]
                self.known.update(zip([new[k] for k in part], merge_rows(self.vocabulary, [raw[k] for k in part])))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        special = self.vocabulary.special
        if any(s in text for s in special for text in texts):
            return [b"".join(self.parts(text)) for text in texts]
        pieces, bounds = pretoken.split(texts)
        self.learn(pieces)
        ids, at = list(map(self.known.__getitem__, pieces)), bounds.tolist()
        return [b"".join(ids[a:b]) for a, b in zip(at, at[1:])]

    def parts(self, text: str) -> Iterator[bytes]:
        """Ids of a text that may hold special tokens: the leftmost, then the longest, is taken each time."""
        at = 0
        while True:
            found = [(p, -len(s), s) for s in self.vocabulary.special if (p := text.find(s, at)) >= 0]
            p, _, s = min(found, default=(len(text), 0, ""))
            if p > at:
                pieces, _ = pretoken.split([text[at:p]])
                self.learn(pieces)
                yield from map(self.known.__getitem__, pieces)
            if not s:
                return
            yield self.vocabulary.special[s].to_bytes(4, "little")
            at = p + len(s)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.cache
def encoder(path: str | None) -> Encoder:
    """One encoder per worker process, so that the cache outlives a task."""
    return Encoder(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Id column and `ids`: the token ids of every whole text, as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, text_col):
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in encoder(path).encode(texts_of(batch, text_col))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=[id_col, "ids"])

    bounded_batches(docs.sparkSession)
    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, ids array<long>")


def decode_documents(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Id column and `text`: the text of every row's ids (null ids: empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encoder(path).decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    bounded_batches(coded.sparkSession)
    kept = coded.select(id_col, ids_col)
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of every whole text's ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in in_chunks(batches):
            ids = coder.encode(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
