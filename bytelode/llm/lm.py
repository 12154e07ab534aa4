"""Operator 9: log probabilities of texts by a causal self-attention model in numpy.

A text is its words (split at white space, A-Z lower-cased) and an end. Each word is
also a few subword ids of a public byte-level vocabulary. A word's probability has two
factors:

* its first subword, from the words before: a causal self-attention network in numpy over
  subword ids. It sees each word by its first and last subword and gives a distribution
  over classes of first subwords; a subword's share of its class comes from counts.
* how the word goes on, from counts of all training documents: with c the word's count, and
  C and V the count and number of words that begin with the same subword,
  (c + (V + 1) * chain) / (C + V + 1), where chain is the chance that a chain of subwords,
  each following the one before, makes just this word.

So every word of any text has a probability, and those of all words add up to one.

The network starts from windows of at most `TRAIN_DOCUMENTS` training documents (those with
the least hash of doc_id), as all tasks need one start; then every task learns from all
windows of all its training documents, each word once, and the mean of the tasks' changes,
weighted by their windows, is the network. Classes come from what subwords follow in all
training documents, shares and all other counts from all of them too.

Texts of any length are scored in overlapping windows of `WINDOW` words; a window after
the first scores the words that the one before has not, so each counts once.

Counts of the `FREQUENT` most frequent words (a bound) go to all tasks; all other words
meet their counts by a shuffle on the word, where no word is frequent.

Defined results: null text is empty text (one token, the end). A null doc_id is neither
held out nor learnt from. Without training documents N = V = 0 and every count is 0.
Repeated rows count, and are scored, each. Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .store import bounded_batches, bounded_sample, durable, in_chunks, texts_of

TRAIN_DOCUMENTS = 2_000
WINDOWS_A_DOCUMENT = 8
WINDOW, STRIDE, SIZE = 32, 28, 16
SINGLES, GROUPS = 40, 24
CLASSES = SINGLES + GROUPS
#: Columns of what a subword follows: the most frequent subwords, and one for all others.
BEFORE = 128
FREQUENT = 1 << 18
LONGEST_FREQUENT = 64
#: At least so many batches are learnt from at the start; RATE is the rate of the pass over all documents.
LEAST_STEPS, BATCH = 400, 256
RATE = 2e-3
#: Words whose codes a task remembers.
REMEMBERED = 300_000
#: How strongly a chain's counts are drawn to those of subwords alone.
DRAWN = 4.0


#: White space that does not part words.
ODD, ODD_ASCII = re.compile(r"\s"), re.compile("[\x1c-\x1f]")


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


class Vocabulary:
    """Subword ids of words, each as it stands after a blank."""

    def __init__(self, path: str | None) -> None:
        import public_tokenizers
        import tiktoken

        known = bpe.Vocabulary(path or bpe.default_path())
        self.size = len(known.bytes)
        self.end = self.size - 1  # the special token, which no word holds
        self.lengths = np.fromiter(map(len, known.bytes), np.int64, self.size)
        ranks = {raw: i for i, raw in enumerate(known.bytes) if i not in known.special.values()}
        self.coder = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in a row, and where each word's begin (one more than the words).

        Words are encoded as one text, in which a blank begins a piece; only beside other
        white space than that which parts words may a piece reach over a word's start, so
        words that hold any are encoded alone.
        """
        texts = [w.decode() for w in words]
        odd = [k for k, t in enumerate(texts) if not t.isascii() and ODD.search(t) or ODD_ASCII.search(t)]
        for k in odd:
            texts[k] = "x"
        ids = np.array(self.coder.encode_ordinary("".join([" " + t for t in texts])), np.int64)
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        sizes[odd] = 2
        ends = np.cumsum(self.lengths[ids])
        bounds = np.concatenate([[0], np.searchsorted(ends, np.cumsum(sizes)) + 1])
        if odd:
            parts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
            for k in odd:
                parts[k] = np.array(self.coder.encode_ordinary(" " + words[k].decode()), np.int64)
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds


@functools.cache
def vocabulary_of(path: str | None) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(path)


class Codes(dict):
    """The places of words in growing columns; `first` and `last` are their first and last subwords. A bounded cache."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.columns: dict[str, np.ndarray] = {}

    def describe(self, words: list[bytes]) -> dict[str, np.ndarray]:
        ids, bounds = self.vocabulary.ids(words)
        return {"first": ids[bounds[:-1]], "last": ids[bounds[1:] - 1]}

    def learn(self, words: list[bytes], keep: int = 0) -> None:
        """Describes words not met before; with `keep` all but the first so many are forgotten where there are over REMEMBERED more."""
        new = list(set(words).difference(self))
        if not new:
            return
        if keep and len(self) > REMEMBERED + keep:
            for word in list(self)[keep:]:
                del self[word]
            self.columns = {k: v[:keep] for k, v in self.columns.items()}
            new = list(set(words).difference(self))
        at = len(self)
        self.update(zip(new, range(at, at + len(new))))
        told = self.describe(new)
        self.columns = {k: np.concatenate([self.columns[k], v]) if k in self.columns else v for k, v in told.items()}

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Network:
    """One causal self-attention layer; a place is a word's first and last subword, the output classes of the next word's first."""

    def __init__(self, classes: np.ndarray, seed: int = 3) -> None:
        rng, d, n = np.random.default_rng(seed), SIZE, len(classes)
        self.classes = classes
        normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        small = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
        # The start of a text is the row after the vocabulary.
        self.p = {
            "first": small(n + 1, d), "last": small(n + 1, d), "pos": small(WINDOW, d),
            "qkv": normal(d, 3 * d), "proj": normal(d, d), "out": normal(d, CLASSES), "bias": np.zeros((CLASSES // d, d), np.float32),
        }
        self.mask = np.tri(WINDOW, dtype=np.float32)

    def forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Activations for (windows, WINDOW, SIZE) embeddings; `e` holds the classes' unnormalised chances, `total` their sums."""
        p, d = self.p, SIZE
        y = x.reshape(-1, d) @ p["qkv"]
        q, k, v = (np.ascontiguousarray(y[:, i * d : (i + 1) * d]).reshape(x.shape) for i in range(3))
        q *= np.float32(1 / np.sqrt(d))
        a = q @ k.transpose(0, 2, 1)
        np.minimum(a, 30, out=a)
        np.exp(a, out=a)
        a *= self.mask
        a *= (1 / (a @ np.ones(WINDOW, a.dtype)))[:, :, None]
        o = (a @ v).reshape(-1, d)
        h = x.reshape(-1, d) + o @ p["proj"]
        np.maximum(h, 0.1 * h, out=h)
        e = h @ p["out"]
        e += p["bias"].reshape(-1)
        np.minimum(e, 30, out=e)
        np.exp(e, out=e)
        return {"x": x, "q": q, "k": k, "v": v, "a": a, "o": o, "h": h, "e": e, "total": e @ np.ones(CLASSES, e.dtype)}

    def embed(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        x = self.p["first"][first]
        x += self.p["last"][last]
        x += self.p["pos"]
        return x

    def log_classes(self, first: np.ndarray, last: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log chances of target classes after each place of (windows, WINDOW) words."""
        c = self.forward(self.embed(first, last))
        t = target.reshape(-1)
        return np.log(c["e"][np.arange(len(t)), t] / c["total"]).reshape(target.shape)

    def backward(self, first: np.ndarray, last: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, Any]]:
        """Mean loss on the target classes and gradients; weight 0 leaves a place out."""
        p, d = self.p, SIZE
        c = self.forward(self.embed(first, last))
        t, w = target.reshape(-1), weight.reshape(-1)
        rows, total = np.arange(len(t)), max(float(w.sum()), 1.0)
        dz, w = c["e"], (w / total).astype(c["e"].dtype)
        dz *= (1 / c["total"])[:, None]
        loss = float(-(np.log(dz[rows, t]) * w).sum())
        dz[rows, t] -= 1
        dz *= w[:, None]
        g: dict[str, Any] = {"out": c["h"].T @ dz, "bias": (np.ones(len(t), dz.dtype) @ dz).reshape(p["bias"].shape)}
        dpre = dz @ p["out"].T
        dpre *= np.where(c["h"] > 0, np.float32(1), np.float32(0.1))
        g["proj"] = c["o"].T @ dpre
        do = (dpre @ p["proj"].T).reshape(c["x"].shape)
        da = do @ c["v"].transpose(0, 2, 1)
        dv = c["a"].transpose(0, 2, 1) @ do
        da -= (do * c["o"].reshape(do.shape)).sum(axis=2, keepdims=True)
        da *= c["a"]
        dq, dk = da @ c["k"], da.transpose(0, 2, 1) @ c["q"]
        dq *= np.float32(1 / np.sqrt(d))
        dqkv = np.concatenate([y.reshape(-1, d) for y in (dq, dk, dv)], axis=1)
        g["qkv"] = c["x"].reshape(-1, d).T @ dqkv
        dx = dpre + dqkv @ p["qkv"].T
        g["pos"] = dx.reshape(c["x"].shape).sum(axis=0)
        g["first"], g["last"] = _by_row(first.reshape(-1), dx), _by_row(last.reshape(-1), dx)
        return loss, g

    def moments(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        return tuple({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))

    def step(self, moments: tuple[dict[str, np.ndarray], dict[str, np.ndarray]], first: np.ndarray, last: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """One step of Adam, in which embeddings of subwords not in the batch rest; the loss before it."""
        m, s = moments
        loss, g = self.backward(first, last, target, weight)
        for name, grad in g.items():
            rows, grad = grad if isinstance(grad, tuple) else (slice(None), grad)
            m[name][rows] += 0.1 * (grad - m[name][rows])
            s[name][rows] += 0.01 * (grad * grad - s[name][rows])
            self.p[name][rows] -= rate * m[name][rows] / (np.sqrt(s[name][rows]) + 1e-6)
        return loss

    def flat(self) -> np.ndarray:
        """All parameters as rows of SIZE numbers."""
        return np.concatenate([v.reshape(-1, SIZE) for v in self.p.values()])

    def add(self, rows: np.ndarray, change: np.ndarray) -> None:
        """Adds to rows of `flat`."""
        whole, at = self.flat(), 0
        whole[rows] += change
        for k, v in self.p.items():
            self.p[k] = whole[at : at + v.size // SIZE].reshape(v.shape)
            at += v.size // SIZE


def _by_row(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, and the sums of their values."""
    if len(ids) and int(ids.max()) < 1 << 16:
        ids = ids.astype(np.uint16)  # which sorts in linear time
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[starts].astype(np.int64), np.add.reduceat(values[order], starts, axis=0)


def windows_of(bounds: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of WINDOW tokens over documents that lie in a row: (begin, fresh, end).

    A window covers begin .. begin + WINDOW - 1 as far as `end`, its document's; tokens from
    `fresh` on are its own. A document's first window owns all it covers, each further one
    `stride` tokens more.
    """
    sizes = bounds[1:] - bounds[:-1]
    more = -(-np.maximum(sizes - WINDOW, 0) // stride)
    owner = np.repeat(np.arange(len(sizes)), more + 1)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    begin, end = bounds[:-1][owner] + nth * stride, bounds[1:][owner]
    fresh = np.where(nth > 0, begin + WINDOW - stride, begin)
    return begin, fresh, end


def before(side: np.ndarray, bounds: np.ndarray, none: int) -> np.ndarray:
    """The subword of the token before each; documents lie in a row, and `none` comes before their first."""
    out = np.empty(len(side), np.int32)
    out[1:] = side[:-1]
    out[bounds[:-1]] = none
    return out


def laid(begin: np.ndarray, fresh: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) arrays: the tokens' places, and which are the window's own."""
    at = begin[:, None] + np.arange(WINDOW)
    own = (at >= fresh[:, None]) & (at < end[:, None])
    return np.minimum(at, end[:, None] - 1, out=at), own


def classify(met: np.ndarray, counts: np.ndarray, rounds: int = 8) -> np.ndarray:
    """A class for each subword: the most frequent first subwords alone, others grouped by what they tend to follow.

    `met` counts, for each subword, how often it follows each of the BEFORE + 1 columns.
    """
    classes = np.zeros(len(counts), np.int64)
    order = np.argsort(-counts, kind="stable")
    classes[order[:SINGLES]] = np.arange(SINGLES)
    rest = order[SINGLES:]
    classes[rest] = SINGLES + np.arange(len(rest)) % GROUPS
    seen = rest[counts[rest] > 0]
    weight = counts[seen].astype(np.float32)
    table = np.sqrt(met[seen] / np.maximum(met[seen].sum(axis=1, keepdims=True), 1)).astype(np.float32)
    centres = table[:GROUPS].copy()
    for _ in range(rounds if len(seen) else 0):
        group = np.argmax(table @ centres.T, axis=1)
        for k in range(len(centres)):
            if (group == k).any():
                mean = np.average(table[group == k], axis=0, weights=weight[group == k])
                centres[k] = mean / max(np.linalg.norm(mean), 1e-6)
        classes[seen] = SINGLES + group
    return classes


class Chain:
    """The chance that a subword goes on as a word does: by what follows its column, drawn to what goes on anywhere."""

    def __init__(self, column: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
        size = len(column)
        self.column, self.keys, self.n = column, keys, n  # keys: column * size + subword (the last subword: the word ends), ascending
        self.totals = np.bincount(keys // size, n, BEFORE + 1)
        alone = np.bincount(keys % size, n, size) + 0.1
        self.alone = alone / alone.sum()

    def log(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log chance of all that follows the first subword of each word, its end included."""
        size = len(self.column)
        follows = np.full(len(ids), size - 1)
        follows[:-1] = ids[1:]
        follows[bounds[1:] - 1] = size - 1
        columns = self.column[ids]
        key = columns * size + follows
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        n = np.where(self.keys[at] == key, self.n[at], 0) if len(self.keys) else np.zeros(len(key))
        logs = np.log((n + DRAWN * self.alone[follows]) / (self.totals[columns] + DRAWN))
        return np.add.reduceat(logs, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)


class Model:
    """What scoring needs: the network, shares, chains, counts by first subword, and frequent words with what is known of them."""

    def __init__(self, network: Network, share: np.ndarray, chains: Chain, begun: np.ndarray, kinds_begun: np.ndarray, ends: int, tokens: int, kinds: int) -> None:
        self.network, self.share, self.chains, self.begun, self.kinds_begun = network, share, chains, begun, kinds_begun
        self.ends, self.tokens, self.kinds = ends, tokens, kinds
        self.none = len(share)
        self.words: list[bytes] = []
        self.columns: dict[str, np.ndarray] = {}

    def remember(self, known: dict[bytes, int], vocabulary: Vocabulary) -> None:
        self.words = list(known)
        self.columns = self.described(self.words, vocabulary) if known else {}
        if known:
            self.columns["c"] = np.fromiter(known.values(), np.int64, len(known))

    def described(self, words: list[bytes], vocabulary: Vocabulary) -> dict[str, np.ndarray]:
        """First and last subwords, c (-1: to be looked up), a = (V + 1) * chain, and b = log(C + V + 1) of words."""
        ids, bounds = vocabulary.ids(words)
        first, last = ids[bounds[:-1]], ids[bounds[1:] - 1]
        more = self.kinds_begun[first] + 1.0
        return {"first": first, "last": last, "c": np.full(len(words), -1), "a": more * np.exp(self.chains.log(ids, bounds)), "b": np.log(self.begun[first] + more)}

    def first_logs(self, first: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log chance of each token's first subword after the tokens before it, for documents that lie in a row."""
        out = np.zeros(len(first))
        target = self.network.classes[first]
        x, y = before(first, bounds, self.none), before(last, bounds, self.none)
        begin, fresh, end = windows_of(bounds, STRIDE)
        for k in range(0, len(begin), BATCH):
            at, own = laid(begin[k : k + BATCH], fresh[k : k + BATCH], end[k : k + BATCH])
            out[at[own]] = self.network.log_classes(x[at], y[at], target[at])[own]
        return out + self.share[first]


class Known(Codes):
    """Codes of words with what scoring needs of each; the frequent ones come first."""

    def __init__(self, vocabulary: Vocabulary, model: Model) -> None:
        super().__init__(vocabulary)
        self.model, self.frequent = model, len(model.words)
        self.update(zip(model.words, range(self.frequent)))
        self.columns = dict(model.columns)

    def describe(self, words: list[bytes]) -> dict[str, np.ndarray]:
        return self.model.described(words, self.vocabulary)


def subword_counts(words: DataFrame, path: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(times begun with, words begun with) by subword, and counts of (column, following subword) pairs within words.

    All come from the distinct words. At most BEFORE + 3 numbers a subword reach the driver.
    """
    size = vocabulary_of(path).size

    def added(batches: Iterator[pa.RecordBatch], of: Any) -> Iterator[pa.RecordBatch]:
        vocabulary, total = vocabulary_of(path), Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bounds = vocabulary.ids(batch.column(0).cast(pa.binary()).to_pylist())
            for key, n in of(ids, bounds, batch.column(1).to_numpy()):
                some, sums = _by_row(key, n)
                total.update(dict(zip(some.tolist(), sums.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["at", "n"])

    def gathered(of: Any) -> tuple[np.ndarray, np.ndarray]:
        got = words.mapInArrow(lambda batches: added(batches, of), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").toArrow()
        return got["at"].to_numpy(), got["n"].to_numpy()

    def alone(ids: np.ndarray, bounds: np.ndarray, c: np.ndarray) -> list:
        first = ids[bounds[:-1]]
        return [(first, c), (size + first, np.ones_like(c)), (2 * size + ids, np.repeat(c, bounds[1:] - bounds[:-1]))]

    at, n = gathered(alone)
    table = np.bincount(at, n, 3 * size).reshape(3, size)
    column = np.full(size, BEFORE)
    often = np.argsort(-table[2], kind="stable")[:BEFORE]
    column[often] = np.arange(len(often))

    def follows(ids: np.ndarray, bounds: np.ndarray, c: np.ndarray) -> list:
        after = np.full(len(ids), size - 1)
        after[:-1] = ids[1:]
        after[bounds[1:] - 1] = size - 1
        return [(column[ids] * size + after, np.repeat(c, bounds[1:] - bounds[:-1]))]

    return table[0], table[1], column, *gathered(follows)


def frequent_words(words: DataFrame) -> dict[bytes, int]:
    """Counts of the most frequent words, at most FREQUENT, by a least count.

    A histogram of counts in steps of an eighth of an octave finds that count, so no
    partition sends more than what is kept.
    """
    short = words.where(F.octet_length("word") <= LONGEST_FREQUENT).withColumn("step", F.floor(F.log2("c") * 8))
    least, total = 1 << 20, 0
    for r in sorted(short.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        total += r["n"]
        if total > FREQUENT:
            break
        least = r["step"]
    got = short.where(F.col("step") >= least).select("word", "c").toArrow()
    return dict(zip(got["word"].cast(pa.binary()).to_pylist(), got["c"].to_pylist()))


def coded(training: DataFrame, path: str | None) -> DataFrame:
    """Two kinds of rows: doc_id and `codes` of every training document, its words' first, then their last subwords
    (little-endian unsigned 16-bit); and word and c, counts that each task has summed over what it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = Codes(vocabulary_of(path)), np.zeros(0, np.int64)

        def told(owners: pa.Array, found: list[bytes], words: list[bytes], c: np.ndarray) -> pa.RecordBatch:
            m, n = len(owners), len(words)
            columns = [
                pa.concat_arrays([owners, pa.nulls(n, pa.int64())]), pa.concat_arrays([pa.array(found, pa.binary()), pa.nulls(n, pa.binary())]),
                pa.concat_arrays([pa.nulls(m, pa.string()), pa.array(words, pa.binary()).cast(pa.string())]), pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(c, pa.int64())]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "codes", "word", "c"])

        none = pa.array([], pa.int64())
        for batch in in_chunks(batches):
            texts = [words_of(t) for t in texts_of(batch)]
            every = list(chain.from_iterable(texts))
            if len(codes) > REMEMBERED:
                yield told(none, [], list(codes), counts)
                codes, counts = Codes(vocabulary_of(path)), np.zeros(0, np.int64)
            codes.learn(every)
            at, out, begin = codes.places(every), [], 0
            fresh = np.bincount(at, minlength=len(codes))
            fresh[: len(counts)] += counts
            counts = fresh
            pairs = [codes.columns[k][at].astype("<u2") if len(at) else np.zeros(0, "<u2") for k in ("first", "last")]
            for own in texts:
                out.append(b"".join(x[begin : begin + len(own)].tobytes() for x in pairs))
                begin += len(own)
            yield told(batch.column(0), out, [], np.zeros(0, np.int64))
        yield told(none, [], list(codes), counts)

    return training.select("doc_id", "text").mapInArrow(run, "doc_id long, codes binary, word string, c long")


def word_counts(codes: DataFrame) -> DataFrame:
    """(word, c) over all training documents."""
    return codes.where("word is not null").groupBy("word").agg(F.sum("c").alias("c"))


def decoded(codes: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, bounds) of documents in a row, each with its end."""
    bounds = np.zeros(len(codes) + 1, np.int64)
    np.cumsum([len(c) // 4 + 1 for c in codes], out=bounds[1:])
    sides = []
    for side in (0, 1):
        out = np.full(bounds[-1], end, np.int64)
        there = np.ones(len(out), bool)
        there[bounds[1:] - 1] = False
        out[there] = np.frombuffer(b"".join(c[side * len(c) // 2 : (side + 1) * len(c) // 2] for c in codes), "<u2")
        sides.append(out)
    return *sides, bounds


def follow_counts(codes: DataFrame, column: np.ndarray, end: int) -> np.ndarray:
    """How often each subword begins a word after one that ends in each column (the start of a text: the last column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in in_chunks(batches, "codes"):
            first, last, bounds = decoded(batch.column(0).to_pylist(), end)
            before = np.full(len(first), BEFORE)
            before[1:] = column[last[:-1]]
            before[bounds[:-1]] = BEFORE
            some, n = np.unique(first * (BEFORE + 1) + before, return_counts=True)
            total.update(dict(zip(some.tolist(), n.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["at", "n"])

    got = codes.select("codes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((end + 1) * (BEFORE + 1), np.float32)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(end + 1, BEFORE + 1)


def examples(network: Network, codes: list[bytes], end: int, pick: np.random.Generator | None = None, most: int = 0) -> tuple[np.ndarray, ...]:
    """Inputs, target classes and weights of all windows of documents, each token once; with `pick` at most `most` windows a document."""
    first, last, bounds = decoded(codes, end)
    before_first, before_last = before(first, bounds, end + 1), before(last, bounds, end + 1)
    begin, fresh, stop = windows_of(bounds, WINDOW)
    if pick is not None:
        order = np.lexsort((pick.random(len(begin)), stop))
        nth = np.arange(len(order)) - np.searchsorted(stop[order], stop[order])
        some = order[nth < most]
        begin, fresh, stop = begin[some], fresh[some], stop[some]
    at, own = laid(begin, fresh, stop)
    return before_first[at], before_last[at], network.classes[first[at]], own.astype(np.float32)


def begin_learning(network: Network, sample: list[bytes], end: int) -> None:
    """Adam over some windows of a bounded number of documents, in an order of its own."""
    rng = np.random.default_rng(5)
    parts = examples(network, sample, end, rng, WINDOWS_A_DOCUMENT)
    moments, step, n = network.moments(), 0, len(parts[0])
    while n and step < LEAST_STEPS:
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            step += 1
            some = order[k : k + BATCH]
            network.step(moments, *[p[some] for p in parts], 1e-2 * min(1.0, step / 40) * max(0.1, 1 - step / LEAST_STEPS))
            if step >= LEAST_STEPS:
                break


def learn_all(network: Network, codes: DataFrame, end: int) -> None:
    """A pass over every window of every training document; a row of parameters changes by the mean of the tasks that used it."""
    sent = codes.sparkSession.sparkContext.broadcast(network)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, rng = Network(sent.value.classes), np.random.default_rng(7)
        net.p = {k: v.copy() for k, v in sent.value.p.items()}
        moments, steps, seen = net.moments(), 0, 0
        for batch in in_chunks(batches, "codes"):
            parts = examples(net, batch.column(0).to_pylist(), end)
            order = rng.permutation(len(parts[0]))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                steps += 1
                net.step(moments, *[p[some] for p in parts], RATE * min(1.0, steps / 50))
            seen += len(order)
        change = net.flat() - sent.value.flat()
        rows = np.flatnonzero(change.any(axis=1))
        for k in range(0, len(rows), 4096):
            some = rows[k : k + 4096]
            values = pa.FixedSizeListArray.from_arrays(pa.array(change[some].reshape(-1).astype(np.float64)), SIZE).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), float(seen))), values], names=["row", "n", "change"])

    told = codes.select("codes").mapInArrow(run, "row long, n double, change array<double>")
    mean = F.array(*[F.sum(F.col("n") * F.col("change")[i]) / F.sum("n") for i in range(SIZE)])
    got = told.groupBy("row").agg(mean.alias("change")).toArrow()
    if got.num_rows:
        network.add(got["row"].to_numpy(), got["change"].combine_chunks().flatten().to_numpy().reshape(-1, SIZE).astype(np.float32))


def fit(codes: DataFrame, words: DataFrame, path: str | None = None) -> Model:
    """Counts of all training words; a network that starts from a bounded number of documents and then learns from all."""
    vocabulary = vocabulary_of(path)
    end = vocabulary.end
    tokens, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = frequent_words(words)
    begun, kinds_begun, column, keys, n = subword_counts(words, path)
    codes = codes.where("codes is not null").select("doc_id", "codes")
    ends = codes.count()
    begun[end] += ends
    network = Network(classify(follow_counts(codes, column, end), begun))
    sample = codes.join(F.broadcast(bounded_sample(codes.select("doc_id").distinct(), "doc_id", TRAIN_DOCUMENTS)), "doc_id")
    some = sample.groupBy("doc_id").agg(F.min("codes").alias("codes")).collect()  # one text of a doc_id, however often it repeats
    begin_learning(network, [bytes(r["codes"]) for r in sorted(some, key=lambda r: r["doc_id"])], end)
    learn_all(network, codes, end)
    smooth = begun + 0.1
    share = np.log(smooth / np.bincount(network.classes, smooth, CLASSES)[network.classes])
    model = Model(network, share, Chain(column, keys, n), begun, kinds_begun, ends, int(tokens) + ends, int(kinds) + (ends > 0))
    model.remember(known, vocabulary)
    return model


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = rows.where(remainder(F.col("doc_id")) != 1)
    codes = durable(coded(training, path))
    words = durable(word_counts(codes))
    model = fit(codes, words, path)
    sent = spark.sparkContext.broadcast(model)  # bounded by FREQUENT, LONGEST_FREQUENT and BEFORE times the vocabulary
    smooth = model.tokens + 0.5 * (model.kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        known, end = Known(vocabulary_of(path), m), vocabulary_of(path).end
        for batch in in_chunks(batches):
            texts = [words_of(t) for t in texts_of(batch)]
            every = list(chain.from_iterable(texts))
            known.learn(every, known.frequent)
            bounds = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(own) + 1 for own in texts], out=bounds[1:])
            there = np.ones(bounds[-1], bool)
            there[bounds[1:] - 1] = False
            place = known.places(every)

            def column(name: str, at_end: float, kind: type) -> np.ndarray:
                out = np.full(bounds[-1], at_end, kind)
                if len(place):
                    out[there] = known.columns[name][place]
                return out

            first = column("first", end, np.int64)
            logs = m.first_logs(first, column("last", end, np.int64), bounds) - column("b", 0.0, np.float64)
            c, a = column("c", m.ends, np.int64), column("a", 0.0, np.float64)
            here = c >= 0
            own = np.where(here & there, np.log(np.where(here, c, 0) + a + 1e-300), 0.0) + logs
            base = np.where(here, np.log((np.where(here, c, 0) + 0.5) / smooth), 0.0)
            each = [np.add.reduceat(x, bounds[:-1]) for x in (own, base, (c > 0).astype(np.int64))] if len(texts) else [np.zeros(0)] * 3
            # Words to be looked up, once for each document.
            doc = np.repeat(np.arange(len(texts)), bounds[1:] - bounds[:-1])
            at = np.full(bounds[-1], -1)
            at[there] = place
            pairs, times = np.unique((doc * (len(known) + 1) + at)[~here], return_counts=True)
            owner, which = pairs // (len(known) + 1), pairs % (len(known) + 1)
            needed, back = np.unique(which, return_inverse=True)
            names = dict(zip(place.tolist(), every)) if len(needed) else {}
            dictionary = pa.array([names[i] for i in needed.tolist()], pa.binary()).cast(pa.string())
            n, k = len(texts), len(pairs)
            row = batch.column(1).take(pa.array(np.concatenate([np.arange(n), owner]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.concatenate([np.arange(n), owner]).astype(np.int64))), row,
                    pa.chunked_array([pa.nulls(n, pa.string()), dictionary.take(pa.array(back.astype(np.int64)))], pa.string()).combine_chunks(),
                    pa.array(np.concatenate([np.zeros(n, np.int64), times])), pa.array(np.concatenate([np.zeros(n), known.columns["a"][which] if k else np.zeros(0)])),
                    pa.array(np.concatenate([bounds[1:] - bounds[:-1], np.zeros(k, np.int64)])), pa.array(np.concatenate([each[2], np.zeros(k)]).astype(np.int64)),
                    pa.array(np.concatenate([each[1], np.zeros(k)]) / np.log(10)), pa.array(np.concatenate([each[0], np.zeros(k)]) / np.log(10)),
                ],
                names=["doc_id", "row", "word", "times", "a", "n_tokens", "n_known", "base", "score"],
            )

    schema = "doc_id long, row long, word string, times long, a double, n_tokens long, n_known long, base double, score double"
    scored = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, schema)
    # A row without a word is a document's sum over frequent words; a blank keeps it from meeting any word.
    keyed = scored.withColumn("key", F.coalesce("word", F.concat(F.lit(" "), F.col("row").cast("string"))))
    met = keyed.join(words.select(F.col("word").alias("key"), "c"), "key", "left")
    c, own, times = F.coalesce("c", F.lit(0)).cast("double"), F.col("word").isNotNull(), F.col("times")
    parts = met.select(
        "row", "doc_id", "n_tokens", (F.col("n_known") + F.when(own & (c > 0), times).otherwise(0)).alias("n_known"),
        (F.col("base") + F.when(own, times * F.log10((c + 0.5) / smooth)).otherwise(0.0)).alias("base"),
        (F.col("score") + F.when(own, times * F.log10(c + F.col("a") + F.lit(1e-300))).otherwise(0.0)).alias("score"),
    )
    sums = parts.groupBy("row", "doc_id").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    return sums.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
