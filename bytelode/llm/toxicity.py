"""Operator 8: toxicity by a factorization machine over hashed terms.

Terms are a document's distinct words and their four-letter beginnings (which catch
inflected insults), hashed to buckets. The machine adds a weight for each term and,
through low-rank factors, one for each pair of terms:

    w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)

It is fitted on at most `TRAIN_ROWS` labelled rows (those with the least hash of
doc_id), never on held-out ones; only the `TERMS` buckets that go with the
label most clearly have weights. Every document is scored by its whole text.

Defined results: null or empty text gets the score of no terms. Labels that are null
are not learnt from; a doc_id labelled twice counts as toxic if one label says so, and of
rows that share a doc_id one is learnt from (that with the least terms). A
null doc_id is held_out false and never learnt from. Without any usable labels all
scores are 0. Repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, bounded_sample, in_chunks, texts_of

BUCKETS = 1 << 20
FACTORS = 4
TRAIN_ROWS = 10_000
LEAST_DOCUMENTS = 4
TERMS = 500
PREFIX = 4
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@functools.lru_cache(1 << 16)  # some 25 MB, kept by the worker process
def word_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginning."""
    own = zlib.crc32(word.encode()) % BUCKETS
    return (own, zlib.crc32(b"^" + word[:PREFIX].encode()) % BUCKETS) if len(word) > PREFIX else (own,)


def buckets(text: str) -> set[int]:
    return {b for word in set(WORD.findall(text.lower())) for b in word_buckets(word)}


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


class Machine:
    """Weights of the known buckets; others weigh nothing."""

    def __init__(self, known: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.known, self.w0, self.w, self.v = {int(b): i for i, b in enumerate(known)}, w0, w, v

    def score(self, text: str) -> float:
        own = list(map(self.known.__getitem__, self.known.keys() & buckets(text)))
        own.sort()  # the sum must not depend on the order of a set
        s = self.v[own].sum(axis=0)
        z = self.w0 + self.w[own].sum() + 0.5 * float((s * s).sum() - (self.v[own] ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def chosen_terms(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The TERMS buckets that go with the label most clearly (chi-squared), of those that LEAST_DOCUMENTS rows hold.

    Pairs of terms that say nothing would drown the pairs that do.
    """
    every, back, documents = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    seen = np.bincount(back, np.repeat(toxic, [len(r) for r in rows]), len(every))
    chance = documents * toxic.mean()
    strength = np.where(documents >= LEAST_DOCUMENTS, (seen - chance) ** 2 / np.maximum(chance, 0.1), -1.0)
    best = np.argsort(-strength, kind="stable")[:TERMS]
    return np.sort(every[best[strength[best] > 0]])


def fit(rows: list[np.ndarray], toxic: np.ndarray, epochs: int = 30, rate: float = 0.1, l1: float = 1e-4, l2: float = 1e-4, seed: int = 7) -> Machine:
    """Minimises logistic loss by AdaGrad over small batches, with soft thresholding of the single weights."""
    if not len(rows) or toxic.min() == toxic.max():
        return Machine(np.zeros(0, np.int64), -60.0, np.zeros(0), np.zeros((0, FACTORS)))
    known = chosen_terms(rows, toxic)
    place = np.full(BUCKETS, -1)
    place[known] = np.arange(len(known))
    local = [p[p >= 0] for p in (place[r] for r in rows)]
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(len(known)), rng.normal(0, 0.01, (len(known), FACTORS)), float(np.log(toxic.mean() / (1 - toxic.mean())))
    gw, gv, g0 = np.full(len(known), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(local))
        for at in range(0, len(order), 64):
            some = [local[i] for i in order[at : at + 64]]
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            ids, owner = np.concatenate(some), np.repeat(np.arange(len(some)), sizes)
            sums = np.stack([np.bincount(owner, v[ids, f], len(some)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(owner, (v[ids] ** 2).sum(axis=1), len(some))
            z = w0 + np.bincount(owner, w[ids], len(some)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - toxic[order[at : at + 64]]) / len(some)
            touched, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, g[owner], len(touched))
            dv = np.stack([np.bincount(back, g[owner] * (sums[owner, f] - v[ids, f]), len(touched)) for f in range(FACTORS)], axis=1) + l2 * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            g0 += float(g.sum()) ** 2
            step = rate / np.sqrt(gw[touched])
            new = w[touched] - step * dw
            w[touched] = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            v[touched] -= 0.3 * rate / np.sqrt(gv[touched]) * dv
            w0 -= rate / np.sqrt(g0) * float(g.sum())
    useful = (w != 0) | (np.abs(v).max(axis=1) > 1e-4)
    return Machine(known[useful], w0, w[useful], v[useful])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most `rows` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    there = texts.select("doc_id").distinct().join(known, "doc_id")
    sample = bounded_sample(there, "doc_id", rows)  # bounded, so it may be broadcast
    chosen = texts.join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            found = [np.array(sorted(buckets(t)), np.int32).tobytes() for t in texts_of(batch)]
            toxic = batch.column(batch.schema.get_field_index("toxic"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), toxic], names=["doc_id", "terms", "toxic"])

    measured = chosen.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, terms binary, toxic int")
    got = measured.groupBy("doc_id").agg(F.min("terms").alias("terms"), F.max("toxic").alias("toxic")).collect()  # at most `rows`, however often an id repeats
    got.sort(key=lambda r: (r["doc_id"], bytes(r["terms"])))
    return fit([np.frombuffer(r["terms"], np.int32) for r in got], np.array([float(r["toxic"] > 0) for r in got]))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Any = sent.value
        for batch in in_chunks(batches):
            found = [own.score(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64()), pa.array([int(x >= 0.5) for x in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))).mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, rows))


def keep_clean(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not predicted toxic."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Any = sent.value
        for batch in in_chunks(batches):
            yield batch.filter(pa.array([own.score(t) < 0.5 for t in texts_of(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
