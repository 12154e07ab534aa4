"""Operator 6: best-fit-decreasing packing of documents into token sequences.

Where a document goes depends on its length alone, and there are at most `capacity`
lengths. So executors tokenize and count; the driver packs the counts (at most
`capacity` rows); executors look up each piece's place by its rank among the pieces
of its length. The packing is that of best fit decreasing over the whole corpus: the
longest piece first, each into the fullest open sequence that still holds it. A
segment tree over remaining capacities finds that sequence in logarithmic time. Once
a sequence is the tightest it stays so until the length no longer fits, so equal
sequences that take equal pieces are handled as one run.

Ranks come from (length, salt) groups, so a length that a third of all documents
share is numbered by many tasks.

Defined results: null text is empty text and gives one piece with the end id alone.
Repeated rows are packed once each. A null doc_id stays null. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .store import bounded_batches, durable, in_chunks, texts_of

CAPACITY = 2048
END_ID = 0
SALTS = 256
#: Above so many runs the lookup table is joined by shuffle instead of broadcast.
MOST_RUNS = 200_000


class Run(NamedTuple):
    """Pieces of one length with ranks first.. first+count-1, `each` to a sequence from `sequence` on, the first at `offset`."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


class Capacities:
    """Open sequences by remaining capacity; a segment tree finds the least capacity that suffices."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.width)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _renew(self, left: int) -> None:
        k = self.width + left
        self.any[k] = bool(self.open[left])
        while k > 1:
            k >>= 1
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def add(self, left: int, first: int, count: int) -> None:
        """Sequences first.. first+count-1 have `left` tokens to spare."""
        if count:
            self.open[left].append((first, count))
            self._renew(left)

    def take(self, left: int) -> tuple[int, int]:
        run = self.open[left].pop()
        self._renew(left)
        return run

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need that some open sequence has."""
        k = self.width + need
        if self.any[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.width
            k >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best fit decreasing over counts of lengths."""
    room, opened, runs = Capacities(capacity), 0, []
    for length in sorted(counts, reverse=True):
        placed, n = 0, counts[length]
        while placed < n:
            left = room.tightest(length)
            if left is None:
                left = capacity
                first, m = opened, -(-(n - placed) // (capacity // length))
                opened += m
            else:
                first, m = room.take(left)
            each = left // length
            some = min(n - placed, m * each)
            full, over = divmod(some, each)
            runs.append(Run(length, placed, some, first, each, capacity - left))
            room.add(left - each * length, first, full)
            if over:
                room.add(left - over * length, first + full, 1)
            room.add(left, first + full + (over > 0), m - full - (over > 0))
            placed += some
    return runs


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; with `with_ids` also its ids (little-endian unsigned 32-bit)."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        for batch in in_chunks(batches):
            owner, number, start, length, crc, raw = [], [], [], [], [], []
            for k, ids in enumerate(coder.encode(texts_of(batch))):
                ids += end
                n = len(ids) // 4
                at = 0
                for i in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if i == 0 else capacity
                    part = ids[4 * at : 4 * (at + size)]
                    owner.append(k), number.append(i), start.append(at), length.append(size), crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(part)
                    at += size
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset there."""
    spark = docs.sparkSession
    # The salt comes from the row, so that neither missing nor repeated ids share one.
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    cut = durable(pieces(docs, path, capacity, end_id, with_ids).withColumn("salt", salt))
    # At most capacity * SALTS rows, whatever the input.
    groups = durable(cut.groupBy("length", "salt").count())
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = spark.createDataFrame(best_fit(counts, capacity), "length long, first long, count long, sequence long, each long, offset long")
    before = groups.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    ranked = cut.withColumn("local", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.expr("before + local - 1"))
    few = runs.count() <= MOST_RUNS
    table = runs.select(F.col("length").alias("run_length"), "first", F.col("count"), "sequence", "each", F.col("offset").alias("run_offset"))
    placed = ranked.join(F.broadcast(table) if few else table, F.expr("length = run_length and rank >= first and rank < first + count"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("sequence + (rank - first) div each").alias("sequence_id"),
        F.expr("run_offset + (rank - first) % each * length").alias("offset"),
        *["ids"] * with_ids,
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each whole sequence (array of its pieces in order), from `pack(..., with_ids=True)`.

    A sequence holds at most `capacity` tokens, so the groups are bounded.
    """
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("pieces"))
