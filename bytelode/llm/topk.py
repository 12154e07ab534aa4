"""Operator 2: exact top-k by inner product, in three phases with one uniform threshold.

A score is a sum over slices of the vector. Each slice has a local list of scores.

1. For every query the best k entries of each slice's list are gathered; only their whole
   scores are computed. The k-th best of them is a safe cutoff, as k real scores reach it.
2. The cutoff goes to all slices. A row whose score reaches the cutoff must have the share
   cutoff / slices in one slice at least, so each slice reports just the entries that do.
3. A reported row scores at most what its reporting slices say, and less than the share in
   each of the others. Where that bound reaches the cutoff, the score is computed exactly.

Rows are dealt into blocks, held as the narrowest whole numbers; every block of queries
meets every block of rows, and the pairs of blocks are spread over all tasks. A task keeps k
rows a query for at most `HELD` query blocks, so no list grows with the table. Arithmetic is
on whole numbers that the floating type in use holds exactly, or on int64 where products are
larger (scores beyond a long are not defined).

Defined results: vectors that are null or hold null or non-finite components take no
part; shorter vectors count as padded with zeros; an empty vector scores 0. Rows with a null
vec_id take no part. Rows that repeat a vec_id are candidates each, but not of queries of
that vec_id; a repeated query has the best k of all its rows. A query with fewer than k
partners gets all. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, durable

ROWS_A_BLOCK = 2048
QUERIES_A_BLOCK = 512
SLICES = 4
HELD = 32
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and `q`, the vector's components as floor(scale * x), of rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("q"))


def blocks(rows: DataFrame, size: int, n: int, name: str) -> DataFrame:
    """Rows dealt into `n` groups and these into blocks of at most 4 * `size`: (name, nth, ids, vectors, width, kind), ids ascending, vectors as raw numbers."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        out = []
        for nth, at in enumerate(range(0, len(pdf), 4 * size)):
            part = pdf.iloc[at : at + 4 * size]
            width = max(map(len, part["q"]))
            m = np.zeros((len(part), width), np.int64)
            for k, v in enumerate(part["q"]):
                m[k, : len(v)] = v
            most = max(int(m.max(initial=0)), -int(m.min(initial=0)) - 1)
            kind = "i1" if most < 1 << 7 else "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8"
            out.append((int(part[name].iloc[0]), nth, part["vec_id"].to_numpy(np.int64), m.astype(kind).tobytes(), width, kind))
        return pd.DataFrame(out, columns=[name, "nth", "ids", "vectors", "width", "kind"])

    # Rows of one repeated vec_id may be many, so the block comes from the whole row.
    dealt = rows.withColumn(name, F.expr(f"cast(pmod(xxhash64(vec_id, q, monotonically_increasing_id()), {n}) as int)"))
    return dealt.groupBy(name).applyInPandas(pack, f"{name} int, nth int, ids array<long>, vectors binary, width int, kind string")


def matrix(raw: bytes, kind: str, rows: int, width: int, wide: int) -> np.ndarray:
    m = np.frombuffer(raw, kind).reshape(rows, width)
    return np.pad(m, ((0, 0), (0, wide - width))) if width < wide else m


def partials(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Exact inner products of each slice of the components."""
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(1, q.shape[1])
    kind = np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else np.int64
    cuts = np.linspace(0, q.shape[1], SLICES + 1).astype(int)
    return [q[:, a:b].astype(kind) @ c[:, a:b].T.astype(kind) for a, b in zip(cuts, cuts[1:])]


def exact(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Whole scores of single pairs."""
    out = np.zeros(len(rows), np.int64)
    for k in range(0, len(rows), 1 << 14):
        some = slice(k, k + (1 << 14))
        out[some] = np.einsum("ij,ij->i", q[rows[some]].astype(np.int64), c[cols[some]].astype(np.int64))
    return out


class Best:
    """The k best (score, id) of each query of one block, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.score, self.id = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.int64)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Entries of queries `rows`, ascending."""
        counts = np.bincount(rows, minlength=len(self.ids))
        place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        shape = (len(self.ids), int(counts.max(initial=0)))
        more, named = np.full(shape, LEAST), np.full(shape, MOST)
        more[rows, place], named[rows, place] = score, ids
        score, ids = np.concatenate([self.score, more], axis=1), np.concatenate([self.id, named], axis=1)
        order = np.lexsort((ids, ~score), axis=1)[:, : self.k]  # ~score descends as score ascends, without overflow
        self.score, self.id = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    def told(self) -> pd.DataFrame:
        rows, cols = np.nonzero(self.id != MOST)
        return pd.DataFrame({"query_id": self.ids[rows], "vec_id": self.id[rows, cols], "score": self.score[rows, cols]})


def gathered(parts: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: (query, row) of the k best entries of each slice's list (one more, as the query itself may be one)."""
    take = min(k + 1, parts[0].shape[1])
    local = np.concatenate([np.argpartition(-p, take - 1, axis=1)[:, :take] for p in parts], axis=1)
    local.sort(axis=1)
    again = np.zeros(local.shape, bool)
    again[:, 1:] = local[:, 1:] == local[:, :-1]
    rows, at = np.nonzero(~again)
    return rows, local[rows, at]


def sufficient(parts: list[np.ndarray], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query, row) that some slice reports and whose bound reaches the query's cutoff."""
    share = cutoff / SLICES
    share[abs(share) >= 2.0**50] -= 2.0**12  # below the exact quotient in spite of rounding
    share = share[:, None]
    reported = np.zeros(parts[0].shape, bool)
    for p in parts:
        reported |= p >= share
    rows, cols = np.nonzero(reported)
    bound = sum(np.maximum(p[rows, cols].astype(float), share[rows, 0]) for p in parts)
    near = np.abs(bound) * 2.0**-40 + 1
    keep = bound + near >= cutoff[rows]
    return rows[keep], cols[keep]


def met(pdfs: Iterator[pd.DataFrame], k: int, cut: bool) -> Iterator[pd.DataFrame]:
    """Phase 1 (cut is false) or phases 2 and 3, over pairs of blocks."""
    best: dict[tuple[int, int], Best] = {}
    for pdf in pdfs:
        for r in pdf.itertuples(index=False):
            if (r.qb, r.q_nth) not in best:
                if len(best) >= HELD:
                    yield from (b.told() for b in best.values())
                    best.clear()
                best[r.qb, r.q_nth] = Best(np.asarray(r.q_ids, np.int64), k)
            own = best[r.qb, r.q_nth]
            ids, wide = np.asarray(r.c_ids, np.int64), max(r.q_width, r.c_width)
            q, c = matrix(r.q_vectors, r.q_kind, len(own.ids), r.q_width, wide), matrix(r.c_vectors, r.c_kind, len(ids), r.c_width, wide)
            if not wide:
                q, c = np.zeros((len(own.ids), 1), np.int8), np.zeros((len(ids), 1), np.int8)
            parts = partials(q, c)
            if cut:
                known, at = np.asarray(r.known_ids, np.int64), np.full(len(own.ids), LEAST)
                if len(known):
                    place = np.minimum(np.searchsorted(known, own.ids), len(known) - 1)
                    at = np.where(known[place] == own.ids, np.asarray(r.known, np.int64)[place], LEAST)
                rows, cols = sufficient(parts, at)
            else:
                rows, cols = gathered(parts, k)
            other = ids[cols] != own.ids[rows]
            rows, cols = rows[other], cols[other]
            score = exact(q, c, rows, cols)
            if cut:
                keep = score >= at[rows]
                rows, cols, score = rows[keep], cols[keep], score[keep]
            if len(rows):
                own.add(rows, score, ids[cols])
    yield from (b.told() for b in best.values())


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each query (rows whose vec_id `every` divides) over all other rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    ready = durable(quantize(vectors))
    asked_for = ready.where(f"vec_id % {every} = 0")
    total, asked = ready.agg(F.count("*"), F.count_if(F.expr(f"vec_id % {every} = 0"))).first()
    n_rows, n_asked = max(1, -(-total // ROWS_A_BLOCK)), max(1, -(-asked // QUERIES_A_BLOCK))
    rows = durable(blocks(ready, ROWS_A_BLOCK, n_rows, "cb")).selectExpr("cb", "ids c_ids", "vectors c_vectors", "width c_width", "kind c_kind")
    queries = durable(blocks(asked_for, QUERIES_A_BLOCK, n_asked, "qb")).selectExpr("qb", "nth q_nth", "ids q_ids", "vectors q_vectors", "width q_width", "kind q_kind")
    # Each task takes some blocks of rows and meets all query blocks, which are a twentieth of the rows.
    sides = rows.repartition(max(1, min(n_rows, 8 * spark.sparkContext.defaultParallelism)), "cb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))

    def found(queries: DataFrame, cut: bool) -> DataFrame:
        pairs = sides.join(queries, "qb").select(*queries.columns, "c_ids", "c_vectors", "c_width", "c_kind")
        return pairs.mapInPandas(lambda it: met(it, k, cut), "query_id long, vec_id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.expr("cast(row_number() over (partition by query_id order by score desc, vec_id) as int)")).where(f"rank <= {k}")

    # Phase 1: k real scores of each query; the least of them is a cutoff that every answer reaches.
    cutoffs = durable(ranked(found(queries, False)).groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n")).where(f"n = {k}").drop("n"))
    # A block's list is as long as the block has queries.
    ids = queries.select("qb", "q_nth", F.explode("q_ids").alias("query_id")).distinct()
    listed = ids.join(cutoffs, "query_id").groupBy("qb", "q_nth").agg(F.sort_array(F.collect_list(F.struct("query_id", "cutoff"))).alias("known"))
    told = queries.join(listed, ["qb", "q_nth"], "left").selectExpr(*queries.columns, "coalesce(known.query_id, array()) known_ids", "coalesce(known.cutoff, array()) known")
    # Phases 2 and 3.
    return ranked(found(durable(told), True)).select("query_id", "rank", "vec_id", "score")

