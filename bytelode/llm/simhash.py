"""Operator 5: SimHash near-duplicates by meet-in-the-middle ball hashing.

Every document gets a 64-bit SimHash. Equal fingerprints are one class, so a group
of copies costs one row from here on. Every distinct fingerprint emits all 65
fingerprints within half the radius (1 of 2 bits). Two fingerprints at most 2 bits
apart share at least one of those, and whatever meets on one lies within 2 bits of
everything else there, so the rows of a variant are bound by 65 and a star from the
least of them keeps every link. The stars' connected components come from
alternating large-star and small-star rounds.

Defined results: null text is empty text; texts without words have fingerprint zero
and link like any other. Repeated rows link to each other. A null doc_id takes part
but is never a component's id unless the component holds no other. Other columns
are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded_batches, durable, forget, in_chunks, texts_of

BITS = 64
RADIUS = 2
SEED = 42
#: Bits of the long print from which tables take theirs, bits of a table's ball, and the chance that a pair of the similarity may be missed by all tables (of large sets; up to some ten times that for sets of 6 to 25 shingles).
LONG, BALL, MISSED = 2048, 26, 3e-6
#: Cells hold about two to this power rows, so that their variants fit into a worker.
CELL = 14
#: Tables by which rows are weighed and get their hub, and the most shingles of sets that also meet by leaving one out.
WEIGHED, TINY = 16, 5
#: Rows that meet others up to so often in the weighed tables are paired with all they meet, so pairs grow with the rows; those that meet more go by rare shingles among each other.
APART = 90
#: Up to so many edges (16 bytes each) are joined on the driver; more go by rounds.
GATHERED = 100_000
#: Up to so many wanted texts (some 60 bytes each) their names are sent to all tasks.
SENT = 200_000


def fingerprint(text: str, words: int = 3, seed: int = SEED) -> int:
    """SimHash of the word shingles of a whole text."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(parts) - words + 1
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n
    )
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 14):  # a bounded block of bits at a time
        ones += np.unpackbits(hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and `fp`, the SimHash as a signed long, of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            found = np.array([fingerprint(t, words) for t in texts_of(batch)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fp long")


def close_stars(prints: DataFrame) -> DataFrame:
    """Edges (a < b) between distinct `fp`: stars that connect all within RADIUS bits of each other."""
    flips = [0] + [1 << b if b < 63 else -(1 << 63) for b in range(BITS)]
    masks = F.array(*[F.lit(f).cast("long") for f in flips])
    balls = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = balls.withColumn("a", F.min("fp").over(Window.partitionBy("variant"))).where("a < fp")
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= RADIUS).select("a", F.col("fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the least node reachable.

    Few edges are joined in one place, since each round costs the driver some twenty stages.
    Of more, large-star and small-star rounds alternate until the edges no longer change;
    the rounds grow as the logarithm of the nodes.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    if edges.count() <= GATHERED:
        return _gathered(edges)
    told = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = durable(_stars(both, keep=F.col("v") > F.col("u")))
        small = durable(_stars(large, keep=F.lit(True), centre=True))
        forget(large)
        seen = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        forget(edges)
        edges = small
        if seen == told:
            break
        told = seen
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _gathered(edges: DataFrame) -> DataFrame:
    """What `components` returns, of at most GATHERED edges (u, v)."""
    got = edges.toArrow()
    names, at = np.unique(np.concatenate([got.column(i).to_numpy() for i in range(2)]), return_inverse=True)
    root = list(range(len(names)))  # names ascend, so the least place is the least name

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in at.reshape(2, -1).T.tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    roots = names[np.array([find(x) for x in range(len(names))], np.int64)]
    return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(names, pa.int64()), "root": pa.array(roots, pa.int64())}))


def _stars(edges: DataFrame, keep, centre: bool = False) -> DataFrame:
    """Links the neighbours v of each u that `keep` holds for to the least of v and u; with `centre` also u itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))  # summed up before the shuffle, so a hub costs a row a task
    linked = edges.join(least, "u").withColumn("m", F.least("m", "u"))
    out = linked.where(keep & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if centre:
        out = out.unionByName(linked.where("u != m").select("u", F.col("m").alias("v")))
    return out.distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of `docs`."""
    hashed = durable(fingerprints(docs, words))
    classes = durable(hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    member = components(close_stars(classes.select("fp")))
    merged = member.join(classes, F.col("node") == F.col("fp")).select("fp", "root", "least_id")
    ids = merged.groupBy("root").agg(F.min("least_id").alias("root_id"))
    linked = merged.join(ids, "root").select("fp", "root_id")
    labels = durable(classes.join(linked, "fp", "left").select("fp", F.coalesce("root_id", "least_id").alias("component_id")))
    return hashed.join(labels, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """Distinct hashes of the word shingles of a whole text (fewer words: of all of them; none: empty)."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    last = ends[min(words, len(parts)) - 1 :]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n))


def long_print(hashes: np.ndarray) -> bytes:
    """SimHash of LONG bits of a set of hashes that is not empty."""
    ones = np.zeros(LONG, np.int64)
    for k in range(0, len(hashes), 255):  # so many rows sum up in a byte
        x = hashes[k : k + 255, None] + np.arange(1, LONG // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def left_one_out(hashes: np.ndarray) -> np.ndarray:
    """The sum of a set of at most TINY hashes, then the sums without one of them: what the ball of a set so small consists of. Of larger sets nothing."""
    return np.concatenate([[hashes.sum()], hashes.sum() - hashes]).astype(np.int64) if 0 < len(hashes) <= TINY else np.zeros(0, np.int64)


def text_classes(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row for each distinct text: id, digest (128 bits), unnamed and doc_id (of its first row), n (shingles), print (LONG bits) and sums (of small sets).

    The first row has the least doc_id; rows without one come last. A text without words has an empty print.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            sets = [shingle_hashes(text, words) for text in texts_of(batch)]
            prints = [long_print(own) if len(own) else b"" for own in sets]
            columns = [pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.binary()), pa.array(map(left_one_out, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "digest", "n", "print", "sums"])

    bounded_batches(docs.sparkSession)
    hashed = _texts(docs).mapInArrow(run, "doc_id long, digest string, n long, print binary, sums array<long>")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("first")
    grouped = hashed.groupBy("digest").agg(first, *[F.any_value(c).alias(c) for c in ("n", "print", "sums")])
    return durable(grouped.select(F.monotonically_increasing_id().alias("id"), "digest", "first.unnamed", "first.doc_id", "n", "print", "sums"))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.encode(text, "UTF-8")).alias("digest"), text.alias("text"))


def missed(tables: int, exact: int, similarity: float) -> float:
    """The chance that a pair of the similarity lies within no ball of so many tables: sums over how many of the LONG bits differ."""
    flips = math.acos(2 * similarity / (1 + similarity)) / math.pi
    d = np.arange(LONG + 1)
    logs = np.concatenate([[0], np.cumsum(np.log(np.arange(1, LONG + 1)))])
    chance = np.exp(logs[LONG] - logs - logs[::-1] + d * np.log(flips) + (LONG - d) * np.log1p(-flips))
    p, q = d / LONG, 1 - d / LONG
    found = q**exact * sum(math.comb(BALL, k) * p**k * q ** (BALL - k) for k in range(RADIUS + 1))
    return float((chance * (1 - found) ** tables).sum())


def table_bits(classes: int, similarity: float) -> np.ndarray:
    """Which bits of the long print make each table's fingerprint: first its exact part, which grows with the classes, then BALL bits.

    So many tables that a pair of the similarity is missed by all with a chance of MISSED at most.
    """
    exact = max(2, max(classes, 1).bit_length() - CELL)
    tables = next(t for t in itertools.count(8, 4) if missed(t, exact, similarity) <= MISSED)
    rng, each = np.random.default_rng(SEED), LONG // (exact + BALL)
    return np.concatenate([rng.permutation(LONG)[: each * (exact + BALL)].reshape(each, -1) for _ in range(-(-tables // each))])[:tables]


def table_prints(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """cell (table and exact part), ball (BALL bits), id and value of every row (id, print, value) and every table."""
    exact = bits.shape[1] - BALL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.int64(1) << np.arange(bits.shape[1], dtype=np.int64)
        first = np.arange(len(bits), dtype=np.int64) << exact
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                long = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, LONG // 8), axis=1)
                found = long[:, bits] @ powers
                cell, ball = first + (found & (1 << exact) - 1), found >> exact
                own, value = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), len(bits)) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().astype(np.int32)), pa.array(ball.ravel().astype(np.int32)), pa.array(own), pa.array(value)], names=["cell", "ball", "id", "value"])

    return rows.select("id", "print", "value").mapInArrow(run, "cell int, ball int, id long, value long")


def balls(prints: DataFrame, meet: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
    """What `meet` makes of the rows of `prints` that meet, each within half the radius of a variant.

    Rows are dealt by cell, and only then does each emit the BALL + 1 fingerprints within half
    the radius, so that a cell's variants are all in one place and none is shuffled. `meet`
    gets the number of the variant, the id and the value of rows ordered by variant, of
    variants with two rows or more.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def variants(cell, ball, own, value):
        near = np.concatenate([[0], np.int64(1) << np.arange(BALL, dtype=np.int64)])
        key = ((cell << BALL)[:, None] | (ball[:, None] ^ near)).ravel()
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        held = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        row = order[held] // (BALL + 1)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in meet(np.unique(key[held], return_inverse=True)[1], own[row], value[row])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for batch in batches:
            kept.append([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            rows += batch.num_rows
            if kept[0][0][0] != kept[-1][0][-1] and rows >= 4096:  # all cells but the last are whole
                whole = [np.concatenate(c) for c in zip(*kept)]
                end = np.searchsorted(whole[0], whole[0][-1])
                yield variants(*[c[:end] for c in whole])
                kept, rows = [[c[end:] for c in whole]], rows - end
        if rows:
            yield variants(*[np.concatenate(c) for c in zip(*kept)])

    return durable(prints.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema))


def from_hubs(variant: np.ndarray, own: np.ndarray, value: np.ndarray) -> tuple:
    """Pairs (a < b) of each variant's hub, the row of the largest value, with its other rows; and (a, a) for every row a of a variant with three rows or more."""
    order = np.lexsort((own, -value, variant))
    variant, own = variant[order], own[order]
    begin = np.flatnonzero(np.diff(variant, prepend=-1))
    size = np.diff(begin, append=len(own))
    hub = np.repeat(own[begin], size)
    pairs = np.stack([np.minimum(hub, own), np.maximum(hub, own)], axis=1)[hub != own]
    many = own[np.repeat(size, size) > 2]
    return tuple(np.unique(np.concatenate([pairs, np.stack([many, many], axis=1)]), axis=0).T)


def meetings(variant: np.ndarray, own: np.ndarray, value: np.ndarray) -> tuple:
    """Each row and how often it meets others."""
    size = np.bincount(variant)[variant] if len(variant) else variant
    ids, at = np.unique(own, return_inverse=True)
    return ids, np.bincount(at, size - 1, len(ids)).astype(np.int64)


def best_hubs(similarity: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple]:
    """For values that hold a row's weight and, in the low 24 bits, its size: each row's hub of the largest value among those whose size allows the similarity, with that value."""

    def meet(variant: np.ndarray, own: np.ndarray, value: np.ndarray) -> tuple:
        ids, first = np.unique(own, return_index=True)
        value_of = lambda rows: value[first][np.searchsorted(ids, rows)]
        a, b = (np.asarray(c, np.int64) for c in from_hubs(variant, own, value))
        a, b = a[a != b], b[a != b]
        swapped = value_of(a) >= value_of(b)  # then a is the hub; of equal values the lesser id
        row, hub = np.where(swapped, b, a), np.where(swapped, a, b)
        n, n_hub = (value_of(c) & (1 << 24) - 1 for c in (row, hub))
        sized = np.minimum(n, n_hub) >= similarity * np.maximum(n, n_hub)
        row, hub = row[sized], hub[sized]
        order = np.lexsort((hub, -value_of(hub), row))
        row, hub = row[order], hub[order]
        best = np.flatnonzero(np.diff(row, prepend=-1))
        return row[best], hub[best], value_of(hub[best])

    return meet


def between_roots(variant: np.ndarray, own: np.ndarray, value: np.ndarray) -> tuple:
    """For values that hold a row's root and, in the lowest bit, whether it is crowded: pairs (a < b) of rows of different roots that meet, of which one at least is not crowded; and `many` with (a, 1 if outside the largest group) for every crowded row that meets crowded ones of another root."""
    root, crowded = value >> 1, (value & 1).astype(bool)
    pairs = [np.zeros((0, 2), np.int64)]
    begin = np.flatnonzero(np.diff(variant, prepend=-1))
    size = np.diff(begin, append=len(variant))
    mixed = np.repeat(np.minimum.reduceat(root, begin) < np.maximum.reduceat(root, begin), size) if len(begin) else crowded
    light = np.flatnonzero(mixed & ~crowded)
    start, length = np.repeat(begin, size)[light], np.repeat(size, size)[light]
    for block in np.split(np.arange(len(light)), np.flatnonzero(np.diff(np.cumsum(length) >> 20)) + 1):  # a bounded block of pairs at a time
        each = length[block]
        x = np.repeat(light[block], each)
        y = np.repeat(start[block] - np.cumsum(each) + each, each) + np.arange(each.sum())
        x, y = x[root[x] != root[y]], y[root[x] != root[y]]
        pairs.append(np.unique(np.stack([np.minimum(own[x], own[y]), np.maximum(own[x], own[y])], axis=1), axis=0))
    pairs = np.unique(np.concatenate(pairs), axis=0)

    dense = np.flatnonzero(mixed & crowded)
    dense = dense[np.lexsort((root[dense], variant[dense]))]
    group = np.flatnonzero(np.diff(variant[dense], prepend=-1).astype(bool) | np.diff(root[dense], prepend=-1).astype(bool))
    count = np.diff(group, append=len(dense))
    of = variant[dense][group]
    order = np.lexsort((-count, of))  # the largest group of each variant first
    outside = np.ones(len(group), bool)
    outside[order[np.flatnonzero(np.diff(of[order], prepend=-1))]] = False
    several = np.isin(of, of[outside])
    ids, at = np.unique(own[dense][np.repeat(several, count)], return_inverse=True)
    out = np.zeros(len(ids), np.int64)
    np.maximum.at(out, at, np.repeat(outside, count)[np.repeat(several, count)].astype(np.int64))
    return np.repeat([False, True], [len(pairs), len(ids)]), np.concatenate([pairs[:, 0], ids]), np.concatenate([pairs[:, 1], out])


def likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose sizes allow the similarity, and whose long prints differ in no more bits than those of texts alike by 0.76 of it.

    At a similarity of 0.8 this is some eight deviations above the mean. Small sets, whose bits spread more, all stay.
    """
    most = LONG * math.acos(2 * (x := 0.76 * similarity) / (1 + x)) / math.pi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(-1, LONG // 64) for i in (2, 3))
            keep = (np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most) | (batch.column(4).to_numpy() <= 2 * TINY)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    a, b = (classes.select(F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("print").alias(f"print_{i}")) for i in "ab")
    sized = pairs.join(a, "a").join(b, "b").withColumn("n", F.least("n_a", "n_b")).where(F.col("n") >= similarity * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "print_a", "print_b", "n").mapInArrow(run, "a long, b long")


def wanted_texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id and text of each wanted class, read once more from the first row of the class."""
    named = durable(classes.join(wanted, "id", "left_semi").select("id", "digest", F.col("doc_id").alias("first_id")))
    few = named.count() <= SENT  # then the texts stay where they are
    there = _texts(docs).join(F.broadcast(named) if few else named, "digest").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    return durable(there.dropDuplicates(["id"]).select("id", "text"))


def alike(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of classes whose whole texts have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            keep, texts, others = [], texts_of(batch), texts_of(batch, "other")
            known = {t: shingle_hashes(t, words) for t in {*texts, *others}}
            for x, y in zip(map(known.__getitem__, texts), map(known.__getitem__, others)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = durable(likely(pairs, classes, similarity))
    there = wanted_texts(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), classes, docs)
    both = pairs.join(there.select(F.col("id").alias("a"), "text"), "a").join(there.select(F.col("id").alias("b"), F.col("text").alias("other")), "b")
    return durable(both.select("a", "b", "text", "other").mapInArrow(run, "a long, b long"))


def rare_pairs(held: DataFrame, classes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes that may have the similarity: all that have it, of different roots, at least one outside.

    `held`: id, root, outside. The shingles of these classes are put in one order, rare ones
    first. Of two sets with the similarity, each has a shingle both share among its first
    n - ceil(similarity * n) + 1, and behind the first such one at least as many shingles must
    be left as both have to share. So copies that strayed from a common text each in its own way,
    however many, meet on nothing, though each of them shares most with most others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            found = [shingle_hashes(t, words).astype(np.int64) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])

    texts = wanted_texts(held.select("id"), classes, docs)
    sets = durable(texts.select("id", "text").mapInArrow(run, "id long, shingles array<long>"))
    each = sets.select("id", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")  # what only one class has comes first, and meets nothing
    met = each.join(often, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("met"))
    alone = F.col("n") - F.size("met")
    reach = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-6) + 1
    first = met.join(sets.select("id", F.size("shingles").alias("n")), "id").join(held, "id")
    first = first.select("id", "n", "root", "outside", alone.alias("alone"), F.posexplode(F.slice("met", F.lit(1), F.greatest(reach - alone, F.lit(0)).cast("int"))).alias("nth", "at"))
    first = durable(first.select("id", "n", "root", "outside", (F.col("n") - F.col("alone") - F.col("nth")).alias("rest"), "at.shingle"))
    x = first.where("outside").select("shingle", F.col("id").alias("x"), F.col("n").alias("n_x"), F.col("root").alias("root_x"), F.col("rest").alias("rest_x"))
    enough = F.least("rest", "rest_x") >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("n_x")) - 1e-6
    found = x.join(first, (x["shingle"] == first["shingle"]) & (F.col("root") != F.col("root_x")) & enough)
    return durable(found.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct())


def similar_edges(docs: DataFrame, classes: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Verified links (a, b) between classes that connect these as all links would.

    Candidates come from SimHash by ball hashing, as in `near_duplicates`. Two bits of one
    fingerprint are too few for texts of this similarity, so there are as many tables of
    fingerprints as leave a pair of it the chance MISSED to be within RADIUS bits in none.
    Candidates whose long prints are too far apart are set aside; the rest are compared by
    their whole texts. First each row is held against one hub, of those that it meets in the
    first tables the row that meets the most others: among copies of one text, which may be
    far from each other, that is the text they are near to. Then come, from all tables, all
    pairs that this has left apart: as they are where one of the two rows meets few others, by
    their rare shingles where both meet many. Sets of at most TINY shingles, whose
    fingerprints are coarse, also meet by the ball of the set.
    """
    bits = table_bits(classes.count(), similarity)
    worded = classes.where("n > 0")
    weight = balls(table_prints(worded.withColumn("value", F.lit(0).cast("long")), bits[:WEIGHED]), meetings, "id long, meets long").groupBy("id").agg(F.sum("meets").alias("meets"))
    weighed = durable(worded.join(weight, "id", "left").select("id", "print", "n", F.coalesce("meets", F.lit(0)).alias("meets")))
    sized = weighed.where("meets > 0").withColumn("value", F.shiftleft("meets", 24) + F.least("n", F.lit((1 << 24) - 1)))
    hubs = balls(table_prints(sized, bits[:WEIGHED]), best_hubs(similarity), "id long, hub long, value long").groupBy("id").agg((-F.max(F.struct("value", (-F.col("hub")).alias("other")))["other"]).alias("hub"))
    sums = classes.select("id", F.posexplode("sums").alias("nth", "sum"))
    whole = sums.where("nth = 0").groupBy("sum").agg(F.min("id").alias("first"))
    small = sums.join(whole, "sum").where("id <> first").select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b"))
    tried = durable(hubs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).unionByName(small).distinct())
    stars = alike(tried, classes, docs, words, similarity)
    roots = components(stars).withColumnRenamed("node", "id")
    rest = durable(weighed.join(roots, "id", "left").select("id", "print", (F.shiftleft(F.coalesce("root", "id"), 1) + (F.col("meets") > APART).cast("long")).alias("value")))
    apart = balls(table_prints(rest, bits), between_roots, "many boolean, a long, b long")
    many = apart.where("many").groupBy(F.col("a").alias("id")).agg((F.max("b") == 1).alias("outside")).join(rest.select("id", F.shiftright("value", 1).alias("root")), "id")
    found = apart.where("not many").select("a", "b").unionByName(rare_pairs(many, classes, docs, words, similarity))
    return stars.unionByName(alike(found.distinct().join(tried, ["a", "b"], "left_anti"), classes, docs, words, similarity))


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, with all their columns, that stand for their group: texts linked by similarity.

    A group is represented by its least doc_id (a row without one only where the group has
    no other), of equal ids by the least digest. Of rows that repeat a doc_id and its text
    one stays, the one with the least hash of its columns. Rows that share a doc_id but not
    their text are judged each by its own. Null is the empty text; texts without words are
    like equal texts alone.
    """
    classes = text_classes(docs, words)
    roots = durable(components(similar_edges(docs, classes, words, similarity)).withColumnRenamed("node", "id"))
    first = F.min(F.struct("unnamed", "doc_id", "digest")).alias("first")
    stay = classes.join(roots, "id").groupBy("root").agg(first).select("first.*")
    stay = durable(stay.unionByName(classes.join(roots, "id", "left_anti").select("unnamed", "doc_id", "digest")))
    keys = {"digest": F.col("digest"), "unnamed": F.col("doc_id").isNull(), "number": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.md5(F.encode(text, "UTF-8")).alias("digest"), keys["unnamed"].alias("unnamed"), keys["number"].alias("number"))
    kept = rows.join(stay.select("digest", "unnamed", keys["number"].alias("number")), ["digest", "unnamed", "number"], "left_semi")
    order = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    return kept.groupBy("digest", "unnamed", "number").agg(F.min_by("row", order).alias("row")).select("row.*")
