"""Operator 4: document fingerprints by a homomorphic multiset hash, in DataFrame functions alone.

A fingerprint is a wide vector that adds up over a document's paragraphs:

* `WIDE` lanes of 32 bits get a hash of each whole paragraph, modulo 2^32. Equal
  multisets of paragraphs have equal sums in any order; others differ but for chance.
* `LEVELS` x `LANES` cells of 16 bits get, modulo 2^16, a hash of each pair of words
  that follow each other in a paragraph; any white space parts words, and the last word
  makes a pair with nothing. A pair belongs to one lane by its hash and to level k
  with chance 8^-k. Where few pairs differ between two documents, few cells of a level
  do, so the number of differing pairs can be read from the level that is not full.
* one lane counts the pairs.

Sums of vectors are fingerprints of joined documents: `combine` inserts paragraphs and
`remove` deletes them without the text. Likeness is an estimate of the multiset Jaccard
similarity of two documents' word pairs, from their fingerprints alone.

Documents and their neighbours meet by one shuffle over ranges of doc_id; the ranges are
at most `RANGES`, so the table of their ends that goes to all tasks is bounded. They hold
about equally many ids, whatever lies between these: their ends are ids picked by a hash.

Defined results: null text is empty text; two texts without words are alike (1). Rows
that share a doc_id follow each other in the order of their texts' hashes; a null
doc_id comes after all others. A single row's next document is itself. Other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import let

WIDE = 8
LANES = 32
#: The last level is read up to 109 x 8^8 differing pairs, more than the words a row of 2 GB can hold.
LEVELS = 9
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
RANGES = 65_536
ROWS_A_RANGE = 512
#: So many picked ids make up a range.
PICKED = 8


def units(text: Column) -> Column:
    """Hashes of a text's word pairs (even) and of its whole paragraphs (odd)."""

    def of(paragraph: Column) -> Column:
        words = F.filter(F.split(paragraph, SPACE), lambda w: w != "")
        pairs = let(words, lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b).bitwiseAND(F.lit(-2))))
        return F.concat(F.array(F.xxhash64(paragraph).bitwiseOR(F.lit(1))), pairs)

    return F.flatten(F.transform(F.filter(F.split(text, "\n"), lambda p: p != ""), of))


def _hex(column: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(column.bitwiseAND(F.lit(16**digits - 1))), digits, "0"))


def summed(each: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and `fingerprint` of each group of units `u` (null: none).

    A group is summed by lane first, so that a unit updates a few sums instead of one
    for every cell; then its at most LANES rows are put side by side.
    """
    u, paragraph = F.col("u"), F.col("u").bitwiseAND(F.lit(1)) == 1
    depth, value = F.shiftrightunsigned(u, 8), F.shiftrightunsigned(u, 40).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(1))
    wide = [F.sum(F.when(paragraph, F.xxhash64(u, F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF)))).alias(f"w{k}") for k in range(WIDE)]
    pairs = F.count(F.when(~paragraph, 1)).alias("pairs")
    cells = [F.sum(F.when(~paragraph & (depth.bitwiseAND(F.lit(8**k - 1)) == 0), value)).alias(f"c{k}") for k in range(LEVELS)]
    lane = F.shiftrightunsigned(u, 1).bitwiseAND(F.lit(LANES - 1))
    by_lane = each.groupBy(*keys, lane.alias("lane")).agg(*wide, pairs, *cells)
    cell = F.concat(*[_hex(F.coalesce(F.col(f"c{k}"), F.lit(0)), 4) for k in range(LEVELS)])
    whole = by_lane.groupBy(*keys).agg(
        *[F.sum(f"w{k}").alias(f"w{k}") for k in range(WIDE)], F.sum("pairs").alias("pairs"),
        F.map_from_entries(F.collect_list(F.when(F.col("lane").isNotNull(), F.struct("lane", cell.alias("cell"))))).alias("cells"))
    lanes = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit("0" * 4 * LEVELS)))
    head = [_hex(F.coalesce(F.col(c), F.lit(0)), 8) for c in [*(f"w{k}" for k in range(WIDE)), "pairs"]]
    return whole.select(*keys, F.concat(*head, F.array_join(lanes, "")).alias("fingerprint"))


def _numbers(print_: Column) -> Column:
    """All numbers of a fingerprint as longs."""
    widths = [8] * (WIDE + 1) + [4] * (LANES * LEVELS)
    starts = [1 + sum(widths[:i]) for i in range(len(widths))]
    return F.array(*[F.conv(F.substring(print_, s, w), 16, 10).cast("long") for s, w in zip(starts, widths)])


def _joined(a: Column, b: Column, sign: int) -> Column:
    sums = F.zip_with(_numbers(a), _numbers(b), lambda x, y: x + sign * y)
    return F.array_join(F.transform(sums, lambda x, i: F.when(i <= WIDE, _hex(x, 8)).otherwise(_hex(x, 4))), "")


def combine(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return _joined(a, b, 1)


def remove(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs without b's."""
    return _joined(a, b, -1)


def likeness(a: Column, b: Column) -> Column:
    """Estimated multiset Jaccard similarity of the word pairs behind two fingerprints; 1 if these are equal."""
    at = 1 + 8 * (WIDE + 1)  # then LANES cells of LEVELS numbers
    counts = [F.conv(F.substring(x, 1 + 8 * WIDE, 8), 16, 10).cast("double") for x in (a, b)]
    total = counts[0] + counts[1]
    cells = F.sequence(F.lit(0), F.lit(LANES - 1))

    def differing(level: int) -> Column:
        """How many cells of the level differ."""
        differs = F.transform(cells, lambda i: (F.substr(a, F.lit(at + 4 * level) + 4 * LEVELS * i, F.lit(4)) != F.substr(b, F.lit(at + 4 * level) + 4 * LEVELS * i, F.lit(4))).cast("int"))
        return F.aggregate(differs, F.lit(0), lambda s, x: s + x)

    def number(differing: Column, level: int) -> Column:
        """Differing pairs, from the share of differing cells."""
        share = F.least(differing, F.lit(LANES - 1)) / F.lit(float(LANES))
        return F.log(1 - share) / F.log(F.lit(1 - 1 / LANES)) * (8**level)

    full = 0.87 * LANES
    counted = [differing(k) for k in range(LEVELS)]
    estimate = reduce(lambda rest, k: let(counted[k], lambda d: F.when(d <= full, number(d, k)).otherwise(rest)), range(LEVELS - 2, -1, -1), number(counted[LEVELS - 1], LEVELS - 1))
    bounded = F.greatest(F.least(estimate, total), F.abs(counts[0] - counts[1]))
    return F.when(a == b, 1.0).otherwise(let(bounded, lambda d: F.when(total > 0, (total - d) / (total + d)).otherwise(1.0)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` rows (doc_id, text) with the fingerprint of each; a general form without neighbours."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return summed(rows.select("row", "doc_id", F.explode_outer(units(F.col("text"))).alias("u")), ["row", "doc_id"]).select("doc_id", "fingerprint")


def range_ends(docs: DataFrame) -> list[int]:
    """Fewer than RANGES doc_ids, ascending, that part the ids into ranges of about equally many."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    ranges = max(1, min(RANGES, n // ROWS_A_RANGE))
    if ranges == 1:
        return []
    # At most about RANGES x PICKED ids meet in one task, and one of PICKED comes here.
    picked = ids.where("doc_id is not null").where(F.expr(f"pmod(xxhash64(doc_id), {max(1, n // ranges // PICKED)}) = 0")).distinct()
    ends = picked.agg(F.filter(F.sort_array(F.collect_list("doc_id")), lambda x, i: i % PICKED == PICKED - 1).alias("ends")).first()["ends"]
    return list(ends)[: RANGES - 1]


def place_among(ends: list[int], value: Column) -> Column:
    """How many of the ascending ends are not above the value (null: 0), by halving."""
    if not ends:
        return F.lit(0).cast("long")
    listed = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(ends).bit_length() - 1, -1, -1)])
    further = lambda at, step: F.when(F.get(listed, at + step - 1) <= value, at + step).otherwise(at)  # noqa: E731  beyond the list there is null
    return F.aggregate(steps, F.lit(0), further).cast("long")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """bucket, place (in descending doc_id), doc_id, text and the next document's text; guest rows close each bucket.

    A bucket is a range of doc_id. Its last row's next document is the greatest of the
    closest lower range that holds any (for the lowest range: of the highest), which is
    therefore sent to that bucket too, as a guest.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", place_among(range_ends(docs), F.col("doc_id")))
    # At most RANGES rows.
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    told = [(tops[i]["top"], tops[(i + 1) % len(tops)]["bucket"]) for i in range(len(tops))]
    guests = docs.sparkSession.createDataFrame(told, "top long, to long")
    rows = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("top")), "left")
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("to").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("guest"))))).alias("at"))
    rows = rows.select("at.bucket", "at.guest", "doc_id", "text", F.xxhash64("text").alias("tie"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "tie")
    return rows.select("bucket", "guest", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    rows = with_neighbours(docs)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left("next", cut))
    rows = rows.withColumn("edited", F.when(~F.col("guest"), edited))
    both = F.when(F.col("guest"), F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t"))))
    rows = rows.select("bucket", "guest", "place", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), F.explode(both).alias("b"))
    keys = ["bucket", "place", "side", "guest", "doc_id", "n_chars", "edited_sha256"]
    each = rows.select("bucket", "place", "b.side", "guest", "doc_id", "n_chars", "edited_sha256", F.explode_outer(units(F.col("b.t"))).alias("u"))
    prints = summed(each, keys)
    order = Window.partitionBy("bucket").orderBy("place", "side")
    prints = prints.select(*keys, "fingerprint", F.lead("fingerprint", 1).over(order).alias("edited_fingerprint"), F.lead("fingerprint", 2).over(order).alias("next_fingerprint"))
    return prints.where("side = 0 and not guest").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
