"""Signature scan and carving, within each blob's row: no shuffle.

Offsets of matches are running sums of what a split leaves between them. The fold that
drops hits near a kept one, the filters and the region ends all work on the row's array
of hits; only finished files become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import BACK_UP, CONFIDENCE, DEDUP_GAP, LEAST_FILE, SIGNATURES
from ..functions import detect
from ..functions.binary import cut, find, latin1, let, number, rfind, running, starts, u8, u16, u32

PATTERN = "|".join("".join(f"\\x{b:02X}" for b in bytes.fromhex(h)) for h, _ in SIGNATURES)


def scan(data: Column) -> Column:
    """All signature hits as (offset, kind), leftmost and not overlapping."""
    kinds = F.create_map(*[F.lit(x) for h, t in SIGNATURES for x in (bytes.fromhex(h).decode("latin-1"), t)])

    def hits(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
        gaps = F.transform(F.split(text, PATTERN, -1), lambda p: F.length(p).cast("bigint"))
        return let(found, lambda m: F.zip_with(
            m, running(F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: g + F.length(x))),
            lambda x, end: F.struct((end - F.length(x)).alias("offset"), kinds[x].alias("kind"))))

    return F.when(F.length(data) > 0, let(latin1(data), hits)).otherwise(F.array().cast("array<struct<offset:bigint,kind:string>>"))


def adjust(hits: Column) -> Column:
    """Hits moved back to where their file begins, at 0 at least."""
    back = F.create_map(*[F.lit(x) for pair in BACK_UP.items() for x in pair])
    return F.transform(hits, lambda h: F.struct(F.greatest(h["offset"] - F.coalesce(F.try_element_at(back, h["kind"]), F.lit(0)), F.lit(0).cast("bigint")).alias("offset"), h["kind"].alias("kind")))


def keep_apart(hits: Column, block: int = 512) -> Column:
    """Keeps a hit if it lies more than DEDUP_GAP after the last one kept: a fold, as the last kept one decides.

    It goes by blocks, so that growing the list of kept hits costs no more than a block each time.
    """
    none, last = F.array().cast("array<struct<offset:bigint,kind:string>>"), F.lit(-1 - DEDUP_GAP).cast("bigint")

    def one(state: Column, h: Column) -> Column:
        stays = h["offset"] > state["last"] + DEDUP_GAP
        grown = F.concat(state["kept"], F.array(F.struct(h["offset"].alias("offset"), h["kind"].alias("kind"))))
        return F.struct(F.when(stays, h["offset"]).otherwise(state["last"]).alias("last"), F.when(stays, grown).otherwise(state["kept"]).alias("kept"))

    def several(state: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(state["last"].alias("last"), none.alias("kept")), one)
        return let(done, lambda d: F.struct(d["last"].alias("last"), F.concat(state["parts"], F.array(d["kept"])).alias("parts")))

    def fold(all_hits: Column) -> Column:
        count = F.greatest(F.lit(0), F.floor((F.size(all_hits) - 1) / block).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(all_hits, b * block + 1, F.lit(block)))
        start = F.struct(last.alias("last"), F.array().cast("array<array<struct<offset:bigint,kind:string>>>").alias("parts"))
        return F.flatten(F.aggregate(blocks, start, several, lambda s: s["parts"]))

    return let(hits, fold)


def plausible(data: Column, kind: Column, offset: Column) -> Column:
    """Whether a hit of a weak signature looks like a file of its type."""
    left = F.length(data) - offset
    declared = u32(data, offset + 2)
    bmp = (left >= 6) & (declared >= 14) & (declared <= left + 1024)
    images, at = u16(data, offset + 4), u32(data, offset + 18)
    ico = (left >= 22) & images.between(1, 256) & (u8(data, offset + 9) == 0) & (at >= 6 + 16 * images) & (at < left)
    mp3 = (left >= 128) | (u8(data, offset) == 0x49)
    return F.coalesce(F.when(kind == "bmp", bmp).when(kind == "ico", ico).when(kind == "mp3", mp3).otherwise(True), F.lit(False))


def regions(hits: Column, size: Column) -> Column:
    """(offset, kind, size) of each hit up to the next, without those under LEAST_FILE bytes."""
    ends = F.concat(F.slice(F.transform(hits, lambda h: h["offset"]), F.lit(2), F.greatest(F.size(hits), F.lit(1))), F.array(size.cast("bigint")))
    made = F.zip_with(hits, F.slice(ends, F.lit(1), F.size(hits)), lambda h, e: F.struct(h["offset"].alias("offset"), h["kind"].alias("kind"), (e - h["offset"]).alias("size")))
    return F.filter(made, lambda r: r["size"] >= LEAST_FILE)


def refined_size(data: Column, kind: Column) -> Column:
    """Size of a carved region after its end mark or declared size is heeded."""
    n = F.length(data)
    ended = lambda at, more: F.when(at.isNotNull(), F.least(at + more, n)).otherwise(n)
    declared = u32(data, 2)
    riff = number(data, 4, 4) + 8
    eocd = rfind(data, "504B0506")
    return (
        F.when(kind == "jpeg", ended(find(data, "FFD9"), 2))
        .when(kind == "png", ended(find(data, b"IEND".hex()), 8))
        .when(kind == "pdf", ended(rfind(data, b"%%EOF".hex()), 6))
        .when(kind == "gif", ended(rfind(data, "3B"), 1))
        .when(kind == "bmp", F.when((n >= 6) & (declared >= 14) & (declared <= n), declared).otherwise(n))
        .when(kind.isin("wav", "avi", "webp"), F.when((n >= 12) & starts(data, "52494646") & (riff >= 12) & (riff <= n), riff).otherwise(n))
        .when(kind == "zip", F.when(eocd + 22 <= n, F.least(eocd + 22 + u16(data, eocd + 20), n)).otherwise(n))
        .otherwise(n)
        .cast("bigint")
    )


def carve(blobs: DataFrame, key: str = "blob_id", content: str = "content") -> DataFrame:
    """Files carved from each blob: key, index, name, kind, file_type, extension, offset, size, sha256, confidence, data.

    Null content counts as empty and yields nothing. Repeated keys are carved each.
    """
    data = F.col("content")
    rows = blobs.select(F.col(key).alias(key), F.coalesce(F.col(content), F.lit(b"")).alias("content"))
    rows = rows.withColumn("hits", keep_apart(adjust(scan(data))))
    rows = rows.withColumn("hits", F.filter("hits", lambda h: plausible(data, h["kind"], h["offset"])))
    rows = rows.select(key, "content", F.posexplode(regions(F.col("hits"), F.length(data))).alias("index", "r"))
    rows = rows.select(key, F.col("index").cast("bigint").alias("index"), F.col("r.kind").alias("kind"), F.col("r.offset").alias("offset"), F.col("r.size").alias("region"), cut(data, F.col("r.offset"), F.col("r.size")).alias("whole"))
    rows = rows.withColumn("size", refined_size(F.col("whole"), F.col("kind")))
    rows = rows.withColumn("data", cut(F.col("whole"), 0, F.col("size")))
    return rows.select(
        key, "index", F.format_string("carved_%04d.%s", "index", detect.type_extension(F.col("kind"))).alias("name"), "kind",
        detect.type_label(F.col("kind")).alias("file_type"), detect.type_extension(F.col("kind")).alias("extension"), "offset", "size",
        F.sha2("data", 256).alias("sha256"), F.when(F.col("size") < F.col("region"), CONFIDENCE["carved_trimmed"]).otherwise(CONFIDENCE["carved"]).alias("confidence"), "data",
    )


