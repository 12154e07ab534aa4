"""Byte windows with overlap over large blobs, and joining of what they found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import cut
from .report import dedup_first

#: Fixed values. Window and overlap in bytes.
PRESETS = {"default": (64 << 20, 1 << 20), "low_memory": (16 << 20, 512 << 10), "high_performance": (256 << 20, 4 << 20)}


def window_starts(size: Column, window: int, overlap: int) -> Column:
    """Starts of windows; a new one begins while window - overlap bytes lie ahead. One window if all fits."""
    if not 0 <= overlap < window:
        raise ValueError("the overlap must be less than the window")
    step = window - overlap
    count = F.when(size <= window, 1).otherwise(F.ceil(size / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: i.cast("bigint") * step)


def windows(blobs: DataFrame, window: int, overlap: int, key: str = "blob_id") -> DataFrame:
    """key, window, start and the bytes of each window."""
    rows = blobs.select(key, "content", F.posexplode(window_starts(F.length("content"), window, overlap)).alias("window", "start"))
    return rows.select(key, "window", "start", cut(F.col("content"), F.col("start"), F.lit(window)).alias("content"))


def joined(files: DataFrame, key: str = "blob_id") -> DataFrame:
    """Files of windows at their places in the blob, the first of each digest."""
    placed = files.withColumn("offset", F.col("offset") + F.col("start"))
    return dedup_first(placed.withColumn("_order", F.struct("window", "index")), key, "sha256", "_order").drop("_order")
