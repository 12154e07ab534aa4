"""Scores and reports over recovered files, as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_first(files: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """The first file of each digest within its blob."""
    first = Window.partitionBy(key, digest).orderBy(order)
    return files.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def reindex(files: DataFrame, key: str, order: str) -> DataFrame:
    """`index` numbered anew from 0 within each blob; names keep their numbers."""
    return files.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("bigint") - 1)


def type_breakdown(files: DataFrame, key: str, kind: str, size: str) -> DataFrame:
    """Count and bytes of each type of a blob."""
    return files.groupBy(key, F.col(kind).alias("file_type")).agg(F.count("*").alias("count"), F.sum(size).alias("total_bytes"))


def salvage_rate(total: Column, size: Column) -> Column:
    """Recovered share in percent, at most 100, one decimal; 0 for an empty input."""
    return F.when(size > 0, F.round(F.least(F.lit(100.0), total / size * 100.0) * 10) / 10).otherwise(0.0)


def overall_confidence(confidence: str, size: str) -> Column:
    """Mean confidence weighted by size (plain if all are empty), three decimals; 0 without files."""
    total = F.sum(size)
    mean = F.when(total > 0, F.sum(F.col(confidence) * F.col(size)) / F.nullif(total, F.lit(0))).otherwise(F.avg(confidence))
    return F.coalesce(F.round(mean * 1000) / 1000, F.lit(0.0))


def report(blobs: DataFrame, files: DataFrame, key: str = "blob_id") -> DataFrame:
    """A row for every blob (key, archive_type, method, input_size, crc_errors, lzma_errors), with or without files."""
    by_type = files.groupBy(key, "file_type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum(F.col("confidence") * F.col("size")).alias("w"), F.sum("confidence").alias("c"))
    each = by_type.groupBy(key).agg(
        F.sum("n").alias("files_salvaged"), F.sum("bytes").alias("total_salvaged_bytes"),
        F.coalesce(F.round(F.when(F.sum("bytes") > 0, F.sum("w") / F.nullif(F.sum("bytes"), F.lit(0))).otherwise(F.sum("c") / F.sum("n")) * 1000) / 1000, F.lit(0.0)).alias("overall_confidence"),
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "file_type", F.col("n").alias("count"), F.col("bytes").alias("total_bytes")))).alias("types"))
    out = blobs.join(each, key, "left")
    stats = [c for c in ("resyncs", "tainted", "zeroed", "rejected") if c in blobs.columns]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return out.select(
        key, "archive_type", "method", "input_size", zero("files_salvaged"), zero("total_salvaged_bytes"), "crc_errors", "lzma_errors",
        (F.col("crc_errors") + F.col("lzma_errors")).alias("corruption_bypassed"),
        salvage_rate(F.coalesce("total_salvaged_bytes", F.lit(0)).cast("double"), F.col("input_size").cast("double")).alias("salvage_rate_percent"),
        F.coalesce("overall_confidence", F.lit(0.0)).alias("overall_confidence"),
        F.coalesce(F.transform("types", lambda t: F.struct(t["file_type"].alias("file_type"), t["count"].alias("count"), t["total_bytes"].alias("total_bytes"))), F.array().cast("array<struct<file_type:string,count:bigint,total_bytes:bigint>>")).alias("type_breakdown"),
        *stats,
    )


_FILE = "index bigint, name string, file_type string, extension string, offset bigint, size bigint, sha256 string, confidence double"


def with_files(reports: DataFrame, files: DataFrame, key: str = "blob_id") -> DataFrame:
    """Reports with all their fields: `files` in order, total_files_found, bytes_recovered, and crc_errors and lzma_errors by their names in texts.

    A blob's files (without their bytes) become one value, so this is for reports that are to be written out.
    """
    names = [f.split()[0] for f in _FILE.split(", ")]
    listed = files.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("files"))
    out = reports.join(listed, key, "left").withColumn("files", F.coalesce("files", F.array().cast("array<struct<" + ",".join(f.replace(" ", ":") for f in _FILE.split(", ")) + ">>")))
    out = out.withColumnsRenamed({"crc_errors": "crc_errors_ignored", "lzma_errors": "lzma_errors_bypassed"})
    return out.withColumn("total_files_found", F.col("files_salvaged")).withColumn("bytes_recovered", F.col("total_salvaged_bytes"))


def supplement(parsed: DataFrame, carved: DataFrame, key: str = "blob_id") -> DataFrame:
    """Parsed files, and carved ones at offsets where none was parsed."""
    return parsed.unionByName(carved.join(parsed.select(key, "offset").distinct(), [key, "offset"], "left_anti"))


def taint_intervals(ranges: DataFrame, key: str) -> DataFrame:
    """Half-open ranges (start, end) of each key, overlapping or touching ones merged."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = ranges.where("start < end").withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    grouped = marked.withColumn("g", F.sum("new").over(order))
    return grouped.groupBy(key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def taint_count(ranges: DataFrame, key: str) -> DataFrame:
    """Distinct tainted positions of each key."""
    return taint_intervals(ranges, key).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("tainted"))


def is_tainted(intervals: Column, position: Column, capacity: Column) -> Column:
    """Whether a position lies in one of a row's intervals; positions past the end count as tainted."""
    return (position >= capacity) | F.exists(intervals, lambda i: (position >= i["start"]) & (position < i["end"]))
