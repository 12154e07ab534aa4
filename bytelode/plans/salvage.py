"""The whole recovery of blobs: detection, extraction, carving, scores, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detect
from ..operators import carve, extract, plugins, report, validate
from .shared import durable

_TOLD = ["crc_errors", "lzma_errors", "method", "resyncs", "tainted", "zeroed", "rejected"]


def candidates(rows: DataFrame, key: str, signatures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, tried): all files that any strategy of a blob led to, each with an id, its checks and its bytes; and what was tried.

    Blobs are decoded once, and files cut and checked once: both tables are durable.
    """
    tried = durable(extract.extract(rows, key))
    part = F.struct(F.col(key).alias("k"), "strategy", *_TOLD, "supplement")
    carved = carve.carve(tried.where("kind = 'carve'").select(part.alias("part"), F.col("data").alias("content")), "part", "content")
    carved = carved.select("part.*", F.lit(1).alias("late"), F.col("index").alias("seq"), "name", "file_type", "extension", "offset", "size", "sha256", "confidence", "data")
    data = F.col("data")
    whole = tried.where("kind = 'file'").select(
        F.col(key).alias("k"), "strategy", *_TOLD, "supplement", F.lit(0).alias("late"), "seq", "name", detect.type_label(detect.file_type(data)).alias("file_type"),
        F.when(F.col("name") == "decompressed.bin", "bin").otherwise(detect.entry_extension(F.col("name"), data)).alias("extension"),
        "offset", F.length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256"), "confidence", "data")
    files = whole.unionByName(carved)
    if signatures is not None:
        more = plugins.carve(rows.where("archive_type = 'unknown'"), signatures, key=key)
        zero = F.lit(0).cast("bigint")
        files = files.unionByName(more.select(
            F.col(key).alias("k"), F.lit(0).alias("strategy"), *[(F.lit("Raw Carve") if c == "method" else zero).alias(c) for c in _TOLD], F.lit(False).alias("supplement"),
            F.lit(2).alias("late"), F.col("index").alias("seq"), "name", "file_type", "extension", "offset", "size", "sha256", "confidence", "data"))
    files = files.withColumn("check", validate.result(F.col("extension"), data)).withColumn("confidence", validate.adjusted(F.col("confidence"), F.col("check.delta")))
    return durable(files.withColumn("id", F.monotonically_increasing_id())), tried


def recover(blobs: DataFrame, key: str = "blob_id", signatures: DataFrame | None = None, data: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, reports) of blobs (key, content).

    Files: key, index, name, file_type, extension, offset, size, sha256, confidence, valid, and with `data` their bytes.
    Signature carving is native and runs on what each strategy left to be carved. Which files
    stay is decided on their descriptions; bytes are joined to those that do.
    """
    rows = blobs.select(key, F.coalesce("content", F.lit(b"")).alias("content")).withColumn("archive_type", detect.archive_type(F.col("content")))
    found, tried = candidates(rows, key, signatures)
    files = found.drop("data")
    # The first strategy that led to a file; of a supplement, only what lies where nothing was parsed.
    files = files.join(files.groupBy("k").agg(F.min("strategy").alias("strategy")), ["k", "strategy"])
    extra = F.col("supplement") & (F.col("late") == 1)
    parsed = files.where("late = 0").select("k", "offset").distinct()
    files = files.where(~extra).unionByName(files.where(extra).join(parsed, ["k", "offset"], "left_anti"))
    kinds = rows.select(F.col(key).alias("k"), "archive_type", F.length("content").cast("bigint").alias("input_size"))
    files = files.join(kinds.select("k", "archive_type"), "k").withColumn("order", F.struct("late", "seq"))
    nth = F.row_number().over(Window.partitionBy("k", "sha256").orderBy("order"))
    files = files.withColumn("nth", nth).where("archive_type <> 'unknown' or nth = 1").drop("nth")
    files = durable(report.reindex(files, "k", "order"))
    methods = tried.groupBy(key).agg(F.min_by(F.struct(*_TOLD), "strategy").alias("first"))
    used = files.groupBy(F.col("k").alias(key)).agg(F.any_value(F.struct(*_TOLD)).alias("used"))
    told = kinds.withColumnRenamed("k", key).join(methods, key, "left").join(used, key, "left").select(
        key, "archive_type", F.coalesce("used.method", "first.method").alias("method"), "input_size",
        *[F.coalesce(f"used.{c}", f"first.{c}", F.lit(0)).cast("bigint").alias(c) for c in _TOLD if c != "method"])
    out = files.select(F.col("k").alias(key), "index", "name", "file_type", "extension", "offset", "size", "sha256", "confidence", F.col("check.valid").alias("valid"), "id")
    reports = report.report(told, out.drop("valid", "id"), key)
    if data:
        return out.join(found.select("id", "data"), "id").drop("id"), reports
    return out.drop("id"), reports
