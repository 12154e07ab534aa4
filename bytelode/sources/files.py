"""Sources and sinks: files as blobs, large files as chunks, recovered files as files, ZIP and JSON."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def blobs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """blob_id, path, length and content of each file; a directory gives its files, not those below."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return raw.select(F.col("path").alias("blob_id"), "path", "length", "content")


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of files that arrive in a directory."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return raw.select(F.col("path").alias("blob_id"), "path", "length", "content", "modificationTime")


class _Chunk(InputPartition):
    def __init__(self, path: str, start: int, size: int) -> None:
        self.path, self.start, self.size = path, start, size


class _Reader(DataSourceReader):
    def __init__(self, path: str, window: int, overlap: int) -> None:
        self.path, self.window, self.overlap = path, window, overlap

    def partitions(self) -> list[InputPartition]:
        size, step = os.path.getsize(self.path), self.window - self.overlap
        if size <= self.window:
            return [_Chunk(self.path, 0, size)]
        return [_Chunk(self.path, at, self.window) for at in range(0, size, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.size)
        if data:
            yield (partition.path, partition.start // (self.window - self.overlap), partition.start, data)


class ChunkSource(DataSource):
    """Overlapping windows of one file on storage that all executors mount; a window is a task. Options: path, window, overlap."""

    @classmethod
    def name(cls) -> str:
        return "bytelode_chunks"

    def schema(self) -> str:
        return "blob_id string, window int, start bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        window, overlap = int(self.options.get("window", 64 << 20)), int(self.options.get("overlap", 1 << 20))
        if not 0 <= overlap < window:
            raise ValueError("the overlap must be less than the window")
        return _Reader(self.options["path"], window, overlap)


def chunks(spark: SparkSession, path: str, window: int = 64 << 20, overlap: int = 1 << 20) -> DataFrame:
    spark.dataSource.register(ChunkSource)
    return spark.read.format("bytelode_chunks").options(path=path, window=str(window), overlap=str(overlap)).load()


def output_name(prefix: str, index: Column, label: Column, extension: Column) -> Column:
    """{prefix}salvaged_{index:04}_{label}.{ext}, blanks as underscores."""
    return F.concat(F.lit(prefix), F.format_string("salvaged_%04d_%s.%s", index, F.replace(label, F.lit(" "), F.lit("_")), extension))


def write_files(files: DataFrame, directory: str, prefix: str = "", key: str = "blob_id") -> None:
    """Writes each file's data into a directory that all executors mount, a folder for each blob."""
    named = files.select(F.sha2(F.col(key).cast("string"), 256).substr(1, 16).alias("blob"), output_name(prefix, F.col("index"), F.col("file_type"), F.col("extension")).alias("name"), "data")

    def put(rows) -> None:
        for r in rows:
            os.makedirs(f"{directory}/{r['blob']}", exist_ok=True)
            with open(f"{directory}/{r['blob']}/{os.path.basename(r['name'])}", "wb") as f:
                f.write(r["data"])

    named.foreachPartition(put)


def zipped(files: DataFrame, key: str = "blob_id") -> DataFrame:
    """key and a ZIP (stored) of each blob's files. Generated or empty names become salvaged_{index:04}.{ext}; of equal names later ones get their index."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out, seen = io.BytesIO(), set()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for r in pdf.sort_values("index").itertuples(index=False):
                base = os.path.basename(r.name or "")
                name = f"salvaged_{r.index:04d}.{r.extension}" if not base or base.startswith(("carved_", "decompressed")) else f"salvaged/{base}"
                name = name if name not in seen else f"salvaged/{r.index:04d}_{base}"
                seen.add(name)
                archive.writestr(name, bytes(r.data))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "zip": [out.getvalue()]})

    kept = files.select(key, "index", "name", "extension", "data")
    return kept.groupBy(key).applyInPandas(pack, f"{key} {kept.schema[0].dataType.simpleString()}, zip binary")


#: Fixed values. Keys of a report's JSON, in order, and of what a service adds.
KEYS = [
    "input_size", "archive_type", "method", "files_salvaged", "total_salvaged_bytes", "corruption_bypassed", "crc_errors_ignored", "lzma_errors_bypassed",
    "salvage_rate_percent", "overall_confidence", "salvage_time_secs", "type_breakdown", "files",
]
STATS = {"resync_count": "resyncs", "bytes_tainted": "tainted", "bytes_zeroed": "zeroed", "entropy_rejections": "rejected"}


def report_json(reports: DataFrame, key: str = "blob_id", seconds: Column | float = 0.0, url: Column | None = None) -> DataFrame:
    """key and `json` of reports with files (`report.with_files`): `input` and KEYS; with `url` also the decoder's stats and a download_url.

    A blob's share of a distributed job has no time of its own, so salvage_time_secs is what the caller gives.
    """
    rows = reports.withColumn("salvage_time_secs", seconds if isinstance(seconds, Column) else F.lit(float(seconds)))
    more = []
    if url is not None:
        more = [F.struct(*[F.col(c).alias(n) for n, c in STATS.items()]).alias("zombie_stats"), url.alias("download_url")]
    return rows.select(key, F.to_json(F.struct(F.col(key).cast("string").alias("input"), *KEYS, *more)).alias("json"))


def report_text(reports: DataFrame, key: str = "blob_id") -> DataFrame:
    """key and a few lines of text about each report."""
    types = F.array_join(F.transform("type_breakdown", lambda t: F.format_string("  %s: %d files, %d bytes", t["file_type"], t["count"], t["total_bytes"])), "\n")
    head = F.format_string("%s: %s, %d bytes, by %s\n%d files, %d bytes, %.1f%% of the input, confidence %.3f, %d errors passed over\n",
                           F.col(key).cast("string"), "archive_type", "input_size", "method", "files_salvaged", "total_salvaged_bytes", "salvage_rate_percent", "overall_confidence", "corruption_bypassed")
    return reports.select(key, F.concat(head, types).alias("text"))


def as_json(reports: DataFrame) -> DataFrame:
    """Each report as a JSON text."""
    return reports.select(F.to_json(F.struct(*reports.columns)).alias("json"))
