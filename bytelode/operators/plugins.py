"""User-defined signatures: validation of their fields, and carving by them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import CONFIDENCE, LEAST_FILE

SCHEMA = "name string, extension string, magic string, offset bigint, max_size bigint, end_marker string, mime_type string, description string"
MAX_SIZE = 50 << 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """Signatures of plugin files (JSON with an array `signatures`), with defaults for what is absent."""
    raw = spark.read.schema(f"name string, version string, author string, signatures array<struct<{', '.join(f.replace(' ', ':', 1) for f in SCHEMA.split(', '))}>>").json(path, multiLine=True)
    return defaults(raw.select(F.explode("signatures").alias("s")).select("s.*"))


def parse(texts: DataFrame, column: str = "json") -> DataFrame:
    """The same from a column of JSON texts."""
    kind = f"struct<signatures:array<struct<{','.join(f.replace(' ', ':', 1) for f in SCHEMA.split(', '))}>>>"
    return defaults(texts.select(F.explode(F.from_json(column, kind)["signatures"]).alias("s")).select("s.*"))


def defaults(signatures: DataFrame) -> DataFrame:
    return signatures.withColumns({"offset": F.coalesce("offset", F.lit(0)).cast("bigint"), "max_size": F.coalesce("max_size", F.lit(MAX_SIZE)).cast("bigint")})


def hex_bytes(text: Column) -> Column:
    """Bytes of trimmed hex pairs; null if the digits are odd in number or not hex."""
    t = F.trim(text)
    return F.when((F.length(t) % 2 == 0) & F.rlike(t, F.lit("^[0-9A-Fa-f]*$")), F.unhex(t))


def error(name: Column, extension: Column, magic: Column, end_marker: Column) -> Column:
    """What is wrong with a signature, or null."""
    bytes_ = hex_bytes(magic)
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "empty name")
        .when(bytes_.isNull(), "invalid magic")
        .when(F.length(bytes_) == 0, "empty magic")
        .when(F.length(bytes_) > 32, "magic too long")
        .when(~F.coalesce(F.octet_length(extension), F.lit(0)).between(1, 10), "invalid extension")
        .when(end_marker.isNotNull() & hex_bytes(end_marker).isNull(), "invalid end marker")
    )


def template() -> list[dict]:
    """Two sample signatures."""
    return [
        {"name": "Lab Trace", "extension": "trc", "magic": "4C414254", "offset": 0, "max_size": MAX_SIZE, "description": "trace of a measurement"},
        {"name": "Sample", "extension": "smp", "magic": "DEADBEEF", "offset": 0, "max_size": 1 << 20, "end_marker": "CAFEBABE"},
    ]


def merged(*registries: DataFrame) -> DataFrame:
    out = registries[0]
    for r in registries[1:]:
        out = out.unionByName(r)
    return out


def carve(blobs: DataFrame, signatures: DataFrame, first_number: int = 0, key: str = "blob_id") -> DataFrame:
    """Files at each signature's hits: up to max_size, cut after the first end marker; under LEAST_FILE bytes none.

    Signatures are a bounded configuration, so they are collected. A hit begins where no
    earlier hit of any signature overlaps it, the earliest end first.
    """
    known = sorted(
        ((bytes(r["m"]), r["offset"], r["max_size"], bytes(r["e"]) if r["e"] is not None else b"", r["name"], r["extension"]) for r in signatures.select(hex_bytes(F.col("magic")).alias("m"), "offset", "max_size", hex_bytes(F.col("end_marker")).alias("e"), "name", "extension").where("m is not null").collect()),
    )

    def hits(data: bytes) -> list[tuple[int, int]]:
        at, found, ahead = 0, [], {i: data.find(s[0]) for i, s in enumerate(known)}
        while True:
            for i, p in ahead.items():
                if 0 <= p < at:
                    ahead[i] = data.find(known[i][0], at)
            some = [(p + len(known[i][0]), -len(known[i][0]), i) for i, p in ahead.items() if p >= 0]
            if not some:
                break
            end, _, i = min(some)
            found.append((max(0, end - len(known[i][0]) - known[i][1]), i))
            at = end
        found.sort()
        return [h for k, h in enumerate(found) if k == 0 or h[0] != found[k - 1][0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for owner, raw in enumerate(batch.column(1).to_pylist()):
                data, n = raw or b"", first_number
                for start, i in hits(data):
                    _, _, most, mark, name, extension = known[i]
                    end = min(start + most, len(data))
                    p = data.find(mark, start, end) if mark else -1
                    confidence = CONFIDENCE["plugin"]
                    if p >= 0:
                        end, confidence = p + len(mark), CONFIDENCE["plugin_ended"]
                    if end - start >= LEAST_FILE:
                        rows.append((owner, n, f"{name}_{n:04d}.{extension}", name, extension, start, end - start, confidence, data[start:end]))
                        n += 1
            columns = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]], names=[key, "index", "name", "file_type", "extension", "offset", "size", "confidence", "data"])

    kept = blobs.select(key, "content")
    return kept.mapInArrow(run, f"{key} {kept.schema[0].dataType.simpleString()}, index bigint, name string, file_type string, extension string, offset bigint, size bigint, confidence double, data binary").withColumn("sha256", F.sha2("data", 256))
