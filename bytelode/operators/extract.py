"""Container and compression decoders: Arrow-batched table functions over blobs.

One blob gives rows of two kinds. A `file` row is a recovered file. A `carve` row holds
bytes that signature carving is to search. Rows carry a strategy number; the plan keeps,
for each blob, the lowest strategy that led to any file. Damage in an entry costs that
entry; nothing raises. No decoder gives more than `dims.MOST_OUTPUT` bytes.
"""

from __future__ import annotations

import bz2
import io
import lzma
import math
import tarfile
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ..dims import CONFIDENCE, ENTROPY_HIGH, ENTROPY_LOW, LEAST_FILE, MOST_OUTPUT

SCHEMA = "strategy int, kind string, seq bigint, name string, offset bigint, confidence double, crc_errors bigint, lzma_errors bigint, method string, supplement boolean, data binary, resyncs bigint, tainted bigint, zeroed bigint, rejected bigint"
#: Fixed values. Chunked decoding of damaged LZMA.
CHUNK, MOST_CHUNKS, SLIDE, PROBE, LEAST_PROGRESS, HEADER = 32 << 10, 32, 64, 64, 16, 13
LZMA_MEMORY = 128 << 20
SCAN_OFFSETS = (0, 32, 34, 48, 64, 96, 128, 256)


class Row(NamedTuple):
    strategy: int
    kind: str
    seq: int
    name: str | None
    offset: int
    confidence: float
    crc_errors: int
    lzma_errors: int
    method: str
    supplement: bool
    data: bytes
    resyncs: int = 0
    tainted: int = 0
    zeroed: int = 0
    rejected: int = 0


def _carve(strategy: int, method: str, data: bytes, lzma_errors: int = 0, crc_errors: int = 0) -> Row:
    return Row(strategy, "carve", 0, None, 0, 0.0, crc_errors, lzma_errors, method, False, data)


_FAILURES = (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError, MemoryError)
_STEP = 1 << 16


def _fed(decoder: Any, part: bytes, room: int) -> bytes:
    """What a decoder gives for a part of its input, at most `room` bytes and about that much memory."""
    return decoder.decompress(part, room) if room > 0 else b""


def inflate(make: Callable[[], Any], data: bytes, most: int = MOST_OUTPUT) -> bytes:
    """All that a decompressor gives before it ends or fails, at most `most` bytes.

    Input goes in steps. If one fails, a new decoder takes the steps before it again, and the
    failing one byte by byte, so what precedes the damage still comes out.
    """
    out, size, decoder, at = [], 0, make(), 0
    try:
        for at in range(0, len(data), _STEP):
            if getattr(decoder, "eof", False) or size >= most:
                break
            out.append(_fed(decoder, data[at : at + _STEP], most - size))
            size += len(out[-1])
    except _FAILURES:
        decoder, out, size = make(), [], 0
        try:
            for k in range(0, at, _STEP):
                out.append(_fed(decoder, data[k : k + _STEP], most - size))
                size += len(out[-1])
            for k in range(at, min(at + _STEP, len(data))):
                out.append(_fed(decoder, data[k : k + 1], most - size))
                size += len(out[-1])
        except _FAILURES:
            pass
    return b"".join(out)


def tar_entries(data: bytes) -> list[tuple[str, bytes]]:
    """Regular files with content, up to the first damage of the headers."""
    out = []
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:", ignore_zeros=False) as archive:
            for member in archive:
                if not member.isreg():
                    continue
                start = member.offset_data
                part = data[start : start + min(member.size, MOST_OUTPUT)]
                if part:
                    out.append((member.name, part))
    except (tarfile.TarError, OSError, ValueError, EOFError):
        pass
    return out


def zip_rows(data: bytes) -> list[Row]:
    method = "ZIP Fail-Forward"
    try:
        entries = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, OSError, ValueError, EOFError, UnicodeDecodeError, NotImplementedError):
        return [_carve(0, "ZIP Raw Carve (bad directory)", data)]
    found, errors = [], 0
    for e in entries:
        head = data[e.header_offset : e.header_offset + 30]
        if len(head) < 30 or head[:4] != b"PK\x03\x04" or e.flag_bits & 1 or e.compress_type not in (0, 8, 12, 14):
            errors += 1
            continue
        if e.is_dir():
            continue
        start = e.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
        raw = data[start : start + e.compress_size]
        if e.compress_type == 0:
            content = raw[:MOST_OUTPUT]
        elif e.compress_type == 8:
            content = inflate(lambda: zlib.decompressobj(-15), raw)
        elif e.compress_type == 12:
            content = inflate(bz2.BZ2Decompressor, raw)
        else:
            content = b""
        whole = len(content) == e.file_size and zlib.crc32(content) == e.CRC
        if not whole and e.file_size <= MOST_OUTPUT:
            errors += 1
            if not content:
                continue
        found.append((e.filename, e.header_offset, content))
    if not found:
        return [_carve(0, "ZIP Raw Carve (fallback)", data, crc_errors=errors)] if len(data) > 100 else [_carve(9, method, b"", crc_errors=errors)]
    confidence = max(0.30, CONFIDENCE["zip"] - min(0.05 * errors, 0.25))
    return [Row(0, "file", i, name, offset, confidence, errors, 0, method, False, content) for i, (name, offset, content) in enumerate(found)]


def stream_rows(data: bytes, name: str, make: Callable[[], Any], whole: bool) -> list[Row]:
    """gzip, bzip2 and xz: a tar inside, else carving of what comes out, else (with `whole`) that as one file."""
    out = inflate(make, data)
    if not out:
        return [_carve(0, f"{name} Raw Carve (fallback)", data)]
    if len(out) >= MOST_OUTPUT:
        name = f"{name} (first {MOST_OUTPUT >> 20} MB)"
    if len(out) > 262 and out[257:262] == b"ustar":
        entries = tar_entries(out)
        if entries:
            return [Row(0, "file", i, n, 0, CONFIDENCE["tar"], 0, 0, f"{name} TAR", False, d) for i, (n, d) in enumerate(entries)]
    rows = [_carve(1, f"{name} Decompress Carve", out)]
    if whole:
        rows.append(Row(2, "file", 0, "decompressed.bin", 0, CONFIDENCE["blob"], 0, 0, f"{name} Decompress", False, out))
    return rows


def vint(data: bytes, at: int) -> tuple[int, int]:
    """Little-endian base-128 number and its length; stops at the end or after 63 bits."""
    value = shift = 0
    start = at
    while at < len(data) and shift < 63:
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 0x80:
            break
    return value, at - start


def rar5_header(block: bytes) -> tuple[str | None, int]:
    """Name and data size of a RAR 5 file header; the name is where mtime is always taken to be there."""
    at, fields = 0, []
    _, n = vint(block, at)
    at += n
    flags, n = vint(block, at)
    at += n
    size = 0
    if flags & 1:
        at += vint(block, at)[1]
    if flags & 2:
        size, n = vint(block, at)
        at += n
    for _ in range(3):  # file flags, unpacked size, attributes
        value, n = vint(block, at)
        fields.append(value)
        at += n
    if at + 4 <= len(block):
        at += 4
    for _ in range(2):  # compression, host
        at += vint(block, at)[1]
    length, n = vint(block, at)
    at += n
    name = None
    if len(block) >= 10 and 0 < length < 1024 and at + length <= len(block):
        try:
            name = block[at : at + length].decode("utf-8")
        except UnicodeDecodeError:
            name = None
    return name, size if len(block) >= 6 else 0


def rar4_name(data: bytes, at: int, size: int) -> str | None:
    if at + 32 > len(data) or size < 32:
        return None
    length = int.from_bytes(data[at + 26 : at + 28], "little")
    raw = data[at + 32 : at + 32 + length]
    if not 0 < length <= 1024 or len(raw) < length:
        return None
    name = raw.decode("utf-8", "replace")
    return name if all(c == "/" or not (ord(c) < 32 or 127 <= ord(c) < 160) for c in name) else None


def rar_rows(data: bytes) -> list[Row]:
    five = data[6:8] == b"\x01\x00"
    begin = 8 if five else 7
    method, score = f"RAR {'v5' if five else 'v4'} Parse + Raw Carve", CONFIDENCE["rar5" if five else "rar4"]
    found: list[Row] = []

    def keep(name: str | None, start: int, end: int) -> None:
        if end > start + LEAST_FILE:
            i = len(found)
            found.append(Row(0, "file", i, name or f"rar_file_{i:04d}", start, score, 0, 0, method, True, data[start:end]))

    at = begin
    while at + 7 < len(data):
        if five:
            if not any(data[at : at + 4]) and at > begin + 100:
                break
            size, n = vint(data, at + 4)
            start = at + 4 + n
            if not size or start + size > len(data):
                break
            block, after = data[start : start + size], start + size
            if len(block) >= 2 and block[0] & 0x0F == 2 and vint(block, 1)[0] & 2:
                name, declared = rar5_header(block)
                end = after + declared if declared and after + declared <= len(data) else min(after + (1 << 20), len(data))
                keep(name, after, end)
                after = end
            at = after
        else:
            flags, size = int.from_bytes(data[at + 3 : at + 5], "little"), int.from_bytes(data[at + 5 : at + 7], "little")
            if size < 7 or at + size > len(data):
                break
            more = int.from_bytes(data[at + 7 : at + 11], "little") if flags & 0x8000 and at + 11 < len(data) else 0
            if data[at + 2] == 0x74:
                end = min(at + size + more, len(data))
                keep(rar4_name(data, at, size), at + size, end)
                at = max(end, at + size)
            else:
                at += size + more
    if not found:
        return [_carve(0, "RAR Raw Carve (fallback)", data)]
    return [*found, _carve(0, method, data)._replace(supplement=True)]


def byte_entropy(data: bytes) -> float:
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0


def try_lzma(data: bytes) -> bytes | None:
    """A whole LZMA stream, or nothing on any error.

    Headers that no stream has (the coder's first byte is always 0, lc + lp is at most 4)
    are told apart before a decoder is made. Dictionaries are limited to LZMA_MEMORY.
    """
    if len(data) <= HEADER or data[HEADER] or data[0] % 9 + data[0] // 9 % 5 > 4:
        return None
    try:
        decoder = lzma.LZMADecompressor(format=lzma.FORMAT_ALONE, memlimit=LZMA_MEMORY)
        out = decoder.decompress(data, MOST_OUTPUT)
    except (lzma.LZMAError, EOFError, MemoryError, ValueError):
        return None
    return out if out and decoder.eof else None


class Stats(NamedTuple):
    resyncs: int = 0
    zeroed: int = 0
    tainted: int = 0
    rejected: int = 0


def _accepted(out: bytes) -> bool:
    return len(out) >= LEAST_PROGRESS and (byte_entropy(out) > ENTROPY_LOW or ENTROPY_LOW <= byte_entropy(out) <= ENTROPY_HIGH)


def resync(data: bytes) -> tuple[int, bytes]:
    """How far to the next place whose probe decodes, and what the probe gives; the whole slide and nothing if none does."""
    for slide in range(1, min(SLIDE, len(data))):
        part = data[slide:]
        if len(part) < HEADER:
            break
        if part[0] <= 224 and (out := try_lzma(part[: 4 * PROBE])) and _accepted(out):
            return slide, out
    return min(SLIDE, len(data)), b""


def lzma_tolerant(data: bytes) -> tuple[bytes, Stats]:
    """Decodes what it can; gaps become zeros, which count as tainted."""
    if not data:
        return b"", Stats()
    out = try_lzma(data)
    if out is not None:
        return out, Stats(tainted=0 if byte_entropy(out) > 0.1 else len(out))
    parts, resyncs, zeroed, tainted, rejected, at = [], 0, 0, 0, 0, 0
    for _ in range(MOST_CHUNKS):
        if at >= len(data):
            break
        window = data[at : at + CHUNK]
        out = try_lzma(window) if window[0] <= 224 else None
        if out is not None and len(out) >= LEAST_PROGRESS:
            if _accepted(out):
                parts.append(out)
                at += len(window)
            else:
                pad = max(len(out), PROBE)
                parts.append(bytes(pad))
                zeroed, tainted, rejected, at = zeroed + pad, tainted + pad, rejected + 1, at + 1
            continue
        skip, probe = resync(data[at:])
        gap = min(skip, PROBE)
        parts += [bytes(gap), probe]
        resyncs, zeroed, tainted = resyncs + 1, zeroed + gap, tainted + gap + len(probe)
        at += min(skip + 1, len(data) - at)
    return b"".join(parts), Stats(resyncs, zeroed, tainted, rejected)


def lzma_scan(data: bytes) -> tuple[bytes, Stats]:
    """The longest output over the usual offsets (the first of equal ones); else one slide over the start."""
    best, stats = b"", Stats()
    for at in SCAN_OFFSETS:
        part = data[at:]
        if len(part) >= HEADER and part[0] <= 224:
            out, own = lzma_tolerant(part)
            if len(out) > len(best):
                best, stats = out, own
    if not best:
        skip, probe = resync(data)
        if probe:
            return bytes(skip) + probe, Stats(1, skip, skip)
    return best, stats


def seven_rows(data: bytes) -> list[Row]:
    out, stats = lzma_scan(data)
    errors = stats.resyncs + stats.zeroed // 64
    rows = [_carve(0, f"7z LZMA ({stats.resyncs} resyncs, {stats.tainted} tainted bytes)", out, errors)] if out else []
    whole = inflate(lambda: lzma.LZMADecompressor(format=lzma.FORMAT_XZ), data) if data[:6] == b"\xfd7zXZ\0" else b""
    if whole:
        rows.append(_carve(1, "7z XZ Decode Carve", whole))
    rows.append(_carve(2, "7z Raw Carve", data, errors))
    return [r._replace(resyncs=stats.resyncs, tainted=stats.tainted, zeroed=stats.zeroed, rejected=stats.rejected) for r in rows]


def rows_of(kind: str, data: bytes) -> list[Row]:
    """Strategies' rows for a blob of a detected container type."""
    if kind == "zip":
        return zip_rows(data)
    if kind == "gzip":
        return stream_rows(data, "GZIP", lambda: zlib.decompressobj(31), True)
    if kind == "bzip2":
        return stream_rows(data, "BZIP2", bz2.BZ2Decompressor, True)
    if kind == "xz":
        return stream_rows(data, "XZ", lambda: lzma.LZMADecompressor(format=lzma.FORMAT_XZ), False)
    if kind == "rar":
        return rar_rows(data)
    if kind == "7z":
        return seven_rows(data)
    if kind == "tar":
        return [Row(0, "file", i, n, 0, CONFIDENCE["tar"], 0, 0, "TAR", False, d) for i, (n, d) in enumerate(tar_entries(data))]
    return [_carve(0, "Raw Carve", data)]


def extract(blobs: DataFrame, key: str = "blob_id", kind: str = "archive_type") -> DataFrame:
    """Rows (see SCHEMA) of every blob, by its detected type. Null content is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = rows_of(batch.column(1)[i].as_py(), batch.column(2)[i].as_py() or b"")
                columns = list(zip(*rows)) if rows else [()] * len(Row._fields)
                kinds = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), *[pa.int64()] * 4]
                own = batch.column(0).take(pa.array([i] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *[pa.array(list(c), t) for c, t in zip(columns, kinds)]], names=[key, *Row._fields])

    kept = blobs.select(key, kind, "content")
    return kept.mapInArrow(run, f"{key} {kept.schema[0].dataType.simpleString()}, {SCHEMA}")
