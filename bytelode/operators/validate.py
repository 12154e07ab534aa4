"""Structure checks by extension: (valid, delta, note) for a file's bytes, and the adjusted confidence.

Twelve are CASE expressions over bytes. JPEG and PNG walk segments of data-dependent
length; that walk is an Arrow-batched function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.binary import cut, find, has, let, number, starts, u8, u16, u32


def walk_jpeg(data: bytes) -> int:
    """1: a frame header was met; 2: a scan was met. Stops at the scan."""
    at, found = 2, 0
    while at + 1 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            found |= 1
        if mark == 0xDA:
            return found | 2
        alone = at + 3 >= len(data) or mark in (0x00, 0xD8, 0xD9)
        at += 2 if alone else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return found


def walk_png(data: bytes) -> int:
    """1: a header chunk with room for its fields; 2: an end chunk."""
    at, found = 8, 0
    while at + 8 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if name == b"IHDR" and at + 20 <= len(data):
            found |= 1
        if name == b"IEND":
            return found | 2
        if at + 12 + size > len(data):
            break
        at += 12 + size
    return found


@F.pandas_udf(IntegerType())
def _walked(kinds: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for kind, data in kinds:
        yield pd.Series([walk_jpeg(bytes(d)) if k == "jpg" else walk_png(bytes(d)) for k, d in zip(kind, data)], dtype="int32")


def _result(valid: bool | Column, delta: float | Column, note: str | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(valid).alias("valid"), lit(delta).cast("double").alias("delta"), lit(note).alias("note"))


def _bad(note: str) -> Column:
    return _result(False, -0.20, note)


def _either(condition: Column, good: float, bad: float, yes: str, no: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), _result(True, good, yes)).otherwise(_result(True, bad, no))


def _checked(data: Column, least: int, magic: Column | None, rest: Column) -> Column:
    out = F.when(F.length(data) < least, _bad("too small"))
    if magic is not None:
        out = out.when(~F.coalesce(magic, F.lit(False)), _bad("bad magic"))
    return out.otherwise(rest)


def native(data: Column) -> dict[str, Column]:
    """The checks that need no walk, by extension."""
    n = F.length(data)
    pe_at = u32(data, 60)
    flac_size = number(F.concat(F.lit(b"\0"), cut(data, 5, 3)), 0, 4, little=False)
    magic42 = F.when(starts(data, "4D4D"), number(data, 2, 2, little=False)).otherwise(u16(data, 2))
    pdf = [find(data, x.hex()).isNotNull() for x in (b"%%EOF", b"xref", b"startxref")]
    return {
        "pdf": _checked(data, 5, starts(data, b"%PDF-".hex().upper()), F.when(pdf[0] & pdf[1] & pdf[2], _result(True, 0.10, "complete")).when(pdf[0], _result(True, -0.05, "no cross references")).otherwise(_result(True, -0.05, "no end mark"))),
        "gif": _checked(data, 13, starts(data, b"GIF8".hex().upper()) & u8(data, 4).isin(0x37, 0x39), _either(has(data, n - 1, "3B"), 0.08, -0.03, "trailer", "no trailer")),
        "bmp": _checked(data, 54, starts(data, "424D"), _either(u32(data, 2) <= n + 1024, 0.08, -0.05, "size fits", "size too large")),
        "zip": _checked(data, 30, starts(data, "504B0304"), _either(find(data, "504B0506").isNotNull(), 0.10, -0.05, "end of directory", "no end of directory")),
        "sqlite": _checked(data, 100, starts(data, b"SQLite format 3\0".hex().upper()), _result(True, 0.10, "header")),
        "elf": _checked(data, 52, starts(data, "7F454C46"), _result(True, 0.08, "header")),
        "exe": _checked(data, 64, starts(data, "4D5A"), F.when(pe_at + 24 > n, _result(True, -0.05, "PE header beyond the file")).when(has(data, pe_at, "50450000"), _result(True, 0.10, "PE header")).otherwise(_result(True, -0.10, "no PE header"))),
        "flac": _checked(data, 42, starts(data, b"fLaC".hex().upper()), F.when(u8(data, 4).bitwiseAND(0x7F) != 0, _result(True, -0.05, "no stream info")).when((flac_size >= 34) & (n >= 8 + flac_size), _result(True, 0.08, "stream info")).otherwise(_result(True, 0.05, "short stream info"))),
        "ogg": _checked(data, 27, starts(data, b"OggS".hex().upper()), _either(u8(data, 4) == 0, 0.08, -0.10, "version 0", "unknown version")),
        "mp3": _checked(data, 4, None, _either(_synced(data), 0.05, -0.05, "frame sync", "no frame sync")),
        "tiff": _checked(data, 8, starts(data, "4D4D") | starts(data, "4949"), F.when(magic42 == 42, _result(True, 0.08, "header")).otherwise(_bad("bad magic"))),
        "wasm": _checked(data, 8, starts(data, "0061736D"), _result(True, 0.08, "header")),
    }


def _synced(data: Column) -> Column:
    """Whether some two bytes are FF and one with its upper three bits set."""
    return F.rlike(F.decode(data, "ISO-8859-1"), F.lit("\\xFF[\\xE0-\\xFF]"))


def result(extension: Column, data: Column, walks: bool = True) -> Column:
    """(valid, delta, note) of a file; unknown extensions are valid. Without `walks` jpg and png count as unknown."""
    out = F.when(F.coalesce(F.length(data), F.lit(0)) == 0, _result(False, -0.20, "empty"))
    for name, check in native(data).items():
        out = out.when(extension == name, check)
    if walks:
        found = _walked(F.when(extension.isin("jpg", "png"), extension).otherwise(F.lit("png")), F.when(extension.isin("jpg", "png"), data).otherwise(F.lit(b"")))
        jpg = _checked(data, 4, starts(data, "FFD8FF"), let(found, lambda f: F.when((f == 3) & has(data, F.length(data) - 2, "FFD9"), _result(True, 0.10, "complete")).when(f.bitwiseAND(1) == 1, _result(True, -0.05, "incomplete")).otherwise(_result(True, -0.10, "no frame"))))
        png = _checked(data, 8, starts(data, "89504E470D0A1A0A"), let(found, lambda f: F.when(f == 3, _result(True, 0.10, "complete")).when(f.bitwiseAND(1) == 1, _result(True, -0.05, "no end chunk")).otherwise(_bad("no header chunk"))))
        out = out.when(extension == "jpg", jpg).when(extension == "png", png)
    return out.otherwise(_result(True, 0.0, "not checked"))


def adjusted(confidence: Column, delta: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence + delta))
