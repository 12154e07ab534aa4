"""Detection and classification as CASE expressions over bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..dims import CONTAINERS, ENTROPY_HIGH, ENTROPY_LOW, MBR_NAMES, SIGNATURES, TYPES
from .binary import has, latin1, let, starts, u32


def _first(cases: list[tuple[Column, str]], other: str) -> Column:
    out = F.lit(other)
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def archive_type(data: Column, streams: bool = False) -> Column:
    """Container of a blob by its prefix; with `streams` RAR does not count. Under 6 bytes: unknown."""
    kinds = [(starts(data, h), k) for h, k in CONTAINERS if not (streams and k == "rar")]
    return F.when(F.length(data) < 6, "unknown").otherwise(_first(kinds, "unknown"))


def file_type(data: Column) -> Column:
    """Type key of a file (see dims.TYPES): BMP, RIFF and PE by structure, others by prefix."""
    n = F.length(data)
    bmp = (n >= 14) & starts(data, "424D") & let(u32(data, 2), lambda s: (s >= 14) & (s <= n + 1024))
    riff = (n >= 12) & starts(data, "52494646")
    exe = (n >= 64) & starts(data, "4D5A") & let(u32(data, 60), lambda p: (p < n - 4) & has(data, p, "50450000"))
    deep = [(bmp, "bmp"), (riff & has(data, 8, "57454250"), "webp"), (riff & has(data, 8, "57415645"), "wav"), (riff & has(data, 8, "41564920"), "avi"), (exe, "exe")]
    flat = [(starts(data, h), t) for h, t in SIGNATURES if t not in ("bmp", "webp", "wav", "avi", "exe")]
    return _first([(F.coalesce(c, F.lit(False)), t) for c, t in deep + flat], "unknown")


def type_label(key: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (label, _) in TYPES.items() for x in (k, label)])[key]


def type_extension(key: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (_, e) in TYPES.items() for x in (k, e)])[key]


def entry_extension(name: Column, data: Column) -> Column:
    """What follows the name's last dot (all of it, if none) if at most 6 bytes, else the type's extension."""
    tail = F.element_at(F.split(name, r"\."), -1)
    return F.when(F.octet_length(tail) <= 6, tail).otherwise(type_extension(file_type(data)))


@F.pandas_udf(DoubleType())
def _entropies(blobs: pd.Series) -> pd.Series:
    def one(data: bytes | None) -> float | None:
        if data is None:
            return None
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        share = counts[counts > 0] / max(len(data), 1)
        return float(-(share * np.log2(share)).sum()) + 0.0

    return blobs.map(one).astype("float64")


def entropy(data: Column) -> Column:
    """Shannon entropy of the bytes in bits; 0 for none. One pass over each blob, in Arrow batches."""
    return _entropies(data)


def entropy_class(h: Column) -> Column:
    return F.when(h < ENTROPY_LOW, "flat").when(h > ENTROPY_HIGH, "noise").otherwise("valid")


def lzma_props_valid(p: Column) -> Column:
    return p <= 224


def lzma_props(p: Column) -> Column:
    """lc, lp, pb of an LZMA properties byte."""
    d = p.cast("int")
    rest = d % 45
    return F.struct((rest % 9).alias("lc"), F.floor(rest / 9).cast("int").alias("lp"), F.floor(d / 45).cast("int").alias("pb"))


def mbr_type_name(byte: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in MBR_NAMES.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(names, byte.cast("int")), F.concat(F.lit("Type 0x"), F.lpad(F.hex(byte), 2, "0")))


def partition_scheme(data: Column, mbr_entries: Column) -> Column:
    """gpt, mbr (with the boot mark and an entry) or unknown."""
    n = F.length(data)
    return F.when((n >= 1024) & has(data, 512, b"EFI PART".hex().upper()), "gpt").when((n >= 512) & has(data, 510, "55AA") & (mbr_entries > 0), "mbr").otherwise("unknown")


def filesystem(data: Column, offset: Column) -> Column:
    """File system at an offset, by marks at fixed places."""
    left = F.length(data) - offset
    marks = [
        (90, 54, b"FAT", "FAT16"), (90, 82, b"FAT", "FAT32"), (8, 3, b"NTFS", "NTFS"),
        (1082, 1080, b"\x53\xef", "ext2/3/4"), (1026, 1024, b"H+", "HFS+"), (8, 3, b"EXFAT", "exFAT"),
    ]
    cases = [((left > most) & has(data, offset + at, mark.hex().upper()), name) for most, at, mark, name in marks]
    return F.when(left <= 0, "unknown").otherwise(_first(cases, "unknown"))


