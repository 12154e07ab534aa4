"""One query for each operator over the driver tables, with the DuckDB text that must give the same rows.

The tables hold text, so archives are framed: a document's bytes between a prefix and a
suffix that doc_id picks. Spark and DuckDB build the same bytes from the same lists.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dims import BACK_UP, CONTAINERS, MBR_NAMES, SIGNATURES, TYPES
from ..functions import detect
from ..functions.binary import cut
from ..operators import carve, disk, extract, plugins, report, validate, windows
from ..sources import files as sinks
from . import images, salvage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _framed(spark: SparkSession, sf_dir: str, frames: list[tuple[str, str]]) -> DataFrame:
    """doc_id and content: each document between the frame of its doc_id."""
    pick = lambda i: F.element_at(F.array(*[F.lit(bytes.fromhex(f[i])) for f in frames]), (F.col("doc_id") % len(frames) + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(pick(0), F.encode("text", "UTF-8"), pick(1)).alias("content"))


def _framed_sql(frames: list[tuple[str, str]]) -> str:
    """CTE f(doc_id, c, h, n): the same bytes, their hex digits and number."""
    pick = lambda i: "CASE doc_id %% %d %s END" % (len(frames), " ".join(f"WHEN {k} THEN unhex('{f[i]}')" for k, f in enumerate(frames)))
    return f"WITH f AS (SELECT doc_id, c, hex(c) AS h, octet_length(c) AS n FROM (SELECT doc_id, {pick(0)} || encode(text) || {pick(1)} AS c FROM documents))"


def _b(at: int | str, h: str = "h") -> str:
    """SQL for the byte at an offset of hex digits."""
    digit = lambda p: f"(instr('0123456789ABCDEF', substr({h}, {p}, 1)) - 1)"
    return f"(16 * {digit(f'2 * ({at}) + 1')} + {digit(f'2 * ({at}) + 2')})"


def _le(at: int | str, size: int, h: str = "h") -> str:
    return "(" + " + ".join(f"{256**i}::HUGEINT * {_b(f'{at} + {i}', h)}" for i in range(size)) + ")" + "::BIGINT" * (size < 8)


def _has(at: int | str, digits: str, h: str = "h") -> str:
    return f"(substr({h}, 2 * ({at}) + 1, {len(digits)}) = '{digits}')"


def _finds(digits: str, h: str = "h") -> str:
    """SQL for the first byte-aligned place of some bytes, null if none."""
    spaced = " ".join(digits[i : i + 2] for i in range(0, len(digits), 2)) + " "
    return f"(CASE WHEN instr(regexp_replace({h}, '(..)', '\\1 ', 'g'), '{spaced}') > 0 THEN (instr(regexp_replace({h}, '(..)', '\\1 ', 'g'), '{spaced}') - 1) // 3 END)"


def _rfinds(digits: str, h: str = "h") -> str:
    """SQL for the last byte-aligned place: the first one in the bytes turned round."""
    turned = "".join(reversed([digits[i : i + 2] for i in range(0, len(digits), 2)]))[0:]
    spaced = " ".join(d[::-1] for d in [turned[i : i + 2] for i in range(0, len(turned), 2)]) + " "
    rev = f"regexp_replace(reverse({h}), '(..)', '\\1 ', 'g')"
    return f"(CASE WHEN instr({rev}, '{spaced}') > 0 THEN length({h}) // 2 - (instr({rev}, '{spaced}') - 1) // 3 - {len(digits) // 2} END)"


# --- detection -------------------------------------------------------------------------------------------------

_CONTAINER_FRAMES = [(h, "") for h, _ in CONTAINERS] + [("", ""), ("FFD8FF", "")]
_DETECT = "CASE WHEN n < 6 THEN 'unknown' {} ELSE 'unknown' END"


@_add("detect_archive", f"{_framed_sql(_CONTAINER_FRAMES)} SELECT doc_id, {_DETECT.format(' '.join(f'''WHEN {_has(0, h)} THEN '{k}' ''' for h, k in CONTAINERS))} AS archive_type FROM f")
def detect_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed(spark, sf_dir, _CONTAINER_FRAMES).select("doc_id", detect.archive_type(F.col("content")).alias("archive_type"))


@_add("detect_stream", f"{_framed_sql(_CONTAINER_FRAMES)} SELECT doc_id, {_DETECT.format(' '.join(f'''WHEN {_has(0, h)} THEN '{k}' ''' for h, k in CONTAINERS if k != 'rar'))} AS archive_type FROM f")
def detect_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed(spark, sf_dir, _CONTAINER_FRAMES).select("doc_id", detect.archive_type(F.col("content"), streams=True).alias("archive_type"))


_TYPE_FRAMES = [(h, "") for h, _ in SIGNATURES] + [
    ("424D00040000", ""), ("5249464600000000" + b"WEBP".hex(), ""), ("5249464600000000" + b"WAVE".hex(), ""), ("5249464600000000" + b"AVI ".hex(), ""),
    ("4D5A" + "00" * 58 + "40000000" + "50450000", ""), ("4D5A" + "00" * 58 + "FF000000", ""), ("", ""),
]
_LABELS = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in TYPES.items()) + " END"
_DEEP_SQL = [
    f"WHEN n >= 14 AND {_has(0, '424D')} AND {_le(2, 4)} BETWEEN 14 AND n + 1024 THEN 'bmp'",
    f"WHEN n >= 12 AND {_has(0, '52494646')} AND {_has(8, '57454250')} THEN 'webp'",
    f"WHEN n >= 12 AND {_has(0, '52494646')} AND {_has(8, '57415645')} THEN 'wav'",
    f"WHEN n >= 12 AND {_has(0, '52494646')} AND {_has(8, '41564920')} THEN 'avi'",
    f"WHEN n >= 64 AND {_has(0, '4D5A')} AND {_le(60, 4)} < n - 4 AND {_has(_le(60, 4), '50450000')} THEN 'exe'",
]
_KIND_SQL = "CASE " + " ".join(_DEEP_SQL + [f"WHEN {_has(0, h)} THEN '{t}'" for h, t in SIGNATURES if t not in ("bmp", "webp", "wav", "avi", "exe")]) + " ELSE 'unknown' END"


@_add("identify_type", f"{_framed_sql(_TYPE_FRAMES)} SELECT doc_id, {_LABELS.format(_KIND_SQL)} AS file_type FROM f")
def identify_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed(spark, sf_dir, _TYPE_FRAMES).select("doc_id", detect.type_label(detect.file_type(F.col("content"))).alias("file_type"))


@_add("entry_extension", f"{_framed_sql(_TYPE_FRAMES)}, w AS (SELECT f.*, CASE WHEN f.doc_id % 3 = 0 THEN source || '.' || lang WHEN f.doc_id % 3 = 1 THEN 'README' ELSE source || '.longer_than_six' END AS name FROM f JOIN documents d USING (doc_id)), "
      f"t AS (SELECT doc_id, string_split(name, '.')[-1] AS tail, {_KIND_SQL} AS kind FROM w) SELECT doc_id, CASE WHEN strlen(tail) <= 6 THEN tail ELSE CASE kind {' '.join(f'''WHEN '{k}' THEN '{v[1]}' ''' for k, v in TYPES.items())} END END AS extension FROM t")  # fmt: skip
def entry_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("."), "lang")).when(F.col("doc_id") % 3 == 1, "README").otherwise(F.concat("source", F.lit(".longer_than_six")))
    return _framed(spark, sf_dir, _TYPE_FRAMES).join(docs, "doc_id").select("doc_id", detect.entry_extension(name, F.col("content")).alias("extension"))


_ENTROPY_SQL = """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents),
k AS (SELECT doc_id, x, count(*) AS c FROM b GROUP BY ALL), s AS (SELECT doc_id, sum(c) OVER (PARTITION BY doc_id) AS n, c FROM k),
e AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS h FROM s GROUP BY doc_id), a AS (SELECT doc_id, coalesce(h, 0.0) AS h FROM documents LEFT JOIN e USING (doc_id))"""


@_add("byte_entropy", f"{_ENTROPY_SQL} SELECT doc_id, round(h, 6) AS entropy FROM a")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(detect.entropy(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), 6).alias("entropy"))


@_add("entropy_class", f"{_ENTROPY_SQL} SELECT doc_id, CASE WHEN h < 1.5 THEN 'flat' WHEN h > 7.85 THEN 'noise' ELSE 'valid' END AS class FROM a")
def entropy_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", detect.entropy_class(detect.entropy(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("class"))


@_add("lzma_props", "SELECT p_partkey, p_partkey % 256 <= 224 AS valid, p_partkey % 256 % 45 % 9 AS lc, p_partkey % 256 % 45 // 9 AS lp, p_partkey % 256 // 45 AS pb FROM part")
def lzma_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey") % 256
    return _table(spark, sf_dir, "part").withColumn("d", detect.lzma_props(p)).select("p_partkey", detect.lzma_props_valid(p).alias("valid"), *[F.col(f"d.{c}").cast("bigint").alias(c) for c in ("lc", "lp", "pb")])


@_add("best_offset", "SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, -l_linenumber))::INTEGER AS best_line, max(l_quantity) AS most FROM lineitem GROUP BY l_orderkey")
def best_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argmax with ties to the first, as the scan over decode offsets takes the longest output."""
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"))).alias("best_line"), F.max("l_quantity").alias("most"))


# --- scan and carve --------------------------------------------------------------------------------------------

_ASCII = [(bytes.fromhex(h).decode("latin-1"), t) for h, t in SIGNATURES if all(x < 128 for x in bytes.fromhex(h))]
_RX = "|".join("".join(f"\\x{{{ord(c):02x}}}" for c in s) for s, _ in _ASCII)
#: Text is UTF-8, so only signatures of ASCII bytes can occur in it (no other signature is valid UTF-8).
_HITS_SQL = f"""WITH p AS (SELECT page_id, html, strlen(html) AS n, string_split_regex(html, '{_RX}') AS gaps, regexp_extract_all(html, '{_RX}') AS found FROM pages),
i AS (SELECT page_id, html, n, gaps, found, unnest(generate_series(1, len(found))) AS k FROM p),
o AS (SELECT page_id, html, n, k, found[k] AS m, list_sum(list_transform(gaps[1:k], lambda g: strlen(g))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda g: strlen(g))), 0) AS off FROM i),
s AS (SELECT page_id, html, n, k, off::BIGINT AS off, CASE {" ".join(f"WHEN hex(encode(m)) = '{s.encode().hex().upper()}' THEN '{t}'" for s, t in _ASCII)} END AS kind FROM o),
a AS (SELECT page_id, html, n, k, kind, off, greatest(off - CASE kind {" ".join(f"WHEN '{t}' THEN {b}" for t, b in BACK_UP.items())} ELSE 0 END, 0) AS adj FROM s)"""


@_add("carve_scan", f"{_HITS_SQL} SELECT page_id, off AS offset, kind FROM a")
def carve_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = carve.scan(F.encode("html", "UTF-8"))
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(hits).alias("h")).select("page_id", "h.offset", "h.kind")


@_add("carve_adjust", f"{_HITS_SQL} SELECT page_id, adj AS offset, kind FROM a")
def carve_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = carve.adjust(carve.scan(F.encode("html", "UTF-8")))
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(hits).alias("h")).select("page_id", "h.offset", "h.kind")


_FOLD = "list_reduce(list_transform(list({0} ORDER BY {1}), lambda x: [x]), lambda kept, x: CASE WHEN x[1].o > kept[-1].o + 4 THEN list_concat(kept, x) ELSE kept END)"


@_add("carve_near_dedup", f"WITH w AS (SELECT l_orderkey, l_linenumber, sum(l_linenumber % 4 + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::BIGINT AS o FROM lineitem), "
      f"k AS (SELECT l_orderkey, {_FOLD.format('{o: o}', 'o')} AS kept FROM w GROUP BY l_orderkey) SELECT l_orderkey, unnest(list_transform(kept, lambda s: s.o)) AS offset FROM k")  # fmt: skip
def carve_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.sum(F.col("l_linenumber") % 4 + 1).over(order).cast("bigint").alias("o"))
    hits = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o").alias("offset"), F.lit("x").alias("kind")))).alias("hits"))
    return hits.select("l_orderkey", F.explode(carve.keep_apart(F.col("hits"))).alias("h")).select("l_orderkey", "h.offset")


_CARVE_SQL = f"""{_HITS_SQL}, d AS (SELECT page_id, any_value(html) AS html, any_value(n) AS n, {_FOLD.format('{o: adj, kind: kind}', 'k')} AS kept FROM a GROUP BY page_id),
u AS (SELECT page_id, hex(encode(html)) AS ph, n, unnest(kept) AS s FROM d),
q AS (SELECT page_id, ph, n, s.o AS off, s.kind AS kind FROM u WHERE CASE s.kind WHEN 'bmp' THEN n - s.o >= 6 AND {_le('s.o + 2', 4, 'ph')} BETWEEN 14 AND n - s.o + 1024 WHEN 'mp3' THEN n - s.o >= 128 OR {_b('s.o', 'ph')} = 73 ELSE true END),
r AS (SELECT page_id, ph, n, off, kind, coalesce(lead(off) OVER (PARTITION BY page_id ORDER BY off), n) - off AS region FROM q),
z AS (SELECT page_id, off, kind, region, substr(ph, 2 * off + 1, 2 * region) AS h FROM r WHERE region >= 32)"""


@_add("carve_region", f"{_CARVE_SQL} SELECT page_id, off AS offset, kind, region AS size FROM z")
def carve_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("html", "UTF-8")
    rows = _table(spark, sf_dir, "pages").select("page_id", data.alias("c")).withColumn("hits", carve.keep_apart(carve.adjust(carve.scan(F.col("c")))))
    good = F.filter("hits", lambda h: carve.plausible(F.col("c"), h["kind"], h["offset"]))
    return rows.select("page_id", F.explode(carve.regions(good, F.length("c"))).alias("r")).select("page_id", "r.offset", "r.kind", "r.size")


#: Sizes of carved regions by kind, over the hex digits h and the number n of their bytes.
_REFINED = {
    "jpeg": f"{_finds('FFD9')} + 2", "png": f"least({_finds('49454E44')} + 8, n)", "pdf": f"least({_rfinds('2525454F46')} + 6, n)", "gif": f"{_rfinds('3B')} + 1",
    "bmp": f"CASE WHEN {_le(2, 4)} BETWEEN 14 AND n THEN {_le(2, 4)} END",
    "wav": f"CASE WHEN n >= 12 AND {_le(4, 4)} + 8 BETWEEN 12 AND n THEN {_le(4, 4)} + 8 END",
    "zip": f"CASE WHEN {_rfinds('504B0506')} + 22 <= n THEN least({_rfinds('504B0506')} + 22 + {_le(_rfinds('504B0506') + ' + 20', 2)}, n) END",
}
_SIZE_SQL = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in [*_REFINED.items(), ("avi", _REFINED["wav"]), ("webp", _REFINED["wav"])]) + " END"


@_add("carve_files", f"""{_CARVE_SQL}, t AS (SELECT page_id, off, kind, region, region AS n, h FROM z),
g AS (SELECT page_id, off, kind, region, h, coalesce({_SIZE_SQL}, n)::BIGINT AS size, row_number() OVER (PARTITION BY page_id ORDER BY off) - 1 AS index FROM t)
SELECT page_id, index, printf('carved_%04d.', index) || CASE kind {' '.join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in TYPES.items())} END AS name, {_LABELS.format('kind')} AS file_type, off AS offset, size,
sha256(unhex(substr(h, 1, 2 * size))) AS sha256, CASE WHEN size < region THEN 0.70 ELSE 0.55 END::DOUBLE AS confidence FROM g""")
def carve_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: scan, back up, drop near hits, filter, cut, trim, hash and score, without a shuffle."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return carve.carve(pages, "page_id").select("page_id", "index", "name", "file_type", "offset", "size", "sha256", "confidence")


def _filter_query(name: str, kind: str, frames: list[tuple[str, str]], sql: str) -> None:
    @_add(name, f"{_framed_sql(frames)} SELECT doc_id, coalesce({sql}, false) AS kept FROM f")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _framed(spark, sf_dir, frames).select("doc_id", carve.plausible(F.col("content"), F.lit(kind), F.lit(0).cast("bigint")).alias("kept"))


_filter_query("post_filter_bmp", "bmp", [("424DE8030000", ""), ("424D0D000000", ""), ("424DF4090000", "")], f"n >= 6 AND {_le(2, 4)} BETWEEN 14 AND n + 1024")
_filter_query("post_filter_ico", "ico", [("000001000100" + "101000000100" + "2000" + "68040000" + "16000000", ""), ("000001000000" + "101000000100" + "2000" + "68040000" + "16000000", ""), ("000001000200" + "101000000100" + "2000" + "68040000" + "26000000", "")],
              f"n >= 22 AND {_le(4, 2)} BETWEEN 1 AND 256 AND {_b(9)} = 0 AND {_le(18, 4)} >= 6 + 16 * {_le(4, 2)} AND {_le(18, 4)} < n")
_filter_query("post_filter_mp3", "mp3", [("FFFB", ""), ("494433", ""), ("FFFA", "")], f"n >= 128 OR {_b(0)} = 73")


def _refine_query(name: str, kind: str, frames: list[tuple[str, str]], sql: str) -> None:
    @_add(name, f"{_framed_sql(frames)} SELECT doc_id, coalesce({sql}, n)::BIGINT AS size FROM f")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _framed(spark, sf_dir, frames).select("doc_id", carve.refined_size(F.col("content"), F.lit(kind)).alias("size"))


_refine_query("refine_jpeg", "jpeg", [("FFD8FFE0", "FFD90000"), ("FFD8FFE0", ""), ("FFD8FFD9", "FFD9")], _REFINED["jpeg"])
_refine_query("refine_png", "png", [("89504E470D0A1A0A", "49454E44AE42608200"), ("89504E470D0A1A0A", ""), ("89504E47", "49454E44")], _REFINED["png"])
_refine_query("refine_pdf", "pdf", [(b"%PDF-1.4 %%EOF ".hex(), b"%%EOF\nrest".hex()), (b"%PDF-1.4".hex(), ""), (b"%PDF-".hex(), b"%%EOF".hex())], _REFINED["pdf"])
_refine_query("refine_gif", "gif", [(b"GIF89a".hex(), "3B00FF"), (b"GIF89a".hex(), ""), (b"GIF;".hex(), "")], _REFINED["gif"])
_refine_query("refine_bmp", "bmp", [("424DE8030000", ""), ("424D0D000000", ""), ("424D64000000", "")], _REFINED["bmp"])
_refine_query("refine_riff", "wav", [("52494646E803000057415645", ""), ("524946460100000057415645", ""), ("524946466400000057415645", "")], _REFINED["wav"])
_refine_query("refine_zip", "zip", [("504B0304", "504B0506" + "00" * 16 + "0300" + "616263" + "FFFF"), ("504B0304", ""), ("504B0304", "504B0506" + "00" * 18)], _REFINED["zip"])


# --- validation ------------------------------------------------------------------------------------------------

_PAD = "00" * 120
_VALID: dict[str, tuple[list[tuple[str, str]], int, str | None, str, bool]] = {
    "pdf": ([(b"%PDF-1.4".hex(), b"xref startxref %%EOF".hex()), (b"%PDF-1.4".hex(), b"%%EOF".hex()), (b"%PDF-1.4".hex(), ""), (b"%PD".hex(), "")], 5, _has(0, "255044462D"),
            f"CASE WHEN {_finds('2525454F46')} IS NOT NULL AND {_finds('78726566')} IS NOT NULL AND {_finds(b'startxref'.hex().upper())} IS NOT NULL THEN 0.10 ELSE -0.05 END", True),
    "gif": ([(b"GIF89a".hex() + "00" * 8, "3B"), (b"GIF87a".hex() + "00" * 8, ""), (b"GIF80a".hex() + "00" * 8, "")], 13, f"({_has(0, '47494638')} AND {_b(4)} IN (55, 57))", f"CASE WHEN {_has('n - 1', '3B')} THEN 0.08 ELSE -0.03 END", True),
    "bmp": ([("424DE8030000" + _PAD, ""), ("424D00002000" + _PAD, ""), ("424E" + _PAD, ""), ("424D", "")], 54, _has(0, "424D"), f"CASE WHEN {_le(2, 4)} <= n + 1024 THEN 0.08 ELSE -0.05 END", True),
    "zip": ([("504B0304" + _PAD, "504B0506"), ("504B0304" + _PAD, ""), ("504B0305" + _PAD, "")], 30, _has(0, "504B0304"), f"CASE WHEN {_finds('504B0506')} IS NOT NULL THEN 0.10 ELSE -0.05 END", True),
    "sqlite": ([(b"SQLite format 3\0".hex() + _PAD, ""), (b"SQLite format 4\0".hex() + _PAD, ""), (b"SQLite format 3\0".hex(), "")], 100, _has(0, b"SQLite format 3\0".hex().upper()), "0.10", True),
    "elf": ([("7F454C46" + _PAD, ""), ("7F454C47" + _PAD, ""), ("7F454C46", "")], 52, _has(0, "7F454C46"), "0.08", True),
    "exe": ([("4D5A" + "00" * 58 + "40000000" + "50450000" + _PAD, ""), ("4D5A" + "00" * 58 + "40000000" + _PAD, ""), ("4D5A" + "00" * 58 + "00000F00", ""), ("4D5B" + _PAD, "")], 64, _has(0, "4D5A"),
            f"CASE WHEN {_le(60, 4)} + 24 > n THEN -0.05 WHEN {_has(_le(60, 4), '50450000')} THEN 0.10 ELSE -0.10 END", True),
    "flac": ([("664C614300000022" + _PAD, ""), ("664C614301000022" + _PAD, ""), ("664C614300000021" + _PAD, ""), ("664C614400000022" + _PAD, "")], 42, _has(0, "664C6143"),
             f"CASE WHEN {_b(4)} % 128 <> 0 THEN -0.05 WHEN {_b(5)} * 65536 + {_b(6)} * 256 + {_b(7)} >= 34 AND n >= 8 + {_b(5)} * 65536 + {_b(6)} * 256 + {_b(7)} THEN 0.08 ELSE 0.05 END", True),
    "ogg": ([("4F67675300" + _PAD, ""), ("4F67675301" + _PAD, ""), ("4F67675400" + _PAD, "")], 27, _has(0, "4F676753"), f"CASE WHEN {_b(4)} = 0 THEN 0.08 ELSE -0.10 END", True),
    "mp3": ([("FFFB90", ""), ("494433", ""), ("494433", "FFE0")], 4, None, "CASE WHEN regexp_matches(regexp_replace(h, '(..)', '\\1 ', 'g'), 'FF [EF]') THEN 0.05 ELSE -0.05 END", True),
    "tiff": ([("49492A00" + _PAD, ""), ("4D4D002A" + _PAD, ""), ("4D4D2A00" + _PAD, ""), ("4E4D002A" + _PAD, "")], 8, f"({_has(0, '49492A00')} OR {_has(0, '4D4D002A')})", "0.08", True),
    "wasm": ([("0061736D01000000", ""), ("0061736E01000000", ""), ("0061736D", "")], 8, _has(0, "0061736D"), "0.08", True),
}


def _valid_query(extension: str) -> None:
    frames, least, magic, delta, _ = _VALID[extension]
    bad = f"n < {least}" + (f" OR NOT {magic}" if magic else "")

    @_add(f"validate_{extension}", f"{_framed_sql(frames)} SELECT doc_id, NOT ({bad}) AS valid, round(CASE WHEN {bad} THEN -0.20 ELSE {delta} END::DOUBLE, 2) AS delta FROM f")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _framed(spark, sf_dir, frames).withColumn("r", validate.result(F.lit(extension), F.col("content"), walks=False))
        return rows.select("doc_id", "r.valid", F.round("r.delta", 2).alias("delta"))


for _e in _VALID:
    _valid_query(_e)

_JPEG = [("FFD8FFE00004AAAAFFC0000B080010001001011100FFDA0004AAAA", "FFD9"), ("FFD8FFE00004AAAAFFC0000B080010001001011100FFDA0004AAAA", ""), ("FFD8FFE00004AAAAFFDA0004AAAA", "FFD9"), ("FFD9", "")]
_JPEG_DELTA = "[0.10, -0.05, -0.10, -0.20]"


@_add("validate_jpeg", f"SELECT doc_id, doc_id % 4 <> 3 AS valid, {_JPEG_DELTA}[doc_id % 4 + 1]::DOUBLE AS delta FROM documents")
def validate_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _framed(spark, sf_dir, _JPEG).withColumn("r", validate.result(F.lit("jpg"), F.col("content")))
    return rows.select("doc_id", "r.valid", F.round("r.delta", 2).alias("delta"))


_IHDR = "0000000D49484452" + "00000010000000100802000000" + "00000000"
_PNG = [("89504E470D0A1A0A" + _IHDR + "0000000049454E44AE426082", ""), ("89504E470D0A1A0A" + _IHDR + "7FFFFFFF", ""), ("89504E470D0A1A0A7FFFFFFF", ""), ("8950", "")]


@_add("validate_png", "SELECT doc_id, doc_id % 4 < 2 AS valid, [0.10, -0.05, -0.20, -0.20][doc_id % 4 + 1]::DOUBLE AS delta FROM documents")
def validate_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _framed(spark, sf_dir, _PNG).withColumn("r", validate.result(F.lit("png"), F.col("content")))
    return rows.select("doc_id", "r.valid", F.round("r.delta", 2).alias("delta"))


@_add("adjust_confidence", "SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.0, l_discount * 20 - l_tax * 5)) AS confidence FROM lineitem")
def adjust_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", validate.adjusted(F.col("l_discount") * 20, -F.col("l_tax") * 5).alias("confidence"))


# --- scores and reports ----------------------------------------------------------------------------------------

_FILES_SQL = "WITH t AS (SELECT doc_id, source, lang, octet_length(encode(text)) AS size, sha256(text) AS sha, 0.5 + doc_id % 5 / 10.0 AS confidence FROM documents)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("sha"), (F.lit(0.5) + F.col("doc_id") % 5 / 10.0).alias("confidence"))


@_add("sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@_add("sha256_dedup", f"{_FILES_SQL} SELECT doc_id, source, sha AS sha256 FROM t QUALIFY row_number() OVER (PARTITION BY source, sha ORDER BY doc_id) = 1")
def sha256_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.dedup_first(_files(spark, sf_dir), "source", "sha", "doc_id").select("doc_id", "source", F.col("sha").alias("sha256"))


@_add("reindex", f"{_FILES_SQL}, u AS (SELECT doc_id, source FROM t QUALIFY row_number() OVER (PARTITION BY source, sha ORDER BY doc_id) = 1) SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS index FROM u")
def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = report.dedup_first(_files(spark, sf_dir), "source", "sha", "doc_id")
    return report.reindex(kept, "source", "doc_id").select("doc_id", "source", "index")


@_add("type_breakdown", f"{_FILES_SQL} SELECT source, lang AS file_type, count(*) AS count, sum(size)::BIGINT AS total_bytes FROM t GROUP BY ALL")
def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.type_breakdown(_files(spark, sf_dir), "source", "lang", "size")


@_add("salvage_rate", f"{_FILES_SQL} SELECT source, round(least(100.0, sum(CASE WHEN doc_id % 3 <> 0 THEN size END) / sum(size) * 100.0) * 10) / 10 AS salvage_rate_percent FROM t GROUP BY source")
def salvage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _files(spark, sf_dir).groupBy("source").agg(F.sum(F.when(F.col("doc_id") % 3 != 0, F.col("size"))).alias("kept"), F.sum("size").alias("size"))
    return sums.select("source", report.salvage_rate(F.col("kept").cast("double"), F.col("size").cast("double")).alias("salvage_rate_percent"))


@_add("overall_confidence", f"{_FILES_SQL} SELECT source, round(sum(confidence::DOUBLE * size) / sum(size) * 1000) / 1000 AS overall_confidence FROM t GROUP BY source")
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("source").agg(report.overall_confidence("confidence", "size").alias("overall_confidence"))


@_add("report", f"{_FILES_SQL}, b AS (SELECT source, sum(size)::BIGINT AS input_size FROM t GROUP BY source), g AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS bytes, round(sum(confidence::DOUBLE * size) / sum(size) * 1000) / 1000 AS c FROM t WHERE doc_id % 3 <> 0 AND source <> 'src3' GROUP BY source) "
      "SELECT source, input_size, coalesce(n, 0) AS files_salvaged, coalesce(bytes, 0) AS total_salvaged_bytes, 3 AS corruption_bypassed, round(least(100.0, coalesce(bytes, 0) / input_size * 100.0) * 10) / 10 AS salvage_rate_percent, coalesce(c, 0) AS overall_confidence FROM b LEFT JOIN g USING (source)")  # fmt: skip
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source without files (src3) still has a report."""
    files = _files(spark, sf_dir)
    blobs = files.groupBy("source").agg(F.sum("size").alias("input_size")).select("source", F.lit("unknown").alias("archive_type"), F.lit("Raw Carve").alias("method"), "input_size", F.lit(1).cast("bigint").alias("crc_errors"), F.lit(2).cast("bigint").alias("lzma_errors"))
    kept = files.where("doc_id % 3 <> 0 and source <> 'src3'").select("source", F.col("lang").alias("file_type"), "size", "confidence")
    return report.report(blobs, kept, "source").select("source", "input_size", "files_salvaged", "total_salvaged_bytes", "corruption_bypassed", "salvage_rate_percent", "overall_confidence")


@_add("report_json", f"""{_FILES_SQL}, f AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, * EXCLUDE (source) FROM t),
k AS (SELECT source, lang, count(*) AS n, sum(size)::BIGINT AS b FROM f GROUP BY ALL), y AS (SELECT source, list({{'file_type': lang, 'count': n, 'total_bytes': b}} ORDER BY n DESC, lang) AS types FROM k GROUP BY source)
SELECT source, to_json({{'input': source, 'input_size': sum(size)::BIGINT, 'archive_type': 'unknown', 'method': 'Raw Carve', 'files_salvaged': count(*), 'total_salvaged_bytes': sum(size)::BIGINT, 'corruption_bypassed': 3,
'crc_errors_ignored': 1, 'lzma_errors_bypassed': 2, 'salvage_rate_percent': 100.0::DOUBLE, 'overall_confidence': round(sum(confidence::DOUBLE * size) / sum(size) * 1000) / 1000, 'salvage_time_secs': 0.0::DOUBLE, 'type_breakdown': any_value(types),
'files': list({{'index': i, 'name': 'f' || doc_id, 'file_type': lang, 'extension': 'bin', 'offset': 0, 'size': size, 'sha256': sha, 'confidence': confidence::DOUBLE}} ORDER BY i)}})::VARCHAR AS json FROM f JOIN y USING (source) GROUP BY source""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of a report with its files, as the command line prints it."""
    files = _files(spark, sf_dir)
    blobs = files.groupBy("source").agg(F.sum("size").alias("input_size")).select("source", F.lit("unknown").alias("archive_type"), F.lit("Raw Carve").alias("method"), "input_size", F.lit(1).cast("bigint").alias("crc_errors"), F.lit(2).cast("bigint").alias("lzma_errors"))
    kept = report.reindex(files, "source", "doc_id").select(
        "source", "index", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("file_type"), F.lit("bin").alias("extension"), F.lit(0).cast("bigint").alias("offset"),
        "size", F.col("sha").alias("sha256"), F.col("confidence").cast("double").alias("confidence"))
    return sinks.report_json(report.with_files(report.report(blobs, kept, "source"), kept, "source"), "source")


@_add("rar_supplement", "WITH p AS (SELECT source, n_chars AS off, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), c AS (SELECT source, n_chars AS off, doc_id FROM documents WHERE doc_id % 2 = 1) "
      "SELECT * FROM p UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source = c.source AND p.off = c.off)")  # fmt: skip
def rar_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("offset"), "doc_id")
    parsed = docs.where("doc_id % 2 = 0").groupBy("source", "offset").agg(F.min("doc_id").alias("doc_id"))
    return report.supplement(parsed, docs.where("doc_id % 2 = 1"), "source").withColumnRenamed("offset", "off")


# --- taint -----------------------------------------------------------------------------------------------------

_TAINT_SQL = """WITH r AS (SELECT source, (doc_id * 37) % 5000 AS s, (doc_id * 37) % 5000 + n_chars % 40 AS e FROM documents),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r WHERE s < e),
g AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m), i AS (SELECT source, min(s) AS s, max(e) AS e FROM g GROUP BY source, g)"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("doc_id") * 37 % 5000
    return _table(spark, sf_dir, "documents").select("source", start.alias("start"), (start + F.col("n_chars") % 40).alias("end"))


@_add("taint_intervals", f"{_TAINT_SQL} SELECT source, s AS \"start\", e AS \"end\" FROM i")
def taint_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.taint_intervals(_ranges(spark, sf_dir), "source")


@_add("taint_count", f"{_TAINT_SQL} SELECT source, sum(e - s)::BIGINT AS tainted FROM i GROUP BY source")
def taint_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.taint_count(_ranges(spark, sf_dir), "source")


# --- disk images -----------------------------------------------------------------------------------------------

_TYPE_BYTES = [0x83, 0x07, 0x0B, 0x00, 0x42]


def _mbr_frame(i: int) -> str:
    entry = lambda t, start, count: f"00000000{t:02X}000000{start.to_bytes(4, 'little').hex()}{count.to_bytes(4, 'little').hex()}"
    table = entry(_TYPE_BYTES[i], 2, 4) + entry(0xEE, 1, 1) + entry(0x82, 0, 9) + entry(0x0C, 90000000, 9)
    return "00" * 446 + table + "55AA" + "00" * 512 + (b"\xeb\x3c\x90NTFS    ".hex() if i % 2 else "00" * 12) + "00" * 96


_MBR = [(_mbr_frame(i), "") for i in range(5)]
_MBR_NAME_SQL = "CASE t " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in MBR_NAMES.items()) + " ELSE printf('Type 0x%02X', t) END"


def _fs_sql(at: str) -> str:
    marks = [(90, 54, "464154", "FAT16"), (90, 82, "464154", "FAT32"), (8, 3, "4E544653", "NTFS"), (1082, 1080, "53EF", "ext2/3/4"), (1026, 1024, "482B", "HFS+"), (8, 3, "4558464154", "exFAT")]
    return f"CASE WHEN n - ({at}) <= 0 THEN 'unknown' " + " ".join(f"WHEN n - ({at}) > {m} AND {_has(f'({at}) + {o}', d)} THEN '{v}'" for m, o, d, v in marks) + " ELSE 'unknown' END"


@_add("mbr_partitions", f"{_framed_sql(_MBR)}, e AS (SELECT doc_id, h, n, i, {_b('446 + 16 * i + 4')} AS t, {_le('446 + 16 * i + 8', 4)} * 512 AS s, {_le('446 + 16 * i + 12', 4)} * 512 AS z FROM f, range(4) AS r(i)), "
      f"g AS (SELECT * FROM e WHERE t > 0 AND s > 0 AND z > 0 AND s < n) SELECT doc_id AS image_id, 'mbr' AS scheme, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS index, {_MBR_NAME_SQL} AS label, s::BIGINT AS start_offset, z::BIGINT AS size, {_fs_sql('s')} AS filesystem FROM g")  # fmt: skip
def mbr_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disk.partitions(_framed(spark, sf_dir, _MBR).withColumnRenamed("doc_id", "image_id"))


def _gpt_frame(i: int) -> str:
    name = ["EFI", "", "Däta"][i].encode("utf-16-le").ljust(72, b"\0")
    entry = lambda first, last: bytes(range(1, 33)) + first.to_bytes(8, "little") + last.to_bytes(8, "little") + bytes(8) + name
    head = b"\0" * 512 + b"EFI PART" + b"\0" * 72 + (3).to_bytes(4, "little") + (128).to_bytes(4, "little")
    return (head.ljust(1024, b"\0") + entry(3, 5) + bytes(128) + entry(6, 6 + i)).hex()


_GPT = [(_gpt_frame(i), "00" * 64) for i in range(3)]


@_add("gpt_partitions", f"{_framed_sql(_GPT)}, e AS (SELECT doc_id, h, n, i, 1024 + 128 * i AS pos FROM f, range(3) AS r(i)), "
      f"k AS (SELECT doc_id, h, n, i, pos, {_le('pos + 32', 8)}::BIGINT AS a, {_le('pos + 40', 8)}::BIGINT AS b FROM e WHERE substr(h, 2 * pos + 1, 32) <> repeat('0', 32)), g AS (SELECT * FROM k WHERE a > 0 AND b > a) "
      f"SELECT doc_id AS image_id, 'gpt' AS scheme, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS index, CASE doc_id % 3 WHEN 0 THEN 'EFI' WHEN 1 THEN 'GPT Partition ' || i ELSE 'Däta' END AS label, (a * 512)::BIGINT AS start_offset, ((b - a + 1) * 512)::BIGINT AS size, {_fs_sql('a * 512')} AS filesystem FROM g")  # fmt: skip
def gpt_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disk.partitions(_framed(spark, sf_dir, _GPT).withColumnRenamed("doc_id", "image_id"))


_FS = [("00" * 54 + b"FAT16".hex() + "00" * 40, ""), ("00" * 82 + b"FAT32".hex() + "00" * 40, ""), ("000000" + b"NTFS".hex() + "00" * 90, ""), ("00" * 1080 + "53EF00", ""), ("00" * 1024 + b"H+".hex() + "00", ""), ("000000" + b"EXFAT".hex() + "00" * 90, ""), ("", "")]


@_add("filesystem", f"{_framed_sql(_FS)} SELECT doc_id, {_fs_sql('0')} AS filesystem FROM f")
def filesystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed(spark, sf_dir, _FS).select("doc_id", detect.filesystem(F.col("content"), F.lit(0)).alias("filesystem"))


@_add("partition_slices", f"{_framed_sql(_MBR)}, e AS (SELECT doc_id, h, n, i, {_b('446 + 16 * i + 4')} AS t, ({_le('446 + 16 * i + 8', 4)} * 512)::BIGINT AS s, ({_le('446 + 16 * i + 12', 4)} * 512)::BIGINT AS z FROM f, range(4) AS r(i)), "
      "g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM e WHERE t > 0 AND s > 0 AND z > 0 AND s < n) "
      "SELECT doc_id AS image_id, k AS index, sha256(unhex(substr(h, 2 * s + 1, 2 * least(z, n - s)))) AS sha256 FROM g UNION ALL SELECT doc_id, -1, sha256(c) FROM f")  # fmt: skip
def partition_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _framed(spark, sf_dir, _MBR).withColumnRenamed("doc_id", "image_id")
    return disk.slices(images, disk.partitions(images)).select("image_id", "index", F.sha2("content", 256).alias("sha256"))


@_add("disk_collect", f"{_FILES_SQL} SELECT doc_id, source FROM t QUALIFY row_number() OVER (PARTITION BY source, sha ORDER BY doc_id % 3 = 0, doc_id % 3, doc_id) = 1")
def disk_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("doc_id", F.col("source").alias("image_id"), F.col("sha").alias("sha256"), F.col("doc_id").alias("index"), (F.col("doc_id") % 3 - 1).alias("partition"))
    return disk.collected(files).select("doc_id", F.col("image_id").alias("source"))


# --- windows ---------------------------------------------------------------------------------------------------

_WINDOWS_SQL = "WITH f AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents), w AS (SELECT doc_id, h, n, unnest(range(CASE WHEN n <= 1000 THEN 1 ELSE ceil(n / 900)::BIGINT END)) AS win FROM f)"


@_add("windows", f"{_WINDOWS_SQL} SELECT doc_id, win AS \"window\", win * 900 AS \"start\", sha256(unhex(substr(h, 1800 * win + 1, 2000))) AS sha256 FROM w")
def byte_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = _framed(spark, sf_dir, [("", "")])
    return windows.windows(blobs, 1000, 100, "doc_id").select("doc_id", "window", "start", F.sha2("content", 256).alias("sha256"))


@_add("window_dedup", f"{_WINDOWS_SQL}, d AS (SELECT doc_id, win, sha256(unhex(substr(h, 1800 * win + 1, 2000))) AS sha256 FROM w WHERE 1800 * win < length(h)) SELECT doc_id, min(win) AS \"window\", sha256, min(win * 900) AS \"offset\" FROM d GROUP BY doc_id, sha256")
def window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_out = windows.windows(_framed(spark, sf_dir, [("", "")]), 1000, 100, "doc_id").where(F.length("content") > 0)
    files = cut_out.select("doc_id", "window", "start", F.lit(0).alias("index"), F.lit(0).cast("bigint").alias("offset"), F.sha2("content", 256).alias("sha256"))
    return windows.joined(files, "doc_id").select("doc_id", F.col("window").cast("bigint").alias("window"), "sha256", "offset")


# --- whole plans over disk images and windows ------------------------------------------------------------------

#: Each document, as hex digits (in which no signature can occur), behind a PDF of its own.
_PDF_SQL = "(encode('%PDF-1.4 document ' || doc_id || chr(10) || 'xref startxref %%EOF' || chr(10)))"


def _pdf() -> Column:
    return F.encode(F.concat(F.lit("%PDF-1.4 document "), F.col("doc_id").cast("string"), F.lit("\nxref startxref %%EOF\n")), "UTF-8")


def _padded(value: Column, size: int) -> Column:
    return F.substring(F.concat(value, F.lit(bytes(size))), 1, size)


_TABLE = bytes(446) + bytes([0, 0, 0, 0, 0x83, 0, 0, 0]) + (2).to_bytes(4, "little") + (4).to_bytes(4, "little") + bytes(48) + b"\x55\xaa"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of six kinds by doc_id: with a PDF in the partition, before it, without a partition table, under 512 bytes, twice the same, and none."""
    text, kind = F.encode(F.hex(F.encode("text", "UTF-8")), "UTF-8"), F.col("doc_id") % 6
    table, blank = F.lit(_TABLE), F.lit(bytes(512))
    content = (
        F.when(kind == 0, F.concat(table, blank, _pdf(), text)).when(kind == 1, F.concat(table, _padded(_pdf(), 512), text)).when(kind == 2, F.concat(blank, _pdf(), text))
        .when(kind == 3, _padded(_pdf(), 500)).when(kind == 4, F.concat(table, _padded(_pdf(), 512), _pdf(), text)).otherwise(F.concat(table, blank, text))
    )
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), content.alias("content"))


_PDF_FOUND = f"sha256({_PDF_SQL}) AS sha256, octet_length({_PDF_SQL}) AS size, round(0.80::DOUBLE, 2) AS confidence"


@_add("disk_scan", f"SELECT doc_id AS image_id, CASE WHEN doc_id % 6 IN (0, 4) THEN 0 ELSE -1 END AS partition, CASE WHEN doc_id % 6 IN (0, 4) THEN 0 ELSE 512 END AS offset, {_PDF_FOUND} FROM documents WHERE doc_id % 6 IN (0, 1, 2, 4)")
def disk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = images.disk_scan(_images(spark, sf_dir))
    return files.select("image_id", "partition", "offset", "sha256", "size", F.round("confidence", 2).alias("confidence"))


@_add("disk_report", f"SELECT doc_id AS image_id, CASE WHEN doc_id % 6 = 3 THEN 'too small' END AS error, CASE doc_id % 6 WHEN 2 THEN 'unknown' WHEN 3 THEN NULL ELSE 'mbr' END AS scheme, CASE WHEN doc_id % 6 IN (2, 3) THEN 0 ELSE 1 END AS partitions, "
      "CASE WHEN doc_id % 6 IN (2, 3) OR doc_id % 6 IN (1, 5) AND octet_length(encode(text)) = 0 THEN 0 ELSE 1 END AS partition_reports, CASE doc_id % 6 WHEN 3 THEN 0 WHEN 5 THEN 0 WHEN 4 THEN 1 ELSE 1 END AS total_files, CASE WHEN doc_id % 6 IN (3, 5) THEN 0 ELSE 1 END AS whole_files FROM documents")  # fmt: skip
def disk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reports = images.disk_scan(_images(spark, sf_dir))
    number = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(c)
    return reports.select("image_id", "error", "scheme", number("partitions"), number("partition_reports"), "total_files", F.coalesce("whole_report.files_salvaged", F.lit(0)).alias("whole_files"))


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), F.concat(F.when(F.col("doc_id") % 2 == 0, _pdf()).otherwise(F.lit(b"")), F.encode(F.hex(F.encode("text", "UTF-8")), "UTF-8")).alias("content"))


@_add("stream_salvage", f"SELECT doc_id AS blob_id, 0 AS \"window\", 0 AS index, 0 AS offset, {_PDF_FOUND} FROM documents WHERE doc_id % 2 = 0")
def stream_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = images.stream_salvage(_streams(spark, sf_dir), 4096, 512)
    return files.select("blob_id", "window", "index", "offset", "sha256", "size", F.round("confidence", 2).alias("confidence"))


@_add("stream_report", f"WITH b AS (SELECT doc_id, octet_length({_PDF_SQL}) AS p, CASE WHEN doc_id % 2 = 0 THEN octet_length({_PDF_SQL}) ELSE 0 END + 2 * octet_length(encode(text)) AS n FROM documents) "
      "SELECT doc_id AS blob_id, n AS input_size, CASE WHEN n = 0 THEN 0 WHEN n <= 4096 THEN 1 ELSE ceil(n / 3584)::BIGINT END AS windows_processed, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS files_salvaged, CASE WHEN doc_id % 2 = 0 THEN p ELSE 0 END AS bytes_recovered FROM b")  # fmt: skip
def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reports = images.stream_salvage(_streams(spark, sf_dir), 4096, 512)
    return reports.select("blob_id", "input_size", "windows_processed", "files_salvaged", "bytes_recovered")


# --- plugins ---------------------------------------------------------------------------------------------------

_PLUGIN_SQL = "['DEADBEEF', 'F', 'zz', '', ' 4142 ', repeat('41', 33)]"


@_add("plugin_validate", f"WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'longextension' ELSE 'bin' END AS ext, {_PLUGIN_SQL}[p_partkey % 6 + 1] AS magic, CASE WHEN p_partkey % 4 = 0 THEN 'X1' END AS mark FROM part) "
      "SELECT p_partkey, CASE WHEN name = '' THEN 'empty name' WHEN length(trim(magic)) % 2 <> 0 OR NOT regexp_full_match(trim(magic), '[0-9A-Fa-f]*') THEN 'invalid magic' WHEN trim(magic) = '' THEN 'empty magic' WHEN length(trim(magic)) > 64 THEN 'magic too long' WHEN length(ext) NOT BETWEEN 1 AND 10 THEN 'invalid extension' WHEN mark IS NOT NULL THEN 'invalid end marker' END AS error FROM s")  # fmt: skip
def plugin_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    magic = F.element_at(F.array(*map(F.lit, ["DEADBEEF", "F", "zz", "", " 4142 ", "41" * 33])), (k % 6 + 1).cast("int"))
    name, ext, mark = F.when(k % 7 == 0, "").otherwise(F.col("p_brand")), F.when(k % 5 == 0, "longextension").otherwise("bin"), F.when(k % 4 == 0, "X1")
    return _table(spark, sf_dir, "part").select("p_partkey", plugins.error(name, ext, magic, mark).alias("error"))


_PLUGIN_FRAMES = [("00" * 40 + "DEADBEEF", "CAFEBABE" + "00" * 10), ("DEADBEEF", ""), ("", "")]


@_add("plugin_carve", f"{_framed_sql(_PLUGIN_FRAMES)}, k AS (SELECT doc_id, h, n, {_finds('DEADBEEF')} AS s FROM f), e AS (SELECT doc_id, n, s, least(s + 5000, n) AS e, substr(h, 2 * s + 1, 2 * (least(s + 5000, n) - s)) AS h FROM k WHERE s IS NOT NULL), "
      f"z AS (SELECT doc_id, s, h, coalesce({_finds('CAFEBABE')} + 4, e - s) AS size, {_finds('CAFEBABE')} IS NOT NULL AS ended FROM e) SELECT doc_id, s AS offset, size, sha256(unhex(substr(h, 1, 2 * size))) AS sha256, CASE WHEN ended THEN 0.65 ELSE 0.50 END::DOUBLE AS confidence FROM z WHERE size >= 32")  # fmt: skip
def plugin_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("Custom", "cst", "DEADBEEF", 0, 5000, "CAFEBABE")], "name string, extension string, magic string, offset bigint, max_size bigint, end_marker string")
    return plugins.carve(_framed(spark, sf_dir, _PLUGIN_FRAMES), known, key="doc_id").select("doc_id", "offset", "size", "sha256", "confidence")


@_add("signature_counts", f"SELECT {len(SIGNATURES)} AS builtin, count(DISTINCT p_brand) AS plugin, {len(SIGNATURES)} + count(DISTINCT p_brand) AS total FROM part")
def signature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = _table(spark, sf_dir, "part").select(F.count_distinct("p_brand").alias("plugin"))
    return brands.select(F.lit(len(SIGNATURES)).alias("builtin"), "plugin", (F.col("plugin") + len(SIGNATURES)).alias("total"))


# --- task analytics --------------------------------------------------------------------------------------------


@_add("task_stats", "SELECT user_id, count(*) AS tasks, count(*) FILTER (event_type = 'click') AS running, coalesce(sum(value) FILTER (event_type <> 'click'), 0) AS bytes FROM events GROUP BY user_id")
def task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = F.col("event_type") == "click"
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("tasks"), F.count_if(click).alias("running"), F.coalesce(F.sum(F.when(~click, F.col("value"))), F.lit(0.0)).alias("bytes"))


@_add("task_retention", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth, max(ts) OVER () AS now FROM events) SELECT event_id, user_id FROM k WHERE nth <= 10 AND ts > now - INTERVAL 1 DAY")
def task_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's last ten tasks that are not a day older than the newest of all."""
    events = _table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    recent = events.join(F.broadcast(now)).where("ts > now - interval 1 day")  # the order is by time, so what goes here comes after all that stays
    return recent.withColumn("nth", nth).where("nth <= 10").select("event_id", "user_id")


@_add("task_admission", "SELECT user_id, count(*) FILTER (event_type = 'click') < 3 AS admitted FROM events GROUP BY user_id")
def task_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "click") < 3).alias("admitted"))


# --- decoders (no SQL equivalent) ------------------------------------------------------------------------------


def _tar(items: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, data in items:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _zip(items: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in items:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED if len(data) % 2 else zipfile.ZIP_STORED)
    return out.getvalue()


def _rar4(items: list[tuple[str, bytes]]) -> bytes:
    out = b"Rar!\x1a\x07\x00"
    for name, data in items:
        raw = name.encode()
        size = 32 + len(raw)
        head = bytes(2) + b"\x74" + (0x8000).to_bytes(2, "little") + size.to_bytes(2, "little") + len(data).to_bytes(4, "little") + bytes(15) + len(raw).to_bytes(2, "little") + bytes(4)
        out += head + raw + data
    return out


def _vint(value: int) -> bytes:
    out = b""
    while value > 127:
        out, value = out + bytes([value & 127 | 128]), value >> 7
    return out + bytes([value])


def _rar5(items: list[tuple[str, bytes]]) -> bytes:
    """Stored files in RAR 5 blocks, each header with a data size and the modification time that is always taken to be there."""
    out = b"Rar!\x1a\x07\x01\x00"
    for name, data in items:
        raw = name.encode()
        head = _vint(2) + _vint(2) + _vint(len(data)) + _vint(2) + _vint(len(data)) + _vint(0) + bytes(4) + _vint(0) + _vint(0) + _vint(len(raw)) + raw
        out += bytes([1, 2, 3, 4]) + _vint(len(head)) + head + data
    return out


def _boxed(text: str, kind: str) -> bytes:
    """An archive of a kind around a text, as the decoders' input."""
    data = text.encode()
    page = b"<html>" + data + b"</html>" + b" " * 32
    items = [("docs/a.html", page), ("docs/b.txt", data)]
    if kind == "zip":
        return _zip(items)
    if kind in ("rar", "rar5"):
        return _rar4(items) if kind == "rar" else _rar5(items)
    if kind == "7z":
        return b"7z\xbc\xaf\x27\x1c" + bytes(26) + lzma.compress(page, format=lzma.FORMAT_ALONE)
    body = _tar(items) if kind == "tar" else page
    return {"gzip": gzip.compress, "bzip2": bz2.compress, "xz": lambda b: lzma.compress(b, format=lzma.FORMAT_XZ), "tar": gzip.compress}[kind](body)


def _archives(spark: SparkSession, sf_dir: str, kind: str, damaged: bool = True) -> DataFrame:
    """blob_id and content: every document boxed as an archive; with `damaged` each fifth one is cut at three quarters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_boxed(t or "", kind) for t in batch.column(1).to_pylist()]
            made = [m[: len(m) * 3 // 4] if damaged and (i or 0) % 5 == 0 else m for i, m in zip(batch.column(0).to_pylist(), made)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["blob_id", "content"])

    return _table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "blob_id bigint, content binary")


def _extract_query(kind: str) -> None:
    @_add(f"{kind}_extract")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return salvage.recover(_archives(spark, sf_dir, kind), data=False)[0]


for _k in ("zip", "gzip", "bzip2", "xz", "tar", "rar", "7z"):
    _extract_query(_k)

#: What went into each undamaged archive is what comes out. Documents hold no signature of their own, so a page is carved where it begins.
_BOXED_SQL = "WITH p AS (SELECT doc_id, encode('<html>') || encode(text) || encode('</html>' || repeat(' ', 32)) AS page, encode(text) AS body FROM documents), b AS (SELECT doc_id AS blob_id, 0 AS index, 'docs/a.html' AS name, page AS data FROM p UNION ALL SELECT doc_id, 1, 'docs/b.txt', body FROM p)"
_ONE_SQL = "SELECT blob_id, index, {} AS name, octet_length(data) AS size, sha256(data) AS sha256, {}::DOUBLE AS confidence FROM b"


def _whole_query(kind: str, sql: str) -> None:
    @_add(f"{kind}_whole", f"{_BOXED_SQL} {sql}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files, _ = salvage.recover(_archives(spark, sf_dir, kind, damaged=False), data=False)
        return files.select("blob_id", "index", "name", "size", "sha256", "confidence")


_whole_query("zip", _ONE_SQL.format("name", 0.95))
_whole_query("tar", _ONE_SQL.format("name", 0.90) + " WHERE octet_length(data) > 0")

def _vint_sql(n: str) -> str:
    return f"CASE WHEN {n} < 128 THEN printf('%02X', {n}) WHEN {n} < 16384 THEN printf('%02X%02X', {n} % 128 + 128, {n} // 128) ELSE printf('%02X%02X%02X', {n} % 128 + 128, {n} // 128 % 128 + 128, {n} // 16384) END"


def _rar_sql(head: str, confidence: float) -> str:
    """Stored files over 32 bytes, and what is carved besides: the archive's own start, up to the first page."""
    name = b"docs/a.html".hex().upper()
    carved = f"SELECT blob_id, (SELECT count(*) FROM b AS o WHERE o.blob_id = b.blob_id AND octet_length(o.data) > 32) AS index, 'carved_0000.rar' AS name, unhex({head} || '{name}') AS data FROM (SELECT *, octet_length(data) AS n FROM b) AS b WHERE index = 0"
    return f", h AS ({carved}) {_ONE_SQL.format('name', confidence)} WHERE octet_length(data) > 32 UNION ALL SELECT blob_id, index, name, octet_length(data), sha256(data), 0.55::DOUBLE FROM h"


_LE32_SQL = "substr(printf('%08X', n), 7, 2) || substr(printf('%08X', n), 5, 2) || substr(printf('%08X', n), 3, 2) || substr(printf('%08X', n), 1, 2)"
_whole_query("rar", _rar_sql(f"'526172211A0700' || '00007400802B00' || {_LE32_SQL} || '{'00' * 15}0B0000000000'", 0.55))
_whole_query("rar5", _rar_sql(f"'526172211A070100' || '01020304' || printf('%02X', 22 + length({_vint_sql('n')})) || '0202' || {_vint_sql('n')} || '02' || {_vint_sql('n')} || '{'00' * 7}0B'", 0.60))
for _k in ("gzip", "bzip2", "xz"):
    _whole_query(_k, _ONE_SQL.format("'carved_0000.html'", 0.55) + " WHERE index = 0")


@_add("salvage_whole", f"{_BOXED_SQL}, k AS (SELECT blob_id, count(*) AS n, sum(octet_length(data))::BIGINT AS bytes FROM b GROUP BY blob_id) SELECT blob_id, 'zip' AS archive_type, 'ZIP Fail-Forward' AS method, n AS files_salvaged, bytes AS total_salvaged_bytes, 0 AS corruption_bypassed, 0.95::DOUBLE AS overall_confidence FROM k")
def salvage_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of undamaged archives."""
    reports = salvage.recover(_archives(spark, sf_dir, "zip", damaged=False), data=False)[1]
    return reports.select("blob_id", "archive_type", "method", "files_salvaged", "total_salvaged_bytes", "corruption_bypassed", "overall_confidence")


@_add("salvage_report")
def salvage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of pages recovered as raw blobs by the whole plan."""
    blobs = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("blob_id"), F.encode("html", "UTF-8").alias("content"))
    return salvage.recover(blobs, data=False)[1]


@_add("lzma_decode")
def lzma_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fault-tolerant LZMA over damaged streams: output size and what was lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract.lzma_scan(b[6:]) for b in batch.column(1).to_pylist()]
            columns = [[len(o) for o, _ in found], [s.resyncs for _, s in found], [s.zeroed for _, s in found], [s.tainted for _, s in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["blob_id", "size", "resyncs", "zeroed", "tainted"])

    return _archives(spark, sf_dir, "7z").mapInArrow(run, "blob_id bigint, size bigint, resyncs bigint, zeroed bigint, tainted bigint")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


