"""Recovery of built archives, whole and damaged, against what was put in."""

import hashlib
import io
import lzma
import zipfile

import pytest
from pyspark.sql import functions as F

from bytelode.functions import detect
from bytelode.operators import carve, disk, extract, plugins, report, validate, windows
from bytelode.plans import images, queries, salvage
from bytelode.sources import files as sources
from bytelode.streaming import arrivals

JPEG = bytes.fromhex("FFD8FFE00004AAAAFFC0000B080010001001011100FFDA0004AAAA") + b"\x11" * 40 + b"\xff\xd9"
PNG = bytes.fromhex("89504E470D0A1A0A0000000D4948445200000010000000100802000000") + b"\0" * 4 + b"\0\0\0\0IEND\xaeB\x60\x82"
PDF = b"%PDF-1.4\n% a page\nxref\nstartxref\n%%EOF\n"


def blobs(spark, *data):
    return spark.createDataFrame([(i, bytearray(d) if d is not None else None) for i, d in enumerate(data)], "blob_id int, content binary")


def recovered(spark, *data):
    files, reports = salvage.recover(blobs(spark, *data))
    return files.orderBy("blob_id", "index").collect(), {r["blob_id"]: r for r in reports.collect()}


def test_carve_files_of_all_kinds(spark, tmp_path):
    """The query keeps files of kinds whose ends are trimmed, and scores the trim."""
    pdf, gif = "%PDF-1.4\n" + "x" * 40 + "%%EOF\n", "GIF89a" + "y" * 40 + ";"
    pages = spark.createDataFrame([(1, "z" * 40 + pdf + "tail" * 9), (2, "z" * 9 + gif + "tail" * 9), (3, "z" * 99)], "page_id long, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    found = {r["page_id"]: (r["offset"], r["size"], r["sha256"], r["confidence"]) for r in queries.carve_files(spark, str(tmp_path)).collect()}
    assert found == {i: (at, len(t), hashlib.sha256(t.encode()).hexdigest(), 0.70) for i, at, t in ((1, 40, pdf), (2, 9, gif))}


def test_three_files_in_a_row(spark):
    data = JPEG + b"\0" * 10 + PNG + PDF
    found, reports = recovered(spark, data)
    assert [(r["offset"], r["size"]) for r in found] == [(0, len(JPEG)), (len(JPEG) + 10, len(PNG)), (len(JPEG) + 10 + len(PNG), len(PDF))]
    first = found[0]
    assert (first["file_type"], first["sha256"]) == ("JPEG Image", hashlib.sha256(JPEG).hexdigest())
    assert abs(first["confidence"] - 0.80) < 1e-9  # trimmed 0.70, complete +0.10
    assert reports[0]["files_salvaged"] == len(found)


def test_edge_blobs(spark):
    found, reports = recovered(spark, b"", None, b"\0", b"\xff" * 500, b"PK")
    assert found == [] and len(reports) == 5
    assert reports[0]["salvage_rate_percent"] == 0 and reports[0]["overall_confidence"] == 0


def test_zip_with_a_damaged_entry(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"alpha" * 20)
        z.writestr("b.jpg", JPEG)
    whole = out.getvalue()
    bad = bytearray(whole)
    bad[40] ^= 0xFF  # within a.txt, so that its CRC fails
    found, reports = recovered(spark, whole, bytes(bad))
    assert [r["name"] for r in found] == ["a.txt", "b.jpg"] * 2
    assert reports[0]["crc_errors"] == 0 and reports[1]["crc_errors"] == 1
    assert found[0]["confidence"] == pytest.approx(0.95) and found[2]["confidence"] == pytest.approx(0.90)


def test_zip_without_directory_is_carved(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("b.jpg", JPEG)
    found, _ = recovered(spark, out.getvalue()[:-40])
    assert "JPEG Image" in [r["file_type"] for r in found]


@pytest.mark.parametrize("kind", ["gzip", "bzip2", "xz", "tar", "rar", "7z", "zip"])
def test_boxes_give_back_their_page(spark, kind):
    text = "some words of a page " * 8
    page = b"<html>" + text.encode() + b"</html>" + b" " * 32
    found, _ = recovered(spark, queries._boxed(text, kind))
    if kind == "7z":  # zeros that stand for gaps may follow the page
        assert any(bytes(r["data"]).startswith(page[:-32]) for r in found)
    else:
        assert hashlib.sha256(page).hexdigest() in [r["sha256"] for r in found]


def test_truncated_streams_give_what_they_can():
    import bz2
    import gzip

    data = bytes(range(256)) * 4000
    for packed, make in ((gzip.compress(data), lambda: __import__("zlib").decompressobj(31)), (bz2.compress(data), bz2.BZ2Decompressor), (lzma.compress(data), lzma.LZMADecompressor)):
        assert extract.inflate(make, packed) == data
        part = extract.inflate(make, packed[:-20])
        assert data.startswith(part)


def test_lzma_tolerates_damage():
    data = b"text that compresses " * 50
    packed = lzma.compress(data, format=lzma.FORMAT_ALONE)
    assert extract.lzma_tolerant(packed)[0] == data
    out, stats = extract.lzma_scan(b"\0" * 32 + packed)
    assert data in out and stats.resyncs >= 1
    assert data in extract.lzma_scan(b"\xff" * 48 + packed)[0]
    assert extract.lzma_scan(b"") == (b"", extract.Stats())


def test_numbers_of_rar():
    assert extract.vint(b"\x05", 0) == (5, 1)
    assert extract.vint(b"\x85\x01", 0) == (133, 2)
    assert extract.vint(b"", 0) == (0, 0)


def test_fold_is_not_a_lag(spark):
    hits = spark.sql("select array(0, 3, 6, 11, 12, 40) o").select(F.transform("o", lambda x: F.struct(x.cast("bigint").alias("offset"), F.lit("x").alias("kind"))).alias("h"))
    assert [h["offset"] for h in hits.select(carve.keep_apart(F.col("h")).alias("k")).first()["k"]] == [0, 6, 11, 40]


def test_entropy_classes(spark):
    rows = spark.createDataFrame([(bytearray(b"a" * 100),), (bytearray(bytes(range(256)) * 4),), (bytearray(b"hello, some words"),)], "c binary")
    got = [r[0] for r in rows.select(detect.entropy_class(detect.entropy(F.col("c")))).collect()]
    assert got == ["flat", "noise", "valid"]


def test_walkers():
    assert validate.walk_jpeg(JPEG) == 3 and validate.walk_png(PNG) == 3
    assert validate.walk_jpeg(b"\xff\xd8\xff") == 0 and validate.walk_png(PNG[:20]) == 0


def test_windows_reject_an_overlap_that_never_advances(spark):
    with pytest.raises(ValueError):
        windows.windows(blobs(spark, b"x"), 10, 10)


def test_chunk_source(spark, tmp_path):
    path = tmp_path / "big.bin"
    path.write_bytes(bytes(range(100)) * 3)
    got = sources.chunks(spark, str(path), 100, 20).orderBy("window").collect()
    assert [r["start"] for r in got] == [0, 80, 160, 240]
    assert bytes(got[1]["content"]) == (bytes(range(100)) * 3)[80:180]


def test_plugins(spark, tmp_path):
    import json

    path = tmp_path / "p.json"
    path.write_text(json.dumps({"name": "x", "signatures": plugins.template()}))
    known = plugins.read(spark, str(path))
    assert known.count() == 2 and known.where(plugins.error(F.col("name"), F.col("extension"), F.col("magic"), F.col("end_marker")).isNotNull()).count() == 0
    data = b"\0" * 50 + bytes.fromhex("DEADBEEF") + b"x" * 60 + bytes.fromhex("CAFEBABE") + b"tail"
    got = plugins.carve(blobs(spark, data), known).collect()
    assert [(r["offset"], r["size"], r["confidence"]) for r in got] == [(50, 68, 0.65)]


def test_disk_partitions(spark):
    image = bytearray(64 << 10)
    image[446 + 4], image[446 + 8], image[446 + 12] = 0x83, 4, 8
    image[510:512] = b"\x55\xaa"
    image[4 * 512 + 1080 : 4 * 512 + 1082] = b"\x53\xef"
    got = disk.partitions(spark.createDataFrame([(1, image), (2, bytearray(100))], "image_id int, content binary")).collect()
    assert [(r["scheme"], r["label"], r["start_offset"], r["size"], r["filesystem"]) for r in got] == [("mbr", "Linux", 2048, 4096, "ext2/3/4")]


def test_taint(spark):
    ranges = spark.createDataFrame([(1, 0, 10), (1, 5, 12), (1, 20, 21), (2, 3, 3)], "k int, start bigint, end bigint")
    assert sorted((r["start"], r["end"]) for r in report.taint_intervals(ranges, "k").collect()) == [(0, 12), (20, 21)]
    assert report.taint_count(ranges, "k").first()["tainted"] == 13


def test_sinks(spark, tmp_path):
    files, reports = salvage.recover(blobs(spark, JPEG + b"\0" * 40))
    sources.write_files(files, str(tmp_path / "out"))
    assert [p.read_bytes() for p in (tmp_path / "out").rglob("*.jpg")] == [JPEG]
    packed = sources.zipped(files).first()["zip"]
    assert zipfile.ZipFile(io.BytesIO(bytes(packed))).namelist() == ["salvaged_0000.jpg"]
    assert '"archive_type":"unknown"' in sources.as_json(reports).first()["json"]


def test_arrivals(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.bin").write_bytes(JPEG + b"\0" * 40)
    (inbox / "b.bin").write_bytes(JPEG + b"\0" * 40)  # the same bytes once more
    query = arrivals.carve_arrivals(sources.arriving(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def lcg(seed):
    """x = x * 6364136223846793005 + 1 modulo 2^64, as the fixtures' damage is drawn."""
    x = seed
    while True:
        x = (x * 6364136223846793005 + 1) % (1 << 64)
        yield x


def zeroed(data, sectors):
    out = bytearray(data)
    for k in sectors:
        out[512 * k : 512 * k + 512] = bytes(len(out[512 * k : 512 * k + 512]))
    return bytes(out)


def flipped(data, n, seed):
    out, draw = bytearray(data), lcg(seed)
    for _ in range(n):
        x = next(draw)
        out[(x >> 16) % len(out)] ^= 1 << ((x >> 48) & 7)
    return bytes(out)


def worn(data, seed):
    """A tenth of the 4 KB blocks turns to ones."""
    out, draw, blocks = bytearray(data), lcg(seed), len(data) // 4096
    for _ in range(blocks // 10):
        at = (next(draw) >> 16) % blocks * 4096
        out[at : at + 4096] = b"\xff" * len(out[at : at + 4096])
    return bytes(out)


def seven_files():
    """Seven files as in a user's folder: (name, data, stored)."""
    noise = lambda n, seed: b"".join(x.to_bytes(8, "little") for x, _ in zip(lcg(seed), range(n // 8)))
    jpeg, png = JPEG[:-2] + noise(64_000, 1).replace(b"\xff", b"\xfe") + b"\xff\xd9", PNG[:-12] + noise(32_000, 2) + PNG[-12:]
    text = b"".join(b"line %d of the report\n" % k for k in range(900))
    return [("photos/vacation.jpg", jpeg, True), ("photos/screenshot.png", png, True), ("documents/report.txt", text, False), ("documents/invoice.pdf", PDF[:-6] + text[:4000] + PDF[-6:], True),
            ("config/settings.json", b'{"a": [1, 2, 3], "b": "c"}' * 40, False), ("bin/helper", b"\x7fELF" + noise(24_000, 3), True), ("data/manifest.xml", b"<m>" + b"<e/>" * 400 + b"</m>", False)]


def test_damaged_archives(spark):
    """How many of seven files come back whole, or at all, after each kind of damage."""
    out, files = io.BytesIO(), seven_files()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, stored in files:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    whole = out.getvalue()
    sectors = len(whole) // 512
    damage = {
        "none": whole, "one dead sector": zeroed(whole, [sectors // 3]), "a fifth of sectors": zeroed(whole, range(2, sectors, 5)),
        "no directory": whole[: whole.rfind(b"PK\x01\x02") - 400] + bytes(900), "half": whole[: len(whole) // 2], "bit flips": flipped(whole[:-600], 100, 5) + whole[-600:], "worn blocks": worn(whole, 9),
    }
    found, reports = recovered(spark, *damage.values())
    digests = {hashlib.sha256(d).hexdigest() for _, d, _ in files}
    counts = {name: (sum(r["blob_id"] == k for r in found), len({r["sha256"] for r in found if r["blob_id"] == k} & digests)) for k, name in enumerate(damage)}
    print(counts)
    assert counts["none"] == (7, 7) and counts["one dead sector"] == (7, 6)
    assert worn(whole, 9) != whole and counts["worn blocks"][1] < 7
    assert all(n >= 1 for n, _ in counts.values())  # what damage leaves depends on where it falls; the README has the counts


def test_hundred_files(spark):
    """A hundred stored files, intact, and with the last third zeroed."""
    out, kinds = io.BytesIO(), [("photo_%d.jpg", JPEG), ("image_%d.png", PNG), ("doc_%d.pdf", PDF), ("note_%d.txt", b"a note of some words. " * 9)]
    with zipfile.ZipFile(out, "w") as z:
        for k in range(100):
            z.writestr(zipfile.ZipInfo(kinds[k % 4][0] % k), kinds[k % 4][1] + str(k).encode() * (k % 4 == 3))
    whole = out.getvalue()
    found, reports = recovered(spark, whole, whole[: len(whole) * 7 // 10] + bytes(len(whole) - len(whole) * 7 // 10))
    assert sum(r["blob_id"] == 0 for r in found) == 100 and sum(r["blob_id"] == 1 for r in found) > 30
    assert reports[0]["files_salvaged"] == 100


def test_rar5(spark):
    """Names and bytes of stored files; a size that does not fit gives what is there."""
    items = [("docs/ä.txt", b"stored bytes " * 9), ("b.bin", b"\x01" * 200)]
    whole = queries._rar5(items)
    found, reports = recovered(spark, whole, whole[:-50], b"Rar!\x1a\x07\x01\x00" + bytes(200) + JPEG)
    named = {(r["blob_id"], r["name"]): bytes(r["data"]) for r in found}
    assert named[0, "docs/ä.txt"] == items[0][1] and named[0, "b.bin"] == items[1][1]
    assert named[1, "b.bin"] == items[1][1][:-50]
    assert "JPEG Image" in {r["file_type"] for r in found if r["blob_id"] == 2}
    assert reports[0]["method"] == "RAR v5 Parse + Raw Carve" and reports[2]["method"] == "RAR Raw Carve (fallback)"


def test_decoders_are_bounded():
    """Damage far into a stream is reached quickly, and output stops at the bound."""
    import gzip
    import time

    data = b"".join(x.to_bytes(8, "little") for x, _ in zip(lcg(4), range(1 << 20)))
    packed = bytearray(gzip.compress(data, 1))
    packed[-200_000:-199_000] = bytes(1000)
    began = time.time()
    got = extract.inflate(lambda: __import__("zlib").decompressobj(31), bytes(packed))
    assert time.time() - began < 10 and len(got) > len(data) * 9 // 10 and data.startswith(got[: len(data) * 9 // 10])
    bomb = gzip.compress(bytes(50 << 20))
    assert len(extract.inflate(lambda: __import__("zlib").decompressobj(31), bomb, 1 << 20)) == 1 << 20


def test_fold_over_blocks(spark):
    hits = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: F.struct((i * 3).cast("bigint").alias("offset"), F.lit("x").alias("kind"))).alias("h"))
    assert [h["offset"] for h in hits.select(carve.keep_apart(F.col("h")).alias("k")).first()["k"]] == list(range(0, 15000, 6))


def test_disk_scan(spark):
    """Files of partitions, of the space between, and once where both find them; small images have an error."""
    table = queries._TABLE
    first = table + JPEG.ljust(512, b"\0") + PNG + bytes(4000)
    files, reports = images.disk_scan(spark.createDataFrame([(1, bytearray(first)), (2, bytearray(100)), (3, bytearray(600)), (4, None)], "image_id int, content binary"))
    assert sorted((r["image_id"], r["partition"], r["file_type"], r["offset"]) for r in files.collect()) == [(1, -1, "JPEG Image", 512), (1, 0, "PNG Image", 0)]
    told = {r["image_id"]: r for r in reports.collect()}
    assert (told[1]["scheme"], told[1]["total_files"], len(told[1]["partitions"]), told[1]["whole_report"]["files_salvaged"]) == ("mbr", 2, 1, 2)
    assert told[2]["error"] == told[4]["error"] == "too small" and (told[3]["scheme"], told[3]["total_files"]) == ("unknown", 0)


def test_stream_salvage(spark):
    """Windows, plain blobs, and an archive that is also recovered as a whole."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.jpg", JPEG)
        z.writestr("b.txt", b"words " * 900)
    far = bytes(5000) + JPEG + bytes(100) + JPEG + bytes(3000) + PNG + bytes(900)
    files, reports = images.stream_salvage(blobs(spark, far, JPEG + bytes(50), out.getvalue(), b"", None), 2048, 256)
    found = {}
    for r in files.orderBy("blob_id", "index").collect():
        found.setdefault(r["blob_id"], []).append((r["offset"], r["file_type"], r["window"] < 0))
    assert found[0] == [(5000, "JPEG Image", False), (far.index(PNG), "PNG Image", False)] and found[1] == [(0, "JPEG Image", False)]
    assert [x[2] for x in found[2]][:2] == [True, True] and 3 not in found
    told = {r["blob_id"]: r for r in reports.collect()}
    assert told[0]["windows_processed"] == -(-len(far) // 1792) and told[1]["method"] == "Streaming → Raw Carve" and told[3]["method"] == "Streaming (empty file)"


def test_whole_reports(spark):
    """All fields in JSON, with files, in the two forms, and as text."""
    import json

    files, reports = salvage.recover(blobs(spark, b"7z\xbc\xaf\x27\x1c" + bytes(26) + lzma.compress(JPEG + bytes(40), format=lzma.FORMAT_ALONE), JPEG + bytes(40), b""))
    full = report.with_files(reports, files)
    short = {r["blob_id"]: json.loads(r["json"]) for r in sources.report_json(full).collect()}
    assert list(short[1]) == ["input", *sources.KEYS] and len(short[1]) == 14 and short[1]["files"][0]["sha256"] == hashlib.sha256(JPEG).hexdigest() and short[2]["files"] == []
    long = json.loads(sources.report_json(full, url=F.lit("/x")).where("blob_id = 0").first()["json"])
    assert set(long["zombie_stats"]) == set(sources.STATS) and long["download_url"] == "/x"
    assert "1 files" in sources.report_text(reports).where("blob_id = 1").first()["text"]


def test_plugin_engine(spark):
    """Own signatures take part in the whole recovery."""
    known = spark.createDataFrame([("Custom", "cst", "DEADBEEF", 0, 5000, "CAFEBABE")], "name string, extension string, magic string, offset bigint, max_size bigint, end_marker string")
    data = bytes(50) + bytes.fromhex("DEADBEEF") + b"x" * 60 + bytes.fromhex("CAFEBABE")
    files, _ = salvage.recover(blobs(spark, data), signatures=known)
    assert [(r["file_type"], r["offset"], r["size"]) for r in files.collect()] == [("Custom", 50, 68)]
