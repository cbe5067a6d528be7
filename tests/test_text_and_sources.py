"""Label classes, URLs, image metadata, and JSON in and out."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmason.functions import text as texts
from gridmason.functions.polygon import shared_area
from gridmason.sources import formats, images
from gridmason.streaming import registry


@pytest.mark.parametrize(
    "text, tag",
    [("", "empty"), ("F4", "boothlike"), ("6X", "boothlike"), ("1031", "text"), ("cafe", "text"), ("f4", "text"), ("9 m²", "boothlike"), ("12 sqm", "boothlike"), ("Acme Industries", "text"), ("ACME LTD", "boothlike"), ("Fire exit", "facility"),
     ("A1 and then many more words than eight in all", "text")],
)
def test_tags(spark, text, tag):
    assert spark.createDataFrame([(text,)], "t string").select(texts.tag(F.col("t"))).first()[0] == tag


@pytest.mark.parametrize("name, stem", [("plan v1.pdf", "planv1"), ("a/b/ç.d.png", "ç.d"), ("???.png", "input"), (".hidden", ".hidden")])
def test_safe_stem(spark, name, stem):
    assert spark.createDataFrame([(name,)], "t string").select(texts.safe_stem(F.col("t"))).first()[0] == stem


def png():
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    rows = b"".join(b"\0" + bytes([x * 20, y * 30, 200] * 1) * 4 for y, x in ((0, 1), (1, 2), (2, 3)))
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02rest"


@pytest.mark.parametrize("raw", [png(), JPEG])
def test_metadata_round_trip(raw):
    assert images.read_metadata(raw) is None
    once = images.write_metadata(raw, "abc", "2024-01-01T00:00:00Z", {"n": "é1"})
    assert images.read_metadata(once) == {"phash": "abc", "date": "2024-01-01T00:00:00Z", "n": "é1"}
    assert images.write_metadata(once, "abc", "2025-01-01T00:00:00Z", {"n": "é1"}) == once
    again = images.write_metadata(once, "def", "2025-01-01T00:00:00Z")
    assert images.read_metadata(again) == {"phash": "def", "date": "2025-01-01T00:00:00Z", "n": "é1"}
    assert images.write_metadata(b"GIF89a", "a", "b") == b"GIF89a"


def exif(order, entries, inner, extra=b""):
    """A JPEG file with an EXIF segment: entries and inner are rows (tag, kind, count, four bytes)."""
    pack = lambda f, *v: struct.pack(order + f, *v)
    rows = lambda some: pack("H", len(some)) + b"".join(pack("HHI", t, k, n) + v for t, k, n, v in some) + pack("I", 0)
    at = 8 + 2 + 12 * (len(entries) + 1) + 4
    top = rows([*entries, (0x8769, 4, 1, pack("I", at))])
    body = b"Exif\0\0" + (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8) + top + rows(inner) + extra
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + JPEG[2:]


@pytest.mark.parametrize("order", ["<", ">"])
def test_other_exif_fields_stay(order):
    short = lambda v: struct.pack(order + "HH", v, 0)
    raw = exif(order, [(0x0112, 3, 1, short(6))], [(0xA002, 3, 1, short(640))], b"thumb")
    out = images.write_metadata(raw, "abc", "2024-01-01T00:00:00Z", {"n": "1"})
    out = images.write_metadata(out, "def", "2025-01-01T00:00:00Z")
    assert images.read_metadata(out) == {"phash": "def", "date": "2025-01-01T00:00:00Z", "n": "1"}
    (body,) = [b for _, marker, b in images.jpeg_segments(out) if marker == 0xE1]
    tiff = body[6:]
    at = lambda v: struct.unpack(order + "I", v)[0]
    top = images._directory(tiff, order, at(tiff[4:8]))
    assert top[0x0112][2] == short(6) and images._directory(tiff, order, at(top[images.EXIF_POINTER][2]))[0xA002][2] == short(640)
    assert b"thumb" in tiff and out.endswith(JPEG[2:])


def test_damaged_files_have_no_metadata():
    bad = png()[:-12] + struct.pack(">I4s", 9, b"zTXt") + b"phash\0\0xx" + bytes(4)
    cut = exif("<", [], [])[:40]
    for raw in (bad, cut, b"\xff\xd8\xff\xe1\x00", images.PNG, b"", None):
        assert images.read_metadata(raw) is None
    broken = exif("<", [], []).replace(b"II*\0" + struct.pack("<I", 8), b"II*\0" + struct.pack("<I", 60_000))
    assert images.read_metadata(images.write_metadata(broken, "a", "b")) == {"phash": "a", "date": "b"}


def test_images_from_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(images.write_metadata(png(), "p", "d"))
    read = images.read_images(spark, str(tmp_path))
    assert read.select("height", "width").first() == (3, 4)
    assert images.pixels(read.withColumn("page_id", F.lit(1))).where("y = 1 and x = 2").select("b", "g", "r").first() == (200, 30, 40)
    assert len(images.hashes(read).first().phash) == 16
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    assert raw.select(images.metadata(F.col("content"))).first()[0] == {"phash": "p", "date": "d"}
    assert raw.select(texts.content_type(F.col("content"))).first()[0] == "image/png"
    with pytest.raises(ValueError):
        images.load_pages(spark, str(tmp_path / "a.pdf"))


def test_pool_documents(spark, tmp_path):
    (tmp_path / "pool.json").write_text(json.dumps({"boxes": [{"bbox": [1, 2, 3, 4]}, {"bbox": [5, 6, 7, 8], "score": 0.5}]}))
    rows = formats.read_pool(spark, str(tmp_path / "pool.json")).orderBy("box_id").collect()
    assert [(r.x1, r.y2, r.score) for r in rows] == [(1.0, 4.0, 1.0), (5.0, 8.0, 0.5)]
    boxes = spark.createDataFrame([(0, 1, 0.0, 0.0, 4.0, 5.0, 1.0, "color")], "page_id long, box_id long, x1 double, y1 double, x2 double, y2 double, score double, source string")
    formats.write_boxes(boxes, str(tmp_path / "out"))
    got = spark.read.json(str(tmp_path / "out")).first()
    assert (got.n_boxes, got.boxes[0].area) == (1, 20.0)


def test_reviewed_results_and_halls(spark, tmp_path):
    (tmp_path / "kept.json").write_text(json.dumps({"kept": [{"bbox": [1, 2, 3, 4], "text_status": "boothlike", "source": "color"}, {"bbox": [5, 5, 0, 1], "text_status": "empty", "source": "bordered"}]}))
    rows = formats.read_reviewed(spark, str(tmp_path / "kept.json")).orderBy("box_id").collect()
    assert [(r.box_id, r.x1, r.y1, r.x2, r.y2, r.text_status) for r in rows] == [(0, 1.0, 2.0, 4.0, 6.0, "boothlike"), (1, 5.0, 5.0, 5.0, 6.0, "empty")]
    assigned = spark.createDataFrame([(0, 1, "Hall_1"), (0, 2, "Hall_1"), (0, 3, "Other")], "page_id long, box_id long, hall string")
    formats.write_halls(assigned, str(tmp_path / "halls"))
    assert sorted((r.hall, r.n_booths) for r in spark.read.json(str(tmp_path / "halls")).collect()) == [("Hall_1", 2), ("Other", 1)]


def test_the_largest_pool_is_recorded(spark):
    kind = "page_id long, boxes array<struct<bbox:array<double>,score:double,source:string>>"
    box = ([0.0, 0.0, 1.0, 1.0], 1.0, "color")
    got = formats.record_largest(spark.createDataFrame([(0, [box]), (0, [box, box]), (1, [])], kind)).orderBy("page_id").collect()
    assert [(r.page_id, r.n_calls, len(r.boxes)) for r in got] == [(0, 2, 2), (1, 1, 0)]


def test_archive_adds(spark, tmp_path):
    rows = spark.createDataFrame([("predict", "a b.png", bytearray(b"x"), "{}")], "endpoint string, name string, content binary, result string")
    for _ in range(2):
        formats.archive(rows, str(tmp_path / "archive"))
    got = spark.read.parquet(str(tmp_path / "archive")).collect()
    assert [(r.endpoint, r.name, r.result) for r in got] == [("predict", "ab", "{}")] * 2 and all(r.at and r.day for r in got)


def test_working_size_and_big_candidates(spark):
    from gridmason.plans.pages import big_candidates

    rows = spark.createDataFrame([(1000, 500), (400, 300), (2300, 10), (3000, 2000), (4600, 100)], "h int, w int")
    assert [round(r[0], 6) for r in rows.select(images.to_working_size(F.col("h"), F.col("w"))).collect()] == [2.3, 3.0, 1.0, 1.0, 0.5]
    found = [(0, 1, 0.0, 0.0, 400.0, 400.0), (0, 2, 0.0, 0.0, 395.0, 398.0), (0, 3, 0.0, 0.0, 300.0, 900.0), (0, 4, 0.0, 0.0, 2000.0, 2000.0)]
    got = big_candidates(spark.createDataFrame(found, "page_id long, box_id long, x1 double, y1 double, x2 double, y2 double"), F.lit(0.5), F.lit(4000.0 * 3000.0)).collect()
    assert [(r.box_id, r.x2, r.score, r.source) for r in got] == [(1, 800.0, 1.0, "bigregion")]


def test_polygons():
    square = [[0, 0], [2, 0], [2, 2], [0, 2]]
    assert shared_area(square, [[1, 1], [3, 1], [3, 3], [1, 3]]) == pytest.approx(1)
    assert shared_area(square, square[::-1]) == pytest.approx(4)
    assert shared_area(square, [[0, 0], [1, 1]]) == 0.0
    assert shared_area(square, [[5, 5], [6, 5], [6, 6]]) == 0.0


def test_registry_in_batches_and_streams(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert registry.load(spark, path).count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "n long, hash string")
    marked = registry.register(rows, registry.load(spark, path), "n")
    assert [r.status for r in marked.orderBy("n").collect()] == ["absent", "absent", "present"]
    registry.save(marked, path)
    assert [r.status for r in registry.register(rows, registry.load(spark, path), "n").collect()] == ["present"] * 3
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long, hash string").parquet(str(tmp_path / "in"))
    out = registry.first_seen(stream).writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("firsts").count() == 2
    for _ in range(2):
        registry.keep_registry(stream, str(tmp_path / "reg"), str(tmp_path / "c2"), "n").awaitTermination()
    assert registry.load(spark, str(tmp_path / "reg") + "/*").count() == 2


def test_small_helpers():
    a = np.zeros((16, 16))
    a[:8] = 255
    assert images.perceptual_hash(a) == images.perceptual_hash(a * 0.5)
