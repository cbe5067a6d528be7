"""Images: pixels through Spark's image reader, metadata inside PNG and JPEG files, perceptual hashes, and places for readers that need other libraries."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"
#: Marks the text of a user comment in EXIF, and its tag and the pointer's to the EXIF directory.
COMMENT, USER_COMMENT, EXIF_POINTER = b"ASCII\0\0\0", 0x9286, 0x8769


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, channels and data (rows of blue, green, red) of the images at path; a path without any fails."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def pixels(images: DataFrame, id: str = "page_id") -> DataFrame:
    """page_id, y, x, b, g, r of images with three channels."""
    n = F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)
    rows = images.where("channels = 3").select(id, "width", "data", F.explode(n).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * 3 + k + 1, F.lit(1))), 16, 10).cast("int")
    return rows.select(id, F.floor(F.col("i") / F.col("width")).alias("y"), (F.col("i") % F.col("width")).cast("long").alias("x"), byte(0).alias("b"), byte(1).alias("g"), byte(2).alias("r"))


def load_pages(spark: SparkSession, path: str, render: Callable[[bytes, int, int], list[np.ndarray]] | None = None, dpi: int = 200, page: int = 0) -> DataFrame:
    """Rasters at path: images by Spark's reader. PDF files need `render` (content, dpi, page) from a library that draws them; without one they fail, as a page beyond the end does."""
    if not path.lower().endswith(".pdf"):
        return read_images(spark, path)
    if render is None:
        raise ValueError("drawing PDF pages needs a renderer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for origin, content in zip(b["path"], b["content"]):
                pages = render(bytes(content), dpi, page)
                if not pages:
                    raise ValueError(f"{origin} has no page {page}")
                yield pd.DataFrame([{"origin": origin, "height": a.shape[0], "width": a.shape[1], "channels": a.shape[2], "data": a.tobytes()} for a in pages])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "origin string, height int, width int, channels int, data binary")


def recognise(images: DataFrame, reader: Callable[[], Callable[[np.ndarray], list[tuple[list, str, float]]]]) -> DataFrame:
    """page_id, span_id, text, conf, points: what a text recogniser finds. `reader` makes the recogniser, once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader()
        for b in batches:
            for r in b.itertuples():
                found = read(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels))
                yield pd.DataFrame({"page_id": r.page_id, "span_id": range(len(found)), "text": [t for _, t, _ in found], "conf": [c for *_, c in found], "points": [[list(map(float, p)) for p in box] for box, *_ in found]})

    return images.mapInPandas(run, "page_id long, span_id long, text string, conf double, points array<array<double>>")


# --- metadata ------------------------------------------------------------------------------------------------------------------


def png_chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG)
    while at + 8 <= len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        yield kind, raw[at + 8 : at + 8 + n]
        at += 12 + n


def png_texts(raw: bytes) -> dict[str, str]:
    """The text entries of a PNG file."""
    out = {}
    for kind, body in png_chunks(raw):
        key, _, rest = body.partition(b"\0")
        if kind == b"tEXt":
            out[key.decode("latin-1")] = rest.decode("latin-1")
        elif kind == b"iTXt" and len(rest) > 2:
            packed, text = rest[0], rest[2:].split(b"\0", 2)[-1]
            out[key.decode("latin-1")] = (zlib.decompress(text) if packed else text).decode()
        elif kind == b"zTXt":
            out[key.decode("latin-1")] = zlib.decompress(rest[1:]).decode("latin-1")
    return out


def jpeg_segments(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, marker, body) of the segments before the image data."""
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
        n = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        yield at, raw[at + 1], raw[at + 4 : at + 2 + n]
        at += 2 + n


def _directory(tiff: bytes, order: str, at: int) -> dict[int, tuple[int, int, bytes]]:
    """tag: (type, count, the four bytes of value or offset) of a TIFF directory."""
    n = struct.unpack(order + "H", tiff[at : at + 2])[0]
    rows = (struct.unpack(order + "HHI4s", tiff[at + 2 + 12 * i : at + 14 + 12 * i]) for i in range(n))
    return {tag: (kind, count, value) for tag, kind, count, value in rows}


def jpeg_comment(raw: bytes) -> str:
    """The user comment in a JPEG file's EXIF data; empty if there is none."""
    for _, marker, body in jpeg_segments(raw):
        if marker != 0xE1 or body[:6] != b"Exif\0\0":
            continue
        tiff = body[6:]
        order = "<" if tiff[:2] == b"II" else ">"
        place = lambda v: struct.unpack(order + "I", v)[0]
        top = _directory(tiff, order, place(tiff[4:8]))
        if EXIF_POINTER in top:
            inner = _directory(tiff, order, place(top[EXIF_POINTER][2]))
            if USER_COMMENT in inner:
                _, n, value = inner[USER_COMMENT]
                whole = tiff[place(value) : place(value) + n] if n > 4 else value[:n]
                return whole[8:].decode("utf-8", "replace").rstrip("\0")
    return ""


def _rows(tiff: bytes, order: str, at: int) -> tuple[dict[int, bytes], bytes]:
    """(the entries of a TIFF directory by tag, as they stand; the offset of the next one, as it stands)."""
    n = struct.unpack(order + "H", tiff[at : at + 2])[0]
    rows = [tiff[at + 2 + 12 * i : at + 14 + 12 * i] for i in range(n)]
    if any(len(r) < 12 for r in rows):
        raise ValueError("a TIFF directory is cut off")
    return {struct.unpack(order + "H", r[:2])[0]: r for r in rows}, tiff[at + 2 + 12 * n : at + 6 + 12 * n].ljust(4, b"\0")


def _with_comment(tiff: bytes, comment: bytes) -> bytes:
    """TIFF data with another user comment. The two directories that lead to it are written anew at the end; whatever else there is stays in its place, so offsets into it hold."""
    order = {b"II": "<", b"MM": ">"}[tiff[:2]]
    pack = lambda f, *v: struct.pack(order + f, *v)
    place = lambda v: struct.unpack(order + "I", v)[0]
    out = bytearray(tiff + b"\0" * (len(tiff) % 2))

    def add(rows: dict[int, bytes], after: bytes) -> int:
        at = len(out)
        out.extend(pack("H", len(rows)) + b"".join(rows[t] for t in sorted(rows)) + after)
        return at

    text = COMMENT + comment
    at = len(out)
    out.extend(text + b"\0" * (len(text) % 2))
    top, after_top = _rows(tiff, order, place(tiff[4:8]))
    inner, after = _rows(tiff, order, place(top[EXIF_POINTER][8:])) if EXIF_POINTER in top else ({}, bytes(4))
    inner[USER_COMMENT] = pack("HHII", USER_COMMENT, 7, len(text), at)
    top[EXIF_POINTER] = pack("HHII", EXIF_POINTER, 4, 1, add(inner, after))
    out[4:8] = pack("I", add(top, after_top))
    return bytes(out)


def _exif(comment: bytes, old: bytes | None = None) -> bytes:
    """An EXIF segment with a user comment, and with what an old one's TIFF data hold besides, unless they are damaged or leave no room."""
    bare = b"II*\0" + struct.pack("<I", 8) + struct.pack("<HI", 0, 0)
    try:
        tiff = _with_comment(old or bare, comment)
    except (ValueError, KeyError, struct.error):
        tiff = b""
    if not tiff or len(tiff) > 0xFFFF - 8:
        tiff = _with_comment(bare, comment)
    return b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff


def read_metadata(raw: bytes | None) -> dict[str, str] | None:
    """phash, date and whatever else was stored, or None: a JPEG file's from JSON in its comment, a PNG file's from its texts, which must have both. A damaged file has none."""
    raw = bytes(raw or b"")
    try:
        if raw.startswith(PNG):
            found = png_texts(raw)
        elif raw.startswith(b"\xff\xd8\xff"):
            found = json.loads(jpeg_comment(raw) or "{}")
        else:
            return None
    except (ValueError, struct.error, zlib.error):
        return None
    if not isinstance(found, dict) or not found.get("phash") or not found.get("date"):
        return None
    return {str(k): str(v) for k, v in found.items()}


def write_metadata(raw: bytes | None, phash: str, date: str, extra: dict[str, str] | None = None) -> bytes:
    """The file with the metadata in it, and all else that it holds: unchanged if it holds the same phash, a date and all extras, or is of another format or too damaged to take any."""
    raw = bytes(raw or b"")
    have = read_metadata(raw) or {}
    extra = {k: str(v) for k, v in (extra or {}).items()}
    if have.get("phash") == phash and have.get("date") and all(have.get(k) == v for k, v in extra.items()):
        return raw
    values = {**have, **extra, "phash": phash, "date": date}
    if raw.startswith(PNG):
        keep = [(k, b) for k, b in png_chunks(raw) if not (k in (b"tEXt", b"zTXt", b"iTXt") and b.partition(b"\0")[0].decode("latin-1") in values)]
        texts = [(b"iTXt", k.encode("latin-1") + b"\0\0\0\0\0" + v.encode()) for k, v in values.items()]
        chunks = [*keep[:1], *texts, *keep[1:]]
        return PNG + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in chunks)
    if raw.startswith(b"\xff\xd8\xff"):
        try:
            old = [(at, body) for at, marker, body in jpeg_segments(raw) if marker == 0xE1 and body[:6] == b"Exif\0\0"]
        except struct.error:
            return raw
        segment = _exif(json.dumps(values).encode(), old[0][1][6:] if old else None)
        at, length = (old[0][0], len(old[0][1]) + 4) if old else (2, 0)
        return raw[:at] + segment + raw[at + length :]
    return raw


def metadata(content: Column) -> Column:
    """The metadata of files, as a map; null where there is none."""

    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([None if (m := read_metadata(x)) is None else json.dumps(m) for x in raw], dtype=object)

    return F.from_json(F.pandas_udf(run, "string")(content), "map<string,string>")


# --- hashes --------------------------------------------------------------------------------------------------------------------


def perceptual_hash(gray: np.ndarray, side: int = 8, sample: int = 32) -> str:
    """Hex digits of the signs of an image's lowest cosine coefficients against their median. The image is averaged to `sample` squared first."""
    rows, cols = (np.linspace(0, n, sample + 1).astype(int) for n in gray.shape)
    small = np.array([[gray[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:])] for a, b in zip(rows, rows[1:])])
    k = np.arange(sample)
    basis = np.cos(np.pi / sample * (k[None, :] + 0.5) * k[:side, None])
    low = basis @ small @ basis.T
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{side * side // 4}x}"


def hashes(images: DataFrame) -> DataFrame:
    """origin, phash, sha1 of each image: the perceptual hash, and the SHA-1 of its bytes where it has no pixels."""

    def phash(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        def one(h, w, c, d):
            if not h or not w:
                return None
            a = np.frombuffer(d, np.uint8).reshape(h, w, c).astype(float)
            return perceptual_hash(a[..., :3] @ [0.114, 0.587, 0.299] if c >= 3 else a[..., 0])

        return pd.Series([one(*x) for x in zip(height, width, channels, data)])

    p = F.pandas_udf(phash, "string")("height", "width", "channels", "data")
    return images.select("origin", F.sha1("data").alias("sha1"), F.coalesce(p, F.sha1("data")).alias("phash"))


def to_working_size(height: Column, width: Column, target: int = 2300, most: float = 3.0) -> Column:
    """The scale that brings a page's long side to the target: up by `most` at most, down only from 1.6 times the target."""
    long_side = F.greatest(height, width)
    return F.when(long_side < target, F.least(F.lit(most), target / long_side)).when(long_side > 1.6 * target, target / long_side).otherwise(F.lit(1.0))
