"""Token ids in a content-addressed store: chunks cut by a rolling hash, document recipes, and a Merkle manifest.

A store is a folder of Parquet tables in the file system of spark.checkpoint.dir, or any other that driver and executors share:
  chunks     hash binary (SHA-256 of the payload), payload binary: each distinct chunk once; ids as little-endian unsigned
             16-bit integers where all of a chunk's ids fit, else 32-bit, after a byte 2 or 4 that tells which
  recipes    seq, doc_id, start, n_tokens, hashes array<binary>: a row for each document, in ascending doc_id order
  manifest   level, node, hash: the Merkle tree over recipes; level 0 holds their hashes in groups of FAN, the last level the root
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, table

#: A chunk ends where the rolling hash of its last WINDOW ids has these bits zero, but not before LEAST ids and at MOST at the latest.
WINDOW = 8
MASK = (1 << 8) - 1
LEAST, MOST = 64, 1024
FAN = 256
#: Ranges of doc_id for the running sums.
RANGES = 256
#: Distinct pre-tokens whose ids a worker holds (and as many parts of texts), and distinct chunks that it remembers to have sent.
HELD = 600_000
SEEN = 200_000
#: Bytes as the characters that stand for them in the vocabulary of a byte-level model: printable ones of Latin-1 as themselves, the others from 256 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PLAIN]
BYTES = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}
#: What a part between two spaces must not begin with, for the pattern to cut before the space.
BLANK = re.compile(r"\s|\Z")


def splits_as_known(path: str) -> bool:
    """Whether the tokenizer of a file cuts texts by the public pattern, and changes nothing before."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    first = file.get("pre_tokenizer") or {}
    return all(file.get(x) is None for x in ("normalizer", "truncation", "padding")) and first.get("type") == "ByteLevel" and bool(first.get("use_regex", True)) and not first.get("add_prefix_space")


class Encoder:
    """The tokenizers library over distinct pre-tokens. Byte-pair merges never cross pre-tokens, so each is given to the library's model once and its ids are held. A tokenizer that cuts texts by another pattern gets whole texts.

    The public pattern always cuts before a space that a character other than a blank follows. So a text is cut at its spaces, and the ids of each part are held too; only new parts are cut by the pattern.
    A text with a space before a blank or at its end is cut by the pattern as a whole.
    """

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = not splits_as_known(path)
        self.held: dict[str, bytes] = {}
        #: What follows a space, up to the next: the ids of both; False if the pattern may not cut there.
        self.parts: dict[str, bytes | bool] = {}

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, words: set[str]) -> None:
        """Hold the ids of the pre-tokens."""
        tokenize, held = self.model.tokenize, self.held
        for w in words:
            if w not in held:
                ids = [t.id for t in tokenize(w.encode().decode("latin-1").translate(BYTES))]
                held[w] = np.array(ids, "<u4").tobytes() if len(ids) > 1 else ids[0].to_bytes(4, "little") if ids else b""

    def learn_parts(self, parts: set[str]) -> None:
        """Hold the ids of the parts, each with a space before it."""
        safe = [p for p in parts if not BLANK.match(p)]
        self.parts.update(dict.fromkeys(parts, False))
        words = self.split(" " + " ".join(safe)) if safe else []
        self.learn(set(words))
        starts = [i for i, w in enumerate(words) if w[0] == " "]
        if len(starts) != len(safe):
            raise RuntimeError("the pattern doesn't cut at spaces")
        held = self.held
        for p, a, b in zip(safe, starts, [*starts[1:], len(words)]):
            self.parts[p] = held[words[a]] if b - a == 1 else b"".join([held[w] for w in words[a:b]])

    def by_pattern(self, text: str) -> bytes:
        words = self.split(text)
        self.learn(set(words))
        return b"".join([self.held[w] for w in words])

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as the library gives them without special tokens added."""
        if len(self.held) > HELD or len(self.parts) > HELD:
            self.held.clear()
            self.parts.clear()
        cut = [None if self.whole or any(s in t for s in self.special) else t.split(" ") for t in texts]
        parts = self.parts
        known = [ps and list(map(parts.get, ps[1:])) for ps in cut]  # looked up once: most of the time goes into finding them in memory
        if missing := {p for ps, ids in zip(cut, known) if ps and None in ids for p, x in zip(ps[1:], ids) if x is None}:
            self.learn_parts(missing)
        for t, ps, ids in zip(texts, cut, known):
            if ps is None:
                yield np.array(self._plain(t), "<u4")
                continue
            found = [parts[p] if x is None else x for p, x in zip(ps[1:], ids)]
            yield np.frombuffer(self.by_pattern(t) if False in found else self.by_pattern(ps[0]) + b"".join(found), "<u4")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(text: str, path: str) -> list[int]:
    """Ids of the text, as the tokenizers library gives them without special tokens added."""
    return next(encoder(path).texts([text])).tolist()


def rolled(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where the rolling hash has its low bits zero: of ids of several texts, each with its place in its text."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(29)
    h = x.copy()
    short = np.flatnonzero(place < WINDOW - 1)
    for j in range(1, min(WINDOW, len(ids))):
        more = x[: len(ids) - j] * np.uint64(pow(0x5851F42D4C957F2D, j, 1 << 64))
        at = short[place[short] < j]
        more[at[at >= j] - j] = 0  # a text's window doesn't reach into the text before
        h[j:] += more
    h ^= h >> np.uint64(32)
    return h & np.uint64(MASK) == 0


def chunked(at: int, end: int, hits: list[int]) -> list[int]:
    """Where the chunks of the ids from at to end end; hits: after which ids the rolling hash allows it."""
    ends = []
    for c in hits:
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c - at >= LEAST:
            ends.append(c)
            at = c
    while end - at > MOST:
        at += MOST
        ends.append(at)
    if at < end:
        ends.append(end)
    return ends


def cuts(ids: np.ndarray) -> list[int]:
    """Where the chunks of an id stream end."""
    return chunked(0, len(ids), (np.flatnonzero(rolled(ids, np.arange(len(ids)))) + 1).tolist())


def cuts_of(texts: list[np.ndarray]) -> tuple[np.ndarray, list[list[int]]]:
    """The ids of texts, one after the other, and where the chunks of each end in them; no text may be empty."""
    n = np.array([len(x) for x in texts], np.int64)
    ids, ends = np.concatenate(texts), np.cumsum(n)
    hits = np.flatnonzero(rolled(ids, np.arange(len(ids)) - np.repeat(ends - n, n))) + 1
    first = np.searchsorted(hits, ends - n, "right").tolist()
    last = np.searchsorted(hits, ends, "right").tolist()
    hits = hits.tolist()
    return ids, [chunked(a, b, hits[i:j]) for a, b, i, j in zip((ends - n).tolist(), ends.tolist(), first, last)]


def pack(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        coder = encoder(path)
        last = np.array([end], "<u4")
        for whole in batches:
            for row in range(0, whole.num_rows, 256):
                b = whole.slice(row, 256)
                n, of, names, new, ends = [], [0], [], [], [0]
                payloads = []
                ids, cut = cuts_of([np.concatenate([x, last]) for x in coder.texts(b.column(1).to_pylist())])
                small = ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else None
                at = 0
                for own in cut:
                    n.append(own[-1] - at)
                    for e in own:
                        payload = b"\x02" + small[2 * at : 2 * e] if small is not None else pack(ids[at:e])
                        name = hashlib.sha256(payload).digest()
                        names.append(name)
                        if name not in seen:  # a copy within the task needn't be sent; the store keeps one of all tasks'
                            seen.add(name)
                            new.append(name)
                            payloads.append(payload)
                        at = e
                    of.append(len(names))
                    ends.append(len(new))
                if len(seen) > SEEN:
                    seen.clear()
                chunks = pa.StructArray.from_arrays([pa.array(new, pa.binary()), pa.array(payloads, pa.binary())], names=["hash", "payload"])
                hashes = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(names, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), hashes, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks)],
                    names=["doc_id", "n_tokens", "hashes", "chunks"],
                )

    return run


def write(docs: DataFrame, to: str, path: str, end: int = 2, id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append the end id, and write the store to the folder `to`.

    Nulls: a null text is an empty one; documents without an id come first. Repeated rows are documents of their own; ties are ordered by their length and chunks.
    An empty table gives an empty store whose root is the hash of nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    encoded = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    encoded = encoded.mapInArrow(_encode(path, end), "doc_id long, n_tokens long, hashes array<binary>, chunks array<struct<hash binary, payload binary>>")
    encoded.write.option("compression", "zstd").parquet(f"{to}/encoded")
    encoded = spark.read.parquet(f"{to}/encoded")
    chunks = encoded.select(F.explode("chunks").alias("c")).select("c.hash", "c.payload")
    chunks.dropDuplicates(["hash"]).write.option("compression", "zstd").parquet(f"{to}/chunks")
    recipes = placed(encoded.select("doc_id", "n_tokens", "hashes"))
    recipes = recipes.repartitionByRange(F.col("seq")).sortWithinPartitions("seq")
    recipes.write.parquet(f"{to}/recipes")
    drop(spark, f"{to}/encoded")
    level = leaves(spark.read.parquet(f"{to}/recipes"))
    depth = 0
    while True:
        at = f"{to}/manifest/level={depth}"
        level.write.parquet(at)
        level = spark.read.parquet(at)
        if level.limit(2).count() < 2:
            return
        level = parents(level)
        depth += 1


def placed(rows: DataFrame) -> DataFrame:
    """Recipes with seq (the document's number) and start (the ids before it), in ascending doc_id order, by sums over ranges of doc_id."""
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "hashes"]
    bounds = rows.agg(F.percentile_approx("doc_id", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))))
    rows = rows.withColumn("part", part)
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("ids"))
    sums = sums.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("seq0"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start0"))
    inside = Window.partitionBy("part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", (F.row_number().over(inside) - 1).alias("seq1"), (F.sum("n_tokens").over(running) - F.col("n_tokens")).alias("start1")).join(F.broadcast(sums), "part")
    return rows.select((F.col("seq0") + F.col("seq1")).alias("seq"), "doc_id", (F.col("start0") + F.col("start1")).alias("start"), "n_tokens", "hashes")


def recipe_hash() -> Column:
    """SHA-256 of a recipe: its numbers and its chunks' hashes."""
    head = F.concat_ws(",", F.col("seq"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("start"), F.col("n_tokens"))
    return F.sha2(F.concat_ws(",", head, F.concat_ws(",", F.transform("hashes", lambda h: F.lower(F.hex(h))))), 256)


def _folded(rows: DataFrame) -> DataFrame:
    together = F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])
    return rows.groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(F.sha2(F.concat_ws("", together), 256).alias("hash")).select(F.col("up").alias("node"), "hash")


def leaves(recipes: DataFrame) -> DataFrame:
    return _folded(recipes.select(F.col("seq").alias("node"), recipe_hash().alias("hash")))


def parents(level: DataFrame) -> DataFrame:
    return _folded(level.select("node", "hash"))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if hashlib.sha256(payload).digest() != name:
                raise ValueError(f"chunk {name.hex()} doesn't hold what its name says")
        yield b


def verified(spark: SparkSession, at: str) -> DataFrame:
    """The recipes of a store, after they have been held against its manifest, level by level up to the root."""
    recipes = spark.read.parquet(f"{at}/recipes")
    manifest = spark.read.parquet(f"{at}/manifest").select("level", "node", "hash")
    sizes = {r.level: r.n for r in manifest.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    top = max(sizes, default=0)
    # an empty store has one empty level, any other a root alone at the top
    if sorted(sizes) != list(range(len(sizes))) or sizes.get(top, 1) != 1:
        raise ValueError("the manifest has no root or lacks a level")
    own, bad = leaves(recipes), None
    for depth in range(top + 1):
        kept = manifest.where(F.col("level") == depth).select("node", "hash")
        other = own.join(kept.select(F.col("node").alias("n"), F.col("hash").alias("kept")), F.col("node") == F.col("n"), "full").where(~F.col("hash").eqNullSafe(F.col("kept"))).select(F.lit(depth).alias("level"))
        bad = other if bad is None else bad.unionByName(other)
        own = parents(kept)
    if bad.limit(1).count():
        raise ValueError("the recipes or a level of the manifest don't agree with the level above")
    return recipes


def read(spark: SparkSession, at: str) -> DataFrame:
    """seq, doc_id, start, n_tokens, i, payload: the verified chunks of every document, i numbering them. In order of seq and i they are the id stream.

    Each chunk is held against its hash, and the recipes against the manifest.
    """
    chunks = spark.read.parquet(f"{at}/chunks").mapInArrow(_check, "hash binary, payload binary")
    uses = verified(spark, at).select("seq", "doc_id", "start", "n_tokens", F.posexplode("hashes").alias("i", "of"))
    return uses.join(chunks, F.col("of") == F.col("hash"), "left").select("seq", "doc_id", "start", "n_tokens", "i", "payload")


#: The polynomial of CRC-32, bits reversed.
CRC = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32, bits reversed."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = b >> 1 ^ CRC if b & 1 else b >> 1
    return out


@cache
def _shift(n: int) -> int:
    """x to the power of 8 * n, modulo that polynomial."""
    out, square, n = 1 << 31, 1 << 30, 8 * n
    while n:
        if n & 1:
            out = _times(out, square)
        square = _times(square, square)
        n >>= 1
    return out


def crc_of_both(one: int, other: int, n: int) -> int:
    """CRC-32 of two byte strings one after the other, from their own; the second has n bytes."""
    return _times(_shift(n), one) ^ other


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of ids of each chunk, and their CRC-32 as 32-bit integers."""
    for b in _check(batches):
        ids = [unpack(x) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], names=["hash", "n", "crc"])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by seq and i: each document's checksum, from those of its chunks, one after the other."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    last, doc, crc, got = None, (), 0, 0

    def checked():
        if got != doc[2]:
            raise ValueError(f"document {doc[0]} has {got} ids in the store, not {doc[2]}")
        return (*doc, crc)

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4)], names=names)

    for b in batches:
        out = []
        for seq, *head, _, n, more in zip(*(c.to_pylist() for c in b.columns)):
            if seq != last:
                if last is not None:
                    out.append(checked())
                last, doc, crc, got = seq, tuple(head), 0, 0
            if n is None:
                raise ValueError(f"a chunk of document {head[0]} is missing")
            got += n
            crc = crc_of_both(crc, more, 4 * n)
        yield batch(out)
    if last is not None:
        yield batch([checked()])


def checksums(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from what the store gives back.

    Each chunk is read, verified and summed up once, however many documents share it; a document's checksum is put together from its chunks'.
    """
    recipes = verified(spark, at)
    chunks = spark.read.parquet(f"{at}/chunks").mapInArrow(_measure, "hash binary, n long, crc long")
    uses = recipes.select("seq", "doc_id", "start", "n_tokens", F.posexplode("hashes").alias("i", "of"))
    rows = uses.join(chunks, F.col("of") == F.col("hash"), "left").select("seq", "doc_id", "start", "n_tokens", "i", "n", "crc")
    return rows.repartition("seq").sortWithinPartitions("seq", "i").mapInArrow(_sum_up, "doc_id long, start long, n_tokens long, ids_crc32 long")


def drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def op10(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    to = f"{ensure_checkpoint_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), to, path or public_tokenizers.path("byte_bpe_50k.json"))
    return checksums(spark, to)
