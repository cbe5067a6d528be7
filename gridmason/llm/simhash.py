"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, and links verified by Hamming distance."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.graph import union_find
from .common import release, stored, table, tidy
from .graph import components

BITS = 64
#: Fingerprints are cut into this many blocks or more. Of two that differ in at most DISTANCE bits, all blocks but DISTANCE or more agree.
BLOCKS = 6
DISTANCE = 4
#: Fingerprints that share a key by chance, on average, at most.
CROWD = 4
SEED = 42
#: A bucket with more fingerprints than this is searched in tiles, by several tasks.
TILE = 1 << 16
#: Shingles hashed before their bits are summed.
BATCH = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of a text: a bit is 1 if more than half of the shingles' hashes have it; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(joined, SEED)
    ends = list(itertools.accumulate(map(len, words), lambda a, x: a + x + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BATCH):
        to = min(n, at + BATCH)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:to], ends[at + shingle - 1 : to + shingle - 1])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """docs, with fp long (the fingerprint, as a signed number) in place of the text. Texts are split at ASCII blanks; A-Z are lower-cased."""
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in b.column(len(keep)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fps)], names=[*keep, "fp"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def blocks_for(n: int) -> int:
    """The number of blocks for n distinct fingerprints: the keys, of all blocks but DISTANCE, widen with it, so that chance buckets don't grow with the corpus. 6 up to some 10 million, 8 up to 17 billion."""
    blocks = BLOCKS
    while BITS * (blocks - DISTANCE) // blocks < math.log2(max(n, 1) / CROWD) and blocks < 16:
        blocks += 1
    return blocks


def block_masks(blocks: int = BLOCKS) -> list[int]:
    """For each choice of blocks that may agree, a mask of their bits."""
    at = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(at)]
    return [sum(c) for c in itertools.combinations(parts, blocks - DISTANCE)]


def _near(one: np.ndarray, other) -> np.ndarray:
    return np.bitwise_count(one ^ other) <= DISTANCE


def forest(fps: np.ndarray) -> Iterator[tuple[np.uint64, np.uint64]]:
    """Edges of a spanning forest of the links among fps: each step takes a reached fingerprint and links what it reaches anew."""
    rest = fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            hit = _near(rest, x)
            if hit.any():
                for y in rest[hit]:
                    yield x, y
                    frontier.append(y)
                rest = rest[~hit]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: a spanning forest of the links in each. A bucket with at most TILE fingerprints, or a tile of two such, is held at a time."""
    held: list[np.ndarray] = []

    def edges(k: np.ndarray, t: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
        n = np.diff(np.r_[first, len(k)])
        a, b = [], []
        two = first[n == 2]
        hit = two[_near(fps[two], fps[two + 1])]
        a.append(fps[hit])
        b.append(fps[hit + 1])
        for at, m in zip(first[n > 2], n[n > 2]):
            if found := list(forest(fps[at : at + m])):
                x, y = zip(*found)
                a.append(np.array(x, np.uint64))
                b.append(np.array(y, np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols[2] = cols[2].astype(np.int64).view(np.uint64)
        held = [np.concatenate(x) for x in zip(held, cols)] if held else cols
        k, t, fps = held
        if not len(k):
            continue
        last = np.flatnonzero((k != k[-1]) | (t != t[-1]))
        end = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
        if end:
            yield edges(k[:end], t[:end], fps[:end])
            held = [x[end:] for x in held]
    if held and len(held[0]):
        yield edges(*held)


def link_forest(fps: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """a, b: links among the distinct fingerprints in column fp that connect whatever all links connect.

    For each choice of blocks, fingerprints that agree in them meet in a bucket, where Hamming distances are verified. Buckets are read in sorted order,
    a step from each fingerprint to those not yet reached, so that a dense group of n costs n steps and n - 1 edges and not all its pairs.
    A bucket above TILE is dealt to tiles by hash: each pair of its parts meets in one tile.
    """
    choices = [F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m - (1 << BITS) if m >> (BITS - 1) else m)).alias("k")) for i, m in enumerate(block_masks(blocks))]
    keyed = fps.select("fp", F.explode(F.array(*choices)).alias("e")).select("fp", F.xxhash64("e.c", "e.k").alias("k"))
    return _dealt(keyed, "fp").mapInArrow(_links, "a long, b long").distinct()


def _dealt(keyed: DataFrame, id: str, broadcast: bool = False) -> DataFrame:
    """keyed (k, and the column id), with t, the tile: dealt out and sorted by bucket and tile. A bucket above TILE becomes tiles by the hash of id; each pair of its parts meets in one.

    With broadcast, the names of the large buckets (one for TILE rows at most) go to every task, and the rows are shuffled once.
    """
    large = keyed.groupBy(F.col("k").alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    joined = keyed.join(F.broadcast(large) if broadcast else large, F.col("k") == F.col("of"), "left")
    parts = F.ceil(2 * F.col("n") / TILE)
    own = F.pmod(F.xxhash64(id), parts)
    tiles = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j)))
    others = [c for c in keyed.columns if c != "k"]
    return joined.select("k", F.explode(tiles).alias("t"), *others).repartition("k", "t").sortWithinPartitions("k", "t")


def classes(docs: DataFrame, shingle: int = 5, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, fp, component_id: each document's fingerprint, and the smallest id among those it is linked with, itself included, step by step.

    Documents with the same fingerprint are merged before the search; links are sought among distinct fingerprints only.
    A null text counts as empty: fingerprint 0, linked like any other. Null ids are never the smallest. Repeated rows stay.
    An empty table gives an empty result. Other columns are ignored.
    """
    marked = stored(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), shingle))
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(link_forest(distinct.select("fp"), blocks_for(distinct.count())))
    linked = stored(roots.join(distinct, F.col("node") == F.col("fp")).select("fp", "low", "root"))
    # written, so that the join by root has nothing but exchanges below it, of which large parts can be split
    least = stored(linked.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("least")))
    moved = linked.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("of"), "least")
    of = distinct.join(moved, F.col("fp") == F.col("of"), "left").select(F.col("fp").alias("own"), F.when(F.col("of").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))
    # written for the same reason: one fingerprint may be that of very many copies
    return marked.join(stored(of), F.col("fp") == F.col("own")).select(F.col("id").alias(id), "fp", "component_id")


def op5(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of documents, as classes has them: a null text is an empty one, null ids are never a component's, repeated rows stay, an empty table gives no rows."""
    out = classes(table(spark, sf_dir, "documents"), shingle=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- classes by similarity -----------------------------------------------------------------------------------------------------

#: Bits of a wide fingerprint, as 64-bit words.
WORDS = 8
#: A pair whose fingerprints are as far apart as is usual at the similarity asked for shares a block with this probability at least.
RECALL = 0.999
#: Fingerprints this many standard deviations further apart than usual at the similarity asked for are still candidates.
SPREAD = 4
#: Words of a wide fingerprint that go with each key while clusters are sought.
SHORT = 4
#: In buckets of up to so many, all pairs are held against one another at once; so many pairs at a time.
FEW, PAIRS = 48, 1 << 17
#: Bits by which rows that can't be meant are left out before a join: a whole number of Spark's bitmaps of 32,768 bits, 2 MB in all.
MAYBE = 1 << 24


def turned(similarity: float) -> float:
    """The share of bits in which the fingerprints of two texts differ on average, whose sets of shingles have this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(similarity: float, words: int = WORDS, spread: float = SPREAD) -> int:
    """The largest distance of candidates, by so many words of their fingerprints."""
    n, p = 64 * words, turned(similarity)
    return int(n * p + spread * math.sqrt(n * p * (1 - p)))


def plan_blocks(n: int, similarity: float) -> np.ndarray:
    """The bits of each block (a row a block), for n distinct fingerprints: wide enough that unlike ones rarely share a block, and as many as RECALL needs.

    Each permutation of the bits is cut into blocks from its start; so pairs that differ in fewer bits than one permutation has blocks always share one.
    """
    wide = max(16, math.ceil(math.log2(max(n, 2))) - 2)
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - turned(similarity)) ** wide))
    rng = np.random.default_rng(SEED)
    each = 64 * WORDS // wide
    cuts_ = [rng.permutation(64 * WORDS)[: each * wide].reshape(each, wide) for _ in range(-(-count // each))]
    return np.concatenate(cuts_)[: max(count, each)]


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 of each distinct shingle, sorted; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ends = list(itertools.accumulate(map(len, words), lambda a, x: a + x + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    last = ends[min(shingle, len(words)) - 1 :]
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, last)], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The SimHash of 64 * WORDS bits of a set of shingles: each hash is mixed into WORDS numbers. All zeros for an empty set."""
    ones = np.zeros(64 * WORDS, np.int64)
    salts = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), BATCH // 16):
        h = hashes[at : at + BATCH // 16, None] + salts
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _sig(hashes: np.ndarray) -> int:
    """The XXH64 of a set of shingles, as a signed number: sets with the same are one node."""
    x = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _key_blocks(blocks: np.ndarray, words: int):
    """From rows (sig, fp): for each block a row (k, sig, fp), of the first words of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.uint64(1) << np.arange(blocks.shape[1], dtype=np.uint64)
        n = blocks.shape[0]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                fps = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                bits = np.unpackbits(fps, axis=1).astype(np.uint64)
                keys = np.stack([(bits[:, rows] * weights).sum(axis=1) | np.uint64(i << 48) for i, rows in enumerate(blocks)], axis=1)
                short = np.repeat(fps[:, : 8 * words], n, axis=0)
                held = pa.Array.from_buffers(pa.binary(8 * words), len(short), [None, pa.py_buffer(short.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), n)), held], names=["k", "sig", "fp"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch], arrays) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """From rows (k, t, …) sorted by bucket and tile: the columns of some whole buckets, as arrays() makes them of a batch, where each bucket starts, and its number of rows."""
    held: list[np.ndarray] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            cols = arrays(batch)
            held = [np.concatenate(x) for x in zip(held, cols)] if held else cols
        if not held or not len(held[0]):
            continue
        k, t = held[:2]
        change = np.flatnonzero((k[1:] != k[:-1]) | (t[1:] != t[:-1])) + 1
        end = len(k) if batch is None else change[-1] if len(change) else 0
        starts = np.r_[0, change]
        starts = starts[starts < end]
        yield [x[:end] for x in held], starts, np.diff(np.r_[starts, end])
        held = [x[end:] for x in held]


def _few(starts: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each bucket of up to FEW rows."""
    for m in np.unique(n[(n > 1) & (n <= FEW)]):
        i, j = np.triu_indices(m, 1)
        own = starts[n == m]
        for some in np.array_split(own, -(-len(own) * len(i) // PAIRS)):
            yield (some[:, None] + i).ravel(), (some[:, None] + j).ravel()


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([x[i] for x in found] or [np.empty(0, np.int64)]).astype(np.int64) for i in (0, 1))


def _wide_links(most: int, words: int):
    """From rows (k, t, sig, fp) sorted by bucket and tile: edges that connect what the candidates in each connect."""

    def far(fps: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps ^ x).sum(axis=-1, dtype=np.int64)

    def near(fps: np.ndarray, starts: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of candidates: all pairs of small buckets; of large ones a step from each row to those not yet reached."""
        for a, b in _few(starts, n):
            hit = far(fps[a], fps[b]) <= most
            yield a[hit], b[hit]
        for at, m in zip(starts[n > FEW], n[n > FEW]):
            rest = np.arange(at, at + m)
            while len(rest) > 1:
                frontier, rest = [rest[0]], rest[1:]
                while frontier and len(rest):
                    x = frontier.pop()
                    hit = far(fps[rest], fps[x]) <= most
                    if hit.any():
                        yield np.full(hit.sum(), x), rest[hit]
                        frontier += list(rest[hit])
                        rest = rest[~hit]

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [*(c.to_numpy() for c in batch.columns[:-1]), np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), np.uint64).reshape(-1, words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, sig, fps), starts, n in _buckets(batches, arrays):
            low = union_find(len(sig), *_edges(list(near(fps, starts, n))))  # of a dense bucket, as many edges as it has rows
            a = np.flatnonzero(low != np.arange(len(sig)))
            b = low[a]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sig[a], sig[b])), pa.array(np.maximum(sig[a], sig[b]))], names=["a", "b"])

    return run


def _prefixes(similarity: float):
    """From rows (cluster, sig, label, hashes, middle): for each hash of a set's prefix a row (k, sig, label, size, place).

    A cluster's hashes are in one order: first those that aren't in its middle text, then the others, by value. If sets of n and m hashes have a Jaccard similarity s, they share s / (1 + s) * (n + m) hashes; so
    the first that they share has no more than n and m less that many before it, and lies among the first n - s * n + 1 of either. Texts that differ enough from the middle have such prefixes of hashes of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                keys, own, sizes, places = [np.empty(0, np.int64)], [], [], [np.empty(0, np.int64)]
                for cluster, hashes, middle in zip(b.column(0).to_pylist(), b.column(3), b.column(4)):
                    h = hashes.values.to_numpy()
                    n = len(h)
                    kept = h[np.argsort(np.isin(h, middle.values.to_numpy()), kind="stable")][: n - math.ceil(similarity * n - 1e-9) + 1] if n else h
                    keys.append(kept ^ np.int64(cluster))  # texts of other clusters that meet by chance are told apart where pairs are verified
                    places.append(np.arange(len(kept)))
                    own.append(len(kept))
                    sizes.append(n)
                sig, label = (np.repeat(b.column(i).to_numpy(), own) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.concatenate(keys), sig, label, np.repeat(sizes, own), np.concatenate(places))], names=["k", "sig", "label", "size", "place"])

    return run


def _sharing(similarity: float):
    """From rows (k, t, sig, label, size, place) sorted by bucket and tile: pairs of unlike labels that can be similar enough if this hash is the first that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, sig, label, size, place), starts, n in _buckets(batches, lambda batch: [c.to_numpy() for c in batch.columns]):

            def hits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                least = np.ceil(similarity / (1 + similarity) * (size[a] + size[b]) - 1e-9)
                return (label[a] != label[b]) & (place[a] <= size[a] - least) & (place[b] <= size[b] - least)

            found = [(a[hit], b[hit]) for a, b in _few(starts, n) for hit in [hits(a, b)]]
            for at, m in zip(starts[n > FEW], n[n > FEW]):
                rows = np.arange(at, at + m)
                labels, of, count = np.unique(label[rows], return_inverse=True, return_counts=True)
                for x in rows[of != count.argmax()]:  # pairs within the most common label are of no use
                    hit = hits(np.full(m, x), rows)
                    found.append((np.full(hit.sum(), x), rows[hit]))
            a, b = _edges(found)
            both = np.unique(np.stack([np.minimum(sig[a], sig[b]), np.maximum(sig[a], sig[b])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["a", "b"])

    return run


def _maybe(rows: DataFrame, id: Column, few: DataFrame, of: Column) -> DataFrame:
    """rows, with maybe: true wherever id is among the ids `of` of few, and for some other rows; so that a join with few needs to shuffle little. The bits, of bounded size, go to every task."""
    hashed = lambda x: F.pmod(F.xxhash64(x), F.lit(MAYBE)).cast("long")
    bits = few.select(hashed(of).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bitmap")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    at = F.bitmap_bit_position(hashed(id)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return rows.join(F.broadcast(stored(bits)), F.bitmap_bucket_number(hashed(id)) == F.col("bitmap"), "left").select(*[F.col(c) for c in rows.columns], found.alias("maybe"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (cluster, fp): how many rows of a cluster, here, have each bit."""
    held: dict[int, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["cluster", "counts"])

    for b in batches:
        bits = np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1)
        for c, own in zip(b.column(0).to_pylist(), bits):
            held[c] = held.get(c, 0) + np.r_[own, 1].astype(np.int32)
            if len(held) > 2000:
                yield out()
                held.clear()
    yield out()


def _majority(group: pa.Table) -> pa.Table:
    """The bits that more than half of a cluster's rows have."""
    counts = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in group.column("counts").to_pylist())
    return pa.table({"of_cluster": group.column("cluster")[:1], "middle": pa.array([np.packbits(2 * counts[:-1] > counts[-1]).tobytes()], pa.binary())})


def _off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (cluster, sig, fp, middle): how far each fingerprint is from the middle."""
    for b in batches:
        one, other = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64))], names=["cluster", "sig", "off"])


def _similar(named: DataFrame, shingle: int, similarity: float, unique: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, sig, fp of each row; sig, fp, low of each distinct text; node, label of each sig that has a candidate). named: id, of any type that has an order, and text. unique: no id comes twice."""
    spark, id_type = named.sparkSession, named.schema["id"]

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(_sig(s), wide_fingerprint(s)) for s in (shingle_set(x, shingle) for x in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "sig", "fp"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [shingle_set(x, shingle) for x in b.column(2).to_pylist()]
                own = [i for i, (s, sig) in enumerate(zip(sets, b.column(1).to_pylist())) if _sig(s) == sig]  # an id may have further texts
                kept = b.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns[:2], pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], names=["cluster", "sig", "hashes"])

    marked = stored(named.select("id", "text").mapInArrow(marks, StructType([id_type]).add("sig", "long").add("fp", "binary")))
    distinct = stored(marked.groupBy("sig", "fp").agg(F.min("id").alias("low")))
    blocks = plan_blocks(distinct.count(), similarity)

    keyed = distinct.select("sig", "fp").mapInArrow(_key_blocks(blocks, SHORT), "k long, sig long, fp binary")
    loose = stored(_dealt(keyed, "sig", True).mapInArrow(_wide_links(most_bits(similarity, SHORT), SHORT), "a long, b long").distinct())
    tidy(spark)
    clusters = stored(components(loose).withColumnRenamed("root", "cluster"))
    tidy(spark)
    needed = stored(distinct.join(clusters, F.col("sig") == F.col("node")).select(F.col("low").alias("of"), "cluster", "sig"))
    sets = _maybe(named, F.col("id"), needed, F.col("of")).where("maybe").join(needed, F.col("id") == F.col("of")).select("cluster", "sig", "text").mapInArrow(sets_of, "cluster long, sig long, hashes array<long>")
    sets = stored(sets if unique else sets.dropDuplicates(["sig"]))
    release(needed)
    tidy(spark)

    def alike(a: str, b: str) -> Column:
        both = F.size(F.array_intersect(a, b))
        return both / (F.size(a) + F.size(b) - both) >= similarity

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: sets.select(F.col("sig").alias(c), F.col("hashes").alias(f"h{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(alike("ha", "hb")).drop("ha", "hb")

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        """labels after links la, lb between them."""
        moved = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("was"), F.col("root").alias("now"))
        out = stored(labels.join(moved, F.col("label") == F.col("was"), "left").select("node", "cluster", F.coalesce("now", "label").alias("label")))
        release(labels)
        tidy(spark)
        return out

    def apart(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        return pairs.join(own("a"), "a").join(own("b"), "b").where("la != lb")

    def still_mixed(labels: DataFrame) -> DataFrame | None:
        """node, cluster, label in clusters of several labels; None if there are no such."""
        mixed = labels.groupBy(F.col("cluster").alias("c")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("c")
        rest = stored(labels.join(mixed, F.col("cluster") == F.col("c"), "left_semi"))
        return None if rest.isEmpty() else rest

    def middles(rest: DataFrame) -> DataFrame:
        """c, lb, hb: of each cluster, the label and the set of the text whose fingerprint is nearest to what most of its fingerprints have: what a text's copies have in common is near the text."""
        prints = stored(rest.join(distinct, F.col("node") == F.col("sig")).select("cluster", "sig", "fp"))
        middle = prints.select("cluster", "fp").mapInArrow(_counted, "cluster long, counts binary").groupBy("cluster").applyInArrow(_majority, "of_cluster long, middle binary")
        off = prints.join(stored(middle), F.col("cluster") == F.col("of_cluster")).select("cluster", "sig", "fp", "middle").mapInArrow(_off, "cluster long, sig long, off long")
        hubs = stored(off.groupBy(F.col("cluster").alias("c")).agg(F.min(F.struct("off", "sig")).alias("best")).select("c", F.col("best.sig").alias("hub")))
        out = stored(hubs.join(rest.select("node", "label"), F.col("hub") == F.col("node")).join(sets, F.col("hub") == F.col("sig")).select("c", F.col("label").alias("lb"), F.col("hashes").alias("hb")))
        release(prints)
        return out

    def beside_middle(rest: DataFrame) -> DataFrame:
        """cluster, sig, la, ha, lb, hb: the texts of each cluster with its middle."""
        members = stored(sets.join(rest.select("node", F.col("label").alias("la")), F.col("sig") == F.col("node")).select("cluster", "sig", "la", F.col("hashes").alias("ha")))
        return members.join(middle, F.col("cluster") == F.col("c"))

    def sharing(rest: DataFrame) -> DataFrame:
        """All pairs a, b of texts of one cluster that are still apart and can be similar enough, by the hashes in the prefixes of their sets."""
        keyed = beside_middle(rest).select("cluster", "sig", "la", "ha", "hb").mapInArrow(_prefixes(similarity), "k long, sig long, label long, size long, place long")
        return _dealt(keyed, "sig", True).mapInArrow(_sharing(similarity), "a long, b long").distinct()

    roots = sets.where("sig = cluster").select(F.col("cluster").alias("c"), F.col("hashes").alias("hb"))
    first = sets.where("sig != cluster").join(roots, F.col("cluster") == F.col("c")).where(alike("hashes", "hb")).select(F.col("sig").alias("a"), F.col("cluster").alias("b"))
    labels = stored(clusters.join(first, F.col("node") == F.col("a"), "left").select("node", "cluster", F.coalesce("b", "node").alias("label")))
    if (rest := still_mixed(labels)) is not None:
        middle = middles(rest)
        labels = joined(labels, beside_middle(rest).where("la != lb").where(alike("ha", "hb")).select("la", "lb"))
    if rest is not None and (rest := still_mixed(labels)) is not None:
        labels = joined(labels, verified(apart(rest, loose)))
    if rest is not None and (rest := still_mixed(labels)) is not None:
        labels = joined(labels, verified(apart(rest, sharing(rest))))
    release(loose, clusters, sets)
    return marked, distinct, labels


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, component_id, as in classes, where texts are linked whose sets of shingles have this Jaccard similarity or more.

    Wide fingerprints give the candidates; each link is verified on the sets. Candidates form clusters. In each, every text is held against the cluster's first; where some are still apart, against the one in
    the middle of the cluster; then along the edges that made the cluster; then every pair of a cluster that is still apart and shares a hash in the prefixes of its sets, which no pair that is similar enough fails to
    do. So a dense group of n costs some n verified pairs, also if its texts differ enough from its middle;
    texts that share rare hashes and aren't similar enough cost a verification for each pair.

    Texts below five words are compared whole. Rows without an id are left out; an id with several texts links their classes. Repeated rows give one row. An empty table gives an empty result.
    """
    named = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    marked, _, labels = _similar(named, shingle, similarity, False)
    of = marked.join(labels, F.col("sig") == F.col("node"), "left").select("id", F.coalesce("label", "sig").alias("label")).distinct()
    least = of.groupBy(F.col("label").alias("l")).agg(F.min("id").alias("low"))
    roots = components(of.join(least, F.col("label") == F.col("l")).select(F.col("id").alias("a"), F.col("low").alias("b")))
    ids = marked.select("id").distinct()
    return ids.join(roots, F.col("id") == F.col("node"), "left").select(F.col("id").alias(id), F.coalesce("root", "id").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity of 0.8 or more), the row with the smallest id.

    Rows are told apart by a number of their own, and classes follow from texts alone: rows that share an id but not a text each have a class. Of rows of one class, null ids come last, and of equal ids the
    first row stays. Texts without words (null, empty) are one class, columns of any names are kept, and an empty table gives an empty one.
    """
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("nth"), F.struct(*docs.columns).alias("doc")))
    doc_id = F.col("doc")["doc_id"]
    named = numbered.select(F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), "nth").alias("id"), F.col("doc")["text"].alias("text"))
    marked, distinct, labels = _similar(named, 5, 0.8, True)
    of = distinct.join(labels, F.col("sig") == F.col("node"), "left").groupBy(F.coalesce("label", "sig").alias("label")).agg(F.min("low").alias("low"))
    best = stored(of.select(F.col("low.nth").alias("best")))
    # few rows are dropped, so most are told from them without a shuffle of texts
    dropped = stored(marked.select(F.col("id.nth").alias("gone")).join(best, F.col("gone") == F.col("best"), "left_anti"))
    release(marked, distinct, labels, best)
    rows = _maybe(numbered, F.col("nth"), dropped, F.col("gone"))
    kept = rows.where("maybe").join(dropped, F.col("nth") == F.col("gone"), "left_anti")
    return rows.where("not maybe").unionByName(kept).select("doc.*")
