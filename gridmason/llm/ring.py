"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Places on the ring; a virtual node sits at one of them.
PLACES = 1 << 16
#: Turns in which keys are admitted: a key's turn comes from its priority hash.
TURNS = 256


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise. A shard's nodes don't depend on the number of shards."""

    def place(shard: int, node: int) -> int:
        digest = hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest()
        return int.from_bytes(digest, "big") % PLACES

    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def arc_of_place(nodes: list[tuple[int, int]]) -> list[int]:
    """For each place, the index of the first node at it or clockwise of it."""
    arcs, i = [], 0
    for p in range(PLACES):
        while i < len(nodes) and nodes[i][0] < p:
            i += 1
        arcs.append(i % len(nodes))
    return arcs


def admit(counts: dict[tuple[int, int], int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Fill the shards, turn by turn and clockwise within a turn.

    counts: rows of each (turn, arc). room: rows each shard may hold. Rows that meet a full shard go on
    clockwise to the next shard with room. Returns (turn, arc, first rank, shard, slot of that rank).
    """
    filled = [0] * len(room)
    out = []
    for (turn, arc), left in sorted(counts.items()):
        rank, at = 0, arc
        while left:
            shard = owners[at % len(owners)]
            n = min(left, room[shard] - filled[shard])
            if n > 0:
                out.append((turn, arc, rank, shard, filled[shard]))
                filled[shard] += n
                rank += n
                left -= n
            at += 1
            if at > arc + len(owners):
                raise ValueError("the shards have less room than there are rows")
    return out


def assign(docs: DataFrame, shards: int = 8, vnodes: int = 64, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's shard and its slot there: key, size, text_crc32, shard, slot.

    A key hashes to a place on the ring and belongs to the next virtual node clockwise. Keys are admitted in an order
    that only their hashes decide; a key whose shard is full continues clockwise. With slack 0 a shard may hold
    n // shards rows, the first n % shards one more, so that counts differ by one at most; with a larger slack,
    ceil((1 + slack) * n / shards) rows, so that fewer keys continue.

    Only a count for each (turn, arc) reaches the driver: TURNS * shards * vnodes figures at most, whatever the input.
    Nulls: a null key is a key; a null text has size 1 and the checksum of an empty text. Repeated rows are
    rows of their own. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    nodes = ring(shards, vnodes)
    arcs = spark.createDataFrame(list(enumerate(arc_of_place(nodes))), "place int, arc int")
    rows = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    #: The turn also hashes what the row holds, so that one key with very many rows spreads over all turns.
    rows = rows.select(
        "*",
        F.pmod(F.xxhash64(F.lit("ring"), "key"), F.lit(PLACES)).cast("int").alias("place"),
        F.xxhash64(F.lit("turn"), "key", "text_crc32", "size").alias("order"),
    ).withColumn("turn", F.pmod("order", F.lit(TURNS)).cast("int"))
    rows = cut(rows.join(F.broadcast(arcs), "place").drop("place"))
    counts = {(r.turn, r.arc): r.n for r in rows.groupBy("turn", "arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    most = -(-n * (1 + slack) // shards)
    room = [int(most) if slack else n // shards + (s < n % shards) for s in range(shards)]
    placed = admit(counts, [s for _, s in nodes], room)
    plan = spark.createDataFrame(placed, "turn int, arc int, first long, shard int, base long")
    last = F.lead("first").over(Window.partitionBy("turn", "arc").orderBy("first"))
    plan = plan.withColumn("until", F.coalesce(last, F.lit(2**62)))
    rank = F.row_number().over(Window.partitionBy("turn", "arc").orderBy("order", "key", "text_crc32", "size")) - 1
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(plan), ["turn", "arc"])
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until")))
        .select("key", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).cast("long").alias("slot"))
    )


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = assign(table(spark, sf_dir, "documents"), shards=8)
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
