"""Mixing sources to target weights by a low-discrepancy schedule of slots. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table, word_count

#: Points of the van der Corput sequence of base 2 as whole numbers: point i is i with its BITS lowest bits in reverse order, out of POINTS. Each period is a permutation.
BITS = 31
POINTS = 1 << BITS
#: Cells in which points meet the cumulative weights.
CELLS = 4096
#: Ranges of the shuffle hash, of 60 bits, within a source, for the running sums.
RANGES = 4096
CAP = 3


def passed(x: Column) -> Column:
    """The classes of slot numbers whose points lie below x, as an array: (bits, low) holds the slots that agree with low in their `bits` lowest bits.

    There is a class for each 1 among x's bits: points that begin like x, and have a 0 there. All points lie below POINTS, one class of 0 bits.
    """
    digits = F.lpad(F.bin(x), BITS, "0")
    ones = F.filter(F.sequence(F.lit(1), F.lit(BITS)), lambda p: F.substr(digits, p, F.lit(1)) == "1")
    low = lambda p: F.conv(F.reverse(F.concat(F.substr(digits, F.lit(1), p - 1), F.lit("0"))), 2, 10).cast("long")
    classes = F.transform(ones, lambda p: F.struct(p.alias("bits"), low(p).alias("low")))
    return F.when(x >= POINTS, F.array(F.struct(F.lit(0).alias("bits"), F.lit(0).cast("long").alias("low")))).otherwise(classes)


def count_below(classes: Column, n: Column) -> Column:
    """How many of the slots 0 to n - 1 are in the classes."""
    shift = lambda name, value, bits: F.call_function(name, value, bits)
    one = F.lit(1).cast("long")
    return F.aggregate(classes, F.lit(0).cast("long"), lambda sum, c: sum + shift("shiftright", n - c["low"] + shift("shiftleft", one, c["bits"]) - 1, c["bits"]))


def sources_of(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, source_size, target, quota, lo, hi: targets by weight up to CAP times the size, and cumulative shares.

    A source is full at the water level r = CAP * size / weight. It is capped if all sources, filled to that level, hold less than
    the total; the others share what the capped ones leave, by weight. The table has a row for each source.
    """
    per = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    everything = Window.partitionBy()
    ordered = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth))
    per = per.withColumn("cap", F.lit(float(CAP)) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(everything).cast("double")
    below = Window.partitionBy().orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.sum("cap").over(below) + F.col("level") * (F.sum("weight").over(everything) - F.sum("weight").over(below))
    per = per.withColumn("total", total).withColumn("capped", held < F.col("total"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    free = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(0.0))
    share = F.when(F.col("capped") | (free <= 0), F.col("cap")).otherwise(F.least("cap", F.col("weight") * left / F.nullif(free, F.lit(0.0))))
    per = per.withColumn("target", share)
    per = per.withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.lit(CAP) * F.col("source_size")).cast("long"))
    running = F.sum("target").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("target").over(everything)
    scale = F.lit(float(POINTS)) / F.nullif(whole, F.lit(0.0))
    per = per.withColumn("hi", F.coalesce(F.floor(running * scale), F.lit(0)).cast("long"))
    return per.select("source", "source_size", "target", "quota", F.coalesce(F.lag("hi").over(ordered), F.lit(0)).alias("lo"), "hi")


def schedule(spark, sources: DataFrame, slots: int) -> DataFrame:
    """slot, source, rank, n_slots, quota, source_size: points mapped through the cumulative targets, and each slot's rank within its source.

    A slot's rank is the number of slots before it whose points lie in the source's share. It follows from the bounds of the share alone, so no source's slots are
    gathered or sorted. A source whose share is too narrow for any point gets one slot after all others.
    """
    width = POINTS // CELLS
    at = lambda n: count_below(F.col("upper"), n) - count_below(F.col("lower"), n)
    wanted = sources.where("quota > 0").select("source", "source_size", "quota", "lo", "hi", passed(F.col("lo")).alias("lower"), passed(F.col("hi")).alias("upper"))
    wanted = wanted.withColumn("hits", at(F.lit(slots).cast("long")))
    cells = wanted.where("hits > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    digits = F.lpad(F.bin(F.pmod("id", F.lit(POINTS))), BITS, "0")
    points = spark.range(slots).select(F.col("id").alias("slot"), F.conv(F.reverse(digits), 2, 10).cast("long").alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    hits = points.join(cells, "cell").where("point >= lo and point < hi").select("slot", "source", at(F.col("slot")).alias("rank"), F.col("hits").alias("n_slots"), "quota", "source_size")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return hits.unionByName(wanted.where("hits = 0").select(F.lit(slots).cast("long").alias("slot"), "source", zero.alias("rank"), one.alias("n_slots"), "quota", "source_size"))


def shuffled(doc_id: Column, text: Column, seed: int) -> Column:
    """A hash of 60 bits, by which documents are shuffled."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit(""))))), 1, 15), 16, 10).cast("long")


def streams(sized: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document's place, start to start + size, in the shuffled word stream of its source, with the columns in carry."""
    rows = sized.where("size > 0").withColumn("part", F.floor(F.col("h") / ((1 << 60) // RANGES)))
    per_part = rows.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return rows.select("doc_id", "source", "size", (F.col("first") + F.col("inside")).alias("start"), *carry)


def sizes_of(docs: DataFrame, seed: int, *more) -> DataFrame:
    """doc_id, source, size, h and further columns, as mixed() needs them."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffled(F.col("doc_id"), F.col("text"), seed).alias("h"), *more)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), block: int = 1024, seed: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their sizes and places, sources, the mix).

    The mix has a row for each run of words that a slot takes from a document: slot, source, rank, epoch, doc_id, size, start (the document's
    place in its source's stream), from_word, to_word. In order of slot, they are the training stream. A source's slots take
    blocks of equal length, its quota divided by its slots, from its shuffled stream, round and round; so it gives its quota exactly,
    and no document gives more than CAP times its words.

    There are ceil(words / block) slots, 16 a source at least. Nulls: a null text has no words; null is a source,
    after all others; null ids are kept. Repeated rows are documents of their own. Without words the mix is empty. Other columns are ignored.
    """
    return mixed(stored(sizes_of(docs, seed)), weights, block)


def mixed(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), block: int = 1024, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As mix, of a stored table of sizes_of. Columns named in carry go with the documents into the first and the last table.

    Sources, schedule and places are written as tables: each plan is small, and the planner knows their sizes.
    """
    spark = sized.sparkSession
    sources = stored(sources_of(sized, weights))
    words, n = sources.agg(F.sum("source_size"), F.count(F.lit(1))).first()
    slots = max(-(-(words or 0) // block), 16 * n) if words else 0
    bound = lambda r: F.floor(F.col("quota") * (r / F.col("n_slots"))).cast("long")
    plan = schedule(spark, sources, slots).withColumn("a", bound(F.col("rank"))).withColumn("b", bound(F.col("rank") + 1)).where("b > a")
    size = F.col("source_size")
    plan = plan.withColumn("epoch", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size))))
    first = F.col("epoch") * size
    plan = plan.select("slot", F.col("source").alias("of"), "rank", "epoch", (F.greatest("a", first) - first).alias("a"), (F.least("b", first + size) - first).alias("b"))
    cell = lambda x: F.floor(x / block)
    plan = stored(plan.withColumn("cell", F.explode(F.sequence(cell(F.col("a")), cell(F.col("b") - 1)))))
    placed = stored(streams(sized, carry))
    end = F.col("start") + F.col("size")
    pieces = placed.withColumn("at", F.explode(F.sequence(cell(F.col("start")), cell(end - 1))))
    met = pieces.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at")) & (F.col("start") < F.col("b")) & (end > F.col("a")) & (cell(F.greatest("start", "a")) == F.col("cell")))
    taken = met.select(*carry, "slot", "source", "rank", "epoch", "doc_id", "size", "start", (F.greatest("start", "a") - F.col("start")).alias("from_word"), (F.least(end, "b") - F.col("start")).alias("to_word"))
    empty = sized.where("size = 0").select("doc_id", "source", "size", F.lit(None).cast("long").alias("start"), *carry)
    return placed.unionByName(empty), sources, taken


def op3(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of documents, as mix has them: rows without words take nothing, repeated rows and null ids are rows of their own, an empty table gives no rows."""
    placed, sources, taken = mix(table(spark, sf_dir, "documents"))
    sums = taken.groupBy(F.col("source").alias("ts"), F.col("start").alias("tp")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("got"))
    rows = placed.join(sums, F.col("source").eqNullSafe(F.col("ts")) & (F.col("start") == F.col("tp")), "left")
    of = sources.select(F.col("source").alias("o"), "source_size", "target")
    rows = rows.join(of, F.col("source").eqNullSafe(F.col("o")))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in their target weights: a document comes once for each round of its source's stream in which the mix takes half of its words or more.

    Rows are told apart by a number of their own, so null ids and ids of several rows make no difference; columns of any names are kept. Documents without words (null, empty) aren't in the mix. An empty table gives an empty one.
    """
    numbered = stored(sizes_of(docs, 20, F.monotonically_increasing_id().alias("nth"), F.struct(*docs.columns).alias("doc")))
    taken = mixed(numbered.select("doc_id", "source", "size", "h", "nth"), carry=("nth",))[2]
    words = F.col("to_word") - F.col("from_word")
    rounds = taken.groupBy("nth").agg(F.first("size").alias("size"), *[F.sum(F.when(F.col("epoch") == k, words)).alias(f"got{k}") for k in range(CAP)])
    copies = sum((F.coalesce((2 * F.col(f"got{k}") >= F.col("size")).cast("long"), F.lit(0)) for k in range(CAP)), F.lit(0).cast("long"))
    rows = numbered.select("nth", "doc").join(rounds.select("nth", copies.alias("copies")).where("copies > 0"), "nth")
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


#: A source's slots together take its stream from its start on, round and round, up to its quota: what a document gives follows from its place.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5(concat('20|', coalesce(CAST(doc_id AS VARCHAR), '-'), '|', md5(coalesce(text, ''))))[1:15] AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
        3.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
c AS (SELECT *, sum(cap) OVER (ORDER BY cap / weight) + cap / weight * (sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight)) < total AS capped FROM w),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, weight * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END AS target FROM c),
q AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS quota FROM t),
p AS (SELECT doc_id, d.source, size, source_size, target, quota, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(list_sum(list_transform([0, 1, 2], lambda k: greatest(0, least(quota, k * source_size + start + size) - (k * source_size + start)))) AS BIGINT) AS taken FROM p
"""
