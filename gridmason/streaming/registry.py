"""The registry of seen hashes: which rows are new, in batches and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MODES = ("always_run", "skip", "reject")


def content_hash(content: Column) -> Column:
    return F.sha1(content)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The registry at path: one column, hash. A folder that isn't there or holds nothing readable is an empty registry."""
    try:
        return spark.read.schema("hash string").parquet(path).where("hash is not null").distinct()
    except AnalysisException:
        return spark.createDataFrame([], "hash string")


def register(rows: DataFrame, seen: DataFrame, order: str, hash: str = "hash") -> DataFrame:
    """rows with status: present if the registry or an earlier row has the hash, else absent."""
    nth = F.row_number().over(Window.partitionBy(hash).orderBy(order))
    known = seen.select(F.col("hash").alias("__seen")).distinct()
    marked = rows.withColumn("__nth", nth).join(known, F.col(hash) == F.col("__seen"), "left")
    return marked.withColumn("status", F.when(F.col("__seen").isNotNull() | (F.col("__nth") > 1), "present").otherwise("absent")).drop("__nth", "__seen")


def admit(marked: DataFrame, mode: str = "always_run") -> DataFrame:
    """The rows to work on, with outcome: run for all (always_run); for the new ones alone, others left out (skip) or kept with the outcome rejected (reject)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "skip":
        return marked.where("status = 'absent'").withColumn("outcome", F.lit("run"))
    rejected = (F.col("status") == "present") & F.lit(mode == "reject")
    return marked.withColumn("outcome", F.when(rejected, "rejected").otherwise("run"))


def save(marked: DataFrame, path: str, hash: str = "hash") -> None:
    """Add the new hashes to the registry. Files are only added, so a reader never meets a half-written registry."""
    marked.where("status = 'absent'").select(F.col(hash).alias("hash")).write.mode("append").parquet(path)


def first_seen(stream: DataFrame, hash: str = "hash", time: str | None = None, late: str | None = None) -> DataFrame:
    """A stream without the rows whose hash came before. With a time column and a bound on lateness, hashes are forgotten once the watermark has passed them, so state stays bounded."""
    if time and late:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([hash])
    return stream.dropDuplicates([hash])


def keep_registry(stream: DataFrame, path: str, checkpoint: str, order: str, hash: str = "hash"):
    """A query that registers each micro-batch. A batch that is run again finds its own hashes marked by batch and registers them once."""

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        marked = register(rows, load(spark, f"{path}/*"), order, hash)
        marked.where("status = 'absent'").select(F.col(hash).alias("hash")).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
