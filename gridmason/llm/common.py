"""What several of the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode where none is set."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gridmason-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: later steps read it instead of computing it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Folders of the tables that stored() wrote and release() has not removed.
_LEFT: dict[str, SparkSession] = {}


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """As cut, but as compressed Parquet: for tables of many rows. The folder lies beside the checkpoints; it goes with release(), or when the driver's Python ends."""
    spark = df.sparkSession
    to = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    _LEFT[to] = spark
    df.write.option("compression", codec).parquet(to)
    out = spark.read.schema(df.schema).parquet(to)
    out._gridmason_folder = to
    return out


def _remove(folder: str) -> None:
    spark = _LEFT.pop(folder, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Remove tables that stored() wrote and nothing reads any more."""
    for t in tables:
        _remove(t._gridmason_folder)


def tidy(spark: SparkSession) -> None:
    """Give back what nothing holds any more: the driver's memory, and on all disks the shuffle files of plans that have run, which otherwise stay until the driver's JVM happens to collect its garbage."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # not glibc
    spark.sparkContext._jvm.System.gc()


def left() -> set[str]:
    """The folders of the tables that stored() wrote and nobody has released."""
    return set(_LEFT)


def release_folders(folders: set[str]) -> None:
    for f in folders:
        _remove(f)


@atexit.register
def _remove_all() -> None:
    for folder in list(_LEFT):
        try:
            _remove(folder)
        except Exception:  # noqa: BLE001  the JVM may have ended first
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bind(value: Column, body) -> Column:
    """body(value), with value computed once per row even where a lambda in body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
