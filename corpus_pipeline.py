"""The corpus pipeline: quality rules, toxicity, near duplicates, mixing of sources, and pieces, over the documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridmason.llm import mixing, pieces, quality, simhash, toxicity
from gridmason.llm.common import left, release, release_folders, stored, tidy

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the tables that stages before have left behind.
_behind: set[str] = set()


def clearing(stage: Stage) -> Stage:
    """The stage, which first removes the tables that stages before it wrote on their way. Their results have been written by then; tables that docs itself still reads stay."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        release_folders(gone := {f for f in _behind if not any(f.rstrip("/").rsplit("/", 1)[-1] in x for x in read)})
        _behind.difference_update(gone)
        tidy(spark)
        before = left()
        out = stage(spark, docs, sf_dir)
        _behind.update(left() - before)
        return out

    return run


#: Each takes (spark, docs, sf_dir); its result, written and read again, is the next one's docs. All but the last return the columns of documents.
STAGES = [
    ("quality rules", clearing(quality.stage)),
    ("toxicity", clearing(toxicity.stage)),
    ("near duplicates", clearing(simhash.stage)),
    ("mixing", clearing(mixing.stage)),
    ("pieces", clearing(pieces.stage)),
]

#: The stages' hashes, search and fitted model have no SQL form. A test holds run() against a plain form of each stage in turn, and others each stage on rows at the edges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document that the stages keep, as often as the mix takes it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if last is not None:
            release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
