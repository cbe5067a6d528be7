"""Connected components: within pages, and over whole edge tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges a-b connect it with, by hooking and halving until nothing moves."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return low
        np.minimum.at(low, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up


def page_components(nodes: DataFrame, edges: DataFrame, size: bool = False) -> DataFrame:
    """nodes (page_id, box_id and any other columns) with comp, the smallest box_id connected with each by edges i-j of the same page; with size, also n, the number of boxes in comp.

    One page's boxes and edges are held at a time, and labelled in time and memory in proportion to them.
    """

    def run(own: pa.Table, links: pa.Table) -> pa.Table:
        ids = own.column("box_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        low = np.arange(len(ids))
        if links.num_rows and len(ids):
            at = lambda c: np.searchsorted(ids, links.column(c).to_numpy(), sorter=order)
            low = union_find(len(ids), at("i"), at("j"))
        place = np.empty_like(order)
        place[order] = np.arange(len(ids))
        low = low[place]
        own = own.rename_columns(fields[: own.num_columns]).append_column("comp", pa.array(ids[order][low]))
        return own.append_column("n", pa.array(np.bincount(low, minlength=len(ids))[low])) if size else own

    # both sides may come from the same table, so their columns get names of their own
    schema = StructType(list(nodes.schema.fields)).add("comp", "long")
    schema = schema.add("n", "long") if size else schema
    fields = list(schema.names)
    left = nodes.select(*[F.col(c).alias("page" if c == "page_id" else c) for c in nodes.columns]).groupBy("page")
    right = edges.select(F.col("page_id").alias("of_page"), F.col("i").alias("i"), F.col("j").alias("j")).groupBy("of_page")
    return left.cogroup(right).applyInArrow(run, schema)


def _cut(df: DataFrame) -> DataFrame:
    """df, written as a table to the folder of spark.checkpoint.dir and read again; to a temporary one in local mode alone. So lineage ends, and the table's size is known to the planner."""
    sc = df.sparkSession.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gridmason-")
    to = f"{where}/graph-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node connected with it) for every node of the edge table i-j, however large its components are.

    Each round every node takes the least label of its neighbours, and then that label's own label, so chains shrink by doubling; labels only fall.
    A round's labels are written to the checkpoint folder; the loop ends when their sum stays.
    """
    both = _cut(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).where("i != j").distinct())
    labels = _cut(both.groupBy(F.col("i").alias("node")).agg(F.least(F.min("j"), F.first("i")).alias("comp")))
    total = None
    while True:
        of = labels.select(F.col("node").alias("j"), F.col("comp").alias("other"))
        heard = both.join(of, "j").groupBy(F.col("i").alias("node")).agg(F.min("other").alias("heard"))
        hooked = labels.join(heard, "node").select("node", F.least("comp", "heard").alias("comp"))
        up = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        labels = _cut(hooked.join(up, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        now = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
