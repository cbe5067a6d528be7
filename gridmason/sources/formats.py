"""Reading and writing pools, text layers, model outputs and results. Documents are read by Spark's own readers; nested parts become rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, from_center, from_xywh, ring
from ..functions.text import safe_stem, squeeze

POOL = "source string, n_calls int, boxes array<struct<bbox:array<double>,score:double,source:string>>"
SPANS = "page_id bigint, blocks array<struct<lines:array<struct<spans:array<struct<text:string,bbox:array<double>>>>>>>"
PREDICTIONS = "array<struct<image:struct<width:double,height:double>,predictions:array<struct<x:double,y:double,width:double,height:double,confidence:double,class:string,class_id:int,detection_id:string,points:array<struct<x:double,y:double>>>>>>"
RESULT = ("box_id", "x1", "y1", "x2", "y2", "score", "source", "label", "text_status")


def corners(bbox: Column) -> list[Column]:
    return [F.get(bbox, F.lit(i)).cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]


def explode_pool(pools: DataFrame) -> DataFrame:
    """box_id (the place in the list), x1..y2, score (1 where none is given) and source of a column `boxes`; other columns stay."""
    keep = [c for c in pools.columns if c not in ("boxes", "source", "n_calls")]
    rows = pools.select(*keep, F.posexplode("boxes").alias("box_id", "b"))
    return rows.select(*keep, F.col("box_id").cast("long").alias("box_id"), *corners(F.col("b.bbox")), F.coalesce("b.score", F.lit(1.0)).alias("score"), F.coalesce("b.source", F.lit("color")).alias("source"))


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """A pool of boxes from JSON: {"boxes": [{"bbox": [x1, y1, x2, y2], "score": …}]}."""
    return explode_pool(spark.read.schema(POOL).option("multiLine", True).json(path))


def pool_document(boxes: DataFrame) -> DataFrame:
    """page_id, boxes: the pool of each page as one nested value."""
    item = F.struct("box_id", F.struct(F.array("x1", "y1", "x2", "y2").alias("bbox"), "score", "source").alias("b"))
    return boxes.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["b"]).alias("boxes"))


def record_largest(calls: DataFrame) -> DataFrame:
    """page_id, n_calls, boxes: of the pools that reached each page's merge, the largest."""
    return calls.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_calls"), F.max_by("boxes", F.size("boxes")).alias("boxes"))


def read_reviewed(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of a reviewed result, whose list `kept` has corners and sizes, as corners."""
    rows = spark.read.option("multiLine", True).schema("kept array<struct<bbox:array<double>,text_status:string,source:string>>").json(path)
    rows = rows.select(F.posexplode("kept").alias("box_id", "b"))
    b = from_xywh(*[F.get("b.bbox", F.lit(i)) for i in range(4)])
    return rows.select(F.col("box_id").cast("long").alias("box_id"), b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"), "b.text_status", "b.source")


def explode_spans(pages: DataFrame, dpi: float) -> DataFrame:
    """page_id, span_id, text, x0, y0, x1, y1: the spans of a text layer of blocks, lines and spans, trimmed, not empty, in pixels of a page rendered at dpi."""
    blocks = pages.select("page_id", F.posexplode("blocks").alias("b", "block"))
    lines = blocks.select("page_id", "b", F.posexplode("block.lines").alias("l", "line"))
    spans = lines.select("page_id", "b", "l", F.posexplode("line.spans").alias("s", "span")).withColumn("text", F.trim("span.text")).where("text <> ''")
    order = Window.partitionBy("page_id").orderBy("b", "l", "s")
    scaled = [(F.get("span.bbox", F.lit(i)) * (dpi / 72.0)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return spans.select("page_id", (F.row_number().over(order) - 1).cast("long").alias("span_id"), "text", *scaled)


def polygon_bounds(points: Column) -> list[Column]:
    """x0, y0, x1, y1 about a recognised text's polygon of points [x, y]."""
    at = lambda i: F.transform(points, lambda p: p[i])
    return [F.array_min(at(0)).alias("x0"), F.array_min(at(1)).alias("y0"), F.array_max(at(0)).alias("x1"), F.array_max(at(1)).alias("y1")]


def predictions(outputs: DataFrame, json: str = "output") -> DataFrame:
    """The predictions of a model's JSON output, one row each: the first object that has any, of a list of objects or of one. Other columns stay; idx is the place in the list."""
    keep = [c for c in outputs.columns if c != json]
    text = F.trim(json)
    blocks = F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), PREDICTIONS)
    block = F.get(F.filter(blocks, lambda b: b["predictions"].isNotNull()), F.lit(0))
    rows = outputs.select(*keep, block.alias("block")).select(*keep, F.col("block.image").alias("image"), F.posexplode("block.predictions").alias("idx", "p"))
    return rows.select(*keep, "image", "idx", "p.*")


def rescaled_halls(rows: DataFrame, scale: Column) -> DataFrame:
    """Predictions of a page that was scaled down, as boxes on the whole page: corners, area, coordinates, confidence and class; those without a size are left out."""
    b = from_center(*[F.col(c) / scale for c in ("x", "y", "width", "height")])
    sized = rows.where((F.col("width") / scale > 0) & (F.col("height") / scale > 0))
    return sized.select(
        "page_id", "idx", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"), (F.col("width") / scale * F.col("height") / scale).alias("area"),
        ring(b).alias("coordinates"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("class", F.lit("hall")).alias("class"),
    )


def page_extent(blocks: DataFrame) -> DataFrame:
    """page_id, w, h: the size that an output names, else 5 % more than its largest coordinates, rounded up, else 2100 by 1275. blocks: page_id, image, predictions."""
    points = F.flatten(F.transform(F.coalesce("predictions", F.array().cast("array<struct<points:array<struct<x:double,y:double>>>>")), lambda p: F.coalesce(p["points"], F.array().cast("array<struct<x:double,y:double>>"))))
    top = lambda c: F.coalesce(F.array_max(F.transform(points, lambda p: p[c])), F.lit(0.0))
    given = (F.coalesce(F.col("image.width"), F.lit(0.0)) != 0) & (F.coalesce(F.col("image.height"), F.lit(0.0)) != 0)
    rows = blocks.select("page_id", "image", given.alias("given"), top("x").alias("mx"), top("y").alias("my"))
    seen = (F.col("mx") > 0) & (F.col("my") > 0)
    side = lambda c, m, default: F.when(F.col("given"), F.col(f"image.{c}").cast("int")).when(seen, F.ceil(F.col(m) * 1.05).cast("int")).otherwise(F.lit(default))
    return rows.select("page_id", side("width", "mx", 2100).alias("w"), side("height", "my", 1275).alias("h"))


def booth_rows(boxes: DataFrame) -> DataFrame:
    """Boxes as consumers read them: area, centroid, closed outline, and the label as name where there is one."""
    b = Box.of()
    cx, cy = b.center
    name = squeeze(F.coalesce("label", F.lit(""))) if "label" in boxes.columns else F.lit("")
    return boxes.select("*", (F.abs(b.x2 - b.x1) * F.abs(b.y2 - b.y1)).alias("area"), F.array(cx, cy).alias("centroid"), ring(b).alias("coordinates"), F.when(name != "", name).alias("name"))


def write_boxes(boxes: DataFrame, path: str) -> None:
    """One JSON document a page: its boxes, with widths, heights and areas, and their number. Outlines and span counts aren't written."""
    b = Box.of()
    item = F.struct(*[c for c in RESULT if c in boxes.columns], b.width.alias("w"), b.height.alias("h"), b.area.alias("area"))
    pages = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("boxes"), F.count(F.lit(1)).alias("n_boxes"))
    pages.write.mode("overwrite").json(path)


def write_halls(assigned: DataFrame, path: str) -> None:
    """page_id, hall, n_booths, as JSON."""
    assigned.groupBy("page_id", "hall").agg(F.count(F.lit(1)).alias("n_booths")).write.mode("overwrite").json(path)


def archive(executions: DataFrame, path: str) -> None:
    """Add inputs (endpoint, name, content) and results to an archive by endpoint and day; names are made safe."""
    stamped = executions.withColumn("name", safe_stem(F.col("name"))).withColumn("at", F.current_timestamp()).withColumn("day", F.current_date())
    stamped.write.mode("append").partitionBy("endpoint", "day").parquet(path)
