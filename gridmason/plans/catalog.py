"""Registered queries over the driver's tables, and the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as texts
from ..functions.geometry import Box
from ..functions.polygon import polygon_area, polygon_overlap
from ..operators import labels, overlap, raster, regions, suppress, trails
from ..operators.graph import components, page_components
from ..sources import fixtures, formats
from ..sources.views import ctes, view
from ..streaming import registry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
HEIGHT, WIDTH = 40, 60
IOU, IOS = 0.4, 0.6


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name, with the SQL of its result over these views."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {ctes(*views)}\n{sql}" if views else sql
        return f

    return register


def nth_nine(c):
    return F.round(c, 9)


# DuckDB's counterparts of the box expressions, over two sides a and b.
AREA = "(greatest(0, {0}.x2 - {0}.x1) * greatest(0, {0}.y2 - {0}.y1))"
A, B = AREA.format("a"), AREA.format("b")
SHARED = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
SQL_IOU = f"({SHARED} / ({A} + {B} - {SHARED}))"
SQL_IOS = f"({SHARED} / least({A}, {B}))"
SQL_OWN = f"({SHARED} / {A})"
PAIRS = f"pairs AS (SELECT a.page_id, a.box_id AS i, b.box_id AS j, {SQL_IOU} AS iou, {SQL_IOS} AS ios FROM box_pool a JOIN box_pool b ON a.page_id = b.page_id AND a.box_id < b.box_id AND {SHARED} > 0)"
BLOCKS = f"""blocks AS (SELECT b.page_id, b.box_id FROM box_pool a JOIN box_pool b ON a.page_id = b.page_id AND {SHARED} > 0 AND {A} < {B} AND {SQL_IOS} > 0.80
  GROUP BY b.page_id, b.box_id, {B} HAVING count(*) >= 2 AND sum({SQL_IOS} * {A}) >= 0.75 * {B}
  AND NOT bool_or(greatest(a.x2 - a.x1, a.y2 - a.y1) / greatest(1.0, least(a.x2 - a.x1, a.y2 - a.y1)) > 2.5 AND {A} < 15000))"""


# --- boxes ---------------------------------------------------------------------------------------------------------------------


@query("SELECT box_id, page_id, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, CASE source WHEN 'color' THEN 0.75 WHEN 'bordered' THEN 0.45 ELSE 1.0 END AS source_score FROM box_pool", "box_pool")
def box_measures(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = Box.of().center
    return view(spark, d, "box_pool").select("box_id", "page_id", Box.of().area.alias("area"), cx.alias("cx"), cy.alias("cy"), geo.source_score(F.col("source")).alias("source_score"))


@query(f", {PAIRS} SELECT page_id, i, j, round(iou, 9) AS iou, round(ios, 9) AS ios FROM pairs", "box_pool")
def overlap_pairs(spark, d):
    p = overlap.overlap_pairs(view(spark, d, "box_pool"))
    return p.select("page_id", "i", "j", nth_nine("iou").alias("iou"), nth_nine("ios").alias("ios"))


@query(f", {PAIRS} SELECT page_id, count(*) AS n, round(sum(iou), 6) AS iou FROM pairs GROUP BY page_id", "box_pool")
def overlap_pairs_by_cell(spark, d):
    p = overlap.overlap_pairs(view(spark, d, "box_pool"), grid=200)
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("iou"), 6).alias("iou"))


@query(f", {BLOCKS} SELECT page_id, box_id FROM blocks", "box_pool")
def merged_blocks(spark, d):
    return overlap.merged_blocks(view(spark, d, "box_pool"))


REACH = f"""edges AS (SELECT page_id, i, j FROM pairs WHERE iou > {IOU} OR ios > {IOS}), both_ways AS (SELECT page_id, i, j FROM edges UNION ALL SELECT page_id, j, i FROM edges),
  reach(page_id, box_id, other) AS (SELECT page_id, box_id, box_id FROM {{pool}} UNION SELECT r.page_id, r.box_id, e.j FROM reach r JOIN both_ways e ON r.page_id = e.page_id AND r.other = e.i),
  comp AS (SELECT page_id, box_id, min(other) AS comp FROM reach GROUP BY page_id, box_id)"""


@query(f", {PAIRS}, {REACH.format(pool='box_pool')} SELECT page_id, box_id, comp FROM comp", "box_pool")
def box_components(spark, d):
    pool = view(spark, d, "box_pool")
    return page_components(pool.select("page_id", "box_id"), suppress.links(pool, IOU, IOS))


@query(f", {PAIRS}, {REACH.format(pool='box_pool')} SELECT box_id AS node, comp FROM comp WHERE box_id IN (SELECT i FROM both_ways)", "box_pool")
def edge_components(spark, d):
    return components(suppress.links(view(spark, d, "box_pool"), IOU, IOS).select("i", "j"))


def greedy(lists: str, order: str, grow: str = "list_append(kept, box_id)") -> str:
    """CTEs that decide a page's boxes one by one: turn (page_id, box_id, step, rejects, …) from `lists`, in `order`; chosen (page_id, box_id), the boxes that no kept one rejects. grow: what a box that is taken makes of the kept ones."""
    return f"""turn AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS step FROM ({lists})),
  walk(page_id, done, kept) AS (SELECT DISTINCT page_id, 0::BIGINT, []::BIGINT[] FROM turn
    UNION ALL SELECT w.page_id, step, CASE WHEN list_has_any(kept, rejects) THEN kept ELSE {grow} END FROM walk w JOIN turn t ON t.page_id = w.page_id AND t.step = w.done + 1),
  chosen AS (SELECT page_id, unnest(kept) AS box_id FROM (SELECT page_id, arg_max(kept, done) AS kept FROM walk GROUP BY page_id))"""


def both_ways(pairs: str) -> str:
    return f"SELECT page_id, i AS box_id, j AS other, iou, ios FROM {pairs} UNION ALL SELECT page_id, j, i, iou, ios FROM {pairs}"


def listed(pool: str, pairs: str, rejects: str, *more: str) -> str:
    """The boxes of a pool as b, with lists of the boxes o that overlap them, under conditions over b, o, iou and ios: rejects, and others."""
    named = [f"coalesce(list(o.box_id) FILTER ({c}), []) AS {n}" for n, c in (("rejects", rejects), *(m.split(": ", 1) for m in more))]
    return f"SELECT b.*, {', '.join(named)} FROM {pool} b LEFT JOIN ({both_ways(pairs)}) p ON p.page_id = b.page_id AND p.box_id = b.box_id LEFT JOIN {pool} o ON o.page_id = p.page_id AND o.box_id = p.other GROUP BY ALL"


SQL_SIZE = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
LARGER = f"{SQL_SIZE.format('b')} > {SQL_SIZE.format('o')}"
SWAP = "CASE WHEN list_has_any(kept, swaps) THEN list_transform(kept, lambda x, i: CASE WHEN i = list_max(list_transform(swaps, lambda s: list_position(kept, s))) THEN box_id ELSE x END) ELSE list_append(kept, box_id) END"
POOL = f"{BLOCKS}, pool AS (SELECT * FROM box_pool WHERE box_id NOT IN (SELECT box_id FROM blocks)), {PAIRS.replace('box_pool', 'pool')}"

KEPT = f""", {BLOCKS}, pool AS (SELECT * FROM box_pool WHERE box_id NOT IN (SELECT box_id FROM blocks)), {PAIRS.replace('box_pool', 'pool')}, {REACH.format(pool='pool')}
SELECT page_id, box_id, x1, y1, x2, y2, score, source, comp FROM (SELECT p.*, comp, row_number() OVER (PARTITION BY comp ORDER BY score DESC, (x2 - x1) * (y2 - y1) DESC, p.box_id) AS nth
  FROM pool p JOIN comp c ON p.box_id = c.box_id) WHERE nth = 1"""


@query(KEPT, "box_pool")
def nms_cluster(spark, d):
    return suppress.nms_cluster(view(spark, d, "box_pool"), IOU, IOS).select("page_id", "box_id", "x1", "y1", "x2", "y2", "score", "source", "comp")


flagship = nms_cluster


@query(f""", {POOL}, {greedy(listed('pool', 'pairs', f"iou > {IOU} OR ios > {IOS} AND NOT {LARGER}", f"swaps: ios > {IOS} AND {LARGER}"), "score DESC, (x2 - x1) * (y2 - y1) DESC, box_id", SWAP)}
SELECT p.* FROM pool p JOIN chosen USING (page_id, box_id)""", "box_pool")
def nms_exact(spark, d):
    return suppress.nms_exact(view(spark, d, "box_pool"), IOU, IOS)


@query(f""", {PAIRS}, {greedy(listed('box_pool', 'pairs', f"ios >= 0.6 AND {SQL_SIZE.format('o')} > {SQL_SIZE.format('b')}"), "(x2 - x1) * (y2 - y1) DESC, box_id")}
SELECT p.* FROM box_pool p JOIN chosen USING (page_id, box_id)""", "box_pool")
def drop_contained(spark, d):
    return suppress.drop_contained(view(spark, d, "box_pool"))


@query(f""", {PAIRS}, {greedy(listed('box_pool', 'pairs', 'iou > 0.2'), "score DESC, box_id")}
SELECT page_id, box_id, x1, y1, x2, y2, score FROM box_pool JOIN chosen USING (page_id, box_id)""", "box_pool")
def trail_nms(spark, d):
    return suppress.by_confidence(view(spark, d, "box_pool"), 0.2)


FINER = f"""near AS (SELECT a.page_id, a.box_id, floor((least(a.x2, b.x2) - a.x1) / 4) AS hx, floor((greatest(a.x1, b.x1) - a.x1) / 4) AS lx, floor((least(a.y2, b.y2) - a.y1) / 4) AS hy, floor((greatest(a.y1, b.y1) - a.y1) / 4) AS ly,
    floor((a.x2 - a.x1) / 4) AS w, floor((a.y2 - a.y1) / 4) AS h FROM fine a JOIN fine b ON a.page_id = b.page_id AND {SHARED} > 0 AND b.area < 0.9 * a.area),
  down AS (SELECT *, unnest(range(CAST(ly AS BIGINT), CAST(least(hy, h) AS BIGINT))) AS gy FROM near), cells AS (SELECT DISTINCT page_id, box_id, w, h, gy, unnest(range(CAST(lx AS BIGINT), CAST(least(hx, w) AS BIGINT))) AS gx FROM down),
  covered AS (SELECT page_id, box_id FROM cells GROUP BY page_id, box_id, w, h HAVING count(*) > 0.8 * greatest(1, w) * greatest(1, h))"""


@query(f""", shapes AS (SELECT page_id, box_id, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) - box_id % 50 AS area FROM box_pool), {PAIRS}, {greedy(listed('shapes', 'pairs', 'iou > 0.3'), "area, box_id")},
  fine AS (SELECT s.* FROM shapes s JOIN chosen USING (page_id, box_id)), {FINER} SELECT page_id, box_id FROM fine WHERE box_id NOT IN (SELECT box_id FROM covered)""", "box_pool")
def prefer_fine(spark, d):
    shapes = view(spark, d, "box_pool").withColumn("area", Box.of().area - F.col("box_id") % 50)
    return suppress.prefer_fine(shapes.drop("score", "source"), 0.3).select("page_id", "box_id")


DEMERGE = f"""SELECT page_id, box_id FROM box_pool WHERE box_id NOT IN (SELECT b.box_id FROM box_pool a JOIN box_pool b ON a.page_id = b.page_id AND a.source = 'bordered' AND b.source <> 'bordered' AND {SHARED} > 0
  WHERE {A} >= 0.0005 * 1200 * 900 AND {A} BETWEEN 0.10 * {B} AND 0.70 * {B} AND {SQL_OWN} > 0.70 GROUP BY b.box_id HAVING count(*) >= 2)"""


@query(DEMERGE, "box_pool")
def demerge(spark, d):
    return regions.demerge(view(spark, d, "box_pool"), F.lit(1200.0 * 900.0)).select("page_id", "box_id")


BESIDE = "abs(floor(({0}.x1 + {0}.x2) / 800) - floor(({1}.x1 + {1}.x2) / 800)) <= 1 AND abs(floor(({0}.y1 + {0}.y2) / 800) - floor(({1}.y1 + {1}.y2) / 800)) <= 1"
FREE = f"""best AS (SELECT page_id, box_id, x1, y1, x2, y2 FROM (SELECT p.*, row_number() OVER (PARTITION BY comp ORDER BY score DESC, (x2 - x1) * (y2 - y1) DESC, p.box_id) AS nth FROM pool p JOIN comp c ON p.box_id = c.box_id) WHERE nth = 1),
  free AS (SELECT * FROM box_pool a WHERE source = 'bordered' AND NOT EXISTS (SELECT 1 FROM best b WHERE a.page_id = b.page_id AND {SHARED} > 0 AND {BESIDE.format('a', 'b')} AND ({SQL_IOU} >= {IOU} OR {SQL_OWN} >= {IOS}))),
  hides AS (SELECT a.page_id, a.box_id, list(b.box_id) AS rejects FROM free a JOIN free b ON a.page_id = b.page_id AND a.box_id > b.box_id AND {SHARED} > 0 AND {BESIDE.format('a', 'b')} AND ({SQL_IOU} >= {IOU} OR {SQL_OWN} >= {IOS}) GROUP BY ALL)"""


@query(f""", {POOL}, {REACH.format(pool='pool')}, {FREE}, {greedy("SELECT f.page_id, f.box_id, coalesce(rejects, []) AS rejects FROM free f LEFT JOIN hides USING (page_id, box_id)", "box_id")}
SELECT f.* FROM free f JOIN chosen USING (page_id, box_id)""", "box_pool")
def recover_uncovered(spark, d):
    pool = view(spark, d, "box_pool")
    return regions.recover_uncovered(pool, suppress.nms_cluster(pool, IOU, IOS), IOU, IOS).select(*pool.columns)


@query("SELECT source, count(*) AS n FROM box_pool GROUP BY source", "box_pool")
def counts_by_source(spark, d):
    return regions.counts_by(view(spark, d, "box_pool"))


QUANTILES = " UNION ALL ".join(f"SELECT '{m}' AS measure, CAST({q} AS DOUBLE) AS q, CAST(quantile_cont({e}, {q}) AS DOUBLE) AS value FROM box_pool" for m, e in (("area", "(x2 - x1) * (y2 - y1)"), ("w", "x2 - x1"), ("h", "y2 - y1")) for q in (0, 0.05, 0.25, 0.5, 0.75, 0.95, 1))


@query(f"SELECT measure, q, round(value, 6) AS value FROM ({QUANTILES})", "box_pool")
def size_quantiles(spark, d):
    return regions.size_quantiles(view(spark, d, "box_pool")).withColumn("value", F.round("value", 6))


@query("SELECT CASE WHEN a < 500 THEN 0 WHEN a < 1000 THEN 500 WHEN a < 2000 THEN 1000 WHEN a < 4000 THEN 2000 WHEN a < 8000 THEN 4000 ELSE 8000 END AS bin, count(*) AS n FROM (SELECT (x2 - x1) * (y2 - y1) AS a FROM box_pool) GROUP BY 1", "box_pool")
def size_histogram(spark, d):
    return regions.size_histogram(view(spark, d, "box_pool"))


@query("SELECT box_id, x1 <= 4 AND page_id % 2 > 0 OR x2 >= 1196 AND 1200 < 1200 * (1 + page_id % 3) OR y1 <= 4 AND page_id % 3 > 0 OR y2 >= 896 AND 900 < 900 * (1 + page_id % 2) AS clipped, (x2 - x1) * (y2 - y1) <= 0.004 * 1200 * 900 AS small FROM box_pool", "box_pool")
def seam_clip(spark, d):
    p, n = F.col("page_id"), lambda x: F.lit(float(x))
    cut = geo.clipped(Box.of(), n(1200), n(900), p % 2, p % 3, 1200.0 * (1 + p % 3) + p % 2, 900.0 * (1 + p % 2) + p % 3)
    return view(spark, d, "box_pool").select("box_id", cut.alias("clipped"), geo.under_cap(Box.of(), n(1200), n(900), 0.004).alias("small"))


@query("SELECT box_id, x1 + page_id % 2 * 1400 AS x1, y1 + page_id % 3 * 1400 AS y1, x2 + page_id % 2 * 1400 AS x2, y2 + page_id % 3 * 1400 AS y2 FROM box_pool", "box_pool")
def page_places(spark, d):
    b = geo.on_page(Box.of(), F.col("page_id") % 2 * 1400.0, F.col("page_id") % 3 * 1400.0)
    return view(spark, d, "box_pool").select("box_id", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"))


@query("""SELECT p_partkey AS k, p_size * 130 AS extent, CASE WHEN p_size * 130 <= 1800 THEN [0] ELSE list_transform(range(0, CAST(ceil((p_size * 130 - 1800) / 1400.0) AS BIGINT) + 1), lambda i: i * 1400) END AS starts,
  range(0, p_size * 130, 1544) AS plain, greatest(300, CAST(round_even(0.0005::DOUBLE * (p_size * 130) * 700, 0) AS BIGINT)) AS floor FROM part""")
def tiling(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") * 130).alias("extent"))
    return part.select(F.col("p_partkey").alias("k"), "extent", geo.tile_starts(F.col("extent"), 1800, 1400).alias("starts"), geo.tile_starts_plain(F.col("extent"), 1544).alias("plain"), geo.area_floor(300, 0.0005, F.col("extent"), F.lit(700)).alias("floor"))


MATCH = f"""l AS (SELECT * FROM box_pool WHERE source = 'color'), r AS (SELECT * FROM box_pool WHERE source <> 'color'),
  m AS (SELECT count(DISTINCT a.box_id) AS matched FROM l a JOIN r b ON a.page_id = b.page_id AND {SHARED} > 0 AND {SQL_IOU} >= 0.5)"""


@query(f", {MATCH} SELECT n_left, n_right, matched, round(matched / n_left, 9) AS rate, round(matched / n_right, 9) AS over_right FROM m, (SELECT count(*) AS n_left FROM l), (SELECT count(*) AS n_right FROM r)", "box_pool")
def match_rate(spark, d):
    pool = view(spark, d, "box_pool")
    m = overlap.match_rate(pool.where("source = 'color'"), pool.where("source <> 'color'"), 0.5)
    return m.select("n_left", "n_right", "matched", nth_nine("rate").alias("rate"), nth_nine("over_right").alias("over_right"))


@query("""SELECT count(*) FILTER (l AND r) AS n_both, count(*) AS n_any, round(count(*) FILTER (l AND r) / count(*), 9) AS jaccard
FROM (SELECT box_id, x1 < 700 AS l, y1 < 500 AS r FROM box_pool) WHERE l OR r""", "box_pool")
def set_agreement(spark, d):
    pool = view(spark, d, "box_pool")
    return overlap.jaccard(pool.where("x1 < 700"), pool.where("y1 < 500")).withColumn("jaccard", nth_nine("jaccard"))


CLASSES = f"""l AS (SELECT * FROM box_pool WHERE source = 'color'), r AS (SELECT * FROM box_pool WHERE source = 'opencv_strict'),
  best AS (SELECT a.box_id, bool_or({SQL_IOU} >= 0.5) AS m, bool_or({SQL_OWN} >= 0.7 AND {B} > 1.4 * {A}) AS f, bool_or({SQL_OWN} > 0.2) AS p FROM l a JOIN r b ON a.page_id = b.page_id AND {SHARED} > 0 GROUP BY a.box_id),
  classes AS (SELECT l.page_id, l.box_id, l.score, CASE WHEN m THEN 'matched' WHEN f THEN 'fused' WHEN p THEN 'partial' ELSE 'true-miss' END AS class FROM l LEFT JOIN best USING (box_id))"""


def _compared(spark, d):
    pool = view(spark, d, "box_pool")
    return pool.where("source = 'color'"), pool.where("source = 'opencv_strict'")


@query(f", {CLASSES} SELECT page_id, box_id, class FROM classes", "box_pool")
def compare_classes(spark, d):
    return regions.compare(*_compared(spark, d))


@query(f""", {CLASSES}, s AS (SELECT 'overall' AS field, '' AS value, class FROM classes UNION ALL SELECT 'page', CAST(page_id % 3 AS VARCHAR), class FROM classes)
SELECT field, value, count(*) AS n, count(*) FILTER (class = 'matched') AS matched, count(*) FILTER (class = 'fused') AS fused, count(*) FILTER (class = 'partial') AS partial, count(*) FILTER (class = 'true-miss') AS true_miss FROM s GROUP BY ALL""", "box_pool")
def compare_rollup(spark, d):
    classes = regions.compare(*_compared(spark, d)).withColumn("page", (F.col("page_id") % 3).cast("string"))
    return regions.compare_rollup(classes, "page")


# --- text ----------------------------------------------------------------------------------------------------------------------

# The label classes for ASCII texts.
SQL_AREA = r"regexp_matches({0}, '(?i)\d{{1,4}}\s*(sq\.?\s*m(tr)?|sqm|m2)\b')"
SQL_BOOTH = r"regexp_matches({0}, '\b([A-Z]{{1,3}}[-\s]?\d{{1,4}}|\d{{1,2}}[A-Z]{{1,2}}[-\s]?\d{{0,4}})[A-Z]?\b')"
SQL_COMPANY = r"regexp_matches({0}, '(?i)\b(PVT|LTD|LLP|INC|LLC|EXPORTS?|IMPEX|INDUSTR|ENTERPRIS|INTERNATIONAL|TRADERS?|OVERSEAS|LIFECARE|TECHNOLOG)\b')"
SQL_FACILITY = r"regexp_matches({0}, '(?i)\b(TOILET|LIFT|DRINKING|WATER|CARGO|SERVICE|FHC|RWP|JC|HUB|LV|STAIR|ENTRY|EXIT|GATE|RAMP|PANTRY|FIRE|ELECTRIC|DG|AHU|DUCT|SHAFT)\b')"
SQL_LIKE = f"({SQL_AREA} OR {SQL_COMPANY} OR ({SQL_BOOTH} AND len(regexp_extract_all({{0}}, '\\S+')) <= 8))"
SQL_TAG = f"CASE WHEN {{0}} = '' THEN 'empty' WHEN {SQL_LIKE} THEN 'boothlike' WHEN {SQL_FACILITY} THEN 'facility' ELSE 'text' END"


@query(f"SELECT span_id, text, {SQL_LIKE.format('text')} AS boothlike, {SQL_TAG.format('text')} AS tag FROM text_items", "text_items")
def text_tags(spark, d):
    return view(spark, d, "text_items").select("span_id", "text", texts.is_boothlike(F.col("text")).alias("boothlike"), texts.tag(F.col("text")).alias("tag"))


HELD = "held AS (SELECT b.page_id, b.box_id, t.span_id, t.text, (x0 + t.x1) / 2 AS cx, (y0 + t.y1) / 2 AS cy FROM box_pool b JOIN text_items t ON b.page_id = t.page_id AND (x0 + t.x1) / 2 BETWEEN b.x1 AND b.x2 AND (y0 + t.y1) / 2 BETWEEN b.y1 AND b.y2)"
NEAR = """near AS (SELECT page_id, box_id, span_id, text, cx, cy FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY shared DESC, box_id) AS nth FROM (
  SELECT b.page_id, b.box_id, t.span_id, t.text, (x0 + t.x1) / 2 AS cx, (y0 + t.y1) / 2 AS cy, (t.x1 - x0) * (t.y1 - y0) AS whole, greatest(0, least(b.x2, t.x1) - greatest(b.x1, x0)) * greatest(0, least(b.y2, t.y1) - greatest(b.y1, y0)) AS shared
  FROM box_pool b JOIN text_items t ON b.page_id = t.page_id WHERE t.span_id NOT IN (SELECT span_id FROM held)) WHERE shared > 0) WHERE nth = 1 AND shared >= 0.30 * whole)"""
LABELS = f"""owned AS (SELECT * FROM held UNION ALL SELECT * FROM near), named AS (SELECT box_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY round_even(cy / 8, 0), cx, span_id), '\\s+', ' ', 'g')) AS label, CAST(count(*) AS INT) AS n_text FROM owned GROUP BY box_id),
  labelled AS (SELECT b.*, coalesce(label, '') AS label, coalesce(n_text, 0) AS n_text, {SQL_TAG.format("coalesce(label, '')")} AS text_status FROM box_pool b LEFT JOIN named USING (box_id))"""


@query(f", {HELD} SELECT * FROM held", "box_pool", "text_items")
def text_in_box(spark, d):
    return labels.text_in_box(view(spark, d, "box_pool"), view(spark, d, "text_items"))


@query(f", {HELD}, {NEAR} SELECT * FROM near", "box_pool", "text_items")
def best_overlap(spark, d):
    return labels.best_overlap(view(spark, d, "box_pool"), view(spark, d, "text_items"))


def _labelled(spark, d):
    return labels.label_boxes(view(spark, d, "box_pool"), view(spark, d, "text_items"))


@query(f", {HELD}, {NEAR}, {LABELS} SELECT box_id, label, n_text, text_status FROM labelled", "box_pool", "text_items")
def labelled_boxes(spark, d):
    return _labelled(spark, d).select("box_id", "label", "n_text", "text_status")


ALONE = f"""spans AS (SELECT page_id, span_id AS box_id, text, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest(60.0, 1.6::DOUBLE * (x1 - x0)) / 2 AS w, greatest(60.0, 2.2::DOUBLE * (y1 - y0)) / 2 AS h FROM text_items
    WHERE {SQL_LIKE.format('text')} AND span_id NOT IN (SELECT span_id FROM held)),
  holds AS (SELECT a.page_id, a.box_id, list(b.box_id) AS rejects FROM spans a JOIN spans b ON a.page_id = b.page_id AND b.box_id < a.box_id AND abs(a.cx - b.cx) <= b.w AND abs(a.cy - b.cy) <= b.h GROUP BY ALL)"""


@query(f""", {HELD}, {ALONE}, {greedy("SELECT s.page_id, s.box_id, coalesce(rejects, []) AS rejects FROM spans s LEFT JOIN holds USING (page_id, box_id)", "box_id")}
SELECT page_id, box_id AS span_id, text AS label, cx - w AS x1, cy - h AS y1, cx + w AS x2, cy + h AS y2, 0.5::DOUBLE AS score, 'text_recovered' AS source, {SQL_TAG.format('text')} AS text_status FROM spans JOIN chosen USING (page_id, box_id)""", "box_pool", "text_items")
def recover_missing(spark, d):
    return labels.recover_missing(view(spark, d, "box_pool"), view(spark, d, "text_items"))


POLICY = """policies AS (SELECT page_id, CASE WHEN count(*) FILTER (text_status = 'boothlike') >= greatest(10.0, 0.15 * count(*)) THEN 'strict' ELSE 'shape' END AS policy FROM labelled GROUP BY page_id)"""


@query(f", {HELD}, {NEAR}, {LABELS}, {POLICY} SELECT * FROM policies", "box_pool", "text_items")
def adaptive_policy(spark, d):
    return regions.resolve_policy(_labelled(spark, d))


@query(f""", {HELD}, {NEAR}, {LABELS}, {POLICY} SELECT box_id, policy FROM labelled JOIN policies USING (page_id)
WHERE CASE policy WHEN 'strict' THEN text_status = 'boothlike' ELSE source IN ('color', 'bordered', 'bigregion') OR source = 'opencv_strict' AND text_status <> 'empty' OR source NOT IN ('color', 'bordered', 'bigregion', 'opencv_strict') AND text_status = 'boothlike' END""", "box_pool", "text_items")
def policy_filter(spark, d):
    boxes = _labelled(spark, d)
    return regions.apply_policy(boxes, regions.resolve_policy(boxes)).select("box_id", "policy")


@query("""SELECT page_id, span_id, text, x0, y0, x1, y1, conf FROM (SELECT *, row_number() OVER (PARTITION BY page_id, text, round_even((x0 + x1) / 2 / 8, 0), round_even((y0 + y1) / 2 / 8, 0) ORDER BY span_id) AS nth
FROM (SELECT span_id, page_id, trim(text) AS text, floor(x0 / 100) * 100 AS x0, y0 - y0 % 100 AS y0, floor(x0 / 100) * 100 + 20 AS x1, y0 - y0 % 100 + 10 AS y1, span_id % 10 / 10.0 AS conf FROM text_items) WHERE conf >= 0.3 AND text <> '') WHERE nth = 1""", "text_items")
def recognised_spans(spark, d):
    t = view(spark, d, "text_items")
    x, y = F.floor(F.col("x0") / 100) * 100.0, F.col("y0") - F.col("y0") % 100
    return labels.dedupe_spans(t.select("page_id", "span_id", "text", x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 10).alias("y1"), (F.col("span_id") % 10 / 10).alias("conf")))


@query("SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY span_id) - 1 AS span_id, trim(text) AS text, round(x0 * 200 / 72.0, 6) AS x0, round(y0 * 200 / 72.0, 6) AS y0, round(x1 * 200 / 72.0, 6) AS x1, round(y1 * 200 / 72.0, 6) AS y1 FROM text_items WHERE trim(text) <> ''", "text_items")
def text_layer(spark, d):
    t = view(spark, d, "text_items")
    span = F.struct("span_id", F.struct(F.array(F.struct(F.array(F.struct("text", F.array("x0", "y0", "x1", "y1").alias("bbox"))).alias("spans"))).alias("lines")).alias("block"))
    pages = t.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(span)), lambda x: x["block"]).alias("blocks"))
    out = formats.explode_spans(pages, 200.0)
    return out.select("page_id", "span_id", "text", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


# --- regions -------------------------------------------------------------------------------------------------------------------

FIRST_HALL = """found AS (SELECT b.box_id, h.hall_idx, h.x2 - h.x1 AS hw, h.y2 - h.y1 AS hh, (b.x2 - b.x1) * (b.y2 - b.y1) AS area, row_number() OVER (PARTITION BY b.box_id ORDER BY h.hall_idx) AS nth
  FROM box_pool b JOIN halls h ON b.page_id = h.page_id AND (b.x1 + b.x2) / 2 BETWEEN h.x1 AND h.x2 AND (b.y1 + b.y2) / 2 BETWEEN h.y1 AND h.y2),
  assigned AS (SELECT b.page_id, b.box_id, coalesce(CASE WHEN area < 0.02 * hw * hh THEN 'Hall_' || (hall_idx + 1) END, 'Other') AS hall FROM box_pool b LEFT JOIN (SELECT * FROM found WHERE nth = 1) USING (box_id))"""


@query(f", {FIRST_HALL} SELECT * FROM assigned", "box_pool", "halls")
def hall_map(spark, d):
    return regions.assign_halls(view(spark, d, "box_pool"), view(spark, d, "halls"), 0.02)


@query(f", {FIRST_HALL} SELECT page_id, hall, count(*) AS n_booths FROM assigned GROUP BY ALL", "box_pool", "halls")
def hall_totals(spark, d):
    return regions.assign_halls(view(spark, d, "box_pool"), view(spark, d, "halls"), 0.02).groupBy("page_id", "hall").agg(F.count(F.lit(1)).alias("n_booths"))


ARBITRATE = """small AS (SELECT * FROM box_pool), big AS (SELECT page_id, hall_idx AS box_id, x1, y1, x1 + (x2 - x1) / 2 AS x2, y1 + (y2 - y1) / 3 AS y2 FROM halls),
  shared AS (SELECT b.page_id, b.box_id, s.box_id AS small_id, greatest(0, least(s.x2, b.x2) - greatest(s.x1, b.x1)) * greatest(0, least(s.y2, b.y2) - greatest(s.y1, b.y1)) AS shared FROM big b JOIN small s USING (page_id)),
  rated AS (SELECT b.*, coalesce((SELECT sum(shared) FROM shared s WHERE s.page_id = b.page_id AND s.box_id = b.box_id), 0) / ((x2 - x1) * (y2 - y1)) AS cover,
    (SELECT count(DISTINCT (floor((t.x0 + t.x1) / 2 / 250), floor((t.y0 + t.y1) / 2 / 250))) FROM text_items t WHERE t.page_id = b.page_id AND (t.x0 + t.x1) / 2 BETWEEN b.x1 AND b.x2 AND (t.y0 + t.y1) / 2 BETWEEN b.y1 AND b.y2) AS labels FROM big b),
  alone AS (SELECT page_id, box_id FROM rated WHERE NOT (cover >= 2.4 OR labels > 1))"""


@query(f""", {ARBITRATE} SELECT page_id, box_id, 'big' AS kind FROM alone
UNION ALL SELECT page_id, box_id, 'small' FROM small WHERE box_id NOT IN (SELECT small_id FROM shared s JOIN alone a USING (page_id, box_id) WHERE shared > 0)""", "box_pool", "halls", "text_items")
def big_regions(spark, d):
    h = view(spark, d, "halls")
    big = h.select("page_id", F.col("hall_idx").alias("box_id"), "x1", "y1", (F.col("x1") + (F.col("x2") - F.col("x1")) / 2).alias("x2"), (F.col("y1") + (F.col("y2") - F.col("y1")) / 3).alias("y2"))
    return regions.arbitrate(view(spark, d, "box_pool"), big, view(spark, d, "text_items"), 2.4, 1)


# --- rasters -------------------------------------------------------------------------------------------------------------------

KERNEL = "(VALUES (-1), (0), (1)) {0}(v)"
DILATED = f"SELECT DISTINCT page_id, y + a.v AS y, x + b.v AS x FROM {{src}} p, {KERNEL.format('a')}, {KERNEL.format('b')}"
ERODED = f"SELECT page_id, y + a.v AS y, x + b.v AS x FROM {{src}} p, {KERNEL.format('a')}, {KERNEL.format('b')} GROUP BY 1, 2, 3 HAVING count(*) = 9"
LINES = """flat AS (SELECT page_id, y, min(x) AS lo, max(x) AS hi, count(*) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS g FROM {src}) GROUP BY page_id, y, g),
  upright AS (SELECT page_id, x, min(y) AS lo, max(y) AS hi, count(*) AS n FROM (SELECT *, y - row_number() OVER (PARTITION BY page_id, x ORDER BY y) AS g FROM {src}) GROUP BY page_id, x, g)"""


@query(DILATED.format(src="pixels"), "pixels")
def dilate(spark, d):
    return raster.dilate(view(spark, d, "pixels"), 3)


@query(ERODED.format(src="pixels"), "pixels")
def erode(spark, d):
    return raster.erode(view(spark, d, "pixels"), 3)


@query(f", e AS ({ERODED.format(src='pixels')}), o AS ({DILATED.format(src='e')}), c1 AS ({DILATED.format(src='pixels')}), c AS ({ERODED.format(src='c1')}) SELECT 'open' AS op, * FROM o UNION ALL SELECT 'close', * FROM c", "pixels")
def open_and_close(spark, d):
    p = view(spark, d, "pixels")
    return raster.opened(p, 3).withColumn("op", F.lit("open")).unionByName(raster.closed(p, 3).withColumn("op", F.lit("close")))


@query(f", {LINES.format(src='pixels')} SELECT p.* FROM pixels p WHERE EXISTS (SELECT 1 FROM flat f WHERE f.page_id = p.page_id AND f.y = p.y AND p.x BETWEEN lo AND hi AND n >= 6) OR EXISTS (SELECT 1 FROM upright u WHERE u.page_id = p.page_id AND u.x = p.x AND p.y BETWEEN lo AND hi AND n >= 6)", "pixels")
def line_pixels(spark, d):
    return raster.line_pixels(view(spark, d, "pixels"), 6)


PACKED = "(page_id << 40) + (y << 20) + x"
def labelled(src: str, reach: int = 1) -> str:
    """CTEs that label the pixels of src: lab (page_id, y, x, label), by runs that touch, cornerwise too if reach is 1."""
    return f"""{LINES.format(src=src)}, line AS (SELECT page_id, y, lo, hi, (page_id << 40) + (y << 20) + lo AS run FROM flat),
  touch AS (SELECT a.run AS i, b.run AS j FROM line a JOIN line b ON a.page_id = b.page_id AND abs(a.y - b.y) = 1 AND a.lo <= b.hi + {reach} AND b.lo <= a.hi + {reach}),
  reach(run, other) AS (SELECT run, run FROM line UNION SELECT r.run, t.j FROM reach r JOIN touch t ON r.other = t.i),
  comp AS (SELECT run, min(other) AS label FROM reach GROUP BY run), lab AS (SELECT p.*, c.label FROM {src} p JOIN line l ON p.page_id = l.page_id AND p.y = l.y AND p.x BETWEEN l.lo AND l.hi JOIN comp c ON l.run = c.run)"""


LABELLED = labelled("specks")


@query(f", {LABELLED} SELECT page_id, y, x, label FROM lab", "specks")
def pixel_components(spark, d):
    return raster.label(view(spark, d, "specks"), 8)


@query(f", {LABELLED} SELECT page_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM lab GROUP BY page_id, label HAVING (max(x) + 1 - min(x)) * (max(y) + 1 - min(y)) >= 4", "specks")
def component_boxes(spark, d):
    return raster.component_boxes(raster.label(view(spark, d, "specks"), 8), 4)


@query(f", {LABELLED} SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY label) AS component, x, y, w, h, area, round(cx, 9) AS cx, round(cy, 9) AS cy FROM (SELECT page_id, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM lab GROUP BY page_id, label)", "specks")
def component_stats(spark, d):
    s = raster.component_stats(raster.label(view(spark, d, "specks"), 8))
    return s.withColumn("component", F.col("component").cast("long")).withColumn("cx", nth_nine("cx")).withColumn("cy", nth_nine("cy"))


@query(f", {LABELLED}, s AS (SELECT page_id, label, count(*) AS n FROM lab GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, label) AS nth FROM s) SELECT l.page_id, l.label, y, x FROM lab l JOIN b ON l.page_id = b.page_id AND l.label = b.label WHERE nth = 1 AND n >= 5", "specks")
def largest_component(spark, d):
    return raster.largest(raster.label(view(spark, d, "specks"), 8), F.lit(5))


@query(f", {LABELLED} SELECT DISTINCT page_id, label FROM lab WHERE y IN (0, 39) OR x IN (0, 59)", "specks")
def border_components(spark, d):
    return raster.touches_border(raster.label(view(spark, d, "specks"), 8), HEIGHT, WIDTH)


HOLES = f"""void AS (SELECT p.page_id, a.range AS y, b.range AS x FROM (SELECT DISTINCT page_id FROM pixels) p, range(0, 40) a, range(0, 60) b EXCEPT SELECT page_id, y, x FROM pixels), {LINES.format(src='void')},
  line AS (SELECT page_id, y, lo, hi, n, (page_id << 40) + (y << 20) + lo AS run FROM flat), touch AS (SELECT a.run AS i, b.run AS j FROM line a JOIN line b ON a.page_id = b.page_id AND abs(a.y - b.y) = 1 AND a.lo <= b.hi AND b.lo <= a.hi),
  reach(run, other) AS (SELECT run, run FROM line UNION SELECT r.run, t.j FROM reach r JOIN touch t ON r.other = t.i), comp AS (SELECT run, min(other) AS label FROM reach GROUP BY run),
  good AS (SELECT label FROM line JOIN comp USING (run) GROUP BY label HAVING sum(n) <= 3 AND NOT bool_or(y IN (0, 39) OR lo = 0 OR hi = 59))"""


@query(f", {HOLES} SELECT page_id, y, x FROM pixels UNION ALL SELECT v.page_id, v.y, v.x FROM void v JOIN line l ON v.page_id = l.page_id AND v.y = l.y AND v.x BETWEEN l.lo AND l.hi JOIN comp c ON l.run = c.run WHERE c.label IN (SELECT label FROM good)", "pixels")
def fill_holes(spark, d):
    return raster.fill_holes(view(spark, d, "pixels"), 3, HEIGHT, WIDTH)


BANDS = [([0, 0, 100], [120, 255, 255]), ([200, 30, 0], [255, 90, 200])]


@query("SELECT page_id, y, x FROM colors WHERE b BETWEEN 0 AND 120 AND g BETWEEN 0 AND 255 AND r BETWEEN 100 AND 255 OR b BETWEEN 200 AND 255 AND g BETWEEN 30 AND 90 AND r BETWEEN 0 AND 200", "colors")
def color_range(spark, d):
    return raster.in_range(view(spark, d, "colors"), BANDS)


FAR = "least(abs(c.h - {0}.h), 180 - abs(c.h - {0}.h)) > 8"
SQL_PLANES = "planes AS (SELECT *, greatest(b, g, r) AS v, CAST(CASE WHEN greatest(b, g, r) > 0 THEN round_even(255.0 * (greatest(b, g, r) - least(b, g, r)) / greatest(b, g, r), 0) ELSE 0 END AS INT) AS s, CAST(round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0) AS INT) AS gray FROM colors)"


@query(f", {SQL_PLANES} SELECT page_id, y, x, v, s, gray FROM planes", "colors")
def color_planes(spark, d):
    return raster.planes(view(spark, d, "colors")).select("page_id", "y", "x", "v", "s", "gray")


@query(f""", {SQL_PLANES}, h AS (SELECT page_id, s, v, CAST(coalesce((round_even(30.0 * CASE WHEN r = v THEN (g - b) / nullif(v - least(b, g, r), 0) WHEN g = v THEN 2 + (b - r) / nullif(v - least(b, g, r), 0) ELSE 4 + (r - g) / nullif(v - least(b, g, r), 0) END, 0) + 180) % 180, 0) AS INT) AS h FROM planes),
  c AS (SELECT page_id, h, count(*) AS n FROM h WHERE s >= 60 AND v >= 60 GROUP BY page_id, h),
  p1 AS (SELECT page_id, h, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, h DESC) AS nth FROM c) WHERE nth = 1),
  p2 AS (SELECT page_id, h, n FROM (SELECT c.*, row_number() OVER (PARTITION BY c.page_id ORDER BY c.n DESC, c.h DESC) AS nth FROM c JOIN p1 USING (page_id) WHERE {FAR.format('p1')}) WHERE nth = 1),
  p3 AS (SELECT page_id, h, n FROM (SELECT c.*, row_number() OVER (PARTITION BY c.page_id ORDER BY c.n DESC, c.h DESC) AS nth FROM c JOIN p1 USING (page_id) JOIN p2 USING (page_id) WHERE {FAR.format('p1')} AND {FAR.format('p2')}) WHERE nth = 1)
SELECT page_id, rank, h AS hue, n, greatest(0, h - 8) AS lo, least(179, h + 8) AS hi FROM (SELECT 1 AS rank, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3)""", "colors")
def hue_bands(spark, d):
    return raster.hue_bands(view(spark, d, "colors"))


@query(f", {SQL_PLANES}, near AS (SELECT page_id, y + a.v AS y, x + b.v AS x, gray FROM planes p, {KERNEL.format('a')}, {KERNEL.format('b')}) SELECT p.page_id, p.y, p.x, CAST(quantile_disc(n.gray, 0.5) AS INT) AS median FROM colors p JOIN near n USING (page_id, y, x) GROUP BY 1, 2, 3", "colors")
def median_filter(spark, d):
    return raster.median(raster.planes(view(spark, d, "colors")), 3)


AROUND = "(SELECT unnest(range(-4, 5)) AS v) {0}"


@query(f", {SQL_PLANES}, near AS (SELECT page_id, y + a.v AS y, x + b.v AS x, gray FROM planes p, {AROUND.format('a')}, {AROUND.format('b')}) SELECT p.page_id, p.y, p.x, CAST(quantile_disc(n.gray, 0.5) AS INT) AS median FROM colors p JOIN near n USING (page_id, y, x) GROUP BY 1, 2, 3", "colors")
def median_floor(spark, d):
    return raster.median(raster.planes(view(spark, d, "colors")), 9)


FULL = "page AS (SELECT a.range AS y, b.range AS x, CAST((a.range * 37 + b.range * b.range * 11) % 256 AS INT) AS s FROM range(0, 40) a, range(0, 60) b)"


@query(f"WITH {FULL}, near AS (SELECT p.y, p.x, dy.v AS dy, dx.v AS dx, q.s FROM page p, {KERNEL.format('dy')}, {KERNEL.format('dx')}, page q WHERE q.y = greatest(0, least(39, p.y + dy.v)) AND q.x = greatest(0, least(59, p.x + dx.v))) SELECT 0::BIGINT AS page_id, y, x, round(sqrt(sum(s * dx * (2 - abs(dy))) ** 2 + sum(s * dy * (2 - abs(dx))) ** 2), 6) AS magnitude FROM near GROUP BY y, x")
def sobel_magnitude(spark, d):
    page = spark.range(HEIGHT * WIDTH).select(F.lit(0).cast("long").alias("page_id"), F.floor(F.col("id") / WIDTH).alias("y"), (F.col("id") % WIDTH).alias("x"))
    page = page.withColumn("s", ((F.col("y") * 37 + F.col("x") * F.col("x") * 11) % 256).cast("int"))
    return raster.sobel(page, HEIGHT, WIDTH).withColumn("magnitude", F.round("magnitude", 6))


@query("SELECT page_id, quantile_cont(greatest(b, g, r), 0.8) AS q FROM colors GROUP BY page_id", "colors")
def white_level(spark, d):
    return view(spark, d, "colors").groupBy("page_id").agg(F.percentile(F.greatest("b", "g", "r"), F.lit(0.8)).alias("q"))


def on_page(sql: str) -> str:
    return f"SELECT * FROM ({sql}) WHERE y BETWEEN 0 AND {HEIGHT - 1} AND x BETWEEN 0 AND {WIDTH - 1}"


def clean(name: str, src: str) -> str:
    """CTEs: the mask src, opened and closed by kernels of 3, as name."""
    steps = ((f"{name}1", ERODED.format(src=src)), (f"{name}2", on_page(DILATED.format(src=f"{name}1"))), (f"{name}3", on_page(DILATED.format(src=f"{name}2"))), (name, ERODED.format(src=f"{name}3")))
    return ", ".join(f"{n} AS ({sql})" for n, sql in steps)


MASK = f"""red AS (SELECT page_id, y, x FROM drawn WHERE b <= 120 AND r >= 100), blue AS (SELECT page_id, y, x FROM drawn WHERE b >= 200 AND g BETWEEN 30 AND 90 AND r <= 200), {clean('redder', 'red')}, {clean('bluer', 'blue')},
  mask AS (SELECT * FROM redder UNION SELECT * FROM bluer)"""
VOID = f"SELECT p.page_id, a.range AS y, b.range AS x FROM (SELECT DISTINCT page_id FROM {{src}}) p, range(0, {HEIGHT}) a, range(0, {WIDTH}) b EXCEPT SELECT page_id, y, x FROM {{src}}"
BOUNDS = "SELECT page_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM lab GROUP BY page_id, label"


@query(f", {MASK} SELECT * FROM mask", "drawn")
def color_mask(spark, d):
    return raster.color_mask(view(spark, d, "drawn"), BANDS, 3, 3, HEIGHT, WIDTH)


COLOR_CELLS = f"{MASK}, {labelled('mask')}, cells AS ({BOUNDS} HAVING (max(x) + 1 - min(x)) * (max(y) + 1 - min(y)) >= 12)"


@query(f", {COLOR_CELLS} SELECT * FROM cells", "drawn")
def color_cells(spark, d):
    return raster.color_cells(view(spark, d, "drawn"), BANDS, 12, HEIGHT, WIDTH)


OPEN = f"""{SQL_PLANES}, walls AS ({on_page(DILATED.format(src='(SELECT * FROM planes WHERE v < 130)'))}),
  white AS (SELECT page_id, greatest(200, least(255, CASE WHEN count(*) FILTER (s < 25) > 1000 THEN CAST(floor(quantile_cont(v, 0.8) FILTER (s < 25)) AS INT) ELSE 245 END)) AS white FROM planes GROUP BY page_id),
  free AS (SELECT p.page_id, y, x FROM planes p JOIN white USING (page_id) WHERE v >= white - 60 AND s < 40 AND NOT EXISTS (SELECT 1 FROM walls w WHERE w.page_id = p.page_id AND w.y = p.y AND w.x = p.x))"""


@query(f", {OPEN}, {labelled('free', 0)} SELECT page_id, y, x FROM lab WHERE label IN (SELECT label FROM lab WHERE y IN (0, {HEIGHT - 1}) OR x IN (0, {WIDTH - 1}))", "colors")
def page_background(spark, d):
    c = view(spark, d, "colors")
    return raster.background(c, raster.planes(c).where("v < 130").select("page_id", "y", "x"), HEIGHT, WIDTH)


LINED = f"dark AS (SELECT page_id, y, x FROM drawn WHERE round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0) < 100), sealed AS ({on_page(DILATED.format(src='dark'))}), paper AS ({VOID.format(src='sealed')})"


@query(f", {LINED}, {labelled('paper')}, cells AS ({BOUNDS} HAVING count(*) >= 4) SELECT * FROM cells", "drawn")
def bordered_cells(spark, d):
    return raster.bordered_cells(view(spark, d, "drawn"), HEIGHT, WIDTH, 100, 3, 4)


@query(f", {COLOR_CELLS} SELECT page_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, 'color' AS source, 0.75::DOUBLE AS score FROM cells UNION ALL SELECT page_id, x1 / 20, y1 / 20, x2 / 20, y2 / 20, 'bordered', 0.45 FROM box_pool", "drawn", "box_pool")
def detector_modes(spark, d):
    found = raster.color_cells(view(spark, d, "drawn"), BANDS, 12, HEIGHT, WIDTH)
    lined = view(spark, d, "box_pool").select("page_id", *[(F.col(c) / 20).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return raster.ensemble("both", color=found, bordered=lined, opencv_strict=lined.limit(0))


@query(f", {LABELLED} SELECT page_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM lab GROUP BY page_id, label HAVING count(*) BETWEEN 2 AND 240 AND min(x) > 2 AND min(y) > 2 AND max(x) + 1 < {WIDTH - 2} AND max(y) + 1 < {HEIGHT - 2} AND least(w, h) >= 2 AND area / (w * h) >= 0.6 AND least(w, h) / greatest(w, h) >= 0.4", "specks")
def cell_shapes(spark, d):
    stats = raster.component_stats(raster.label(view(spark, d, "specks"), 8))
    return raster.shape_filter(stats, HEIGHT, WIDTH, 2 / (HEIGHT * WIDTH), 0.1, 2, 0.6, 0.4).select("page_id", "x", "y", "w", "h", "area")


# --- lines ---------------------------------------------------------------------------------------------------------------------

PORTS = "ports AS (SELECT page_id, seg, cluster, '1' AS e, ax AS x, ay AS y FROM segments UNION ALL SELECT page_id, seg, cluster, '2', bx, by_ FROM segments)"


@query(f", {PORTS} SELECT a.page_id, a.seg AS i, b.seg AS j, a.e AS ei, b.e AS ej, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS d FROM ports a JOIN ports b ON a.page_id = b.page_id AND a.seg < b.seg AND a.cluster = b.cluster AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 60", "segments")
def end_pairs(spark, d):
    return trails.end_pairs(view(spark, d, "segments"), 60.0).withColumn("d", F.round("d", 6))


BRIDGES = f"""ends AS (SELECT a.page_id, a.cluster <> b.cluster AS crossing, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.seg AS i, b.seg AS j, a.e AS ei, b.e AS ej FROM ports a JOIN ports b ON a.page_id = b.page_id AND a.seg < b.seg),
  turn AS (SELECT *, i - page_id * 30 + 1 AS ii, j - page_id * 30 + 1 AS jj, row_number() OVER (PARTITION BY page_id ORDER BY crossing, d, i, j, ei, ej) AS step FROM ends WHERE d < CASE WHEN crossing THEN 15 ELSE 60 END),
  walk(page_id, done, used, part, taken) AS (SELECT DISTINCT page_id, 0::BIGINT, []::VARCHAR[], range(1, 31), false FROM turn
    UNION ALL SELECT page_id, step, CASE WHEN ok THEN list_concat(used, [i || ei, j || ej]) ELSE used END, CASE WHEN ok THEN list_transform(part, lambda x: CASE WHEN x = part[jj] THEN part[ii] ELSE x END) ELSE part END, ok
    FROM (SELECT t.*, used, part, NOT list_has_any(used, [i || ei, j || ej]) AND part[ii] <> part[jj] AS ok FROM walk w JOIN turn t ON t.page_id = w.page_id AND t.step = w.done + 1))"""


@query(f""", {PORTS}, {BRIDGES} SELECT t.page_id, i AS seg_i, j AS seg_j, ei AS ep_i, ej AS ep_j, round(d, 2) AS gap, CASE WHEN NOT crossing OR a.confidence >= b.confidence THEN a.cluster ELSE b.cluster END AS cluster, crossing AS cross
FROM turn t JOIN walk w ON t.page_id = w.page_id AND t.step = w.done AND w.taken JOIN segments a ON a.seg = t.i JOIN segments b ON b.seg = t.j""", "segments")
def bridges(spark, d):
    return trails.find_bridges(view(spark, d, "segments"), 60.0, 15.0)


@query("SELECT path_id, pos, round(CASE WHEN n > 5 AND pos >= 2 AND pos < n - 2 THEN mx ELSE x END, 6) AS x, round(CASE WHEN n > 5 AND pos >= 2 AND pos < n - 2 THEN my ELSE y END, 6) AS y FROM (SELECT *, count(*) OVER (PARTITION BY path_id) AS n, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM paths WINDOW w AS (PARTITION BY path_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))", "paths")
def smooth_paths(spark, d):
    return trails.smooth(view(spark, d, "paths"), 5).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6)).withColumn("pos", F.col("pos").cast("long"))


@query(""", s AS (SELECT *, CAST(greatest(1, ceil(coalesce(sqrt((nx - x) ** 2 + (ny - y) ** 2), 0) / 25.0)) AS INT) AS n FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM paths WINDOW w AS (PARTITION BY path_id ORDER BY pos)))
SELECT path_id, CAST(pos AS BIGINT) AS pos, CAST(k AS INT) AS k, round(CASE WHEN k = 0 THEN x ELSE x + k / n * (nx - x) END, 3) AS x, round(CASE WHEN k = 0 THEN y ELSE y + k / n * (ny - y) END, 3) AS y FROM (SELECT *, unnest(range(0, n)) AS k FROM s)""", "paths")
def densify_paths(spark, d):
    """Every point, to the thousandth. Coordinates are whole and a step is cut into ten at most, so no point lies halfway between two thousandths."""
    p = trails.densify(view(spark, d, "paths"), 25.0)
    return p.select("path_id", F.col("pos").cast("long").alias("pos"), "k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(""", s AS (SELECT page_id, seg, (seg * 7) % 500 AS px, (seg * 11) % 400 AS py, ax, ay, bx - ax AS dx, by_ - ay AS dy, (bx - ax) ** 2 + (by_ - ay) ** 2 AS l FROM segments)
SELECT seg, round(CASE WHEN l < 1e-12 THEN sqrt((px - ax) ** 2 + (py - ay) ** 2) ELSE sqrt((px - ax - greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / l)) * dx) ** 2 + (py - ay - greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / l)) * dy) ** 2) END, 6) AS d, CAST(trunc(px * 0.37) AS INT) AS px FROM s""", "segments")
def segment_distances(spark, d):
    px, py = (F.col("seg") * 7 % 500).cast("double"), (F.col("seg") * 11 % 400).cast("double")
    off = geo.segment_distance(px, py, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"))
    return view(spark, d, "segments").select("seg", F.round(off, 6).alias("d"), geo.to_pixel(px, F.lit(0.37)).alias("px"))


@query("""SELECT seg, round(abs(ax * by_ - bx * ay) / 2, 6) AS triangle, round(100.0 * 80 - 0, 6) AS rectangle, round(greatest(0, 100 - seg % 120) * greatest(0, 80 - seg % 70) / (2 * 8000 - greatest(0, 100 - seg % 120) * greatest(0, 80 - seg % 70)), 6) AS iou FROM segments""", "segments")
def polygon_overlaps(spark, d):
    s = view(spark, d, "segments")
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    rect = lambda x, y: F.array(point(x, y), point(x + 100, y), point(x + 100, y + 80), point(x, y + 80))
    one, other = rect(F.lit(0), F.lit(0)), rect(F.col("seg") % 120, F.col("seg") % 70)
    triangle = F.array(point(F.lit(0), F.lit(0)), point(F.col("ax"), F.col("ay")), point(F.col("bx"), F.col("by_")))
    return s.select("seg", F.round(polygon_area(triangle), 6).alias("triangle"), F.round(polygon_area(one), 6).alias("rectangle"), F.round(polygon_overlap(one, other)["iou"], 6).alias("iou"))


def _drawn(spark, d):
    """Predictions of slanted strips, and the pages they are on."""
    s = view(spark, d, "segments")
    dx, dy = F.lit(6.0), F.lit(14.0)
    strip = [(F.col("ax") + 100, F.col("ay") + 100), (F.col("bx") + 220, F.col("by_") + 120), (F.col("bx") + 220 + dx, F.col("by_") + 120 + dy), (F.col("ax") + 100 + dx, F.col("ay") + 100 + dy)]
    points = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in strip])
    preds = s.select("page_id", F.col("seg").alias("idx"), "confidence", F.lit("trails").alias("class"), F.lit(1).alias("class_id"), F.col("seg").cast("string").alias("detection_id"), points.alias("points"))
    size = preds.select("page_id").distinct().select("page_id", *[F.lit(float(v)).alias(c) for c, v in (("w", 900), ("h", 700), ("image_w", 900), ("image_h", 700))])
    return preds, size, s.select("page_id", F.col("seg").alias("idx"), "cluster")


@query()
def merged_trails(spark, d):
    return trails.suppress_trails(trails.merge_trails(*_drawn(spark, d)))


@query()
def color_clusters(spark, d):
    c = view(spark, d, "colors").select("page_id", (F.col("y") * WIDTH + F.col("x") + F.col("page_id") * HEIGHT * WIDTH).alias("seg"), "r", "g", "b")
    return trails.cluster_colors(c)


@query(", s AS (SELECT page_id * 10 + y AS seg, r, g, b, greatest(r, g, b) - least(r, g, b) AS sat FROM colors), t AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY sat DESC, r, g, b) AS nth, greatest(1, floor(count(*) OVER (PARTITION BY seg) / 5)) AS top FROM s) SELECT seg, CAST(trunc(median(r)) AS INT) AS r, CAST(trunc(median(g)) AS INT) AS g, CAST(trunc(median(b)) AS INT) AS b FROM t WHERE nth <= top GROUP BY seg", "colors")
def color_samples(spark, d):
    return trails.sample_color(view(spark, d, "colors").select((F.col("page_id") * 10 + F.col("y")).alias("seg"), "r", "g", "b"))


# --- sources -------------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, box_id - page_id * 1000 - 1 AS box_id, x1, y1, x2, y2, CASE WHEN box_id % 3 = 0 THEN 1.0 ELSE score END AS score, source FROM box_pool", "box_pool")
def json_pool(spark, d):
    pool = view(spark, d, "box_pool").withColumn("score", F.when(F.col("box_id") % 3 != 0, F.col("score")))
    nested = formats.pool_document(pool).select("page_id", F.to_json("boxes").alias("json"))
    boxes = F.from_json("json", "array<struct<bbox:array<double>,score:double,source:string>>")
    return formats.explode_pool(nested.select("page_id", boxes.alias("boxes"))).select("page_id", "box_id", "x1", "y1", "x2", "y2", "score", "source")


MODEL = "model AS (SELECT c_custkey AS page_id, '{\"image\":{\"width\":' || (c_custkey % 2 * 640) || ',\"height\":480},\"predictions\":[{\"x\":' || c_custkey % 90 || ',\"y\":30,\"width\":' || c_custkey % 7 * 4 || ',\"height\":10,\"confidence\":0.5,\"class\":\"hall\",\"points\":[{\"x\":' || c_custkey % 90 || ',\"y\":20}]}]}' AS output FROM customer)"


def _model(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit('{"image":{"width":'), k % 2 * 640, F.lit(',"height":480},"predictions":[{"x":'), k % 90, F.lit(',"y":30,"width":'), k % 7 * 4, F.lit(',"height":10,"confidence":0.5,"class":"hall","points":[{"x":'), k % 90, F.lit(',"y":20}]}]}'))
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("page_id"), text.alias("output"))


@query("SELECT c_custkey AS page_id, 0 AS idx, CAST(c_custkey % 90 AS DOUBLE) AS x, 30.0::DOUBLE AS y, CAST(c_custkey % 7 * 4 AS DOUBLE) AS width, 0.5::DOUBLE AS confidence, 'hall' AS class FROM customer")
def model_output(spark, d):
    return formats.predictions(_model(spark, d)).select("page_id", "idx", "x", "y", "width", "confidence", "class")


@query("SELECT c_custkey AS page_id, (c_custkey % 90 - c_custkey % 7 * 2) / 0.5 AS x1, 50.0::DOUBLE AS y1, (c_custkey % 90 + c_custkey % 7 * 2) / 0.5 AS x2, 70.0::DOUBLE AS y2, c_custkey % 7 * 4 / 0.5 * 20.0 AS area FROM customer WHERE c_custkey % 7 > 0")
def rescaled_halls(spark, d):
    return formats.rescaled_halls(formats.predictions(_model(spark, d)), F.lit(0.5)).select("page_id", "x1", "y1", "x2", "y2", "area")


@query("SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 1 THEN 640 WHEN c_custkey % 90 > 0 THEN CAST(ceil(c_custkey % 90 * 1.05::DOUBLE) AS INT) ELSE 2100 END AS w, CASE WHEN c_custkey % 2 = 1 THEN 480 WHEN c_custkey % 90 > 0 THEN 21 ELSE 1275 END AS h FROM customer")
def page_extents(spark, d):
    kind = "struct<image:struct<width:double,height:double>,predictions:array<struct<points:array<struct<x:double,y:double>>>>>"
    return formats.page_extent(_model(spark, d).select("page_id", F.from_json("output", kind).alias("o")).select("page_id", "o.*"))


@query("SELECT box_id, (x2 - x1) * (y2 - y1) AS area, [(x1 + x2) / 2, (y1 + y2) / 2] AS centroid, CASE WHEN box_id % 2 = 0 THEN source END AS name FROM box_pool", "box_pool")
def consumer_rows(spark, d):
    b = view(spark, d, "box_pool").withColumn("label", F.when(F.col("box_id") % 2 == 0, F.concat(F.lit("  "), "source", F.lit(" "))).otherwise(" "))
    return formats.booth_rows(b).select("box_id", "area", "centroid", "name")


@query(r"""SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '([^/.])\.[^./]*$', '\1'), '^.*/', ''), '[^\p{L}\p{N}\-_.]', '', 'g'), ''), 'input') AS stem FROM pages""")
def url_parts(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1).alias("host"), texts.safe_stem(F.col("url")).alias("stem"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'bucket' || page_id WHEN 1 THEN 'media' ELSE 'b' END AS bucket, CASE page_id % 3 WHEN 0 THEN 'a/b' || page_id || '.png' WHEN 1 THEN 'pre/x' || page_id ELSE 'k' || page_id END AS key, CASE page_id % 3 WHEN 2 THEN 'eu-west-1' END AS region FROM pages""")
def object_places(spark, d):
    k = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("s3://bucket"), k, F.lit("/a/b"), k, F.lit(".png"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://cdn.example.org/x"), k)).otherwise(F.concat(F.lit("https://b.s3.eu-west-1.amazonaws.com/k"), k))
    hosts = texts.host_map(F.lit('{"cdn.example.org":{"bucket":"media","key_prefix":"pre/"}}'))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", texts.object_place(url, hosts).alias("o")).select("page_id", "o.*")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/octet-stream' ELSE 'application/octet-stream' END AS type, page_id % 4 = 2 AS pdf FROM pages")
def content_types(spark, d):
    heads = F.array(*[F.lit(h) for h in (b"\x89PNG\r\n\x1a\n....", b"\xff\xd8\xff\xe0....", b"%PDF-1.7", b"plain")])
    content = F.get(heads, (F.col("page_id") % 4).cast("int"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", texts.content_type(content).alias("type"), texts.is_pdf(content).alias("pdf"))


# --- registry ------------------------------------------------------------------------------------------------------------------


def _events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", registry.content_hash(F.concat("event_type", (F.col("user_id") % 50).cast("string"))).alias("hash"))


@query("SELECT event_id, sha1(event_type || CAST(user_id % 50 AS VARCHAR)) AS hash FROM events")
def content_hashes(spark, d):
    return _events(spark, d)


SEEN = "h AS (SELECT event_id, sha1(event_type || CAST(user_id % 50 AS VARCHAR)) AS hash FROM events), s AS (SELECT DISTINCT hash FROM h WHERE event_id % 97 = 0), m AS (SELECT event_id, h.hash, CASE WHEN h.hash IN (SELECT hash FROM s) OR row_number() OVER (PARTITION BY h.hash ORDER BY event_id) > 1 THEN 'present' ELSE 'absent' END AS status FROM h)"


def _marked(spark, d):
    e = _events(spark, d)
    return registry.register(e, e.where("event_id % 97 = 0").select("hash"), "event_id")


@query(f"WITH {SEEN} SELECT * FROM m")
def seen_hashes(spark, d):
    return _marked(spark, d)


@query(f"WITH {SEEN} SELECT event_id, 'skip' AS mode, 'run' AS outcome FROM m WHERE status = 'absent' UNION ALL SELECT event_id, 'reject', CASE status WHEN 'present' THEN 'rejected' ELSE 'run' END FROM m UNION ALL SELECT event_id, 'always_run', 'run' FROM m")
def registry_modes(spark, d):
    m = _marked(spark, d)
    parts = [registry.admit(m, mode).select("event_id", F.lit(mode).alias("mode"), "outcome") for mode in ("skip", "reject", "always_run")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def page_plan(spark, d):
    from .pages import big_candidates, resolve_pages

    halls = view(spark, d, "halls")
    found = halls.select("page_id", (-10_000_000 - F.col("hall_idx")).alias("box_id"), "x1", "y1", "x2", (F.col("y1") + (F.col("x2") - F.col("x1"))).alias("y2"))
    big = big_candidates(found, F.lit(0.8), F.lit(1600.0 * 1200.0))
    return resolve_pages(view(spark, d, "box_pool"), view(spark, d, "text_items"), halls, F.lit(1200.0 * 900.0), big)


@query("SELECT count(*) AS n, count(*) FILTER (c_custkey % 7 > 0) AS sized, CAST(count(*) AS BIGINT) AS with_points FROM customer")
def prediction_summary(spark, d):
    p = formats.predictions(_model(spark, d))
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("width") > 0).alias("sized"), F.count_if(F.size("points") > 0).alias("with_points"))


# --- made-up pools -------------------------------------------------------------------------------------------------------------


@query()
def synthetic_pool(spark, d):
    return fixtures.box_pool(spark, 600, 0)


@query()
def synthetic_plan(spark, d):
    return raster.color_cells(fixtures.plan_pixels(spark, 6, 0), [fixtures.FILL], 30)


@query()
def line_cells(spark, d):
    from ..operators.detect import detect_cells

    return detect_cells(fixtures.plan_images(spark, 12, 2))
