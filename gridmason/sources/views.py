"""Relations of boxes, text spans, regions and pixels over the driver's tables. The same SQL runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOX_POOL = """
SELECT page_id * 1000 + row_number() OVER (PARTITION BY page_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS box_id,
       page_id, CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, x + 40 + l_quantity * 2 AS x2, y + 30 + l_quantity + l_linenumber * 6 AS y2,
       CAST(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.75 ELSE 0.45 END AS DOUBLE) AS score,
       CASE l_returnflag WHEN 'A' THEN 'opencv_strict' WHEN 'N' THEN 'color' ELSE 'bordered' END AS source
FROM (SELECT *, CAST(floor(l_orderkey / 100) AS BIGINT) AS page_id, (l_partkey * 37) % 1200 AS x, (l_suppkey * 53 + l_orderkey * 29) % 900 AS y FROM {lineitem}) t
"""

TEXT_ITEMS = """
SELECT p_partkey AS span_id, CAST(floor(p_partkey * 3 / 40) AS BIGINT) AS page_id,
       CASE p_partkey % 5 WHEN 0 THEN concat(chr(CAST(65 + p_partkey % 26 AS INT)), CAST(p_partkey % 97 AS VARCHAR(9)))
            WHEN 1 THEN p_name WHEN 2 THEN 'TOILET' WHEN 3 THEN '9 sqm' ELSE 'ACME TRADERS LTD' END AS text,
       CAST((p_partkey * 41) % 1300 AS DOUBLE) AS x0, CAST((p_partkey * 67) % 1000 AS DOUBLE) AS y0,
       CAST((p_partkey * 41) % 1300 + 20 + p_size AS DOUBLE) AS x1, CAST((p_partkey * 67) % 1000 + 12 AS DOUBLE) AS y1
FROM {part}
"""

HALLS = """
SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS page_id, c_custkey % 10 AS hall_idx,
       CAST((c_custkey % 2) * 550 AS DOUBLE) AS x1, CAST(floor((c_custkey % 10) / 2) * 400 AS DOUBLE) AS y1,
       CAST((c_custkey % 2) * 550 + 650 AS DOUBLE) AS x2, CAST(floor((c_custkey % 10) / 2) * 400 + 500 AS DOUBLE) AS y2
FROM {customer} WHERE c_custkey % 10 < 4
"""

PIXELS = """
SELECT DISTINCT CAST(floor(l_orderkey / 100) AS BIGINT) AS page_id, (l_suppkey * 7 + l_linenumber * 3) % 40 AS y, l_partkey % 60 AS x
FROM {lineitem}
"""

#: Coloured pixels: blue, green and red from the position.
COLORS = """
SELECT page_id, y, x, CAST((y * 37 + x * 11 + page_id * 5) % 256 AS INT) AS b, CAST((y * 13 + x * 53) % 256 AS INT) AS g, CAST((x * x + y * 3) % 256 AS INT) AS r
FROM ({pixels}) p
"""

#: Line segments with two ends, a cluster and a confidence.
SEGMENTS = """
SELECT c_custkey AS seg, CAST(floor(c_custkey / 30) AS BIGINT) AS page_id, c_custkey % 3 AS cluster, CAST(c_custkey % 10 AS DOUBLE) / 10 AS confidence,
       CAST((c_custkey * 37) % 400 AS DOUBLE) AS ax, CAST((c_custkey * 61) % 300 AS DOUBLE) AS ay,
       CAST((c_custkey * 37) % 400 + (c_custkey * 13) % 90 - 45 AS DOUBLE) AS bx, CAST((c_custkey * 61) % 300 + (c_custkey * 29) % 70 - 35 AS DOUBLE) AS by_
FROM {customer}
"""

#: Paths of points in order.
PATHS = """
SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
       CAST((event_id * 7) % 200 AS DOUBLE) AS x, CAST((event_id * 13) % 150 AS DOUBLE) AS y
FROM {events}
"""

#: Pixels of smaller pages, few of which touch.
SPECKS = """
SELECT DISTINCT CAST(floor(l_orderkey / 30) AS BIGINT) AS page_id, (l_suppkey * 7 + l_linenumber * 3) % 40 AS y, l_partkey % 60 AS x
FROM {lineitem}
"""

#: Coloured pixels of rectangles of 3 to 7 pixels a side on pages of 60 by 40; where rectangles overlap, the last one's.
DRAWN = """
SELECT page_id, y, x, CAST(CASE k % 3 WHEN 0 THEN 20 WHEN 1 THEN 220 ELSE 90 END AS INT) AS b, CAST(CASE k % 3 WHEN 0 THEN 40 WHEN 1 THEN 60 ELSE 90 END AS INT) AS g,
       CAST(CASE k % 3 WHEN 0 THEN 180 WHEN 1 THEN 50 ELSE 90 END AS INT) AS r
FROM (SELECT page_id, t.y + a.n AS y, t.x + b.n AS x, max(k) AS k
      FROM (SELECT c_custkey AS k, CAST(floor(c_custkey / 30) AS BIGINT) AS page_id, (c_custkey * 61) % 34 AS y, (c_custkey * 37) % 54 AS x, 3 + c_custkey % 4 AS h, 3 + c_custkey % 5 AS w FROM {customer}) t
      JOIN (SELECT DISTINCT c_custkey - 1 AS n FROM {customer} WHERE c_custkey <= 7) a ON a.n < t.h JOIN (SELECT DISTINCT c_custkey - 1 AS n FROM {customer} WHERE c_custkey <= 7) b ON b.n < t.w
      GROUP BY page_id, t.y + a.n, t.x + b.n) p
"""

SQL = {"box_pool": BOX_POOL, "text_items": TEXT_ITEMS, "halls": HALLS, "pixels": PIXELS, "colors": COLORS.replace("{pixels}", PIXELS), "segments": SEGMENTS, "paths": PATHS, "specks": SPECKS, "drawn": DRAWN}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of SQL by name. Each reads one table."""
    sql = SQL[name]
    (used,) = {t for t in ("lineitem", "part", "customer", "events") if "{" + t + "}" in sql}
    return spark.sql(sql, **{used: spark.read.parquet(f"{sf_dir}/{used}.parquet")})


def ctes(*names: str) -> str:
    """The views as common table expressions of a DuckDB query."""
    return ", ".join(f"{n} AS ({SQL[n].format(lineitem='lineitem', part='part', customer='customer', events='events')})" for n in names)
