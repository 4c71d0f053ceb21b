"""Deterministic drawing-like views over the driver's tables; Spark and DuckDB run the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS = {
    "v_boxes": """
SELECT p_partkey AS id, p_partkey % 8 AS page,
  CAST((p_partkey*37)%1000 AS DOUBLE) AS x0, CAST((p_partkey*91)%800 AS DOUBLE) AS y0,
  CAST((p_partkey*37)%1000 + p_size*4 AS DOUBLE) AS x1,
  CAST((p_partkey*91)%800 + (p_size%7+1)*12 AS DOUBLE) AS y1,
  p_name AS text, p_brand AS grp
FROM part""",
    "v_segments": """
SELECT o_orderkey AS id, o_orderkey % 16 AS page,
  CAST((o_orderkey*29)%500 AS DOUBLE) AS x0, CAST((o_orderkey*53)%400 AS DOUBLE) AS y0,
  CAST((o_orderkey*29)%500 + o_custkey%41 - 20 AS DOUBLE) AS x1,
  CAST((o_orderkey*53)%400 + (o_orderkey*7)%41 - 20 AS DOUBLE) AS y1
FROM orders""",
    # a segment and a second line derived from it
    "v_twins": """
SELECT id, page, x0, y0, x1, y1, x0 + (id % 7 - 3) * 6 AS bx0, y0 + (id % 5 - 2) * 8 AS by0, x1 + (id % 11 - 5) * 4 AS bx1, y1 - (id % 3) * 9 AS by1
FROM (SELECT o_orderkey AS id, o_orderkey % 16 AS page,
  CAST((o_orderkey*29)%500 AS DOUBLE) AS x0, CAST((o_orderkey*53)%400 AS DOUBLE) AS y0,
  CAST((o_orderkey*29)%500 + o_custkey%41 - 20 AS DOUBLE) AS x1,
  CAST((o_orderkey*53)%400 + (o_orderkey*7)%41 - 20 AS DOUBLE) AS y1
FROM orders) s""",
    "v_labels": """
SELECT p_partkey AS id, p_partkey % 8 AS page,
  CASE p_partkey % 12 WHEN 0 THEN '3/4' WHEN 1 THEN CAST(p_size AS VARCHAR(10)) WHEN 2 THEN '1.5' WHEN 3 THEN '.5'
    WHEN 4 THEN '"' WHEN 5 THEN 'feet' WHEN 6 THEN 'Inches' WHEN 7 THEN '3"' WHEN 8 THEN '12 feet'
    WHEN 9 THEN 'A' || CAST(10 + p_size AS VARCHAR(10)) WHEN 10 THEN 'D' || CAST(p_size AS VARCHAR(10)) ELSE '/' END AS text
FROM part""",
    "v_schedules": "SELECT user_id AS doc, event_id AS sched_id, ts AS page_ts FROM events WHERE event_type = 'signup'",
    "v_marks": "SELECT user_id AS doc, event_id AS mark_id, ts AS page_ts, value FROM events WHERE event_type = 'view'",
    "v_progress": """
SELECT user_id AS pdf_id, event_id AS seq, ts,
  CASE WHEN event_type IN ('view','click') THEN event_id END AS curr_step,
  CASE WHEN event_type = 'error' THEN props END AS msg,
  CASE WHEN event_type = 'purchase' THEN TRUE END AS success
FROM events""",
    "v_elems": """
SELECT 'r' || CAST(p_partkey AS VARCHAR(20)) AS id, p_partkey % 8 AS page_number, 'schedule_row' AS elem_type, p_brand AS mnfct FROM part
UNION ALL
SELECT 'c' || CAST(p_partkey AS VARCHAR(20)), p_partkey % 8, 'schedule_cell', p_brand FROM part
UNION ALL
SELECT 'o' || CAST(o_orderkey AS VARCHAR(20)), o_orderkey % 8, 'elem', NULL FROM orders""",
    "v_links": """
SELECT 'c' || CAST(p_partkey AS VARCHAR(20)) AS from_id, 'r' || CAST(p_partkey AS VARCHAR(20)) AS to_id, 'cell_of_row' AS link_type FROM part
UNION ALL
SELECT DISTINCT 'o' || CAST(o.o_orderkey AS VARCHAR(20)), 'r' || CAST(l.l_partkey AS VARCHAR(20)), 'instance_of'
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey""",
    "v_sizes": "SELECT p_partkey AS id, CAST(p_size*4 AS DOUBLE) AS w, CAST((p_size%7+1)*12 AS DOUBLE) AS h FROM part",
    # rules: rows of schedules with ids, some of them patterns
    "v_rules": """
SELECT s_suppkey AS rule_id, s_suppkey % 8 AS page,
  CASE s_suppkey % 4 WHEN 0 THEN 'D' || CAST(s_suppkey % 50 + 1 AS VARCHAR(10)) WHEN 1 THEN 'A##' WHEN 2 THEN '3/4' ELSE '' END AS row_id
FROM supplier""",
    # glyphs of part names on crowded lines, some of them turned; digits above and below bars; labels inside rings
    "v_glyphs": """
SELECT p_partkey * 32 + k AS id, page, text, left_right, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(size AS DOUBLE) AS fontsize FROM (
  SELECT p_partkey, k, page, substr(p_name, k + 1, 1) AS text, NOT turned AS left_right, h AS size,
    CASE WHEN turned THEN bx ELSE bx + 6 * k END AS x0, CASE WHEN turned THEN by0 + 6 * k ELSE by0 END AS y0,
    CASE WHEN turned THEN bx + h ELSE bx + 6 * k + 6 END AS x1, CASE WHEN turned THEN by0 + 6 * k + 6 ELSE by0 + h END AS y1
  FROM (SELECT p_partkey, p_name, CAST(floor(p_partkey / 50) AS BIGINT) AS page, p_partkey % 9 = 0 AS turned, (p_partkey * 37 % 30) * 12 AS bx, (p_partkey * 91 % 20) * 24 + p_size % 3 AS by0, CASE WHEN p_size % 5 = 0 THEN 14 ELSE 10 END AS h FROM part) p
    JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) AS n(k) ON k < length(p_name)
  UNION ALL
  SELECT p_partkey, k, page, CASE k WHEN 24 THEN CAST(p_size % 10 AS VARCHAR(2)) WHEN 25 THEN CAST((p_size + 1) % 10 AS VARCHAR(2)) ELSE 'x' END, TRUE, 10,
    CASE k WHEN 26 THEN bx + 10 ELSE bx END, CASE k WHEN 24 THEN 1020 WHEN 25 THEN 1000 ELSE 1010 END, CASE k WHEN 26 THEN bx + 16 ELSE bx + 10 END, CASE k WHEN 24 THEN 1030 WHEN 25 THEN 1010 ELSE 1020 END
  FROM (SELECT p_partkey, p_size, CAST(floor(p_partkey / 50) AS BIGINT) AS page, CAST(floor((p_partkey % 50) / 3) AS BIGINT) * 14 + p_size % 5 AS bx FROM part WHERE p_partkey % 3 = 0) p
    JOIN (VALUES (24), (25), (26)) AS n(k) ON k < 26 OR p_partkey % 6 = 0
  UNION ALL
  SELECT 1000000000 + s_suppkey, k, CAST(floor(s_suppkey * 2 / 5) AS BIGINT), CASE WHEN k = 1 THEN CAST(s_suppkey % 10 AS VARCHAR(2)) WHEN s_suppkey % 2 = 0 THEN 'D' ELSE 'W' END, TRUE, 10,
    1000 + (s_suppkey % 5) * 200 + 6 * k - 6, 95, 1000 + (s_suppkey % 5) * 200 + 6 * k, 105
  FROM supplier JOIN (VALUES (0), (1)) AS n(k) ON s_suppkey % 7 > 0
) g""",
    "v_bars": """
SELECT p_partkey * 32 + k AS id, CAST(floor(p_partkey / 50) AS BIGINT) AS page, CAST(bx AS DOUBLE) AS x0, CAST(1015 - k % 2 AS DOUBLE) AS y0, CAST(bx + 10 AS DOUBLE) AS x1, CAST(1015 - k % 2 AS DOUBLE) AS y1, CAST(10 AS DOUBLE) AS length
FROM (SELECT p_partkey, CAST(floor((p_partkey % 50) / 3) AS BIGINT) * 14 + p_size % 5 AS bx FROM part WHERE p_partkey % 3 = 0) p
  JOIN (VALUES (28), (29)) AS n(k) ON k = 28 OR p_partkey % 5 = 0""",
    # rings of lines: regular ones, stars, open ones, some with a chord or a tail
    "v_rings": """
SELECT s_suppkey * 64 + k AS id, s_suppkey AS ring, page, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM (
  SELECT s_suppkey, k, page,
    cx + ra * cos(2 * pi() * CASE WHEN k < 24 THEN k ELSE 0 END / n) AS x0, 100.5 + ra * sin(2 * pi() * CASE WHEN k < 24 THEN k ELSE 0 END / n) AS y0,
    CASE WHEN k = 25 THEN cx + r + 5 ELSE cx + rb * cos(2 * pi() * (j % n) / n) END AS x1, CASE WHEN k = 25 THEN 107.5 ELSE 100.5 + rb * sin(2 * pi() * (j % n) / n) END AS y1
  FROM (SELECT *, CASE WHEN star AND k < 24 AND k % 2 = 1 THEN r / 2 ELSE r END AS ra, CASE WHEN star AND j % n % 2 = 1 THEN r / 2 ELSE r END AS rb FROM (
    SELECT *, CASE WHEN k = 24 THEN CAST(floor(n / 2) AS BIGINT) ELSE k + 1 END AS j FROM (
      SELECT s_suppkey, CAST(floor(s_suppkey * 2 / 5) AS BIGINT) AS page, CAST(1000.5 + (s_suppkey % 5) * 200 AS DOUBLE) AS cx, CAST(20 + s_nationkey AS DOUBLE) AS r, s_suppkey % 6 = 4 AS star,
        CASE s_suppkey % 6 WHEN 0 THEN 24 WHEN 1 THEN 12 WHEN 3 THEN 20 WHEN 5 THEN 18 ELSE 6 END AS n FROM supplier) a
      JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19), (20), (21), (22), (23), (24), (25)) AS m(k)
        ON (k < n AND NOT (s_suppkey % 6 = 5 AND k = 17)) OR (k = 24 AND s_suppkey % 4 = 1) OR (k = 25 AND s_suppkey % 5 = 0)) c) d) e""",
    # rooms: four lines, sometimes one across, and texts with measures
    "v_room_lines": """
SELECT p_partkey * 16 + k AS id, page, CAST(bx + x0 AS DOUBLE) AS x0, CAST(by0 + y0 AS DOUBLE) AS y0, CAST(bx + x1 AS DOUBLE) AS x1, CAST(by0 + y1 AS DOUBLE) AS y1
FROM (SELECT p_partkey, p_size, CAST(floor(p_partkey / 50) AS BIGINT) AS page, (p_partkey % 10) * 100 AS bx, CAST(floor(p_partkey % 50 / 10) AS BIGINT) * 100 AS by0 FROM part) p
  JOIN (VALUES (0, 5, 5, 5, 75), (1, 85, 5, 85, 75), (2, 5, 5, 85, 5), (3, 5, 75, 85, 75), (4, 40, 5, 40, 75)) AS l(k, x0, y0, x1, y1)
    ON CASE k WHEN 4 THEN p_partkey % 7 = 0 WHEN 3 THEN p_partkey % 11 > 0 ELSE p_size > 0 END""",
    "v_room_texts": """
SELECT p_partkey * 16 + 8 + k AS id, page, CAST(bx + x0 AS DOUBLE) AS x0, CAST(by0 + 30 AS DOUBLE) AS y0, CAST(bx + x1 AS DOUBLE) AS x1, CAST(by0 + 40 AS DOUBLE) AS y1,
  CASE k WHEN 1 THEN ' x ' WHEN 0 THEN CAST(8 + p_size % 9 AS VARCHAR(4)) || CASE p_partkey % 4 WHEN 0 THEN chr(39) WHEN 1 THEN chr(39) || ' 6"' WHEN 2 THEN chr(39) || ' 6 1/2"' ELSE ' feet' END
    ELSE CASE p_partkey % 5 WHEN 0 THEN CAST(90 + p_size AS VARCHAR(4)) || ' inches' WHEN 1 THEN '9.5' WHEN 2 THEN p_name ELSE CAST(7 + p_size % 6 AS VARCHAR(4)) || chr(39) END END AS text
FROM (SELECT p_partkey, p_size, p_name, CAST(floor(p_partkey / 50) AS BIGINT) AS page, (p_partkey % 10) * 100 AS bx, CAST(floor(p_partkey % 50 / 10) AS BIGINT) * 100 AS by0 FROM part) p
  CROSS JOIN (VALUES (0, 10, 30), (1, 32, 36), (2, 44, 70)) AS t(k, x0, x1)""",
    # rows, cells and areas of rooms with their data as JSON
    "v_facts": """
SELECT 's' || CAST(s_suppkey AS VARCHAR(20)) AS id, 'schedule_row' AS elem_type, '{"name_of_room": "Room ' || CAST(s_suppkey % 37 AS VARCHAR(20)) || '"}' AS data FROM supplier
UNION ALL
SELECT 'c' || CAST(p_partkey AS VARCHAR(20)), 'schedule_cell', CASE p_partkey % 4 WHEN 0 THEN '{"ceiling": "C' || CAST(p_size % 5 AS VARCHAR(4)) || '"}' WHEN 1 THEN '{"floor": "F' || CAST(p_size % 3 AS VARCHAR(4)) || '", "ceiling": null}' WHEN 2 THEN '{"ceiling": "C9", "floor": 2}' ELSE '{"name": "' || p_name || '"}' END FROM part
UNION ALL
SELECT 'q' || CAST(c_custkey AS VARCHAR(20)), 'square_feet', '{"name_of_room": "Room ' || CAST(c_custkey % 53 AS VARCHAR(20)) || '", "square_feet": ' || CAST(100 + c_custkey % 400 AS VARCHAR(20)) || '}' FROM customer""",
    "v_fact_links": "SELECT 'c' || CAST(p_partkey AS VARCHAR(20)) AS from_id, 's' || CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS VARCHAR(20)) AS to_id, 'cell_of_row' AS link_type FROM part",
    # title blocks on three pages of each document
    "v_titles": """
SELECT s_suppkey AS doc, page, k AS id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 - (s_suppkey * k) % 7 AS DOUBLE) AS y0, CAST(x0 + 150 AS DOUBLE) AS x1, CAST(y0 + 10 - (s_suppkey * k) % 7 AS DOUBLE) AS y1, CAST(3000 AS DOUBLE) AS page_width, CAST(2000 AS DOUBLE) AS page_height,
  CASE k WHEN 1 THEN 'Floor Plan ' || CAST(page AS VARCHAR(4)) WHEN 2 THEN s_name WHEN 3 THEN 'A-' || CAST(page AS VARCHAR(4)) WHEN 7 THEN s_name || ' House' WHEN 9 THEN CAST(s_nationkey AS VARCHAR(4)) || ' Main St' ELSE word END AS text,
  CASE WHEN k = 12 THEN 5 END AS parent
FROM supplier CROSS JOIN (VALUES (1), (2), (3)) AS p(page)
  JOIN (VALUES (0, 2800, 250, 'DRAWING TITLE'), (1, 2790, 220, ''), (2, 2790, 200, ''), (3, 2800, 100, ''), (4, 2800, 140, 'Drawing Number'), (5, 2780, 700, 'Project Name:'), (6, 100, 700, 'project name'), (7, 2780, 650, ''), (8, 2790, 630, 'Owner: Smith'), (9, 2790, 610, ''),
    (10, 2800, 590, 'second line'), (11, 2700, 570, 'beside'), (12, 2790, 560, 'inner'), (13, 2790, 200, 'tied')) AS t(k, x0, y0, word)
    ON CASE k WHEN 0 THEN s_suppkey % 4 > 0 WHEN 2 THEN s_suppkey % 3 > 0 WHEN 5 THEN (s_suppkey + page) % 3 > 0 WHEN 8 THEN s_suppkey % 5 > 0 WHEN 13 THEN (s_suppkey + page) % 6 = 0 ELSE page > 0 END""",
    # one text for each part, crowded on short lines
    "v_scraps": """
SELECT p_partkey AS id, CAST(floor(p_partkey / 200) AS BIGINT) AS page, substr(p_name, 1, 1 + p_size % 3) AS text, p_partkey % 7 <> 0 AS left_right,
  CAST((p_partkey * 37) % 61 AS DOUBLE) AS x0, CAST(((p_partkey * 91) % 40) * 20 + p_size % 4 AS DOUBLE) AS y0,
  CAST((p_partkey * 37) % 61 + 4 + p_size % 9 AS DOUBLE) AS x1, CAST(((p_partkey * 91) % 40) * 20 + p_size % 4 + 8 + (p_size % 5) * 2 AS DOUBLE) AS y1
FROM part""",
}


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df in as many partitions as there are cores, if it comes from fewer files: one small file is one task otherwise.

    Larger inputs are left as they are, so no shuffle is added where it would cost.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *columns) if len(df.inputFiles()) < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only the tables that it names are opened, with their columns pruned at the scan."""
    text = VIEWS[name]
    for table in TABLES:
        if table in text:
            base(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(text)


def glyphs(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, text, box): every character of every document, six units wide, on one line."""
    from pyspark.sql import functions as F

    rows = documents.filter(F.length("text") > 0).select("doc_id", F.posexplode(F.split("text", "")).alias("p", "text")).filter(F.col("text") != "")
    pos = (F.col("p") + 1).cast("bigint")
    x = pos.cast("double") * 6
    return rows.select("doc_id", pos.alias("pos"), "text", x.alias("x0"), F.lit(0.0).alias("y0"), (x + 6).alias("x1"), F.lit(10.0).alias("y1"))


def with_views(sql: str, *names: str) -> str:
    """SQL preceded by the views that it uses."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql.lstrip()
