"""Screens, boxes and captions derived from the test tables.

One order is one screen, its lines are the boxes; the part's name is the caption.  The SQL
runs in Spark and in the checking engine alike, so both start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOXES = """
SELECT l_orderkey AS state_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS elem_id,
  CAST((l_partkey*7919 + l_linenumber*104729) % 200 AS INT) AS x1,
  CAST((l_suppkey*6271 + l_partkey*97 + l_linenumber*1299709) % 120 AS INT) AS y1,
  CAST((l_partkey*7919 + l_linenumber*104729) % 200 + 20 + (CAST(l_quantity AS INT)*13) % 180 AS INT) AS x2,
  CAST((l_suppkey*6271 + l_partkey*97 + l_linenumber*1299709) % 120 + 10 + (l_partkey*31 + l_linenumber) % 60 AS INT) AS y2,
  CASE l_returnflag WHEN 'A' THEN 'button' WHEN 'R' THEN 'input_field' ELSE 'text' END AS visual_type,
  l_discount*10 AS confidence, l_partkey AS part_id
FROM lineitem"""

#: Labels: the same boxes moved by a few pixels, a seventh of them with another type.
TRUTH = """
SELECT state_id, elem_id, x1 + elem_id % 7 AS x1, y1 + elem_id % 5 AS y1, x2 + elem_id % 7 AS x2, y2 + elem_id % 3 AS y2,
  CASE WHEN (state_id + elem_id) % 7 = 0 THEN 'button' ELSE visual_type END AS visual_type, confidence, part_id
FROM boxes WHERE (state_id + elem_id) % 11 <> 0"""

#: Boxes with a caption, a hint and a role.
CAPTIONS = """
SELECT b.state_id, b.elem_id, b.x1, b.y1, b.x2, b.y2, b.visual_type, b.confidence,
  CASE WHEN b.elem_id % 4 = 0 THEN NULL ELSE p_name END AS text, CAST(NULL AS STRING) AS label, p_brand AS hint, b.visual_type AS role
FROM boxes b JOIN part ON b.part_id = p_partkey"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOXES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRUTH.replace("FROM boxes", "FROM {boxes}"), boxes=boxes(spark, sf_dir))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(CAPTIONS.replace("FROM boxes b JOIN part", "FROM {boxes} b JOIN {part}"), boxes=boxes(spark, sf_dir), part=part)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
