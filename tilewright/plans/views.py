"""Derived tables: images, annotations, detections and frames made from the star schema, by text that Spark and DuckDB both run.

Row ids come from windows within an order or a supplier, never from one over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.operators.dataset import Dataset
from tilewright.session import table

SQL = {
    "v_images": "SELECT o_orderkey AS image_id, concat('img_', CAST(o_orderkey AS STRING), '.jpg') AS file_name, CAST(480 + (o_orderkey * 91) % 2593 AS INT) AS height, CAST(640 + (o_orderkey * 37) % 3457 AS INT) AS width, o_orderkey AS ord FROM {orders}",
    "v_categories": "SELECT * FROM (VALUES (0, 'A', 'returned'), (1, 'N', 'kept'), (2, 'R', 'returned')) AS t(category_id, name, supercategory)",
    "v_annotations": """SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ann_id,
        l_orderkey AS image_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS category_id,
        CAST((l_partkey * 7 + l_linenumber * 131) % (640 + (l_orderkey * 37) % 3457) AS DOUBLE) AS x, CAST((l_suppkey * 31 + l_linenumber * 53) % (480 + (l_orderkey * 91) % 2593) AS DOUBLE) AS y,
        CAST(1 + floor(l_quantity * 8) AS DOUBLE) AS w, CAST(1 + l_partkey % 400 AS DOUBLE) AS h FROM {lineitem}""",
    "v_dets": """SELECT l_suppkey AS scene_id, l_suppkey * 10000000 + row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS id,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS category_id,
        CAST((l_partkey * 7) % 900 AS DOUBLE) AS x1, CAST((l_orderkey * 31 + l_linenumber * 53) % 900 AS DOUBLE) AS y1,
        CAST((l_partkey * 7) % 900 + 5 + floor(l_quantity) AS DOUBLE) AS x2, CAST((l_orderkey * 31 + l_linenumber * 53) % 900 + 5 + l_partkey % 60 AS DOUBLE) AS y2,
        CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score FROM {lineitem}""",
    "v_frames": "SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_id, event_id AS image_id, ts, event_type AS label, value AS score FROM {events}",
}
SQL["v_truth"] = f"SELECT ann_id AS id, image_id, category_id, 0 AS iscrowd, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM ({SQL['v_annotations']}) t"
SQL["v_preds"] = f"""SELECT ann_id AS id, image_id, CASE WHEN ann_id % 13 = 0 THEN CAST((category_id + 1) % 3 AS INT) ELSE category_id END AS category_id, CAST((ann_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score,
    x + ann_id % 7 - 3 AS x1, y AS y1, x + ann_id % 7 - 3 + greatest(CAST(1 AS DOUBLE), w + ann_id % 11 - 5) AS x2, y + h AS y2 FROM ({SQL['v_annotations']}) t WHERE ann_id % 4 <> 0"""

_BASE = ("orders", "lineitem", "events")


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    text = SQL[name]
    return spark.sql(text, **{b: table(spark, d, b) for b in _BASE if "{" + b + "}" in text})


def dataset(spark: SparkSession, d: str) -> Dataset:
    return Dataset(view(spark, d, "v_images"), view(spark, d, "v_categories"), view(spark, d, "v_annotations"))


def ctes(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n].format(**{b: b for b in _BASE})})" for n in names)
