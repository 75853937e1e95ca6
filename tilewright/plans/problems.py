"""Queries p1 and p6: nested records and dangling references, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.nested import flatten_records
from tilewright.operators.references import orphan_references
from tilewright.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    flat = flatten_records(table(spark, d, "terrain1"))
    shapes = flat["shape"].select("record_id", F.col("row_key").alias("shape_path"), F.lit(-1).alias("point_no"))
    return shapes.unionByName(flat["point"].select("record_id", F.col("parent_key").alias("shape_path"), F.col("pos").alias("point_no")))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return flatten_records(table(spark, d, "terrain1"))["record"].select("record_id", "version", "image_path", "image_height", "image_width")


def p1_shapes(spark: SparkSession, d: str) -> DataFrame:
    return flatten_records(table(spark, d, "terrain1"))["shape"].select("record_id", F.col("row_key").alias("shape_path"), F.col("parent_key").alias("parent_path"), "label", "shape_type", "group_id", "depth")


def p1_points(spark: SparkSession, d: str) -> DataFrame:
    return flatten_records(table(spark, d, "terrain1"))["point"].select("record_id", F.col("parent_key").alias("shape_path"), F.col("pos").alias("point_no"), "x", "y")


def p1_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return flatten_records(table(spark, d, "terrain1"))["unreadable"]


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Every reference of both tables, one row each: the table and column it stands in are part of what is reported."""
    sides = []
    for name, key in (("coco_result", "det_id"), ("coco_annotations", "id")):
        t = table(spark, d, name).select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), "image_id", F.col("category_id").cast("bigint").alias("category_id"), "created_at")
        sides.append(t)
    return sides[0].unionByName(sides[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    refs = _references(spark, d)
    images = table(spark, d, "terrain_all_coco").select(F.col("id").alias("tid"), "loaded_at", "deleted_at")
    cats = table(spark, d, "coco_categories").select(F.col("id").cast("bigint").alias("tid"), "loaded_at", "deleted_at")
    out = []
    for ref, targets in (("image_id", images), ("category_id", cats)):
        o = orphan_references(refs.select("table_name", "row_key", "created_at", ref), targets, {ref: "tid"}, "created_at")
        out.append(o.select("table_name", "row_key", F.lit(ref).alias("ref_name"), F.col("orphan_kind").alias("kind"), F.date_format("created_at", "yyyy-MM").alias("period")))
    return out[0].unionByName(out[1]).distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("table_name", "ref_name", "kind", "period").agg(F.count("*").alias("n"))


def _composite(match: str) -> Callable[[SparkSession, str], DataFrame]:
    """Detections by their (image_id, category_id), either of which may be null, against the pairs that annotations have."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        own = F.col("category_id").cast("bigint").alias("category_id")
        refs = table(spark, d, "coco_result").select("det_id", "image_id", own, "created_at").distinct()
        targets = table(spark, d, "coco_annotations").select("image_id", own, "loaded_at", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
        o = orphan_references(refs, targets, {"image_id": "image_id", "category_id": "category_id"}, "created_at", match=match)
        return o.select("det_id", F.col("orphan_kind").alias("kind"))

    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_records": p1_records, "p1_shapes": p1_shapes, "p1_points": p1_points, "p1_unreadable": p1_unreadable, "p6_found": p6_found, "p6_report": p6_report, "p6_composite_partial": _composite("partial"), "p6_composite_full": _composite("full")}


_ORPHANS = """
WITH refs AS (
  SELECT DISTINCT 'coco_result' AS table_name, det_id AS row_key, ref_name, key, created_at FROM (SELECT det_id, created_at, image_id, category_id::BIGINT AS category_id FROM coco_result) UNPIVOT (key FOR ref_name IN (image_id, category_id))
  UNION SELECT DISTINCT 'coco_annotations', id, ref_name, key, created_at FROM (SELECT id, created_at, image_id, category_id::BIGINT AS category_id FROM coco_annotations) UNPIVOT (key FOR ref_name IN (image_id, category_id))),
targets AS (SELECT 'image_id' AS ref_name, id AS key, loaded_at, deleted_at FROM terrain_all_coco UNION ALL SELECT 'category_id', id::BIGINT, loaded_at, deleted_at FROM coco_categories),
judged AS (
  SELECT r.table_name, r.row_key, r.ref_name, r.created_at, count(t.key) AS n, count(t.key) FILTER (t.loaded_at <= r.created_at AND (t.deleted_at IS NULL OR t.deleted_at > r.created_at)) AS there, count(t.key) FILTER (t.loaded_at > r.created_at) AS later
  FROM refs r LEFT JOIN targets t ON t.ref_name = r.ref_name AND t.key = r.key GROUP BY ALL),
orphans AS (SELECT table_name, row_key, ref_name, CASE WHEN n = 0 THEN 'missing' WHEN later = n THEN 'late' ELSE 'deleted' END AS kind, strftime(created_at, '%Y-%m') AS period FROM judged WHERE there = 0)
"""


_UNWRAPPED = r"""
WITH RECURSIVE texts AS (
  SELECT record_id, delivery_id, regexp_replace(raw, '^[\s\x{FEFF}]+', '') AS t FROM terrain1 WHERE record_id IS NOT NULL
  UNION ALL
  SELECT record_id, delivery_id, CASE json_type(t) WHEN 'VARCHAR' THEN regexp_replace(t ->> '$', '^[\s\x{FEFF}]+', '') ELSE (t -> '$.payload')::VARCHAR END
  FROM (SELECT * FROM texts WHERE json_valid(t)) q WHERE json_type(t) = 'VARCHAR' OR (json_type(t) = 'OBJECT' AND NOT json_exists(t, '$.shapes') AND json_exists(t, '$.payload'))),
found AS (SELECT record_id, delivery_id, t FROM (SELECT * FROM texts WHERE json_valid(t)) q WHERE json_type(t) = 'OBJECT' AND json_exists(t, '$.shapes')),
recs AS (SELECT record_id, arg_min(t, delivery_id)::JSON AS t FROM found GROUP BY record_id),
shapes AS (
  SELECT record_id, (t -> '$.shapes') AS list, unnest(range(0, json_array_length(t -> '$.shapes')::BIGINT)) AS i, '' AS parent_path, 0 AS depth FROM recs WHERE json_type(t -> '$.shapes') = 'ARRAY'
  UNION ALL
  SELECT record_id, kids, unnest(range(0, json_array_length(kids)::BIGINT)), path, depth + 1 FROM (
    SELECT record_id, depth, (list -> i::INT -> '$.children') AS kids, CASE parent_path WHEN '' THEN i::VARCHAR ELSE parent_path || '.' || i END AS path FROM shapes WHERE json_type(list -> i::INT) = 'OBJECT') q WHERE json_type(kids) = 'ARRAY'),
flat AS (SELECT record_id, CASE parent_path WHEN '' THEN i::VARCHAR ELSE parent_path || '.' || i END AS shape_path, parent_path, depth, list -> i::INT AS s FROM shapes WHERE json_type(list -> i::INT) = 'OBJECT'),
entries AS (SELECT record_id, shape_path, unnest(range(0, json_array_length(s -> '$.points')::BIGINT)) AS point_no, s -> '$.points' AS ps FROM flat WHERE json_type(s -> '$.points') = 'ARRAY'),
pairs AS (SELECT record_id, shape_path, point_no, CASE json_type(p) WHEN 'OBJECT' THEN p -> '$.x' WHEN 'ARRAY' THEN p -> 0 END AS px, CASE json_type(p) WHEN 'OBJECT' THEN p -> '$.y' WHEN 'ARRAY' THEN p -> 1 END AS py FROM (SELECT *, ps -> point_no::INT AS p FROM entries) q),
points AS (SELECT record_id, shape_path, point_no::INT AS point_no, CASE WHEN json_type(px) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') THEN TRY_CAST(px ->> '$' AS DOUBLE) END AS x, CASE WHEN json_type(py) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') THEN TRY_CAST(py ->> '$' AS DOUBLE) END AS y FROM pairs)
"""
_LABEL = "CASE json_type(s -> '$.label') WHEN 'ARRAY' THEN s -> '$.label' ->> 0 WHEN 'OBJECT' THEN s -> '$.label' ->> '$.name' WHEN 'NULL' THEN NULL ELSE s ->> '$.label' END"


_PAIRS = """
WITH refs AS (SELECT DISTINCT det_id, image_id, category_id::BIGINT AS category_id, created_at FROM coco_result),
pairs AS (SELECT image_id, category_id::BIGINT AS category_id, min(loaded_at) AS first, max(loaded_at) AS last FROM coco_annotations WHERE image_id IS NOT NULL AND category_id IS NOT NULL GROUP BY ALL),
images AS (SELECT image_id, min(loaded_at) AS first FROM coco_annotations WHERE image_id IS NOT NULL GROUP BY ALL),
categories AS (SELECT category_id::BIGINT AS category_id, min(loaded_at) AS first FROM coco_annotations WHERE category_id IS NOT NULL GROUP BY ALL),
whole AS (SELECT det_id, created_at, first FROM refs LEFT JOIN pairs USING (image_id, category_id) WHERE image_id IS NOT NULL AND category_id IS NOT NULL),
one AS (SELECT det_id, created_at, first FROM refs LEFT JOIN images USING (image_id) WHERE image_id IS NOT NULL AND refs.category_id IS NULL UNION ALL SELECT det_id, created_at, first FROM refs LEFT JOIN categories USING (category_id) WHERE refs.image_id IS NULL AND category_id IS NOT NULL)
"""
_KIND = "SELECT DISTINCT det_id, CASE WHEN first IS NULL THEN 'missing' ELSE 'late' END AS kind FROM {0} WHERE first IS NULL OR first > created_at"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _UNWRAPPED + "SELECT record_id, shape_path, -1 AS point_no FROM flat UNION ALL SELECT record_id, shape_path, point_no FROM points WHERE x IS NOT NULL AND y IS NOT NULL",
        "p1_records": _UNWRAPPED + "SELECT record_id, t ->> '$.version' AS version, t ->> '$.imagePath' AS image_path, TRY_CAST(t ->> '$.imageHeight' AS INT) AS image_height, TRY_CAST(t ->> '$.imageWidth' AS INT) AS image_width FROM recs",
        "p1_shapes": _UNWRAPPED + f"SELECT record_id, shape_path, parent_path, {_LABEL} AS label, s ->> '$.shape_type' AS shape_type, TRY_CAST(s ->> '$.group_id' AS BIGINT) AS group_id, depth FROM flat",
        "p1_points": _UNWRAPPED + "SELECT record_id, shape_path, point_no, x, y FROM points WHERE x IS NOT NULL AND y IS NOT NULL",
        "p1_unreadable": _UNWRAPPED + "SELECT record_id, delivery_id, CASE WHEN raw IS NULL THEN 'null' WHEN trim(raw) = '' THEN 'empty' ELSE 'not readable' END AS reason FROM terrain1 t WHERE delivery_id NOT IN (SELECT delivery_id FROM found)",
        "p6_composite_partial": _PAIRS + _KIND.format("(SELECT * FROM whole UNION ALL SELECT * FROM one)"),
        "p6_composite_full": _PAIRS + _KIND.format("whole") + " UNION SELECT det_id, 'partial_null' FROM refs WHERE (image_id IS NULL) <> (category_id IS NULL)",
        "p6_found": _ORPHANS + "SELECT * FROM orphans",
        "p6_report": _ORPHANS + "SELECT table_name, ref_name, kind, period, count(*) AS n FROM orphans GROUP BY ALL",
    }
