"""Queries of the training-data operators, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.consolidate import matched_groups
from tilewright.llm.cutoff import kept_fraction, with_source
from tilewright.llm.leaks import leaked_passages, reparameterised
from tilewright.llm.pii import mask_personal, personal_places
from tilewright.llm.pieces import image_sizes, oversized_pieces
from tilewright.llm.splits import picture_groups, split_of
from tilewright.llm.tokens import decode_corpus, encode_corpus
from tilewright.llm.topn import scored, top_n
from tilewright.session import table

SPLITS = [("train", 80.0), ("validation", 10.0), ("test", 10.0)]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    g = picture_groups(table(spark, d, "terrain_all_coco"))
    return g.filter("linked").select(F.col("record_id").alias("image_id"), "group_id")


def p2_split_images(spark: SparkSession, d: str) -> DataFrame:
    g = picture_groups(table(spark, d, "terrain_all_coco"))
    return g.select(F.col("record_id").alias("image_id"), split_of(F.col("group_id"), SPLITS).alias("split"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """What the splits reach: images, groups and percentage of the images in each."""
    g = picture_groups(table(spark, d, "terrain_all_coco")).withColumn("split", split_of(F.col("group_id"), SPLITS))
    n = g.groupBy("split").agg(F.count("*").alias("n_images"), F.count_distinct("group_id").alias("n_groups"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n_images").alias("total")))).select("split", "n_images", "n_groups", F.round(100 * F.col("n_images") / F.col("total"), 6).alias("pct"))


def p2_split_detections(spark: SparkSession, d: str) -> DataFrame:
    """Detections follow their image; those of an image that is nowhere described form a group by its id."""
    g = picture_groups(table(spark, d, "terrain_all_coco")).select(F.col("record_id").alias("image_id"), "group_id")
    dets = table(spark, d, "coco_result").select("det_id", "image_id").filter("det_id is not null and image_id is not null").distinct()
    return dets.join(g, "image_id", "left").select("det_id", split_of(F.coalesce("group_id", "image_id"), SPLITS).alias("split"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "coco_result").select("image_id", "det_id", "score").filter(scored(F.col("score")))
    return top_n(r, "image_id", "score", "det_id", 5)


def _kept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "keep_targets")
    return kept_fraction(with_source(table(spark, d, "coco_result"), targets, table(spark, d, "coco_categories")), targets)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d)[0].select(F.col("source").alias("category_name"), "det_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d)[1].withColumnRenamed("source", "category_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized_pieces(image_sizes(table(spark, d, "terrain_all_coco")), table(spark, d, "mosaic_seams"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return matched_groups(table(spark, d, "coco_result"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode_corpus(encode_corpus(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return reparameterised(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_places(table(spark, d, "documents"), table(spark, d, "person_names"))


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return mask_personal(table(spark, d, "documents"), table(spark, d, "person_names"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": p2_found,
        "p2_split_images": p2_split_images,
        "p2_shares": p2_shares,
        "p2_split_detections": p2_split_detections,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_report": p4_report,
        "p5_found": p5_found,
        "p7_found": p7_found,
        "p8_ids": p8_ids,
        "p8_decoded": p8_decoded,
        "p9_found": p9_found,
        "p9_reparameterised": p9_reparameterised,
        "p10_found": p10_found,
        "p10_masked": p10_masked,
    }


_PICTURES = r"""
base AS (SELECT id, regexp_replace(CASE WHEN contains(file_name, '%') THEN url_decode(file_name) ELSE file_name END, '^.*[/\\]', '') AS b FROM terrain_all_coco),
parts AS (SELECT id, regexp_extract(b, '(?i)^(.*?[a-z].*?)[\s_.\-]*(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})[\s_.\-]+f0*(\d+)[\s_.\-]+0*(\d+)', ['site', 'y', 'm', 'd', 'flight', 'shot']) AS p FROM base),
keyed AS (SELECT id, regexp_replace(lower(p.site), '[^a-z0-9]+', '', 'g') || '|' || p.y || p.m || p.d || '|' || p.flight || '|' || p.shot AS k FROM parts WHERE p.shot <> ''),
firsts AS (SELECT k, min(id) AS g FROM keyed GROUP BY k),
grouped AS (SELECT id AS image_id, min(g) AS group_id FROM keyed JOIN firsts USING (k) GROUP BY id),
sized AS (SELECT group_id, count(*) AS n FROM grouped GROUP BY group_id)
"""
_PIECES = r"""
WITH RECURSIVE bases AS (SELECT id, width, height, regexp_replace(regexp_replace(CASE WHEN contains(file_name, '%') THEN url_decode(file_name) ELSE file_name END, '^.*[/\\]', ''), '(?i)\.(?:jpe?g|png|tiff?)$', '') AS b FROM terrain_all_coco WHERE id IS NOT NULL),
told AS (SELECT id, width, height, [
  {'w': TRY_CAST(regexp_extract(b, '(?i)[_\-\s]w(\d+)[_x]?h(\d+)\b', 1) AS INT), 'h': TRY_CAST(regexp_extract(b, '(?i)[_\-\s]w(\d+)[_x]?h(\d+)\b', 2) AS INT)},
  {'w': TRY_CAST(regexp_extract(b, '(?i)[_\-\s](\d+)w[_x]?(\d+)h\b', 1) AS INT), 'h': TRY_CAST(regexp_extract(b, '(?i)[_\-\s](\d+)w[_x]?(\d+)h\b', 2) AS INT)},
  {'w': TRY_CAST(regexp_extract(b, '(?i)[_\-\s](\d+)x(\d+)(?:px)?(?:[^\dx]|$)', 1) AS INT), 'h': TRY_CAST(regexp_extract(b, '(?i)[_\-\s](\d+)x(\d+)(?:px)?(?:[^\dx]|$)', 2) AS INT)},
  {'w': TRY_CAST(regexp_extract(b, '_(\d+)_(\d+)_(\d+)_(\d+)\D*$', 3) AS INT) - TRY_CAST(regexp_extract(b, '_(\d+)_(\d+)_(\d+)_(\d+)\D*$', 1) AS INT), 'h': TRY_CAST(regexp_extract(b, '_(\d+)_(\d+)_(\d+)_(\d+)\D*$', 4) AS INT) - TRY_CAST(regexp_extract(b, '_(\d+)_(\d+)_(\d+)_(\d+)\D*$', 2) AS INT)}] AS f FROM bases),
by_id AS (SELECT id, max(CASE WHEN width > 0 AND height > 0 THEN {'w': width, 'h': height} END) AS own, max(list_filter(f, lambda p: p.w > 0 AND p.h > 0)[1]) AS named FROM told GROUP BY id),
sizes AS (SELECT id, coalesce(own, named) AS z FROM by_id WHERE coalesce(own, named) IS NOT NULL),
axes AS (SELECT id, 'x' AS axis, z.w AS n FROM sizes WHERE greatest(z.w, z.h) > 2048 UNION ALL SELECT id, 'y', z.h FROM sizes WHERE greatest(z.w, z.h) > 2048),
lines AS (SELECT a.id, a.axis, a.n, coalesce(list(s.pos) FILTER (s.pos < a.n), []) AS seams FROM axes a LEFT JOIN mosaic_seams s ON s.image_id = a.id AND lower(trim(s.axis)) = a.axis GROUP BY ALL),
cut AS (
  SELECT id, axis, n, seams, 0 AS s, CASE WHEN n <= 2048 THEN n ELSE coalesce(list_max(list_filter(seams, lambda p: p > 160 AND p <= 2048)), 2048) END AS e FROM lines
  UNION ALL SELECT id, axis, n, seams, e - 160, CASE WHEN n - (e - 160) <= 2048 THEN n ELSE coalesce(list_max(list_filter(seams, lambda p: p > e AND p <= e - 160 + 2048)), e - 160 + 2048) END FROM cut WHERE e < n)
SELECT x.id AS image_id, x.s AS x1, y.s AS y1, x.e AS x2, y.e AS y2 FROM cut x JOIN cut y ON x.id = y.id AND x.axis = 'x' AND y.axis = 'y'"""
_PLACE = "CASE WHEN s < 0.8 THEN 'train' WHEN s < 0.9 THEN 'validation' ELSE 'test' END"
_SHARE = "('0x' || substr(md5(g::VARCHAR), 1, 8))::BIGINT / 4294967296.0"
_SCORED = "score BETWEEN 0 AND 1 AND NOT isnan(score)"
_SPELL = r"regexp_replace(lower(translate({0}, (SELECT string_agg(chr((65248 + i)::INT), '' ORDER BY i) FROM range(33, 127) t(i)), (SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(33, 127) t(i)))), '[\s\p{{Z}}\p{{C}}\p{{Pd}}_./+·]+', '', 'g')"
_KEPT = (
    "WITH names AS (SELECT category_name AS source, keep_pct, " + _SPELL.format("category_name") + " AS k FROM keep_targets), "
    "dets AS (SELECT DISTINCT det_id, score, " + _SPELL.format(r"CASE WHEN category_name IS NULL OR regexp_replace(category_name, '[\s\p{Z}\p{C}]+', '', 'g') = '' THEN c.name ELSE category_name END") + " AS k "
    "FROM coco_result r LEFT JOIN coco_categories c ON c.id = r.category_id WHERE " + _SCORED + "), "
    "ranked AS (SELECT source, keep_pct, det_id, score, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY score DESC, det_id) AS rn FROM dets JOIN names USING (k)), "
    "cuts AS (SELECT source, score AS cutoff FROM ranked WHERE rn = greatest(1, (n * keep_pct + 99) // 100)) "
)


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH {_PICTURES} SELECT image_id, group_id FROM grouped JOIN sized USING (group_id) WHERE n > 1",
        "p2_split_images": f"WITH {_PICTURES}, a AS (SELECT DISTINCT i.id AS image_id, coalesce(group_id, i.id) AS g FROM terrain_all_coco i LEFT JOIN grouped ON image_id = i.id), b AS (SELECT image_id, {_SHARE} AS s FROM a) SELECT image_id, {_PLACE} AS split FROM b",
        "p2_shares": f"WITH {_PICTURES}, a AS (SELECT DISTINCT i.id AS image_id, coalesce(group_id, i.id) AS g FROM terrain_all_coco i LEFT JOIN grouped ON image_id = i.id), b AS (SELECT image_id, g, {_SHARE} AS s FROM a), c AS (SELECT g, {_PLACE} AS split FROM b) SELECT split, count(*) AS n_images, count(DISTINCT g) AS n_groups, round(100 * count(*) / (SELECT count(*) FROM c), 6) AS pct FROM c GROUP BY split",
        "p2_split_detections": f"WITH {_PICTURES}, a AS (SELECT DISTINCT det_id, coalesce(group_id, r.image_id) AS g FROM coco_result r LEFT JOIN grouped USING (image_id) WHERE r.image_id IS NOT NULL), b AS (SELECT det_id, {_SHARE} AS s FROM a) SELECT det_id, {_PLACE} AS split FROM b",
        "p3_found": f"WITH d AS (SELECT DISTINCT image_id, det_id, score FROM coco_result WHERE image_id IS NOT NULL AND {_SCORED}), r AS (SELECT image_id, det_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS INT) AS rank_no FROM d) SELECT * FROM r WHERE rank_no <= 5",
        "p4_found": _KEPT + "SELECT source AS category_name, det_id FROM ranked JOIN cuts USING (source) WHERE score >= cutoff",
        "p4_report": _KEPT + "SELECT source AS category_name, any_value(keep_pct)::BIGINT AS keep_pct, any_value(n) AS n_items, any_value(cutoff) AS cutoff, count(*) AS n_kept FROM ranked JOIN cuts USING (source) WHERE score >= cutoff GROUP BY source",
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p5_found": _PIECES,
        "p7_found": f"""
            WITH RECURSIVE d AS (SELECT DISTINCT det_id, image_id, bbox[1] AS x1, bbox[2] AS y1, bbox[1] + bbox[3] AS x2, bbox[2] + bbox[4] AS y2 FROM coco_result
              WHERE image_id IS NOT NULL AND {_SCORED} AND score >= 0.1 AND len(bbox) = 4 AND bbox[3] > 0 AND bbox[4] > 0),
            e AS (SELECT a.det_id AS u, b.det_id AS v FROM d a JOIN d b ON a.image_id = b.image_id AND a.det_id <> b.det_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2
              WHERE 3 * (least(a.x2, b.x2) - greatest(a.x1, b.x1))::BIGINT * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) >= (a.x2 - a.x1)::BIGINT * (a.y2 - a.y1) + (b.x2 - b.x1)::BIGINT * (b.y2 - b.y1)),
            reach AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u)
            SELECT u AS det_id, least(u, min(v)) AS group_id FROM reach GROUP BY u""",
    }
