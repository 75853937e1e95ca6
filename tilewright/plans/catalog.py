"""One query for each operator of the engine, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import boxes as B
from tilewright.functions import decode as X
from tilewright.functions import polygons as P
from tilewright.functions.text import file_base
from tilewright.operators import dataset as D
from tilewright.operators import evaluation as E
from tilewright.operators import pipeline as L
from tilewright.operators import tiling as T
from tilewright.operators.merge import Merging, groups, merged, merged_masks, nms, ranked
from tilewright.operators.overlap import grid_pairs, mean_degree
from tilewright.plans.views import ctes, dataset, view
from tilewright.session import Scratch, table
from tilewright.sources import coco, media, yolo
from tilewright.streaming.frames import counts_by_window

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQLS: dict[str, str] = {}
PAIR_IOU, SCENE = 0.3, ["scene_id"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQLS[name] = sql
        return f

    return keep


# --- tiling ------------------------------------------------------------------------------------------------------------


def _ax(k: str, length: str, size: str, step: str) -> tuple[str, str]:
    end = f"least({length}, {k} * {step} + {size})"
    return f"greatest(0, {end} - {size})", end


def _grid(size: int, ov: int, source: str = "v_images", extra: str = "") -> str:
    """SQL of a tile grid, row by row."""
    step = size - ov
    (x1, x2), (y1, y2) = _ax("c", "width", str(size), str(step)), _ax("r", "height", str(size), str(step))
    return (
        f"n AS (SELECT *, greatest(ceil((width - {size}) / {step}.0), 0)::INT + 1 AS nx, greatest(ceil((height - {size}) / {step}.0), 0)::INT + 1 AS ny FROM {source}), "
        f"rs AS (SELECT *, unnest(range(0, ny))::INT AS r FROM n), cs AS (SELECT *, unnest(range(0, nx))::INT AS c FROM rs), "
        f"grid AS (SELECT image_id, file_name, height, width{extra}, (r * nx + c)::INT AS tile_idx, r AS row_idx, c AS col_idx, ({x1})::INT AS x1, ({y1})::INT AS y1, ({x2})::INT AS x2, ({y2})::INT AS y2 FROM cs)"
    )


_TILE_COLS = ["image_id", "tile_idx", "row_idx", "col_idx", "x1", "y1", "x2", "y2"]


@query("tile_grid", f"{ctes('v_images')}, {_grid(512, 102)} SELECT image_id, tile_idx, row_idx, col_idx, x1, y1, x2, y2 FROM grid")
def tile_grid(spark, d):
    return T.tiles(view(spark, d, "v_images")).select(*_TILE_COLS)


_FACTOR = "length(bin(height::BIGINT * width - 1)) - 1"
_AUTO = f"""
f AS (SELECT *, CASE WHEN {_FACTOR} <= 18 THEN 'low' WHEN {_FACTOR} < 21 THEN 'medium' WHEN {_FACTOR} < 24 THEN 'high' ELSE 'ultra-high' END AS resolution,
  CASE WHEN width < height THEN 'vertical' WHEN width > height THEN 'horizontal' ELSE 'square' END AS orientation FROM v_images),
s AS (SELECT *, CASE resolution WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 4 END AS sl, CASE WHEN resolution = 'medium' THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END AS ra FROM f),
z AS (SELECT *, CASE WHEN resolution = 'low' THEN height ELSE height // (sl * CASE WHEN orientation = 'vertical' THEN 2 ELSE 1 END) END AS th,
  CASE WHEN resolution = 'low' THEN width ELSE width // (sl * CASE WHEN orientation = 'horizontal' THEN 2 ELSE 1 END) END AS tw FROM s),
o AS (SELECT *, CASE WHEN resolution = 'low' THEN 0 ELSE floor(th * ra)::INT END AS oh, CASE WHEN resolution = 'low' THEN 0 ELSE floor(tw * ra)::INT END AS ow FROM z)"""
_AX1, _AY1 = _ax("c", "width", "tw", "(tw - ow)"), _ax("r", "height", "th", "(th - oh)")


@query("tile_params_auto", f"{ctes('v_images')}, {_AUTO} SELECT image_id, resolution, orientation, th::INT AS tile_height, tw::INT AS tile_width, oh AS ov_h, ow AS ov_w FROM o")
def tile_params_auto(spark, d):
    return T.auto_tiles(view(spark, d, "v_images")).select("image_id", "resolution", "orientation", "tile_height", "tile_width", "ov_h", "ov_w")


@query(
    "tile_grid_auto",
    f"{ctes('v_images')}, {_AUTO}, n AS (SELECT *, greatest(ceil((width - tw) / (tw - ow)::DOUBLE), 0)::INT + 1 AS nx, greatest(ceil((height - th) / (th - oh)::DOUBLE), 0)::INT + 1 AS ny FROM o), rs AS (SELECT *, unnest(range(0, ny))::INT AS r FROM n), cs AS (SELECT *, unnest(range(0, nx))::INT AS c FROM rs) "
    f"SELECT image_id, (r * nx + c)::INT AS tile_idx, r AS row_idx, c AS col_idx, ({_AX1[0]})::INT AS x1, ({_AY1[0]})::INT AS y1, ({_AX1[1]})::INT AS x2, ({_AY1[1]})::INT AS y2 FROM cs",
)
def tile_grid_auto(spark, d):
    return T.tiles(view(spark, d, "v_images"), T.TileSpec(auto=True)).select(*_TILE_COLS)


@query("tile_count_by_orientation", f"{ctes('v_images')}, {_grid(512, 102)} SELECT CASE WHEN width < height THEN 'vertical' WHEN width > height THEN 'horizontal' ELSE 'square' END AS orientation, count(*) AS n_tiles, count(DISTINCT image_id) AS n_images FROM grid GROUP BY 1")
def tile_count_by_orientation(spark, d):
    i = T.with_tile_size(view(spark, d, "v_images"), T.TileSpec())
    n = T.axis_count(F.col("width"), F.col("tile_width"), F.col("ov_w")) * T.axis_count(F.col("height"), F.col("tile_height"), F.col("ov_h"))
    return i.groupBy(T.orientation(F.col("height"), F.col("width")).alias("orientation")).agg(F.sum(n).alias("n_tiles"), F.count("*").alias("n_images"))


@query("tile_names", f"{ctes('v_images')}, {_grid(640, 128)} SELECT image_id, tile_idx, concat_ws('_', regexp_replace(file_name, '\\.[^.]*$', ''), x1, y1, x2, y2) || '.png' AS name FROM grid")
def tile_names(spark, d):
    return T.tiles(view(spark, d, "v_images"), T.TileSpec(640, 640)).select("image_id", "tile_idx", T.tile_name(F.col("file_name")).alias("name"))


def _sliced(size: int, ov: int, ratio: float) -> str:
    return (
        f"{_grid(size, ov)}, cut AS (SELECT g.image_id, g.tile_idx, a.ann_id, a.category_id, greatest(a.x, g.x1) - g.x1 AS x, greatest(a.y, g.y1) - g.y1 AS y, least(a.x + a.w, g.x2) - greatest(a.x, g.x1) AS w, least(a.y + a.h, g.y2) - greatest(a.y, g.y1) AS h, floor(a.w * a.h) AS full_area "
        f"FROM grid g JOIN v_annotations a ON a.image_id = g.image_id AND a.x < g.x2 AND a.x + a.w > g.x1 AND a.y < g.y2 AND a.y + a.h > g.y1), "
        f"sliced AS (SELECT image_id, tile_idx, ann_id, category_id, x, y, w, h, floor(w * h)::BIGINT AS area FROM cut WHERE full_area >= 1 AND floor(w * h) / full_area >= {ratio}::DOUBLE)"
    )


@query("slice_annotations", f"{ctes('v_images', 'v_annotations')}, {_sliced(512, 102, 0.1)} SELECT * FROM sliced")
def slice_annotations(spark, d):
    return T.slice_annotations(view(spark, d, "v_images"), view(spark, d, "v_annotations"))


@query("slice_coco_export", f"{ctes('v_images', 'v_annotations')}, {_sliced(512, 102, 0.1)}, s AS (SELECT image_id, tile_idx, count(*) AS n, sum(area)::BIGINT AS area FROM sliced GROUP BY ALL) SELECT g.image_id, g.tile_idx, concat_ws('_', regexp_replace(file_name, '\\.[^.]*$', ''), x1, y1, x2, y2) || '.png' AS file_name, y2 - y1 AS height, x2 - x1 AS width, n AS n_annotations, area FROM grid g JOIN s USING (image_id, tile_idx)")
def slice_coco_export(spark, d):
    ds = dataset(spark, d)
    t, a = T.slice_dataset(ds.images, ds.annotations, ignore_negatives=True)
    return t.join(a.groupBy("image_id", "tile_idx").agg(F.count("*").alias("n_annotations"), F.sum("area").alias("area")), ["image_id", "tile_idx"])


@query("slice_multi_size", f"{ctes('v_images', 'v_annotations')} SELECT 640 AS slice_size, count(*) AS n, sum(area)::BIGINT AS area FROM (WITH {_sliced(640, 128, 0.1)} SELECT * FROM sliced) UNION ALL SELECT 1024, count(*), sum(area)::BIGINT FROM (WITH {_sliced(1024, 204, 0.1)} SELECT * FROM sliced)")
def slice_multi_size(spark, d):
    ds = dataset(spark, d)
    one = lambda s: T.slice_annotations(ds.images, ds.annotations, T.TileSpec(s, s)).agg(F.lit(s).alias("slice_size"), F.count("*").alias("n"), F.sum("area").alias("area"))
    return one(640).unionByName(one(1024))


@query("tile_shift_back", f"{ctes('v_images', 'v_annotations')}, {_sliced(512, 102, 0.1)} SELECT s.image_id, s.tile_idx, ann_id, s.x + g.x1 AS x1, s.y + g.y1 AS y1, s.x + s.w + g.x1 AS x2, s.y + s.h + g.y1 AS y2 FROM sliced s JOIN grid g USING (image_id, tile_idx)")
def tile_shift_back(spark, d):
    im = view(spark, d, "v_images")
    s = T.slice_annotations(im, view(spark, d, "v_annotations")).select("image_id", "tile_idx", "ann_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return T.to_images(s, im)


# --- boxes -------------------------------------------------------------------------------------------------------------

_ANN = ctes("v_annotations")
_ANNI = ctes("v_images", "v_annotations")


def _ann_boxes(spark, d) -> DataFrame:
    a = view(spark, d, "v_annotations").join(view(spark, d, "v_images").select("image_id", "height", "width"), "image_id")
    return a.withColumns(dict(zip(("x1", "y1", "x2", "y2"), B.to_xyxy(F.col("x"), F.col("y"), F.col("w"), F.col("h")), strict=True)))


_BOXED = "b AS (SELECT a.*, i.height, i.width, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM v_annotations a JOIN v_images i USING (image_id))"


def _named(cols, names=("x1", "y1", "x2", "y2")):
    return [c.cast("double").alias(n) for c, n in zip(cols, names, strict=True)]


@query("box_area", f"{_ANN} SELECT ann_id, w * h AS area FROM v_annotations")
def box_area(spark, d):
    return _ann_boxes(spark, d).select("ann_id", B.area(*B.cols()).alias("area"))


@query("box_expand", f"{_ANNI}, {_BOXED} SELECT ann_id, greatest(0, x1 - floor(w * 0.1::DOUBLE))::DOUBLE AS x1, greatest(0, y1 - floor(h * 0.1::DOUBLE))::DOUBLE AS y1, least(x2 + floor(w * 0.1::DOUBLE), width)::DOUBLE AS x2, least(y2 + floor(h * 0.1::DOUBLE), height)::DOUBLE AS y2 FROM b")
def box_expand(spark, d):
    return _ann_boxes(spark, d).select("ann_id", *_named(B.expand(B.cols(), 0.1, F.col("width").cast("double"), F.col("height").cast("double"))))


@query("box_formats", f"{_ANNI}, {_BOXED} SELECT ann_id, x1, y1, x2, y2, x2 - x1 AS w, y2 - y1 AS h FROM b")
def box_formats(spark, d):
    w = B.to_xywh(*B.cols())
    return _ann_boxes(spark, d).select("ann_id", "x1", "y1", "x2", "y2", w[2].alias("w"), w[3].alias("h"))


@query("box_shift", f"{_ANNI}, {_BOXED} SELECT ann_id, x1 + 10 AS x1, y1 + 20 AS y1, x2 + 10 AS x2, y2 + 20 AS y2 FROM b")
def box_shift(spark, d):
    return _ann_boxes(spark, d).select("ann_id", *_named(B.shift(B.cols(), F.lit(10), F.lit(20))))


@query("box_clamp", f"{_ANNI}, {_BOXED} SELECT ann_id, greatest(x1, 0)::DOUBLE AS x1, greatest(y1, 0)::DOUBLE AS y1, least(x2, width)::DOUBLE AS x2, least(y2, height)::DOUBLE AS y2 FROM b")
def box_clamp(spark, d):
    return _ann_boxes(spark, d).select("ann_id", *_named(B.clamp(B.cols(), F.col("width").cast("double"), F.col("height").cast("double"))))


_YOLO = ("cx", "cy", "nw", "nh")


@query("voc_to_yolo", f"{_ANNI}, {_BOXED} SELECT ann_id, (x1 + x2) / 2 / width AS cx, (y1 + y2) / 2 / height AS cy, (x2 - x1) / width AS nw, (y2 - y1) / height AS nh FROM b")
def voc_to_yolo(spark, d):
    return _ann_boxes(spark, d).select("ann_id", *_named(B.voc_to_yolo(B.cols(), F.col("width"), F.col("height")), _YOLO))


@query("yolo_to_voc", f"{_ANNI}, {_BOXED} SELECT ann_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM b")
def yolo_to_voc(spark, d):
    """There and back again."""
    y = _ann_boxes(spark, d).select("ann_id", "height", "width", *_named(B.voc_to_yolo(B.cols(), F.col("width"), F.col("height")), _YOLO))
    return y.select("ann_id", *[F.round(c, 6).alias(n) for c, n in zip(B.yolo_to_voc(*[F.col(k) for k in _YOLO], F.col("width"), F.col("height")), ("x1", "y1", "x2", "y2"), strict=True)])


@query("relative_boxes", f"{_ANNI}, {_BOXED} SELECT ann_id, x / width AS rx, y / height AS ry, w / width AS rw, h / height AS rh FROM b")
def relative_boxes(spark, d):
    return _ann_boxes(spark, d).select("ann_id", *_named(D.relative_columns(F.col("width"), F.col("height")), ("rx", "ry", "rw", "rh")))


@query("reading_order", f"{ctes('v_dets')} SELECT id, (row_number() OVER (PARTITION BY scene_id ORDER BY floor(y1 / 10), x1, id) - 1)::INT AS position FROM v_dets")
def reading_order(spark, d):
    return L.reading_order(view(spark, d, "v_dets").withColumnRenamed("scene_id", "image_id")).select("id", "position")


# --- overlaps and merging ----------------------------------------------------------------------------------------------

_DETS = ctes("v_dets")


def _inter(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def _size(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def _metric(a: str, b: str, ios: bool = False) -> str:
    den = f"least({_size(a)}, {_size(b)})" if ios else f"({_size(a)} + {_size(b)} - {_inter(a, b)})"
    return f"(CASE WHEN {den} > 0 THEN {_inter(a, b)} / {den} ELSE 0 END)"


def _pairs_sql(ios: bool, keys: str = "a.scene_id = b.scene_id") -> str:
    return f"{_DETS} SELECT DISTINCT a.scene_id, a.id AS i, b.id AS j, round({_metric('a', 'b', ios)}, 9) AS metric FROM v_dets a JOIN v_dets b ON {keys} AND a.id < b.id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 WHERE {_metric('a', 'b', ios)} >= {PAIR_IOU}"


def _pairs(spark, d, metric) -> DataFrame:
    return grid_pairs(view(spark, d, "v_dets"), SCENE, "id", metric, PAIR_IOU).select("scene_id", "i", "j", F.round("metric", 9).alias("metric"))


@query("iou_pairs", _pairs_sql(False))
def iou_pairs(spark, d):
    return _pairs(spark, d, "IOU")


@query("ios_pairs", _pairs_sql(True))
def ios_pairs(spark, d):
    return _pairs(spark, d, "IOS")


@query("grid_join_pairs", _pairs_sql(False, "a.scene_id = b.scene_id AND a.category_id = b.category_id").replace("a.scene_id, a.id", "a.scene_id, a.category_id, a.id"))
def grid_join_pairs(spark, d):
    return grid_pairs(view(spark, d, "v_dets"), ["scene_id", "category_id"], "id", "IOU", PAIR_IOU).select("scene_id", "category_id", "i", "j", F.round("metric", 9).alias("metric"))


@query("mean_degree", f"{_DETS}, e AS (SELECT a.scene_id, count(*) AS n FROM v_dets a JOIN v_dets b ON a.scene_id = b.scene_id AND a.id < b.id AND {_metric('a', 'b')} >= {PAIR_IOU} GROUP BY 1) SELECT scene_id, count(*) AS n_boxes, round(2.0 * coalesce(any_value(e.n), 0) / count(*), 9) AS mean_degree FROM v_dets LEFT JOIN e USING (scene_id) GROUP BY scene_id")
def mean_degree_q(spark, d):
    return mean_degree(view(spark, d, "v_dets"), SCENE, "id", "IOU", PAIR_IOU).withColumn("mean_degree", F.round("mean_degree", 9))


_ORD = "score DESC, x1, y1, x2, y2, id"


def _nms_sql(thr: float, ios: bool = False, cat: bool = False, op: str = ">=", order: str = _ORD) -> str:
    keys = "scene_id, category_id" if cat else "scene_id"
    return (
        f"bs AS (SELECT {keys}, list({{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY {order}) AS b FROM v_dets GROUP BY {keys}), "
        f"kept AS (SELECT {keys}, unnest(list_reduce(list_transform(b, lambda q: [q]), lambda acc, q: CASE WHEN len(list_filter(acc, lambda k: {_metric('k', 'q[1]', ios)} {op} {thr})) > 0 THEN acc ELSE list_concat(acc, q) END)).id AS id FROM bs)"
    )


def _nms_query(name: str, strategy: str, metric: str = "IOU", thr: float = 0.5, agnostic: bool = True, strict: bool = False) -> None:
    cat = not agnostic
    keys = "scene_id, category_id" if cat else "scene_id"
    sql = f"{_DETS}, {_nms_sql(thr, metric == 'IOS', cat, '>' if strict else '>=', 'score DESC, id' if strict else _ORD)} SELECT {keys}, id FROM kept"
    query(name, sql)(lambda spark, d: nms(view(spark, d, "v_dets"), SCENE, metric, thr, agnostic, strategy, strict))


_nms_query("nms", "auto")
_nms_query("nms_ios", "auto", "IOS")
_nms_query("nms_fold", "fold")
_nms_query("nms_relational", "relational")
_nms_query("batched_nms", "auto", agnostic=False)
_nms_query("batched_nms_relational", "relational", thr=0.3, agnostic=False)
_nms_query("legacy_nms", "auto", strict=True)


@query("nms_match_all", f"{_DETS} SELECT scene_id, id FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {_ORD}) AS rn FROM v_dets) WHERE rn = 1")
def nms_match_all(spark, d):
    return nms(view(spark, d, "v_dets"), SCENE, threshold=0.0)


@query("box_rank", f"{_DETS} SELECT id, row_number() OVER (PARTITION BY scene_id ORDER BY {_ORD})::INT AS rank FROM v_dets")
def box_rank(spark, d):
    return ranked(view(spark, d, "v_dets"), SCENE).select("id", "rank")


def _ranked_sql(cat: bool) -> str:
    keys = "scene_id, category_id" if cat else "scene_id"
    return f"rk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {_ORD}) AS rk FROM v_dets)"


def _owner_sql(thr: float, ios: bool, cat: bool) -> str:
    same = "a.scene_id = b.scene_id" + (" AND a.category_id = b.category_id" if cat else "")
    return (
        f"{_nms_sql(thr, ios, cat)}, {_ranked_sql(cat)}, kk AS (SELECT rk.* FROM rk JOIN (SELECT id FROM kept) USING (id)), "
        f"own AS (SELECT b.id, coalesce(min(a.rk), any_value(b.rk)) AS ork, any_value(b.scene_id) AS scene_id, any_value(b.category_id) AS category_id, any_value(b.rk) AS rk FROM rk b LEFT JOIN kk a ON {same} AND a.rk < b.rk AND {_metric('a', 'b', ios)} >= {thr} AND b.id NOT IN (SELECT id FROM kept) GROUP BY b.id), "
        f"owners AS (SELECT o.id, k.id AS keeper, o.rk AS claim FROM own o JOIN rk k ON k.scene_id = o.scene_id {'AND k.category_id = o.category_id' if cat else ''} AND k.rk = o.ork)"
    )


def _forest_sql(thr: float, ios: bool, cat: bool) -> str:
    same = "a.scene_id = b.scene_id" + (" AND a.category_id = b.category_id" if cat else "")
    k = ", category_id" if cat else ""
    return (
        f"{_ranked_sql(cat)}, par AS (SELECT b.scene_id, b.category_id, b.rk, b.id, min(a.rk) AS prk FROM rk b JOIN rk a ON {same} AND a.rk < b.rk AND {_metric('a', 'b', ios)} >= {thr} AND (a.score > b.score OR (a.score = b.score AND a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2)) GROUP BY ALL), "
        f"up AS (SELECT id, scene_id, category_id, prk AS cur, prk FROM par UNION ALL SELECT u.id, u.scene_id, u.category_id, p.prk, u.prk FROM up u JOIN par p ON p.scene_id = u.scene_id {'AND p.category_id = u.category_id' if cat else ''} AND p.rk = u.cur), "
        f"tops AS (SELECT id, scene_id, any_value(category_id) AS category_id, min(cur) AS top, any_value(prk) AS prk FROM up GROUP BY id, scene_id), "
        f"owners AS (SELECT t.id, r.id AS keeper, t.prk AS claim FROM tops t JOIN rk r ON r.scene_id = t.scene_id {'AND r.category_id = t.category_id' if cat else ''} AND r.rk = t.top UNION ALL SELECT id, id, rk FROM rk WHERE id NOT IN (SELECT id FROM tops))"
    )


def _merged_sql(owners: str, thr: float, ios: bool, head: str = "") -> str:
    grown = "{'x1': least(acc.x1, m.x1), 'y1': least(acc.y1, m.y1), 'x2': greatest(acc.x2, m.x2), 'y2': greatest(acc.y2, m.y2), 's': greatest(acc.s, m.s), 'c': CASE WHEN acc.s > m.s THEN acc.c ELSE m.c END, 'n': acc.n + 1}"
    return (
        f"{head or _DETS}, {owners}, ms AS (SELECT d.scene_id, o.keeper, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 's': score, 'c': category_id, 'n': 0::BIGINT}} ORDER BY (o.id = o.keeper) DESC, claim, o.id) AS l FROM owners o JOIN v_dets d ON d.id = o.id GROUP BY ALL), "
        f"fd AS (SELECT scene_id, keeper AS id, list_reduce(l, lambda acc, m: CASE WHEN {_metric('acc', 'm', ios)} > {thr} THEN {grown} ELSE acc END) AS f FROM ms) "
        f"SELECT scene_id, id, f.c AS category_id, f.s AS score, f.x1 AS x1, f.y1 AS y1, f.x2 AS x2, f.y2 AS y2, f.n AS n_merged FROM fd"
    )


def _group_query(name: str, how: Merging, fold: bool) -> None:
    ios, cat = how.metric == "IOS", not how.class_agnostic
    owners = (_forest_sql if how.method == "nmm" else _owner_sql)(how.threshold, ios, cat)
    if fold:
        query(name, _merged_sql(owners, how.threshold, ios))(lambda spark, d: merged(view(spark, d, "v_dets"), SCENE, how))
    else:
        query(name, f"{_DETS}, {owners} SELECT DISTINCT id, keeper FROM owners")(lambda spark, d: groups(view(spark, d, "v_dets"), SCENE, how).select("id", "keeper"))


_group_query("greedy_nmm", Merging("greedy_nmm", "IOS", 0.5, True), False)
_group_query("greedy_nmm_relational", Merging("greedy_nmm", "IOS", 0.5, True, "relational"), False)
_group_query("batched_greedy_nmm", Merging("greedy_nmm", "IOS", 0.5, False), False)
_group_query("greedy_nmm_merged", Merging("greedy_nmm", "IOS", 0.5, False), True)
_group_query("greedy_nmm_merged_iou", Merging("greedy_nmm", "IOU", 0.3, True), True)
_group_query("nmm", Merging("nmm", "IOU", 0.3, True), False)
_group_query("nmm_relational", Merging("nmm", "IOU", 0.3, True, "relational"), False)
_group_query("batched_nmm", Merging("nmm", "IOS", 0.5, False), False)
_group_query("nmm_merged", Merging("nmm", "IOU", 0.3, False), True)
_group_query("batched_nmm_merged", Merging("nmm", "IOS", 0.5, False), True)


_BOX_M = "{'x1': m.x1, 'y1': m.y1, 'x2': m.x2, 'y2': m.y2}"
_UNION = f"""{_DETS}, start AS (SELECT scene_id, category_id, list({{'id': id, 's': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, id) AS l FROM v_dets GROUP BY ALL),
step AS (
  SELECT scene_id, category_id, NULL::BIGINT AS id, NULL::DOUBLE AS score, NULL::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) AS b, 0::BIGINT AS n_merged, l FROM start
  UNION ALL
  SELECT scene_id, category_id, l[1].id, l[1].s, f.b, len(f.t)::BIGINT, list_filter(l[2:], lambda z: NOT list_contains(f.t, z.id)) FROM (
    SELECT scene_id, category_id, l, list_reduce(list_transform(l, lambda m: {{'id': m.id, 'b': {_BOX_M}, 't': []::BIGINT[]}}), lambda acc, m: CASE WHEN {_metric('acc.b', 'm.b')} > 0.3
      THEN {{'id': acc.id, 'b': {{'x1': least(acc.b.x1, m.b.x1), 'y1': least(acc.b.y1, m.b.y1), 'x2': greatest(acc.b.x2, m.b.x2), 'y2': greatest(acc.b.y2, m.b.y2)}}, 't': list_append(acc.t, m.id)}} ELSE acc END) AS f
    FROM step WHERE len(l) > 0) q)
SELECT scene_id, id, category_id, score, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2, n_merged FROM step WHERE id IS NOT NULL"""


@query("union_merge", _UNION)
def union_merge(spark, d):
    return merged(view(spark, d, "v_dets"), SCENE, Merging("union_merge", "IOU", 0.3, False))


_TOOK = "{'x1': least(acc.x1, m.x1), 'y1': least(acc.y1, m.y1), 'x2': greatest(acc.x2, m.x2), 'y2': greatest(acc.y2, m.y2), 't': list_concat(acc.t, m.t)}"
_PIXELS = (
    f"{_DETS}, {_owner_sql(0.5, True, False)}, ms AS (SELECT d.scene_id, o.keeper, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 't': [d.id]}} ORDER BY (o.id = o.keeper) DESC, claim, o.id) AS l FROM owners o JOIN v_dets d ON d.id = o.id GROUP BY ALL), "
    f"fd AS (SELECT scene_id, keeper AS id, list_reduce(l, lambda acc, m: CASE WHEN {_metric('acc', 'm', True)} > 0.5 THEN {_TOOK} ELSE acc END).t AS t FROM ms), "
    "px AS (SELECT f.scene_id, f.id, unnest(range(x1::BIGINT, x2::BIGINT + 1)) AS x, y1, y2 FROM (SELECT scene_id, id, unnest(t) AS m FROM fd WHERE len(t) > 1) f JOIN v_dets d ON d.id = f.m), "
    "pq AS (SELECT scene_id, id, x, unnest(range(y1::BIGINT, y2::BIGINT + 1)) AS y FROM px) "
    "SELECT scene_id, id, count(DISTINCT (x, y)) AS pixels FROM pq GROUP BY ALL UNION ALL SELECT scene_id, id, ((x2 - x1 + 1) * (y2 - y1 + 1))::BIGINT FROM v_dets JOIN (SELECT id FROM fd WHERE len(t) = 1) s USING (id)"
)


@query("merge_masks", _PIXELS)
def merge_masks(spark, d):
    """Boxes as polygons, merged and united; the pixels that each kept one covers."""
    boxes = view(spark, d, "v_dets").withColumn("segmentation", F.array(P.box_ring(*B.cols())))
    m = merged_masks(boxes, SCENE, Merging("greedy_nmm", "IOS", 0.5, True))
    return m.select("scene_id", "id", P.pixels_of("segmentation").alias("pixels"))


@query("greedy_nmm_match_all", f"{_DETS}, t AS (SELECT scene_id, id AS keeper FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {_ORD}) AS rn FROM v_dets) WHERE rn = 1) SELECT DISTINCT id, keeper FROM v_dets JOIN t USING (scene_id)")
def greedy_nmm_match_all(spark, d):
    return groups(view(spark, d, "v_dets"), SCENE, Merging("greedy_nmm", "IOU", 0.0, True)).select("id", "keeper")


@query("nmm_match_all", f"{_DETS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {_ORD}) AS rn FROM v_dets) WHERE rn = 1) SELECT DISTINCT d.id, CASE WHEN d.score < t.score OR (d.x1 = t.x1 AND d.y1 = t.y1 AND d.x2 = t.x2 AND d.y2 = t.y2) THEN t.id ELSE d.id END AS keeper FROM v_dets d JOIN t USING (scene_id)")
def nmm_match_all(spark, d):
    return groups(view(spark, d, "v_dets"), SCENE, Merging("nmm", "IOU", 0.0, True)).select("id", "keeper")


# --- predictions -------------------------------------------------------------------------------------------------------


@query("exclude_classes", f"{_DETS} SELECT id, category_id FROM v_dets WHERE category_id <> 1 AND CASE category_id WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END <> 'R'")
def exclude_classes(spark, d):
    p = view(spark, d, "v_dets").join(F.broadcast(view(spark, d, "v_categories").select("category_id", F.col("name").alias("category_name"))), "category_id")
    return L.exclude(p, ["R"], [1]).select("id", "category_id")


@query("score_filter", f"{_DETS} SELECT id, score FROM v_dets WHERE score >= 0.3")
def score_filter(spark, d):
    return view(spark, d, "v_dets").filter(F.col("score") >= 0.3).select("id", "score")


@query("prediction_remap", f"{_DETS} SELECT id, CASE category_id WHEN 0 THEN 7 WHEN 2 THEN 9 ELSE category_id END AS category_id FROM v_dets")
def prediction_remap(spark, d):
    return L.remap_categories(view(spark, d, "v_dets"), {"0": 7, "2": 9}).select("id", "category_id")


@query("coco_prediction_rows", f"{_DETS} SELECT scene_id AS image_id, [x1, y1, x2 - x1, y2 - y1] AS bbox, score, category_id FROM v_dets")
def coco_prediction_rows(spark, d):
    return L.coco_predictions(view(spark, d, "v_dets").withColumnRenamed("scene_id", "image_id"))


@query("softmax_decode", "WITH t AS (SELECT vec_id, embedding AS e, list_max(embedding) AS m, embedding[1:len(embedding) - 1] AS fg FROM embeddings) SELECT vec_id, (list_position(fg, list_max(fg)) - 1)::INT AS label, round(exp((list_max(fg) - m)::DOUBLE) / list_sum(list_transform(e, lambda v: exp((v - m)::DOUBLE))), 6) AS score FROM t")
def softmax_decode(spark, d):
    z = L.softmax_decode(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", z["label"].alias("label"), F.round(z["score"], 6).alias("score"))


@query("sigmoid_decode", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS label, round(1 / (1 + exp(-list_max(embedding)::DOUBLE)), 6) AS score FROM embeddings")
def sigmoid_decode(spark, d):
    z = L.sigmoid_decode(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", z["label"].alias("label"), F.round(z["score"], 6).alias("score"))


_GRID_BOXES = f"""{ctes('v_images')}, {_grid(512, 102)},
t AS (SELECT image_id, tile_idx, x1, y1, x2, y2 FROM grid UNION ALL SELECT image_id, -1, 0, 0, width, height FROM v_images WHERE image_id IN (SELECT image_id FROM grid WHERE tile_idx = 1)),
k AS (SELECT *, unnest(range(0, greatest(1, least(x2 - x1, y2 - y1) - 64), 128)) AS k FROM t),
p AS (SELECT image_id, tile_idx, k, ((image_id + k // 128) % 3)::INT AS category_id, (((image_id * 31 + tile_idx * 17 + k) % 1000 + 1000) % 1000) / 1000.0::DOUBLE AS score, x1 + k AS x1, y1 + k AS y1, x1 + least(x2 - x1, k + 64) AS x2, y1 + least(y2 - y1, k + 64) AS y2 FROM k)"""


@query("detect_tiles", f"{_GRID_BOXES} SELECT image_id, tile_idx, category_id, round(score, 6) AS score, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM p WHERE tile_idx >= 0 AND score >= 0.3")
def detect_tiles(spark, d):
    t = T.tiles(L.spread(view(spark, d, "v_images"))).select("image_id", "tile_idx", "x1", "y1", "x2", "y2")
    return L.detect(t, L.GridDetector, shifted=True, confidence=0.3, named=False).withColumn("score", F.round("score", 6))


_PREDICTED = f"""{_GRID_BOXES}, v_dets AS (SELECT image_id AS scene_id, row_number() OVER (ORDER BY image_id, tile_idx, k) AS id, category_id, score, x1, y1, x2, y2 FROM (
  SELECT p.image_id, tile_idx, k, category_id, score, greatest(x1, 0)::DOUBLE AS x1, greatest(y1, 0)::DOUBLE AS y1, least(x2, width)::DOUBLE AS x2, least(y2, height)::DOUBLE AS y2 FROM p JOIN v_images i ON i.image_id = p.image_id WHERE score >= 0.3) q WHERE x2 > x1 AND y2 > y1)"""


@query("sliced_pipeline", f"SELECT scene_id AS image_id, category_id, score, x1, y1, x2, y2, n_merged FROM ({_merged_sql(_owner_sql(0.5, True, True), 0.5, True, _PREDICTED)})")
def sliced_pipeline(spark, d):
    return L.sliced_prediction(view(spark, d, "v_images"), L.GridDetector).drop("id")


# --- datasets ----------------------------------------------------------------------------------------------------------

_DS = ctes("v_images", "v_categories", "v_annotations")


@query("category_remap", f"{_ANN} SELECT ann_id, (category_id + 10)::INT AS category_id FROM v_annotations")
def category_remap(spark, d):
    m = view(spark, d, "v_categories").select("category_id", (F.col("category_id") + 10).alias("new_id"))
    return D.remap_by_id(dataset(spark, d), m).annotations.select("ann_id", "category_id")


def _desired(spark) -> DataFrame:
    return spark.createDataFrame([("R", 0), ("A", 5)], "name string, category_id int")


@query("category_update", f"{_ANN} SELECT ann_id, image_id, CASE category_id WHEN 2 THEN 0 ELSE 5 END AS category_id FROM v_annotations WHERE category_id IN (0, 2)")
def category_update(spark, d):
    return D.update_categories(dataset(spark, d), _desired(spark)).annotations.select("ann_id", "image_id", "category_id")


@query("category_filter_by_name", f"{_ANN} SELECT category_id, count(*) AS n FROM v_annotations WHERE category_id = 0 GROUP BY 1")
def category_filter_by_name(spark, d):
    ds = D.update_categories(dataset(spark, d), spark.createDataFrame([("A", 0)], "name string, category_id int"))
    return ds.annotations.groupBy("category_id").agg(F.count("*").alias("n"))


def _other(spark, d) -> D.Dataset:
    """A second dataset: the same images and annotations under categories of its own, one of them new."""
    a = dataset(spark, d)
    cats = spark.createDataFrame([(0, "R", "returned"), (1, "X", "new"), (2, "A", "kept")], "category_id int, name string, supercategory string")
    return D.Dataset(a.images, cats, a.annotations)


@query("dataset_merge", "SELECT * FROM (VALUES (0, 'A'), (1, 'N'), (2, 'R'), (3, 'X')) AS t(category_id, name)")
def dataset_merge(spark, d):
    return D.merge_categories(dataset(spark, d).categories, _other(spark, d).categories)


@query(
    "dataset_merge_ids",
    f"{_DS}, t AS (SELECT (SELECT max(image_id) + 1 FROM v_images) AS di, (SELECT max(ann_id) + 1 FROM v_annotations) AS da) SELECT ann_id, image_id, category_id FROM v_annotations UNION ALL SELECT ann_id + da, image_id + di, CASE category_id WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END FROM v_annotations, t",
)
def dataset_merge_ids(spark, d):
    return D.merge_datasets(dataset(spark, d), _other(spark, d)).annotations.select("ann_id", "image_id", "category_id")


@query("dataset_merge_list", f"{_DS}, t AS (SELECT max(image_id) + 1 AS m FROM v_images), s AS (SELECT image_id FROM v_images UNION ALL SELECT image_id + m FROM v_images, t), t2 AS (SELECT max(image_id) + 1 AS m FROM s) SELECT image_id FROM s UNION ALL SELECT image_id + m FROM v_images, t2")
def dataset_merge_list(spark, d):
    o = _other(spark, d)
    return D.merge_datasets(D.merge_datasets(dataset(spark, d), o), o).images.select("image_id")


@query("split_hashed", f"{ctes('v_images')} SELECT image_id, CASE WHEN ('0x' || substr(md5(image_id || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.9 THEN 'train' ELSE 'val' END AS part FROM v_images")
def split_hashed(spark, d):
    return D.split_hashed(view(spark, d, "v_images"))


@query("split_train_val", f"{ctes('v_images')}, n AS (SELECT count(*) AS n FROM v_images) SELECT 'train' AS part, floor(n * 0.9)::BIGINT AS n FROM n UNION ALL SELECT 'val', n - floor(n * 0.9)::BIGINT FROM n")
def split_train_val(spark, d):
    return D.split_exact(view(spark, d, "v_images")).groupBy("part").agg(F.count("*").alias("n"))


_EVERY = "SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY ord) AS rn FROM {0}) WHERE (rn - 1) % 3 = 0"


@query("subsample", f"{ctes('v_images')} {_EVERY.format('v_images')}")
def subsample(spark, d):
    return D.subsample(dataset(spark, d), 3).images.select("image_id")


def _sub_cat(has: str) -> str:
    return f"{_DS}, h AS (SELECT * FROM v_images WHERE image_id {has}) SELECT image_id FROM v_images WHERE image_id NOT IN (SELECT image_id FROM h) UNION ALL ({_EVERY.format('h')})"


@query("subsample_category", _sub_cat("IN (SELECT image_id FROM v_annotations WHERE category_id = 0)"))
def subsample_category(spark, d):
    return D.subsample(dataset(spark, d), 3, 0).images.select("image_id")


@query("subsample_negative", _sub_cat("NOT IN (SELECT image_id FROM v_annotations)"))
def subsample_negative(spark, d):
    return D.subsample(dataset(spark, d), 3, -1).images.select("image_id")


@query("upsample", f"{ctes('v_images')} SELECT image_id, unnest(range(0, 3))::INT AS copy_no FROM v_images")
def upsample(spark, d):
    return D.upsample(dataset(spark, d), 3)


@query("upsample_category", f"{_DS} SELECT image_id, 0 AS copy_no FROM v_images UNION ALL SELECT image_id, unnest([1, 2]) FROM (SELECT DISTINCT image_id FROM v_annotations WHERE category_id = 2)")
def upsample_category(spark, d):
    return D.upsample(dataset(spark, d), 3, 2)


@query("area_filter", f"{_DS} SELECT image_id FROM v_images WHERE image_id NOT IN (SELECT image_id FROM v_annotations WHERE floor(w * h) < 1000 OR floor(w * h) > 100000)")
def area_filter(spark, d):
    return D.area_filter(dataset(spark, d), 1000, 100000).select("image_id")


@query("area_filter_by_category", f"{_DS} SELECT image_id FROM v_images WHERE image_id NOT IN (SELECT image_id FROM v_annotations WHERE floor(w * h) > 200000 OR (category_id = 0 AND (floor(w * h) < 500 OR floor(w * h) > 50000)))")
def area_filter_by_category(spark, d):
    iv = spark.createDataFrame([(0, 500, 50000)], "category_id int, lo long, hi long")
    return D.area_filter(dataset(spark, d), 0, 200000, iv).select("image_id")


@query("clip_boxes", f"{_ANNI}, {_BOXED} SELECT ann_id, image_id, category_id, floor(greatest(x1, 0))::INT AS x, floor(greatest(y1, 0))::INT AS y, (floor(least(x2, width)) - floor(greatest(x1, 0)))::INT AS w, (floor(least(y2, height)) - floor(greatest(y1, 0)))::INT AS h FROM b WHERE x1 < width AND x2 > 0 AND y1 < height AND y2 > 0")
def clip_boxes(spark, d):
    return D.clip_boxes(dataset(spark, d))


@query(
    "dataset_stats",
    f"{_DS}, p AS (SELECT image_id, count(*) AS n FROM v_annotations GROUP BY 1) SELECT (SELECT count(*) FROM v_images) AS num_images, (SELECT count(*) FROM v_images WHERE image_id NOT IN (SELECT image_id FROM p)) AS num_negative_images, (SELECT min(n) FROM p) AS min_annotations_per_image, (SELECT max(n) FROM p) AS max_annotations_per_image, (SELECT round(avg(n), 6) FROM p) AS avg_annotations_per_image, "
    "count(*) AS num_annotations, min(floor(w * h))::BIGINT AS min_annotation_area, max(floor(w * h))::BIGINT AS max_annotation_area, round(avg(floor(w * h)), 6) AS avg_annotation_area, (SELECT count(*) FROM v_categories) AS num_categories FROM v_annotations",
)
def dataset_stats(spark, d):
    return D.stats(dataset(spark, d)).withColumns({c: F.round(c, 6) for c in ("avg_annotations_per_image", "avg_annotation_area")})


@query("dataset_stats_by_category", f"{_DS} SELECT category_id, any_value(name) AS name, count(*) AS num_annotations, count(DISTINCT image_id) AS num_images, min(floor(w * h))::BIGINT AS min_area, max(floor(w * h))::BIGINT AS max_area, round(avg(floor(w * h)), 6) AS avg_area FROM v_annotations JOIN v_categories USING (category_id) GROUP BY 1")
def dataset_stats_by_category(spark, d):
    return D.stats_by_category(dataset(spark, d)).withColumn("avg_area", F.round("avg_area", 6))


_COUNTS = "c AS (SELECT category_id, count(DISTINCT image_id) AS n_images, (SELECT count(DISTINCT image_id) FROM v_annotations) AS total_images FROM v_annotations GROUP BY 1)"


@query("class_counts", f"{_ANN}, {_COUNTS} SELECT * FROM c")
def class_counts(spark, d):
    return D.class_counts(view(spark, d, "v_annotations"))


@query("class_frequencies", f"{_ANN}, {_COUNTS} SELECT category_id, round(n_images / total_images, 9) AS frequency FROM c")
def class_frequencies(spark, d):
    return D.class_counts(view(spark, d, "v_annotations")).select("category_id", F.round(F.col("n_images") / F.col("total_images"), 9).alias("frequency"))


@query("class_counts_add", f"{_ANN}, {_COUNTS}, o AS (SELECT category_id, count(DISTINCT image_id) AS n_images, (SELECT count(DISTINCT image_id) FROM v_annotations WHERE category_id > 0) AS total_images FROM v_annotations WHERE category_id > 0 GROUP BY 1) SELECT category_id, sum(n_images)::BIGINT AS n_images, (SELECT max(total_images) FROM c) + (SELECT max(total_images) FROM o) AS total_images FROM (SELECT * FROM c UNION ALL SELECT * FROM o) GROUP BY 1")
def class_counts_add(spark, d):
    a = view(spark, d, "v_annotations")
    return D.add_counts(D.class_counts(a), D.class_counts(a.filter("category_id > 0")))


@query("remove_invalid", f"{_ANNI}, {_BOXED} SELECT ann_id FROM b WHERE x - 100 >= 0 AND y >= 0 AND x - 100 <= width AND y <= height AND w <= width AND h <= height")
def remove_invalid(spark, d):
    return D.remove_invalid(view(spark, d, "v_annotations").withColumn("x", F.col("x") - 100), view(spark, d, "v_images")).select("ann_id")


_GOOD = "len(bbox) = 4 AND bbox[1] >= 0 AND bbox[2] >= 0 AND bbox[3] >= 0 AND bbox[4] >= 0"


@query("remove_invalid_results", f"SELECT DISTINCT det_id FROM coco_result WHERE {_GOOD}")
def remove_invalid_results(spark, d):
    at = lambda k: F.try_element_at("bbox", F.lit(k))
    r = table(spark, d, "coco_result").filter(F.size("bbox") == 4).select("det_id", "image_id", at(1).alias("x"), at(2).alias("y"), at(3).alias("w"), at(4).alias("h"))
    return D.remove_invalid(r).select("det_id").distinct()


@query("drop_negatives", f"{_DS} SELECT image_id FROM v_images WHERE image_id IN (SELECT image_id FROM v_annotations)")
def drop_negatives(spark, d):
    return D.drop_negatives(dataset(spark, d)).select("image_id")


@query("dedup_images", "SELECT id, arg_min(row_id, row_id) AS row_id, arg_min(coalesce(file_name, ''), row_id) AS file_name FROM terrain_all_coco GROUP BY id")
def dedup_images(spark, d):
    rows = table(spark, d, "terrain_all_coco").select("id", F.coalesce("file_name", F.lit("")).alias("file_name"), "row_id")
    return D.first_of_id(rows, "id", "row_id")


@query("running_ids", f"{ctes('v_images')} SELECT image_id, row_number() OVER (ORDER BY ord) AS new_id FROM v_images")
def running_ids(spark, d):
    return D.running_ids(view(spark, d, "v_images"), ["ord"], "new_id").select("image_id", "new_id")


@query(
    "coco_export",
    f"{_DS}, i AS (SELECT *, row_number() OVER (ORDER BY ord) AS nid FROM v_images WHERE image_id IN (SELECT image_id FROM v_annotations)) SELECT row_number() OVER (ORDER BY ord, ann_id) AS id, nid AS image_id, category_id, [x, y, w, h] AS bbox, floor(w * h)::BIGINT AS area, 0 AS iscrowd FROM v_annotations JOIN i USING (image_id)",
)
def coco_export(spark, d):
    return coco.export_tables(dataset(spark, d), True)[1]


@query("category_mapping", f"{ctes('v_categories')} SELECT category_id, name FROM v_categories")
def category_mapping(spark, d):
    m = view(spark, d, "v_categories").agg(F.map_from_entries(F.collect_list(F.struct("category_id", "name"))).alias("m"))
    return m.select(F.explode("m").alias("category_id", "name"))


@query("annotations_by_image", f"{_ANN} SELECT image_id, list(ann_id ORDER BY ann_id) AS ann_ids FROM v_annotations GROUP BY 1")
def annotations_by_image(spark, d):
    return view(spark, d, "v_annotations").groupBy("image_id").agg(F.array_sort(F.collect_list("ann_id")).alias("ann_ids"))


@query("yolo_labels", f"{_ANNI}, {_BOXED} SELECT ann_id, 'img_' || image_id AS label_name, category_id, (x1 + x2) / 2 / width AS cx, (y1 + y2) / 2 / height AS cy, (x2 - x1) / width AS w, (y2 - y1) / height AS h FROM b")
def yolo_labels(spark, d):
    return yolo.label_lines(dataset(spark, d)).drop("image_id")


@query("base_names", r"SELECT row_id, regexp_replace(CASE WHEN contains(file_name, '%') THEN url_decode(file_name) ELSE file_name END, '^.*[/\\]', '') AS base, lower(regexp_extract(file_name, '\.([^./\\]*)$', 1)) AS extension FROM terrain_all_coco WHERE file_name IS NOT NULL")
def base_names(spark, d):
    f = F.col("file_name")
    return table(spark, d, "terrain_all_coco").filter(f.isNotNull()).select("row_id", file_base(f).alias("base"), F.lower(F.regexp_extract(f, r"\.([^./\\]*)$", 1)).alias("extension"))


@query("video_reid", f"{ctes('v_frames')} SELECT image_id, (row_number() OVER (PARTITION BY video_id ORDER BY ts, image_id) - 1)::INT AS frame_id, dense_rank() OVER (ORDER BY video_id)::BIGINT AS new_video_id FROM v_frames")
def video_reid(spark, d):
    return D.video_ids(view(spark, d, "v_frames").drop("frame_id")).select("image_id", "frame_id", "new_video_id")


@query("instance_offsets", f"{ctes('v_frames')}, v AS (SELECT video_id, image_id, frame_id % 3 AS instance_id FROM v_frames), p AS (SELECT video_id, max(instance_id) + 1 AS n FROM v GROUP BY 1), o AS (SELECT video_id, coalesce(sum(n) OVER (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f FROM p) SELECT image_id, instance_id + f AS instance_id FROM v JOIN o USING (video_id)")
def instance_offsets(spark, d):
    a = view(spark, d, "v_frames").select("video_id", "image_id", (F.col("frame_id") % 3).alias("instance_id"))
    return D.instance_offsets(a).select("image_id", F.col("instance_id").cast("bigint").alias("instance_id"))


_FRAME_ANNS = "fa AS (SELECT image_id * 2 + k AS ann_id, image_id, CASE WHEN image_id % 5 = 0 THEN NULL ELSE (frame_id * 7 + k) % 11 END::BIGINT AS instance_id FROM v_frames CROSS JOIN (VALUES (0), (1)) t(k))"


@query(
    "video_export",
    f"{ctes('v_frames')}, {_FRAME_ANNS}, im AS (SELECT image_id, dense_rank() OVER (ORDER BY video_id) AS video_id, row_number() OVER (PARTITION BY video_id ORDER BY ts, image_id) - 1 AS frame_id, row_number() OVER (ORDER BY video_id, ts, image_id) AS new_image_id FROM v_frames), "
    "a AS (SELECT f.*, i.video_id, i.frame_id, i.new_image_id FROM fa f JOIN im i USING (image_id)), per AS (SELECT video_id, count(DISTINCT instance_id) AS n FROM a GROUP BY 1), off AS (SELECT video_id, 1 + coalesce(sum(n) OVER (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM per) "
    "SELECT DISTINCT row_number() OVER (ORDER BY new_image_id, ann_id) AS id, new_image_id AS image_id, video_id::BIGINT AS video_id, instance_id + o AS instance_id FROM a JOIN off USING (video_id)",
)
def video_export(spark, d):
    f = view(spark, d, "v_frames").drop("frame_id")
    numbered = view(spark, d, "v_frames")
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    a = numbered.select("image_id", "frame_id", k).select((F.col("image_id") * 2 + F.col("k")).alias("ann_id"), "image_id", F.when(F.col("image_id") % 5 != 0, ((F.col("frame_id") * 7 + F.col("k")) % 11).cast("bigint")).alias("instance_id"))
    return D.video_tables(f, a, view(spark, d, "v_categories"))["annotations"].select("id", "image_id", "video_id", "instance_id")


@query("frame_skip", f"{ctes('v_frames')} SELECT video_id, frame_id, image_id FROM v_frames WHERE frame_id % 4 = 3")
def frame_skip(spark, d):
    return media.skip_frames(view(spark, d, "v_frames"), 3).select("video_id", "frame_id", "image_id")


@query("frame_windows", "SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type AS label, count(*) AS n FROM events GROUP BY ALL")
def frame_windows(spark, d):
    return counts_by_window(view(spark, d, "v_frames"))


# --- polygons and masks ------------------------------------------------------------------------------------------------

_POLY = "SELECT DISTINCT ON (id) id, image_id, segmentation FROM coco_annotations WHERE len(segmentation) > 0"


def _polys(spark, d) -> DataFrame:
    a = table(spark, d, "coco_annotations").select("id", "image_id", "segmentation").filter(F.size("segmentation") > 0)
    return a.groupBy("id").agg(F.min_by("segmentation", "id").alias("segmentation"))


@query(
    "poly_area",
    f"WITH p AS ({_POLY}), r AS (SELECT id, unnest(segmentation) AS q FROM p), s AS (SELECT id, q, len(q) AS n FROM r), e AS (SELECT id, q, n, unnest(range(0, n // 2)) AS k FROM s WHERE n >= 6 AND n % 2 = 0), t AS (SELECT id, q, abs(sum(q[2 * k + 1] * q[(2 * k + 3) % n + 1] - q[(2 * k + 2) % n + 1] * q[2 * k + 2])) / 2 AS a FROM e GROUP BY id, q) SELECT id, floor(sum(a))::BIGINT AS area FROM t GROUP BY id",
)
def poly_area(spark, d):
    return _polys(spark, d).select("id", P.area(F.col("segmentation")).alias("area"))


@query("poly_bbox", f"WITH p AS ({_POLY}), e AS (SELECT id, unnest(segmentation) AS q FROM p), f AS (SELECT id, unnest(q) AS v, generate_subscripts(q, 1) AS k FROM e) SELECT id, min(v) FILTER (k % 2 = 1) AS x1, min(v) FILTER (k % 2 = 0) AS y1, max(v) FILTER (k % 2 = 1) AS x2, max(v) FILTER (k % 2 = 0) AS y2 FROM f GROUP BY id")
def poly_bbox(spark, d):
    return _polys(spark, d).select("id", P.bounds(F.col("segmentation")).alias("b")).select("id", "b.*")


@query("poly_shift", f"WITH p AS ({_POLY}) SELECT id, list_transform(segmentation, lambda q: list_transform(q, lambda v, k: CASE WHEN k % 2 = 1 THEN least(v + 10, 2000) ELSE least(v + 20, 1000) END)) AS segmentation FROM p")
def poly_shift(spark, d):
    return _polys(spark, d).select("id", P.shift(F.col("segmentation"), F.lit(10.0), F.lit(20.0), F.lit(2000.0), F.lit(1000.0)).alias("segmentation"))


@query("poly_export", f"WITH p AS ({_POLY}) SELECT id, list_filter(list_transform(segmentation, lambda q: list_transform(q, lambda v: trunc(v)::INT)), lambda q: len(list_distinct(q)) > 2 AND list_max(list_transform(q, lambda v, k: CASE WHEN k % 2 = 1 THEN v END)) > list_min(list_transform(q, lambda v, k: CASE WHEN k % 2 = 1 THEN v END)) AND list_max(list_transform(q, lambda v, k: CASE WHEN k % 2 = 0 THEN v END)) > list_min(list_transform(q, lambda v, k: CASE WHEN k % 2 = 0 THEN v END))) AS segmentation FROM p")
def poly_export(spark, d):
    return _polys(spark, d).select("id", P.to_export(F.col("segmentation"), F.lit(0.0), F.lit(0.0)).alias("segmentation"))


def _cut_sql(r: str, axis: str, limit: str, keep_less: bool) -> str:
    """Points of ring r on one side of a line, as a list."""
    other, op = ("y", "x")[axis == "y"], "<=" if keep_less else ">="
    p, q = f"{r}[CASE WHEN k = 1 THEN len({r}) ELSE k - 1 END]", f"{r}[k]"
    at = f"{p}.{other} + ({limit} - {p}.{axis}) / ({q}.{axis} - {p}.{axis}) * ({q}.{other} - {p}.{other})"
    x, y = (limit, at) if axis == "x" else (at, limit)
    return f"list_filter(flatten(list_transform(range(1, len({r}) + 1), lambda k: [CASE WHEN ({p}.{axis} {op} {limit}) <> ({q}.{axis} {op} {limit}) THEN {{'x': ({x})::DOUBLE, 'y': ({y})::DOUBLE}} END, CASE WHEN {q}.{axis} {op} {limit} THEN {q} END])), lambda z: z IS NOT NULL)"


def _clip_sql(source: str, keys: str, out: str) -> str:
    """CTEs that cut rings (keys, seg, no, r: points; bx1..by2) to their box, leaving {out}(keys, no, r, a: area)."""
    steps, at = [], source
    for n, (axis, limit, less) in enumerate((("x", "bx1", False), ("x", "bx2", True), ("y", "by1", False), ("y", "by2", True))):
        steps.append(f"{out}{n} AS MATERIALIZED (SELECT {keys}, no, bx1, by1, bx2, by2, {_cut_sql('r', axis, limit, less)} AS r FROM {at})")
        at = f"{out}{n}"
    area = "abs(list_sum(list_transform(range(1, len(r) + 1), lambda k: r[k].x * r[CASE WHEN k = len(r) THEN 1 ELSE k + 1 END].y - r[CASE WHEN k = len(r) THEN 1 ELSE k + 1 END].x * r[k].y))) / 2"
    return ", ".join(steps) + f", {out} AS (SELECT {keys}, no, bx1, by1, bx2, by2, r, {area} AS a FROM {at} WHERE len(r) >= 3)"


_RINGS = "generate_subscripts(segmentation, 1) AS no, unnest(segmentation) AS q"
_POINTS = "list_transform(range(0, len(q) // 2), lambda k: {'x': q[2 * k + 1]::DOUBLE, 'y': q[2 * k + 2]::DOUBLE})"


@query(
    "poly_clip",
    f"WITH p AS ({_POLY}), rr AS (SELECT id, {_RINGS} FROM p), f AS (SELECT id, min(q[k]) FILTER (k % 2 = 1) AS x1, min(q[k]) FILTER (k % 2 = 0) AS y1, max(q[k]) FILTER (k % 2 = 1) AS x2, max(q[k]) FILTER (k % 2 = 0) AS y2 FROM (SELECT id, q, unnest(range(1, len(q) + 1)) AS k FROM rr) GROUP BY id), "
    f"s0 AS (SELECT id, no, {_POINTS} AS r, x1::DOUBLE AS bx1, y1::DOUBLE AS by1, ((x1 + x2) / 2)::DOUBLE AS bx2, ((y1 + y2) / 2)::DOUBLE AS by2 FROM rr JOIN f USING (id) WHERE len(q) >= 6 AND len(q) % 2 = 0), {_clip_sql('s0', 'id', 'c')} "
    "SELECT p.id, round(coalesce(sum(a), 0), 4)::DOUBLE AS area FROM p LEFT JOIN c USING (id) GROUP BY p.id",
)
def poly_clip(spark, d):
    """Polygons cut to the left upper quarter of their own bounds, with the area left."""
    p = _polys(spark, d).withColumn("b", P.bounds(F.col("segmentation")))
    c = P.clip_to_box(F.col("segmentation"), F.col("b.x1"), F.col("b.y1"), (F.col("b.x1") + F.col("b.x2")) / 2, (F.col("b.y1") + F.col("b.y2")) / 2)
    return p.select("id", c.alias("s")).select("id", F.round(P.area_exact(F.col("s")), 4).alias("area"))


_SIZED = "v_images AS (SELECT id AS image_id, '' AS file_name, max(height) AS height, max(width) AS width FROM terrain_all_coco WHERE height > 0 AND width > 0 GROUP BY id)"
_DRAWN = f"drawn AS (SELECT DISTINCT ON (id) id AS ann_id, image_id, segmentation FROM coco_annotations WHERE len(segmentation) > 0), rr AS (SELECT ann_id, image_id, {_RINGS} FROM drawn)"
_WHOLE = f"fulls AS (SELECT ann_id, floor(sum(CASE WHEN len(q) >= 6 AND len(q) % 2 = 0 THEN (SELECT abs(list_sum(list_transform(range(1, len(z) + 1), lambda k: z[k].x * z[CASE WHEN k = len(z) THEN 1 ELSE k + 1 END].y - z[CASE WHEN k = len(z) THEN 1 ELSE k + 1 END].x * z[k].y))) / 2 FROM (SELECT {_POINTS} AS z)) ELSE 0 END)) AS full_area FROM rr GROUP BY ann_id)"


def sized_images(spark, d) -> DataFrame:
    t = table(spark, d, "terrain_all_coco").filter("height > 0 and width > 0")
    return t.groupBy(F.col("id").alias("image_id")).agg(F.max("height").alias("height"), F.max("width").alias("width"))


@query(
    "slice_polygons",
    f"WITH {_SIZED}, {_grid(512, 102)}, {_DRAWN}, {_WHOLE}, s0 AS (SELECT rr.image_id, g.tile_idx, rr.ann_id, no, {_POINTS} AS r, g.x1::DOUBLE AS bx1, g.y1::DOUBLE AS by1, g.x2::DOUBLE AS bx2, g.y2::DOUBLE AS by2 FROM rr JOIN grid g USING (image_id) JOIN fulls USING (ann_id) WHERE full_area >= 1 AND len(q) >= 6 AND len(q) % 2 = 0), "
    f"{_clip_sql('s0', 'image_id, tile_idx, ann_id', 'c')}, z AS (SELECT image_id, tile_idx, ann_id, floor(sum(a)) AS area, min(list_min(list_transform(r, lambda p: p.x))) - any_value(bx1) AS x, min(list_min(list_transform(r, lambda p: p.y))) - any_value(by1) AS y, max(list_max(list_transform(r, lambda p: p.x))) - any_value(bx1) AS x2, max(list_max(list_transform(r, lambda p: p.y))) - any_value(by1) AS y2, count(*) AS n_rings FROM c GROUP BY ALL) "
    "SELECT image_id, tile_idx, ann_id, area::BIGINT AS area, round(x, 4) AS x, round(y, 4) AS y, round(x2 - x, 4) AS w, round(y2 - y, 4) AS h, n_rings::INT AS n_rings FROM z JOIN fulls USING (ann_id) WHERE area / full_area >= 0.1::DOUBLE AND area > 0",
)
def slice_polygons(spark, d):
    a = table(spark, d, "coco_annotations").filter(F.size("segmentation") > 0).groupBy(F.col("id").alias("ann_id")).agg(F.min_by(F.struct("image_id", "category_id", "segmentation"), "id").alias("r")).select("ann_id", "r.*")
    s = T.slice_polygons(sized_images(spark, d), a)
    return s.select("image_id", "tile_idx", "ann_id", "area", *[F.round(k, 4).alias(k) for k in ("x", "y", "w", "h")], F.size("segmentation").alias("n_rings"))


_CROSS = "((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x))"


@query(
    "poly_hull",
    f"WITH p0 AS ({_POLY}), rr AS (SELECT id, {_RINGS} FROM p0), pt AS (SELECT DISTINCT id, z.x AS x, z.y AS y FROM (SELECT id, unnest({_POINTS}) AS z FROM rr WHERE len(q) % 2 = 0)), "
    # an edge has all points on its left and, of those on its line, none beyond its ends
    f"e AS (SELECT p.id, p.x * q.y - q.x * p.y AS c FROM pt p JOIN pt q ON p.id = q.id AND (p.x, p.y) <> (q.x, q.y) WHERE NOT EXISTS (SELECT 1 FROM pt r WHERE r.id = p.id AND ({_CROSS} < 0 OR ({_CROSS} = 0 AND ((r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) < 0 OR (r.x - q.x) * (p.x - q.x) + (r.y - q.y) * (p.y - q.y) < 0))))) "
    "SELECT p0.id, round(coalesce(abs(sum(c)) / 2, 0), 4)::DOUBLE AS hull_area FROM p0 LEFT JOIN e ON e.id = p0.id GROUP BY p0.id",
)
def poly_hull(spark, d):
    h = _polys(spark, d).select("id", P.convex_hull("segmentation").alias("hull"))
    return h.select("id", F.round(P.ring_area(F.col("hull")), 4).alias("hull_area"))


_OFF = "(abs((r[b + 1].x - r[a + 1].x) * (r[k + 1].y - r[a + 1].y) - (r[b + 1].y - r[a + 1].y) * (r[k + 1].x - r[a + 1].x)))"
_CHORD = "sqrt((r[b + 1].x - r[a + 1].x) ** 2 + (r[b + 1].y - r[a + 1].y) ** 2)"
_FAR = f"list_transform(range(a + 1, b), lambda k: CASE WHEN {_CHORD} > 0 THEN {_OFF} / {_CHORD} ELSE sqrt((r[k + 1].x - r[a + 1].x) ** 2 + (r[k + 1].y - r[a + 1].y) ** 2) END)"


@query(
    "poly_simplify",
    f"WITH RECURSIVE p0 AS ({_POLY}), rr AS (SELECT id, {_RINGS} FROM p0), ring AS (SELECT id, no, list_append({_POINTS}, {{'x': q[1]::DOUBLE, 'y': q[2]::DOUBLE}}) AS r FROM rr WHERE len(q) >= 6 AND len(q) % 2 = 0), "
    f"seg AS (SELECT id, no, r, 0::BIGINT AS a, (len(r) - 1)::BIGINT AS b FROM ring UNION ALL SELECT id, no, r, unnest([a, a + list_position(f, list_max(f))]), unnest([a + list_position(f, list_max(f)), b]) FROM (SELECT *, {_FAR} AS f FROM seg WHERE b - a >= 2) q WHERE list_max(f) > 1), "
    "kept AS (SELECT id, no, list_transform(list_sort(list_distinct(list(a))), lambda k: [any_value(r)[k + 1].x, any_value(r)[k + 1].y]) AS l FROM seg GROUP BY id, no), "
    "outs AS (SELECT id, list(flatten(l) ORDER BY no) AS s FROM kept GROUP BY id) SELECT p0.id, coalesce(s, []) AS segmentation FROM p0 LEFT JOIN outs USING (id)",
)
def poly_simplify(spark, d):
    return _polys(spark, d).select("id", P.simplify(1.0)("segmentation").alias("segmentation"))


_DRAWN_PIXELS = (
    f"p0 AS ({_POLY}), rr AS (SELECT id, {_RINGS} FROM p0), b AS (SELECT id, min(q[k]) FILTER (k % 2 = 1) AS ox, min(q[k]) FILTER (k % 2 = 0) AS oy FROM (SELECT id, q, unnest(range(1, len(q) + 1)) AS k FROM rr) GROUP BY id), "
    "pts AS (SELECT id, no, len(q) // 2 AS n, unnest(range(0, len(q) // 2)) AS k, q, ox, oy FROM rr JOIN b USING (id) WHERE len(q) >= 6 AND len(q) % 2 = 0), "
    "ed AS (SELECT id, no, k, round_even(q[2 * k + 1] - ox, 0) AS x0, round_even(q[2 * k + 2] - oy, 0) AS y0, round_even(q[2 * ((k + 1) % n) + 1] - ox, 0) AS x1, round_even(q[2 * ((k + 1) % n) + 2] - oy, 0) AS y1 FROM pts), "
    # crossings of the lines through pixel centres, taken in pairs
    "ys AS (SELECT id, no, unnest(range(min(y0)::BIGINT, max(y0)::BIGINT + 1)) AS y FROM ed GROUP BY id, no), "
    "cr AS (SELECT e.id, e.no, y, x0 + (y - y0) * (x1 - x0) / (y1 - y0) AS x FROM ed e JOIN ys ON e.id = ys.id AND e.no = ys.no WHERE (y0 <= y) <> (y1 <= y)), "
    "od AS (SELECT *, row_number() OVER (PARTITION BY id, no, y ORDER BY x) AS rn FROM cr), pr AS (SELECT id, no, y, (rn - 1) // 2 AS pair, min(x) AS a, max(x) AS z FROM od GROUP BY ALL), "
    "inner_ AS (SELECT id, y, unnest(range(ceil(a)::BIGINT, floor(z)::BIGINT + 1)) AS x FROM pr), "
    # the outline, in as many steps as its longer side has
    "ln AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0))::BIGINT AS m FROM ed), st AS (SELECT *, unnest(range(0, m + 1)) AS i FROM ln), "
    "outer_ AS (SELECT id, round_even(CASE WHEN i = m THEN y1 ELSE i * ((y1 - y0) / m) + y0 END, 0)::BIGINT AS y, round_even(CASE WHEN i = m THEN x1 ELSE i * ((x1 - x0) / m) + x0 END, 0)::BIGINT AS x FROM st), "
    "px AS (SELECT id, y, x FROM inner_ UNION SELECT id, y, x FROM outer_)"
)


def _drawn(spark, d) -> DataFrame:
    """Polygons moved to their corner, and filled."""
    p = _polys(spark, d).withColumn("b", P.bounds(F.col("segmentation")))
    local = P.shift(F.col("segmentation"), -F.col("b.x1"), -F.col("b.y1"), F.lit(1e9), F.lit(1e9))
    return p.select("id", P.mask_from_polygons(local, (F.col("b.x2") - F.col("b.x1") + 1).cast("int"), (F.col("b.y2") - F.col("b.y1") + 1).cast("int")).alias("m"))


@query("poly_raster", f"WITH {_DRAWN_PIXELS} SELECT p0.id, count(px.id)::INT AS pixels FROM p0 LEFT JOIN px ON px.id = p0.id GROUP BY p0.id")
def poly_raster(spark, d):
    return _drawn(spark, d).select("id", P.mask_pixels(F.col("m")).alias("pixels"))


@query("poly_outline", f"WITH {_DRAWN_PIXELS} SELECT id, min(x)::INT AS x1, min(y)::INT AS y1, max(x)::INT AS x2, max(y)::INT AS y2 FROM px GROUP BY id HAVING max(x) > min(x) AND max(y) > min(y)")
def poly_outline(spark, d):
    """The bounds of the outlines traced around the filled pixels."""
    o = _drawn(spark, d).select("id", P.polygons_from_mask("m").alias("r")).select("id", P.bounds(F.col("r")).alias("b")).filter("b.x2 > b.x1 and b.y2 > b.y1")
    return o.select("id", "b.*")


def _mask(spark, d) -> DataFrame:
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("embedding", r * 8 + 1, F.lit(8)))
    return table(spark, d, "embeddings").select("vec_id", rows.alias("mask"))


_PIX = "px AS (SELECT vec_id, (k - 1) % 8 AS x, (k - 1) // 8 AS y, v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings))"


_COUNTED = "c AS (SELECT vec_id, list_transform(embedding, lambda v: floor(abs(v) * 10)::BIGINT) AS counts FROM embeddings), ends AS (SELECT vec_id, unnest(generate_series(2, len(counts), 2)) AS k, counts FROM c), runs AS (SELECT vec_id, list_sum(counts[1:k - 1])::BIGINT AS a, list_sum(counts[1:k])::BIGINT AS b FROM ends), set_ AS (SELECT vec_id, unnest(range(a, b)) AS p FROM runs WHERE b > a)"


@query("rle_decode", f"WITH {_COUNTED} SELECT vec_id, count(*) AS pixels, min(p // 8)::INT AS x1, min(p % 8)::INT AS y1, max(p // 8)::INT AS x2, max(p % 8)::INT AS y2 FROM set_ GROUP BY vec_id")
def rle_decode(spark, d):
    """Run-length masks of height 8: pixels and bounds without drawing them."""
    counts = F.transform("embedding", lambda v: F.floor(F.abs(v) * F.lit(10).cast("float")).cast("bigint"))
    m = table(spark, d, "embeddings").select("vec_id", counts.alias("counts"))
    r = m.select("vec_id", X.rle_pixels(F.col("counts")).alias("pixels"), X.rle_bounds(F.col("counts"), F.lit(8)).alias("b")).filter("b is not null")
    return r.select("vec_id", "pixels", "b.*")


@query("centre_boxes", f"{_ANNI}, {_BOXED} SELECT ann_id, round(greatest(0, x1), 6) AS x1, round(greatest(0, y1), 6) AS y1, round(least(x2, width), 6) AS x2, round(least(y2, height), 6) AS y2 FROM b")
def centre_boxes(spark, d):
    """Relative centre boxes, as many detectors give them, back to clamped corners."""
    y = _ann_boxes(spark, d).select("ann_id", "height", "width", *_named(B.voc_to_yolo(B.cols(), F.col("width"), F.col("height")), _YOLO))
    c = X.centre_boxes(*[F.col(k) for k in _YOLO], F.col("width"), F.col("height"))
    return y.select("ann_id", *[F.round(v, 6).alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True)])


@query("mask_threshold", f"WITH {_PIX} SELECT vec_id, count(*) FILTER (v > 0.1::FLOAT)::INT AS pixels FROM px GROUP BY 1")
def mask_threshold(spark, d):
    m = P.threshold(F.transform("mask", lambda r: F.transform(r, lambda v: v.cast("float"))), F.lit(0.1).cast("float"))
    return _mask(spark, d).select("vec_id", P.mask_pixels(m).alias("pixels"))


@query("mask_bbox", f"WITH {_PIX}, b AS (SELECT vec_id, min(x)::INT AS x1, min(y)::INT AS y1, max(x)::INT AS x2, max(y)::INT AS y2 FROM px WHERE v > 0.1::FLOAT GROUP BY 1) SELECT * FROM b WHERE x2 > x1 AND y2 > y1")
def mask_bbox(spark, d):
    m = _mask(spark, d).withColumn("m", P.threshold(F.col("mask"), F.lit(0.1).cast("float")))
    return m.select("vec_id", P.mask_bounds(F.col("m")).alias("b")).filter("b is not null").select("vec_id", "b.*")


@query("mask_min_area", f"WITH {_PIX} SELECT vec_id, count(*)::INT AS pixels FROM px WHERE v > 0.1::FLOAT GROUP BY 1 HAVING count(*) >= 12")
def mask_min_area(spark, d):
    m = _mask(spark, d).select("vec_id", P.mask_pixels(P.threshold(F.col("mask"), F.lit(0.1).cast("float"))).alias("pixels"))
    return m.filter("pixels >= 12")


@query("mask_labels", f"WITH {_PIX} SELECT vec_id, floor(v * 5)::INT AS label, count(*) AS n_pixels, min(x)::INT AS x1, min(y)::INT AS y1, max(x)::INT AS x2, max(y)::INT AS y2 FROM px GROUP BY 1, 2")
def mask_labels(spark, d):
    ids = _mask(spark, d).select("vec_id", F.transform("mask", lambda r: F.transform(r, lambda v: F.floor(v * F.lit(5.0).cast("float")).cast("int"))).alias("ids"))
    return P.label_masks(ids, "ids", "vec_id")


# --- evaluation --------------------------------------------------------------------------------------------------------

_EV = ctes("v_truth", "v_preds")
_MIXED = ctes("v_truth", "v_preds") + ", v_mixed AS (SELECT id, image_id, category_id, CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS iscrowd, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area FROM v_truth)"
_AREA_ROWS = "(VALUES ('all', 0, 1e10), ('s', 0, 1024), ('m', 1024, 9216), ('l', 9216, 1e10)) AS a(area_lbl, lo, hi)"


def _pixel_iou(a: str, b: str) -> str:
    """Overlap of the pixels of two boxes of whole numbers, borders included."""
    inter = f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1) + 1) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1) + 1))"
    size = lambda t: f"(({t}.x2 - {t}.x1 + 1) * ({t}.y2 - {t}.y1 + 1))"
    return f"({inter} / ({size(a)} + {size(b)} - {inter}))"


def _match_sql(truth: str, thresholds: str, out: str, areas: str = _AREA_ROWS, v: str = "") -> str:
    """CTEs of the public matching rule over truth(id, image_id, category_id, iscrowd, area, x1..y2) and v_preds, named after ``out``:
    detections with their near ground truth first, so that the fold runs over those alone."""
    v = v or f"(CASE WHEN g.iscrowd = 1 THEN {_inter('d', 'g')} / {_size('d')} ELSE {_metric('d', 'g')} END)"
    free = "list_filter(q.c, lambda c: c.v >= least(acc.thr, 1 - 1e-10) AND (c.crowd OR NOT list_contains(acc.used, c.g)))"
    best = f"list_reverse_sort(list_transform({free}, lambda c: {{'r': NOT (c.crowd OR c.area < acc.lo OR c.area > acc.hi), 'v': c.v, 'g': c.g}}))[1]"
    return f"""
{out}_near AS (SELECT d.image_id, d.category_id, d.id, any_value(d.score) AS score, any_value({_size('d')}) AS da, list({{'g': g.id, 'v': {v}, 'crowd': g.iscrowd = 1, 'area': g.area}} ORDER BY g.id) AS c
  FROM v_preds d JOIN {truth} g ON g.image_id = d.image_id AND g.category_id = d.category_id WHERE {v} >= (SELECT min(thr) - 1e-9 FROM {thresholds}) GROUP BY ALL),
{out}_each AS (SELECT image_id, category_id, list({{'id': id, 's': score, 'da': da, 'c': c}} ORDER BY score DESC, id) AS l FROM {out}_near GROUP BY ALL),
{out}_start AS (SELECT image_id, category_id, thr, area_lbl, list_concat([{{'q': NULL, 'thr': thr, 'lo': lo, 'hi': hi, 'used': []::BIGINT[], 'res': []::STRUCT(d BIGINT, r BOOLEAN)[]}}],
  list_transform(l, lambda q: {{'q': q, 'thr': thr, 'lo': lo, 'hi': hi, 'used': []::BIGINT[], 'res': []::STRUCT(d BIGINT, r BOOLEAN)[]}})) AS l FROM {out}_each CROSS JOIN {thresholds} CROSS JOIN {areas}),
{out}_hits AS (SELECT category_id, thr, area_lbl, unnest(list_reduce(l, lambda acc, s: {{'q': s.q, 'thr': acc.thr, 'lo': acc.lo, 'hi': acc.hi,
  'used': list_append(acc.used, coalesce({best.replace('q.c', 's.q.c')}.g, -1)), 'res': list_append(acc.res, {{'d': s.q.id, 'r': {best.replace('q.c', 's.q.c')}.r}})}}).res) AS h FROM {out}_start),
{out}_judged AS (SELECT d.category_id, d.id, d.score, t.thr, a.area_lbl, coalesce(h.h.r, FALSE) AS tp, CASE WHEN h.h.r IS NULL THEN {_size('d')} < a.lo OR {_size('d')} > a.hi ELSE NOT h.h.r END AS ign
  FROM v_preds d CROSS JOIN {thresholds} t CROSS JOIN {areas} LEFT JOIN {out}_hits h ON h.category_id = d.category_id AND h.thr = t.thr AND h.area_lbl = a.area_lbl AND h.h.d = d.id)"""


def _curve_sql(truth: str, thresholds: str, out: str, npig_of: str) -> str:
    """Interpolated precision of ``out``'s matches at 101 recalls: {out}_curve, and {out}_tp, the hits of each group."""
    return f"""
{out}_npig AS (SELECT category_id, area_lbl, count(*) AS npig FROM {npig_of} CROSS JOIN {_AREA_ROWS} WHERE iscrowd = 0 AND area >= lo AND area <= hi GROUP BY ALL),
{out}_run AS (SELECT category_id, area_lbl, thr, tp AS hit, sum(tp::INT) OVER w AS tp, count(*) OVER w AS n FROM {out}_judged WHERE NOT ign WINDOW w AS (PARTITION BY category_id, area_lbl, thr ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
{out}_best AS (SELECT category_id, area_lbl, thr, (tp * 100) // npig AS k, max(tp / n) AS p FROM {out}_run JOIN {out}_npig USING (category_id, area_lbl) GROUP BY ALL),
{out}_grid AS (SELECT category_id, area_lbl, thr, r.k AS k FROM {out}_npig CROSS JOIN {thresholds} CROSS JOIN range(0, 101) r(k)),
{out}_curve AS (SELECT g.category_id, g.area_lbl, g.thr AS iou_thr, g.k::INT AS rec_pct, coalesce(max(b.p), 0) AS precision FROM {out}_grid g LEFT JOIN {out}_best b ON b.category_id = g.category_id AND b.area_lbl = g.area_lbl AND b.thr = g.thr AND b.k >= g.k GROUP BY ALL),
{out}_tp AS (SELECT category_id, area_lbl, thr, count(*) FILTER (tp AND NOT ign) AS tp FROM {out}_judged GROUP BY ALL)"""


_THR = "thr AS (SELECT round(0.5 + 0.05 * k, 2)::DOUBLE AS thr, k FROM range(0, 10) t(k))"
_FREE = f"list_filter(gs, lambda g: NOT list_contains(acc.used, g.id) AND {_metric('q.d', 'g')} >= least(thr, 1 - 1e-10))"
_MATCH = f"""{_THR},
ds AS (SELECT image_id, category_id, list({{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 's': score}} ORDER BY score DESC, id) AS ds FROM v_preds GROUP BY ALL),
gs AS (SELECT image_id, category_id, list({{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY id) AS gs FROM v_truth GROUP BY ALL),
j AS (SELECT image_id, category_id, thr, list_concat([{{'id': -1::BIGINT, 'x1': 0.0::DOUBLE, 'y1': 0.0::DOUBLE, 'x2': 0.0::DOUBLE, 'y2': 0.0::DOUBLE, 's': 0.0::DOUBLE}}], ds) AS ds, coalesce(gs, []) AS gs FROM ds LEFT JOIN gs USING (image_id, category_id) CROSS JOIN thr),
mt AS (SELECT category_id, thr, unnest(list_reduce(list_transform(ds, lambda d: {{'d': d, 'used': []::BIGINT[], 'res': []::STRUCT(d BIGINT, s DOUBLE, g BIGINT)[]}}),
  lambda acc, q: {{'d': q.d, 'used': list_append(acc.used, coalesce(list_reverse_sort(list_transform({_FREE}, lambda g: {{'v': {_metric('q.d', 'g')}, 'i': g.id}}))[1].i, -1)),
    'res': list_append(acc.res, {{'d': q.d.id, 's': q.d.s, 'g': coalesce(list_reverse_sort(list_transform({_FREE}, lambda g: {{'v': {_metric('q.d', 'g')}, 'i': g.id}}))[1].i, -1)}})}}).res) AS r FROM j),
m AS (SELECT category_id, thr, r.d AS id, r.s AS score, r.g AS gt_id FROM mt),
npig AS (SELECT category_id, count(*) AS npig FROM v_truth GROUP BY 1)"""
_PR = f"""{_MATCH},
run AS (SELECT category_id, thr, sum((gt_id >= 0)::INT) OVER w AS tp, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY category_id, thr ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT category_id, thr, (tp * 100) // npig AS k, tp / n AS p FROM run JOIN npig USING (category_id)),
best AS (SELECT category_id, thr, k, max(p) AS p FROM pt GROUP BY ALL),
grid AS (SELECT category_id, thr, r.k AS k FROM npig CROSS JOIN thr CROSS JOIN range(0, 101) r(k)),
curve AS (SELECT g.category_id, g.thr AS iou_thr, g.k::INT AS rec_pct, coalesce(max(b.p), 0) AS precision FROM grid g LEFT JOIN best b ON b.category_id = g.category_id AND b.thr = g.thr AND b.k >= g.k GROUP BY ALL)"""


def _eval(spark, d, truth: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches and counts are written once, since curves and recalls both read them."""
    truth = view(spark, d, "v_truth") if truth is None else truth
    scratch = Scratch(spark, "eval")
    return scratch.write(E.matches(view(spark, d, "v_preds"), truth)), scratch.write(E.truth_counts(truth))


def _mixed(spark, d) -> DataFrame:
    """Ground truth of which a part is crowds."""
    return view(spark, d, "v_truth").withColumn("iscrowd", F.when(F.col("id") % 17 == 0, 1).otherwise(0))


@query("eval_matches", f"{_EV}, {_MATCH} SELECT id, thr AS iou_thr, gt_id FROM m")
def eval_matches(spark, d):
    m = _eval(spark, d)[0].filter("area_lbl = 'all'").select("id", F.posexplode("gt_id").alias("k", "gt_id"))
    return m.select("id", F.element_at(F.array(*[F.lit(t) for t in E.IOU_THRESHOLDS]), F.col("k") + 1).alias("iou_thr"), "gt_id")


@query("eval_pr_curve", f"{_EV}, {_PR} SELECT category_id, iou_thr, rec_pct, round(precision, 9) AS precision FROM curve")
def eval_pr_curve(spark, d):
    m, n = _eval(spark, d)
    return E.pr_curve(m, n).filter("area_lbl = 'all'").select("category_id", "iou_thr", "rec_pct", F.round("precision", 9).alias("precision"))


@query("eval_map", f"{_EV}, {_PR}, ap AS (SELECT category_id, iou_thr, avg(precision) AS v FROM curve GROUP BY ALL) SELECT 'mAP' AS metric, round(avg(v), 6) AS value FROM ap UNION ALL SELECT 'mAP75', round(avg(v), 6) FROM ap WHERE iou_thr = 0.75 UNION ALL SELECT 'mAP50', round(avg(v), 6) FROM ap WHERE iou_thr = 0.5")
def eval_map(spark, d):
    m, n = _eval(spark, d)
    return E.summary(E.pr_curve(m, n), E.max_recall(m, n)).filter("metric in ('mAP', 'mAP50', 'mAP75')")


_ALL_OF = f"{_MIXED}, {_THR}, {_match_sql('v_mixed', 'thr', 'x')}, {_curve_sql('v_mixed', 'thr', 'x', 'v_mixed')}"
_AP = "ap AS (SELECT category_id, area_lbl, iou_thr, avg(precision) AS v FROM x_curve GROUP BY ALL)"
_AR = "ar AS (SELECT n.area_lbl, coalesce(t.tp, 0) / npig AS v FROM x_npig n CROSS JOIN thr LEFT JOIN x_tp t ON t.category_id = n.category_id AND t.area_lbl = n.area_lbl AND t.thr = thr.thr)"
_FIGURE = "SELECT '{0}' AS metric, coalesce(round(avg(v), 6), -1) AS value FROM {1} WHERE {2}"
_FIGURES = [("mAP", "ap", "area_lbl = 'all'"), ("mAP75", "ap", "area_lbl = 'all' AND iou_thr = 0.75"), ("mAP50", "ap", "area_lbl = 'all' AND iou_thr = 0.5")]
_FIGURES += [x for s in "sml" for x in ((f"mAP_{s}", "ap", f"area_lbl = '{s}'"), (f"mAP50_{s}", "ap", f"area_lbl = '{s}' AND iou_thr = 0.5"), (f"AR_{s}", "ar", f"area_lbl = '{s}'"))]


@query("eval_summary", f"{_ALL_OF}, {_AP}, {_AR} {' UNION ALL '.join(_FIGURE.format(*x) for x in _FIGURES)}")
def eval_summary(spark, d):
    """All twelve figures, with crowds in the ground truth."""
    m, n = _eval(spark, d, _mixed(spark, d))
    return E.summary(E.pr_curve(m, n), E.max_recall(m, n))


@query("eval_areas_and_crowds", f"{_ALL_OF} SELECT category_id, area_lbl, iou_thr, rec_pct, round(precision, 9) AS precision FROM x_curve")
def eval_areas_and_crowds(spark, d):
    m, n = _eval(spark, d, _mixed(spark, d))
    return E.pr_curve(m, n).withColumn("precision", F.round("precision", 9))


_PLAIN = "v_full AS (SELECT id, image_id, category_id, iscrowd, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area FROM v_truth)"


@query("eval_masks", f"{_EV}, {_PLAIN}, {_THR}, {_match_sql('v_full', 'thr', 'x', _AREA_ROWS, _pixel_iou('d', 'g'))} SELECT category_id, area_lbl, thr AS iou_thr, count(*) FILTER (tp AND NOT ign) AS n_hits, count(*) FILTER (NOT ign) AS n_counted FROM x_judged GROUP BY ALL")
def eval_masks(spark, d):
    """Boxes drawn as polygons and compared pixel by pixel: hits and counted detections at each threshold."""
    ring = F.array(P.box_ring(*B.cols()))
    m = E.matches(view(spark, d, "v_preds").withColumn("segmentation", ring), view(spark, d, "v_truth").withColumn("segmentation", ring), masks=True)
    bit = lambda c, k: F.getbit(F.col(c), F.lit(k)).cast("bigint")
    n = range(len(E.IOU_THRESHOLDS))
    sums = m.groupBy("category_id", "area_lbl").agg(*[F.sum(bit("tp", k) * (1 - bit("ignored", k))).alias(f"t{k}") for k in n], *[F.sum(1 - bit("ignored", k)).alias(f"n{k}") for k in n])
    each = F.explode(F.array(*[F.struct(F.lit(E.IOU_THRESHOLDS[k]).alias("iou_thr"), F.col(f"t{k}").alias("n_hits"), F.col(f"n{k}").alias("n_counted")) for k in n])).alias("z")
    return sums.select("category_id", "area_lbl", each).select("category_id", "area_lbl", "z.iou_thr", "z.n_hits", "z.n_counted")


_CLASS_FIGURES = ", ".join(f"round(avg(precision) FILTER ({c}), 6) AS \"{n}\"" for n, c in [("mAP", "area_lbl = 'all'"), ("mAP50", "area_lbl = 'all' AND iou_thr = 0.5"), ("mAP75", "area_lbl = 'all' AND iou_thr = 0.75"), *[(f"mAP_{s}", f"area_lbl = '{s}'") for s in "sml"], *[(f"mAP50_{s}", f"area_lbl = '{s}' AND iou_thr = 0.5") for s in "sml"]])


@query("eval_classwise", f"{_ALL_OF} SELECT category_id, {_CLASS_FIGURES} FROM x_curve GROUP BY category_id")
def eval_classwise(spark, d):
    m, n = _eval(spark, d, _mixed(spark, d))
    return E.classwise(E.pr_curve(m, n))


@query("eval_recall", f"{_EV}, {_MATCH} SELECT category_id, thr AS iou_thr, round(count(*) FILTER (gt_id >= 0) / any_value(npig), 9) AS recall FROM m JOIN npig USING (category_id) GROUP BY ALL")
def eval_recall(spark, d):
    m, n = _eval(spark, d)
    return E.max_recall(m, n).filter("area_lbl = 'all'").select("category_id", "iou_thr", F.round("recall", 9).alias("recall"))


@query("eval_area_ranges", f"{ctes('v_truth')}, a AS (SELECT category_id, (x2 - x1) * (y2 - y1) AS a FROM v_truth) SELECT category_id, l AS area_lbl, count(*) AS npig FROM a JOIN (VALUES ('all', 0, 1e10), ('s', 0, 1024), ('m', 1024, 9216), ('l', 9216, 1e10)) AS r(l, lo, hi) ON a >= lo AND a <= hi GROUP BY ALL")
def eval_area_ranges(spark, d):
    return E.truth_counts(view(spark, d, "v_truth"))


def _layers_sql() -> str:
    """C75, C50 and Loc by their thresholds; Sim and Oth with ground truth of other classes as crowds of the asked class."""
    truth = "v_full AS (SELECT id, image_id, category_id, iscrowd, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area FROM v_truth)"
    asked = "asked AS (SELECT DISTINCT image_id, p.category_id AS as_category, c.supercategory AS as_super FROM v_preds p JOIN v_categories c USING (category_id))"
    extra = "SELECT t.id, t.image_id, a.as_category AS category_id, 1 AS iscrowd, t.x1, t.y1, t.x2, t.y2, t.area FROM v_full t JOIN v_categories c USING (category_id) JOIN asked a ON a.image_id = t.image_id AND a.as_category <> t.category_id"
    sets = f"v_sim AS (SELECT * FROM v_full UNION ALL {extra} WHERE a.as_super = c.supercategory), v_oth AS (SELECT * FROM v_full UNION ALL {extra})"
    parts = [_match_sql("v_full", "t3", "c") + "," + _curve_sql("v_full", "t3", "c", "v_full")]
    parts += [_match_sql(f"v_{x}", "t1", x) + "," + _curve_sql(f"v_{x}", "t1", x, "v_full") for x in ("sim", "oth")]
    named = "SELECT category_id, CASE WHEN iou_thr = 0.75 THEN 'C75' WHEN iou_thr = 0.5 THEN 'C50' ELSE 'Loc' END AS layer, area_lbl, avg(precision) AS p FROM c_curve GROUP BY ALL"
    named += "".join(f" UNION ALL SELECT category_id, '{x.title()}', area_lbl, avg(precision) FROM {x}_curve GROUP BY ALL" for x in ("sim", "oth"))
    return (
        f"{ctes('v_truth', 'v_preds', 'v_categories')}, {truth}, {asked}, {sets}, t3 AS (SELECT unnest([0.75, 0.5, 0.1])::DOUBLE AS thr), t1 AS (SELECT 0.1::DOUBLE AS thr), {', '.join(parts)}, layers AS ({named}) "
        "SELECT category_id, layer, area_lbl, round(p, 6) AS precision FROM layers UNION ALL SELECT category_id, 'BG', area_lbl, CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END::DOUBLE FROM layers WHERE layer = 'Oth' UNION ALL SELECT category_id, 'FN', area_lbl, 1.0::DOUBLE FROM layers WHERE layer = 'Oth'"
    )


@query("error_layers", _layers_sql())
def error_layers(spark, d):
    e = E.error_layers(view(spark, d, "v_preds"), view(spark, d, "v_truth"), view(spark, d, "v_categories"))
    return e.withColumn("precision", F.round("precision", 6))


@query("gt_area_groups", f"{ctes('v_truth')}, a AS (SELECT (x2 - x1) * (y2 - y1) AS a FROM v_truth) SELECT l AS area_lbl, count(*) AS n FROM a JOIN (VALUES ('all', 0, 1e10), ('s', 0, 1024), ('m', 1024, 9216), ('l', 9216, 1e10)) AS r(l, lo, hi) ON a >= lo AND a <= hi GROUP BY 1")
def gt_area_groups(spark, d):
    return E.truth_counts(view(spark, d, "v_truth")).groupBy("area_lbl").agg(F.sum("npig").alias("n"))


@query("gt_area_histogram", f"{ctes('v_truth')}, s AS (SELECT sqrt((x2 - x1) * (y2 - y1)) AS s FROM v_truth), r AS (SELECT min(s) AS lo, max(s) AS hi FROM s) SELECT least(99, floor((s - lo) * 100 / (hi - lo)))::INT AS bin, count(*) AS n FROM s, r GROUP BY 1")
def gt_area_histogram(spark, d):
    return E.area_histogram(view(spark, d, "v_truth"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQLS)
