"""Overlapping tiles over images, and annotations carried onto them.

The grid is a closed form per axis, so tiles are generated and the tiles of a box are computed, never searched for: carrying
annotations onto tiles needs the image's size beside them and no join with the tiles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import polygons as P

DEFAULT_OVERLAP = 0.2


@dataclass(frozen=True)
class TileSpec:
    """Tile size and overlap ratio, the same for all images; ``auto`` takes both from each image's size instead."""

    height: int = 512
    width: int = 512
    overlap_height: float | None = DEFAULT_OVERLAP
    overlap_width: float | None = DEFAULT_OVERLAP
    auto: bool = False

    def __post_init__(self) -> None:
        for r in (self.overlap_height, self.overlap_width):
            if r is not None and r >= 1:
                raise ValueError("an overlap ratio must be less than 1")
        if not self.auto and min(self.height, self.width) < 1:
            raise ValueError("a tile must have at least one pixel")


def resolution_factor(height: Column, width: Column) -> Column:
    """One less than the smallest power of two that covers the pixel count."""
    return F.length(F.bin(height.cast("bigint") * width - 1)) - F.when(height.cast("bigint") * width == 1, 2).otherwise(1)


def resolution_class(height: Column, width: Column) -> Column:
    f = resolution_factor(height, width)
    return F.when(f <= 18, "low").when(f < 21, "medium").when(f < 24, "high").otherwise("ultra-high")


def orientation(height: Column, width: Column) -> Column:
    return F.when(width < height, "vertical").when(width > height, "horizontal").otherwise("square")


def auto_tiles(images: DataFrame) -> DataFrame:
    """images with resolution, orientation, tile_height, tile_width, step overlaps ov_h and ov_w chosen from the size."""
    h, w = F.col("height"), F.col("width")
    res, ori = resolution_class(h, w), orientation(h, w)
    slide = F.when(F.col("resolution") == "medium", 1).when(F.col("resolution") == "high", 2).otherwise(4)
    ratio = F.when(F.col("resolution") == "medium", 0.8).otherwise(0.4)
    i = images.withColumn("resolution", res).withColumn("orientation", ori).withColumn("slide", slide).withColumn("ratio", ratio)
    i = i.withColumn("n_row", F.when(F.col("orientation") == "horizontal", 2 * F.col("slide")).otherwise(F.col("slide")))
    i = i.withColumn("n_col", F.when(F.col("orientation") == "vertical", 2 * F.col("slide")).otherwise(F.col("slide")))
    low = F.col("resolution") == "low"
    i = i.withColumn("tile_height", F.when(low, h).otherwise(F.expr("height div n_col")).cast("int")).withColumn("tile_width", F.when(low, w).otherwise(F.expr("width div n_row")).cast("int"))
    i = i.withColumn("ov_h", F.when(low, 0).otherwise(F.floor(F.col("tile_height") * F.col("ratio"))).cast("int")).withColumn("ov_w", F.when(low, 0).otherwise(F.floor(F.col("tile_width") * F.col("ratio"))).cast("int"))
    return i.drop("slide", "ratio", "n_row", "n_col")


def with_tile_size(images: DataFrame, spec: TileSpec) -> DataFrame:
    if spec.auto:
        return auto_tiles(images).drop("resolution", "orientation")
    ov = lambda size, r: int(size * (DEFAULT_OVERLAP if r is None else r))
    return images.withColumns({"tile_height": F.lit(spec.height), "tile_width": F.lit(spec.width), "ov_h": F.lit(ov(spec.height, spec.overlap_height)), "ov_w": F.lit(ov(spec.width, spec.overlap_width))})


def axis_count(length: Column, size: Column, overlap: Column) -> Column:
    return (F.greatest(F.ceil((length - size) / (size - overlap)), F.lit(0)) + 1).cast("int")


def axis_end(k: Column, length: Column, size: Column, overlap: Column) -> Column:
    return F.least(length, k * (size - overlap) + size).cast("int")


def axis_start(k: Column, length: Column, size: Column, overlap: Column) -> Column:
    return F.greatest(F.lit(0), axis_end(k, length, size, overlap) - size).cast("int")



def _axis(name: str) -> tuple[Column, Column, Column]:
    return (F.col("width"), F.col("tile_width"), F.col("ov_w")) if name == "x" else (F.col("height"), F.col("tile_height"), F.col("ov_h"))


def tiles(images: DataFrame, spec: TileSpec = TileSpec()) -> DataFrame:
    """images exploded to (…, tile_idx, row_idx, col_idx, x1, y1, x2, y2), row by row; the last row and column are pulled back inside."""
    i = with_tile_size(images, spec).withColumn("nx", axis_count(*_axis("x"))).withColumn("ny", axis_count(*_axis("y")))
    t = i.withColumn("row_idx", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("col_idx", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    t = t.withColumn("tile_idx", (F.col("row_idx") * F.col("nx") + F.col("col_idx")).cast("int"))
    out = {}
    for ax, k in (("x", "col_idx"), ("y", "row_idx")):
        out[f"{ax}1"], out[f"{ax}2"] = axis_start(F.col(k), *_axis(ax)), axis_end(F.col(k), *_axis(ax))
    return t.withColumns(out).drop("nx", "ny", "tile_height", "tile_width", "ov_h", "ov_w")


def tile_name(file_name: Column, suffix: str | None = None) -> Column:
    """stem_x1_y1_x2_y2 with the given suffix, or the source's own where it is lossless, else .png."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[^.]*$", "")
    own = F.lower(F.regexp_extract(file_name, r"(\.[^./]*)$", 1))
    ext = F.lit(suffix) if suffix else F.when(own.isin(".png", ".tif", ".tiff", ".bmp"), own).otherwise(".png")
    return F.concat(F.concat_ws("_", stem, *[F.col(k).cast("string") for k in ("x1", "y1", "x2", "y2")]), ext)


def _hit_tiles(lo: Column, hi: Column, axis: str) -> Column:
    """Numbers of the tiles of an axis that the open interval (lo, hi) overlaps: a stretch of regular ones, and the last."""
    length, size, ov = _axis(axis)
    step, n = size - ov, axis_count(length, size, ov)
    first = F.greatest(F.lit(0), F.least(n - 1, F.floor((lo - size) / step).cast("int")))
    last = F.greatest(F.lit(0), F.least(n - 1, F.ceil(hi / step).cast("int")))
    cand = F.array_distinct(F.concat(F.sequence(first, F.greatest(first, last)), F.array(n - 1)))
    return F.filter(cand, lambda k: (axis_start(k, length, size, ov) < hi) & (axis_end(k, length, size, ov) > lo))


def _on_tiles(images: DataFrame, annotations: DataFrame, spec: TileSpec) -> DataFrame:
    """Annotations with each tile (row, col, tx1..ty2, nx) that their box overlaps. One equi-join with the images' sizes, which
    shuffles: a compressed table tells too little of its rows to be broadcast on its size."""
    i = with_tile_size(images.select("image_id", "height", "width"), spec)
    a = annotations.join(i.hint("merge"), "image_id").withColumn("nx", axis_count(*_axis("x")))
    hit = a.withColumn("col", F.explode(_hit_tiles(F.col("x"), F.col("x") + F.col("w"), "x"))).withColumn("row", F.explode(_hit_tiles(F.col("y"), F.col("y") + F.col("h"), "y")))
    return hit.withColumns({"tx1": axis_start(F.col("col"), *_axis("x")), "tx2": axis_end(F.col("col"), *_axis("x")), "ty1": axis_start(F.col("row"), *_axis("y")), "ty2": axis_end(F.col("row"), *_axis("y"))})


_TILE_IDX = "cast(row * nx + col as int) AS tile_idx"


def slice_annotations(images: DataFrame, annotations: DataFrame, spec: TileSpec = TileSpec(), min_area_ratio: float = 0.1) -> DataFrame:
    """annotations(image_id, ann_id, category_id, x, y, w, h) on the tiles they overlap, clipped and relative to them.

    Columns: image_id, tile_idx, ann_id, category_id, x, y, w, h, area. A part counts if its whole-pixel area is at least
    min_area_ratio of the annotation's; one whose own area is below 1 is dropped. One equi-join with the images' sizes.
    """
    hit = _on_tiles(images, annotations.select("image_id", "ann_id", "category_id", "x", "y", "w", "h"), spec)
    cut = hit.withColumns({"cx1": F.greatest("x", "tx1"), "cy1": F.greatest("y", "ty1"), "cx2": F.least(F.col("x") + F.col("w"), F.col("tx2")), "cy2": F.least(F.col("y") + F.col("h"), F.col("ty2"))})
    cut = cut.withColumn("area", F.floor((F.col("cx2") - F.col("cx1")) * (F.col("cy2") - F.col("cy1")))).withColumn("full", F.floor(F.col("w") * F.col("h")))
    kept = cut.filter((F.col("full") >= 1) & (F.col("area") / F.col("full") >= F.lit(float(min_area_ratio))))
    return kept.select(
        "image_id", F.expr(_TILE_IDX), "ann_id", "category_id",
        (F.col("cx1") - F.col("tx1")).cast("double").alias("x"), (F.col("cy1") - F.col("ty1")).cast("double").alias("y"),
        (F.col("cx2") - F.col("cx1")).cast("double").alias("w"), (F.col("cy2") - F.col("cy1")).cast("double").alias("h"), F.col("area").cast("bigint").alias("area"),
    )


def slice_polygons(images: DataFrame, annotations: DataFrame, spec: TileSpec = TileSpec(), min_area_ratio: float = 0.1) -> DataFrame:
    """annotations(image_id, ann_id, category_id, segmentation) on the tiles they overlap: polygons clipped to the tile and relative
    to it, box and area derived from what is left of them.

    Columns: image_id, tile_idx, ann_id, category_id, segmentation, x, y, w, h, area. A part counts if its whole-pixel area is
    at least min_area_ratio of the annotation's, whose own must be at least 1; annotations without polygons have no rows.
    """
    seg = F.col("segmentation")
    a = annotations.select("image_id", "ann_id", "category_id", seg.cast("array<array<double>>").alias("segmentation")).withColumn("b", P.bounds(F.col("segmentation"))).filter("b is not null")
    a = a.withColumns({"x": F.col("b.x1"), "y": F.col("b.y1"), "w": F.col("b.x2") - F.col("b.x1"), "h": F.col("b.y2") - F.col("b.y1"), "full": P.area(seg)}).drop("b").filter("full >= 1")
    hit = _on_tiles(images, a, spec).drop("x", "y", "w", "h")
    box = [F.col(k).cast("double") for k in ("tx1", "ty1", "tx2", "ty2")]
    cut = hit.withColumn("segmentation", P.clip_to_box(seg, *box)).withColumn("area", P.area(seg)).filter(F.col("area") / F.col("full") >= F.lit(float(min_area_ratio)))
    moved = F.transform(seg, lambda p: F.transform(p, lambda v, i: F.when(i % 2 == 0, v - box[0]).otherwise(v - box[1])))
    cut = cut.withColumn("segmentation", moved).withColumn("b", P.bounds(seg)).filter("b is not null")
    return cut.select("image_id", F.expr(_TILE_IDX), "ann_id", "category_id", "segmentation", F.col("b.x1").alias("x"), F.col("b.y1").alias("y"), (F.col("b.x2") - F.col("b.x1")).alias("w"), (F.col("b.y2") - F.col("b.y1")).alias("h"), "area")


def slice_dataset(images: DataFrame, annotations: DataFrame, spec: TileSpec = TileSpec(), min_area_ratio: float = 0.1, ignore_negatives: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sliced dataset: (tile images with their new sizes and names, annotations on them); empty tiles go if asked. Annotations
    with a ``segmentation`` keep it, clipped; those without polygons among them are sliced by their box."""
    t = tiles(images.select("image_id", "file_name", "height", "width"), spec)
    t = t.select("image_id", "tile_idx", tile_name(F.col("file_name")).alias("file_name"), (F.col("y2") - F.col("y1")).alias("height"), (F.col("x2") - F.col("x1")).alias("width"))
    if "segmentation" in annotations.columns:
        drawn = F.coalesce(F.size("segmentation"), F.lit(0)) > 0
        boxes = slice_annotations(images, annotations.filter(~drawn), spec, min_area_ratio).withColumn("segmentation", F.lit(None).cast("array<array<double>>"))
        a = slice_polygons(images, annotations.filter(drawn), spec, min_area_ratio).unionByName(boxes)
    else:
        a = slice_annotations(images, annotations, spec, min_area_ratio)
    if ignore_negatives:
        t = t.join(a, ["image_id", "tile_idx"], "left_semi")
    return t, a


def _moved(p: DataFrame) -> DataFrame:
    return p.withColumns({"x1": F.col("x1") + F.col("dx"), "x2": F.col("x2") + F.col("dx"), "y1": F.col("y1") + F.col("dy"), "y2": F.col("y2") + F.col("dy")}).drop("dx", "dy")


def to_full_image(preds: DataFrame, tile_table: DataFrame) -> DataFrame:
    """Tile-relative boxes carried back by their tile's corner. Tiles are often made by exploding images, which the planner
    takes for as small as the images, so they are never broadcast."""
    corner = tile_table.select("image_id", "tile_idx", F.col("x1").alias("dx"), F.col("y1").alias("dy"))
    return _moved(preds.join(corner.hint("merge"), ["image_id", "tile_idx"]))


def to_images(preds: DataFrame, images: DataFrame, spec: TileSpec = TileSpec()) -> DataFrame:
    """``to_full_image`` for the tiles of a spec: their corners are computed from the images' sizes, no tile is made."""
    i = with_tile_size(images.select("image_id", "height", "width"), spec).withColumns({"__nx": axis_count(*_axis("x")), "__ny": axis_count(*_axis("y"))})
    p = preds.join(i.hint("merge"), "image_id").filter((F.col("tile_idx") >= 0) & (F.col("tile_idx") < F.col("__nx") * F.col("__ny")))
    p = p.withColumns({"dx": axis_start(F.col("tile_idx") % F.col("__nx"), *_axis("x")), "dy": axis_start(F.expr("tile_idx div __nx"), *_axis("y"))})
    return _moved(p.select(*preds.columns, "dx", "dy"))
