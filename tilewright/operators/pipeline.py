"""Sliced prediction: tiles, a detector per worker, boxes back on the image, filters, merging."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators import tiling
from tilewright.operators.merge import Merging, low_confidence_rewrite, merged
from tilewright.session import Scratch, ship_package

_SCHEMA = pa.schema([("image_id", pa.int64()), ("tile_idx", pa.int32()), ("category_id", pa.int32()), ("category_name", pa.string()), ("score", pa.float64()), *[(k, pa.float64()) for k in ("x1", "y1", "x2", "y2")]])


class Detector(Protocol):
    """A model: built once in each Python worker, called with batches of tile rows (dicts), gives rows of predictions relative to the tile.

    One that also has ``predict_arrays`` is called with the columns of many tiles instead, as arrays without nulls, and gives the position of each
    prediction's tile and the columns category_id, category_name (array or Arrow), score, x1, y1, x2 and y2."""

    def predict(self, batch: list[dict]) -> list[dict]: ...


@dataclass
class GridDetector:
    """Deterministic stand-in: in every tile one box per ``step`` pixels of its diagonal, scored by position."""

    step: int = 128
    side: int = 64
    names: tuple[str, ...] = ("a", "b", "c")

    def predict(self, batch: list[dict]) -> list[dict]:
        out = []
        for t in batch:
            w, h = t["x2"] - t["x1"], t["y2"] - t["y1"]
            for k in range(0, max(1, min(w, h) - self.side), self.step):
                c = (t["image_id"] + k // self.step) % len(self.names)
                out.append({"image_id": t["image_id"], "tile_idx": t["tile_idx"], "category_id": c, "category_name": self.names[c], "score": ((t["image_id"] * 31 + t["tile_idx"] * 17 + k) % 1000) / 1000.0, "x1": float(k), "y1": float(k), "x2": float(min(w, k + self.side)), "y2": float(min(h, k + self.side))})
        return out

    def predict_arrays(self, t: dict[str, np.ndarray]) -> tuple[np.ndarray, dict]:
        w, h = t["x2"].astype(np.int64) - t["x1"], t["y2"].astype(np.int64) - t["y1"]
        n = -(-np.maximum(1, np.minimum(w, h) - self.side) // self.step)
        rows = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        k, image, tile = nth * self.step, t["image_id"].astype(np.int64)[rows], t["tile_idx"].astype(np.int64)[rows]
        c = (image % len(self.names) + nth) % len(self.names)
        at = k.astype(np.float64)
        return rows, {"category_id": c, "category_name": pa.DictionaryArray.from_arrays(pa.array(c, pa.int32()), pa.array(self.names, pa.string())), "score": (image % 1000 * 31 + tile % 1000 * 17 + k) % 1000 / 1000.0, "x1": at, "y1": at, "x2": np.minimum(w[rows], k + self.side).astype(np.float64), "y2": np.minimum(h[rows], k + self.side).astype(np.float64)}


#: Registry of model types; users add their own factories.
DETECTORS: dict[str, Callable[..., Detector]] = {"grid": GridDetector}


def register_detector(name: str, factory: Callable[..., Detector]) -> None:
    DETECTORS[name] = factory


def _predicted(model: Detector, b: pa.RecordBatch, batch_size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Table]]:
    """(tiles, position of each prediction's tile among them, predictions) for a batch of tiles."""
    if hasattr(model, "predict_arrays") and not any(c.null_count for c in b.columns):
        rows, found = model.predict_arrays({n: c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns, strict=True)})
        cols = {k: b.column(k).take(pa.array(rows)) for k in ("image_id", "tile_idx")} | found
        yield b, rows, pa.table([v.cast(f.type) if isinstance(v := cols[f.name], pa.Array) else pa.array(v, f.type) for f in _SCHEMA], schema=_SCHEMA)
        return
    for at in range(0, b.num_rows, batch_size):
        part = b.slice(at, batch_size)
        tiles = part.to_pylist()
        found = model.predict(tiles)
        where = {(t["image_id"], t["tile_idx"]): n for n, t in enumerate(tiles)}
        yield part, np.array([where[p["image_id"], p["tile_idx"]] for p in found], np.int64), pa.Table.from_pylist(found, schema=_SCHEMA)


def detect(tile_table: DataFrame, make: Callable[[], Detector], batch_size: int = 64, shifted: bool = False, confidence: float | None = None, named: bool = True, clamped: bool = False) -> DataFrame:
    """Predictions of every tile, by Arrow batches; the model is made once per task. ``shifted``: already moved by their tile's
    corner, so that nothing has to be joined back; streams can be detected on, too. ``confidence``: those that score less are
    left out before they leave the worker. ``named`` False leaves out category_name. ``clamped``: cut to the image, whose size the
    tiles have as ih and iw, without those that are empty then."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    ship_package(tile_table.sparkSession)
    out = [f for f in _SCHEMA if named or f.name != "category_name"]
    sql = {"int64": "bigint", "int32": "int", "double": "double", "string": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            for tiles, rows, found in _predicted(model, b, batch_size):
                if confidence is not None:
                    # as in SQL: a score that is no number is above all, one that is null is not
                    on = pc.fill_null(pc.or_(pc.greater_equal(found.column("score"), confidence), pc.is_nan(found.column("score"))), False)
                    found, rows = found.filter(on), rows[np.asarray(on)]
                if shifted:
                    for k in ("x1", "y1", "x2", "y2"):
                        by = pc.cast(tiles.column(f"{k[0]}1"), pa.float64()).take(pa.array(rows))
                        found = found.set_column(found.schema.get_field_index(k), k, pc.add(found.column(k), by))
                if clamped:
                    x1, y1, x2, y2 = (found.column(k).to_numpy() for k in ("x1", "y1", "x2", "y2"))
                    iw, ih = (tiles.column(k).to_numpy(zero_copy_only=False)[rows] for k in ("iw", "ih"))
                    cut = {"x1": np.maximum(x1, 0.0), "y1": np.maximum(y1, 0.0), "x2": np.fmin(x2, iw), "y2": np.fmin(y2, ih)}
                    for k, v in cut.items():
                        found = found.set_column(found.schema.get_field_index(k), k, pa.array(v, pa.float64()))
                    found = found.filter(pa.array((cut["x2"] > cut["x1"]) & (cut["y2"] > cut["y1"])))
                yield from found.select([f.name for f in out]).to_batches()

    return tile_table.mapInArrow(run, ", ".join(f"{f.name} {sql[str(f.type)]}" for f in out))


def exclude(preds: DataFrame, names: list[str] | None = None, ids: list[int] | None = None) -> DataFrame:
    """Without predictions of the named categories or category ids."""
    if names:
        preds = preds.filter(~F.coalesce(F.col("category_name").isin(names), F.lit(False)))
    if ids:
        preds = preds.filter(~F.coalesce(F.col("category_id").isin(ids), F.lit(False)))
    return preds


def remap_categories(preds: DataFrame, mapping: dict[str, int]) -> DataFrame:
    """Category ids replaced through a map keyed by the id as text; unmapped ids stay."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(str(k)), F.lit(int(v)))])
    return preds.withColumn("category_id", F.coalesce(m[F.col("category_id").cast("string")], F.col("category_id")).cast("int"))


def spread(images: DataFrame) -> DataFrame:
    """(image_id, height, width) dealt out to all tasks: what is detected on an image is far more than its bytes tell. Not on streams."""
    i = images.select("image_id", "height", "width")
    n = max(int(i.sparkSession.conf.get("spark.sql.shuffle.partitions")), i.sparkSession.sparkContext.defaultParallelism)
    return i if i.isStreaming else i.repartition(n, "image_id")


def _tile_rows(images: DataFrame, spec: tiling.TileSpec, full_image: bool, sliced: bool = True) -> DataFrame:
    """Tiles with the size of their image; images of several tiles, or all if none are cut, have tile -1, the whole image."""
    images = spread(images)
    size = [F.col("height").alias("ih"), F.col("width").alias("iw")]
    whole = lambda d: d.select("image_id", F.lit(-1).alias("tile_idx"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("width").alias("x2"), F.col("height").alias("y2"), *size)
    if not sliced:
        return whole(images)
    t = tiling.tiles(images.select("image_id", "height", "width"), spec).select("image_id", "tile_idx", "x1", "y1", "x2", "y2", *size)
    if full_image:
        many = tiling.with_tile_size(images.select("image_id", "height", "width"), spec)
        n = tiling.axis_count(F.col("width"), F.col("tile_width"), F.col("ov_w")) * tiling.axis_count(F.col("height"), F.col("tile_height"), F.col("ov_h"))
        t = t.unionByName(whole(many.filter(n > 1)))
    return t


def raw_predictions(images: DataFrame, make: Callable[[], Detector], spec: tiling.TileSpec = tiling.TileSpec(), confidence: float = 0.3, exclude_names: list[str] | None = None, exclude_ids: list[int] | None = None, full_image: bool = True, sliced: bool = True, named: bool = True) -> DataFrame:
    """(image_id, tile_idx, category_id, category_name, score, x1..y2) of images(image_id, height, width), moved to the image and
    clamped to it; empty boxes go. ``named`` False: category_name only if names are excluded. No shuffle but of the images' sizes,
    which the tiles carry, and none on a stream."""
    t = _tile_rows(images, spec, full_image, sliced).select("image_id", "tile_idx", "x1", "y1", "x2", "y2", "ih", "iw")
    return exclude(detect(t, make, shifted=True, confidence=confidence, named=named or bool(exclude_names), clamped=True), exclude_names, exclude_ids)


def sliced_prediction(images: DataFrame, make: Callable[[], Detector], spec: tiling.TileSpec = tiling.TileSpec(), how: Merging = Merging(), confidence: float = 0.3, exclude_names: list[str] | None = None, exclude_ids: list[int] | None = None, full_image: bool = True, sliced: bool = True) -> DataFrame:
    """(image_id, id, category_id, score, x1..y2, n_merged) of images(image_id, file_name, height, width).

    Images of several tiles also get a pass over the whole image; ``sliced`` False gives that alone. Boxes are moved by their
    tile's corner, clamped to the image and merged per image; the merging strategy is rewritten for very low confidence."""
    p = raw_predictions(images, make, spec, confidence, exclude_names, exclude_ids, full_image, sliced, False).drop("category_name", "tile_idx")
    # ids are given once and written, so that they are unique and stay what they are; equal predictions are all kept
    p = Scratch(images.sparkSession, "predictions").write(p.withColumn("id", F.monotonically_increasing_id()))
    return merged(p, ["image_id"], low_confidence_rewrite(how, confidence))


def predict(images: DataFrame, make: Callable[[], Detector], path: str, category_names: dict[int, str] | None = None, **options) -> dict[str, float]:
    """Predicts images(image_id, file_name, height, width) and writes path/results, COCO result rows with their names as JSON lines,
    and path/visuals, one row for each box that would be drawn; returns how many seconds each step took."""
    took, t = {}, time.time()
    scratch = Scratch(images.sparkSession, "predict")
    p = scratch.write(sliced_prediction(images, make, **options))
    took["prediction"], t = time.time() - t, time.time()
    names = F.create_map(*[x for k, v in (category_names or {}).items() for x in (F.lit(int(k)), F.lit(v))]) if category_names else None
    named = p.withColumn("category_name", names[F.col("category_id")] if names is not None else F.col("category_id").cast("string"))
    coco_predictions(named, True).write.mode("overwrite").json(f"{path}/results")
    took["results"], t = time.time() - t, time.time()
    named.join(images.select("image_id", "file_name", "height", "width"), "image_id").write.mode("overwrite").parquet(f"{path}/visuals")
    took["visuals"] = time.time() - t
    return took


def detect_stream(frames: DataFrame, make: Callable[[], Detector], path: str, spec: tiling.TileSpec = tiling.TileSpec(), confidence: float = 0.3, checkpoint: str | None = None):
    """Detects on a stream of frames(image_id, height, width) and appends the predictions, on the frame's coordinates, to the parquet
    table at path; returns the running query."""
    w = raw_predictions(frames, make, spec, confidence, full_image=False).writeStream.format("parquet").outputMode("append")
    return w.option("checkpointLocation", checkpoint or f"{path}/_checkpoint").start(f"{path}/predictions")


def reading_order(preds: DataFrame, row_height: float = 10.0) -> DataFrame:
    """Predictions with their reading position per image: rows of equal height from top to bottom, then left to right."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id").orderBy(F.floor(F.col("y1") / row_height), "x1", "id")
    return preds.withColumn("position", F.row_number().over(w) - 1)


def softmax_decode(logits: Column) -> Column:
    """struct(label, score) of the best class but the last (background), by softmax."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp((v - top).cast("double")))
    fg = F.slice(logits, F.lit(1), F.size(logits) - 1)
    best = F.array_max(fg)
    return F.struct((F.array_position(fg, best) - 1).cast("int").alias("label"), (F.exp((best - top).cast("double")) / z).alias("score"))


def sigmoid_decode(logits: Column) -> Column:
    best = F.array_max(logits)
    return F.struct((F.array_position(logits, best) - 1).cast("int").alias("label"), (1 / (1 + F.exp(-best.cast("double")))).alias("score"))


def coco_predictions(preds: DataFrame, named: bool = False) -> DataFrame:
    """COCO result rows; ``named``: with category_name, area, iscrowd and, where there is one, the segmentation."""
    more = [F.col("category_name"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), F.lit(0).alias("iscrowd")] if named else []
    more += [F.col("segmentation")] if named and "segmentation" in preds.columns else []
    return preds.select("image_id", F.array(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), "score", "category_id", *more)
