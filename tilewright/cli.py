"""Command line: python -m tilewright.cli slice|evaluate|yolo|predict ..."""

from __future__ import annotations

import argparse
import os
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tilewright.functions.draw import text_table
from tilewright.operators import evaluation as E
from tilewright.operators import pipeline as L
from tilewright.operators import tiling as T
from tilewright.operators.dataset import Dataset, running_ids
from tilewright.operators.merge import Merging
from tilewright.session import Scratch, local_session
from tilewright.sources import coco, media, yolo


def next_path(path: str, sep: str = "") -> str:
    """path, or path2, path3, ... behind the greatest number in use."""
    if not os.path.exists(path):
        return path
    head, tail = os.path.split(path)
    used = [int(m[1]) for n in os.listdir(head or ".") if (m := re.fullmatch(re.escape(tail + sep) + r"(\d+)", n))]
    return f"{path}{sep}{max([1, *used]) + 1}"


def _predict(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.source.endswith(".json"):
        images = coco.read_coco(spark, a.source).images
    else:
        files = media.read_images(spark, a.source).filter("width is not null").select(F.col("path").alias("file_name"), "height", "width")
        images = running_ids(files, ["file_name"], "image_id")
    spec = T.TileSpec(a.size, a.size, a.overlap, a.overlap)
    how = Merging(a.method, a.metric, a.threshold, a.class_agnostic)
    took = L.predict(images, L.DETECTORS[a.model], next_path(a.out), spec=spec, how=how, confidence=a.confidence, exclude_names=a.exclude, full_image=not a.no_full_image, sliced=not a.no_sliced)
    print(text_table(["step", "seconds"], [[k, round(v, 2)] for k, v in took.items()]))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tilewright")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("slice", help="slice a COCO dataset, once for each size")
    s.add_argument("dataset"), s.add_argument("out"), s.add_argument("--size", type=int, nargs="+", default=[512]), s.add_argument("--overlap", type=float, default=0.2)
    s.add_argument("--min-area-ratio", type=float, default=0.1), s.add_argument("--ignore-negatives", action="store_true")
    e = sub.add_parser("evaluate", help="evaluate COCO results against a dataset")
    e.add_argument("dataset"), e.add_argument("results"), e.add_argument("--max-detections", type=int, default=E.MAX_DETECTIONS), e.add_argument("--classwise", action="store_true"), e.add_argument("--errors", action="store_true")
    y = sub.add_parser("yolo", help="write YOLO labels of a COCO dataset")
    y.add_argument("dataset"), y.add_argument("out"), y.add_argument("--train-rate", type=float), y.add_argument("--images", help="folder of the image files, to be copied beside their labels")
    r = sub.add_parser("predict", help="sliced prediction over a COCO dataset or a folder of images")
    r.add_argument("source"), r.add_argument("out"), r.add_argument("--model", default="grid", choices=sorted(L.DETECTORS)), r.add_argument("--size", type=int, default=512), r.add_argument("--overlap", type=float, default=0.2)
    r.add_argument("--confidence", type=float, default=0.3), r.add_argument("--method", default="greedy_nmm"), r.add_argument("--metric", default="IOS"), r.add_argument("--threshold", type=float, default=0.5)
    r.add_argument("--class-agnostic", action="store_true"), r.add_argument("--no-sliced", action="store_true"), r.add_argument("--no-full-image", action="store_true"), r.add_argument("--exclude", nargs="*", default=[])
    a = p.parse_args(argv)
    # a session that spark-submit or the caller has made is used; without one, all cores of this machine
    spark = SparkSession.getActiveSession() or (SparkSession.builder.getOrCreate() if os.environ.get("SPARK_ENV_LOADED") or os.environ.get("SPARK_REMOTE") else local_session("*"))
    if a.command == "predict":
        _predict(spark, a)
        return
    d = coco.read_coco(spark, a.dataset)
    if a.command == "slice":
        for size in a.size:
            t, an = T.slice_dataset(d.images, d.annotations, T.TileSpec(size, size, a.overlap, a.overlap), a.min_area_ratio, a.ignore_negatives)
            # tiles are numbered over the dataset, in order of image and tile
            order = d.images.select("image_id", "ord")
            images = running_ids(t.join(order, "image_id").withColumn("ord", F.struct("ord", "tile_idx")), ["ord"], "new_id")
            anns = an.join(images.select("image_id", "tile_idx", "new_id"), ["image_id", "tile_idx"]).drop("image_id").withColumnRenamed("new_id", "image_id")
            coco.write_coco(Dataset(images.drop("image_id").withColumnRenamed("new_id", "image_id"), d.categories, anns), next_path(f"{a.out}/{size}"), a.ignore_negatives)
    elif a.command == "evaluate":
        truth = d.annotations.select(F.col("ann_id").alias("id"), "image_id", "category_id", "iscrowd", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
        b = F.col("bbox")
        dets = Scratch(spark, "results").write(coco.read_results(spark, a.results).filter(F.size(b) == 4).select(F.monotonically_increasing_id().alias("id"), "image_id", "category_id", "score", b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2")))
        m, n = E.matches(dets, truth, max_detections=a.max_detections), E.truth_counts(truth)
        curve = E.pr_curve(m, n)
        tables = [E.summary(curve, E.max_recall(m, n))] + [E.classwise(curve)] * a.classwise + [E.error_layers(dets, truth, d.categories)] * a.errors
        for t in tables:
            print(text_table(t.columns, [list(r) for r in t.collect()]))
    else:
        yolo.write_labels(d, a.out, a.images, a.train_rate)


if __name__ == "__main__":
    main()
