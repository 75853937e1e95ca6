"""Datasets in COCO JSON and results, read and written with fixed schemas."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import polygons as P
from tilewright.operators.dataset import Dataset, annotation_area, first_of_id, running_ids
from tilewright.sources.files import filesystem

SCHEMA = """
images ARRAY<STRUCT<id: BIGINT, file_name: STRING, height: INT, width: INT>>,
categories ARRAY<STRUCT<id: INT, name: STRING, supercategory: STRING>>,
annotations ARRAY<STRUCT<id: BIGINT, image_id: BIGINT, category_id: INT, iscrowd: INT, bbox: ARRAY<DOUBLE>, segmentation: STRING>>
"""
RESULT_SCHEMA = "image_id BIGINT, bbox ARRAY<DOUBLE>, score DOUBLE, category_id INT, category_name STRING, segmentation STRING, iscrowd INT, area DOUBLE"


def read_coco(spark: SparkSession, path: str, ignore_negatives: bool = False) -> Dataset:
    """Images (the first of an id wins), categories (supercategory defaults to the name) and annotations with boxes derived from
    their polygons where they have any. A run-length segmentation (an object) is passed over in favour of the box.
    ``path`` may name several documents; annotations are numbered over all of them, in order of file and place."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("file"))
    place = F.struct("file", "pos").alias("ord")
    im = raw.select("file", F.posexplode("images").alias("pos", "i")).select(place, F.col("i.id").alias("image_id"), "i.file_name", "i.height", "i.width")
    images = first_of_id(im.select("image_id", "file_name", "height", "width", "ord"), "image_id", "ord")
    cats = raw.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), "c.name", F.coalesce("c.supercategory", "c.name").alias("supercategory"))
    cats = cats.dropDuplicates(["category_id"])
    an = raw.select("file", F.posexplode("annotations").alias("pos", "a")).select(place, F.col("a.image_id"), F.col("a.category_id"), F.col("a.iscrowd"), F.col("a.bbox"), F.col("a.segmentation"))
    an = running_ids(an, ["ord"], "ann_id").withColumn("polygons", F.from_json("segmentation", "ARRAY<ARRAY<DOUBLE>>"))
    b = P.bounds(F.col("polygons"))
    box = lambda k: F.try_element_at(F.col("bbox"), F.lit(k))
    an = an.withColumn("b", b)
    anns = an.select(
        "ann_id", "image_id", "category_id", F.coalesce(F.col("b.x1"), box(1)).alias("x"), F.coalesce(F.col("b.y1"), box(2)).alias("y"),
        F.coalesce(F.col("b.x2") - F.col("b.x1"), box(3)).alias("w"), F.coalesce(F.col("b.y2") - F.col("b.y1"), box(4)).alias("h"), F.col("polygons").alias("segmentation"), F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"),
    )
    if ignore_negatives:
        images = images.join(anns, "image_id", "left_semi")
    return Dataset(images, cats, anns)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).json(path, multiLine=True)


def export_tables(d: Dataset, ignore_negatives: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) with ids given anew from 1 in list order; iscrowd is 0; polygons stay, and the area is theirs where there are
    any; images without annotations go if asked."""
    images = d.images.join(d.annotations, "image_id", "left_semi") if ignore_negatives else d.images
    im = running_ids(images, ["ord"], "new_id")
    drawn = ["segmentation"] if "segmentation" in d.annotations.columns else []
    an = d.annotations.join(im.select("image_id", "new_id", "ord"), "image_id")
    an = running_ids(an.select("ann_id", "new_id", "ord", "category_id", "x", "y", "w", "h", *drawn), ["ord", "ann_id"], "new_ann_id")
    rows = an.select(F.col("new_ann_id").alias("id"), F.col("new_id").alias("image_id"), "category_id", F.array("x", "y", "w", "h").alias("bbox"), annotation_area(an).alias("area"), F.lit(0).alias("iscrowd"), *drawn)
    return im.select(F.col("new_id").alias("id"), "file_name", "height", "width"), rows


def write_coco(d: Dataset, path: str, ignore_negatives: bool = False) -> None:
    """Three folders of JSON lines, written in parallel: a dataset of any size. ``write_coco_document`` gives the single document."""
    images, anns = export_tables(d, ignore_negatives)
    for name, df in (("images", images), ("annotations", anns), ("categories", d.categories.withColumnRenamed("category_id", "id"))):
        df.write.mode("overwrite").json(f"{path}/{name}")


LINE_SCHEMAS = {
    "images": "id BIGINT, file_name STRING, height INT, width INT",
    "annotations": "id BIGINT, image_id BIGINT, category_id INT, bbox ARRAY<DOUBLE>, segmentation ARRAY<ARRAY<DOUBLE>>, iscrowd INT",
    "categories": "id INT, name STRING, supercategory STRING",
}


def read_coco_lines(spark: SparkSession, path: str) -> Dataset:
    """What ``write_coco`` wrote: JSON lines, which are split among tasks, where one document is a single row and task."""
    t = {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in LINE_SCHEMAS.items()}
    box = [F.try_element_at("bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh", 1)]
    return Dataset(
        t["images"].select(F.col("id").alias("image_id"), "file_name", "height", "width", F.col("id").alias("ord")),
        t["categories"].select(F.col("id").alias("category_id"), "name", F.coalesce("supercategory", "name").alias("supercategory")),
        t["annotations"].select(F.col("id").alias("ann_id"), "image_id", "category_id", *box, "segmentation", F.coalesce("iscrowd", F.lit(0)).alias("iscrowd")),
    )


def write_coco_document(d: Dataset, path: str, ignore_negatives: bool = False, max_rows: int = 5_000_000) -> None:
    """One COCO document, streamed through the driver row by row; refused beyond max_rows."""
    images, anns = export_tables(d, ignore_negatives)
    n = images.count() + anns.count()
    if n > max_rows:
        raise ValueError(f"{n} rows are too many for one document; use write_coco")
    parts = (("images", images.orderBy("id")), ("categories", d.categories.withColumnRenamed("category_id", "id").orderBy("id")), ("annotations", anns.orderBy("id")))
    fs, to = filesystem(path)
    with io.TextIOWrapper(fs.open_output_stream(to), encoding="utf-8") as f:
        f.write("{")
        for k, (name, df) in enumerate(parts):
            f.write(("," if k else "") + f'"{name}":[')
            for j, r in enumerate(df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator()):
                f.write(("," if j else "") + r["j"])
            f.write("]")
        f.write("}")


def add_box_and_area(anns: DataFrame) -> DataFrame:
    """Annotations with box and exact area derived from ``segmentation``."""
    b = P.bounds(F.col("segmentation"))
    return anns.withColumn("__b", b).withColumns({"x": F.col("__b.x1"), "y": F.col("__b.y1"), "w": F.col("__b.x2") - F.col("__b.x1"), "h": F.col("__b.y2") - F.col("__b.y1"), "area": P.area_exact(F.col("segmentation"))}).drop("__b")
