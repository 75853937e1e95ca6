"""Datasets as YOLO label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import boxes as B
from tilewright.operators.dataset import Dataset, split_hashed
from tilewright.session import ship_package
from tilewright.sources.files import filesystem, write_bytes


def label_names(images: DataFrame) -> DataFrame:
    """images with label_name: the file's stem, numbered _2, _3, … where stems collide; files without a suffix or of text are left out."""
    base = F.regexp_replace("file_name", r"^.*[/\\]", "")
    i = images.withColumn("stem", F.regexp_extract(base, r"^(.+)\.[^.]+$", 1)).filter((F.col("stem") != "") & ~F.lower(base).endswith(".txt"))
    n = F.row_number().over(Window.partitionBy("stem").orderBy("ord", "image_id"))
    return i.withColumn("n", n).withColumn("label_name", F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""))).drop("stem", "n")


def label_lines(d: Dataset) -> DataFrame:
    """(image_id, label_name, category_id, cx, cy, w, h) normalised by the image's size; one row for each line of a label file."""
    a = d.annotations.join(label_names(d.images).select("image_id", "label_name", "height", "width"), "image_id")
    box = B.to_xyxy(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    y = B.voc_to_yolo(box, F.col("width"), F.col("height"))
    return a.select("image_id", "ann_id", "label_name", "category_id", *[c.alias(k) for c, k in zip(y, ("cx", "cy", "w", "h"), strict=True)])


def valid(lines: DataFrame) -> DataFrame:
    """Lines with a box of positive size whose centre lies in the image."""
    inside = lambda c: F.col(c).between(0, 1)
    return lines.filter((F.col("w") > 0) & (F.col("h") > 0) & inside("cx") & inside("cy"))


def write_labels(d: Dataset, path: str, image_root: str | None = None, train_rate: float | None = None, seed: int = 0) -> None:
    """A folder in YOLO layout, written by the executors, image by image: labels/name.txt for each image, without lines for invalid
    boxes, and data.yml.

    With ``train_rate`` there are train and val instead, by a hash of the image id, and with ``image_root`` each image's file
    stands beside its labels under the same name. ``path`` and ``image_root`` are addresses all machines can reach."""
    im = label_names(d.images)
    parts = split_hashed(d.images, train_rate, seed) if train_rate is not None else d.images.select("image_id", F.lit("labels").alias("part"))
    line = F.format_string("%d %s %s %s %s", "category_id", *[F.col(k).cast("string") for k in ("cx", "cy", "w", "h")])
    texts = valid(label_lines(d)).groupBy("image_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("ann_id", line.alias("s")))), lambda r: r["s"])).alias("text"))
    files = im.join(parts, "image_id").join(texts, "image_id", "left").select("label_name", "file_name", "part", F.coalesce("text", F.lit("")).alias("text"))

    def save(rows) -> None:
        fs, root = filesystem(path)
        source = filesystem(image_root) if image_root else None
        for r in rows:
            write_bytes(fs, f"{root}/{r['part']}/{r['label_name']}.txt", (r["text"] + "\n" if r["text"] else "").encode())
            if source:
                with source[0].open_input_stream(f"{source[1]}/{r['file_name']}") as f:
                    write_bytes(fs, f"{root}/{r['part']}/{r['label_name']}.{r['file_name'].rpartition('.')[2]}", f.read())

    ship_package(d.images.sparkSession)
    files.foreachPartition(save)
    names = [r["name"] for r in d.categories.orderBy("category_id").select("name").toLocalIterator()]
    fs, root = filesystem(path)
    train, val = ("train", "val") if train_rate is not None else ("labels", "labels")
    write_bytes(fs, f"{root}/data.yml", f"train: {root}/{train}\nval: {root}/{val}\nnc: {len(names)}\nnames: {names}\n".encode())
