"""Algebra over datasets of images, categories and annotations held in three tables."""

from __future__ import annotations

import random
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import boxes as B
from tilewright.functions import polygons as P


@dataclass(frozen=True)
class Dataset:
    """images(image_id, file_name, height, width, ord), categories(category_id, name, supercategory), annotations(ann_id, image_id,
    category_id, x, y, w, h, ...). ``ord`` stands for list order."""

    images: DataFrame
    categories: DataFrame
    annotations: DataFrame


def annotation_area(annotations: DataFrame) -> Column:
    """Whole-pixel area: of the polygons where there are any, else of the box; an area that was delivered is not trusted."""
    box = F.floor(F.col("w") * F.col("h")).cast("bigint")
    if "segmentation" not in annotations.columns:
        return box
    return F.when(F.coalesce(F.size("segmentation"), F.lit(0)) > 0, P.area(F.col("segmentation"))).otherwise(box)


def first_of_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each id, by a partial aggregate: nothing of a group is gathered."""
    rest = [c for c in rows.columns if c not in (key, order)]
    g = rows.groupBy(key).agg(F.min_by(F.struct(order, *rest), order).alias("r"))
    return g.select(key, *[F.col(f"r.{c}").alias(c) for c in rows.columns if c != key]).select(*rows.columns)


def running_ids(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Consecutive ids in a global order: a range sort, counts per partition, and offsets; no single-task window."""
    from tilewright.session import Scratch, cores

    spark = df.sparkSession
    scratch = Scratch(spark, "ids")
    ranged = df.repartitionByRange(max(cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), *[F.col(c) for c in order])
    rows = scratch.write(ranged.withColumn("__part", F.spark_partition_id()))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"))
    offsets = sizes.select("__part", (F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start).alias("__from"))
    w = Window.partitionBy("__part").orderBy(*order)
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__from") + F.row_number().over(w) - 1).cast("bigint")).drop("__part", "__from")


def remap_by_id(d: Dataset, mapping: DataFrame) -> Dataset:
    """Category ids replaced once by mapping(category_id, new_id); a category that is not mapped is an error."""
    j = d.annotations.join(mapping, "category_id", "left")
    checked = F.when(F.col("new_id").isNull(), F.raise_error(F.concat(F.lit("no mapping for category "), F.col("category_id").cast("string")))).otherwise(F.col("new_id"))
    anns = j.withColumn("category_id", checked.cast("int")).drop("new_id")
    cats = d.categories.join(mapping, "category_id").withColumn("category_id", F.col("new_id")).drop("new_id").select(*d.categories.columns)
    return replace(d, annotations=anns, categories=cats)


def update_categories(d: Dataset, desired: DataFrame) -> Dataset:
    """Categories matched by name to desired(name, category_id); annotations of others, and of those given -1, go; images stay."""
    desired = desired.filter("category_id <> -1")
    to = d.categories.select("category_id", "name").join(desired.withColumnRenamed("category_id", "new_id"), "name").select("category_id", "new_id")
    anns = d.annotations.join(to, "category_id").withColumn("category_id", F.col("new_id").cast("int")).select(*d.annotations.columns)
    cats = desired.select("category_id", "name").withColumn("supercategory", F.col("name"))
    return replace(d, annotations=anns, categories=cats)


def merge_categories(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of category names, first seen first, numbered from 0."""
    seen = a.select(F.lit(0).alias("d"), F.col("category_id").alias("o"), "name").unionByName(b.select(F.lit(1).alias("d"), F.col("category_id").alias("o"), "name"))
    names = seen.groupBy("name").agg(F.min(F.struct("d", "o")).alias("k"))
    return names.select((F.row_number().over(Window.orderBy("k.d", "k.o")) - 1).cast("int").alias("category_id"), "name")


def merge_datasets(a: Dataset, b: Dataset, desired: DataFrame | None = None) -> Dataset:
    """Both datasets under the united (or desired) categories; image and annotation ids of the second move behind the first's."""
    desired = desired if desired is not None else merge_categories(a.categories, b.categories)
    a, b = update_categories(a, desired), update_categories(b, desired)
    return append(a, b)


def append(a: Dataset, b: Dataset) -> Dataset:
    """b behind a: ids move by the greatest id of a plus one, leaving the gap that makes."""
    top = a.images.agg((F.coalesce(F.max("image_id"), F.lit(-1)) + 1).alias("di")).crossJoin(a.annotations.agg((F.coalesce(F.max("ann_id"), F.lit(-1)) + 1).alias("da")))
    move = lambda df, cols: df.crossJoin(F.broadcast(top)).withColumns({c: F.col(c) + F.col(o) for c, o in cols}).select(*df.columns)
    images = a.images.unionByName(move(b.images, [("image_id", "di")]))
    return Dataset(images, a.categories, a.annotations.unionByName(move(b.annotations, [("image_id", "di"), ("ann_id", "da")])))


def split_exact(images: DataFrame, rate: float = 0.9, seed: int = 0) -> DataFrame:
    """(image_id, part) by the seeded shuffle of ordinals that Python's random gives: for datasets whose image list fits the driver."""
    n = images.count()
    perm = list(range(n))
    random.Random(seed).shuffle(perm)
    cut = int(n * rate)
    train = set(perm[:cut])
    spark = images.sparkSession
    flags = spark.createDataFrame([(i + 1, i in train) for i in range(n)] or [(0, False)], "rn long, train boolean")
    return running_ids(images, ["ord"], "rn").join(flags, "rn").select("image_id", F.when(F.col("train"), "train").otherwise("val").alias("part"))


def split_hashed(images: DataFrame, rate: float = 0.9, seed: int = 0) -> DataFrame:
    """(image_id, part) by a hash of the id: no order, no shuffle, the same part for an image in any dataset."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("image_id").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return images.select("image_id", F.when(place < F.lit(rate), "train").otherwise("val").alias("part"))


def _every(images: DataFrame, ratio: int, per: str) -> DataFrame:
    return running_ids(images, [per], "rn").filter((F.col("rn") - 1) % ratio == 0).drop("rn")


def with_category(d: Dataset, category_id: int) -> DataFrame:
    """Ids of the images that have the category; -1 stands for images without annotations."""
    if category_id == -1:
        return d.images.select("image_id").join(d.annotations, "image_id", "left_anti")
    return d.annotations.filter(F.col("category_id") == category_id).select("image_id").distinct()


def subsample(d: Dataset, ratio: int = 2, category_id: int | None = None) -> Dataset:
    """Every ratio-th image; with a category, only images that have it are thinned."""
    if category_id is None:
        images = _every(d.images, ratio, "ord")
    else:
        ids = with_category(d, category_id)
        images = d.images.join(ids, "image_id", "left_anti").unionByName(_every(d.images.join(ids, "image_id", "left_semi"), ratio, "ord").select(*d.images.columns))
    return replace(d, images=images, annotations=d.annotations.join(images, "image_id", "left_semi"))


def upsample(d: Dataset, ratio: int = 2, category_id: int | None = None) -> DataFrame:
    """(image_id, copy_no): images repeated ratio times; with a category, only those that have it."""
    n = F.explode(F.sequence(F.lit(0), F.lit(ratio - 1))).alias("copy_no")
    if category_id is None:
        return d.images.select("image_id", n)
    ids = with_category(d, category_id).withColumn("has", F.lit(True))
    return d.images.join(ids, "image_id", "left").select("image_id", "has", n).filter("copy_no = 0 or has").select("image_id", "copy_no")


def area_filter(d: Dataset, low: float = 0, high: float = float("inf"), intervals: DataFrame | None = None) -> DataFrame:
    """Images none of whose annotations lies outside the global interval or that of its category(category_id, lo, hi)."""
    a = d.annotations.withColumn("area", annotation_area(d.annotations))
    bad = (F.col("area") < low) | (F.col("area") > high)
    if intervals is not None:
        a = a.join(intervals, "category_id", "left")
        bad = bad | F.coalesce((F.col("area") < F.col("lo")) | (F.col("area") > F.col("hi")), F.lit(False))
    return d.images.join(a.filter(bad).select("image_id"), "image_id", "left_anti")


def clip_boxes(d: Dataset) -> DataFrame:
    """Annotations cut to their image, in whole pixels; those outside go."""
    a = d.annotations.join(d.images.select("image_id", "height", "width"), "image_id")
    box = [F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")]
    frame = [F.lit(0.0), F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double")]
    c = B.clamp(box, frame[2], frame[3])
    i = [F.floor(v).cast("int") for v in c]
    return a.filter(B.touches_inside(box, frame)).select("ann_id", "image_id", "category_id", i[0].alias("x"), i[1].alias("y"), (i[2] - i[0]).alias("w"), (i[3] - i[1]).alias("h"))


def drop_negatives(d: Dataset) -> DataFrame:
    return d.images.join(d.annotations, "image_id", "left_semi")


def class_counts(annotations: DataFrame) -> DataFrame:
    """(category_id, n_images, total_images): images per category, and images that have annotations at all."""
    pairs = annotations.select("image_id", "category_id").distinct()
    total = pairs.select("image_id").distinct().agg(F.count("*").alias("total_images"))
    return pairs.groupBy("category_id").agg(F.count("*").alias("n_images")).crossJoin(F.broadcast(total))


def add_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of two datasets: key-wise sums, and the sum of the totals."""
    u = a.unionByName(b)
    t = a.agg(F.max("total_images").alias("t")).unionByName(b.agg(F.max("total_images").alias("t"))).agg(F.sum("t").alias("total_images"))
    return u.groupBy("category_id").agg(F.sum("n_images").alias("n_images")).crossJoin(F.broadcast(t))


def stats(d: Dataset) -> DataFrame:
    """One row of counts, annotations per image (images without any left out of the mean) and areas."""
    a = d.annotations.withColumn("area", annotation_area(d.annotations))
    per = a.groupBy("image_id").agg(F.count("*").alias("n"))
    whole = a.agg(F.count("*").alias("num_annotations"), F.min("area").alias("min_annotation_area"), F.max("area").alias("max_annotation_area"), F.avg("area").alias("avg_annotation_area"))
    im = d.images.join(per, "image_id", "left").agg(
        F.count("*").alias("num_images"), F.sum(F.col("n").isNull().cast("int")).alias("num_negative_images"),
        F.min("n").alias("min_annotations_per_image"), F.max("n").alias("max_annotations_per_image"), F.avg("n").alias("avg_annotations_per_image"),
    )
    cats = d.categories.agg(F.count("*").alias("num_categories"))
    return im.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(cats))


def stats_by_category(d: Dataset) -> DataFrame:
    a = d.annotations.withColumn("area", annotation_area(d.annotations))
    per_image = a.groupBy("category_id", "image_id").agg(F.count("*").alias("n"), F.min("area").alias("lo"), F.max("area").alias("hi"), F.sum("area").alias("s"))
    by = per_image.groupBy("category_id").agg(F.sum("n").alias("num_annotations"), F.count("*").alias("num_images"), F.min("lo").alias("min_area"), F.max("hi").alias("max_area"), (F.sum("s") / F.sum("n")).alias("avg_area"))
    return by.join(F.broadcast(d.categories.select("category_id", "name")), "category_id")


def remove_invalid(preds: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Predictions(image_id, x, y, w, h) without a null, empty or negative box; with images, also not starting beyond or being larger than theirs."""
    p = preds.filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") >= 0) & (F.col("h") >= 0))
    if images is None:
        return p
    size = images.select("image_id", "height", "width")
    return p.join(size, "image_id").filter((F.col("x") <= F.col("width")) & (F.col("y") <= F.col("height")) & (F.col("w") <= F.col("width")) & (F.col("h") <= F.col("height"))).drop("height", "width")


def video_ids(frames: DataFrame) -> DataFrame:
    """frames(video_id, image_id, ts) with new_video_id from 1, frame_id from 0 within each video; instance ids move per video elsewhere."""
    vids = frames.select("video_id").distinct()
    numbered = running_ids(vids, ["video_id"], "new_video_id")
    w = Window.partitionBy("video_id").orderBy("ts", "image_id")
    return frames.withColumn("frame_id", (F.row_number().over(w) - 1).cast("int")).join(numbered, "video_id")


def running_totals(df: DataFrame, order: list[str], value: str, name: str, start: int = 0) -> DataFrame:
    """df with the sum of ``value`` over all rows before each in a global order: a range sort, sums per partition, and offsets."""
    from tilewright.session import Scratch, cores

    spark = df.sparkSession
    ranged = df.repartitionByRange(max(cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), *[F.col(c) for c in order])
    rows = Scratch(spark, "totals").write(ranged.withColumn("__part", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__part").agg(F.sum(value).alias("__s"))
    # one row for each partition
    offsets = parts.select("__part", (F.coalesce(F.sum("__s").over(before(Window.orderBy("__part"))), F.lit(0)) + start).alias("__from"))
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy("__part").orderBy(*order))), F.lit(0))
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__from") + inside).cast("bigint")).drop("__part", "__from")


def instance_offsets(anns: DataFrame) -> DataFrame:
    """anns(video_id, instance_id, …) with instance ids made distinct across videos: each video's start after those of the videos before."""
    per = anns.groupBy("video_id").agg((F.max("instance_id") + 1).alias("n"))
    off = running_totals(per, ["video_id"], "n", "off").select("video_id", "off")
    return anns.join(off, "video_id").withColumn("instance_id", F.col("instance_id") + F.col("off")).drop("off")


def video_tables(frames: DataFrame, anns: DataFrame, categories: DataFrame) -> dict[str, DataFrame]:
    """videos, images, annotations and categories of frames(video_id, image_id, ts, …) and anns(ann_id, image_id, instance_id, …).

    Videos, images and annotations are numbered anew from 1 in order of video, time and old id, frames from 0 within each video; a
    video's instance ids move by 1 and by the number of different ones in the videos before. A null instance id stays null."""
    videos = running_ids(frames.select("video_id").distinct(), ["video_id"], "id")
    im = video_ids(frames)
    im = running_ids(im, ["new_video_id", "frame_id"], "new_image_id")
    a = anns.join(im.select("image_id", "new_image_id", "new_video_id"), "image_id")
    per = videos.select(F.col("id").alias("new_video_id")).join(a.groupBy("new_video_id").agg(F.count_distinct("instance_id").alias("n")), "new_video_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    off = running_totals(per, ["new_video_id"], "n", "off", 1).select("new_video_id", "off")
    a = running_ids(a.join(off, "new_video_id"), ["new_image_id", "ann_id"], "id").withColumn("instance_id", F.col("instance_id") + F.col("off"))
    return {
        "videos": videos,
        "images": im.drop("video_id", "image_id").withColumnsRenamed({"new_video_id": "video_id", "new_image_id": "id"}),
        "annotations": a.drop("image_id", "ann_id", "off").withColumnsRenamed({"new_video_id": "video_id", "new_image_id": "image_id"}),
        "categories": categories,
    }


def relative_columns(width: Column, height: Column) -> list[Column]:
    return B.relative(F.col("x"), F.col("y"), F.col("w"), F.col("h"), width, height)
