"""What models give, as boxes and masks: centre boxes, run-length masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def centre_boxes(cx: Column, cy: Column, w: Column, h: Column, width: Column | None = None, height: Column | None = None) -> list[Column]:
    """Corners of a box given by its centre and size; relative ones are scaled by the image's size, and clamped to it."""
    x1, y1, x2, y2 = cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2
    if width is None or height is None:
        return [x1, y1, x2, y2]
    zero = F.lit(0.0)
    return [F.greatest(zero, x1 * width), F.greatest(zero, y1 * height), F.least(x2 * width, width.cast("double")), F.least(y2 * height, height.cast("double"))]


def rle_runs(counts: Column) -> Column:
    """The runs of set pixels of a run-length mask (lengths of unset and set pixels in turn, column by column), as structs from, to."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("runs"))
    indexed = F.transform(counts, lambda c, k: F.struct(k.alias("k"), c.cast("bigint").alias("c")))

    def step(acc: Column, v: Column) -> Column:
        end = acc["at"] + v["c"]
        run = F.struct(acc["at"].alias("a"), end.alias("b"))
        return F.struct(end.alias("at"), F.when((v["k"] % 2 == 1) & (v["c"] > 0), F.array_append(acc["runs"], run)).otherwise(acc["runs"]).alias("runs"))

    return F.aggregate(indexed, start, step)["runs"]


def rle_pixels(counts: Column) -> Column:
    """How many pixels a run-length mask sets."""
    return F.aggregate(F.transform(counts, lambda c, k: F.when(k % 2 == 1, c.cast("bigint")).otherwise(0)), F.lit(0).cast("bigint"), lambda a, v: a + v)


def rle_bounds(counts: Column, height: Column) -> Column:
    """struct(x1, y1, x2, y2): first and last column and row with a set pixel; null for none."""
    runs = rle_runs(counts)
    h = height.cast("bigint")
    one = lambda r: F.floor(r["a"] / h) == F.floor((r["b"] - 1) / h)
    low = F.array_min(F.transform(runs, lambda r: F.when(one(r), r["a"] % h).otherwise(0)))
    high = F.array_max(F.transform(runs, lambda r: F.when(one(r), (r["b"] - 1) % h).otherwise(h - 1)))
    x1, x2 = F.array_min(F.transform(runs, lambda r: F.floor(r["a"] / h))), F.array_max(F.transform(runs, lambda r: F.floor((r["b"] - 1) / h)))
    return F.when(F.size(runs) > 0, F.struct(x1.cast("int").alias("x1"), low.cast("int").alias("y1"), x2.cast("int").alias("x2"), high.cast("int").alias("y2")))
