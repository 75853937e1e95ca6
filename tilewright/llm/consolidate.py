"""Consolidating pairwise matches into groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.topn import scored
from tilewright.operators.overlap import meetings
from tilewright.session import Scratch, fits_broadcast


def seed_tree(pairs: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(v, seed) for every vertex of ``pairs(a, b)``: seed is the smallest vertex of its component.

    Each round every vertex proposes the least of its neighbourhood to all its neighbours; a vertex that nobody, itself
    included, proposes drops out and hangs from the least proposed to it, and only proposals are linked with each other, so
    the graph shrinks to the seeds while a forest of pruned vertices grows. Then seeds flow down the forest, last pruned
    first: as many joins as rounds, logarithmic in the length of a chain. Hubs are pre-aggregated before each shuffle; joins
    on a hub are split by adaptive execution. Pairs of equal or null vertices don't matter; repeats count once.
    """
    both = lambda d, x, y: d.select(F.col(x).alias("u"), F.col(y).alias("v")).unionByName(d.select(F.col(y).alias("u"), F.col(x).alias("v")))
    edges = scratch.write(both(pairs.filter("a != b"), "a", "b").distinct())
    forest: list[DataFrame] = []
    while edges.limit(1).count():
        if len(forest) >= max_rounds:
            raise RuntimeError("the seed trees did not settle")
        least = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        proposals = scratch.write(edges.join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("c")).unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("c"))).distinct())
        best = proposals.groupBy("x").agg(F.min("c").alias("p"), F.max((F.col("c") == F.col("x")).cast("int")).alias("own"))
        forest.append(scratch.write(best.filter("own = 0").select("x", "p")))
        later = scratch.write(both(proposals.join(best, "x").filter("c != p"), "c", "p").distinct())
        scratch.drop(edges)
        scratch.drop(proposals)
        edges = later
    if not forest:
        return pairs.select(F.col("a").alias("v"), F.col("b").alias("seed")).limit(0)
    down = forest[-1].select(F.col("x").alias("v"), F.col("p").alias("seed"))
    for level in reversed(forest[:-1]):
        above = down.select(F.col("v").alias("p"), "seed")
        here = level.join(above, "p", "left").select(F.col("x").alias("v"), F.coalesce("seed", "p").alias("seed"))
        down = scratch.write(down.unionByName(here))
    return down.unionByName(down.select(F.col("seed").alias("v"), "seed").distinct())


def usable(dets: DataFrame, min_score: float) -> DataFrame:
    """(image_id, det_id, x1, y1, x2, y2) of the detections that can match at all, one row for each delivery."""
    b = F.col("bbox")
    at = lambda k: F.try_element_at(b, F.lit(k)).cast("double")
    ok = F.col("image_id").isNotNull() & F.col("det_id").isNotNull() & scored(F.col("score")) & (F.col("score") >= min_score) & (F.size(b) == 4) & (at(3) > 0) & (at(4) > 0)
    real = [(at(k) > float("-inf")) & (at(k) < float("inf")) for k in (1, 2, 3, 4)]
    return dets.filter(ok & real[0] & real[1] & real[2] & real[3]).select("image_id", "det_id", at(1).alias("x1"), at(2).alias("y1"), (at(1) + at(3)).alias("x2"), (at(2) + at(4)).alias("y2"))


def like_boxes(min_iou: float) -> list[Column]:
    """Columns that are equal only for boxes x1..y2 of which any two have an IoU of min_iou at least: corners in steps of a fraction
    of the power of two below each side, and those powers. Empty where only equal boxes have it.

    Of two boxes with equal columns, the corners of an axis differ by less than a step each, and a step is at most 1/k of the
    joint extent, so the overlap is at least 1 - 2/k of it; on both axes that is min_iou.
    """
    if min_iou >= 0.999:
        return []
    k = math.ceil(2 / (1 - math.sqrt(min_iou)))
    out = []
    for lo, hi in (("x1", "x2"), ("y1", "y2")):
        power = F.floor(F.log2((F.col(hi) - F.col(lo)) * 0.9999)).cast("int")
        step = F.pow(F.lit(2.0), power) / k
        out += [power, F.floor(F.col(lo) / step), F.floor(F.col(hi) / step)]
    return out


#: A group of like boxes this large is represented by one of them.
DENSE = 4


def with_representatives(boxes: DataFrame, min_iou: float) -> DataFrame:
    """boxes(image_id, id, x1..y2) with ``rep``: the smallest id among DENSE or more like boxes of the image, else the own id.

    Only counts of like boxes are shuffled, and they are pre-aggregated; of the groups only the dense ones are joined back."""
    like = like_boxes(min_iou)
    if not like:
        return boxes.withColumn("rep", F.col("id"))
    names = [f"l{k}" for k in range(len(like))]
    keyed = boxes.select("*", *[c.alias(n) for c, n in zip(like, names, strict=True)])
    dense = keyed.groupBy("image_id", *names).agg(F.min("id").alias("dense_rep"), F.count("*").alias("n")).filter(F.col("n") >= DENSE).drop("n")
    return keyed.join(dense, ["image_id", *names], "left").select(*boxes.columns, F.coalesce("dense_rep", "id").alias("rep"))


def matched_groups(dets: DataFrame, min_score: float = 0.1, min_iou: float = 0.5) -> DataFrame:
    """(det_id, group_id) of every detection that matches another one; group_id is the smallest det_id linked with it.

    Identical boxes of an image are first folded into their smallest det_id, so copies of one box, however many, cost no pairs;
    like boxes, of which any two match, are represented by one vertex, so a dense cluster gives links between its parts and not
    all pairs. Every pair of boxes is still compared, and each link between different parts kept, so nothing is lost. Matches
    are found cell by cell (``overlap.meetings``), which adaptive execution may split. Members get their representative's group
    at the end, one row each. Deliveries of a detection count once. Boxes that are null, short, flat, negative in size or not
    finite, null image ids and unscored detections match nothing.
    """
    if not 0 < min_iou <= 1:
        raise ValueError("min_iou must be above 0 and at most 1")
    spark = dets.sparkSession
    scratch = Scratch(spark, "matches")
    box = ["image_id", "x1", "y1", "x2", "y2"]
    rows = usable(dets, min_score)
    folded = scratch.write(rows.groupBy(*box).agg(F.min("det_id").alias("id"), F.max("det_id").alias("most")))
    dense = scratch.write(with_representatives(folded.drop("most"), min_iou).filter("rep != id"))
    small = lambda d, width: F.broadcast(d) if fits_broadcast(d, width) else d
    own = folded.drop("most").join(small(dense.select("id", "rep"), 32), "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    links = meetings(own, ["image_id"], ["rep"], "IOU", min_iou).filter("g_rep != h_rep").select(F.col("g_rep").alias("a"), F.col("h_rep").alias("b"))
    seeds = seed_tree(links, scratch)
    # whoever has a copy or a like box has a match, linked to others or not
    several = folded.filter("most != id").select(F.col("id").alias("v")).unionByName(dense.select(F.col("rep").alias("v"))).distinct()
    reps = scratch.write(several.join(dense.select(F.col("id").alias("v"), F.col("rep").alias("r")), "v", "left").select(F.coalesce("r", "v").alias("v")).distinct())
    groups = scratch.write(seeds.unionByName(reps.join(seeds, "v", "left_anti").select("v", F.col("v").alias("seed"))))
    group_of = lambda d, rep: d.join(groups.withColumnRenamed("v", rep), rep).select("det_id", F.col("seed").alias("group_id"))
    members = group_of(dense.select(F.col("id").alias("det_id"), "rep"), "rep")
    copied = folded.filter("most != id").join(small(dense.select("id", "rep"), 32), "id", "left").select(*box, F.col("id").alias("first"), F.coalesce("rep", "id").alias("rep"))
    copies = group_of(rows.join(copied, box).filter("det_id != first").select("det_id", "rep").distinct(), "rep")
    return groups.select(F.col("v").alias("det_id"), F.col("seed").alias("group_id")).unionByName(members).unionByName(copies)
