"""Overlapping pairs of boxes without all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import boxes as B

#: Side of a cell in units of the level's least box size.
CELL = 16


def size_level(width: Column, height: Column) -> Column:
    """Boxes of a level have a greater side from 4^level to 4^(level + 1); of any scale, fractions of a pixel too."""
    return F.floor(F.log2(F.greatest(width, height)) / 2).cast("int")


def _half(level: Column) -> Column:
    """No box of the level reaches further from its centre; a little more, since logarithms are rounded."""
    return 2.001 * F.pow(F.lit(4.0), level)


def levels_in_use(boxes: DataFrame) -> list[int]:
    """The levels that any box has. Bounded by the exponents of a number, whatever the data."""
    r = boxes.agg(F.collect_set(size_level(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("l")).head()
    return sorted(r["l"]) if r else []


def meetings(boxes: DataFrame, keys: list[str], payload: list[str], metric: str, threshold: float) -> DataFrame:
    """Pairs of boxes (keys, id, payload, x1..y2) that may overlap by the threshold, each once: g_* of the one, h_* of the other.

    A box is at home in one cell, that of its centre on the grid of its own level, whose cells are some box sizes wide. As a
    guest it visits, on its own level and on the larger ones in use, the cells in which the centre of a box may lie that matches
    it. A pair meets where the larger of the two is at home (of the same level, the one of the smaller id), so only once, and
    no distinct follows. For IoU, sizes and centres of matching boxes differ by bounded factors, which limits both; for IoS the
    levels in use do. Nothing is repartitioned by hand, so adaptive execution may split a hot cell or key.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less matches all pairs")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    b = boxes.filter("x2 > x1 and y2 > y1").withColumn("own", size_level(w, h))
    cell = lambda at, level: F.floor(at / (CELL * F.pow(F.lit(4.0), level)))
    mid = lambda lo, hi: (F.col(lo) + F.col(hi)) / 2
    cols = ["id", *payload, "x1", "y1", "x2", "y2"]
    home = b.select(*[F.col(k).alias(f"h_{k}") for k in (*keys, "own")], cell(mid("x1", "x2"), F.col("own")).alias("h_tx"), cell(mid("y1", "y2"), F.col("own")).alias("h_ty"), *[F.col(c).alias(f"h_{c}") for c in cols])
    t = min(1.0, threshold)
    if metric == B.IOU:
        # the greater side grows by at most 1 / threshold
        up = F.sequence(F.col("own"), F.greatest(F.col("own"), size_level(w * (1.001 / t), h * (1.001 / t))))
    else:
        used = levels_in_use(b)
        up = F.filter(F.array(*[F.lit(k) for k in used]).cast("array<int>"), lambda k: k >= F.col("own"))
    g = b.withColumn("level", F.explode(up))

    def span(lo: str, hi: str) -> Column:
        low, high = F.col(lo) - _half(F.col("level")), F.col(hi) + _half(F.col("level"))
        if metric == B.IOU:
            # overlaps are at least threshold times the wider side on each axis, so centres are this near
            near = (F.col(hi) - F.col(lo)) * ((1 - t) / t * 1.001 + 1e-9)
            low, high = F.greatest(low, mid(lo, hi) - near), F.least(high, mid(lo, hi) + near)
        return F.sequence(cell(low, F.col("level")), cell(high, F.col("level")))

    g = g.withColumn("tx", F.explode(span("x1", "x2"))).withColumn("ty", F.explode(span("y1", "y2")))
    guest = g.select(*[F.col(k).alias(f"g_{k}") for k in (*keys, "own", "level", "tx", "ty", *cols)])
    same = [F.col(f"g_{k}") == F.col(f"h_{k}") for k in (*keys, "tx", "ty")] + [F.col("g_level") == F.col("h_own")]
    once = (F.col("g_own") < F.col("h_own")) | (F.col("h_id") < F.col("g_id"))
    p, q = B.cols("g_"), B.cols("h_")
    hit = B.touches_inside(p, q) & (B.intersection(p, q) >= threshold * B.denominator(p, q, metric))
    return guest.join(home, reduce(lambda x, y: x & y, same) & once & hit)


def grid_pairs(boxes: DataFrame, keys: list[str], ident: str = "id", metric: str = B.IOU, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """(keys, i, j, metric), i < j, of the boxes x1..y2 within each key whose metric is at least the threshold (``strict``: above it).

    Found by ``meetings``. Needs a positive threshold, or 0 if strict, since disjoint boxes never meet; a threshold that disjoint
    boxes reach makes every pair match and is answered in closed form by the operators that use this one.
    """
    if threshold < 0 or (threshold == 0 and not strict):
        raise ValueError("a threshold of 0 or less matches all pairs")
    b = boxes.select(*keys, F.col(ident).alias("id"), *[F.col(k).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")])
    j = meetings(b, keys, [], metric, threshold or 1e-300)
    m = B.overlap(B.cols("g_"), B.cols("h_"), metric)
    if strict:
        j = j.filter(m > threshold)
    return j.select(*[F.col(f"g_{k}").alias(k) for k in keys], F.least("g_id", "h_id").alias("i"), F.greatest("g_id", "h_id").alias("j"), m.alias("metric"))


def mean_degree(boxes: DataFrame, keys: list[str], ident: str = "id", metric: str = B.IOU, threshold: float = 0.5) -> DataFrame:
    """Per key: boxes and mean number of matching neighbours, the cost model for choosing a merging strategy."""
    n = boxes.groupBy(*keys).agg(F.count("*").alias("n_boxes"))
    e = grid_pairs(boxes, keys, ident, metric, threshold).groupBy(*keys).agg(F.count("*").alias("n_pairs"))
    return n.join(e, keys, "left").select(*keys, "n_boxes", (2 * F.coalesce("n_pairs", F.lit(0)) / F.col("n_boxes")).alias("mean_degree"))
