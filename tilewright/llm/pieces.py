"""Cutting oversized items at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import file_base
from tilewright.session import ship_package

LIMIT, OVERLAP = 2048, 160
#: How a file name tells its size; in each, width comes first. Corners are left, top, right, bottom.
SIZE_FORMS = (
    r"(?i)[_\-\s]w(\d+)[_x]?h(\d+)\b",
    r"(?i)[_\-\s](\d+)w[_x]?(\d+)h\b",
    r"(?i)[_\-\s](\d+)x(\d+)(?:px)?(?![\dx])",
)
CORNERS = r"_(\d+)_(\d+)_(\d+)_(\d+)(?=\D*$)"


def size_in_name(file_name: Column) -> Column:
    """struct(width, height) told by a file name, or null: w640h480, 640w_480h, 640x480(px), or the corners of a crop."""
    base = F.regexp_replace(file_base(file_name), r"(?i)\.(?:jpe?g|png|tiff?)$", "")
    num = lambda form, k: F.regexp_extract(base, form, k).try_cast("int")
    pairs = [F.struct(num(f, 1).alias("width"), num(f, 2).alias("height")) for f in SIZE_FORMS]
    pairs.append(F.struct((num(CORNERS, 3) - num(CORNERS, 1)).alias("width"), (num(CORNERS, 4) - num(CORNERS, 2)).alias("height")))
    ok = [F.when((p["width"] > 0) & (p["height"] > 0), p) for p in pairs]
    return F.coalesce(*ok)


#: A node of the structure: from, to, and its parts; a leaf has none.
Node = tuple[int, int, tuple]


def grow(length: int, seams: list[int], limit: int = LIMIT) -> list[Node]:
    """The tree of an axis: leaves are the segments between its sorted seams; sibling subtrees are merged, pair by pair and level by
    level, as long as they stay within the limit. Returned are the parts of the root, each within the limit or a single segment."""
    at = [0, *seams, length]
    nodes: list[Node] = [(a, b, ()) for a, b in zip(at[:-1], at[1:])]
    while True:
        level, k = [], 0
        while k < len(nodes):
            if k + 1 < len(nodes) and nodes[k + 1][1] - nodes[k][0] <= limit:
                level.append((nodes[k][0], nodes[k + 1][1], (nodes[k], nodes[k + 1])))
                k += 2
            else:
                level.append(nodes[k])
                k += 1
        if len(level) == len(nodes):
            return nodes
        nodes = level


def pack(parts: list[Node], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces of the tree from left to right. A subtree that fits into the current piece joins it whole; one that does not is
    descended into, down to the segment that crosses the limit. There the piece ends: where that segment begins, which is the
    last seam within the limit, or, if the piece would gain no more than the overlap, at the limit inside the segment. The
    next piece starts ``overlap`` before."""
    out, s = [], 0
    stack = parts[::-1]
    while stack:
        a, b, inner = stack.pop()
        if b - s <= limit:
            end = b
        elif inner:
            stack.extend(reversed(inner))
        else:
            while b - s > limit:
                e = a if a > s + overlap else s + limit
                out.append((s, e))
                s = e - overlap
            end = b
    out.append((s, end))
    return out


def pack_axis(length: int, seams: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    if length <= limit:
        return [(0, length)]
    inside = np.unique(seams[(seams > 0) & (seams < length)])
    return pack(grow(length, inside.tolist(), limit), limit, overlap)


_OUT = pa.schema([("image_id", pa.int64()), ("x1", pa.int32()), ("y1", pa.int32()), ("x2", pa.int32()), ("y2", pa.int32())])
_FLUSH = 50_000


def _cut(limit: int, overlap: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _OUT, strict=True)], schema=_OUT)

        none, n = np.empty(0, np.int64), 0
        for b in batches:
            of = lambda c: [none if s.as_py() is None else np.asarray(s.values) for s in b.column(c)]  # noqa: E731, B023
            for i, w, h, xs, ys in zip(*(b.column(c).to_pylist() for c in ("image_id", "width", "height")), of("xs"), of("ys"), strict=True):
                px, py = (np.array(pack_axis(k, s, limit, overlap)) for k, s in ((w, xs), (h, ys)))
                # many pieces of one image are given on strip by strip
                step = max(1, _FLUSH // len(py))
                for at in range(0, len(px), step):
                    x, y = np.repeat(px[at : at + step], len(py), axis=0), np.tile(py, (len(px[at : at + step]), 1))
                    held.append((np.full(len(x), i), x[:, 0], y[:, 0], x[:, 1], y[:, 1]))
                    n += len(x)
                    if n >= _FLUSH:
                        yield out()
                        n = 0
        if held:
            yield out()

    return f


def image_sizes(images: DataFrame) -> DataFrame:
    """(image_id, width, height) of the images whose size is known: from a row with both positive, else from a file name."""
    told = F.struct("width", "height")
    by = images.groupBy(F.col("id").cast("bigint").alias("image_id")).agg(F.max(F.when((F.col("width") > 0) & (F.col("height") > 0), told)).alias("own"), F.max(size_in_name(F.col("file_name"))).alias("named"))
    s = F.coalesce("own", "named")
    return by.filter(s.isNotNull() & F.col("image_id").isNotNull()).select("image_id", s["width"].alias("width"), s["height"].alias("height"))


def oversized_pieces(sizes: DataFrame, seams: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(image_id, x1, y1, x2, y2): pieces of at most limit x limit of the images of which a side exceeds it.

    The structure of an image is a tree for each axis, grown from the segments between its seams (``grow``) and packed into
    pieces (``pack``), descending only into what does not fit whole.

    ``seams(image_id, axis, pos)`` in any order; repeats, nulls, other axes, positions outside the image and seams of unknown or
    small images don't matter. Distinct seams inside an image are at most as many as its pixels on a side, so the array of an
    axis is bounded by the image, not by the rows delivered for it. Every piece but the last of an axis ends at a seam or is
    full; neighbours overlap by ``overlap``. The pieces are all combinations of both axes. Empty tables give no rows.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    big = sizes.filter((F.col("width") > limit) | (F.col("height") > limit)).select("image_id", "width", "height")
    cuts = seams.select(F.col("image_id").cast("bigint").alias("image_id"), F.lower(F.trim("axis")).alias("axis"), F.col("pos").cast("int").alias("pos")).filter("axis in ('x', 'y') and pos > 0").distinct()
    inside = cuts.join(big, "image_id").filter(F.col("pos") < F.when(F.col("axis") == "x", F.col("width")).otherwise(F.col("height")))
    at = inside.groupBy("image_id").agg(F.collect_list(F.when(F.col("axis") == "x", F.col("pos"))).alias("xs"), F.collect_list(F.when(F.col("axis") == "y", F.col("pos"))).alias("ys"))
    ship_package(sizes.sparkSession)
    both = big.join(at, "image_id", "left").select("image_id", "width", "height", "xs", "ys")
    return both.mapInArrow(_cut(limit, overlap), "image_id bigint, x1 int, y1 int, x2 int, y2 int")
