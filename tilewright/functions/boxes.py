"""Box column functions. A box is four columns or a struct of x1, y1, x2, y2; widths and heights are differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IOU, IOS = "IOU", "IOS"


def cols(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in ("x1", "y1", "x2", "y2")]


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def to_xyxy(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x, y, x + w, y + h]


def to_xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    return [x1, y1, x2 - x1, y2 - y1]


def expand(box: list[Column], ratio: float, max_x: Column | None = None, max_y: Column | None = None) -> list[Column]:
    """Widened by whole pixels of ratio times its size on every side, not below 0 and not beyond the maxima that are given and not 0."""
    x1, y1, x2, y2 = box
    mx, my = F.floor((x2 - x1) * ratio), F.floor((y2 - y1) * ratio)
    zero = F.lit(0.0)
    cap = lambda v, m: v if m is None else F.when(m.isNull() | (m == 0), v).otherwise(F.least(v, m))
    return [F.greatest(zero, x1 - mx), F.greatest(zero, y1 - my), cap(x2 + mx, max_x), cap(y2 + my, max_y)]


def shift(box: list[Column], dx: Column, dy: Column) -> list[Column]:
    return [box[0] + dx, box[1] + dy, box[2] + dx, box[3] + dy]


def clamp(box: list[Column], width: Column, height: Column) -> list[Column]:
    zero = F.lit(0.0)
    return [F.greatest(box[0], zero), F.greatest(box[1], zero), F.least(box[2], width), F.least(box[3], height)]


def degenerate(box: list[Column]) -> Column:
    return (box[2] <= box[0]) | (box[3] <= box[1])


def yolo_to_voc(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    return [(cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height]


def voc_to_yolo(box: list[Column], width: Column, height: Column) -> list[Column]:
    x1, y1, x2, y2 = box
    return [(x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height]


def relative(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    return [x / width, y / height, w / width, h / height]


def intersection(a: list[Column], b: list[Column]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def denominator(a: list[Column], b: list[Column], metric: str) -> Column:
    if metric == IOU:
        return area(*a) + area(*b) - intersection(a, b)
    if metric == IOS:
        return F.least(area(*a), area(*b))
    raise ValueError(f"unknown metric {metric!r}")


def overlap(a: list[Column], b: list[Column], metric: str = IOU) -> Column:
    """Intersection over union or over the smaller box; 0 where the denominator is not positive."""
    den = denominator(a, b, metric)
    return F.when(den > 0, intersection(a, b) / den).otherwise(F.lit(0.0))


def union_box(a: list[Column], b: list[Column]) -> list[Column]:
    return [F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])]


def touches_inside(a: list[Column], b: list[Column]) -> Column:
    """Open intervals overlap on both axes; edges that only touch do not."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])
