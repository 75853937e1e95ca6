"""Polygon column functions (flat coordinate arrays, higher-order functions) and Arrow kernels for what needs a geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf, pandas_udf

_RINGS, _INT_RINGS, _MASK = (T.ArrayType(T.ArrayType(t)) for t in (T.DoubleType(), T.IntegerType(), T.BooleanType()))


def xs(poly: Column) -> Column:
    return F.filter(poly, lambda _, i: i % 2 == 0)


def ys(poly: Column) -> Column:
    return F.filter(poly, lambda _, i: i % 2 == 1)


def bounds(segmentation: Column) -> Column:
    """struct(x1, y1, x2, y2) over all polygons; null if there are no coordinates."""
    flat_x, flat_y = F.flatten(F.transform(segmentation, xs)), F.flatten(F.transform(segmentation, ys))
    return F.when(F.size(flat_x) > 0, F.struct(F.array_min(flat_x).alias("x1"), F.array_min(flat_y).alias("y1"), F.array_max(flat_x).alias("x2"), F.array_max(flat_y).alias("y2")))


def ring_area(poly: Column) -> Column:
    """Shoelace area of one flat ring; below three points it is 0."""
    n = F.size(poly).cast("int")
    at = lambda i: F.get(poly, i)
    term = lambda i: at(i) * at((i + 3) % n) - at((i + 2) % n) * at(i + 1)
    s = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)), F.lit(2)), F.lit(0.0), lambda acc, i: acc + term(i).cast("double"))
    return F.when((n >= 6) & (n % 2 == 0), F.abs(s) / 2).otherwise(F.lit(0.0))


def area(segmentation: Column) -> Column:
    """Whole-pixel area: the sum over the polygons, truncated."""
    return F.floor(F.aggregate(F.transform(segmentation, ring_area), F.lit(0.0), lambda a, x: a + x)).cast("bigint")


def area_exact(segmentation: Column) -> Column:
    return F.aggregate(F.transform(segmentation, ring_area), F.lit(0.0), lambda a, x: a + x)


def shift(segmentation: Column, dx: Column, dy: Column, max_x: Column, max_y: Column) -> Column:
    """Moved by (dx, dy), capped above at the image's size, not below."""
    return F.transform(segmentation, lambda p: F.transform(p, lambda v, i: F.when(i % 2 == 0, F.least(v + dx, max_x)).otherwise(F.least(v + dy, max_y))))


def closed_quad(points: Column) -> Column:
    """Four [x, y] points to one closed ring of ten numbers."""
    return F.concat(F.flatten(points), F.get(points, F.lit(0)))


def box_ring(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(x1, y1, x2, y1, x2, y2, x1, y2)


def to_export(segmentation: Column, ox: Column, oy: Column) -> Column:
    """Relative to (ox, oy), truncated to whole pixels, closing vertices dropped, rings without area left out."""
    rel = F.transform(segmentation, lambda p: F.transform(p, lambda v, i: F.when(i % 2 == 0, v - ox).otherwise(v - oy).cast("int")))
    n = lambda p: F.size(p).cast("int")
    open_ = F.transform(rel, lambda p: F.when((n(p) > 6) & (F.get(p, F.lit(0)) == F.get(p, n(p) - 2)) & (F.get(p, F.lit(1)) == F.get(p, n(p) - 1)), F.slice(p, F.lit(1), n(p) - 2)).otherwise(p))
    return F.filter(open_, lambda p: ring_area(p) > 0)


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def points(poly: Column) -> Column:
    """A flat ring as structs of x and y."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(poly) / 2).cast("int") - 1), lambda k: F.struct(F.get(poly, 2 * k).cast("double").alias("x"), F.get(poly, 2 * k + 1).cast("double").alias("y")))


def _cut(ring: Column, axis: str, limit: Column, keep_less: bool) -> Column:
    """The part of a ring of points on one side of a line: corners inside, and the line's crossings."""
    inside = lambda p: p[axis] <= limit if keep_less else p[axis] >= limit
    other = "y" if axis == "x" else "x"

    def crossing(p: Column, q: Column) -> Column:
        at = p[other] + (limit - p[axis]) / (q[axis] - p[axis]) * (q[other] - p[other])
        x, y = (limit, at) if axis == "x" else (at, limit)
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def corner(q: Column, k: Column, r: Column) -> Column:
        p = F.get(r, F.when(k == 0, F.size(r) - 1).otherwise(k - 1))
        return F.array(F.when(inside(p) != inside(q), crossing(p, q)), F.when(inside(q), q))

    return _bound(ring, lambda r: F.array_compact(F.flatten(F.transform(r, lambda q, k: corner(q, k, r)))))


def clip_to_box(segmentation: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Rings cut to a box, edge by edge, as flat rings again; parts that fall apart stay joined along the box's edge. Rings of fewer
    than three points, before or after, are left out; null stays null."""
    whole = F.filter(segmentation, lambda p: (F.size(p) >= 6) & (F.size(p) % 2 == 0))
    cut = lambda r: _cut(_cut(_cut(_cut(points(r), "x", x1, False), "x", x2, True), "y", y1, False), "y", y2, True)
    parts = F.filter(F.transform(whole, cut), lambda r: F.size(r) >= 3)
    return F.transform(parts, lambda r: F.flatten(F.transform(r, lambda p: F.array(p["x"], p["y"]))))


# --- Arrow kernels -----------------------------------------------------------------------------------------------------


def hull(points: np.ndarray) -> np.ndarray:
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(it):
        out: list[np.ndarray] = []
        for q in it:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    lower, upper = half(p), half(p[::-1])
    return np.array(lower[:-1] + upper[:-1])


@pandas_udf(T.ArrayType(T.DoubleType()))
def convex_hull(segmentation: pd.Series) -> pd.Series:
    def one(seg):
        pts = [np.asarray(p, float).reshape(-1, 2) for p in seg if len(p) % 2 == 0] if seg is not None else []
        return hull(np.concatenate(pts)).ravel().tolist() if pts else None

    return segmentation.map(one)


def simplify_ring(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Keeps the ends and, between them, whatever lies further than the tolerance from the chord; with a stack, not recursion."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        off = p[a + 1 : b] - p[a]
        n = np.hypot(*d)
        dist = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / n if n else np.hypot(off[:, 0], off[:, 1])
        k = int(dist.argmax())
        if dist[k] > tolerance:
            m = a + 1 + k
            keep[m] = True
            stack += [(a, m), (m, b)]
    return p[keep]


def simplify(tolerance: float = 1.0):
    @pandas_udf(_RINGS)
    def f(segmentation: pd.Series) -> pd.Series:
        return segmentation.map(lambda seg: [simplify_ring(np.asarray([*p, *p[:2]], float).reshape(-1, 2), tolerance)[:-1].ravel().tolist() for p in seg if len(p) >= 6 and len(p) % 2 == 0] if seg is not None else None)

    return f


# --- masks: rows of pixels ---------------------------------------------------------------------------------------------


#: Crossings of scan lines and edges looked at in one go.
_CROSSINGS = 1 << 20


def fill(segmentation, width: int, height: int) -> np.ndarray:
    """Pixels whose centre lies in a ring (even-odd), and the rounded outline itself."""
    m = np.zeros((height, width), bool)
    for p in segmentation:
        r = np.rint(np.asarray(p, float)).reshape(-1, 2)
        if len(r) < 3 or not width:
            continue
        (x0, y0), (x1, y1) = r.T, np.roll(r, -1, axis=0).T
        top, end = max(0, int(y0.min())), min(height - 1, int(y0.max())) + 1
        rows = max(1, _CROSSINGS // len(r))
        for y in range(top, end, rows):
            line = np.arange(y, min(end, y + rows))[:, None]
            cross = (y0 <= line) != (y1 <= line)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = np.where(cross, x0 + (line - y0) * (x1 - x0) / (y1 - y0), np.inf)
            at = np.sort(at, axis=1)[:, : 2 * int(cross.sum(axis=1).max(initial=0) // 2)]
            a, b = at[:, ::2], at[:, 1::2]
            some = np.isfinite(b)
            k = np.nonzero(some)[0]
            lo = np.clip(np.ceil(a[some]), 0, width).astype(np.int64)
            hi = np.clip(np.floor(b[some]) + 1, 0, width).astype(np.int64)
            step = np.zeros((len(line), width + 1), np.int32)
            np.add.at(step, (k, lo), 1)
            np.add.at(step, (k, np.maximum(lo, hi)), -1)
            m[y : y + len(line)] |= np.cumsum(step[:, :-1], axis=1) > 0
        n = np.maximum(np.abs(x1 - x0), np.abs(y1 - y0)).astype(np.int64) + 1
        for e in range(len(r)):
            lx, ly = np.rint(np.linspace(x0[e], x1[e], n[e])).astype(int), np.rint(np.linspace(y0[e], y1[e], n[e])).astype(int)
            ok = (lx >= 0) & (lx < width) & (ly >= 0) & (ly < height)
            m[ly[ok], lx[ok]] = True
    return m


#: Pixels of the raster on which many masks are drawn at once, as a rule; bounds the memory, not the size of a mask.
RASTER = 1 << 22


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) of n[k] things for each k."""
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)


class Rings:
    """The rings of many segmentations: of each ring its owner, of each corner its ring. Rings of fewer than three points or an odd
    number of coordinates are left out, as ``fill`` and its callers leave them out."""

    def __init__(self, owner: np.ndarray, size: np.ndarray, xy: np.ndarray, n: int) -> None:
        self.owner, self.size, self.xy, self.n = owner, size, xy, n
        self.start = np.concatenate([[0], np.cumsum(size)])

    @classmethod
    def of_arrow(cls, column: pa.ChunkedArray | pa.Array) -> Rings:
        c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
        c = c.cast(pa.list_(pa.list_(pa.float64())))
        at, there = np.asarray(c.offsets, np.int64), np.asarray(c.is_valid())
        owner, k = _spread(np.where(there, np.diff(at), 0))
        inner = c.values
        pos = at[owner] + k
        to = np.asarray(inner.offsets, np.int64)
        size = np.where(np.asarray(inner.is_valid()), np.diff(to), 0)[pos] if len(pos) else np.empty(0, np.int64)
        ok = (size >= 6) & (size % 2 == 0)
        owner, pos, size = owner[ok], pos[ok], size[ok]
        ring, k = _spread(size)
        return cls(owner, size // 2, np.asarray(inner.values, np.float64)[to[pos[ring]] + k].reshape(-1, 2), len(c))

    def take(self, owners: np.ndarray) -> Rings:
        """Those of the given owners, in their order, who may come again."""
        first = np.searchsorted(self.owner, np.arange(self.n + 1))
        who, k = _spread(np.diff(first)[owners])
        ring = first[owners][who] + k
        to, k = _spread(self.size[ring])
        return Rings(who, self.size[ring], self.xy[self.start[ring][to] + k], len(owners))

    def corner_owner(self) -> np.ndarray:
        return np.repeat(self.owner, self.size)

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lowest, highest corner of each owner, whether it has any)."""
        some = np.bincount(self.owner, minlength=self.n) > 0
        at = np.searchsorted(self.corner_owner(), np.flatnonzero(some))
        low, high = np.zeros((self.n, 2)), np.zeros((self.n, 2))
        if some.any():
            low[some], high[some] = np.minimum.reduceat(self.xy, at), np.maximum.reduceat(self.xy, at)
        return low, high, some

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """(rounded corners x1, y1, x2, y2, whether it is one) of owners whose mask is one upright box, borders included."""
        n = self.n
        only = np.bincount(self.owner, minlength=n) == 1
        out, ok = np.zeros((n, 4)), np.zeros(n, bool)
        ring = np.flatnonzero(only[self.owner] & (self.size == 4))
        if len(ring):
            r = np.rint(self.xy[self.start[ring][:, None] + np.arange(4)])
            step = np.roll(r, -1, axis=1) - r
            x0, x1 = (step[:, ::2, 1] == 0).all(1) & (step[:, 1::2, 0] == 0).all(1), (step[:, ::2, 0] == 0).all(1) & (step[:, 1::2, 1] == 0).all(1)
            w = self.owner[ring]
            ok[w] = x0 | x1
            out[w, :2], out[w, 2:] = r.min(axis=1), r.max(axis=1)
        return out, ok


def draw(rings: Rings, origin: np.ndarray, width: np.ndarray, height: np.ndarray, border: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """What ``fill`` draws of each owner on its raster, whose first pixel is at ``origin`` and which has an empty border: all rasters
    row by row one after the other as one flat array, and where each starts."""
    base = np.concatenate([[0], np.cumsum((width + 2 * border) * (height + 2 * border))])
    corner = base[:-1] + border * (width + 2 * border + 1)
    own = rings.corner_owner()
    r = np.rint(rings.xy - origin[own])
    last = rings.start[1:] - 1
    nxt = np.arange(1, len(r) + 1)
    nxt[last] = rings.start[:-1]
    (x0, y0), (x1, y1) = r.T, r[nxt].T
    w, h = width[own], height[own]
    ring = np.repeat(np.arange(len(rings.size)), rings.size)
    # scan lines: where an edge crosses the rows of its raster, in order along the row of its ring
    lo, hi = np.clip(np.minimum(y0, y1), 0, h).astype(np.int64), np.clip(np.maximum(y0, y1), 0, h).astype(np.int64)
    e, k = _spread(np.maximum(hi - lo, 0))
    line = lo[e] + k
    at = x0[e] + (line - y0[e]) * (x1[e] - x0[e]) / (y1[e] - y0[e])
    o = np.lexsort((at, line, ring[e]))
    e, line, at = e[o], line[o], at[o]
    a, b, e, line = at[::2], at[1::2], e[::2], line[::2]
    wide = w[e]
    left = np.clip(np.ceil(a), 0, wide).astype(np.int64)
    right = np.maximum(left, np.clip(np.floor(b) + 1, 0, wide).astype(np.int64))
    row = corner[own[e]] + line * (wide + 2 * border)
    # level edges are stretches, too; upright ones but for their end are ends of stretches already
    f = np.flatnonzero((y0 == y1) & (y0 >= 0) & (y0 < h))
    flat = corner[own[f]] + y0[f].astype(np.int64) * (w[f] + 2 * border)
    on, off = (np.clip(x, 0, w[f]).astype(np.int64) for x in (np.minimum(x0[f], x1[f]), np.maximum(x0[f], x1[f]) + 1))
    step = np.bincount(np.concatenate([row + left, flat + on]), minlength=base[-1] + 1) - np.bincount(np.concatenate([row + right, flat + off]), minlength=base[-1] + 1)
    m = np.cumsum(step)[:-1] > 0
    # outlines, as np.linspace gives them; of upright and level edges their end
    span = np.where((x0 == x1) | (y0 == y1), 0, np.maximum(np.abs(x1 - x0), np.abs(y1 - y0))).astype(np.int64)
    e, k = _spread(span + 1)
    put = []
    for p, q in ((x0, x1), (y0, y1)):
        d = (q - p) / np.maximum(span, 1)
        v = np.rint(k * d[e] + p[e])
        put.append(np.where(k == span[e], q[e], v).astype(np.int64))
    ok = (put[0] >= 0) & (put[0] < w[e]) & (put[1] >= 0) & (put[1] < h[e])
    e, px, py = e[ok], put[0][ok], put[1][ok]
    m[corner[own[e]] + py * (w[e] + 2 * border) + px] = True
    return m, base


def _parts(size: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of things whose sizes come to RASTER at most, or that are one thing."""
    out, at, total = [], 0, np.cumsum(size)
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + RASTER, "right")))
        out.append((at, to))
        at = to
    return out


@pandas_udf(_MASK)
def mask_from_polygons(segmentation: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([fill(s if s is not None else [], int(w), int(h)).tolist() for s, w, h in zip(segmentation, width, height, strict=True)])


def _tops(mask: np.ndarray) -> list[tuple[int, int]]:
    """The first pixel, row by row, of each 8-connected part: runs of a row joined with those they touch in the row above."""
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (ys, starts), (_, ends) = np.nonzero(step == 1), np.nonzero(step == -1)
    up = list(range(len(ys)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    runs = list(zip(ys.tolist(), starts.tolist(), ends.tolist(), strict=True))
    above = 0
    for k, (y, a, b) in enumerate(runs):
        while above < k and (runs[above][0] < y - 1 or (runs[above][0] == y - 1 and runs[above][2] < a)):
            above += 1
        j = above
        while j < k and runs[j][0] == y - 1 and runs[j][1] <= b:
            p, q = root(j), root(k)
            up[max(p, q)] = min(p, q)
            j += 1
    return [runs[k][:2] for k in range(len(runs)) if up[k] == k]


def outline(mask: np.ndarray) -> list[list[int]]:
    """Outer borders of the 8-connected parts as rings of pixel positions, straight runs reduced to their ends; at least three points."""
    h, w = mask.shape
    wide = np.zeros((h + 2, w + 2), bool)
    wide[1:-1, 1:-1] = mask
    pad = wide.tolist()
    step = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    out = []
    for y, x in _tops(wide):
        ring, at, came = [(y, x)], (y, x), 4
        first = None
        while True:
            for k in range(1, 9):
                d = (came + k) % 8
                n = (at[0] + step[d][0], at[1] + step[d][1])
                if pad[n[0]][n[1]]:
                    break
            else:
                break
            if first is None:
                first = d
            elif at == (y, x) and d == first:
                break
            at, came = n, (d + 4) % 8
            ring.append(at)
        pts = ring[:-1] if len(ring) > 1 and ring[-1] == ring[0] else ring
        n = len(pts)
        turn = [p for i, p in enumerate(pts) if n < 3 or (p[0] - pts[i - 1][0], p[1] - pts[i - 1][1]) != (pts[(i + 1) % n][0] - p[0], pts[(i + 1) % n][1] - p[1])]
        if len(turn) >= 3:
            out.append([int(v) for p in turn for v in (p[1] - 1, p[0] - 1)])
    return out


_STEP_Y, _STEP_X = np.array([0, 1, 1, 1, 0, -1, -1, -1]), np.array([1, 1, 0, -1, -1, -1, 0, 1])


def _next_step() -> np.ndarray:
    """By the pixels set around one (a bit for each direction) and the direction one comes from: the direction to go on in, or -1."""
    out = np.full((256, 8), -1, np.int64)
    for code in range(1, 256):
        for came in range(8):
            out[code, came] = next(d for k in range(1, 9) if code >> (d := (came + k) % 8) & 1)
    return out


_NEXT = _next_step()


def outlines(m: np.ndarray, base: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``outline`` of many rasters, each with an empty border: (raster, number of corners) of each ring, and all corners (x, y), which
    count from the raster's first pixel. All rings are walked along at once, a pixel at a time."""
    seen = np.concatenate([[0], np.cumsum(m)])
    starts, ends = np.flatnonzero(m[1:] & ~m[:-1]) + 1, np.flatnonzero(m[:-1] & ~m[1:]) + 1
    of = at_of(starts, base)
    w = width[of]
    # runs that touch none above; where a raster has several of them they may hang together further down
    top = seen[ends - w + 1] == seen[starts - w - 1]
    of, at = of[top], starts[top]
    several = np.bincount(of, minlength=len(width)) > 1
    if several.any():
        each = {k: _tops(m[base[k] : base[k + 1]].reshape(height[k], width[k])) for k in np.flatnonzero(several).tolist()}
        one = ~several[of]
        of = np.concatenate([of[one], np.repeat(list(each), [len(t) for t in each.values()])]).astype(np.int64)
        at = np.concatenate([at[one], [base[k] + y * width[k] + x for k, t in each.items() for y, x in t]]).astype(np.int64)
        o = np.argsort(at, kind="stable")
        of, at = of[o], at[o]
    go, w = np.arange(len(at)), width[of]
    begun, begin, came, first, n = at, at, np.full(len(at), 4), np.full(len(at), -1), 0
    turns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(go):
        code = np.zeros(len(go), np.int64)
        for d in range(8):
            code |= m[at + (_STEP_Y[d] * w + _STEP_X[d])].astype(np.int64) << d
        d = _NEXT[code, came]
        if n:
            back = (at == begin) & (d == first)
            turn = d != (came + 4) % 8
            turns.append((go[turn], np.where(back[turn], 0, n), at[turn]))
            on = ~back
        else:
            first, on = d, d >= 0
        if not on.all():
            go, w, at, begin, came, first, d = (x[on] for x in (go, w, at, begin, came, first, d))
        at, came, n = at + (_STEP_Y[d] * w + _STEP_X[d]), (d + 4) % 8, n + 1
    ring, nth, at = (np.concatenate(x) for x in zip(*turns, strict=True)) if turns else (np.empty(0, np.int64),) * 3
    o = np.lexsort((nth, ring))
    ring, at = ring[o], at[o]
    size = np.bincount(ring, minlength=len(begun))
    ok = size >= 3
    at, ring = at[ok[ring]], ring[ok[ring]]
    k = of[ring]
    y, x = np.divmod(at - base[k], width[k])
    return of[ok], size[ok], np.stack([x, y], axis=1)


def at_of(at: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The raster that each pixel is on."""
    return np.searchsorted(base, at, "right") - 1


@pandas_udf(_INT_RINGS)
def polygons_from_mask(mask: pd.Series) -> pd.Series:
    return mask.map(lambda m: outline(np.array([list(r) for r in m], bool)) if m is not None and len(m) else [])


@pandas_udf(_INT_RINGS)
def union_polygons(a: pd.Series, b: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Union of two segmentations on the pixel raster."""
    return pd.Series([outline(fill(p if p is not None else [], int(w), int(h)) | fill(q if q is not None else [], int(w), int(h))) for p, q, w, h in zip(a, b, width, height, strict=True)])


def unite(rings: list) -> list[list[int]]:
    """Outlines of what any ring covers, on a raster no larger than their bounds."""
    r = [np.asarray(p, float) for p in rings]
    r = [p for p in r if len(p) >= 6 and len(p) % 2 == 0]
    if not r:
        return []
    x = min(np.floor(p[::2].min()) for p in r)
    y = min(np.floor(p[1::2].min()) for p in r)
    w, h = (int(max(np.ceil(p[k::2].max()) for p in r) - o) + 1 for k, o in ((0, x), (1, y)))
    seg = [p - np.tile([x, y], len(p) // 2) for p in r]
    return [[int(v + (x if k % 2 == 0 else y)) for k, v in enumerate(ring)] for ring in outline(fill(seg, w, h))]


def unite_all(segmentations: pa.Array) -> pa.Array:
    """``unite`` for each segmentation of an Arrow array, null for null: many on one raster, each with an empty border."""
    r = Rings.of_arrow(segmentations)
    low, high, some = r.bounds()
    low = np.floor(low)
    size = np.where(some[:, None], np.ceil(high) - low + 1, 0).astype(np.int64)
    owner, count, corner = [], [], []
    for a, b in _parts((size[:, 0] + 2) * (size[:, 1] + 2)):
        at, w, h = low[a:b], size[a:b, 0], size[a:b, 1]
        o, n, c = outlines(*draw(r.take(np.arange(a, b)), at, w, h, 1), w + 2, h + 2)
        owner.append(o + a), count.append(n), corner.append(c - 1 + at.astype(np.int64)[np.repeat(o, n)])
    o, n, c = (np.concatenate(x) for x in (owner, count, corner)) if owner else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.int64))
    to = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
    rings = pa.ListArray.from_arrays(to(2 * n), pa.array(c.ravel(), pa.int32()))
    return pa.ListArray.from_arrays(to(np.bincount(o, minlength=r.n)), rings, mask=segmentations.is_null())


def count_pixels(segmentations: pa.Array) -> pa.Array:
    """How many pixels the rings of each segmentation of an Arrow array cover; null for null."""
    r = Rings.of_arrow(segmentations)
    low, high, some = r.bounds()
    size = np.where(some[:, None], np.rint(high - low) + 1, 0).astype(np.int64)
    _, box = r.boxes()
    out = np.where(box, size[:, 0] * size[:, 1], 0)
    rest = np.flatnonzero(some & ~box)
    size = size[rest]
    for a, b in _parts(size[:, 0] * size[:, 1]):
        m, base = draw(r.take(rest[a:b]), low[rest[a:b]], size[a:b, 0], size[a:b, 1])
        out[rest[a:b]] = np.diff(np.concatenate([[0], np.cumsum(m)])[base])
    return pa.array(out, pa.int64(), mask=np.asarray(segmentations.is_null()))


def pair_overlaps(p: Rings, q: Rings, i: np.ndarray, j: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """Overlap of the pixels of masks i of p and j of q (of crowd masks, over those of i), drawn on the raster of their common bounds."""
    (pl, ph, ps), (ql, qh, qs), (pb, pu), (qb, qu) = p.bounds(), q.bounds(), p.boxes(), q.boxes()
    out = np.zeros(len(i))
    n = np.flatnonzero(pu[i] & qu[j])
    a, b = pb[i[n]], qb[j[n]]
    inter = np.prod(np.maximum(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]) + 1, 0), axis=1)
    own, other = (np.prod(x[:, 2:] - x[:, :2] + 1, axis=1) for x in (a, b))
    out[n] = inter / np.where(crowd[n], own, own + other - inter)
    # masks further than a pixel apart share none
    meet = (np.minimum(ph[i], qh[j]) - np.maximum(pl[i], ql[j]) > -2).all(axis=1)
    n = np.flatnonzero(meet & ps[i] & qs[j] & ~(pu[i] & qu[j]))
    low = np.floor(np.minimum(pl[i[n]], ql[j[n]]))
    size = (np.rint(np.maximum(ph[i[n]], qh[j[n]]) - low) + 1).astype(np.int64)
    for f, t in _parts(size[:, 0] * size[:, 1]):
        at, (w, h) = n[f:t], size[f:t].T
        (a, base), (b, _) = (draw(r.take(k[at]), low[f:t], w, h) for r, k in ((p, i), (q, j)))
        count = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[base])  # noqa: E731, B023
        inter, whole = count(a & b), np.where(crowd[at], count(a), count(a | b))
        out[at] = np.where(whole > 0, inter / np.maximum(whole, 1), 0.0)
    return out


@arrow_udf(_INT_RINGS)
def union_rings(segmentation: pa.Array) -> pa.Array:
    """One segmentation that covers what any of its rings covers."""
    return unite_all(segmentation)


@arrow_udf(T.LongType())
def pixels_of(segmentation: pa.Array) -> pa.Array:
    """How many pixels its rings cover together; null for null."""
    return count_pixels(segmentation)


def threshold(mask: Column, limit: float = 0.5) -> Column:
    return F.transform(mask, lambda row: F.transform(row, lambda v: v > F.lit(limit)))


def mask_bounds(mask: Column) -> Column:
    """struct(x1, y1, x2, y2) of the first and last true column and row; null if empty or flat."""
    rows = F.filter(F.transform(mask, lambda r, i: F.when(F.exists(r, lambda v: v), i)), lambda v: v.isNotNull())
    cols_ = F.filter(F.flatten(F.transform(mask, lambda r: F.transform(r, lambda v, i: F.when(v, i)))), lambda v: v.isNotNull())
    b = F.struct(F.array_min(cols_).alias("x1"), F.array_min(rows).alias("y1"), F.array_max(cols_).alias("x2"), F.array_max(rows).alias("y2"))
    return F.when((F.size(rows) > 0) & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), b)


def mask_pixels(mask: Column) -> Column:
    return F.aggregate(F.flatten(mask), F.lit(0), lambda n, v: n + v.cast("int"))


def label_masks(df, label_map: str, ident: str = "image_id"):
    """One row per label present in an id map (array of rows): its pixels as (x, y) rows grouped by label."""
    px = df.select(ident, F.posexplode(label_map).alias("y", "row")).select(ident, "y", F.posexplode("row").alias("x", "label"))
    return px.filter("label is not null").groupBy(ident, "label").agg(F.count("*").alias("n_pixels"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
