"""NumPy kernels over the boxes of one group: suppression, greedy and transitive grouping, and the merge fold.

A block is (n, 4) corners and (n,) scores. All orders are total: score from high to low, then x1, y1, x2, y2, then position.
"""

from __future__ import annotations

import numpy as np


def order(box: np.ndarray, score: np.ndarray) -> np.ndarray:
    return np.lexsort((box[:, 3], box[:, 2], box[:, 1], box[:, 0], -score))


def overlaps(one: np.ndarray, many: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(intersection, denominator) of a box with many."""
    w = np.minimum(one[2], many[:, 2]) - np.maximum(one[0], many[:, 0])
    h = np.minimum(one[3], many[:, 3]) - np.maximum(one[1], many[:, 1])
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    own = (one[2] - one[0]) * (one[3] - one[1])
    area = (many[:, 2] - many[:, 0]) * (many[:, 3] - many[:, 1])
    return inter, (own + area - inter if metric == "IOU" else np.minimum(own, area))


def _match(one: np.ndarray, many: np.ndarray, metric: str, thr: float, strict: bool = False) -> np.ndarray:
    inter, den = overlaps(one, many, metric)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where(den > 0, inter / den, 0.0)
    return v > thr if strict else v >= thr


#: Pairs looked at in one go, as a rule; bounds the kernel's memory. Cells above which a box is compared with all others instead.
CHUNK, MANY_CELLS = 1 << 20, 1 << 10


def _laid(b: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, number of cells) of each box along both axes; cells are twice as wide as the middle box of the group."""
    size = np.maximum(b[:, 2] - b[:, 0], b[:, 3] - b[:, 1])
    some = np.flatnonzero(size > 0)
    some = some[np.lexsort((size[some], g[some]))]
    side = np.ones(int(g.max(initial=0)) + 1)
    if len(some):
        n = np.bincount(g[some], minlength=len(side))
        at = np.cumsum(n) - n
        middle = (size[some[np.minimum(at + k, len(some) - 1)]] for k in ((n - 1) // 2, n // 2))
        side = np.where(n > 0, sum(middle), side)
    side = side[g][:, None]
    lo = np.floor(b[:, :2] / side)
    return lo, np.maximum(np.floor(b[:, 2:] / side) - lo + 1, 0)


def with_wide(box: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The groups some box of which lies on so many cells that it has to be compared with all others."""
    span = _laid(box, group)[1]
    return np.unique(group[span[:, 0] * span[:, 1] > MANY_CELLS])


class _Cells:
    """Boxes laid on grid cells, to be asked for the neighbours of a few of them at a time. Given groups have cells of their own each."""

    def __init__(self, b: np.ndarray, group: np.ndarray | None = None) -> None:
        n = len(b)
        g = np.zeros(n, np.int64) if group is None else group
        lo, span = _laid(b, g)
        cells = span[:, 0] * span[:, 1]
        self.wide, self.group = cells > MANY_CELLS, g
        own = np.where(self.wide, 0, cells).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(own)])
        who = np.repeat(np.arange(n), own)
        k = np.arange(len(who)) - self.at[who]
        wide = np.maximum(span[who, 0].astype(np.int64), 1)
        cx, cy = lo[who, 0] + k % wide, lo[who, 1] + k // wide
        o = np.lexsort((who, cx, cy) if group is None else (who, cx, cy, g[who]))
        new = np.ones(len(o), bool)
        new[1:] = (np.diff(cx[o]) != 0) | (np.diff(cy[o]) != 0) | (np.diff(g[who[o]]) != 0)
        #: boxes cell by cell, in order; where each cell starts; the cell of each entry of a box
        self.boxes, self.start = who[o], np.append(np.flatnonzero(new), len(o))
        self.cell = np.empty(len(o), np.int64)
        self.cell[o] = np.cumsum(new) - 1
        size = np.diff(self.start)
        #: how many entries asking for a box looks through
        self.cost = np.concatenate([[0], np.cumsum(size[self.cell])])[self.at]
        self.cost = np.where(self.wide, n, np.diff(self.cost))

    def near(self, q: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) with i in q, j > i and live, of boxes that share a cell; repeats included."""
        out = []
        few = q[~self.wide[q]]
        m = self.at[few + 1] - self.at[few]
        entry = np.repeat(self.at[few] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        c = self.cell[entry]
        size = self.start[c + 1] - self.start[c]
        j = self.boxes[np.repeat(self.start[c] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        i = np.repeat(np.repeat(few, m), size)
        ok = (j > i) & live[j]
        out.append((i[ok], j[ok]))
        if self.wide.any():
            for x, js in [(x, np.flatnonzero(live)) for x in q[self.wide[q]]] + [(x, np.flatnonzero(live & self.wide)) for x in few]:
                js = js[(js > x) & (self.group[js] == self.group[x])]
                out.append((np.full(len(js), x), js))
        i, j = (np.concatenate(x) for x in zip(*out, strict=True))
        return i, j


    def prune(self, live: np.ndarray) -> None:
        """Leaves only live boxes to be found, once enough of them are not."""
        keep = live[self.boxes]
        if 4 * np.count_nonzero(keep) < 3 * len(keep):
            self.start = np.concatenate([[0], np.cumsum(keep)])[self.start]
            self.boxes = self.boxes[keep]


#: Boxes settled at once.
BATCH = 512


def _matches(b: np.ndarray, area: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    p, o = b[i], b[j]
    w, h = np.minimum(p[:, 2], o[:, 2]) - np.maximum(p[:, 0], o[:, 0]), np.minimum(p[:, 3], o[:, 3]) - np.maximum(p[:, 1], o[:, 1])
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    den = area[i] + area[j] - inter if metric == "IOU" else np.minimum(area[i], area[j])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(den > 0, inter / den, 0.0)


def greedy(box: np.ndarray, score: np.ndarray, metric: str = "IOU", thr: float = 0.5, strict: bool = False, group: np.ndarray | None = None) -> np.ndarray:
    """For each box the position of the keeper that takes it: itself if kept, else the best-ranked keeper it matches.

    ``strict`` is the older variant: only more than the threshold matches, and equal scores keep their position.

    Boxes are settled batch by batch in rank order, and only those that no earlier keeper has taken look for neighbours; in a
    crowd that is a small part of them. Boxes of different ``group`` (small numbers) don't match; it asks for a threshold above 0."""
    n = len(box)
    rank = np.argsort(-score, kind="stable") if strict else order(box, score)
    if n and (thr < 0 or (thr == 0 and not strict)):
        return np.full(n, rank[0])
    b = box[rank]
    owner = np.arange(n)
    if n:
        cells, live, at, batch = _Cells(b, None if group is None else group[rank]), np.ones(n, bool), 0, _batch(group)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    while n and at < n:
        q = at + np.flatnonzero(live[at : at + 8 * batch])[:batch]
        if not len(q):
            at += 8 * batch
            continue
        q = q[: max(1, int(np.searchsorted(np.cumsum(cells.cost[q]), CHUNK, "right")))]
        at = int(q[-1]) + 1
        i, j = cells.near(q, live)
        v = _matches(b, area, i, j, metric)
        ok = v > thr if strict else v >= thr
        i, j = i[ok], j[ok]
        # within the batch one after the other; what lies behind it falls to the best of the batch's keepers
        inside = j < at
        for x, y in sorted(set(zip(i[inside].tolist(), j[inside].tolist(), strict=True))):
            if owner[x] == x and owner[y] == y:
                owner[y] = x
        first = ~inside & (owner[i] == i)
        i, j = i[first], j[first]
        taken = np.full(n - at, n)
        np.minimum.at(taken, j - at, i)
        hit = np.flatnonzero(taken < n)
        owner[at + hit] = taken[hit]
        live[at + hit] = False
        live[:at] = False
        cells.prune(live)
    out = np.empty(n, np.int64)
    out[rank] = rank[owner]
    return out


def _batch(group: np.ndarray | None) -> int:
    """Boxes settled at once: some of each group."""
    return BATCH if group is None else max(BATCH, 8 * (int(group.max(initial=0)) + 1))


def transitive(box: np.ndarray, score: np.ndarray, metric: str = "IOU", thr: float = 0.5, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(root, claim rank) of each box: a box hangs from the best-ranked box that matches and dominates it (higher score, or the
    same box and score again), and belongs to the root of that chain. The claim rank orders members within a root. ``group`` as in ``greedy``."""
    n = len(box)
    rank = order(box, score)
    b, s = box[rank], score[rank]
    parent = np.full(n, n, np.int64)
    if thr <= 0:
        if n:
            same = np.all(b == b[0], axis=1) & (s == s[0])
            parent[(s < s[0]) | same] = 0
            parent[0] = n
    elif n:
        # batch by batch in rank order: a box that has its best claim need not be found again
        cells, live, at, batch = _Cells(b, None if group is None else group[rank]), np.ones(n, bool), 0, _batch(group)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        upto = np.cumsum(cells.cost)
        while at < n and live[at:].any():
            end = min(n, at + 8 * batch, max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right"))))
            live[at] = False
            i, j = cells.near(np.arange(at, end), live)
            ok = (s[i] > s[j]) | np.all(b[i] == b[j], axis=1)
            i, j = i[ok], j[ok]
            ok = _matches(b, area, i, j, metric) >= thr
            np.minimum.at(parent, j[ok], i[ok])
            live[:end] = False
            live[parent < n] = False
            cells.prune(live)
            at = end
    root = np.where(parent < n, parent, np.arange(n))
    while True:
        up = root[root]
        if (up == root).all():
            break
        root = up
    out, claim = np.empty(n, np.int64), np.empty(n, np.int64)
    out[rank], claim[rank] = rank[root], np.where(parent < n, parent, -1)
    return out, claim


def member_order(owner: np.ndarray, claim: np.ndarray) -> np.ndarray:
    """Positions of the members (keepers left out), by owner, then by claim rank, then by position."""
    members = np.flatnonzero(owner != np.arange(len(owner)))
    return members[np.lexsort((members, claim[members], owner[members]))]


def fold_members(box: np.ndarray, score: np.ndarray, category: np.ndarray, owner: np.ndarray, members: np.ndarray, metric: str, thr: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members in order grow their keeper: the union box, the greater score, the category of the higher score (the member's on
    a tie), if they still overlap the grown box by more than thr; others are dropped. Returns corners, scores, categories and
    the number merged, by position, of which only keepers' rows mean anything, and whether each member was merged."""
    b, s, c, k = np.array(box, float).reshape(-1, 4), np.array(score, float), np.array(category), np.zeros(len(box), np.int64)
    old, took, at = b.copy(), np.zeros(len(box), bool), 0
    # the first members of all keepers at once, then the second ones, and so on; one by one where few keepers are left
    m = members[np.argsort(owner[members], kind="stable")]
    n = np.unique(owner[m], return_counts=True)[1]
    nth = np.arange(len(m)) - np.repeat(np.cumsum(n) - n, n)
    m = m[np.argsort(nth, kind="stable")]
    for n in np.bincount(nth).tolist():
        if n < 16:
            break
        x, at = m[at : at + n], at + n
        o = owner[x]
        inter, den = _meet(b[o], old[x], metric)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = x[(den > 0) & (inter / den > thr)]
        o = owner[x]
        b[o] = np.concatenate([np.minimum(b[o, :2], old[x, :2]), np.maximum(b[o, 2:], old[x, 2:])], axis=1)
        theirs = o[~(s[o] > score[x])]
        c[theirs] = category[x[~(s[o] > score[x])]]
        s[o] = np.maximum(s[o], score[x])
        k[o] += 1
        took[x] = True
    for x, o in zip(m[at:].tolist(), owner[m[at:]].tolist(), strict=True):
        inter, den = (float(v[0]) for v in _meet(b[o : o + 1], old[x : x + 1], metric))
        if den > 0 and inter / den > thr:
            b[o] = [*np.minimum(b[o, :2], old[x, :2]), *np.maximum(b[o, 2:], old[x, 2:])]
            if not s[o] > score[x]:
                c[o] = category[x]
            s[o] = max(s[o], float(score[x]))
            k[o] += 1
            took[x] = True
    return b, s, c, k, took


def _meet(p: np.ndarray, o: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(intersection, denominator) of boxes in pairs."""
    w, h = np.minimum(p[:, 2], o[:, 2]) - np.maximum(p[:, 0], o[:, 0]), np.minimum(p[:, 3], o[:, 3]) - np.maximum(p[:, 1], o[:, 1])
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    a, b = (p[:, 2] - p[:, 0]) * (p[:, 3] - p[:, 1]), (o[:, 2] - o[:, 0]) * (o[:, 3] - o[:, 1])
    return inter, (a + b - inter if metric == "IOU" else np.minimum(a, b))


def fold(*args) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``fold_members`` without the last."""
    return fold_members(*args)[:4]


def union_merge(box: np.ndarray, score: np.ndarray, metric: str, thr: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keeper positions, grown corners, number merged): the best box left takes, in score order, whatever overlaps it by more
    than thr as it has grown so far."""
    left = np.argsort(-score, kind="stable")
    keep, grown, n = [], [], []
    while len(left):
        k, rest = left[0], left[1:]
        b, at, taken = box[k].copy(), 0, np.zeros(len(rest), bool)
        while at < len(rest):
            hit = np.flatnonzero(_match(b, box[rest[at:]], metric, thr, strict=True))
            if not len(hit):
                break
            at += int(hit[0])
            m = rest[at]
            taken[at] = True
            b[:2], b[2:] = np.minimum(b[:2], box[m, :2]), np.maximum(b[2:], box[m, 2:])
            at += 1
        keep.append(k), grown.append(b), n.append(int(taken.sum()))
        left = rest[~taken]
    return np.array(keep, np.int64), np.array(grown).reshape(-1, 4), np.array(n, np.int64)
