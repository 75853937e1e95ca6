"""Detection evaluation by the public COCO protocol, and its error breakdown."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import polygons as P
from tilewright.operators.merge import buckets
from tilewright.session import fits_broadcast, ship_package

IOU_THRESHOLDS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
AREAS = (1024.0, 9216.0, 1e10)
AREA_LABELS = ("all", "s", "m", "l")
MAX_DETECTIONS = 500
#: Score buckets of the two-level running sums.
BUCKETS = 1000


def area_ranges(areas: Sequence[float] = AREAS) -> list[tuple[float, float]]:
    a, b, c = areas
    return [(0.0, c), (0.0, a), (a, b), (b, c)]


def match_image(near: list[list[tuple[int, float]]], crowd: Sequence[bool], ignore: Sequence[bool], thr: float) -> list[int]:
    """For each detection, in order, the ground truth it takes or -1: the best free one of at least thr, a real one before an
    ignored one, the later of equals; crowds can be taken again."""
    taken: set[int] = set()
    out = []
    thr = min(thr, 1 - 1e-10)
    for cands in near:
        best, m, real = thr, -1, False
        for g, v in cands:
            if v < thr or (g in taken and not crowd[g]):
                continue
            if ignore[g]:
                if not real and v >= best:
                    best, m = v, g
            elif not real or v >= best:
                best, m, real = v, g, True
        if m >= 0:
            taken.add(m)
        out.append(m)
    return out


#: tp and ignored hold a bit for each threshold; gt_id, an element for each, is given for the area label "all" only.
_OUT = pa.schema([("category_id", pa.int32()), ("id", pa.int64()), ("score", pa.float64()), ("area_lbl", pa.string()), ("tp", pa.int32()), ("ignored", pa.int32()), ("gt_id", pa.list_(pa.int64()))])
_OUT_DDL = "category_id int, id bigint, score double, area_lbl string, tp int, ignored int, gt_id array<bigint>"


def _codes(d: pa.Table, g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """One number per (image, category), common to both tables."""
    n = d.num_rows
    part = []
    for c in ("image_id", "category_id"):
        both = np.concatenate([np.asarray(d.column(c), np.int64), np.asarray(g.column(c), np.int64)])
        part.append(np.unique(both, return_inverse=True)[1])
    code = part[0] * (int(part[1].max(initial=0)) + 1) + part[1]
    return code[:n], code[n:]


#: Pairs of boxes looked at in one go; bounds the memory, not the number of detections or of ground truth.
CHUNK = 1 << 22


def _near(d: np.ndarray, dcode: np.ndarray, darea: np.ndarray, g: np.ndarray, gcode: np.ndarray, crowd: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(detection, truth, overlap) of each pair of one image and category that overlaps by ``least``, in order: a sweep along x, by
    the truth's left edges, between those that start beyond the detection and those too narrow to reach it."""
    if not len(d) or not len(g):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    low = min(d[:, 0].min(), g[:, 0].min())
    span = 2.0 * (max(d[:, 2].max(), g[:, 2].max()) - low) + 1.0
    widest = np.zeros(int(max(dcode.max(), gcode.max())) + 1)
    np.maximum.at(widest, gcode, g[:, 2] - g[:, 0])
    key = gcode * span + (g[:, 0] - low)
    o = np.argsort(key, kind="stable")
    key = key[o]
    slack = 1e-9 * (abs(key[-1]) + span)
    base = dcode * span
    first = np.searchsorted(key, np.maximum(base, base + (d[:, 0] - low) - widest[dcode]) - slack, "left")
    n = np.maximum(np.searchsorted(key, base + (d[:, 2] - low) + slack, "right") - first, 0)
    own = (g[:, 2] - g[:, 0]) * (g[:, 3] - g[:, 1])
    out, at, total = [], 0, np.cumsum(n)
    while at < len(d):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
        m = n[at:to]
        di = np.repeat(np.arange(at, to), m)
        gi = o[np.repeat(first[at:to] - (np.cumsum(m) - m), m) + np.arange(len(di))]
        same = gcode[gi] == dcode[di]
        di, gi = di[same], gi[same]
        w = np.minimum(d[di, 2], g[gi, 2]) - np.maximum(d[di, 0], g[gi, 0])
        h = np.minimum(d[di, 3], g[gi, 3]) - np.maximum(d[di, 1], g[gi, 1])
        inter = np.maximum(w, 0) * np.maximum(h, 0)
        den = np.where(crowd[gi], darea[di], darea[di] + own[gi] - inter)
        with np.errstate(divide="ignore", invalid="ignore"):
            iou = np.where(den > 0, inter / den, 0.0)
        near = iou >= least
        out.append((di[near], gi[near], iou[near]))
        at = to
    di, gi, iou = (np.concatenate(x) for x in zip(*out, strict=True))
    o = np.lexsort((gi, di))
    return di[o], gi[o], iou[o]


def _matcher(thresholds: Sequence[float], ranges: list[tuple[float, float]], masks: bool = False):
    """Pairs of a bucket are found all at once. A pair of which neither side overlaps anything else is settled by comparing its
    overlap with the thresholds; only what competes is matched one by one."""
    cuts = [min(t, 1 - 1e-10) for t in thresholds]
    k = len(cuts)
    everywhere = (1 << k) - 1

    def f(dets: pa.Table, gts: pa.Table) -> pa.Table:
        corner = lambda t: np.stack([np.asarray(t.column(c), np.float64) for c in ("x1", "y1", "x2", "y2")], axis=1).reshape(-1, 4)
        dcode, gcode = _codes(dets, gts)
        do = np.lexsort((np.asarray(dets.column("id")), -np.asarray(dets.column("score")), dcode))
        go = np.lexsort((np.asarray(gts.column("id")), gcode))
        dets, dcode, gts, gcode = dets.take(pa.array(do)), dcode[do], gts.take(pa.array(go)), gcode[go]
        d, g, nd = corner(dets), corner(gts), len(dcode)
        crowd, gid = np.asarray(gts.column("iscrowd")).astype(bool), np.asarray(gts.column("id"), np.int64)
        garea, darea = np.asarray(gts.column("area"), np.float64), (d[:, 2] - d[:, 0]) * (d[:, 3] - d[:, 1])
        if masks:
            darea = np.asarray(dets.column("area"), np.float64)
        di, gi, iou = _near(d, dcode, darea, g, gcode, crowd, -1.0 if masks else min(cuts))
        if masks:
            iou = P.pair_overlaps(P.Rings.of_arrow(dets.column("segmentation")), P.Rings.of_arrow(gts.column("segmentation")), di, gi, crowd[gi])
            on = iou >= min(cuts)
            di, gi, iou = di[on], gi[on], iou[on]
        alone = (np.bincount(di, minlength=nd)[di] == 1) & (np.bincount(gi, minlength=len(gcode))[gi] == 1)
        hits = np.zeros(len(di), np.int64)
        for t, cut in enumerate(cuts):
            hits |= (iou >= cut).astype(np.int64) << t
        sd, sg, sh = di[alone], gi[alone], hits[alone]
        rest: dict[int, dict[int, list[tuple[int, float]]]] = {}
        for a, b, v in zip(di[~alone].tolist(), gi[~alone].tolist(), iou[~alone].tolist(), strict=True):
            rest.setdefault(int(dcode[a]), {}).setdefault(a, []).append((b, v))
        crowds, to = crowd.tolist(), np.full((nd, k), -1, np.int64)
        tps, skips, rows = [], [], []
        for r, (lo, hi) in enumerate(ranges):
            ign = crowd | (garea < lo) | (garea > hi)
            tp, skip = np.zeros(nd, np.int32), np.where((darea < lo) | (darea > hi), everywhere, 0).astype(np.int32)
            tp[sd] = np.where(ign[sg], 0, sh)
            skip[sd] = np.where(ign[sg], skip[sd] | sh, skip[sd] & ~sh)
            if r == 0:
                to[sd] = np.where((sh[:, None] >> np.arange(k)) & 1, gid[sg][:, None], -1)
            ignored = ign.tolist()
            for group in rest.values():
                who = list(group)
                for t, cut in enumerate(cuts):
                    for a, m in zip(who, match_image(list(group.values()), crowds, ignored, cut), strict=True):
                        if m >= 0:
                            if ignored[m]:
                                skip[a] |= 1 << t
                            else:
                                tp[a] |= 1 << t
                                skip[a] &= ~(1 << t)
                            if r == 0:
                                to[a, t] = gid[m]
            # outside its range a detection that matched nothing counts nowhere
            on = np.arange(nd) if r == 0 else np.flatnonzero((tp != 0) | (skip != everywhere))
            tps.append(tp[on]), skips.append(skip[on]), rows.append(on)
        all_, rest_n = nd, sum(map(len, rows[1:]))
        gt_ids = pa.concat_arrays([pa.ListArray.from_arrays(pa.array(np.arange(all_ + 1) * k, pa.int32()), pa.array(to.ravel())), pa.nulls(rest_n, pa.list_(pa.int64()))])
        of = lambda c, t: pa.concat_arrays([pa.array(np.asarray(dets.column(c))[on], t) for on in rows])
        lbl = pa.array(np.repeat(AREA_LABELS[: len(ranges)], [len(on) for on in rows]).tolist(), pa.string())
        return pa.table([of("category_id", pa.int32()), of("id", pa.int64()), of("score", pa.float64()), lbl, pa.array(np.concatenate(tps)), pa.array(np.concatenate(skips)), gt_ids], schema=_OUT)

    return f


def top_detections(dets: DataFrame, n: int = MAX_DETECTIONS) -> DataFrame:
    w = Window.partitionBy("image_id", "category_id").orderBy(F.col("score").desc(), "id")
    return dets.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def matches(dets: DataFrame, truth: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS, areas: Sequence[float] = AREAS, max_detections: int = MAX_DETECTIONS, masks: bool = False) -> DataFrame:
    """(category_id, id, score, area_lbl, tp, ignored, gt_id[]): a bit, or an element, for each IoU threshold.

    dets(id, image_id, category_id, score, x1..y2); truth(id, image_id, category_id, iscrowd, x1..y2). Each image and category
    is matched by itself, its best max_detections only; many of them share an Arrow batch, by a hash whose range follows the number of detections. The
    smaller area labels have rows for what counts in them only.

    ``masks``: both sides carry a segmentation, and it is pixels that overlap, not boxes (which still tell who can meet)."""
    ship_package(dets.sparkSession)
    box = [F.col(k).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")]
    seg = [F.col("segmentation").cast("array<array<double>>").alias("segmentation")] if masks else []
    drawn = [F.coalesce(P.area_exact(F.col("segmentation")), F.lit(0.0)).alias("area")] if masks else []
    keys = [F.col("image_id").cast("bigint").alias("image_id"), F.col("category_id").cast("int").alias("category_id"), F.col("id").cast("bigint").alias("id")]
    d = top_detections(dets.select(*keys, F.col("score").cast("double").alias("score"), *box, *seg, *drawn), max_detections)
    area = F.col("area") if "area" in truth.columns else (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    g = truth.select(*keys, F.col("iscrowd").cast("int").alias("iscrowd"), area.cast("double").alias("area"), *box, *seg)
    f = _matcher(thresholds, area_ranges(areas), masks)
    n = buckets(dets, dets.count())
    by = F.pmod(F.xxhash64("image_id", "category_id"), F.lit(n)).alias("bucket")
    return d.groupBy(by).cogroup(g.groupBy(by)).applyInArrow(f, _OUT_DDL)


def truth_counts(truth: DataFrame, areas: Sequence[float] = AREAS) -> DataFrame:
    """(category_id, area_lbl, npig): ground truth that counts, per area range."""
    area = F.col("area") if "area" in truth.columns else (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    inside = [F.when((area >= lo) & (area <= hi) & (F.coalesce("iscrowd", F.lit(0)) == 0), lbl) for lbl, (lo, hi) in zip(AREA_LABELS, area_ranges(areas), strict=True)]
    t = truth.select("category_id", F.explode(F.array_compact(F.array(*inside))).alias("area_lbl"))
    return t.groupBy("category_id", "area_lbl").agg(F.count("*").alias("npig"))


_BEST = pa.schema([("category_id", pa.int32()), ("area_lbl", pa.string()), ("t", pa.int32()), ("k", pa.int32()), ("p", pa.float64())])


def _best_of(n_thresholds: int):
    """Running sums of all thresholds over the score buckets of one hash, and the best precision at each recall in each bucket."""
    t = np.arange(n_thresholds)

    def f(rows: pa.Table, starts: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _BEST.empty_table()
        both = [np.concatenate([np.asarray(x.column(c).to_numpy(zero_copy_only=False)) for x in (rows, starts)]) for c in ("category_id", "area_lbl", "b")]
        code = np.zeros(len(both[0]), np.int64)
        for c in both:
            u, inv = np.unique(c, return_inverse=True)
            code = code * len(u) + inv
        code, at = code[: rows.num_rows], {c: k for k, c in enumerate(code[rows.num_rows :].tolist())}
        o = np.lexsort((np.asarray(rows.column("id")), -np.asarray(rows.column("score")), code))
        code = code[o]
        first = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])
        which = np.array([at[c] for c in code[first].tolist()])
        seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
        ign = (np.asarray(rows.column("ignored"))[o][:, None] >> t) & 1
        hit = ((np.asarray(rows.column("tp"))[o][:, None] >> t) & 1) & ~ign

        def running(x: np.ndarray, before: str) -> np.ndarray:
            c = np.cumsum(x, axis=0, dtype=np.int64)
            start = np.vstack([np.zeros(n_thresholds, np.int64), c])[first]
            own = np.stack([np.asarray(v) for v in starts.column(before).to_pylist()])[which]
            return c + (own - start)[seg]

        tp, seen = running(hit, "hits"), running(1 - ign, "seen")
        npig = np.asarray(starts.column("npig"))[which][seg]
        out = []
        for j in range(n_thresholds):
            r = np.flatnonzero(hit[:, j])
            if not len(r):
                continue
            k, p = tp[r, j] * 100 // npig[r], tp[r, j] / seen[r, j]
            new = np.concatenate([[0], np.flatnonzero((np.diff(seg[r]) != 0) | (np.diff(k) != 0)) + 1])
            out.append((which[seg[r[new]]], np.full(len(new), j), k[new], np.maximum.reduceat(p, new)))
        if not out:
            return _BEST.empty_table()
        w, j, k, p = (np.concatenate(x) for x in zip(*out, strict=True))
        key = starts.take(pa.array(w))
        return pa.table([key.column("category_id").cast(pa.int32()), key.column("area_lbl"), pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(p)], schema=_BEST)

    return f


def best_precisions(m: DataFrame, npig: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS) -> DataFrame:
    """(category_id, area_lbl, iou_thr, k, p): the best precision among the hits at each whole percent k of recall that is reached.

    Precision falls behind a detection that is no hit, so its best values stand at hits. The running sums have two levels: the
    totals of buckets of scores are summed in a table of at most BUCKETS + 1 rows for each category and area, and within the
    buckets the detections are, all thresholds at once, so that a category with most of them is summed by as many tasks as it
    has buckets."""
    n = len(thresholds)
    bit = lambda c, k: F.getbit(F.col(c), F.lit(k)).cast("int")
    key = ["category_id", "area_lbl"]
    each = m.select(F.col("category_id").cast("int").alias("category_id"), "area_lbl", "score", "id", "tp", "ignored", F.greatest(F.lit(0), F.least(F.lit(BUCKETS), F.floor(F.col("score") * BUCKETS).cast("int"))).alias("b"))
    sums = [F.sum(bit("tp", k) * (1 - bit("ignored", k))).alias(f"t{k}") for k in range(n)] + [F.sum(1 - bit("ignored", k)).alias(f"n{k}") for k in range(n)]
    totals = each.groupBy(*key, "b").agg(*sums)
    before = Window.partitionBy(*key).orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.array(*[F.coalesce(F.sum(f"{c}{k}").over(before), F.lit(0)) for k in range(n)])
    starts = totals.select(*key, "b", upto("t").alias("hits"), upto("n").alias("seen")).join(_small(npig), key)
    ship_package(m.sparkSession)
    by = F.pmod(F.xxhash64(*key, "b"), F.lit(buckets(each, each.count())))
    rows = each.join(_small(npig.select(*key)), key, "left_semi").withColumn("bucket", by)
    starts = starts.withColumn("bucket", by)
    starts = starts.toDF(*starts.columns)
    best = rows.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(_best_of(n), "category_id int, area_lbl string, t int, k int, p double")
    at = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("t") + 1)
    return best.groupBy(*key, at.alias("iou_thr"), "k").agg(F.max("p").alias("p"))


def _small(d: DataFrame, width: int = 64) -> DataFrame:
    return F.broadcast(d) if fits_broadcast(d, width) else d


def pr_curve(m: DataFrame, npig: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS) -> DataFrame:
    """(category_id, area_lbl, iou_thr, rec_pct, precision) at 101 recall points: the best precision at that recall or a higher
    one, 0 beyond the last. Groups without ground truth have no rows."""
    at = best_precisions(m, npig, thresholds)
    grid = npig.crossJoin(F.broadcast(m.sparkSession.createDataFrame([(float(t),) for t in thresholds], "iou_thr double"))).select("category_id", "area_lbl", "iou_thr", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("k"))
    down = Window.partitionBy("category_id", "area_lbl", "iou_thr").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(at, ["category_id", "area_lbl", "iou_thr", "k"], "left").select("category_id", "area_lbl", "iou_thr", F.col("k").alias("rec_pct"), F.coalesce(F.max("p").over(down), F.lit(0.0)).alias("precision"))


def max_recall(m: DataFrame, npig: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS) -> DataFrame:
    sums = m.groupBy("category_id", "area_lbl").agg(*[F.sum((F.getbit("tp", F.lit(k)).cast("int")) * (1 - F.getbit("ignored", F.lit(k)).cast("int"))).alias(str(k)) for k in range(len(thresholds))])
    each = sums.select("category_id", "area_lbl", F.posexplode(F.array(*[F.col(str(k)) for k in range(len(thresholds))])).alias("k", "tp"))
    grid = npig.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1))).alias("k"))
    r = grid.join(each, ["category_id", "area_lbl", "k"], "left")
    return r.select("category_id", "area_lbl", F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("k") + 1).alias("iou_thr"), (F.coalesce("tp", F.lit(0)) / F.col("npig")).alias("recall"))


def summary(curve: DataFrame, recall: DataFrame) -> DataFrame:
    """(metric, value) of the twelve headline figures; -1 where nothing is defined."""
    near = lambda t: F.abs(F.col("iou_thr") - t) < 1e-9
    of = lambda cond: F.coalesce(F.round(F.avg(F.when(cond, F.col("v"))), 6), F.lit(-1.0))
    a = {"mAP": F.col("area_lbl") == "all", "mAP75": (F.col("area_lbl") == "all") & near(0.75), "mAP50": (F.col("area_lbl") == "all") & near(0.5)}
    for s in "sml":
        a[f"mAP_{s}"], a[f"mAP50_{s}"] = F.col("area_lbl") == s, (F.col("area_lbl") == s) & near(0.5)
    p = curve.groupBy("area_lbl", "iou_thr", "category_id").agg(F.avg("precision").alias("v")).agg(*[of(c).alias(k) for k, c in a.items()])
    r = recall.withColumn("v", F.col("recall")).agg(*[of(F.col("area_lbl") == s).alias(f"AR_{s}") for s in "sml"])
    both = p.crossJoin(F.broadcast(r))
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in both.columns])).alias("z")).select("z.*")


def classwise(curve: DataFrame) -> DataFrame:
    """Per category, average precision over the thresholds, at 0.5 and at 0.75, and by area, over the thresholds and at 0.5."""
    v = curve.groupBy("category_id").agg(
        F.round(F.avg(F.when(F.col("area_lbl") == "all", F.col("precision"))), 6).alias("mAP"),
        F.round(F.avg(F.when((F.col("area_lbl") == "all") & (F.abs(F.col("iou_thr") - 0.5) < 1e-9), F.col("precision"))), 6).alias("mAP50"),
        F.round(F.avg(F.when((F.col("area_lbl") == "all") & (F.abs(F.col("iou_thr") - 0.75) < 1e-9), F.col("precision"))), 6).alias("mAP75"),
        *[F.round(F.avg(F.when(F.col("area_lbl") == s, F.col("precision"))), 6).alias(f"mAP_{s}") for s in "sml"],
        *[F.round(F.avg(F.when((F.col("area_lbl") == s) & (F.abs(F.col("iou_thr") - 0.5) < 1e-9), F.col("precision"))), 6).alias(f"mAP50_{s}") for s in "sml"],
    )
    return v


def error_layers(dets: DataFrame, truth: DataFrame, categories: DataFrame, areas: Sequence[float] = AREAS) -> DataFrame:
    """(category_id, layer, area_lbl, precision): mean precision as classes of error are forgiven one after the other.

    C75, C50 and Loc are IoU 0.75, 0.5 and 0.1; Sim and Oth, at 0.1, turn ground truth of the same supercategory, or all other,
    into ignored crowd of the class; BG is 1 where Oth has any precision; FN is 1. Each class sees its own rewriting of the
    truth, expanded only to classes that have detections in the image."""
    base = matches(dets, truth, (0.75, 0.5, 0.1), areas)
    npig = truth_counts(truth, areas)
    name = {0.75: "C75", 0.5: "C50", 0.1: "Loc"}
    named = F.create_map(*[x for t, n in name.items() for x in (F.lit(t), F.lit(n))])
    c = pr_curve(base, npig, (0.75, 0.5, 0.1)).groupBy("category_id", "area_lbl", "iou_thr").agg(F.avg("precision").alias("precision"))
    out = c.select("category_id", F.element_at(named, F.col("iou_thr")).alias("layer"), "area_lbl", "precision")
    super_of = categories.select("category_id", "supercategory")
    asked = dets.select("image_id", F.col("category_id").alias("as_category")).distinct().join(_small(super_of.toDF("as_category", "as_super")), "as_category")
    area = F.col("area") if "area" in truth.columns else (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    t = truth.withColumn("area", area).join(_small(super_of), "category_id", "left")
    others = t.join(asked, "image_id").filter(F.col("category_id") != F.col("as_category"))
    cols = ["id", "image_id", "category_id", "iscrowd", "area", "x1", "y1", "x2", "y2"]
    for layer, cond in (("Sim", F.col("supercategory") == F.col("as_super")), ("Oth", F.lit(True))):
        extra = others.filter(cond).withColumn("category_id", F.col("as_category")).withColumn("iscrowd", F.lit(1))
        own = t.withColumn("iscrowd", F.coalesce("iscrowd", F.lit(0)))
        m = matches(dets, own.select(*cols).unionByName(extra.select(*cols)), (0.1,), areas)
        out = out.unionByName(pr_curve(m, npig, (0.1,)).groupBy("category_id", "area_lbl").agg(F.avg("precision").alias("precision")).select("category_id", F.lit(layer).alias("layer"), "area_lbl", "precision"))
    oth = out.filter("layer = 'Oth'")
    bg = oth.withColumn("layer", F.lit("BG")).withColumn("precision", F.when(F.col("precision") > 0, 1.0).otherwise(0.0))
    return out.unionByName(bg).unionByName(oth.withColumn("layer", F.lit("FN")).withColumn("precision", F.lit(1.0)))


def area_histogram(truth: DataFrame, bins: int = 100) -> DataFrame:
    """(bin, n): histogram of the square root of the area over its own range."""
    s = truth.select(F.sqrt((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("s"))
    r = s.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("s") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int"))
    return s.crossJoin(F.broadcast(r)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
