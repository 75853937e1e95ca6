"""Splits, top n, cutoffs, pieces and consolidation against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm.consolidate import matched_groups, seed_tree, usable, with_representatives
from tilewright.llm.cutoff import kept_fraction, with_source
from tilewright.llm.pieces import grow, image_sizes, oversized_pieces, pack_axis, size_in_name
from tilewright.llm.splits import large_star_small_star, related_groups, source_key, split_of
from tilewright.llm.topn import top_n
from tilewright.session import Scratch


def union_find(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    low = {}
    for v in list(up):
        low[root(v)] = min(low.get(root(v), v), v)
    return {v: low[root(v)] for v in up}


def graphs():
    r = random.Random(3)
    yield "none", []
    yield "loops", [(1, 1), (2, 2)]
    yield "chain", [(i, i + 1) for i in range(200)]
    yield "shuffled chain", list(zip(p := r.sample(range(10_000), 150), p[1:], strict=False))
    yield "star", [(7, i) for i in range(100, 400)]
    yield "random", [(r.randrange(300), r.randrange(300)) for _ in range(200)] * 2


@pytest.mark.parametrize(("name", "pairs"), list(graphs()))
def test_components_both_ways(spark, name, pairs):
    want = union_find([p for p in pairs if p[0] != p[1]])
    df = spark.createDataFrame([(*p, "x") for p in pairs], "a bigint, b bigint, seed string")
    got = {r.v: r.seed for r in seed_tree(df, Scratch(spark, "t")).collect()}
    assert got == want
    e = df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    assert {r.u: r.root for r in large_star_small_star(e, Scratch(spark, "t")).collect()} == want


def test_related_groups(spark):
    rows = [(1, "s", None, 9), (2, "s", "p", 9), (3, None, "p", 9), (4, "q", None, 9), (5, None, None, 9), (5, None, None, 9), (None, "s", "q", 9), (6, "p", None, 9)]
    df = spark.createDataFrame(rows, "record_id bigint, source string, author string, group_id int")
    got = {r.record_id: (r.group_id, r.linked) for r in related_groups(df, "record_id", ["source", "author"]).collect()}
    # 'p' as a source is another entity than 'p' as an author
    assert got == {1: (1, True), 2: (1, True), 3: (1, True), 4: (4, False), 5: (5, False), 6: (6, False)}
    assert related_groups(df.limit(0), "record_id", ["source"]).count() == 0


def test_source_names(spark):
    same = ["mnt/store/b2/north_ridge_20230704_f16_001215.png", "./in/north%20ridge%202023-07-04%20f16%20001215.jpg", "D:\\survey\\raw\\North Ridge 20230704 f16 01215 - Copy.JPG", "export/2024/NORTH_RIDGE_20230704_F16_001215_12_0_24_90.tif", "north-ridge-2023-07-04-F16-1215_w640h480.png", "north.ridge.20230704.f16.1215@2x.png", "northridge_20230704_f016_1215_v2.tif"]
    other = ["north_ridge_20230705_f16_001215.png", "north_ridge_20230704_f15_001215.png", "north_ridge_20230704_f16_001216.png", "south_ridge_20230704_f16_001215.png"]
    none = [None, "", "20230704_f16_001215.png", "north_ridge_20230704_001215.png", "notes.txt"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate([*same, *other, *none])], "i int, n string")
    k = {r.i: r.k for r in df.select("i", source_key(F.col("n")).alias("k")).collect()}
    assert len({k[i] for i in range(len(same))}) == 1 and k[0] is not None
    assert len({k[i] for i in range(len(same) + len(other))}) == 1 + len(other)
    assert all(k[len(same) + len(other) + i] is None for i in range(len(none)))


def test_split_shares(spark):
    df = spark.range(20_000).select(split_of(F.col("id"), [("train", 80), ("validation", 10), ("test", 10)]).alias("s"))
    n = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert abs(n["train"] - 16_000) < 300 and abs(n["test"] - 2000) < 200


def test_top_n(spark):
    r = random.Random(1)
    rows = [(g, i, r.choice([0.1, 0.5, 0.5, 0.9, None, float("nan")]), 0) for g in (1, 2, 3, None) for i in [r.randrange(50) + 100 * (g or 0) for _ in range(60)]]
    rows = [(g, i, {0: 0.5, 1: 0.9, 2: None, 3: float("nan"), 4: 0.1}[i % 5], x) for g, i, _, x in rows] + [(9, None, 0.5, 0), (8, 1, 0.5, 0)]
    want = []
    for g in (1, 2, 3, 8):
        best = sorted({(-s, i) for h, i, s, _ in rows if h == g and i is not None and s is not None and not math.isnan(s)})[:3]
        want += [(g, i, k + 1) for k, (_, i) in enumerate(best)]
    df = spark.createDataFrame(rows, "g int, i int, s double, rank_no int")
    assert sorted(map(tuple, top_n(df, "g", "s", "i", 3).collect())) == sorted(want)
    assert top_n(df.limit(0), "g", "s", "i", 3).count() == 0


def brute_cut(items, pct):
    out = {}
    for src in {s for s, *_ in items}:
        own = sorted({(sc, i) for s, sc, i in items if s == src and sc is not None and 0 <= sc <= 1}, reverse=True)
        if src in pct and own:
            ok = [c for c, _ in own if 100 * sum(s >= c for s, _ in own) >= pct[src] * len(own)]
            if ok:
                out[src] = (max(ok), {i for s, i in own if s >= max(ok)})
    return out


def test_cutoffs_equal_brute_force(spark):
    r = random.Random(5)
    items = [("hot", r.choice([0.5, 0.25, 0.75]), i) for i in range(500)] + [(f"s{i % 7}", round(r.random(), 2), 1000 + i) for i in range(300)] + [("s1", v, 5000 + k) for k, v in enumerate([None, float("nan"), -1.0, 2.0, 0.0, 1.0])] + [(None, 0.5, 7000)]
    items += items[::9]
    pct = {"hot": 40, "s0": 100, "s1": 1, "s2": 0, "s3": 50, "s4": 33, "s5": 120, "absent": 5}
    df = spark.createDataFrame([(*i, 0, "z") for i in items], "source string, score double, det_id bigint, part int, cutoff string")
    t = spark.createDataFrame([*pct.items(), ("s6", None)], "category_name string, keep_pct int")
    kept, report = kept_fraction(df, t)
    want = brute_cut([i for i in items if i[0] and (i[1] is None or not math.isnan(i[1]))], pct)
    got = defaultdict(set)
    for row in kept.collect():
        got[row.source].add(row.det_id)
    assert dict(got) == {s: ids for s, (_, ids) in want.items()}
    assert {r.source: (r.cutoff, r.n_kept) for r in report.collect()} == {s: (c, len(ids)) for s, (c, ids) in want.items()}
    kept, report = kept_fraction(df.limit(0), t)
    assert kept.count() == 0 and report.count() == 0


def test_source_spellings(spark):
    t = spark.createDataFrame([("haul truck", 50), ("rider", 10), (" ", 1)], "category_name string, keep_pct int")
    c = spark.createDataFrame([(1, "rider", "x"), (2, None, "x"), (3, "other", "x")], "id int, name string, score string")
    names = [("Haul_Truck", 1, "haul truck"), ("\tHAUL\xa0truck ", 1, "haul truck"), ("ｈａｕｌ－ｔｒｕｃｋ", None, "haul truck"), ("HaulTruck", 3, "haul truck"), (None, 1, "rider"), (" \xa0", 1, "rider"), ("", 2, None), ("n/a", 1, None), ("lorry", 1, None), (None, None, None)]
    d = spark.createDataFrame([(i, 0.5, n, k) for i, (n, k, _) in enumerate(names)], "det_id bigint, score double, category_name string, category_id int")
    assert {r.det_id: r.source for r in with_source(d, t, c).collect()} == {i: s for i, (_, _, s) in enumerate(names) if s}


def test_packing():
    none = np.empty(0, np.int64)
    assert pack_axis(2048, none) == [(0, 2048)]
    assert pack_axis(2049, none) == [(0, 2048), (1888, 2049)]
    assert pack_axis(5000, np.array([160, 161, 2000, 2048])) == [(0, 2048), (1888, 3936), (3776, 5000)]
    assert pack_axis(5000, np.array([2048, 2049])) == [(0, 2048), (1888, 2049), (1889, 3937), (3777, 5000)]
    assert pack_axis(5000, np.array([100, 160])) == [(0, 2048), (1888, 3936), (3776, 5000)]
    assert pack_axis(3000, np.array([161])) == [(0, 161), (1, 2049), (1889, 3000)]
    r = random.Random(2)
    for _ in range(200):
        n, seams = r.randint(1, 20_000), np.array(sorted(r.sample(range(1, 20_000), 15)))
        p = pack_axis(n, seams)
        assert p[0][0] == 0 and p[-1][1] == n and all(0 < b - a <= 2048 for a, b in p) and all(b - c == 160 for (_, b), (c, _) in zip(p, p[1:], strict=False))


def greedy(length, seams, limit, overlap):
    out, s = [], 0
    while length - s > limit:
        e = max((p for p in seams if s + overlap < p <= s + limit and p < length), default=s + limit)
        out.append((s, e))
        s = e - overlap
    return [*out, (s, length)]


def test_tree_packs_as_the_rule_says():
    r = random.Random(5)
    for _ in range(2000):
        n, limit = r.randint(1, 600), r.randint(5, 60)
        overlap = r.randrange(limit)
        seams = [r.randint(-20, 620) for _ in range(r.randrange(80))]
        assert pack_axis(n, np.array(seams, np.int64), limit, overlap) == greedy(n, seams, limit, overlap)
        parts = grow(n, sorted({p for p in seams if 0 < p < n}), limit)
        todo = list(parts)
        while todo:
            a, b, inner = todo.pop()
            assert not inner or (b - a <= limit and inner[0][0] == a and inner[-1][1] == b and inner[0][1] == inner[1][0])
            todo += inner
        assert all(x[1] == y[0] and (y[1] - x[0] > limit) for x, y in zip(parts[:-1], parts[1:]) if x[1] - x[0] <= limit and y[1] - y[0] <= limit)


def test_pieces(spark):
    im = spark.createDataFrame([(1, "a.jpg", 100, 3000), (1, "a.jpg", None, None), (2, "b_w2100h50.png", 0, 0), (3, "c.png", None, None), (4, "d.png", 2048, 2048), (None, "e.png", 9000, 9000), (5, "f_2500x2500 (1).jpg", -1, -1)], "id bigint, file_name string, height int, width int")
    s = spark.createDataFrame([(1, " X", 1500, 3), (1, "x", 1500, 3), (1, "x", None, 3), (1, "x", -4, 3), (1, "x", 9999, 3), (1, None, 700, 3), (1, "y", 50, 3), (9, "x", 5, 3), (None, "x", 5, 3), (5, "y", 2000, 3)], "image_id bigint, axis string, pos int, width int")
    got = sorted(map(tuple, oversized_pieces(image_sizes(im), s).collect()))
    ax, ay = [(0, 2048), (1888, 2500)], [(0, 2000), (1840, 2500)]
    assert got == sorted([(1, 0, 0, 1500, 100), (1, 1340, 0, 3000, 100), (2, 0, 0, 2048, 50), (2, 1888, 0, 2100, 50), *[(5, a, c, b, e) for a, b in ax for c, e in ay]])
    assert oversized_pieces(image_sizes(im.limit(0)), s.limit(0)).count() == 0
    with pytest.raises(ValueError):
        oversized_pieces(image_sizes(im), s, 100, 100)


def test_sizes_in_names(spark):
    names = {"a_20230704_f16_001215_800x600.jpg": (800, 600), "x_w640h480.PNG": (640, 480), "x_2321w_1689h.tif": (2321, 1689), "x-1600X600px.jpg": (1600, 600), "x_10_20_110_220.tiff": (100, 200), "x_20230704_f16_001215.jpg": None, "x@2x.png": None, "x_v2.jpg": None, "x (1).jpg": None, None: None, "x_0x0.png": None, "x_99999999999x4.png": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: tuple(r.s) if r.s else None for r in df.select("n", size_in_name(F.col("n")).alias("s")).collect()}
    assert got == names


def brute_matches(rows):
    ok = {}
    for image, det, box, score in rows:
        if image is not None and score is not None and 0.1 <= score <= 1 and box is not None and len(box) == 4 and all(v is not None for v in box) and box[2] > 0 and box[3] > 0:
            ok[det] = (image, box[0], box[1], box[0] + box[2], box[1] + box[3])
    pairs = []
    ids = sorted(ok)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            p, q = ok[i], ok[j]
            if p[0] == q[0]:
                inter = max(0, min(p[3], q[3]) - max(p[1], q[1])) * max(0, min(p[4], q[4]) - max(p[2], q[2]))
                area = lambda x: (x[3] - x[1]) * (x[4] - x[2])
                if inter and 3 * inter >= area(p) + area(q):
                    pairs.append((i, j))
    return union_find(pairs)


def test_matched_groups(spark):
    r = random.Random(8)
    rows = [(r.choice([1, 1, 2]), i, [r.randint(-20, 300), r.randint(-20, 60), r.choice([3, 20, 40, 70]) + r.randint(0, 9), r.choice([10, 30]) + r.randint(0, 9)], r.choice([0.05, 0.1, 0.5, 1.0])) for i in range(600)]
    rows += [(3, 1000 + k, [5, 5, 10, 10], 0.5) for k in range(40)] + [(4, 2000 + k, [10 * k, 0, 40, 40], 0.5) for k in range(60)]
    rows += [(3, 3000, None, 0.5), (3, 3001, [5, 5, 10], 0.5), (3, 3002, [5, 5, 0, 10], 0.5), (None, 3003, [5, 5, 10, 10], 0.5), (3, 3004, [5, 5, 10, 10], None), (3, 3005, [5, 5, 10, 10], float("nan")), (3, 3006, [5, 5, 10, 10], 1.5), (3, 3007, [5, None, 10, 10], 0.5), (3, 3008, [5, 5, -10, 10], 0.5)]
    rows += rows[::7]
    want = brute_matches([x for x in rows if x[3] is None or not math.isnan(x[3])])
    df = spark.createDataFrame([(*x, 0, "u") for x in rows], "image_id bigint, det_id bigint, bbox array<int>, score double, rep int, seed string")
    got = matched_groups(df).collect()
    assert {x.det_id: x.group_id for x in got} == want and len(got) == len(want)
    assert matched_groups(df.limit(0)).count() == 0


def test_dense_cluster_links_parts_and_not_pairs(spark):
    """Thousands of boxes that nearly coincide: links stay far below all pairs, and the groups are those of all pairs."""
    r = random.Random(1)
    rows = [(1, i, [200 + r.randint(-5, 5), 100 + r.randint(-5, 5), 40 + r.randint(-4, 4), 40 + r.randint(-4, 4)], 0.9) for i in range(700)]
    rows += [(1, 5000 + i, [330 + 7 * i, 100, 40, 40], 0.9) for i in range(12)]
    df = spark.createDataFrame(rows, "image_id bigint, det_id bigint, bbox array<int>, score double")
    assert {x.det_id: x.group_id for x in matched_groups(df).collect()} == brute_matches(rows)
    boxes = usable(df, 0.1).withColumnRenamed("det_id", "id")
    reps = with_representatives(boxes, 0.5)
    assert reps.count() == 712 and reps.select("rep").distinct().count() < 712
    like = {}
    for x in reps.collect():
        like.setdefault(x.rep, []).append((x.x1, x.y1, x.x2, x.y2))
    for members in like.values():
        for p in members:
            for q in members:
                inter = (min(p[2], q[2]) - max(p[0], q[0])) * (min(p[3], q[3]) - max(p[1], q[1]))
                assert inter / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - inter) >= 0.5


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e7])
def test_boxes_of_any_scale(spark, scale):
    r = random.Random(2)
    box = [(r.uniform(0, 300) * scale, r.uniform(0, 60) * scale, r.choice([0.3, 3, 20, 200]) * r.uniform(1, 2) * scale, r.choice([1, 10, 90]) * r.uniform(1, 2) * scale) for _ in range(250)]
    df = spark.createDataFrame([(1, i, list(b), 0.9) for i, b in enumerate(box)], "image_id bigint, det_id bigint, bbox array<double>, score double")
    for least in (0.3, 0.75):
        pairs = []
        for i, (a, b, c, d) in enumerate(box):
            for j, (e, f, g, h) in enumerate(box[:i]):
                inter = max(0, min(a + c, e + g) - max(a, e)) * max(0, min(b + d, f + h) - max(b, f))
                if inter >= least * (c * d + g * h - inter):
                    pairs.append((j, i))
        assert {x.det_id: x.group_id for x in matched_groups(df, min_iou=least).collect()} == union_find(pairs)


def test_bad_threshold(spark):
    for least in (0.0, -1.0, 1.5):
        with pytest.raises(ValueError):
            matched_groups(spark.createDataFrame([], "image_id bigint, det_id bigint, bbox array<int>, score double"), min_iou=least)


def test_targets_that_spell_alike_are_refused(spark):
    targets = spark.createDataFrame([("fuel truck", 50), ("Fuel-Truck", 20)], "category_name string, keep_pct int")
    dets = spark.createDataFrame([(1, 0.5, "fuel truck", 1)], "det_id bigint, score double, category_name string, category_id int")
    cats = spark.createDataFrame([(1, "fuel truck")], "id int, name string")
    with pytest.raises(Exception, match="spell alike"):
        with_source(dets, targets, cats).collect()
