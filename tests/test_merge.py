import random

import numpy as np
import pytest

from tilewright.functions import kernels as K
from tilewright.operators import merge as M
from tilewright.operators.overlap import grid_pairs

SCHEMA = "image_id bigint, id bigint, category_id int, score double, x1 double, y1 double, x2 double, y2 double"
#: x1, y1, x2, y2, score, category: a strong box with a shifted and a far one; a second category; a wide box over two small ones.
SHIFTED = [(40, 30, 80, 70, 0.61, 4), (43, 33, 83, 73, 0.55, 4), (400, 30, 440, 70, 0.2, 4)]
CLASSES = [(7, 7, 27, 47, 0.3, 0), (8, 8, 28, 48, 0.97, 2), (7, 9, 27, 49, 0.4, 0), (9, 7, 29, 47, 0.96, 2)]
WIDE = [(0, 0, 60, 30, 0.77, 1), (5, 5, 25, 20, 0.31, 1), (50, 10, 66, 26, 0.3, 1)]


def frame(spark, boxes, image=0):
    return spark.createDataFrame([(image, i, int(c), float(s), *map(float, b)) for i, (*b, s, c) in enumerate(boxes)], SCHEMA)


def rand(n, spread, seed):
    r = np.random.default_rng(seed)
    xy, wh = r.uniform(0, spread, (n, 2)), r.uniform(1, 40, (n, 2))
    wh[::7, 0] = 0
    xy, wh = np.round(xy / 5) * 5, np.round(wh / 5) * 5
    return [(*a, *(a + b), s, c) for a, b, s, c in zip(xy, wh, np.round(r.uniform(0, 1, n), 1), r.integers(0, 3, n), strict=True)]


def blocks(boxes):
    a = np.array(boxes, float).reshape(-1, 6)
    return a[:, :4], a[:, 4]


def brute_forest(box, score, metric, thr):
    """Every box, kept or taken, claims what it dominates and nobody claimed yet, in rank order."""
    rank = K.order(box, score)
    root = {}
    for a, i in enumerate(rank):
        root.setdefault(i, i)
        for j in rank[a + 1 :]:
            inter, den = K.overlaps(box[i], box[j : j + 1], metric)
            if j not in root and den[0] > 0 and inter[0] / den[0] >= thr and (score[i] > score[j] or (score[i] == score[j] and (box[i] == box[j]).all())):
                root[j] = root[i]
    return [root[i] for i in range(len(box))]


def test_known_cases(spark):
    kept = lambda b, **kw: sorted(r.id for r in M.nms(frame(spark, b), ["image_id"], **kw).collect())
    assert kept(SHIFTED) == [0, 2]
    assert kept(CLASSES, class_agnostic=False) == [1, 2] and kept(CLASSES) == [1]
    inner = [(10, 10, 210, 110, 0.5, 3), (30, 30, 50, 60, 0.45, 3)]
    assert kept(inner) == [0, 1] and kept(inner, metric="IOS") == [0]
    same = [(3, 3, 9, 8, s, 1) for s in (0.2, 0.6, 0.4)]
    own = {r.id: (r.keeper, r.pos) for r in M.groups(frame(spark, same), ["image_id"], M.Merging("greedy_nmm", "IOU", 0.5, True)).collect()}
    assert own == {1: (1, 0), 2: (1, 1), 0: (1, 2)}
    r = M.merged(frame(spark, WIDE), ["image_id"], M.Merging("greedy_nmm", "IOU", 0.05, True)).collect()
    assert [(x.id, x.n_merged, x.x2) for x in r] == [(0, 2, 66.0)]


@pytest.mark.parametrize("metric", M.METRICS)
@pytest.mark.parametrize(("n", "spread"), [(0, 10), (120, 120)])
def test_strategies_agree(spark, metric, n, spread):
    df = frame(spark, rand(n, spread, n)) if n else spark.createDataFrame([], SCHEMA)
    for method in ("greedy_nmm", "nmm", "legacy_nms"):
        how = [M.Merging(method, metric, 0.4, True, s) for s in ("arrow", "relational")]
        a, b = (sorted(map(tuple, M.groups(df, ["image_id"], h).select("id", "keeper", "pos").collect())) for h in how)
        assert a == b
    kept = [sorted(r.id for r in M.nms(df, ["image_id"], metric, 0.4, strategy=s).collect()) for s in ("arrow", "fold", "relational")]
    assert kept[0] == kept[1] == kept[2]


@pytest.mark.parametrize("metric", M.METRICS)
@pytest.mark.parametrize("method", ["nms", "greedy_nmm", "nmm", "legacy_nms"])
def test_size_of_a_group_changes_nothing(spark, method, metric):
    """Groups above max_group fall into components, and those above it go the relational way: the same keepers, at exact ties too."""
    boxes = rand(120, 150, 5) + [(0, 600, 10, 610, 0.5, 1), (0, 600, 10, 605, 0.5, 1), (0, 700, 10, 705, 0.5, 1), (0, 700, 10, 710, 0.5, 1)]
    df = frame(spark, boxes).union(frame(spark, rand(10, 80, 6), 1).withColumn("id", M.F.col("id") + 1000))
    got = [sorted(map(tuple, M.groups(df, ["image_id"], M.Merging(method, metric, 0.5, True, "auto", most)).select("id", "keeper", "pos").collect())) for most in (50_000, 4)]
    assert got[0] == got[1]


@pytest.mark.parametrize("threshold", [0.0, -0.5])
def test_thresholds_that_all_boxes_reach(spark, threshold):
    df = frame(spark, rand(60, 400, 3))
    for method in ("greedy_nmm", "legacy_nms"):
        got = [sorted(map(tuple, M.groups(df, ["image_id"], M.Merging(method, "IOU", threshold, True, s, most)).select("id", "keeper").collect())) for s, most in (("arrow", 50_000), ("auto", 4))]
        assert got[0] == got[1] and (method == "legacy_nms" and threshold == 0 or len({k for _, k in got[0]}) == 1)


@pytest.mark.parametrize("threshold", [0.1, 0.0])
def test_union_merge_of_large_groups(spark, threshold):
    df = frame(spark, rand(100, 600, 11))
    got = [sorted(map(tuple, M.merged(df, ["image_id"], M.Merging("union_merge", "IOU", threshold, True, "auto", most)).collect())) for most in (50_000, 4)]
    assert got[0] == got[1] and any(r[-1] for r in got[0])


def test_components(spark):
    r = np.random.default_rng(5)
    pairs = [(int(a), int(a) + 1) for a in r.permutation(60)] + [(200, 200 + k) for k in range(30)] + [(500, 500)]
    got = M.connected(spark.createDataFrame(pairs, "a bigint, b bigint"), M.Scratch(spark, "t")).collect()
    assert len(got) == 61 + 30 and len({x.root for x in got if x.v <= 60}) == 1 and len({x.root for x in got if x.v >= 200}) == 1 and len({x.root for x in got}) == 2


@pytest.mark.parametrize("seed", range(4))
def test_kernels_against_plain_definitions(seed):
    box, score = blocks(rand(300, 250, seed))
    for metric in M.METRICS:
        root, _ = K.transitive(box, score, metric, 0.3)
        assert root.tolist() == brute_forest(box, score, metric, 0.3)
        rank, owner = K.order(box, score), {}
        for i in rank:
            hit = [k for k in rank if owner.get(k) == k and (lambda x: x[1][0] > 0 and x[0][0] / x[1][0] >= 0.3)(K.overlaps(box[k], box[i : i + 1], metric))]
            owner[i] = hit[0] if hit else i
        assert K.greedy(box, score, metric, 0.3).tolist() == [owner[i] for i in range(len(box))]


def test_match_all():
    box, score = blocks([(0, 0, 1, 1, 0.9, 0), (5, 5, 6, 6, 0.9, 0), (0, 0, 1, 1, 0.9, 0), (9, 9, 10, 10, 0.1, 0)])
    assert K.greedy(box, score, "IOU", 0).tolist() == [0, 0, 0, 0]
    assert K.transitive(box, score, "IOU", 0)[0].tolist() == [0, 1, 0, 0]


def test_pairs_equal_brute_force(spark):
    boxes = rand(200, 150, 9)
    box, _ = blocks(boxes)
    for metric in M.METRICS:
        want = set()
        for i in range(len(box)):
            for j in range(i + 1, len(box)):
                inter, den = K.overlaps(box[i], box[j : j + 1], metric)
                if inter[0] > 0 and inter[0] >= 0.25 * den[0]:
                    want.add((i, j))
        got = grid_pairs(frame(spark, boxes), ["image_id"], "id", metric, 0.25).collect()
        assert {(r.i, r.j) for r in got} == want and len(got) == len(want)


def test_fold_drops_members_that_do_not_overlap_enough():
    box, score = blocks([(0, 0, 10, 10, 0.9, 1), (0, 5, 10, 15, 0.9, 2)])
    b, s, c, n = K.fold(box, score, np.array([1, 2]), np.array([0, 0]), np.array([1]), "IOU", 1 / 3)
    assert n[0] == 0 and b[0].tolist() == [0, 0, 10, 10]
    b, s, c, n = K.fold(box, score, np.array([1, 2]), np.array([0, 0]), np.array([1]), "IOU", 0.3)
    assert n[0] == 1 and b[0].tolist() == [0, 0, 10, 15] and c[0] == 2


def test_rewrites_and_bad_settings():
    assert M.low_confidence_rewrite(M.Merging(), 0.05).method == "nms"
    assert M.low_confidence_rewrite(M.Merging(), 0.05, force=True).method == "greedy_nmm"
    assert M.low_confidence_rewrite(M.Merging(), 0.5, True).method == "nms"
    for kw in ({"method": "x"}, {"metric": "GIOU"}, {"strategy": "x"}):
        with pytest.raises(ValueError):
            M.Merging(**kw)


def test_hot_cell_is_split(spark):
    """Most boxes in one cell of one scene: the join is planned with skew handling, which a repartition by hand would forbid."""
    r = random.Random(4)
    boxes = [(1, i, r.uniform(0, 60), r.uniform(0, 60)) if i % 3 else (1, i, r.uniform(0, 90_000), r.uniform(0, 90_000)) for i in range(6000)]
    df = spark.createDataFrame(boxes, "image_id bigint, id bigint, x1 double, y1 double").selectExpr("*", "x1 + 40 AS x2", "y1 + 40 AS y2").repartition(8)
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        j = grid_pairs(df, ["image_id"], "id", "IOU", 0.9)
        j.collect()
        assert "skew=true" in j._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_kernels_of_points_and_outliers():
    """More boxes without size than with, one as wide as everything, fractions of a pixel."""
    r = np.random.default_rng(3)
    xy = r.uniform(0, 1, (80, 2))
    box = np.concatenate([xy, xy + r.uniform(0, 0.3, (80, 2)) * (np.arange(80) % 3 == 0)[:, None]], axis=1)
    box[5] = [0, 0, 5000, 5000]
    score = np.round(r.uniform(0, 1, 80), 1)
    for metric in M.METRICS:
        owner = K.greedy(box, score, metric, 0.2)
        for i in range(80):
            keepers = [k for k in K.order(box, score) if owner[k] == k and (k == i or (lambda x: x[1][0] > 0 and x[0][0] / x[1][0] >= 0.2)(K.overlaps(box[k], box[i : i + 1], metric)))]
            assert owner[i] == keepers[0]
        assert K.transitive(box, score, metric, 0.2)[0].tolist() == brute_forest(box, score, metric, 0.2)
    zero = np.zeros((5, 4))
    assert K.greedy(zero, np.arange(5.0)).tolist() == list(range(5)) and K.transitive(zero, np.arange(5.0))[0].tolist() == list(range(5))


@pytest.mark.parametrize("metric", ["IOU", "IOS"])
def test_many_groups_at_once_equal_each_by_itself(metric):
    """One call for all groups of a bucket, whose boxes may stand in the same places and be of very different size."""
    rng = np.random.default_rng(7)
    group = rng.integers(0, 40, 3000)
    lo = rng.integers(0, 60, (3000, 2)).astype(float)
    box = np.concatenate([lo, lo + rng.integers(0, 25, (3000, 2))], axis=1) * (1.0 + group[:, None] % 5)
    score, cat = rng.integers(0, 20, 3000) / 20, rng.integers(0, 3, 3000)
    assert K.with_wide(box, group).tolist() == [] and K.with_wide(np.concatenate([box, [[0, 0, 9e5, 9e5]]]), np.append(group, 4)).tolist() == [4]
    root, claim = K.transitive(box, score, metric, 0.3, group)
    own = K.greedy(box, score, metric, 0.3, group=group)
    folded = K.fold_members(box, score, cat, root, K.member_order(root, claim), metric, 0.3)
    assert folded[4].sum() > 100
    for g in range(40):
        at = np.flatnonzero(group == g)
        r, c = K.transitive(box[at], score[at], metric, 0.3)
        assert at[r].tolist() == root[at].tolist() and at[K.greedy(box[at], score[at], metric, 0.3)].tolist() == own[at].tolist()
        # so few that they are folded one by one
        few = K.fold_members(box[at], score[at], cat[at], r, K.member_order(r, c), metric, 0.3)
        kept = np.flatnonzero(r == np.arange(len(at)))
        assert all((a[kept] == b[at][kept]).all() for a, b in zip(few[:4], folded[:4], strict=True)) and (few[4] == folded[4][at]).all()


@pytest.mark.parametrize("method", ["greedy_nmm", "nmm"])
def test_merging_takes_one_shuffle_beside_the_count(spark, method):
    """Small groups are grouped and folded in one step, with a huge box among them as well, and as the relational way does."""
    rng = np.random.default_rng(11)
    rows = [(n, int(rng.integers(0, 9)), int(rng.integers(0, 2)), float(rng.integers(0, 30)) / 30, x, y, x + float(rng.integers(1, 40)), y + float(rng.integers(1, 40))) for n, (x, y) in enumerate(rng.integers(0, 90, (600, 2)).astype(float).tolist())]
    rows.append((600, 3, 1, 0.99, 0.0, 0.0, 1e6, 1e6))
    boxes = spark.createDataFrame(rows, "id bigint, scene_id bigint, category_id int, score double, x1 double, y1 double, x2 double, y2 double")
    got = M.merged(boxes, ["scene_id"], M.Merging(method, "IOS", 0.5))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = M.merged(boxes, ["scene_id"], M.Merging(method, "IOS", 0.5, strategy="relational"))
    apart = M.merged(boxes, ["scene_id"], M.Merging(method, "IOS", 0.5, max_group=35))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == sorted(map(tuple, apart.collect()))
