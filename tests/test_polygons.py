import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.functions import polygons as P
from tilewright.streaming import frames as S


def test_shoelace_and_bounds(spark):
    seg = [[1.0, 1.0, 325.0, 125.0, 250.0, 200.0, 5.0, 200.0], [0.0, 0.0, 1.0], []]
    df = spark.createDataFrame([(1, seg), (2, []), (3, None)], "id int, s array<array<double>>")
    x, y = np.array(seg[0]).reshape(-1, 2).T
    area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
    r = {a.id: a for a in df.select("id", P.area(F.col("s")).alias("a"), P.bounds(F.col("s")).alias("b")).collect()}
    assert r[1].a == int(area) and r[1].b.x1 == 0.0 and r[1].b.y2 == 200.0
    assert r[2].a == 0 and r[2].b is None and r[3].b is None


def test_clip(spark):
    square, comb = [0, 0, 10, 0, 10, 10, 0, 10], [0, 0, 30, 0, 30, 20, 20, 20, 20, 5, 10, 5, 10, 20, 0, 20]
    df = spark.createDataFrame([(1, [[float(v) for v in square]]), (2, [[float(v) for v in comb], [1.0, 1.0]]), (3, []), (4, None)], "id int, s array<array<double>>")
    cut = lambda *b: {r.id: r.c for r in df.select("id", P.clip_to_box(F.col("s"), *[F.lit(float(v)) for v in b]).alias("c")).collect()}
    got = cut(5, 5, 20, 20)
    assert sorted(zip(got[1][0][::2], got[1][0][1::2])) == [(5, 5), (5, 10), (10, 5), (10, 10)] and got[3] == [] and got[4] is None
    assert cut(50, 50, 60, 60) == {1: [], 2: [], 3: [], 4: None}
    areas = {r.id: r.a for r in df.filter("id = 2").select("id", P.area_exact(P.clip_to_box(F.col("s"), *[F.lit(float(v)) for v in (5, 2, 25, 15)])).alias("a")).collect()}
    # a strip of 20 x 3, and two teeth of 5 x 10
    assert areas == {2: 160.0}


def test_union_of_rings(spark):
    a, b, far = [0, 0, 9, 0, 9, 9, 0, 9], [5, 5, 14, 5, 14, 14, 5, 14], [40, 40, 44, 40, 44, 44, 40, 44]
    df = spark.createDataFrame([(1, [[float(v) for v in r] for r in (a, b, far)]), (2, [[1.0, 2.0]]), (3, None)], "id int, s array<array<double>>")
    rows = {r.id: (r.u, r.n, r.m) for r in df.select("id", P.union_rings("s").alias("u"), P.pixels_of("s").alias("n")).withColumn("m", P.pixels_of(F.col("u").cast("array<array<double>>"))).collect()}
    assert rows[1][1] == rows[1][2] == 100 + 100 - 25 + 25 and len(rows[1][0]) == 2 and rows[2] == ([], 0, 0) and rows[3] == (None, None, None)


def test_hull_and_simplify():
    pts = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2], [1, 3]], float)
    assert sorted(map(tuple, P.hull(pts).tolist())) == [(0, 0), (0, 4), (4, 0), (4, 4)]
    line = np.array([[0, 0], [1, 0.1], [2, 0], [3, 5], [4, 0]], float)
    assert P.simplify_ring(line, 1.0).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]


def test_mask_round_trip():
    m = np.zeros((10, 20), bool)
    m[2:5, 3:9] = True
    m[6:9, 12:15] = True
    rings = P.outline(m)
    assert len(rings) == 2
    assert (P.fill(rings, 20, 10) == m).all()


def test_mask_columns(spark):
    df = spark.createDataFrame([(1, [[0.1, 0.9], [0.8, 0.2]]), (2, [[0.0, 0.0], [0.0, 0.0]])], "id int, m array<array<double>>")
    r = {a.id: a for a in df.select("id", P.mask_bounds(P.threshold(F.col("m"))).alias("b"), P.mask_pixels(P.threshold(F.col("m"))).alias("n")).collect()}
    assert tuple(r[1].b) == (0, 0, 1, 1) and r[1].n == 2 and r[2].b is None


def test_udfs(spark):
    df = spark.createDataFrame([([[0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0]],)], "s array<array<double>>")
    r = df.select(P.clip_to_box("s", F.lit(2.0), F.lit(2.0), F.lit(9.0), F.lit(9.0)).alias("c"), P.convex_hull("s").alias("h"), P.simplify(1.0)("s").alias("q"), P.union_polygons("s", "s", F.lit(8), F.lit(8)).alias("u")).head()
    assert len(r.c[0]) == 8 and len(r.h) == 8 and len(r.q[0]) == 8 and len(r.u) == 1


def test_frame_stream_and_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, concat('k', id % 2) as label from range(40)").write.parquet(str(tmp_path / "in"))
    q = S.counts_by_window(S.frame_stream(spark, str(tmp_path / "in"), "ts timestamp, label string")).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("select * from windows").collect()))
    want = sorted(map(tuple, S.counts_by_window(spark.read.parquet(str(tmp_path / "in"))).collect()))
    assert got == want and len(got) == 8


def test_merge_buffer_function():
    import pandas as pd

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, v):
            self.exists, self.get = True, v

        def setTimeoutDuration(self, ms):
            pass

        def remove(self):
            self.exists = False

    st, run = State(), S.merge_buffer("IOU", 0.5, 2)
    rows = pd.DataFrame([(1, 0, 0, 10, 10, 0.5), (2, 0, 0, 10, 10, 0.9), (3, 50, 50, 60, 60, 0.1)], columns=["id", "x1", "y1", "x2", "y2", "score"])
    assert list(run((7,), iter([rows]), st)) == []
    st.hasTimedOut = True
    out = list(run((7,), iter([]), st))[0]
    assert sorted(out["id"]) == [2, 3] and set(out["image_id"]) == {7} and not st.exists


def test_every_query_has_a_stable_schema(spark, data):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["slice_annotations", "greedy_nmm_merged", "dataset_stats", "p1_found", "p6_found"])
def test_queries_against_sql(spark, data, name):
    import glob
    import os

    import duckdb

    import __spark_entry__ as e

    df = e.queries()[name](spark, data)
    got = sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    if name not in e.oracle_sql():
        assert got
        return
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    r = c.sql(e.oracle_sql()[name])
    at = [r.columns.index(x) for x in sorted(r.columns)]
    assert got == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


def random_masks(n, seed):
    """Segmentations of none to four rings: upright boxes, some on half pixels, and any polygons, some too short; null at times."""
    rng = np.random.default_rng(seed)

    def one():
        out = []
        for _ in range(rng.integers(0, 5)):
            x, y, w, h = (rng.integers(-10, 60, 4) / rng.choice([1, 2])).tolist()
            out.append([x, y, x + abs(w), y, x + abs(w), y + abs(h), x, y + abs(h)] if rng.random() < 0.5 else (rng.integers(-20, 80, int(rng.integers(2, 18))) / 2).tolist())
        return out if rng.random() > 0.1 else None

    masks = [one() for _ in range(n)]
    return masks, pa.array(masks, pa.list_(pa.list_(pa.float64())))


def test_masks_of_a_batch_overlap_as_drawn_one_by_one(monkeypatch):
    monkeypatch.setattr(P, "RASTER", 20_000)
    (a, ca), (b, cb) = random_masks(300, 1), random_masks(300, 2)
    rng = np.random.default_rng(3)
    i, j, crowd = rng.integers(0, 300, 500), rng.integers(0, 300, 500), rng.random(500) < 0.3
    rings = lambda s: [np.asarray(r) for r in s or [] if len(r) >= 6 and len(r) % 2 == 0]
    want = []
    for p, q, c in zip([rings(a[k]) for k in i], [rings(b[k]) for k in j], crowd, strict=True):
        x, y = (np.floor(min([r[k::2].min() for r in p + q], default=0)) for k in (0, 1))
        m, g = (P.fill([r - np.tile([x, y], len(r) // 2) for r in s], 200, 200) for s in (p, q))
        whole = (m if c else m | g).sum()
        want.append((m & g).sum() / whole if p and q and whole else 0.0)
    assert P.pair_overlaps(P.Rings.of_arrow(ca), P.Rings.of_arrow(cb), i, j, crowd).tolist() == want and sum(v > 0 for v in want) > 50


def test_masks_of_a_batch_are_united_as_one_by_one(monkeypatch):
    monkeypatch.setattr(P, "RASTER", 20_000)
    masks, column = random_masks(400, 4)
    assert P.unite_all(column).to_pylist() == [None if m is None else P.unite(m) for m in masks]
    united = pa.array([None if m is None else [[float(v) for v in r] for r in P.unite(m)] for m in masks], column.type)
    for m, n in zip(united.to_pylist(), P.count_pixels(united).to_pylist(), strict=True):
        assert n is None if m is None else n == P.fill([np.asarray(r) + 50 for r in m], 200, 200).sum()
