import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.operators import tiling as T


def axis(length, size, ov):
    n = max(-(-(length - size) // (size - ov)), 0) + 1
    return [(max(0, min(length, k * (size - ov) + size) - size), min(length, k * (size - ov) + size)) for k in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 1200), st.floats(0, 0.9))
def test_axis_covers_without_gaps(length, size, ratio):
    ov = int(size * ratio)
    t = axis(length, size, ov)
    assert t[0][0] == 0 and t[-1][1] == length
    assert all(b - a == min(size, length) for a, b in t)
    assert all(c <= b for (_, b), (c, _) in zip(t, t[1:], strict=False))


def images(spark, sizes):
    return spark.createDataFrame([(i, f"d/a{i}.jpg", h, w) for i, (h, w) in enumerate(sizes)], "image_id bigint, file_name string, height int, width int")


def test_grid_matches_closed_form(spark):
    rng = random.Random(1)
    sizes = [(rng.randint(1, 2000), rng.randint(1, 2000)) for _ in range(20)]
    got = T.tiles(images(spark, sizes), T.TileSpec(300, 200, 0.2, 0.1)).collect()
    for i, (h, w) in enumerate(sizes):
        want = [(*x, *y) for y in axis(h, 300, 60) for x in axis(w, 200, 20)]
        assert [(r.x1, r.x2, r.y1, r.y2) for r in sorted(got, key=lambda r: r.tile_idx) if r.image_id == i] == want


def test_goldens(spark):
    """Counts of the tiles of a 2048 x 1365 picture, given and automatic sizes."""
    im = images(spark, [(1365, 2048)])
    assert T.tiles(im, T.TileSpec(512, 512, 0.1, 0.4)).count() == 18
    assert T.tiles(im, T.TileSpec(512, 512)).count() == 20
    assert T.tiles(im, T.TileSpec(auto=True)).count() == 18


def test_annotations_on_tiles_equal_brute_force(spark):
    rng = random.Random(2)
    im = images(spark, [(700, 900), (100, 100), (1300, 400)])
    rows = [(n, rng.randrange(3), rng.randrange(3), float(rng.randint(-50, 900)), float(rng.randint(-50, 1300)), float(rng.randint(0, 300)), float(rng.randint(0, 300))) for n in range(150)]
    an = spark.createDataFrame(rows, "ann_id bigint, image_id bigint, category_id int, x double, y double, w double, h double")
    spec = T.TileSpec(256, 256, 0.25, 0.25)
    tiles = T.tiles(im, spec).collect()
    want = set()
    for n, i, _, x, y, w, h in rows:
        for t in tiles:
            if t.image_id == i and x < t.x2 and x + w > t.x1 and y < t.y2 and y + h > t.y1 and w * h >= 1:
                a = (min(x + w, t.x2) - max(x, t.x1)) * (min(y + h, t.y2) - max(y, t.y1))
                if int(a) / int(w * h) >= 0.1:
                    want.add((n, t.tile_idx, max(x, t.x1) - t.x1, max(y, t.y1) - t.y1, int(a)))
    got = T.slice_annotations(im, an, spec).collect()
    assert {(r.ann_id, r.tile_idx, r.x, r.y, r.area) for r in got} == want and len(got) == len(want)


def test_bad_specs():
    for kw in ({"overlap_width": 1.0}, {"height": 0}):
        with pytest.raises(ValueError):
            T.TileSpec(**kw)


def test_names(spark):
    r = T.tiles(images(spark, [(10, 10)]), T.TileSpec(10, 10)).select(T.tile_name(T.F.col("file_name")).alias("a"), T.tile_name(T.F.col("file_name"), ".jpg").alias("b")).head()
    assert (r.a, r.b) == ("a0_0_0_10_10.png", "a0_0_0_10_10.jpg")


@pytest.mark.parametrize("spec", [T.TileSpec(256, 300, 0.25, 0.1), T.TileSpec(auto=True)])
def test_corners_without_tiles(spark, spec):
    """Boxes go back to the image by computed corners as they do by a table of tiles; those of tiles that are not there go nowhere."""
    im = images(spark, [(700, 900), (100, 100), (1300, 400), (1365, 2048)])
    t = T.tiles(im, spec)
    p = t.select("image_id", "tile_idx", F.lit(1.0).alias("x1"), F.lit(2.0).alias("y1"), F.lit(5.0).alias("x2"), F.lit(9.0).alias("y2"))
    p = p.union(spark.createDataFrame([(0, -1, 0.0, 0.0, 1.0, 1.0), (0, 999, 0.0, 0.0, 1.0, 1.0)], p.schema))
    a, b = (sorted(map(tuple, d.collect())) for d in (T.to_images(p, im, spec), T.to_full_image(p, t)))
    assert a == b and len(a) == t.count()


def test_shifting_back_broadcasts_nothing(spark, data):
    import __spark_entry__ as e

    plan = e.queries()["tile_shift_back"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert "Broadcast" not in T.to_full_image(*(T.tiles(images(spark, [(700, 900)])) for _ in "ab"))._jdf.queryExecution().executedPlan().toString()
