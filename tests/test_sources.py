import json

import pytest
from pyspark.sql import functions as F

from tilewright import cli
from tilewright.cli import next_path
from tilewright.functions import decode as X
from tilewright.functions import draw
from tilewright.functions.text import file_base, is_blank, spelling
from tilewright.operators import dataset as D
from tilewright.operators import pipeline as L
from tilewright.operators import tiling as T
from tilewright.session import shared_dir
from tilewright.sources import coco, datasource, media, yolo


def test_frames_batch_and_stream(spark):
    datasource.register(spark)
    opts = {"video_id": 3, "n_frames": 25, "skip": 3, "partitions": 4, "per_batch": 10}
    batch = spark.read.format("frames").options(**opts).load()
    assert sorted(r.frame_id for r in batch.collect()) == [3, 7, 11, 15, 19, 23]
    q = spark.readStream.format("frames").options(**opts).load().writeStream.format("memory").queryName("frames_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.frame_id for r in spark.table("frames_out").collect()) == [3, 7, 11, 15, 19, 23]


def test_table_function_equals_the_grid(spark):
    datasource.register(spark)
    got = sorted(map(tuple, spark.sql("select * from tile_grid(1365, 2048, 512, 512, 102, 102)").collect()))
    im = spark.createDataFrame([(1, "a", 1365, 2048)], "image_id int, file_name string, height int, width int")
    assert got == sorted(map(tuple, T.tiles(im).select("tile_idx", "x1", "y1", "x2", "y2").collect()))


def test_drawing_tables(spark):
    df = spark.createDataFrame([(1, 7, 4, "car", 0.873, 1.5, 2.5, 3.5, 4.5, 1000, 1000, "d/a.jpg")], "image_id int, id int, category_id int, category_name string, score double, x1 double, y1 double, x2 double, y2 double, height int, width int, file_name string")
    r = draw.draw_list(df, ["#FF0010", "#00ff00", "#0000FF"]).head()
    assert (r.line_width, r.label, tuple(r.colour)) == (3, "car 0.87", (0, 255, 0))
    assert draw.crop_boxes(df).head().crop_name == "d/a_box7_class4.png"
    assert draw.text_table(["a", "bc"], [[1, 2]]).split("\n")[1] == "| a | bc |"


def test_names(spark):
    rows = [("a%20b/c%2Bd+e.png", "c+d+e.png", "c+d+e.png"), ("D:\\x\\y.jpg", "y.jpg", "y.jpg"), ("100%.png", "100%.png", "100%.png"), (None, None, None)]
    df = spark.createDataFrame(rows, "n string, want string, x string")
    assert all(r.b == r.want for r in df.select("want", file_base(F.col("n")).alias("b")).collect())
    s = spark.createDataFrame([("ＨＡＵＬ　truck",), (" \xa0\t",), (None,), ("haul-Truck_",)], "n string").select(spelling(F.col("n")).alias("k"), is_blank(F.col("n")).alias("b")).collect()
    assert [(r.k, r.b) for r in s] == [("haultruck", False), ("", True), (None, True), ("haultruck", False)]


def test_next_path(tmp_path):
    p = str(tmp_path / "exp")
    assert next_path(p) == p
    (tmp_path / "exp").mkdir(), (tmp_path / "exp7").mkdir()
    assert next_path(p) == p + "8"


@pytest.mark.parametrize("kind", ["IOU", "IOS"])
def test_pairs_refuse_a_threshold_of_zero(spark, kind):
    from tilewright.operators.overlap import grid_pairs

    with pytest.raises(ValueError):
        grid_pairs(spark.createDataFrame([], "k int, id int, x1 double, y1 double, x2 double, y2 double"), ["k"], metric=kind, threshold=0)


def document(path, ids, boxes):
    """A COCO document of images of 900 x 1300 with the given boxes each."""
    anns = [{"id": 1, "image_id": i, "category_id": 1 + k % 2, "bbox": list(map(float, b))} for i in ids for k, b in enumerate(boxes)]
    doc = {"images": [{"id": i, "file_name": f"d/p{i}.png", "height": 900, "width": 1300} for i in ids], "categories": [{"id": 1, "name": "car"}, {"id": 2, "name": "bus", "supercategory": "road"}], "annotations": anns}
    path.write_text(json.dumps(doc))


def test_annotations_of_several_documents_are_numbered_together(spark, tmp_path):
    document(tmp_path / "a.json", [1, 2], [(0, 0, 10, 10), (5, 5, 20, 20)])
    document(tmp_path / "b.json", [2, 3], [(1, 1, 10, 10)])
    d = coco.read_coco(spark, str(tmp_path / "*.json"))
    assert sorted(r.ann_id for r in d.annotations.collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r.image_id for r in d.images.collect()) == [1, 2, 3] and d.categories.count() == 2
    (tmp_path / "out").mkdir()
    coco.write_coco_document(d, f"file://{tmp_path}/out/whole.json")
    assert len(json.loads((tmp_path / "out" / "whole.json").read_text())["annotations"]) == 6


def test_lines_come_back_as_they_went(spark, tmp_path):
    doc = {"images": [{"id": 9, "file_name": "a.png", "height": 50, "width": 60}], "categories": [{"id": 3, "name": "x"}], "annotations": [{"id": 5, "image_id": 9, "category_id": 3, "segmentation": [[0, 0, 10, 0, 10, 5]]}, {"id": 6, "image_id": 9, "category_id": 3, "bbox": [1, 2, 3, 4]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    coco.write_coco(coco.read_coco(spark, str(tmp_path / "a.json")), str(tmp_path / "out"))
    rows = sorted((r.id, r.image_id, r.area, r.bbox) for r in spark.read.json(str(tmp_path / "out" / "annotations")).collect())
    assert rows == [(1, 1, 25, [0.0, 0.0, 10.0, 5.0]), (2, 1, 12, [1.0, 2.0, 3.0, 4.0])]
    d = coco.read_coco_lines(spark, str(tmp_path / "out"))
    got = sorted((r.ann_id, r.x, r.w, r.segmentation) for r in d.annotations.collect())
    assert got == [(1, 0.0, 10.0, [[0.0, 0.0, 10.0, 0.0, 10.0, 5.0]]), (2, 1.0, 3.0, None)] and d.images.count() == d.categories.count() == 1


def test_yolo_folder(spark, tmp_path):
    document(tmp_path / "a.json", range(1, 21), [(10, 10, 100, 50), (5, 5, 0, 20), (2000, 5, 10, 10)])
    (tmp_path / "img" / "d").mkdir(parents=True)
    for i in range(1, 21):
        (tmp_path / "img" / "d" / f"p{i}.png").write_bytes(b"x%d" % i)
    d = coco.read_coco(spark, str(tmp_path / "a.json"))
    yolo.write_labels(d, f"file://{tmp_path}/y", str(tmp_path / "img"), 0.7)
    files = {p.relative_to(tmp_path / "y").as_posix(): p.read_bytes() for p in (tmp_path / "y").rglob("*") if p.is_file()}
    texts = {k: v for k, v in files.items() if k.endswith(".txt")}
    assert len(texts) == 20 and {k.split("/")[0] for k in texts} == {"train", "val"}
    assert all(v.decode().split("\n")[0].startswith("1 ") and len(v.decode().strip().split("\n")) == 1 for v in texts.values())
    assert all(files[k[:-3] + "png"] == b"x" + k.rpartition("/p")[2][:-4].encode() for k in texts)
    assert b"nc: 2" in files["data.yml"] and not any(k.endswith(".part") for k in files)
    yolo.write_labels(d, str(tmp_path / "z"))
    assert len(list((tmp_path / "z" / "labels").iterdir())) == 20


def test_predict_command(spark, tmp_path, capsys):
    document(tmp_path / "a.json", [4, 5], [])
    cli.main(["predict", str(tmp_path / "a.json"), str(tmp_path / "run"), "--confidence", "0.1"])
    rows = spark.read.json(str(tmp_path / "run" / "results"))
    want = L.sliced_prediction(coco.read_coco(spark, str(tmp_path / "a.json")).images, L.GridDetector, T.TileSpec(512, 512), confidence=0.1)
    assert rows.count() == want.count() > 10 and {"bbox", "category_name", "area", "iscrowd"} <= set(rows.columns)
    assert spark.read.parquet(str(tmp_path / "run" / "visuals")).count() == rows.count() and "prediction" in capsys.readouterr().out
    cli.main(["slice", str(tmp_path / "a.json"), str(tmp_path / "cut"), "--size", "512"])
    tiles = spark.read.json(str(tmp_path / "cut" / "512" / "images"))
    assert sorted(r.id for r in tiles.collect()) == list(range(1, tiles.count() + 1))


def test_unsliced_prediction_sees_whole_images(spark):
    im = spark.createDataFrame([(7, "a", 900, 1300)], "image_id bigint, file_name string, height int, width int")
    whole, cut = (L.raw_predictions(im, L.GridDetector, confidence=0.0, full_image=f, sliced=s).collect() for f, s in ((True, False), (True, True)))
    assert {r.tile_idx for r in whole} == {-1} and {r.tile_idx for r in cut} == {-1, *range(6)}


def test_detection_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"image_id": i, "height": 700, "width": 600} for i in range(5)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    frames = spark.readStream.schema("image_id bigint, height int, width int").json(str(tmp_path / "in"))
    q = L.detect_stream(frames, L.GridDetector, str(tmp_path / "out"), confidence=0.0)
    q.processAllAvailable()
    (tmp_path / "in" / "b.json").write_text(json.dumps({"image_id": 9, "height": 700, "width": 600}))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out" / "predictions"))
    batch = L.raw_predictions(spark.createDataFrame([*[(i, 700, 600) for i in range(5)], (9, 700, 600)], "image_id bigint, height int, width int"), L.GridDetector, confidence=0.0, full_image=False)
    key = lambda d: sorted((r.image_id, r.tile_idx, r.score, r.x1, r.y1) for r in d.collect())
    assert key(got) == key(batch)


def test_run_lengths(spark):
    df = spark.createDataFrame([(1, [3, 2, 6, 9]), (2, [0, 4]), (3, [20]), (4, []), (5, None)], "id int, c array<bigint>")
    got = {r.id: (r.n, r.b and tuple(r.b)) for r in df.select("id", X.rle_pixels(F.col("c")).alias("n"), X.rle_bounds(F.col("c"), F.lit(4)).alias("b")).collect()}
    assert got == {1: (11, (0, 0, 4, 3)), 2: (4, (0, 0, 0, 3)), 3: (0, None), 4: (0, None), 5: (None, None)}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://a:7077", "applicationId": "x"})()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_files_by_part_of_their_name(spark, tmp_path):
    for n in ("A_Tile.png", "tile_b.jpg", "other.png"):
        (tmp_path / n).write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (7).to_bytes(4, "big") + (5).to_bytes(4, "big"))
    rows = media.read_images(spark, str(tmp_path), contains=["TILE"]).collect()
    assert sorted(r.path.rpartition("/")[2] for r in rows) == ["A_Tile.png", "tile_b.jpg"] and {(r.width, r.height) for r in rows} == {(7, 5)}


def test_category_minus_one_is_dropped(spark, tmp_path):
    document(tmp_path / "a.json", [1], [(0, 0, 10, 10), (5, 5, 20, 20)])
    d = coco.read_coco(spark, str(tmp_path / "a.json"))
    out = D.update_categories(d, spark.createDataFrame([("car", 7), ("bus", -1)], "name string, category_id int"))
    assert [r.category_id for r in out.annotations.collect()] == [7] and [r.category_id for r in out.categories.collect()] == [7]


def test_detector_of_arrays_equals_rows(spark):
    """Both ways of asking a detector give the same predictions; those below the confidence never leave the worker."""
    class Rows:
        predict = L.GridDetector().predict

    im = spark.createDataFrame([(i - 2, 200 + 211 * i, 1900 - 150 * i) for i in range(9)], "image_id bigint, height int, width int")
    t = T.tiles(im).select("image_id", "tile_idx", "x1", "y1", "x2", "y2")
    for shifted in (False, True):
        a, b = (sorted(map(tuple, L.detect(t, make, 7, shifted).collect())) for make in (L.GridDetector, Rows))
        assert a == b and len(a) > 200
        c = L.detect(t, L.GridDetector, 7, shifted, 0.3, False)
        assert sorted(map(tuple, c.collect())) == sorted((*r[:3], *r[4:]) for r in b if r[4] >= 0.3) and "category_name" not in c.columns


def test_detected_tiles_are_not_joined_and_all_tasks_detect(spark, data):
    import __spark_entry__ as e

    d = e.queries()["detect_tiles"](spark, data)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert d.select(F.spark_partition_id()).distinct().count() >= 4


def test_raw_predictions_are_cut_to_the_image_without_a_join(spark):
    class Wild:
        def predict(self, batch):
            box = lambda t, *b: {"image_id": t["image_id"], "tile_idx": t["tile_idx"], "category_id": 0, "category_name": "a", "score": 0.5, **dict(zip(("x1", "y1", "x2", "y2"), map(float, b), strict=True))}
            return [b for t in batch for b in (box(t, -9, -9, 5, 5), box(t, 100, 100, 9999, 9999), box(t, -9, 0, 0, 5))]

    im = spark.createDataFrame([(1, 300, 200)], "image_id bigint, height int, width int")
    p = L.raw_predictions(im, Wild, T.TileSpec(200, 200, 0.0, 0.0))
    assert "Join" not in p._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.tile_idx, r.x1, r.y1, r.x2, r.y2) for r in p.collect())
    assert got == [(-1, 0, 0, 5, 5), (-1, 100, 100, 200, 300), (0, 0, 0, 5, 5), (0, 100, 100, 200, 300), (1, 0, 91, 5, 105), (1, 100, 200, 200, 300)]
