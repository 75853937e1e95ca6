import json

import pytest

from tilewright.operators import dataset as D
from tilewright.operators import evaluation as E
from tilewright.operators import pipeline as L
from tilewright.sources import coco, media, yolo

DOC = {
    "images": [{"id": 1, "file_name": "a.jpg", "height": 100, "width": 200}, {"id": 1, "file_name": "again.jpg", "height": 1, "width": 1}, {"id": 2, "file_name": "x/a.png", "height": 50, "width": 50}],
    "categories": [{"id": 1, "name": "human"}, {"id": 2, "name": "car", "supercategory": "vehicle"}],
    "annotations": [
        {"id": 9, "image_id": 1, "category_id": 1, "bbox": [1, 2, 30, 40], "area": 7, "iscrowd": 0},
        {"id": 9, "image_id": 1, "category_id": 2, "bbox": [0, 0, 1, 1], "segmentation": [[10, 10, 20, 10, 20, 30]]},
        {"id": 9, "image_id": 1, "category_id": 2, "bbox": [5, 5, 5, 5], "segmentation": {"size": [1, 1], "counts": "0"}},
    ],
}


@pytest.fixture
def ds(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DOC))
    return coco.read_coco(spark, str(tmp_path / "d.json"))


def test_read(ds):
    assert sorted((r.image_id, r.file_name) for r in ds.images.collect()) == [(1, "a.jpg"), (2, "x/a.png")]
    assert {(r.name, r.supercategory) for r in ds.categories.collect()} == {("human", "human"), ("car", "vehicle")}
    assert sorted((r.ann_id, r.x, r.y, r.w, r.h) for r in ds.annotations.collect()) == [(1, 1, 2, 30, 40), (2, 10, 10, 10, 20), (3, 5, 5, 5, 5)]


def test_round_trip(spark, ds, tmp_path):
    coco.write_coco_document(ds, str(tmp_path / "out.json"), ignore_negatives=True)
    out = json.loads((tmp_path / "out.json").read_text())
    assert [i["file_name"] for i in out["images"]] == ["a.jpg"] and [a["id"] for a in out["annotations"]] == [1, 2, 3]
    # the triangle has the area of its polygon
    assert [a["area"] for a in out["annotations"]] == [1200, 100, 25]
    coco.write_coco(ds, str(tmp_path / "folder"))
    assert spark.read.json(str(tmp_path / "folder/annotations")).count() == 3
    with pytest.raises(ValueError):
        coco.write_coco_document(ds, str(tmp_path / "no.json"), max_rows=2)


def test_yolo(ds, tmp_path):
    yolo.write_labels(ds, str(tmp_path / "y"))
    lines = (tmp_path / "y/labels/a.txt").read_text().split("\n")
    assert lines[0].startswith("1 0.08") and len(lines) == 4
    assert "nc: 2" in (tmp_path / "y/data.yml").read_text()
    assert {r.label_name for r in yolo.label_names(ds.images).collect()} == {"a", "a_2"}


def test_unmapped_category_is_an_error(spark, ds):
    m = spark.createDataFrame([(1, 5)], "category_id int, new_id int")
    with pytest.raises(Exception, match="no mapping"):
        D.remap_by_id(ds, m).annotations.collect()


def test_merge_leaves_the_gap(spark, ds):
    both = D.merge_datasets(ds, ds)
    assert sorted(r.image_id for r in both.images.collect()) == [1, 2, 4, 5]
    assert sorted(r.ann_id for r in both.annotations.collect()) == [1, 2, 3, 5, 6, 7]


def test_running_ids_with_ties_and_empty(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(100)], "o int, i int")
    assert [r.n for r in D.running_ids(df, ["o", "i"], "n").orderBy("i").collect()] == list(range(1, 101))
    assert D.running_ids(df.limit(0), ["o", "i"], "n").count() == 0


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    sof = b"\xff\xc0\x00\x11\x08" + (9).to_bytes(2, "big") + (7).to_bytes(2, "big") + b"\x03" + b"\0" * 9
    tiff = b"II*\0\x08\0\0\0\x01\0" + b"\x12\x01\x03\0\x01\0\0\0\x06\0\0\0"
    exif = b"\xff\xe1" + (len(tiff) + 8).to_bytes(2, "big") + b"Exif\0\0" + tiff
    assert media.image_size(png) == (7, 9)
    assert media.image_size(b"\xff\xd8" + sof) == (7, 9)
    assert media.image_size(b"\xff\xd8" + exif + sof) == (9, 7)
    assert media.image_size(b"") is None and media.image_size(b"nothing") is None


def test_image_source(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big"))
    (tmp_path / "b.png").write_bytes(b"junk")
    got = sorted((r.width, r.height) for r in media.read_images(spark, str(tmp_path), "*.png").filter("width is not null").collect())
    assert got == [(7, 9)]


BOX = "id bigint, image_id bigint, category_id int, score double, x1 double, y1 double, x2 double, y2 double"


def test_evaluation_by_hand(spark):
    truth = spark.createDataFrame([(1, 1, 0, 0, 0.0, 0.0, 10.0, 10.0), (2, 1, 0, 0, 50.0, 50.0, 60.0, 60.0), (3, 2, 0, 1, 0.0, 0.0, 100.0, 100.0)], "id bigint, image_id bigint, category_id int, iscrowd int, x1 double, y1 double, x2 double, y2 double")
    dets = spark.createDataFrame([(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (2, 1, 0, 0.8, 0.0, 0.0, 10.0, 9.0), (3, 1, 0, 0.7, 50.0, 50.0, 60.0, 60.0), (4, 2, 0, 0.95, 1.0, 1.0, 9.0, 9.0), (5, 3, 0, 0.1, 0.0, 0.0, 1.0, 1.0)], BOX)
    m, n = E.matches(dets, truth), E.truth_counts(truth)
    got = {r.id: (bool(r.tp & 1), bool(r.ignored & 1), r.gt_id[0]) for r in m.filter("area_lbl = 'all'").collect()}
    assert got == {1: (True, False, 1), 2: (False, False, -1), 3: (True, False, 2), 4: (False, True, 3), 5: (False, False, -1)}
    ap = {r.metric: r.value for r in E.summary(E.pr_curve(m, n), E.max_recall(m, n)).collect()}
    assert ap["mAP50"] == pytest.approx((51 * 1 + 50 * 2 / 3) / 101, abs=1e-6) and ap["AR_s"] == 1.0 and ap["mAP_l"] == -1.0


def test_error_layers_forgive(spark):
    truth = spark.createDataFrame([(1, 1, 0, 0, 0.0, 0.0, 10.0, 10.0), (2, 1, 1, 0, 20.0, 0.0, 30.0, 10.0)], "id bigint, image_id bigint, category_id int, iscrowd int, x1 double, y1 double, x2 double, y2 double")
    dets = spark.createDataFrame([(1, 1, 0, 0.5, 0.0, 0.0, 10.0, 10.0), (2, 1, 0, 0.9, 20.0, 0.0, 30.0, 10.0)], BOX)
    cats = spark.createDataFrame([(0, "a", "x"), (1, "b", "x")], "category_id int, name string, supercategory string")
    got = {r.layer: r.precision for r in E.error_layers(dets, truth, cats).filter("category_id = 0 and area_lbl = 'all'").collect()}
    assert got["C50"] == pytest.approx(0.5) and got["Sim"] == 1.0 and got["Oth"] == 1.0 and got["FN"] == 1.0


def test_pipeline_runs_and_is_repeatable(spark):
    im = spark.createDataFrame([(1, "a.jpg", 900, 1300), (2, "b.jpg", 300, 300)], "image_id bigint, file_name string, height int, width int")
    a, b = (sorted(map(tuple, L.sliced_prediction(im, L.GridDetector, exclude_ids=[2]).collect())) for _ in range(2))
    assert a and a == b and all(r[2] != 2 for r in a)
    with pytest.raises(ValueError):
        L.detect(im, L.GridDetector, 0)
