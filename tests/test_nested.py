import json

import pytest

from tilewright.operators import nested as N


def shape(label="a", points=((1, 2),), **kw):
    return {"label": label, "points": [list(p) for p in points], "shape_type": "polygon", **kw}


def test_numbers():
    assert [N.number(v) for v in (1, 2.5, "3", " -4.5e1 ", ".5")] == [1, 2.5, 3, -45, 0.5]
    assert all(N.number(v) is None for v in (None, True, "", "x", "nan", float("nan"), float("inf"), [], {}, "1,2", 10**400))


def test_readable_forms():
    rec = {"version": "5", "shapes": []}
    text = json.dumps(rec)
    for raw in (text, "﻿" + text, json.dumps(text), json.dumps({"payload": rec, "sent": 1}), json.dumps({"payload": text}), json.dumps([rec]), json.dumps(json.dumps({"payload": rec, "sent": 2}))):
        assert N.readable(raw) == rec, raw
    assert N.readable('{"shapes": null}') == {"shapes": None}
    for raw in (None, "", "null", "<html/>", text[:-3], "[]", "{}", "3", '{"a": {"b": 1}}', "[" * 100_000):
        assert N.readable(raw) is None


def test_visit_keeps_positions_and_parents():
    rec = {"shapes": [None, shape(points=[(1, 2), (None, 3), ("4", "x"), ("5", "6", 7)], children=[shape(children=[shape()]), 3, shape()]), {"points": None}, {"points": [{"y": 1, "x": 2}, {"x": 1}]}]}
    rows = [(t, k, p, i) for t, k, p, i, _ in N.visit(rec)]
    assert [r for r in rows if r[0] == "shape"] == [("shape", "1", "", 1), ("shape", "1.0", "1", 0), ("shape", "1.0.0", "1.0", 0), ("shape", "1.2", "1", 2), ("shape", "2", "", 2), ("shape", "3", "", 3)]
    assert [r[1] for r in rows if r[0] == "point"] == ["1#0", "1#3", "1.0#0", "1.0.0#0", "1.2#0", "3#0"]


def test_deep_nesting_is_walked_without_recursion():
    s = shape()
    for _ in range(2000):
        s = {"children": [s]}
    assert sum(1 for t, *_ in N.visit({"shapes": [s]}) if t == "shape") == 2001


def test_nothing_is_too_deep():
    """Neither shapes, nor envelopes, nor JSON in JSON strings, nor flags that nobody asked for."""
    deep = '{"points": [[1, 2]], "children": [' * 7000 + "]}" * 7000
    rows = list(N.visit(N.readable('{"shapes": [' + deep + "]}")))
    assert sum(t == "shape" for t, *_ in rows) == sum(t == "point" for t, *_ in rows) == 7000 and rows[-1][1].count(".") == 6999
    rec = {"shapes": [shape()]}
    v = rec
    for _ in range(300):
        v = {"payload": v, "sent": 1}
    assert N.readable(json.dumps(v)) == rec
    assert N.readable('{"payload": ' * 20_000 + json.dumps(rec) + "}" * 20_000) == rec
    text = json.dumps(rec)
    for _ in range(14):
        text = json.dumps(text)
    assert N.readable(text) == rec
    flags = '{"a": [1, ' * 5000 + "true" + "]}" * 5000
    (_, _, _, _, payload), *_ = N.visit(N.readable('{"shapes": [], "flags": ' + flags + "}"))
    assert payload[4] == flags


def test_own_parser_agrees():
    for text in ('{"a": [], "b": {}, "c": [1, -2.5e3, "x\\n\\u00e9", true, false, null, [[]], {"d": {"e": "}"}}]}', " [ ] ", "3", '"s"', "[-0, 0.5]"):
        assert N.parse_deep(text) == json.loads(text) and json.loads(N.to_text(json.loads(text))) == json.loads(text)
    for text in ("", "[1,]", '{"a" 1}', "[1", '{"a": 1,}', "[1] 2", "nul", "{1: 2}", '["a]', "[1 2]"):
        for f in (N.parse_deep, json.loads):
            with pytest.raises(ValueError):
                f(text)
    assert N.readable('{"shapes": [{"points": [[1' + "0" * 5000 + ", 2], [1, 2]]}]}") is not None


def deliveries(spark, rows):
    return spark.createDataFrame(rows, "delivery_id bigint, record_id bigint, raw string, tag string, pos string, payload string")


def test_flatten(spark):
    good = json.dumps({"version": 4, "shapes": [shape(["a", "b"]), shape({"name": "c", "conf": 1}, children=[shape(None)])], "imageHeight": "12"})
    x = ("t", "p", "l")
    rows = [(5, 1, good, *x), (3, 1, good, *x), (1, 1, good[:20], *x), (None, 2, good, *x), (7, None, good, *x), (8, 3, None, *x), (9, 4, '{"shapes": []}', *x), (5, 1, good, *x)]
    flat = N.flatten_records(deliveries(spark, rows))
    assert {(r.record_id, r.version, r.image_height) for r in flat["record"].collect()} == {(1, "4", 12), (2, "4", 12), (4, None, None)}
    shapes = flat["shape"].orderBy("record_id", "row_key").collect()
    assert [(r.record_id, r.row_key, r.parent_key, r.label, r.labels) for r in shapes if r.record_id == 1] == [(1, "0", "", "a", ["a", "b"]), (1, "1", "", "c", ["c"]), (1, "1.0", "1", None, [])]
    assert flat["point"].count() == 6
    assert sorted((r.record_id or 0, r.delivery_id, r.reason) for r in flat["unreadable"].collect()) == [(0, 7, "no record id"), (1, 1, "not readable"), (3, 8, "null")]
    parents = {(r.record_id, r.row_key) for r in shapes}
    assert all((r.record_id, r.parent_key) in parents for r in flat["point"].collect())


def test_flatten_empty(spark):
    flat = N.flatten_records(deliveries(spark, []))
    assert [flat[t].count() for t in N.TAGS] == [0, 0, 0, 0]
