import datetime as dt

import pytest

from tilewright.operators.references import orphan_references, target_intervals

T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
REFS = "rid int, key bigint, sub string, at timestamp, loaded_at string, t0 string, t1 string, id string"
TARGETS = "id bigint, part string, loaded_at timestamp, deleted_at timestamp, rid int"


def refs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], REFS)


def targets(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], TARGETS)


def kinds(df):
    return sorted((r.rid, r.orphan_kind) for r in df.collect())


def test_simple(spark):
    t = targets(spark, [(1, None, T(0), None), (2, None, T(0), T(10)), (2, None, T(20), None), (3, None, T(5), None), (4, None, None, None)])
    r = refs(spark, [(1, 1, None, T(1)), (2, 2, None, T(9)), (3, 2, None, T(10)), (4, 2, None, T(20)), (5, 3, None, T(4)), (6, 9, None, T(1)), (7, None, None, T(1)), (8, 9, None, None), (9, 1, None, None), (10, 3, None, T(4)), (10, 3, None, T(4))])
    assert kinds(orphan_references(r, t, {"key": "id"}, "at")) == [(3, "deleted"), (5, "late"), (6, "missing"), (8, "missing"), (10, "late"), (10, "late")]
    assert kinds(orphan_references(r.filter("rid in (1, 7)"), targets(spark, []), {"key": "id"}, "at")) == [(1, "missing")]
    assert orphan_references(refs(spark, []), t, {"key": "id"}, "at").count() == 0


@pytest.mark.parametrize(("match", "want"), [("simple", [(2, "missing")]), ("partial", [(2, "missing"), (4, "missing")]), ("full", [(2, "missing"), (3, "partial_null"), (4, "partial_null")])])
def test_masks(spark, match, want):
    t = targets(spark, [(1, "a", T(0), None), (2, "b", T(0), None)])
    r = refs(spark, [(1, 1, "a", T(1)), (2, 1, "b", T(1)), (3, 1, None, T(1)), (4, None, "z", T(1)), (5, None, None, T(1))])
    assert kinds(orphan_references(r, t, {"key": "id", "sub": "part"}, "at", match=match)) == want


def test_bad_match(spark):
    with pytest.raises(ValueError):
        orphan_references(refs(spark, []), targets(spark, []), {"key": "id"}, "at", match="loose")


def test_intervals_merge(spark):
    t = targets(spark, [(1, None, T(0), T(5)), (1, None, T(3), T(8)), (1, None, T(3), T(4)), (1, None, T(8), T(9)), (1, None, T(11), None), (1, None, T(12), T(12))])
    got = sorted((r.t0, r.t1.year == 9999, r.t1) for r in target_intervals(t, ["id"], "loaded_at", "deleted_at").collect())
    assert [(a, b) for a, b, _ in got] == [(T(0), False), (T(11), True)] and got[0][2] == T(9)
