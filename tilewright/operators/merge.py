"""Suppressing and merging overlapping detections.

Three interchangeable strategies give the same groups:

* ``arrow``: one Arrow batch per group and a NumPy kernel; for groups of bounded size;
* ``fold``: a Catalyst higher-order fold over the group's sorted array (suppression only); no Python;
* ``relational``: grid join to match edges, then rounds of joins; for groups of any size, as nothing is gathered per group.

``auto`` counts the groups once. Those above ``max_group`` boxes are taken apart into the connected components of their match
graph, on which the result depends and nothing else; components above ``max_group`` go the relational way, the rest to ``arrow``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import kernels as K
from tilewright.functions import polygons as P
from tilewright.operators.components import connected
from tilewright.operators.overlap import grid_pairs
from tilewright.session import Scratch, ship_package

METRICS = ("IOU", "IOS")
METHODS = ("nms", "greedy_nmm", "nmm", "union_merge", "legacy_nms")
STRATEGIES = ("auto", "arrow", "fold", "relational")
MAX_GROUP = 50_000


@dataclass(frozen=True)
class Merging:
    """How detections of a group are put together. ``class_agnostic`` False makes the category part of the group."""

    method: str = "greedy_nmm"
    metric: str = "IOS"
    threshold: float = 0.5
    class_agnostic: bool = False
    strategy: str = "auto"
    max_group: int = MAX_GROUP

    def __post_init__(self) -> None:
        for value, allowed in ((self.method, METHODS), (self.metric, METRICS), (self.strategy, STRATEGIES)):
            if value not in allowed:
                raise ValueError(f"{value!r} is not one of {allowed}")


def _keys(keys: list[str], how: Merging) -> list[str]:
    return keys if how.class_agnostic or "category_id" in keys else [*keys, "category_id"]


def _blocks(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    box = np.stack([np.asarray(t.column(k), dtype=np.float64) for k in ("x1", "y1", "x2", "y2")], axis=1)
    return box, np.asarray(t.column("score"), dtype=np.float64)


#: Rows of a bucket, as a rule: an Arrow table of some megabytes.
BUCKET_ROWS = 100_000


def buckets(df: DataFrame, rows: int) -> int:
    """How many buckets ``rows`` rows are hashed into: by their number, and some to each shuffle partition."""
    return max(8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def bucketed(df: DataFrame, keys: list[str], kernel: Callable[[pa.Table], pa.Table], fields: str, rows: int | None = None) -> DataFrame:
    """Runs a kernel on every group of keys, many groups to an Arrow batch: groups are hashed into as many buckets as the number
    of rows asks for (counted here unless given), so small groups don't each pay for a batch of their own."""
    ship_package(df.sparkSession)
    n = buckets(df, df.count() if rows is None else rows)

    def f(t: pa.Table) -> pa.Table:
        t = t.drop_columns(["__bucket"]).sort_by([(k, "ascending") for k in keys])
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t.column(k).combine_chunks().dictionary_encode("encode")
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            codes = np.asarray(c.indices)
            new[1:] |= codes[1:] != codes[:-1]
        at = [0, *np.flatnonzero(new).tolist(), t.num_rows]
        return pa.concat_tables([kernel(t.slice(a, b - a)) for a, b in zip(at[:-1], at[1:], strict=True)])

    return df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(n))).groupBy("__bucket").applyInArrow(f, fields)


def _group_kernel(how: Merging, key_types: dict[str, pa.DataType]):
    def f(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        box, score = _blocks(t)
        if how.method == "nmm":
            owner, claim = K.transitive(box, score, how.metric, how.threshold)
        else:
            owner = K.greedy(box, score, how.metric, how.threshold, strict=how.method == "legacy_nms")
            rank = np.empty(len(box), np.int64)
            rank[np.argsort(-score, kind="stable") if how.method == "legacy_nms" else K.order(box, score)] = np.arange(len(box))
            claim = rank
        pos = np.zeros(len(box), np.int32)
        members = K.member_order(owner, claim)
        start = np.searchsorted(owner[members], owner[members], "left")
        pos[members] = np.arange(len(members)) - start + 1
        ids = np.asarray(t.column("id"))
        return pa.table({**{k: t.column(k) for k in key_types}, "id": ids, "keeper": ids[owner], "pos": pos})

    return f


def _codes(t: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each group of keys."""
    code = np.zeros(t.num_rows, np.int64)
    for k in keys:
        c = t.column(k).combine_chunks().dictionary_encode("encode")
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        code = np.unique(code * (len(c.dictionary) + 1) + np.asarray(c.indices), return_inverse=True)[1]
    return code


def _whole_kernel(how: Merging, keys: list[str], gk: list[str], members_too: bool):
    """Groups the boxes of a whole bucket and folds them, all groups at once; groups with boxes far larger than most of them one by one."""

    def f(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        box, score = _blocks(t)
        code, n = _codes(t, gk), t.num_rows
        owner, claim = np.arange(n), np.zeros(n, np.int64)
        odd = K.with_wide(box, code)
        plain = np.flatnonzero(~np.isin(code, odd))
        for at, group in [(plain, np.unique(code[plain], return_inverse=True)[1]), *((np.flatnonzero(code == g), None) for g in odd.tolist())]:
            if how.method == "nmm":
                own, claim[at] = K.transitive(box[at], score[at], how.metric, how.threshold, group)
            else:
                own = K.greedy(box[at], score[at], how.metric, how.threshold, group=group)
                claim[at[K.order(box[at], score[at])]] = np.arange(len(at))
            owner[at] = at[own]
        b, s, c, k, took = K.fold_members(box, score, np.asarray(t.column("category_id")), owner, K.member_order(owner, claim), how.metric, how.threshold)
        kept = np.flatnonzero(owner == np.arange(n))
        if members_too:
            on = np.concatenate([kept, np.flatnonzero(took)])
            return pa.table({x: t.column(x).take(pa.array(on)) for x in keys} | {"keeper": t.column("id").take(pa.array(owner[on])), "id": t.column("id").take(pa.array(on))})
        cols = {x: t.column(x).take(pa.array(kept)) for x in [*keys, "id"]}
        return pa.table(cols | {"category_id": c[kept].astype(np.int32), "score": s[kept], "x1": b[kept, 0], "y1": b[kept, 1], "x2": b[kept, 2], "y2": b[kept, 3], "n_merged": k[kept]})

    return f


def _folded(b: DataFrame, keys: list[str], how: Merging, members_too: bool, fields: str) -> tuple[DataFrame, int]:
    """Kept boxes with what they absorbed, or pairs of them and what they absorbed, and the number of boxes. A group of at most
    max_group boxes is grouped and folded in the bucket it comes to; beyond it, groups and folds are steps of their own."""
    gk = _keys(keys, how)
    plain_keys = [k for k in gk if k != "category_id"]
    ship_package(b.sparkSession)
    apart = lambda d: _by_keeper(_placed(d, keys, how)).applyInArrow(_merge_kernel(how, plain_keys, members_too), fields)
    if how.threshold <= 0 or how.strategy == "relational":
        return apart(b), b.count()
    scratch = Scratch(b.sparkSession, "folded")
    rows, big = _large(b, gk, how.max_group, scratch) if how.strategy == "auto" else (b.count(), None)
    n = buckets(b, rows)
    whole = lambda d: d.withColumn("__bucket", F.pmod(F.xxhash64(*gk), F.lit(n))).groupBy("__bucket").applyInArrow(_whole_kernel(how, plain_keys, gk, members_too), fields)
    if big is None:
        return whole(b), rows
    return whole(b.join(big, gk, "left_anti")).unionByName(apart(scratch.write(b.join(big, gk, "left_semi")))), rows


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _arrow_groups(boxes: DataFrame, keys: list[str], how: Merging, rows: int | None = None) -> DataFrame:
    return bucketed(boxes, keys, _group_kernel(how, dict.fromkeys(keys)), f"{_fields(boxes, keys)}, id bigint, keeper bigint, pos int", rows)


def _order(how: Merging) -> list[str]:
    """What decides between equal scores."""
    return ["id"] if how.method == "legacy_nms" else ["x1", "y1", "x2", "y2", "id"]


def ranked(boxes: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "x1", "y1", "x2", "y2", "id")
    return boxes.withColumn("rank", F.row_number().over(w))


def fold_nms(boxes: DataFrame, keys: list[str], how: Merging) -> DataFrame:
    """Kept ids by one higher-order fold over each group's array, in rank order."""
    item = F.struct((-F.col("score")).alias("s"), "x1", "y1", "x2", "y2", "id", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))
    g = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("b"))

    def hit(k, b):
        w, h = F.least(k["x2"], b["x2"]) - F.greatest(k["x1"], b["x1"]), F.least(k["y2"], b["y2"]) - F.greatest(k["y1"], b["y1"])
        den = F.least(k["area"], b["area"]) if how.metric == "IOS" else k["area"] + b["area"] - w * h
        # most pairs fall at the first of these
        return (w > 0) & (h > 0) & (w * h / den >= how.threshold)

    empty = F.slice("b", 1, 0)
    kept = F.aggregate("b", empty, lambda acc, b: F.when(F.exists(acc, lambda k: hit(k, b)), acc).otherwise(F.array_append(acc, b)))
    return g.select(*keys, F.explode(kept).alias("k")).select(*keys, F.col("k.id").alias("id"))


def _pairs(boxes: DataFrame, keys: list[str], how: Merging) -> DataFrame:
    return grid_pairs(boxes, keys, "id", how.metric, how.threshold, strict=how.method == "legacy_nms").select("i", "j")


def _edges(boxes: DataFrame, pairs: DataFrame, how: Merging, scratch: Scratch) -> DataFrame:
    """(lo, hi) of each matching pair: the better-ranked box and the other; dominated tells whether lo may claim hi."""
    cols = ["id", "score", "x1", "y1", "x2", "y2"]
    own = boxes.select(*cols)
    a, b = (own.select(*[F.col(c).alias(f"{s}_{c}") for c in cols]) for s in "ab")
    j = pairs.join(a, F.col("i") == F.col("a_id")).join(b, F.col("j") == F.col("b_id"))
    key = lambda s: F.struct((-F.col(f"{s}_score")).alias("s"), *[F.col(f"{s}_{c}").alias(c) for c in _order(how)])
    first = key("a") < key("b")
    same = F.col("a_score") == F.col("b_score")
    twin = same & (F.col("a_x1") == F.col("b_x1")) & (F.col("a_y1") == F.col("b_y1")) & (F.col("a_x2") == F.col("b_x2")) & (F.col("a_y2") == F.col("b_y2"))
    return scratch.write(j.select(F.when(first, F.col("i")).otherwise(F.col("j")).alias("lo"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("hi"), (~same | twin).alias("dominates"), F.when(first, key("a")).otherwise(key("b")).alias("lo_key")))


def _relational_groups(boxes: DataFrame, keys: list[str], how: Merging, pairs: DataFrame | None = None) -> DataFrame:
    """Greedy: a box with no undecided better neighbour is kept and takes its neighbours; rounds until all are decided.
    Transitive: each box hangs from its best dominating neighbour; roots by pointer doubling."""
    scratch = Scratch(boxes.sparkSession, "merge")
    boxes = scratch.write(boxes.select(*keys, "id", "score", "x1", "y1", "x2", "y2"))
    edges = _edges(boxes, _pairs(boxes, keys, how) if pairs is None else pairs, how, scratch)
    if how.method == "nmm":
        hung = edges.filter("dominates").groupBy("hi").agg(F.min("lo_key").alias("k")).select(F.col("hi").alias("id"), F.col("k.id").alias("up"))
        up = scratch.write(hung)
        while True:
            above = up.select(F.col("id").alias("up"), F.col("up").alias("up2"))
            nxt = scratch.write(up.join(above, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")))
            if not nxt.filter("moved").limit(1).count():
                break
            up = nxt.select("id", "up")
        owners = up.select("id", F.col("up").alias("keeper"))
    else:
        left, gone = edges.select("lo", "hi"), None
        while left.limit(1).count():
            waiting = left.select(F.col("hi").alias("lo")).distinct()
            takes = scratch.write(left.join(waiting, "lo", "left_anti"))
            got = scratch.write(takes.select(F.col("hi").alias("id")).distinct())
            gone = got if gone is None else gone.unionByName(got)
            done = got.unionByName(takes.select(F.col("lo").alias("id"))).distinct()
            before, left = left, scratch.write(left.join(done.withColumnRenamed("id", "lo"), "lo", "left_anti").join(got.withColumnRenamed("id", "hi"), "hi", "left_anti"))
            scratch.drop(takes)
            scratch.drop(before)
        if gone is None:
            owners = boxes.select("id", F.col("id").alias("keeper")).limit(0)
        else:  # only now is it known which better neighbour was kept
            kept = edges.join(gone.withColumnRenamed("id", "lo"), "lo", "left_anti").join(gone.withColumnRenamed("id", "hi"), "hi", "left_semi")
            owners = kept.groupBy("hi").agg(F.min("lo_key").alias("k")).select(F.col("hi").alias("id"), F.col("k.id").alias("keeper"))
    claims = edges.filter("dominates").groupBy("hi").agg(F.min("lo_key").alias("claim")).withColumnRenamed("hi", "id") if how.method == "nmm" else None
    out = boxes.join(owners, "id", "left").withColumn("keeper", F.coalesce("keeper", "id"))
    own = F.struct((-F.col("score")).alias("s"), *_order(how))
    out = out.withColumn("claim", own) if claims is None else out.join(claims, "id", "left")
    w = Window.partitionBy("keeper").orderBy("claim", "id")
    members = out.filter("id != keeper").withColumn("pos", F.row_number().over(w))
    return out.filter("id = keeper").select(*keys, "id", "keeper", F.lit(0).alias("pos")).unionByName(members.select(*keys, "id", "keeper", "pos"))


def groups(boxes: DataFrame, keys: list[str], how: Merging = Merging()) -> DataFrame:
    """(keys, id, keeper, pos) for every box(keys, id, category_id, score, x1..y2): which kept box takes it; pos is 0 for keepers and
    orders the others. Ids must be unique. A threshold of 0 or less matches all boxes of a group, in closed form."""
    keys = _keys(keys, how)
    b = boxes.select(*keys, F.col("id").cast("bigint").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("score", "x1", "y1", "x2", "y2")])
    if how.threshold < 0 or (how.threshold == 0 and how.method != "legacy_nms"):
        return _match_all(b, keys, how)
    if how.strategy == "relational":
        return _relational_groups(b, keys, how)
    if how.strategy == "arrow":
        return _arrow_groups(b, keys, how)
    scratch = Scratch(boxes.sparkSession, "groups")
    rows, big = _large(b, keys, how.max_group, scratch)
    if big is None:
        return _arrow_groups(b, keys, how, rows)
    small = _arrow_groups(b.join(big, keys, "left_anti"), keys, how, rows)
    large = scratch.write(b.join(big, keys, "left_semi"))
    return small.unionByName(_by_components(large, keys, how, scratch))


def _large(b: DataFrame, keys: list[str], most: int, scratch: Scratch) -> tuple[int, DataFrame | None]:
    """The number of rows, and the groups of more than ``most`` of them, if any."""
    sizes = scratch.write(b.groupBy(*keys).agg(F.count("*").alias("n")))
    r = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).head()
    return r["rows"] or 0, sizes.filter(F.col("n") > most).select(*keys) if (r["most"] or 0) > most else None


def _by_components(large: DataFrame, keys: list[str], how: Merging, scratch: Scratch) -> DataFrame:
    pairs = scratch.write(_pairs(large, keys, how))
    roots = connected(pairs.toDF("a", "b"), scratch)
    placed = scratch.write(large.join(roots.withColumnRenamed("v", "id"), "id", "left").withColumn("__root", F.coalesce("root", "id")).drop("root"))
    # nothing matches a box without pairs, whatever group it is put into
    rows, big = _large(placed, ["__root"], how.max_group, scratch)
    if big is None:
        return _arrow_groups(placed, [*keys, "__root"], how, rows).drop("__root")
    rest = _arrow_groups(placed.join(big, "__root", "left_anti"), [*keys, "__root"], how, rows).drop("__root")
    huge = scratch.write(placed.join(big, "__root", "left_semi").drop("__root"))
    among = pairs.join(huge.select(F.col("id").alias("i")), "i", "left_semi")
    return rest.unionByName(_relational_groups(huge, keys, how, among))


def _match_all(b: DataFrame, keys: list[str], how: Merging) -> DataFrame:
    item = F.struct((-F.col("score")).alias("s"), *dict.fromkeys([*_order(how), "x1", "y1", "x2", "y2"]))
    top = b.groupBy(*keys).agg(F.min(item).alias("top"))
    j = b.join(top, keys)
    taken = F.lit(True)
    if how.method == "nmm":
        twin = (F.col("x1") == F.col("top.x1")) & (F.col("y1") == F.col("top.y1")) & (F.col("x2") == F.col("top.x2")) & (F.col("y2") == F.col("top.y2"))
        taken = (-F.col("score") > F.col("top.s")) | ((-F.col("score") == F.col("top.s")) & twin)
    j = j.withColumn("keeper", F.when(taken, F.col("top.id")).otherwise(F.col("id")))
    by = ["id"] if how.method == "nmm" else [F.col("score").desc(), *_order(how)]
    members = j.filter("id != keeper").withColumn("pos", F.row_number().over(Window.partitionBy("keeper").orderBy(*by)))
    return j.filter("id = keeper").select(*keys, "id", "keeper", F.lit(0).alias("pos")).unionByName(members.select(*keys, "id", "keeper", "pos"))


def nms(boxes: DataFrame, keys: list[str], metric: str = "IOU", threshold: float = 0.5, class_agnostic: bool = True, strategy: str = "auto", strict: bool = False) -> DataFrame:
    """(keys, id) of the kept boxes: a box goes if its metric with a kept better one is at least the threshold (``strict``: above it)."""
    how = Merging("legacy_nms" if strict else "nms", metric, threshold, class_agnostic, "auto" if strategy == "fold" else strategy)
    keys = _keys(keys, how)
    if strategy == "fold":
        return fold_nms(boxes, keys, how)
    return groups(boxes, keys, how).filter("id = keeper").select(*keys, "id")


def _merge_kernel(how: Merging, keys: list[str], members_too: bool = False):
    def f(t: pa.Table) -> pa.Table:
        t = t.sort_by([("keeper", "ascending"), ("pos", "ascending")])
        box, score = _blocks(t)
        cat = np.asarray(t.column("category_id"))
        owner = np.searchsorted(np.asarray(t.column("keeper")), np.asarray(t.column("keeper")), "left")
        members = np.flatnonzero(np.asarray(t.column("pos")) > 0)
        b, s, c, k, took = K.fold_members(box, score, cat, owner, members, how.metric, how.threshold)
        if members_too:
            on = np.flatnonzero(took | (np.asarray(t.column("pos")) == 0))
            return pa.table({x: t.column(x).take(pa.array(on)) for x in [*keys, "keeper", "id"]})
        kept = np.flatnonzero(np.asarray(t.column("pos")) == 0)
        cols = {x: t.column(x).take(pa.array(kept)) for x in [*keys, "id"]}
        return pa.table(cols | {"category_id": c[kept].astype(np.int32), "score": s[kept], "x1": b[kept, 0], "y1": b[kept, 1], "x2": b[kept, 2], "y2": b[kept, 3], "n_merged": k[kept]})

    return f


def _union_kernel(how: Merging, keys: list[str]):
    def f(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        box, score = _blocks(t)
        keep, grown, n = K.union_merge(box, score, how.metric, how.threshold)
        rows = t.take(pa.array(keep))
        return pa.table({**{k: rows.column(k) for k in [*keys, "id"]}, "category_id": rows.column("category_id").cast(pa.int32()), "score": rows.column("score"), "x1": grown[:, 0], "y1": grown[:, 1], "x2": grown[:, 2], "y2": grown[:, 3], "n_merged": n})

    return f


def merged(boxes: DataFrame, keys: list[str], how: Merging = Merging()) -> DataFrame:
    """(keys, id, category_id, score, x1..y2, n_merged): kept boxes with what they absorbed.

    Members are folded in order and must overlap the grown box by more than the threshold (grouping asks for at least it); those
    that do not are dropped. Scores: the greater; category: the higher score's, the member's on a tie. Suppression merges nothing.
    """
    gk = _keys(keys, how)
    plain_keys = [k for k in gk if k != "category_id"]
    fields = f"{_fields(boxes, plain_keys)}, id bigint, category_id int, score double, x1 double, y1 double, x2 double, y2 double, n_merged bigint"
    b = boxes.select(*plain_keys, F.col("id").cast("bigint").alias("id"), F.col("category_id").cast("int").alias("category_id"), *[F.col(c).cast("double").alias(c) for c in ("score", "x1", "y1", "x2", "y2")])
    if how.method == "union_merge":
        return _union_merged(b, gk, plain_keys, how, fields)
    if how.method in ("nms", "legacy_nms"):
        return _placed(b, keys, how).filter("id = keeper").drop("keeper", "pos").withColumn("n_merged", F.lit(0).cast("bigint")).select(*plain_keys, "id", "category_id", "score", "x1", "y1", "x2", "y2", "n_merged")
    return _folded(b, keys, how, False, fields)[0]


def _placed(b: DataFrame, keys: list[str], how: Merging) -> DataFrame:
    ship_package(b.sparkSession)
    return b.join(groups(b, keys, how).select("id", "keeper", "pos"), "id")


def _by_keeper(j: DataFrame):
    """Whatever is folded together shares a keeper, so keepers are hashed, and a huge scene is spread over its keepers."""
    return j.groupBy(F.pmod(F.xxhash64("keeper"), F.lit(buckets(j, j.count()))).alias("__bucket"))


def merged_masks(boxes: DataFrame, keys: list[str], how: Merging = Merging()) -> DataFrame:
    """(keys, id, segmentation) of the kept boxes of ``merged``: the union, on the pixel raster, of the polygons of each kept box and
    of those it absorbed. boxes carry a ``segmentation``, null or empty where there is none; a kept box that absorbed nothing
    keeps its polygons as they are, and its null if all are. Suppression absorbs nothing."""
    gk = _keys(keys, how)
    plain_keys = [k for k in gk if k != "category_id"]
    own = boxes.select(*plain_keys, F.col("id").cast("bigint").alias("id"), F.col("category_id").cast("int").alias("category_id"), *[F.col(c).cast("double").alias(c) for c in ("score", "x1", "y1", "x2", "y2")])
    drawn = boxes.select(*plain_keys, F.col("id").cast("bigint").alias("id"), F.col("segmentation").cast("array<array<double>>").alias("segmentation"))
    if how.method in ("nms", "legacy_nms"):
        return drawn.join(_placed(own, keys, how).filter("id = keeper").select("id"), "id", "left_semi").select(*plain_keys, "id", "segmentation")
    if how.method == "union_merge":
        raise ValueError("union_merge merges boxes only")
    took, rows = _folded(own, keys, how, True, f"{_fields(own, plain_keys)}, keeper bigint, id bigint")
    # drawing costs far more than its bytes tell, so partitions are not left to be coalesced by size
    parts = max(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    rings = took.join(drawn.select("id", "segmentation"), "id").repartition(parts, "keeper").groupBy("keeper").agg(*[F.first(k).alias(k) for k in plain_keys], F.count("*").alias("n"), F.flatten(F.collect_list("segmentation")).alias("s"))
    # the null spares the single ones being drawn, for a Python function sees every row
    united = P.union_rings(F.when(F.col("n") > 1, F.col("s"))).cast("array<array<double>>")
    return rings.select(*plain_keys, F.col("keeper").alias("id"), F.when(F.size("s") > 0, F.when(F.col("n") == 1, F.col("s")).otherwise(united)).alias("segmentation"))


def _union_merged(b: DataFrame, gk: list[str], plain_keys: list[str], how: Merging, fields: str) -> DataFrame:
    """Groups of more than max_group boxes are taken apart into clusters whose hulls are disjoint: a grown box never leaves the hull
    of its cluster, so clusters don't meet. One cluster is worked through by one task, as each step depends on the one before."""
    kernel = _union_kernel(how, plain_keys)
    scratch = Scratch(b.sparkSession, "union")
    rows, big = _large(b, gk, how.max_group, scratch)
    if big is None or how.threshold < 0:
        return bucketed(b, gk, kernel, fields, rows)
    small = bucketed(b.join(big, gk, "left_anti"), gk, kernel, fields, rows)
    large = scratch.write(b.join(big, gk, "left_semi"))
    hulls = scratch.write(large.select(*gk, F.col("id").alias("root"), "x1", "y1", "x2", "y2"))
    member = hulls.select(F.col("root").alias("id"), "root")
    while True:
        touch = scratch.write(grid_pairs(hulls, gk, "root", "IOS", 0.0, strict=True).select(F.col("i").alias("a"), F.col("j").alias("b")))
        if not touch.limit(1).count():
            break
        up = connected(touch, scratch).select(F.col("v").alias("root"), F.col("root").alias("next"))
        lift = lambda d: d.join(up, "root", "left").withColumn("root", F.coalesce("next", "root")).drop("next")  # noqa: E731, B023
        member = scratch.write(lift(member))
        hulls = scratch.write(lift(hulls).groupBy(*gk, "root").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")))
    return small.unionByName(bucketed(large.join(member.withColumnRenamed("root", "__root"), "id"), [*gk, "__root"], kernel, fields, rows))


def low_confidence_rewrite(how: Merging, confidence: float, model_gives_obb: bool = False, force: bool = False) -> Merging:
    """Below a confidence of 0.1 merging would chain everything: plain suppression by IoU is used, unless forced; oriented boxes are only ever suppressed."""
    if model_gives_obb:
        return replace(how, method="nms")
    if confidence < 0.1 and how.method != "nms" and not force:
        return replace(how, method="nms", metric="IOU")
    return how
