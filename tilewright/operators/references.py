"""References to rows that are not there: missing, deleted, or arriving later."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.session import Scratch, fits_broadcast

MATCHES = ("simple", "partial", "full")


def target_intervals(targets: DataFrame, keys: list[str], since: str, until: str) -> DataFrame:
    """keys, t0, t1 (null: still there): the times at which a target is there, as disjoint intervals.

    Rows of one key that overlap are merged, so a key that is delivered over and over costs one row. Rows without a start
    never begin; an interval that ends no later than it starts is empty.
    """
    spans = targets.filter(F.col(since).isNotNull()).groupBy(*keys, F.col(since).alias("t0")).agg(F.max(F.coalesce(F.col(until), F.lit("9999-12-31 23:59:59").cast(targets.schema[until].dataType))).alias("t1")).filter("t1 > t0")
    by = Window.partitionBy(*keys).orderBy("t0")
    reach = F.max("t1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach.isNull() | (F.col("t0") > reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("island")


def _equal(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [x == y for x, y in pairs])


def orphan_references(refs: DataFrame, targets: DataFrame, keys: dict[str, str], at: str, since: str = "loaded_at", until: str = "deleted_at", match: str = "simple") -> DataFrame:
    """The rows of ``refs`` whose target is not there at the row's time ``at``, with ``orphan_kind`` added.

    ``keys`` maps the reference's key columns to the target's. References are grouped by which of their columns are null
    and each group is anti-joined on its other columns alone. Match semantics as declared in SQL:

    * simple: a key with any null refers to nothing and is never an orphan;
    * partial: the columns that are not null must agree with some target; all null refers to nothing;
    * full: all null refers to nothing; null beside non-null is an orphan of kind ``partial_null``.

    A target is there if one of its rows has since <= at and until null or > at. Kinds: ``missing`` (no row of that key),
    ``late`` (all its rows start after ``at``), else ``deleted``. With a null ``at`` nothing can be said to have been there:
    only ``missing`` is reported. Repeated reference rows come out as often as they came in; empty targets make every
    reference missing. Extra columns are kept and may have any name, those of ``targets`` included.

    The target side is two small tables (merged intervals; first start of each key). They are broadcast only if their
    counted rows fit the bound; beyond it the joins shuffle on the key and adaptive execution splits the partitions of hot keys.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    scratch = Scratch(refs.sparkSession, "references")
    rcols, tkeys = list(keys), [f"__t{i}" for i in range(len(keys))]
    t = targets.select(*(F.col(c).alias(k) for c, k in zip(keys.values(), tkeys, strict=True)), F.col(since).alias("__since"), F.col(until).alias("__until"))
    out = []
    for mask in product((True, False), repeat=len(rcols)):
        has = [(c, k) for c, k, m in zip(rcols, tkeys, mask, strict=True) if m]
        here = reduce(lambda a, b: a & b, [F.col(c).isNotNull() if m else F.col(c).isNull() for c, m in zip(rcols, mask, strict=True)])
        if not has or (match == "simple" and not all(mask)):
            continue
        part = refs.filter(here)
        if match == "full" and not all(mask):
            out.append(part.withColumn("orphan_kind", F.lit("partial_null")))
            continue
        tk = [k for _, k in has]
        known = t.dropna(subset=tk)
        spans = scratch.write(target_intervals(known, tk, "__since", "__until").withColumnsRenamed({"t0": "__from", "t1": "__upto"}))
        first = scratch.write(known.groupBy(*tk).agg(F.min("__since").alias("__first")))
        hint = F.broadcast if fits_broadcast(first, 64 + 32 * len(tk)) and fits_broadcast(spans, 80 + 32 * len(tk)) else lambda d: d
        on = _equal([(F.col(c), F.col(k)) for c, k in has])
        gone = part.join(hint(spans), on & (F.col("__from") <= F.col(at)) & (F.col("__upto") > F.col(at)), "left_anti")
        kinds = gone.join(hint(first.withColumn("__there", F.lit(True))), on, "left").withColumn("orphan_kind", F.when(F.col("__there").isNull(), "missing").when(F.col("__first") > F.col(at), "late").when(F.col(at).isNotNull(), "deleted"))
        out.append(kinds.filter("orphan_kind is not null").drop(*tk, "__first", "__there"))
    if not out:
        return refs.limit(0).withColumn("orphan_kind", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, out)
