"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import file_base
from tilewright.session import Scratch

#: site, day, flight and shot, in any of their spellings; what follows the shot is free.
SOURCE_NAME = r"(?i)^(.*?[a-z].*?)[\s_.\-]*(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})[\s_.\-]+f0*(\d+)[\s_.\-]+0*(\d+)"


def source_key(file_name: Column) -> Column:
    """site|day|flight|shot of a picture's file name, however written; null if any of the four is absent."""
    base = file_base(file_name)
    part = lambda k: F.regexp_extract(base, SOURCE_NAME, k)
    site = F.regexp_replace(F.lower(part(1)), r"[^\p{L}\p{N}]+", "")
    return F.when((part(6) != "") & (site != ""), F.concat_ws("|", site, F.concat(part(2), part(3), part(4)), part(5), part(6)))


def _size_hash(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).head()
    return r["n"], r["h"] or 0


def large_star_small_star(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(u, root) for every vertex of ``edges(u, v)``; root is the smallest vertex of its component.

    Alternates large-star (each vertex links its larger neighbours to the least of its neighbourhood) and small-star (each
    vertex links its smaller neighbours and itself to the least of them) until the edges no longer change; they are then
    stars. Each step is a partial aggregate and an equi-join on the vertex, so a hub is pre-aggregated before the shuffle and
    its joined rows are split by adaptive execution. Only a row count and a hash of the edges reach the driver.
    """
    now = scratch.write(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _size_hash(now)
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = scratch.write(both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.write(pairs.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(large)
        scratch.drop(now)
        now, before, mark = small, mark, _size_hash(small)
        if mark == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def related_groups(records: DataFrame, id_col: str, entity_cols: list[str]) -> DataFrame:
    """(record_id, group_id, linked) for every non-null record id: group_id is the smallest id among records that share any entity,
    directly or through others; linked tells whether there is another one.

    An entity is a non-null value of one of ``entity_cols`` (values of different columns are different entities). Repeated
    rows count once; null ids are left out; a record without entities is a group of its own. Empty input gives no rows.
    """
    scratch = Scratch(records.sparkSession, "groups")
    ids = F.col(id_col).cast("bigint").alias("record_id")
    cells = records.select(ids, F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("string").alias("e")) for i, c in enumerate(entity_cols)])).alias("c"))
    owns = scratch.write(cells.filter("record_id is not null and c.e is not null").select("record_id", "c.k", "c.e").distinct())
    first = owns.groupBy("k", "e").agg(F.min("record_id").alias("v"))
    edges = owns.join(first, ["k", "e"]).select(F.col("record_id").alias("u"), "v")
    roots = large_star_small_star(edges, scratch)
    every = records.select(ids).filter("record_id is not null").distinct()
    return every.join(roots.withColumnRenamed("u", "record_id"), "record_id", "left").select("record_id", F.coalesce("root", "record_id").alias("group_id"), F.col("root").isNotNull().alias("linked"))


def share(group: Column, salt: str = "") -> Column:
    """A group's fixed place in [0, 1): 32 bits of the md5 of its id."""
    return F.conv(F.substring(F.md5(F.concat(group.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def split_of(group: Column, proportions: list[tuple[str, float]], salt: str = "") -> Column:
    """The split whose range the group's place falls into. The same group goes to the same split in every run and beside any other data."""
    total, upto, out = sum(p for _, p in proportions), 0.0, None
    for name, p in proportions[:-1]:
        upto += p / total
        hit = share(group, salt) < F.lit(upto)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    last = proportions[-1][0]
    return F.lit(last) if out is None else out.otherwise(last)


def picture_groups(images: DataFrame) -> DataFrame:
    return related_groups(images.select(F.col("id").alias("record_id"), source_key(F.col("file_name")).alias("source")), "record_id", ["source"])
