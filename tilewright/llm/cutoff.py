"""Score cutoffs that keep a target fraction of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.text import is_blank, spelling
from tilewright.llm.topn import scored
from tilewright.session import Scratch, cores, fits_broadcast


def with_source(dets: DataFrame, targets: DataFrame, categories: DataFrame) -> DataFrame:
    """dets' det_id and score with ``source``: the target name its category_name spells or, if that is null or blank, the name of
    its category_id spells; rows of neither are left out. Two targets of one spelling are an error. The two dimensions are
    broadcast behind a count of their rows."""
    spelt = targets.select(F.col("category_name").alias("source"), spelling(F.col("category_name")).alias("key")).filter("key != ''").distinct()
    twice = F.raise_error(F.concat(F.lit("two targets spell alike: "), F.array_join(F.collect_set("source"), ", ")))
    names = spelt.groupBy("key").agg(F.when(F.count("*") > 1, twice).otherwise(F.min("source")).alias("source")).select("source", "key")
    by_id = categories.select(F.col("id").cast("bigint").alias("cid"), F.col("name").alias("cname")).dropDuplicates(["cid"])
    small = lambda d, width: F.broadcast(d) if fits_broadcast(d, width) else d
    own = dets.select("det_id", "score", F.col("category_name").alias("n"), F.col("category_id").cast("bigint").alias("cid"))
    named = own.join(small(by_id, 256), "cid", "left").select("det_id", "score", spelling(F.when(is_blank(F.col("n")), F.col("cname")).otherwise(F.col("n"))).alias("key"))
    return named.join(small(names, 256), "key").select("source", "score", "det_id")


def kept_fraction(items: DataFrame, targets: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows: source, det_id, score; report: source, keep_pct, n_items, cutoff, n_kept).

    ``items(source, score, det_id)``, repeated rows counting once; rows without source or with a score outside 0..1 (null, NaN)
    are left out. The cutoff is the highest score of the source at or above which at least keep_pct percent of it lie, so all
    ties at the cutoff are kept. keep_pct of 0 or less keeps the best score; above 100 or null there is no cutoff.

    The rows are range-sorted by (source, score, det_id) once: a source that holds a third of all rows, or one score that does,
    is spread over as many partitions as its size asks for, and repeats of a row meet in one. Counts per partition and source
    are prefix-summed; they name the one partition in which the cutoff lies, and only its rows of that source are numbered.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "cutoff")
    parts = parts or max(cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    clean = items.filter(F.col("source").isNotNull() & scored(F.col("score"))).select("source", F.col("score").cast("double").alias("score"), "det_id")
    ranged = clean.repartitionByRange(parts, F.col("source"), F.col("score").desc(), F.col("det_id")).distinct()
    rows = scratch.write(ranged.withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy("source", "part").agg(F.count("*").alias("n"))
    wanted = targets.select(F.col("category_name").alias("source"), F.col("keep_pct").cast("bigint").alias("keep_pct")).filter("keep_pct is not null").dropDuplicates(["source"])
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(wanted, "source").withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("source")))
    placed = placed.withColumn("need", F.greatest(F.lit(1), F.expr("(total * keep_pct + 99) div 100")))
    spot = scratch.write(placed.filter("before < need and need <= before + n").select("source", "part", "keep_pct", "total", (F.col("need") - F.col("before")).alias("nth")))
    hint = F.broadcast if fits_broadcast(spot, 256) else lambda d: d
    order = Window.partitionBy("source", "part").orderBy(F.col("score").desc(), "det_id")
    cut = rows.join(hint(spot), ["source", "part"]).withColumn("rn", F.row_number().over(order)).filter("rn = nth").select("source", "keep_pct", F.col("total").alias("n_items"), F.col("score").alias("cutoff"))
    cuts = scratch.write(cut)
    kept = rows.join(hint(cuts.select("source", "cutoff")), "source").filter("score >= cutoff").select("source", "det_id", "score")
    sizes = kept.groupBy("source").agg(F.count("*").alias("n_kept"))
    return kept, cuts.join(sizes, "source").select("source", "keep_pct", "n_items", "cutoff", "n_kept")
