"""What a drawing would need, as tables: colours, line widths, label texts, and text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hex_to_rgb(c: Column) -> Column:
    """struct(r, g, b) of '#RRGGBB'."""
    part = lambda k: F.conv(F.substring(F.regexp_replace(c, "^#", ""), k, 2), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def palette_colour(category_id: Column, palette: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in palette]), (F.pmod(category_id, F.lit(len(palette))) + 1).cast("int"))


def draw_list(preds: DataFrame, palette: list[str]) -> DataFrame:
    """image_id, box, line width, label text and colour of predictions(image_id, category_id, category_name, score, x1..y2, height, width)."""
    line = F.greatest(F.round((F.col("height") + F.col("width") + 3) / 2 * 0.003).cast("int"), F.lit(2))
    return preds.select("image_id", "x1", "y1", "x2", "y2", line.alias("line_width"), F.format_string("%s %.2f", "category_name", "score").alias("label"), hex_to_rgb(palette_colour(F.col("category_id"), palette)).alias("colour"))


def crop_boxes(preds: DataFrame) -> DataFrame:
    """File name and whole-pixel window of the crop of each prediction."""
    box = [F.floor(F.col(k)).cast("int").alias(k) for k in ("x1", "y1", "x2", "y2")]
    return preds.select("image_id", F.concat(F.regexp_replace("file_name", r"\.[^.]*$", ""), F.format_string("_box%d_class%d.png", F.col("id"), F.col("category_id"))).alias("crop_name"), *box)


def text_table(header: list[str], rows: list[list[object]], per_line: int | None = None) -> str:
    """A grid of text, for results that are a few rows by nature."""
    table = [[str(x) for x in r] for r in [header, *rows]]
    width = [max(len(r[k]) for r in table) for k in range(len(header))]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    lines = ["|" + "|".join(f" {x:<{w}} " for x, w in zip(r, width, strict=True)) + "|" for r in table]
    return "\n".join([rule, lines[0], rule, *lines[1:], rule])
