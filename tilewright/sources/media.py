"""Image files by header, and frames of videos with skipping."""

from __future__ import annotations

import struct
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

_SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from a PNG, GIF, BMP or JPEG header; JPEG orientations 5 to 8 swap them."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] != b"\xff\xd8":
        return None
    at, turned = 2, False
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xD8, 0x01, 0xFF) or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            turned = _orientation(data[at + 10 : at + 2 + size]) in (5, 6, 7, 8)
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return (h, w) if turned else (w, h)
        at += 2 + size
    return None


def _orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8:
        return 1
    at = struct.unpack(order + "I", tiff[4:8])[0]
    if at + 2 > len(tiff):
        return 1
    for k in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
        e = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(e) == 12 and struct.unpack(order + "H", e[:2])[0] == 0x0112:
            return struct.unpack(order + "H", e[8:10])[0]
    return 1


@pandas_udf(_SIZE)
def size_of(content: pd.Series) -> pd.DataFrame:
    s = [image_size(bytes(c)) if c is not None else None for c in content]
    return pd.DataFrame({"width": pd.array([x[0] if x else None for x in s], "Int32"), "height": pd.array([x[1] if x else None for x in s], "Int32")})


def read_images(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, contains: list[str] | None = None) -> DataFrame:
    """(path, length, content, width, height) of the files; the size comes from the header. ``contains``: only files in whose name,
    case aside, one of these stands (anywhere, not at the end alone)."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    if contains:
        name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
        f = f.filter(reduce(lambda x, y: x | y, [name.contains(c.lower()) for c in contains]))
    return f.withColumn("size", size_of("content")).select("path", "length", "content", "size.width", "size.height")


def skip_frames(frames: DataFrame, interval: int = 0) -> DataFrame:
    """The frames a reader sees that, before each read, advances past ``interval`` of them."""
    return frames.filter(F.col("frame_id") % (interval + 1) == interval)
