"""Python data sources: frames of a video as batch or stream, and the tile grid as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def _frame(video: int, k: int, size: int) -> tuple[int, int, bytes]:
    """Stand-in decoder: frame k of a video as a few bytes that depend on both; a real one is passed by subclassing."""
    return video, k, bytes((video * 31 + k + j) % 256 for j in range(size))


class FrameSource(DataSource):
    """``spark.read.format("frames")``: options video_id, n_frames, skip (frames passed over before each one read), size, partitions."""

    decode = staticmethod(_frame)

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "video_id bigint, frame_id int, content binary"

    def _opt(self, key: str, default: int) -> int:
        return int(self.options.get(key, default))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FrameReader(self._opt("video_id", 0), self._opt("n_frames", 0), self._opt("skip", 0), self._opt("size", 16), self._opt("partitions", 4), self.decode)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _FrameStream(self._opt("video_id", 0), self._opt("n_frames", 0), self._opt("skip", 0), self._opt("size", 16), self._opt("per_batch", 10), self.decode)


class _FrameReader(DataSourceReader):
    def __init__(self, video: int, n: int, skip: int, size: int, parts: int, decode) -> None:
        self.video, self.n, self.skip, self.size, self.parts, self.decode = video, n, skip, size, max(1, parts), decode

    def partitions(self) -> list[InputPartition]:
        step = -(-max(1, self.n) // self.parts)
        return [_Range(a, min(self.n, a + step)) for a in range(0, max(1, self.n), step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k in range(partition.first, partition.last):
            if k % (self.skip + 1) == self.skip:
                yield self.decode(self.video, k, self.size)


class _FrameStream(SimpleDataSourceStreamReader):
    def __init__(self, video: int, n: int, skip: int, size: int, per_batch: int, decode) -> None:
        self.video, self.n, self.skip, self.size, self.per_batch, self.decode = video, n, skip, size, per_batch, decode

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(self.n, start["at"] + self.per_batch)
        return self.readBetweenOffsets(start, {"at": end}), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.decode(self.video, k, self.size) for k in range(start["at"], end["at"]) if k % (self.skip + 1) == self.skip])


@udtf(returnType="tile_idx: int, x1: int, y1: int, x2: int, y2: int")
class TileGrid:
    """tile_grid(height, width, tile_height, tile_width, overlap_h, overlap_w): the tiles of one image, row by row."""

    def eval(self, height: int, width: int, th: int, tw: int, oh: int, ow: int) -> Iterator[tuple]:
        def axis(length: int, size: int, ov: int) -> list[tuple[int, int]]:
            n = max(-(-(length - size) // (size - ov)), 0) + 1
            ends = [min(length, k * (size - ov) + size) for k in range(n)]
            return [(max(0, e - size), e) for e in ends]

        k = 0
        for y1, y2 in axis(height, th, oh):
            for x1, x2 in axis(width, tw, ow):
                yield k, x1, y1, x2, y2
                k += 1


def register(spark: SparkSession) -> None:
    """Makes the frames source and the tile_grid table function known to a session."""
    spark.dataSource.register(FrameSource)
    spark.udtf.register("tile_grid", TileGrid)
