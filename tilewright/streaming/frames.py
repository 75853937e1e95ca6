"""Frames as a stream: detection per micro-batch, buffered merging per video, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilewright.functions import kernels as K


def frame_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def counts_by_window(events: DataFrame, ts: str = "ts", label: str = "label", size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, label, n) by event time; rows later than the watermark are left out in streams."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "label", "n")


def merge_buffer(metric: str = "IOU", threshold: float = 0.5, limit: int = 1000) -> Callable[..., Iterator[pd.DataFrame]]:
    """State function for ``applyInPandasWithState``: boxes of a key are kept until more than ``limit`` are held, then suppressed;
    the survivors stay in the buffer and are given out when no row has come for the timeout. The state is bounded by the
    survivors plus one micro-batch of the key, and the result, unlike that of an unbounded merge, depends on arrival order."""

    def run(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists and not state.hasTimedOut else []
        if state.hasTimedOut:
            rows = list(zip(*state.get, strict=True))
            state.remove()
            yield _out(key, _kept(rows, metric, threshold))
            return
        for p in pdfs:
            held += list(p[["id", "x1", "y1", "x2", "y2", "score"]].itertuples(index=False, name=None))
            if len(held) > limit:
                held = _kept(held, metric, threshold)
        state.update(tuple([r[k] for r in held] for k in range(6)))
        state.setTimeoutDuration(1000)

    return run


def _kept(rows: list[tuple], metric: str, threshold: float) -> list[tuple]:
    if not rows:
        return rows
    a = np.array([r[1:] for r in rows], float)
    own = K.greedy(a[:, :4], a[:, 4], metric, threshold)
    return [r for i, r in enumerate(rows) if own[i] == i]


def _out(key: tuple[Any, ...], rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(key[0], *r) for r in rows], columns=["image_id", "id", "x1", "y1", "x2", "y2", "score"])


BUFFER_STATE = "id array<bigint>, x1 array<double>, y1 array<double>, x2 array<double>, y2 array<double>, score array<double>"
BUFFER_OUT = "image_id bigint, id bigint, x1 double, y1 double, x2 double, y2 double, score double"


def buffered_suppression(preds: DataFrame, metric: str = "IOU", threshold: float = 0.5, limit: int = 1000) -> DataFrame:
    return preds.groupBy("image_id").applyInPandasWithState(merge_buffer(metric, threshold, limit), BUFFER_OUT, BUFFER_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
