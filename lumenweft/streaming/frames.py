"""Frame streams: grading in micro-batches and stateful scene cuts."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import scene


def stream_rows(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, at most so many in a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that there is, then stop; an error of a batch is raised once here.

    The sink gets (rows, batch number); after a failure a batch comes again with
    its number, so a sink that overwrites by number writes each once.
    """
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def parquet_sink(path: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A sink of one folder per batch number."""
    return lambda rows, number: change(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")


class PreviousFrame(StatefulProcessor):
    """The distance of each frame of a clip from the one before, across micro-batches.

    Input rows: clip_id, frame_id, hist, pixels.  Frames of a batch are taken in
    order; a frame older than the last one seen is late and left out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "frame_id long, hist array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("frame_id")
        seen, before = self.last.get() if self.last.exists() else (None, None)
        out = []
        for frame, hist, pixels in zip(every["frame_id"], every["hist"], every["pixels"], strict=True):
            if seen is not None and frame <= seen:
                continue
            if before is not None:
                moved = float(np.abs(np.asarray(hist) - np.asarray(before)).sum())
                out.append((key[0], int(frame), moved / (6.0 * pixels) if pixels else 0.0))
            seen, before = int(frame), [int(x) for x in hist]
        if before is not None:
            self.last.update((seen, before))
        yield pd.DataFrame(out, columns=["clip_id", "frame_id", "distance"]).astype({"frame_id": "int64", "distance": "float64"})

    def close(self) -> None:
        return None


# the planner's own Python process does not see shipped sources, so the class travels by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_distances(histograms: DataFrame) -> DataFrame:
    """Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    return histograms.groupBy("clip_id").transformWithStateInPandas(PreviousFrame(), "clip_id string, frame_id long, distance double", outputMode="Append", timeMode="None")


def stream_cuts(histograms: DataFrame, threshold: float = scene.THRESHOLD) -> DataFrame:
    return stream_distances(histograms).where(F.col("distance") > threshold)


def event_counts(stream: DataFrame, at: str, by: list[str], width: str, delay: str) -> DataFrame:
    """Counts of tumbling windows of event time; a window is given out once, when the watermark has passed it."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"))


def joined_within(left: DataFrame, right: DataFrame, by: list[str], at: str, interval: str, delay: str = "0 seconds") -> DataFrame:
    """Pairs (a, b) of two streams where b follows a within the interval; watermarks bound what is kept."""
    a, b = left.withWatermark(at, delay).alias("a"), right.withWatermark(at, delay).alias("b")
    near = F.col(f"b.{at}").between(F.col(f"a.{at}"), F.col(f"a.{at}") + F.expr(f"interval {interval}"))
    for c in by:
        near = near & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, near)


class Progress(StreamingQueryListener):
    """Rows, rates, late rows and the time of each phase of a trigger, kept for whoever asks."""

    def __init__(self) -> None:
        self.seen: list[dict] = []

    def onQueryStarted(self, event) -> None:
        return None

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen.append({"batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond, "late": sum(o.numRowsDroppedByWatermark for o in p.stateOperators), **{f"{k}_ms": v for k, v in (p.durationMs or {}).items()}})

    def onQueryIdle(self, event) -> None:
        return None

    def onQueryTerminated(self, event) -> None:
        return None
