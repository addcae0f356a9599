"""The window aggregation and the z-score on a stream of flow records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from flowsieve.functions.columns import col
from flowsieve.operators.stats import ColumnStats, with_zscore
from flowsieve.operators.windows import aggregate_windows, with_valid_time


def stream_windows(stream: DataFrame, source: str, minutes: int, names: list[str], time: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """Finished (source, window) rows of a stream; records later than ``late`` are dropped.

    The state is one partial aggregate per open window.
    """
    timed = with_valid_time(stream, time, check=False).where(col(source).isNotNull())
    return aggregate_windows(timed.withWatermark("event_time", late), source, minutes, names)


def score_windows(windows: DataFrame, stats: ColumnStats, threshold: float = 2.5) -> DataFrame:
    """z-score columns of finished windows against statistics fitted before, for example on last month's windows."""
    return with_zscore(windows, stats, threshold)


@dataclass(frozen=True)
class StreamRun:
    """What one run over the data that had arrived did: batches, records read, and (source, window) groups that came after their window was closed and were dropped.
    ``schema`` is that of the windows written."""

    batches: int
    records: int
    late_groups: int
    schema: StructType


def run_available(stream: DataFrame, source: str, minutes: int, names: list[str], stats: ColumnStats, target: str, state: str,
                  time: str = "timestamp", late: str = "1 hour", threshold: float = 2.5, seconds: int = 3600) -> StreamRun:
    """Read all records that arrived since the last run and append the windows that are closed now, with their scores, to parquet files in ``target``.

    ``state`` holds offsets, open windows and the watermark, so a run goes on where the last one ended, or failed. ``stats`` are loaded, not fitted here.
    """
    scored = score_windows(stream_windows(stream, source, minutes, names, time, late), stats, threshold)
    query = (
        scored.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"The stream had more to read than {seconds} seconds allow; the next run goes on from here.")
    progress = query.recentProgress
    dropped = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
    return StreamRun(len(progress), sum(p["numInputRows"] for p in progress), dropped, scored.schema)
