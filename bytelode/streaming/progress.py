"""Progress of streams as rows, metrics of batch jobs while they run, and their cancelling."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "job_id string, event string, ts_ms long, batch long, rows long, rows_per_second double, error string"


class ProgressLog(StreamingQueryListener):
    """Keeps the last `most` events of the session's streams; add it with spark.streams.addListener."""

    def __init__(self, most: int = 10_000):
        self._rows: deque[tuple] = deque(maxlen=most)
        self._lock = threading.Lock()

    def _add(self, job: object, event: str, at: str | None = None, batch: int | None = None, rows: int | None = None, speed: float | None = None, error: str | None = None) -> None:
        when = datetime.fromisoformat(at) if at else datetime.now().astimezone()
        with self._lock:
            self._rows.append((str(job), event, int(when.timestamp() * 1000), batch, rows, speed, error))

    def onQueryStarted(self, event) -> None:
        self._add(event.id, "started", event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add(p.id, "progress", p.timestamp, p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        self._add(event.id, "idle", event.timestamp)

    def onQueryTerminated(self, event) -> None:
        self._add(event.id, "error" if event.exception else "complete", error=event.exception)

    def frame(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            rows = list(self._rows)
        return spark.createDataFrame(rows, SCHEMA)


def observed(df: DataFrame, name: str, size: str | None = None) -> tuple[DataFrame, Observation]:
    """df, and what its next action will have seen of it: rows, and bytes of a column. No second pass is made."""
    seen = Observation(name)
    sizes = F.coalesce(F.sum(F.octet_length(size)), F.lit(0)) if size else F.lit(0)
    return df.observe(seen, F.count("*").alias("rows"), sizes.cast("long").alias("bytes")), seen


@contextmanager
def cancellable(spark: SparkSession, job: str) -> Iterator[None]:
    """Actions inside, on this thread, can be ended from another by cancel(spark, job)."""
    spark.sparkContext.addJobTag(job)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(job)


def cancel(spark: SparkSession, job: str) -> None:
    spark.sparkContext.cancelJobsWithTag(job)
