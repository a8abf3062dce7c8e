"""Rows that pass each stage of a job, counted while the job runs."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

PREFIX = "stage_"
SCHEMA = "stage string, n long"


class StageCounters:
    """Counters of a batch job; ``table`` gives them after its action.

    They cost no job of their own. A task that runs again after an executor was
    lost may count its rows again, so they tell what the job did, not what a
    table holds. A stage whose rows an action never asks for has no count.
    """

    def __init__(self) -> None:
        self._held: list[tuple[str, Observation]] = []

    def mark(self, df: DataFrame, stage: str) -> DataFrame:
        seen = Observation(f"{PREFIX}{stage}")
        self._held.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(stage, int(seen.get["n"])) for stage, seen in self._held], SCHEMA)


def mark_stream(df: DataFrame, stage: str) -> DataFrame:
    return df.observe(f"{PREFIX}{stage}", F.count(F.lit(1)).alias("n"))


class StreamCounters(StreamingQueryListener):
    """Sums the marks of the streams of a session; holds a number for each stream and stage."""

    def __init__(self) -> None:
        self._sums: dict[tuple[str, str], int] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            for name, row in p.observedMetrics.items():
                if name.startswith(PREFIX):
                    key = (str(p.id), name.removeprefix(PREFIX))
                    self._sums[key] = self._sums.get(key, 0) + int(row["n"])

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._end(str(event.runId)).set()

    def table(self, spark: SparkSession, query, wait_s: float = 60) -> DataFrame:
        """The counters of a stream that has ended; its last progress may still be on its way, so this waits for the end to be told."""
        if not self._end(str(query.runId)).wait(wait_s):
            raise TimeoutError("the stream's end was not told")
        with self._lock:
            rows = [(stage, n) for (ident, stage), n in self._sums.items() if ident == str(query.id)]
        return spark.createDataFrame(rows, SCHEMA)
