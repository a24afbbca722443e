"""Jobs as state machines over a stream of events.

A job is queued, processing, complete or failed; the last two are final. Each
event moves its job or is refused; progress never falls, and stays where it was
when a job fails. A job that isn't final and hears nothing for ``EXPIRY_SECONDS``
fails as abandoned: by the next event that comes after that time or, if none
does, by a timer once the watermark has passed it. State is kept by Spark for
each job, so a restarted query goes on where it was, and the output of each
event is the same however the stream is cut into batches.

Events are rows (job_id, event_id, created_at, event_name, progress). The
outcome of each is a row (job_id, event_id, event_name, at, status, progress,
accepted), status and progress being those after it; the row of an expiry has
event_id -1. An event earlier than the last one that counted is refused; a null
or unknown event_name is refused; a null progress leaves it; of events at one
time the smaller event_id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..scratch import scratch

#: Which event moves a job from which states (none yet: "") to which.
ALLOWED = {
    "job_submitted": ({""}, "queued"),
    "job_processing": ({"queued", "processing"}, "processing"),
    "job_completed": ({"processing"}, "complete"),
    "job_failed": ({"queued", "processing"}, "failed"),
}
FINAL = {"complete", "failed"}
EXPIRED = "job_expired"
EXPIRY_SECONDS = 43_200
OUTCOME = "job_id long, event_id long, event_name string, at timestamp, status string, progress double, accepted boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobMachine(StatefulProcessor):
    def __init__(self, expiry_seconds: int = EXPIRY_SECONDS):
        self.expiry = expiry_seconds * 1_000_000  # in microseconds, like all times here

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, progress double, updated long")

    def close(self) -> None:
        pass

    def _read(self) -> list:
        return list(self.job.get()) if self.job.exists() else ["", 0.0, 0]

    def _keep(self, before: list, state: list) -> None:
        """The new state, and a timer at its expiry in place of the one before."""
        if before[0] and before[0] not in FINAL:
            self.handle.deleteTimer(self._timer(before[2]))
        self.job.update(tuple(state))
        if state[0] not in FINAL:
            self.handle.registerTimer(self._timer(state[2]))

    def _timer(self, updated: int) -> int:
        return (updated + self.expiry) // 1000

    @staticmethod
    def _row(key, event_id, name, at, state, accepted) -> tuple:
        return (key[0], event_id, name, pd.Timestamp(at, unit="us"), state[0] or None, state[1], accepted)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["created_at", "event_id"], kind="stable")
        times = events["created_at"].astype("datetime64[us]").astype("int64")
        before = self._read()
        state, out = list(before), []
        for event_id, name, at, progress in zip(events["event_id"], events["event_name"], times, events["progress"]):
            if state[0] and state[0] not in FINAL and at > state[2] + self.expiry:
                state = ["failed", state[1], state[2] + self.expiry]
                out.append(self._row(key, -1, EXPIRED, state[2], state, True))
            sources, target = ALLOWED.get(name, (set(), ""))
            accepted = state[0] in sources and at >= state[2]
            if accepted:
                risen = state[1] if target != "processing" or pd.isna(progress) else max(state[1], float(progress))
                state = [target, 1.0 if target == "complete" else risen, int(at)]
            out.append(self._row(key, event_id, name, at, state, accepted))
        if state != before:
            self._keep(before, state)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._read()
        if state[0] and state[0] not in FINAL and expiredTimerInfo.getExpiryTimeInMs() == self._timer(state[2]):
            state = ["failed", state[1], state[2] + self.expiry]
            self.job.update(tuple(state))
            yield self._frame([self._row(key, -1, EXPIRED, state[2], state, True)])


def job_outcomes(events: DataFrame, delay: str = "1 hour", expiry_seconds: int = EXPIRY_SECONDS) -> DataFrame:
    """The outcomes of a stream of events, to be written in append mode; events later than ``delay`` behind the newest may be left out."""
    rows = events.select("job_id", "event_id", "created_at", "event_name", F.col("progress").cast("double").alias("progress"))
    return rows.withWatermark("created_at", delay).groupBy("job_id").transformWithStateInPandas(JobMachine(expiry_seconds), OUTCOME, "append", "EventTime")


def drained(spark: SparkSession, outcomes: DataFrame, path: str | None = None) -> DataFrame:
    """All outcomes of what a stream has to offer now, written below ``path``; a later call with the same path goes on from there."""
    path = path or scratch(spark, "jobs")
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        started = outcomes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/progress")
        started.trigger(availableNow=True).start(f"{path}/result").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return spark.read.schema(outcomes.schema).parquet(f"{path}/result")
