"""The telemetry table: events are appended, parted by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "event_id string, created_at timestamp, job_id string, event_name string, duration_ms double, properties string"


def append(events: DataFrame, path: str, enabled: bool = True) -> None:
    """Adds events; does nothing when telemetry is off."""
    if enabled:
        events.write.mode("append").partitionBy("event_name").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
