"""Tables that streams keep, written so that a batch costs what it changed and a repeated one changes nothing.

A keyed table is a base and the changes since: ``base=N`` holds the newest row
of every key as of batch N, ``batch=N`` the rows that batch N changed. A batch
writes its own folder and no other; each ``EVERY`` batches the changes are merged
into a new base. Readers take the newest finished base and the batches after it.
So streams run in update mode, and bytes follow the keys touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Batches whose changes are merged into a new base.
EVERY = 16


def _finished(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders ``kind=N`` below a path that were written to the end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    names = [s.getPath() for s in store.listStatus(root) if s.getPath().getName().startswith(f"{kind}=")]
    done = [p for p in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def current(spark: SparkSession, path: str, keys: list[str], schema: StructType, upto: int | None = None) -> DataFrame:
    """The newest row of each key, as of batch ``upto`` (the last by default)."""
    bases = [n for n in _finished(spark, path, "base") if upto is None or n <= upto]
    base = bases[-1] if bases else -1
    later = [n for n in _finished(spark, path, "batch") if n > base and (upto is None or n <= upto)]
    read = spark.read.schema(schema)
    parts = [read.parquet(f"{path}/base={base}").withColumn("_batch", F.lit(base))] if bases else []
    parts += [read.parquet(f"{path}/batch={n}").withColumn("_batch", F.lit(n)) for n in later]  # EVERY at most
    if not parts:
        return spark.createDataFrame([], schema)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    values = [c for c in every.columns if c not in (*keys, "_batch")]
    newest = every.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in values]).select(*[c for c in every.columns if c != "_batch"])


def keyed_sink(path: str, keys: list[str], every: int = EVERY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for streams in update mode: a batch's rows replace those of their keys."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % every == 0:
            current(batch.sparkSession, path, keys, batch.schema, number).write.mode("overwrite").parquet(f"{path}/base={number}")

    return step


def drained(stream: DataFrame, path: str, keys: list[str], every: int = EVERY) -> DataFrame:
    """All that a stream in update mode has to offer now, merged by key below ``path``; a later call goes on from there."""
    started = stream.writeStream.outputMode("update").foreachBatch(keyed_sink(f"{path}/table", keys, every))
    started.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return current(stream.sparkSession, f"{path}/table", keys, stream.schema)


# --- events once ---------------------------------------------------------------


def once(events: DataFrame, delay: str = "1 day", key: str = "event_id", time: str = "created_at") -> DataFrame:
    """A stream of events without repetitions of a key that come within ``delay`` of each other; state is dropped after it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def event_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: a batch's events as its own folder, so that a repeated batch replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def recorded(events: DataFrame, path: str, delay: str = "1 day") -> DataFrame:
    """All events of a stream that are there now, each once, written below ``path``; a later call goes on from there."""
    started = once(events, delay).writeStream.outputMode("append").foreachBatch(event_sink(f"{path}/events"))
    started.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    spark = events.sparkSession
    if not _finished(spark, f"{path}/events", "batch"):
        return spark.createDataFrame([], events.schema)
    return spark.read.schema(events.schema).parquet(f"{path}/events")
