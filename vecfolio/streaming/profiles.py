"""Profiles and jobs kept up to date from streams.

Global vectors are running sums, so they are exact at any time. Clustering isn't
incremental; ``refresh_profiles`` recomputes the profiles that a batch touched
from all their clips. Writes name their batch, so a repeated one changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import with_unit


def running_sums(clips: DataFrame) -> DataFrame:
    """(profile_id, i, total, n): sums of the unit vectors' components, for a stream or a batch.

    A clip without a direction is left out.
    """
    unit = with_unit(clips, "embedding", "unit").filter("unit is not null")
    each = unit.select("profile_id", F.posexplode("unit").alias("i", "x"))
    return each.groupBy("profile_id", "i").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n"))


def vectors_of(sums: DataFrame) -> DataFrame:
    """(profile_id, vector, n) of the running sums as they stand."""
    grouped = sums.groupBy("profile_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("total") / F.col("n")).alias("x")))), lambda x: x["x"]).alias("mean"), F.max("n").alias("n")
    )
    return with_unit(grouped, "mean", "vector").select("profile_id", "vector", "n")


def latest_jobs(events: DataFrame, job: str = "job_id") -> DataFrame:
    """The last event of each job so far, for a stream in update or complete mode."""
    last = F.max(F.struct("created_at", "event_id", "event_name")).alias("last")
    return events.groupBy(job).agg(last, F.count(F.lit(1)).alias("n_events")).select(job, "last.event_name", "last.created_at", "last.event_id", "n_events")


#: Buckets of clips by profile, so that a batch reads those of its profiles only.
BUCKETS = 64


def refresh_profiles(path: str, clips_path: str, make: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: keeps a batch's clips by bucket, and writes the touched profiles anew under the batch's number.

    Of the clips before it reads the buckets of the batch's profiles, at most ``buckets`` names.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named = batch.withColumn("bucket", F.pmod(F.xxhash64("profile_id"), F.lit(buckets)).cast("int"))
        named.write.mode("overwrite").partitionBy("bucket").parquet(f"{clips_path}/batch={number}")
        new = spark.read.schema(named.schema).parquet(f"{clips_path}/batch={number}")
        touched = new.select("bucket", "profile_id").distinct()
        held = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
        every = spark.read.schema(named.withColumn("batch", F.lit(number)).schema).option("basePath", clips_path).parquet(clips_path)
        every = every.filter((F.col("batch") <= number) & F.col("bucket").isin(held)).select(*batch.columns)
        make(every.join(touched.select("profile_id"), "profile_id", "left_semi")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def current_profiles(written: DataFrame) -> DataFrame:
    """The newest row of each profile of a table written by ``refresh_profiles``."""
    newest = written.groupBy("profile_id").agg(F.max("batch").alias("batch"))
    return written.join(newest, ["profile_id", "batch"]).drop("batch")
