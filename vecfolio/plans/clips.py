"""The shared tables as the engine's inputs.

A profile is a label of ``embeddings``, and its clips are that label's vectors
by vec_id, however many they are. A recording's length is a document's
number of characters. A window of samples is a user's events, scaled so that
each kind of rejection occurs; every ``EVENTS`` event_ids begin a new window.
Generated windows are sampled from formulas that SQL can evaluate too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.profiles import normalised
from ..operators.quality import gathered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENTS = 100_000
#: One of so many vectors is an isolate of ``planted_clips``.
ISOLATED = 37
RATE = 48_000


def _clips(spark: SparkSession, sf_dir: str, number: Column) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(number.cast("int").alias("profile_id"), "vec_id", "embedding")
    order = Window.partitionBy("profile_id").orderBy("vec_id")
    return rows.select("profile_id", (F.row_number().over(order) - 1).alias("clip_ix"), "embedding")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile_id, clip_ix, embedding)."""
    return _clips(spark, sf_dir, F.col("label"))


def unit_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(clips(spark, sf_dir))


def half_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label as two profiles, 2 * label and 2 * label + 1, by the parity of vec_id."""
    return normalised(_clips(spark, sf_dir, F.col("label") * 2 + F.col("vec_id") % 2))


def planted_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clips`` drawn towards a direction of their label, but for one in ``ISOLATED`` vec_ids, which lie far off."""
    toward = F.transform("embedding", lambda x, i: x.cast("double") + F.when((i == F.col("label")) & (F.col("vec_id") % ISOLATED != 0), F.lit(3.0)).otherwise(F.lit(0.0)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("profile_id"), "vec_id", toward.alias("embedding"))
    order = Window.partitionBy("profile_id").orderBy("vec_id")
    return rows.select("profile_id", (F.row_number().over(order) - 1).alias("clip_ix"), "embedding")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id"), F.col("n_chars").cast("double").alias("duration_s"))


def event_sound() -> Column:
    """An event's value as a sample in -1 to 1: near silence, loud and clipped, soft, or off the middle, by user."""
    gain = F.element_at(F.array(*[F.lit(g) for g in (1e-5, 1.0, 0.1, 0.3)]), (F.col("user_id") % 4 + 1).cast("int"))
    offset = F.when(F.col("user_id") % 4 == 3, 0.3).otherwise(0.0)
    sign = F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sign * F.col("value") / 100.0 * gain + offset))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, window_ix, samples)."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.floor(F.col("event_id") / EVENTS).alias("window_ix"), "event_id", event_sound().alias("x")
    )
    return gathered(rows, "user_id", "window_ix", order="event_id")


def generated(rows: DataFrame, length: int) -> DataFrame:
    """``rows`` with ``samples`` of ``length`` values for their columns r and w: tones, silence, gaps, clipping, offsets, noise and a NaN."""
    r, w = F.col("r"), F.col("w")
    step = F.lit(2 * math.pi) * (200 + 37 * ((r * 31 + w * 17) % 50)) / RATE
    given = rows.withColumn("_kind", (r * 7 + w) % 8).withColumn("_step", step).withColumn("_bad", (r * 7 + w) % 40 == 39)
    # few small rows that make much: dealt to all cores, by a number that isn't merged again
    given = given.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "r", "w")

    def tone(of) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda n: of(n, F.sin(F.col("_step") * n + 0.1)))

    noise = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda n: ((n.cast("long") * 7919 + (r.cast("long") * 31 + w) * 104_729) % 10_007) / 10_007.0 * 0.4 - 0.2)
    kind = F.col("_kind")
    samples = (
        F.when(kind == 3, tone(lambda n, s: s * 0.0)).when(kind == 4, tone(lambda n, s: F.when(n < length / 10, s * 0.2).otherwise(0.0)))
        .when(kind == 5, tone(lambda n, s: F.when(s > 0, 1.0).otherwise(-1.0))).when(kind == 6, tone(lambda n, s: s * 0.2 + 0.3))
        .when(kind == 7, noise).otherwise(tone(lambda n, s: s * 0.2))
    )
    spoiled = F.transform("samples", lambda x, n: F.when(n == 7, float("nan")).otherwise(x))
    made = given.withColumn("samples", samples).withColumn("samples", F.when(F.col("_bad"), spoiled).otherwise(F.col("samples")))
    return made.drop("_kind", "_step", "_bad")


#: Samples that an event lasts, and events of a window of the shipped rules' rate.
HELD, TOGETHER = 240, 100


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(w, samples): windows of 24,000 samples, each event held for ``HELD`` of them; one in 16 has a NaN."""
    w = F.floor(F.col("event_id") / TOGETHER)
    gain = F.element_at(F.array(*[F.lit(g) for g in (1e-5, 1.0, 0.1, 0.3)]), (w % 4 + 1).cast("int"))
    sign = F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sign * F.col("value") / 97.0 * gain + F.when(w % 4 == 3, 0.3).otherwise(0.0)))
    bad = (w % 16 == 15) & (F.col("event_id") % TOGETHER == 3)
    rows = table(spark, sf_dir, "events").select(w.alias("w"), "event_id", F.when(bad, float("nan")).otherwise(x).alias("x"))
    held = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "x"))), lambda e: F.array_repeat(e["x"], HELD)))
    return rows.groupBy("w").agg(held.alias("samples"))


#: Samples, windows and seconds of a generated recording; of each five suppliers one is too long and one silent.
JOB_SAMPLES, JOB_WINDOWS, JOB_SECONDS, JOB_LONG = 2048, 6, 135.0, 20_000.0


def job_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recordings (profile_id, duration_s) and their windows (profile_id, window_ix, start_s, samples): one for each supplier."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("profile_id"))
    recordings = suppliers.select("profile_id", F.when(F.col("profile_id") % 5 == 3, JOB_LONG).otherwise(JOB_SECONDS).alias("duration_s"))
    places = suppliers.select("profile_id", F.explode(F.sequence(F.lit(0), F.lit(JOB_WINDOWS - 1))).alias("window_ix"))
    silent = F.col("profile_id") % 5 == 4
    rows = places.withColumn("r", F.when(silent, 0).otherwise(F.col("profile_id"))).withColumn("w", F.when(silent, 3).otherwise(F.col("window_ix")))
    windows = generated(rows, JOB_SAMPLES).select("profile_id", "window_ix", (F.col("window_ix") * 25).cast("double").alias("start_s"), "samples")
    return recordings, windows
