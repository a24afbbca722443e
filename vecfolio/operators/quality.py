"""Which windows are usable, and why others are not.

A window is a row with its samples as an array, as decoding gives it. All
metrics of a window are made in one pass of an Arrow function, so no sample is
shuffled; decisions use unrounded values.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.vectors import shown

METRICS = ("rms_dbfs", "peak", "clipped_ratio", "active_ratio", "dc_offset", "zero_crossing_rate", "spectral_flatness")
#: Windows that are measured at once.
TOGETHER = 16


@dataclass(frozen=True)
class QualityRules:
    min_rms_dbfs: float = -48.0
    max_clipped_ratio: float = 0.02
    frame: int = 2048
    stride: int = 8
    most_spectrum: int = 65_536
    clipped_at: float = 0.999
    least_active: float = 0.2
    most_offset: float = 0.2
    noise_flatness: float = 0.92
    noise_crossings: float = 0.35

    @property
    def active_rms(self) -> float:
        return 10 ** ((self.min_rms_dbfs - 6) / 20)


def flatness(power: np.ndarray) -> float:
    """Geometric over arithmetic mean of a power spectrum."""
    return float(np.exp(np.log(power + 1e-12).mean()) / max(power.mean(), 1e-12))


def measure(samples, rules: QualityRules = QualityRules()) -> dict[str, float | None] | None:
    """A window's metrics; none for samples that are missing or not finite. A share of nothing is null, but 1 of no whole frame."""
    x = np.asarray([] if samples is None else samples, float)
    if not len(x) or not np.isfinite(x).all():
        return None
    power, level = x * x, np.abs(x)
    frames = power[: len(x) // rules.frame * rules.frame].reshape(-1, rules.frame)
    kept = x[:: rules.stride]
    low = np.signbit(kept)
    return {
        "rms_dbfs": float(20 * np.log10(max(np.sqrt(power.mean()), 1e-12))),
        "peak": float(level.max()),
        "clipped_ratio": float((level >= np.float32(rules.clipped_at)).mean()),
        "active_ratio": float((np.sqrt(frames.mean(axis=1)) > rules.active_rms).mean()) if len(frames) else 1.0,
        "dc_offset": float(abs(x.mean())),
        "zero_crossing_rate": float((low[1:] != low[:-1]).mean()) if len(low) > 1 else None,
        "spectral_flatness": flatness(np.abs(np.fft.rfft(kept[: rules.most_spectrum])) ** 2),
    }


def reason_of(metrics: dict | None, rules: QualityRules = QualityRules()) -> str | None:
    """The first rule that rejects a window of these metrics; none keeps it."""
    if metrics is None:
        return "invalid"
    noisy = metrics["spectral_flatness"] > rules.noise_flatness and (metrics["zero_crossing_rate"] or 0.0) > rules.noise_crossings
    checks = {
        "low_energy": metrics["rms_dbfs"] < rules.min_rms_dbfs,
        "mostly_silent": metrics["active_ratio"] < rules.least_active,
        "clipped": metrics["clipped_ratio"] > rules.max_clipped_ratio,
        "dc_offset": metrics["dc_offset"] > rules.most_offset,
        "broadband_noise": noisy,
    }
    return next((name for name, bad in checks.items() if bad), None)


def analyse(windows: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``windows`` with metrics, ``reason``, ``keep`` and ``filter_ms`` in place of their array column ``samples``."""
    kept = [c for c in windows.columns if c != "samples"]
    made = [*METRICS, "reason", "filter_ms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part, rows = batch.slice(at, TOGETHER), []
                for x in part.column(len(kept)).to_numpy(zero_copy_only=False):
                    began = time.perf_counter()
                    found = measure(x, rules)
                    reason = reason_of(found, rules)
                    rows.append([*((found or {}).get(m) for m in METRICS), reason, 1000 * (time.perf_counter() - began)])
                kinds = [pa.float64()] * len(METRICS) + [pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [*kept, *made])

    fields = [windows.schema[c] for c in kept] + [StructField(m, StringType() if m == "reason" else DoubleType()) for m in made]
    found = windows.select(*kept, "samples").mapInArrow(run, StructType(fields))
    return found.withColumn("keep", F.col("reason").isNull())


def shown_metrics() -> list[Column]:
    """The metrics rounded for output: decibels to three places, the others to six."""
    return [shown(F.col(m), 3 if m == "rms_dbfs" else 6).alias(m) for m in METRICS]


def gathered(samples: DataFrame, *keys: str, order: str = "n") -> DataFrame:
    """(keys, samples): a window's samples (keys, n, x) as an array, for windows of bounded length."""
    pairs = F.array_sort(F.collect_list(F.struct(order, "x")))
    return samples.groupBy(*keys).agg(F.transform(pairs, lambda s: s["x"]).alias("samples"))


def reason_histogram(decided: DataFrame, recording: Column) -> DataFrame:
    """(recording, considered, retained, filtered, filter_counts): counts, and a map from reason to count by name.

    Counts by reason come first, so a recording brings as many rows as it has reasons.
    """
    counts = decided.groupBy(recording.alias("recording"), "keep", F.coalesce("reason", F.lit("unknown")).alias("reason")).count()
    filtered = F.filter(F.array_sort(F.collect_list(F.when(~F.col("keep"), F.struct("reason", "count")))), lambda x: x.isNotNull())
    return counts.groupBy("recording").agg(
        F.sum("count").alias("considered"),
        F.sum(F.when(F.col("keep"), F.col("count")).otherwise(0)).alias("retained"),
        F.sum(F.when(~F.col("keep"), F.col("count")).otherwise(0)).alias("filtered"),
        F.map_from_entries(filtered).alias("filter_counts"),
    )


def without_retained(counts: DataFrame) -> DataFrame:
    """Recordings of which no window is left: an error for the profile."""
    return counts.filter("retained = 0").select("recording")
