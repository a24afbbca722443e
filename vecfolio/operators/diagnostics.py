"""Diagnostics of a profile: spread along its principal axes, extreme clips, diversity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import timecode
from ..functions.vectors import dot
from . import blocks, density
from .profiles import _grouped, principal

def pca(clips: DataFrame) -> DataFrame:
    """(profile_id, variance, low_clip, high_clip) over all clips, trimmed ones too."""

    def make(ix, unit):
        shares, (low, high) = principal(unit)
        return pa.array([shares], pa.list_(pa.float64())), pa.array(ix[[low]], pa.int32()), pa.array(ix[[high]], pa.int32())

    columns = "variance array<double>, low_clip int, high_clip int"
    return density.by_size(clips, lambda c: _grouped(c, make, columns), blocks.principal)


def diversity(clips: DataFrame, vectors: DataFrame) -> DataFrame:
    """(profile_id, diversity): one less the mean similarity of all clips to the global vector."""
    met = clips.join(vectors.select("profile_id", "vector"), "profile_id")
    return met.groupBy("profile_id").agg((F.lit(1.0) - F.avg(dot(F.col("unit"), F.col("vector")))).alias("diversity"))


def extreme_snippets(axes: DataFrame, starts: DataFrame) -> DataFrame:
    """(profile_id, side, clip_ix, start_s, timecode): where the extreme clips begin; ``starts`` has (profile_id, clip_ix, start_s)."""
    sides = axes.select(
        "profile_id", F.explode(F.array(_side("low"), _side("high"))).alias("x")
    ).select("profile_id", "x.side", "x.clip_ix")
    return sides.join(starts, ["profile_id", "clip_ix"]).withColumn("timecode", timecode(F.col("start_s")))


def _side(name: str) -> Column:
    return F.struct(F.lit(name).alias("side"), F.col(f"{name}_clip").alias("clip_ix"))
