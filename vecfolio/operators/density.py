"""Trimming of isolated clips by local density.

Clips are rows (profile_id, clip_ix, unit). A profile of at most ``MOST_CLIPS``
clips (four hours of windows every 20 s are 721) is one group in one task; larger
ones are worked on in blocks, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

MOST_CLIPS = 20_000
LEAST_FOR_TRIM = 8
MOST_FRACTION = 0.10
MAD_SCALE, MAD_MULTIPLE, LEAST_SCALE = 1.4826, 3.5, 1e-6
_BLOCK = 1024


def matrix_of(clips: pa.Table, column: str = "unit") -> tuple[np.ndarray, np.ndarray]:
    """Clip numbers in order, and the vectors in that order as a matrix."""
    ix = clips.column("clip_ix").to_numpy()
    order = np.argsort(ix, kind="stable")
    return ix[order], np.stack(clips.column(column).to_numpy())[order]


def neighbours(n: int) -> int:
    return min(n - 1, max(3, round(np.sqrt(n))))


def density_of(unit: np.ndarray) -> np.ndarray:
    """The mean of each row's largest similarities to other rows; NaN for a single row."""
    k = neighbours(len(unit))
    found = np.full(len(unit), np.nan)
    for at in range(0, len(unit), _BLOCK) if k else ():
        near = unit[at : at + _BLOCK] @ unit.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        found[at : at + len(near)] = np.partition(near, -k, axis=1)[:, -k:].mean(axis=1)
    return found


def trim(unit: np.ndarray, fraction: float, strict: bool = False) -> tuple[np.ndarray, float | None]:
    """Rows to trim, the least dense first, and the threshold, as ``trimmed`` has them for a table."""
    if not fraction or len(unit) < LEAST_FOR_TRIM:
        return np.zeros(0, int), None
    found = density_of(unit)
    middle = np.median(found)
    threshold = float(middle - MAD_MULTIPLE * max(MAD_SCALE * np.median(np.abs(found - middle)), LEAST_SCALE))
    order = np.argsort(found, kind="stable")[: max(0 if strict else 1, int(len(unit) * fraction))]
    return order[found[order] < threshold], threshold


def by_size(clips: DataFrame, grouped: Callable[[DataFrame], DataFrame], in_blocks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``grouped`` for profiles that fit into a task, and of ``in_blocks`` (given their blocks) for larger ones."""
    large = blocks.larger(clips, MOST_CLIPS)
    if large is None:
        return grouped(clips)
    found = in_blocks(blocks.blocked(clips.join(large, "profile_id", "left_semi")))
    few = grouped(clips.join(large, "profile_id", "left_anti"))
    return few.unionByName(found.select(*[F.col(f.name).cast(f.dataType) for f in few.schema]))


def local_density(clips: DataFrame) -> DataFrame:
    """(profile_id, clip_ix, density): the mean of a clip's largest similarities to others of its profile."""
    return by_size(clips, _grouped_density, blocks.density)


def _grouped_density(clips: DataFrame) -> DataFrame:
    kind = clips.schema["profile_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        ix, unit = matrix_of(t)
        found = density_of(unit)
        names = t.column("profile_id").take(pa.array(np.zeros(len(ix), int)))
        return pa.table([names, pa.array(ix, pa.int32()), pa.array(found, pa.float64(), from_pandas=True)], ["profile_id", "clip_ix", "density"])

    narrow = clips.select("profile_id", F.col("clip_ix").cast("int").alias("clip_ix"), "unit")
    return narrow.groupBy("profile_id").applyInArrow(run, f"profile_id {kind}, clip_ix int, density double")


def thresholds(density: DataFrame) -> DataFrame:
    """(profile_id, n, median, mad, threshold) by exact medians."""
    middle = density.groupBy("profile_id").agg(F.median("density").alias("median"), F.count(F.lit(1)).alias("n"))
    off = density.join(middle, "profile_id").withColumn("off", F.abs(F.col("density") - F.col("median")))
    spread = off.groupBy("profile_id").agg(F.median("off").alias("mad"))
    scale = F.greatest(F.lit(MAD_SCALE) * F.col("mad"), F.lit(LEAST_SCALE))
    return middle.join(spread, "profile_id").withColumn("threshold", F.col("median") - MAD_MULTIPLE * scale)


def check_fraction(fraction: float) -> None:
    if not 0.0 <= fraction <= MOST_FRACTION:
        raise ValueError(f"the trim fraction {fraction} is not in 0 to {MOST_FRACTION}")


def allowed(n: Column, fraction: float, strict: bool = False) -> Column:
    """How many clips may go: at least one, unless the cap is strict."""
    return F.greatest(F.lit(0 if strict else 1), F.floor(n * F.lit(fraction)))


def trimmed(clips: DataFrame, fraction: float, strict: bool = False) -> DataFrame:
    """(profile_id, clip_ix, density, threshold, outlier) of each clip.

    Of the clips less dense than the threshold, the least dense go, up to the
    cap. No clip goes, and the threshold is null, without a fraction or in
    profiles of under ``LEAST_FOR_TRIM`` clips.
    """
    check_fraction(fraction)
    return outliers(local_density(clips), fraction, strict)


def outliers(density: DataFrame, fraction: float, strict: bool = False) -> DataFrame:
    """``trimmed`` of clips whose density is known."""
    with_limit = density.join(thresholds(density).select("profile_id", "n", "threshold"), "profile_id")
    applies = (F.col("n") >= LEAST_FOR_TRIM) & F.lit(fraction > 0)
    with_limit = with_limit.withColumn("threshold", F.when(applies, F.col("threshold")))
    rank = F.row_number().over(Window.partitionBy("profile_id").orderBy("density", "clip_ix"))
    isolated = F.coalesce(F.col("density") < F.col("threshold"), F.lit(False))
    # the densities under the threshold come first in the order, so their ranks need no window of their own
    return with_limit.withColumn("outlier", isolated & (rank <= allowed(F.col("n"), fraction, strict))).drop("n")


def core(clips: DataFrame, trim: DataFrame) -> DataFrame:
    """The clips that weren't trimmed."""
    return clips.join(trim.filter("outlier").select("profile_id", "clip_ix"), ["profile_id", "clip_ix"], "left_anti")
