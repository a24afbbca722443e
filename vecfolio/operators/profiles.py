"""Profiles: a global vector and two weighted cluster vectors for the clips of a recording.

The global vector is a grouped mean. Two-centre spherical clustering iterates
over a profile's clips, so it runs where they are: one Arrow group for each
profile of up to ``density.MOST_CLIPS`` clips, one shuffle for all; larger ones
are clustered in rounds over their blocks.
Everything is in double precision.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import LEAST_NORM, mean_vector, with_unit
from ..scratch import written
from . import blocks, density

ROUNDS = 50
#: A cluster holds at least one clip in so many.
SUPPORT = 10
#: Coordinates of a centre that order clusters of equal size.
ORDERING = 8
FORCED, PLAIN = "minimum_support_spherical_kmeans", "spherical_kmeans"
ROLES = ("global", "cluster_1", "cluster_2")


def normalised(clips: DataFrame, strict: bool = True) -> DataFrame:
    """(profile_id, clip_ix, unit) of rows (profile_id, clip_ix, embedding).

    A clip without a direction is an error, or left out if not ``strict``.
    """
    out = with_unit(clips, "embedding", "unit", strict).select("profile_id", "clip_ix", "unit")
    return out if strict else out.filter("unit is not null")


def global_vectors(clips: DataFrame) -> DataFrame:
    """(profile_id, vector, n): the unit mean of each profile's unit vectors."""
    means = clips.groupBy("profile_id").agg(mean_vector("unit").alias("mean"), F.count(F.lit(1)).alias("n"))
    return with_unit(means, "mean", "vector", strict=True).select("profile_id", "vector", "n")


def unit_mean(rows: np.ndarray) -> np.ndarray:
    mean = rows.mean(axis=0)
    length = np.sqrt(mean @ mean)
    if not np.isfinite(length) or length <= LEAST_NORM:
        raise ValueError("the mean of these vectors has no direction")
    return mean / length


def seeds(unit: np.ndarray) -> tuple[int, int]:
    """The clip nearest to the mean direction, and the one farthest from that clip; the first of equals."""
    middle = int(np.argmax(unit @ unit_mean(unit)))
    return middle, int(np.argmin(unit @ unit[middle]))


def split(unit: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, bool]:
    """Whether each clip belongs to the second centre, and whether minimum support decided.

    A clip goes to the nearer centre, to the first if both are as near. Should
    a side get too few, it takes those that lean most towards it, by the
    difference of similarities and then in clip order.
    """
    lean = unit @ centres[0] - unit @ centres[1]
    second = lean < 0
    least = -(-len(unit) // SUPPORT)
    if min(second.sum(), (~second).sum()) >= least:
        return second, False
    place = np.empty(len(unit), int)
    place[np.argsort(-lean, kind="stable")] = np.arange(len(unit))
    return (place >= least if (~second).sum() < least else place >= len(unit) - least), True


def two_clusters(unit: np.ndarray) -> dict:
    """Centres, sides and how they came about, of a matrix of unit rows."""
    if len(unit) == 1:
        return {"centres": unit[[0, 0]], "second": np.zeros(1, bool), "strategy": "single_embedding_duplicate", "rounds": 0}
    centres, before, forced, rounds = unit[list(seeds(unit))], None, False, 0
    while rounds < ROUNDS:
        rounds += 1
        second, supported = split(unit, centres)
        forced |= supported
        moved = np.array([unit_mean(unit[~second]), unit_mean(unit[second])])
        settled = before is not None and (second == before).all() and np.allclose(moved, centres)
        centres, before = moved, second
        if settled:
            break
    sizes = (int((~before).sum()), int(before.sum()))
    if (-sizes[1], *centres[1][:ORDERING]) < (-sizes[0], *centres[0][:ORDERING]):
        centres, before = centres[::-1], ~before
    name = FORCED if forced else PLAIN
    return {"centres": centres, "second": before, "strategy": name, "rounds": rounds}


def principal(unit: np.ndarray, most: int = 3) -> tuple[list[float], tuple[int, int]]:
    """Shares of variance of the first axes, and the places of the least and greatest projection on the first.

    By the eigenvectors of the scatter matrix or, if that is smaller, of the
    clips' inner products. The axis points so that its largest loading is
    positive. One clip, or equal ones, have no axes.
    """
    centred = unit - unit.mean(axis=0)
    if len(unit) == 1 or np.allclose(centred, 0.0):
        return [], (0, 0)
    wide = unit.shape[1] > len(unit)
    values, axes = np.linalg.eigh(centred @ centred.T if wide else centred.T @ centred)
    values = np.maximum(values[::-1], 0.0)
    axis = centred.T @ axes[:, -1] if wide else axes[:, -1]
    if axis[np.argmax(np.abs(axis))] < 0:
        axis = -axis
    along = centred @ axis
    rank = min(unit.shape)
    return [float(v / values.sum()) for v in values[: min(most, rank)]], (int(np.argmin(along)), int(np.argmax(along)))


def _grouped(clips: DataFrame, make, columns: str) -> DataFrame:
    kind = clips.schema["profile_id"].dataType.simpleString()
    narrow = clips.select("profile_id", F.col("clip_ix").cast("int").alias("clip_ix"), "unit")
    names = ["profile_id", *[c.split()[0] for c in columns.split(", ")]]

    def run(t: pa.Table) -> pa.Table:
        made = make(*density.matrix_of(t))
        who = t.column("profile_id").take(pa.array(np.zeros(len(made[0]), int)))
        return pa.table([who, *made], names)

    return narrow.groupBy("profile_id").applyInArrow(run, f"profile_id {kind}, {columns}")


def assignments(core: DataFrame) -> DataFrame:
    """(profile_id, clip_ix, cluster): 0 for the larger cluster, 1 for the other."""

    def make(ix, unit):
        return pa.array(ix, pa.int32()), pa.array(two_clusters(unit)["second"].astype(np.int32))

    def in_blocks(b: DataFrame) -> DataFrame:
        return blocks.sides(b, _states(b))

    return density.by_size(core, lambda c: _grouped(c, make, "clip_ix int, cluster int"), in_blocks)


def _states(b: DataFrame) -> DataFrame:
    return blocks.cluster_states(b, ROUNDS, SUPPORT, ORDERING)


def _strategy() -> Column:
    return F.when(F.col("forced"), FORCED).otherwise(PLAIN)


def clusters(core: DataFrame) -> DataFrame:
    """(profile_id, cluster, weight, vector, n, strategy, rounds): two rows a profile."""

    def make(ix, unit):
        found = two_clusters(unit)
        share = [1.0, 0.0] if len(unit) == 1 else [float((~found["second"]).mean()), float(found["second"].mean())]
        return (
            pa.array([0, 1], pa.int32()),
            pa.array(share),
            pa.array(list(found["centres"]), pa.list_(pa.float64())),
            pa.array([len(unit)] * 2, pa.int64()),
            pa.array([found["strategy"]] * 2),
            pa.array([found["rounds"]] * 2, pa.int32()),
        )

    columns = "cluster int, weight double, vector array<double>, n long, strategy string, rounds int"

    def in_blocks(b: DataFrame) -> DataFrame:
        two = [F.struct(F.lit(k).alias("cluster"), (F.col(f"n{k}") / F.col("n")).alias("weight"), F.col(f"c{k}").alias("vector")) for k in (0, 1)]
        return _states(b).select("profile_id", F.explode(F.array(*two)).alias("x"), "n", _strategy().alias("strategy"), "rounds").select("profile_id", "x.*", "n", "strategy", "rounds")

    return density.by_size(core, lambda c: _grouped(c, make, columns), in_blocks)


def seed_clips(core: DataFrame) -> DataFrame:
    """(profile_id, first_clip, second_clip)."""

    def make(ix, unit):
        first, second = seeds(unit)
        return pa.array(ix[[first]], pa.int32()), pa.array(ix[[second]], pa.int32())

    return density.by_size(core, lambda c: _grouped(c, make, "first_clip int, second_clip int"), blocks.seeds)


def representatives(core: DataFrame) -> DataFrame:
    """(profile_id, role, weight, vector): three rows a profile."""
    whole = global_vectors(core).select("profile_id", F.lit(ROLES[0]).alias("role"), F.lit(1.0).alias("weight"), "vector")
    role = F.when(F.col("cluster") == 0, ROLES[1]).otherwise(ROLES[2])
    return whole.unionByName(clusters(core).select("profile_id", role.alias("role"), "weight", "vector"))


SUMMARY = (
    "vectors array<struct<role:string,weight:double,vector:array<double>>>, assignments array<int>, strategy string, core_count long, "
    "outliers array<int>, threshold double, variance array<double>, low_clip int, high_clip int, diversity double, aggregate_ms double"
)
_VECTORS = pa.list_(pa.struct([("role", pa.string()), ("weight", pa.float64()), ("vector", pa.list_(pa.float64()))]))
KINDS = (
    _VECTORS, pa.list_(pa.int32()), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.float64(),
    pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.float64(), pa.float64(),
)


def summary(ix: np.ndarray, unit: np.ndarray, fraction: float) -> list[pa.Array]:
    """One row of ``SUMMARY`` columns for the clips of a profile, in clip order.

    ``assignments`` follows the clips, -1 for a trimmed one; axes are of all
    clips, diversity is theirs too, to the global vector of those kept.
    """
    began = time.perf_counter()
    out, threshold = density.trim(unit, fraction)
    core = np.delete(np.arange(len(unit)), out)
    found, whole = two_clusters(unit[core]), unit_mean(unit[core])
    sides = np.full(len(unit), -1)
    sides[core] = found["second"]
    share = float(found["second"].mean())
    vectors = zip(ROLES, (1.0, 1.0 - share, share), (whole, *found["centres"]))
    shares, (low, high) = principal(unit)
    row = [
        [{"role": r, "weight": w, "vector": v} for r, w, v in vectors], sides, found["strategy"], len(core), ix[out], threshold,
        shares, ix[low], ix[high], float(1.0 - (unit @ whole).mean()),
    ]
    return [pa.array([v], kind) for v, kind in zip([*row, 1000 * (time.perf_counter() - began)], KINDS)]


def aggregate(clips: DataFrame, max_outlier_fraction: float = 0.0) -> DataFrame:
    """(profile_id, and ``SUMMARY``): one row for each profile of rows (profile_id, clip_ix, embedding).

    One grouped pass, but for profiles too large for it; theirs takes many tasks, so ``aggregate_ms`` is null.
    """
    density.check_fraction(max_outlier_fraction)

    def grouped(c: DataFrame) -> DataFrame:
        return _grouped(c, lambda ix, unit: summary(ix, unit, max_outlier_fraction), SUMMARY)

    return density.by_size(normalised(clips), grouped, lambda b: _summary_of_blocks(b, max_outlier_fraction))


def _summary_of_blocks(whole: DataFrame, fraction: float) -> DataFrame:
    """``summary`` of the profiles in blocks."""
    none = F.lit(None)
    core, limits = whole, whole.select("profile_id", F.array().cast("array<int>").alias("outliers"), none.cast("double").alias("threshold")).distinct()
    gone = None
    if fraction:
        trim = written(density.outliers(blocks.density(whole), fraction))
        order = F.array_sort(F.collect_list(F.when(F.col("outlier"), F.struct("density", "clip_ix"))))
        limits = trim.groupBy("profile_id").agg(F.transform(order, lambda x: x["clip_ix"]).alias("outliers"), F.max("threshold").alias("threshold"))
        gone = trim.filter("outlier").select("profile_id", "clip_ix")
        each = whole.select("profile_id", F.explode("clips").alias("x")).select("profile_id", "x.*")
        core = blocks.blocked(each.join(gone, ["profile_id", "clip_ix"], "left_anti"))
    states, middle = _states(core), written(blocks.means(core).select("profile_id", "vector"))
    sides = blocks.sides(core, states)
    if gone is not None:
        sides = sides.unionByName(gone.withColumn("cluster", F.lit(-1)))
    # a number a clip, as an export row has it
    sides = sides.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("clip_ix", "cluster"))).alias("s")).select("profile_id", F.expr("s.cluster").alias("assignments"))
    spread = blocks.closeness(blocks.means(whole), middle)
    met = states
    for other in (middle, sides, limits, blocks.principal(whole), spread):
        met = met.join(other, "profile_id")
    roles = zip(ROLES, (F.lit(1.0), F.col("n0") / F.col("n"), F.col("n1") / F.col("n")), ("vector", "c0", "c1"))
    vectors = F.array(*[F.struct(F.lit(r).alias("role"), w.alias("weight"), F.col(v).alias("vector")) for r, w, v in roles])
    return met.select(
        "profile_id", vectors.alias("vectors"), "assignments", _strategy().alias("strategy"), F.col("n").alias("core_count"),
        "outliers", "threshold", "variance", "low_clip", "high_clip", "diversity", none.cast("double").alias("aggregate_ms"),
    )
