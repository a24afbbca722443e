"""The two-dimensional map of a catalogue.

A projection is fitted to global vectors: mean and scatter matrix are sums over
partitions, so only a matrix of the dimension's size reaches the driver. A
fitted projection is a one-row table that can be kept and used again; then
profiles that come later don't move those that are there.

Moments can be kept: a row for each batch of profiles put or taken off, whose
sums are the catalogue's. A projection fitted anew from them needs no sums over
the catalogue; only how far its profiles reach along both axes is asked of it,
since a maximum can't be taken off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, with_unit
from .blocks import vector_sum

LEAST_SCALE = 1e-6
#: A catalogue of so many vectors makes a frozen projection.
LEAST_FROZEN = 3
METHODS = {False: "collection_pca_v2", True: "frozen_reference_pca_v1"}
SIMILARITY_METHOD = "quarter_global_three_quarter_weighted_cluster_v1"
SCHEMA = "center array<double>, axis_1 array<double>, axis_2 array<double>, scale array<double>, variance array<double>, version string, reference_count long"


def moments(unit: DataFrame, column: str = "unit") -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and sum of outer products of the vectors, summed in the partitions first."""
    d = unit.select(F.size(column)).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
                n, total, outer = n + len(x), total + x.sum(axis=0), outer + x.T @ x
        values = np.concatenate([[n], total, outer.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "value"])

    sums = unit.select(column).mapInArrow(run, "i long, value double").groupBy("i").agg(F.sum("value").alias("value"))
    values = np.array([r["value"] for r in sums.orderBy("i").collect()])  # 1 + d + d * d numbers
    return int(values[0]), values[1 : d + 1], values[d + 1 :].reshape(d, d)


MOMENTS = "n long, total array<double>, outer array<double>"


def moment_row(vectors: DataFrame, column: str = "vector", removed: bool = False) -> DataFrame:
    """The one-row ``MOMENTS`` of profiles put, or taken off, to be appended to those kept; no rows give none."""
    unit = with_unit(vectors, column, "unit", strict=True).select("unit")
    spark = vectors.sparkSession
    if unit.isEmpty():
        return spark.createDataFrame([], MOMENTS)
    n, total, outer = moments(unit)
    sign = -1 if removed else 1
    return spark.createDataFrame([(sign * n, (sign * total).tolist(), (sign * outer).ravel().tolist())], MOMENTS)


def refit(kept: DataFrame, vectors: DataFrame, column: str = "vector") -> DataFrame:
    """``fit`` of the catalogue whose ``MOMENTS`` were kept; ``vectors`` are asked for their reach only."""
    unit = with_unit(vectors, column, "unit", strict=True).select("unit")
    row = kept.agg(F.sum("n").alias("n"), vector_sum("total").alias("total"), vector_sum("outer").alias("outer")).first()
    if not row["n"] or row["n"] < 0:
        raise ValueError("there is no vector to fit a projection to")
    total = np.array(row["total"])
    return _projection(unit, int(row["n"]), total, np.array(row["outer"]).reshape(len(total), -1))


def fit(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """The one-row projection of rows with a vector column.

    Each axis points so that the reference coordinate that is largest in
    absolute value is positive (of equals, that of the least unit vector).
    Equal vectors, or one, get the first two coordinate axes. The version
    hashes the numbers at six decimals, so it doesn't hang on the last bits.
    """
    unit = with_unit(vectors, column, "unit", strict=True).select("unit")
    if unit.isEmpty():
        raise ValueError("there is no vector to fit a projection to")
    return _projection(unit, *moments(unit))


def _projection(unit: DataFrame, n: int, total: np.ndarray, outer: np.ndarray) -> DataFrame:
    center, d = total / n, len(total)
    scatter = outer - n * np.outer(center, center)
    variance = [0.0, 0.0]
    axes = np.zeros((2, d))
    # equal vectors differ by rounding only, and have no coordinates
    equal = np.sqrt(max(np.trace(scatter), 0.0) / n) <= 1e-7
    if equal:
        axes[0, 0] = axes[1, min(1, d - 1)] = 1.0
    else:
        values, columns = np.linalg.eigh(scatter)
        values = np.maximum(values[::-1], 0.0)
        axes[: min(2, d)] = columns.T[::-1][:2]
        variance[: min(2, d, n)] = (values[: min(2, d, n)] / max(values.sum(), 1e-12)).tolist()
    literal = [F.array(*[F.lit(float(x)) for x in a]) for a in axes]
    middle = F.array(*[F.lit(float(x)) for x in center])
    moved = F.zip_with("unit", middle, lambda x, c: x - c)
    coordinates = unit.select("unit", *[dot(moved, a).alias(f"a{k}") for k, a in enumerate(literal)])
    far = coordinates.agg(
        *[F.max(F.struct(F.round(F.abs(f"a{k}"), 9).alias("size"), F.transform("unit", lambda x: -x).alias("least"), F.col(f"a{k}").alias("at"))).alias(f"f{k}") for k in (0, 1)]
    ).first()
    at = [0.0 if equal else far[f"f{k}"]["at"] for k in (0, 1)]
    axes *= np.where(np.array(at) < 0, -1.0, 1.0)[:, None]
    scale = [max(abs(x), LEAST_SCALE) for x in at]
    text = ";".join(",".join(f"{x + 0.0:.6f}" for x in part) for part in (center, *axes, scale)) + f";{n}"
    version = "pca-" + hashlib.sha256(text.replace("-0.000000", "0.000000").encode()).hexdigest()[:12]
    row = (center.tolist(), axes[0].tolist(), axes[1].tolist(), scale, variance, version, n)
    return unit.sparkSession.createDataFrame([row], SCHEMA)


def transform(vectors: DataFrame, projection: DataFrame, column: str = "vector") -> DataFrame:
    """``vectors`` with map coordinates x and y in (-1, 1) by a one-row projection."""
    unit = with_unit(vectors, column, "_unit", strict=True)
    met = unit.join(F.broadcast(projection.limit(1).select("center", "axis_1", "axis_2", "scale")))  # one row
    fits = F.when(F.size("_unit") == F.size("center"), F.col("_unit")).otherwise(
        F.raise_error(F.lit("the projection was fitted to vectors of another length")).cast("array<double>")
    )
    met = met.withColumn("_moved", F.zip_with(fits, "center", lambda x, c: x - c))
    for k, name in enumerate(("x", "y")):
        met = met.withColumn(name, F.tanh(dot(F.col("_moved"), F.col(f"axis_{k + 1}")) / F.col("scale")[k]))
    return met.drop("_unit", "_moved", "center", "axis_1", "axis_2", "scale")


def projection_for(vectors: DataFrame, reference: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """A projection and whether it is frozen: fitted to the reference if that has enough vectors, else to ``vectors``."""
    if reference is not None and reference.limit(LEAST_FROZEN).count() == LEAST_FROZEN:
        return fit(reference), True
    return fit(vectors), False


def header(projection: DataFrame, frozen: bool, n_profiles: int) -> DataFrame:
    """The map's one-row header."""
    return projection.select(
        F.lit(METHODS[frozen]).alias("method"),
        F.col("version").alias("projection_version"),
        F.lit(frozen).alias("projection_is_stable"),
        F.col("reference_count").alias("reference_profile_count"),
        F.lit(SIMILARITY_METHOD).alias("similarity_method"),
        F.lit(n_profiles).cast("long").alias("relative_to_profile_count"),
        F.transform("variance", lambda x: F.round(x, 6)).alias("axis_explained_variance_ratio"),
    )


def payload(points: DataFrame, nearest: DataFrame) -> DataFrame:
    """(map_id, ordinal, json) of rows (map_id, ordinal, id, label, x, y) and their nearest."""
    named = points.select("map_id", F.col("ordinal").alias("nearest"), F.col("id").alias("_id"), F.col("label").alias("_label"))
    met = points.join(nearest, ["map_id", "ordinal"], "left").join(named, ["map_id", "nearest"], "left")
    near = F.when(
        F.col("nearest").isNotNull(),
        F.struct(F.col("_id").alias("id"), F.col("_label").alias("label"), *[F.round(c, 6).alias(c) for c in ("similarity", "global_similarity", "cluster_similarity")]),
    )
    point = F.struct(F.struct(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.lit(1.0).alias("weight")).alias("global"))
    return met.select("map_id", "ordinal", F.to_json(F.struct("id", "label", point.alias("points"), near.alias("nearest")), {"ignoreNullFields": "false"}).alias("json"))
