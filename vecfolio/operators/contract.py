"""The export contract of a profile, as queries for its violations.

An export is a row (profile_id, model, source, aggregation, diagnostics,
timing_ms) of nested columns. A violation is a row (profile_id, rule, severity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiles import ROLES
from .sampling import INTERVALS

#: Fixed values of the contract.
SCHEMA_VERSION = "1.0"
METHOD, METHOD_VERSION = "robust_spherical_kmeans", "3"
STRATEGIES = ("spherical_kmeans", "minimum_support_spherical_kmeans", "single_embedding_duplicate")
OUTLIER_METHODS = ("disabled", "knn_density_mad_3.5")
BACKENDS = ("clap", "fake")
MOST_PROFILES, MOST_LABEL = 100, 200

SCHEMA = (
    "profile_id string, schema_version string, "
    "model struct<id:string,revision:string,dimensions:int,device:string,backend:string,load_duration_ms:int>, "
    "source struct<duration_seconds:double,sample_interval_seconds:int,window_seconds:double,windows_considered:int,"
    "windows_retained:int,windows_filtered:int,filter_counts:map<string,int>>, "
    "aggregation struct<method:string,version:string,cluster_strategy:string,outlier_method:string,"
    "max_outlier_fraction:double,input_clip_count:int,core_clip_count:int,embedding_outlier_count:int,"
    "local_density_threshold:double,vectors:array<struct<role:string,weight:double,vector:array<double>>>>, "
    "diagnostics struct<pca_explained_variance_ratio:array<double>,pca_extreme_snippets:array<struct<side:string,"
    "retained_clip_index:int,start_seconds:double,timecode:string>>,diversity:double>, "
    "timing_ms map<string,int>"
)


def rules() -> dict[str, Column]:
    """What must hold, by the rule's name; a null counts as broken."""
    c = F.col
    vectors = c("aggregation.vectors")
    weights = F.aggregate(F.slice(vectors, 2, 2), F.lit(0.0), lambda s, v: s + v["weight"])
    return {
        "schema_version": c("schema_version") == SCHEMA_VERSION,
        "positive_dimensions": c("model.dimensions") > 0,
        "device": c("model.device") == "cpu",
        "backend": c("model.backend").isin(*BACKENDS),
        "load_duration": c("model.load_duration_ms") >= 0,
        "positive_duration": c("source.duration_seconds") > 0,
        "sample_interval": c("source.sample_interval_seconds").isin(*INTERVALS),
        "positive_window": c("source.window_seconds") > 0,
        "window_counts": (c("source.windows_considered") > 0) & (c("source.windows_retained") > 0) & (c("source.windows_filtered") >= 0),
        "method": (c("aggregation.method") == METHOD) & (c("aggregation.version") == METHOD_VERSION),
        "cluster_strategy": c("aggregation.cluster_strategy").isin(*STRATEGIES),
        "outlier_method": c("aggregation.outlier_method").isin(*OUTLIER_METHODS),
        "outlier_fraction": c("aggregation.max_outlier_fraction").between(0, 0.1),
        "clip_counts": (c("aggregation.input_clip_count") > 0) & (c("aggregation.core_clip_count") > 0) & (c("aggregation.embedding_outlier_count") >= 0),
        "three_vectors": F.size(vectors) == 3,
        "vectors_not_empty": F.forall(vectors, lambda v: F.size(v["vector"]) > 0),
        "weight_range": F.forall(vectors, lambda v: v["weight"].between(0, 1)),
        "role_order": F.transform(vectors, lambda v: v["role"]) == F.array(*[F.lit(r) for r in ROLES]),
        "vector_length": F.forall(vectors, lambda v: F.size(v["vector"]) == c("model.dimensions")),
        "weights_sum": F.abs(weights - 1.0) <= 1e-5,
        "counts_reconcile": c("aggregation.core_clip_count") + c("aggregation.embedding_outlier_count") == c("aggregation.input_clip_count"),
        "two_extremes": F.size("diagnostics.pca_extreme_snippets") == 2,
        "extremes": F.forall(
            c("diagnostics.pca_extreme_snippets"),
            lambda s: s["side"].isin("low", "high") & (s["retained_clip_index"] >= 0) & (s["start_seconds"] >= 0),
        ),
        "diversity": c("diagnostics.diversity") >= 0,
    }


def warnings() -> dict[str, Column]:
    """What should hold, though the contract doesn't ask for it."""
    c = F.col
    counted = F.aggregate(F.map_values("source.filter_counts"), F.lit(0), lambda s, x: s + x)
    return {
        "windows_reconcile": c("source.windows_retained") + c("source.windows_filtered") == c("source.windows_considered"),
        "filter_counts_reconcile": counted == c("source.windows_filtered"),
    }


def violations(exports: DataFrame) -> DataFrame:
    """(profile_id, rule, severity) of every rule that an export breaks, in one pass."""
    broken = [
        F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))
        for severity, group in (("error", rules()), ("warning", warnings()))
        for name, ok in group.items()
    ]
    found = exports.select("profile_id", F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("x"))
    return found.select("profile_id", "x.rule", "x.severity")


def duplicate_roles(vectors: DataFrame) -> DataFrame:
    """(profile_id, role, n) where a profile has a role more than once."""
    return vectors.groupBy("profile_id", "role").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphan_vectors(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """Vectors whose profile is absent."""
    return vectors.join(profiles.select("profile_id"), "profile_id", "left_anti")


def without_deleted(vectors: DataFrame, deleted: DataFrame) -> DataFrame:
    """Vectors that are left once the deleted profiles' go with them."""
    return vectors.join(deleted.select("profile_id"), "profile_id", "left_anti")


def table_violations(profiles: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """(profile_id, problem) of the catalogue's tables: their columns' checks, a role twice, a vector without a profile.

    ``profiles`` and ``vectors`` are as ``sources.profiles.profile_rows`` and ``vector_rows`` return; a null breaks a check.
    """
    c = F.col
    checks = {
        "dimensions": c("dimensions") == dimensions,
        "duration_seconds": c("duration_seconds") > 0,
        "windows_considered": c("windows_considered") > 0,
        "windows_retained": c("windows_retained") > 0,
        "windows_filtered": c("windows_filtered") >= 0,
    }
    of_vectors = {"role": c("role").isin(*ROLES), "weight": c("weight").between(0, 1), "vector": F.size("vector") == dimensions}

    def broken(rows: DataFrame, group: dict[str, Column]) -> DataFrame:
        found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in group.items()])
        return rows.select("profile_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))

    twice = duplicate_roles(vectors).select("profile_id", F.lit("role_twice").alias("problem"))
    lost = orphan_vectors(vectors, profiles).select("profile_id", F.lit("no_profile").alias("problem"))
    return broken(profiles, checks).unionByName(broken(vectors, of_vectors)).unionByName(twice).unionByName(lost)


def map_request_problems(profiles: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(map_id, rule) of map requests, rows (map_id, ordinal, label, …): their number of profiles and labels.

    ``requests`` (map_id) names all of them, so that one without profiles shows up too.
    """
    n = profiles.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max((~F.coalesce(F.length("label").between(1, MOST_LABEL), F.lit(False))).cast("int")).alias("bad"),
    )
    if requests is not None:
        n = requests.select("map_id").distinct().join(n, "map_id", "left")
    size = F.coalesce("n", F.lit(0))
    rows = F.filter(
        F.array(F.when(~size.between(1, MOST_PROFILES), F.lit("profile_count")), F.when(F.col("bad") > 0, F.lit("label_length"))),
        lambda x: x.isNotNull(),
    )
    return n.select("map_id", F.explode(rows).alias("rule"))
