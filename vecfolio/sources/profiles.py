"""Profiles in and out: JSON documents, batches of them, and the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contract import SCHEMA

BATCH_VERSION = "batch-1.0"
#: Entries of an initial export that are used.
MOST_INITIAL = 100
_RESULT = "struct<" + ",".join(
    f"{name}:{kind}" for name, kind in (part.split(" ", 1) for part in SCHEMA.split(", ")[1:])
) + ">"
_ENTRY = f"struct<id:string,label:string,created_at:string,result:{_RESULT},profile:{_RESULT}>"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(position, id, label, created_at, result) of a batch document's complete entries.

    An entry holds its profile as ``result`` or ``profile``; it is complete with
    representative vectors. A file that isn't JSON, or without a list of
    profiles, is an error.
    """
    read = spark.read.schema(f"schema_version string, profiles array<{_ENTRY}>").option("multiLine", True).option("mode", "FAILFAST")
    listed = F.when(F.col("profiles").isNotNull(), F.col("profiles")).otherwise(
        F.raise_error(F.lit("the document has no list of profiles")).cast(f"array<{_ENTRY}>")
    )
    each = read.json(path).select(F.posexplode(listed).alias("position", "e"))
    out = each.select("position", "e.id", "e.label", "e.created_at", F.coalesce("e.result", "e.profile").alias("result"))
    return out.filter(F.size("result.aggregation.vectors") > 0)


def initial(spark: SparkSession, path: str | None, most: int = MOST_INITIAL) -> DataFrame:
    """The complete ones of the first ``most`` entries; none without a path."""
    if not path:
        return spark.createDataFrame([], f"position int, id string, label string, created_at string, result {_RESULT}")
    return entries(spark, path).filter(F.col("position") < most)


def imported(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a batch document; an error if there are none, or one isn't complete."""
    whole = spark.read.schema(f"profiles array<{_ENTRY}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    n = whole.select(F.coalesce(F.size("profiles"), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    found = entries(spark, path)
    if not n or n < 0 or found.count() != n:
        raise ValueError("every entry of a batch needs representative vectors")
    return found


def profile_json(exports: DataFrame) -> DataFrame:
    """(profile_id, json): each export as one JSON document, nulls shown."""
    body = F.struct(*[c for c in exports.columns if c != "profile_id"])
    return exports.select("profile_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def write_profiles(exports: DataFrame, path: str) -> None:
    """A JSON line for each profile."""
    exports.write.json(path)


def batch_documents(entry_rows: DataFrame, per_document: int = MOST_INITIAL) -> DataFrame:
    """(document, json): batch documents of up to about ``per_document`` entries (position, id, label, created_at, result)."""
    part = F.floor(F.col("position") / per_document).alias("document")
    # maps in an entry can't be ordered, so positions alone are, and entries follow them
    entry = F.struct("id", "label", "created_at", "result")
    grouped = entry_rows.groupBy(part).agg(F.map_from_entries(F.collect_list(F.struct("position", entry.alias("e")))).alias("m"))
    grouped = grouped.select("document", F.transform(F.array_sort(F.map_keys("m")), lambda k: F.element_at("m", k)).alias("profiles"))
    return grouped.select("document", F.to_json(F.struct(F.lit(BATCH_VERSION).alias("schema_version"), "profiles")).alias("json"))


def profile_rows(exports: DataFrame) -> DataFrame:
    """The catalogue's profile table: a row an export."""
    return exports.select(
        "profile_id", "schema_version", F.col("model.id").alias("model_id"), F.col("model.revision").alias("model_revision"),
        "model.dimensions", "source.duration_seconds", "source.windows_considered", "source.windows_retained",
        "source.windows_filtered", "source.sample_interval_seconds", "source.window_seconds",
        F.col("aggregation.method").alias("aggregation_method"),
    )


def vector_rows(exports: DataFrame) -> DataFrame:
    """The catalogue's vector table: a row for each role of an export."""
    return exports.select(
        "profile_id", F.explode("aggregation.vectors").alias("v"), F.col("model.id").alias("model_id"),
        F.col("model.revision").alias("model_revision"), F.col("aggregation.method").alias("aggregation_method"),
        F.col("aggregation.version").alias("aggregation_version"),
    ).select("profile_id", "v.role", "v.weight", "v.vector", "model_id", "model_revision", "aggregation_method", "aggregation_version")


def write_catalogue(exports: DataFrame, path: str) -> None:
    """Both tables as Parquet; vectors are parted by revision and role, so retrieval prunes."""
    profile_rows(exports).write.mode("append").parquet(f"{path}/profiles")
    vector_rows(exports).write.mode("append").partitionBy("model_revision", "role").parquet(f"{path}/vectors")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")
