"""Similarity, nearest profiles and retrieval over a catalogue of profiles.

Pairs within a map request (at most 100 profiles) are a join on the request.
Nearest profiles over a whole catalogue are in ``nearest``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_double, cosine, dot, scaled, norm, has_direction
from .contract import MOST_PROFILES
from .profiles import ROLES

GLOBAL_WEIGHT, CLUSTER_WEIGHT = 0.25, 0.75


def pivoted(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, g, c1, c2, w1, w2): a profile's three unit vectors in a row, weights scaled to sum 1.

    Of rows (keys, role, weight, vector); of a role that comes twice the last by
    ``place`` counts, where there is such a column, else the greatest. A profile
    without exactly the three roles, or with vectors without direction or of
    unlike lengths, is an error.
    """
    unit = vectors.withColumn("_v", as_double("vector")).withColumn("_n", norm(F.col("_v")))
    good = has_direction(F.col("_v"), F.col("_n"))
    unit = unit.withColumn("_v", F.when(good, scaled(F.col("_v"), F.col("_n"))))
    fields = [c for c in ("place",) if c in vectors.columns] + ["_v", "weight"]
    take = {r: F.max(F.when(F.col("role") == r, F.struct(*fields))) for r in ROLES}
    wide = unit.groupBy(*keys).agg(
        F.array_sort(F.collect_set("role")).alias("_roles"),
        F.min(F.col("_v").isNotNull().cast("int")).alias("_good"),
        F.size(F.collect_set(F.size("vector"))).alias("_lengths"),
        *[x.alias(name) for name, x in zip(("_g", "_1", "_2"), take.values())],
    )
    ok = (F.col("_roles") == F.array_sort(F.array(*[F.lit(r) for r in ROLES]))) & (F.col("_good") == 1) & (F.col("_lengths") == 1)
    total = F.greatest(F.col("_1.weight") + F.col("_2.weight"), F.lit(1e-12))
    checked = F.when(ok, F.col("_g._v")).otherwise(
        F.raise_error(F.lit("each profile needs three roles with vectors of one length that aren't zero")).cast("array<double>")
    )
    return wide.select(
        *keys, checked.alias("g"), F.col("_1._v").alias("c1"), F.col("_2._v").alias("c2"),
        (F.col("_1.weight") / total).alias("w1"), (F.col("_2.weight") / total).alias("w2"),
    )


def coverage(a: str, b: str) -> Column:
    """Symmetric cluster coverage of two pivoted rows under aliases a and b."""
    s = {(i, j): dot(F.col(f"{a}.c{i}"), F.col(f"{b}.c{j}")) for i in (1, 2) for j in (1, 2)}
    left = sum((F.col(f"{a}.w{i}") * F.greatest(s[i, 1], s[i, 2]) for i in (1, 2)), F.lit(0.0))
    right = sum((F.col(f"{b}.w{j}") * F.greatest(s[1, j], s[2, j]) for j in (1, 2)), F.lit(0.0))
    return F.lit(0.5) * (left + right)


def blended(whole: Column, clusters: Column) -> Column:
    return F.lit(GLOBAL_WEIGHT) * whole + F.lit(CLUSTER_WEIGHT) * clusters


def request_similarities(profiles: DataFrame) -> DataFrame:
    """(map_id, left, right, global_similarity, cluster_similarity, similarity) of all ordered pairs in a request.

    Profiles are pivoted rows with (map_id, ordinal), at most ``MOST_PROFILES``
    in a request; more are an error. Each pair is scored once and given both ways.
    """
    sizes = profiles.groupBy("map_id").agg(F.count(F.lit(1)).alias("_n"))
    small = F.when(F.col("_n") <= MOST_PROFILES, F.col("map_id")).otherwise(
        F.raise_error(F.lit(f"a map request has more than {MOST_PROFILES} profiles")).cast(profiles.schema["map_id"].dataType)
    )
    checked = profiles.join(sizes.select(small.alias("map_id")), "map_id")
    pairs = checked.alias("a").join(profiles.alias("b"), (F.col("a.map_id") == F.col("b.map_id")) & (F.col("a.ordinal") < F.col("b.ordinal")))
    once = pairs.select(
        F.col("a.map_id").alias("map_id"), F.col("a.ordinal").alias("left"), F.col("b.ordinal").alias("right"),
        dot(F.col("a.g"), F.col("b.g")).alias("global_similarity"), coverage("a", "b").alias("cluster_similarity"),
    )
    scored = once.withColumn("similarity", blended(F.col("global_similarity"), F.col("cluster_similarity")))
    names = scored.columns
    sides = F.explode(F.array(F.struct("left", "right"), F.struct(F.col("right").alias("left"), F.col("left").alias("right"))))
    both = scored.withColumn("_s", sides)
    return both.select(*[F.col(f"_s.{n}") if n in ("left", "right") else F.col(n) for n in names])


def request_nearest(profiles: DataFrame) -> DataFrame:
    """(map_id, ordinal, nearest, three scores): each profile's nearest in its request; null if it is alone.

    The profile itself is left out by its place, so equal ids don't matter;
    ties go to the smaller ordinal.
    """
    order = Window.partitionBy("map_id", "left").orderBy(F.desc("similarity"), "right")
    best = request_similarities(profiles).withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    best = best.select("map_id", F.col("left").alias("ordinal"), F.col("right").alias("nearest"), "similarity", "global_similarity", "cluster_similarity")
    return profiles.select("map_id", "ordinal").join(best, ["map_id", "ordinal"], "left")


def match_vectors(vectors: DataFrame, query: list[float], k: int = 20, role: str | None = None, model_revision: str | None = None) -> DataFrame:
    """(profile_id, role, similarity) of the k vectors nearest to the query by cosine, one at least.

    Ties go to the smaller (profile_id, role). Role and revision are optional
    filters, and reach the scan.
    """
    if role is not None:
        vectors = vectors.filter(F.col("role") == role)
    if model_revision is not None:
        vectors = vectors.filter(F.col("model_revision") == model_revision)
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("profile_id", "role", cosine(as_double("vector"), asked).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "profile_id", "role").limit(max(k, 1))


def register_match(spark: SparkSession, view: str = "catalogue_vectors", name: str = "match_vectors") -> None:
    """A table function for SQL over a view of vectors (profile_id, role, vector, model_revision).

    ``match_vectors(query, k, role, revision)`` gives (profile_id, role,
    similarity) as ``match_vectors`` here does; a null role or revision is any.
    The function is SQL itself, so Spark plans it with its arguments in place,
    and a role or revision reaches the scan.
    """
    kind = spark.table(view).schema["profile_id"].dataType.simpleString()
    dot_ = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    v = "cast(v.vector as array<double>)"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, k INT DEFAULT 20, asked_role STRING DEFAULT NULL, asked_revision STRING DEFAULT NULL)
        RETURNS TABLE (profile_id {kind}, role STRING, similarity DOUBLE)
        RETURN SELECT profile_id, role, similarity FROM (
          SELECT profile_id, role, similarity, row_number() OVER (ORDER BY similarity DESC, profile_id, role) AS n FROM (
            SELECT v.profile_id, v.role, {dot_.format(v, 'query')} / (sqrt({dot_.format(v, v)}) * sqrt({dot_.format('query', 'query')})) AS similarity
            FROM {view} v WHERE (asked_role IS NULL OR v.role = asked_role) AND (asked_revision IS NULL OR v.model_revision = asked_revision)))
        WHERE n <= greatest(k, 1)"""
    )


def reranked(profiles: DataFrame, query: DataFrame, k: int = 20) -> DataFrame:
    """(profile_id, similarity, global_similarity, cluster_similarity, rank) of the query's k nearest by global vector, ranked by the blend.

    Both are pivoted rows with (profile_id); the query is one row, and its own id is left out.
    """
    asked = query.limit(1).select(*[F.col(c).alias(f"q_{c}") for c in ("profile_id", "g", "c1", "c2", "w1", "w2")])
    met = profiles.join(F.broadcast(asked), F.col("profile_id") != F.col("q_profile_id"))  # one row
    short = met.withColumn("global_similarity", dot(F.col("g"), F.col("q_g"))).orderBy(F.desc("global_similarity"), "profile_id").limit(max(k, 1))
    q = F.struct(*[F.col(f"q_{c}").alias(c) for c in ("c1", "c2", "w1", "w2")])
    pair = short.select("profile_id", "global_similarity", F.struct("c1", "c2", "w1", "w2").alias("a"), q.alias("b"))
    scored = pair.withColumn("cluster_similarity", coverage("a", "b"))
    scored = scored.withColumn("similarity", blended(F.col("global_similarity"), F.col("cluster_similarity")))
    order = Window.orderBy(F.desc("similarity"), "profile_id")  # k rows
    return scored.select("profile_id", "similarity", "global_similarity", "cluster_similarity", F.row_number().over(order).alias("rank"))
