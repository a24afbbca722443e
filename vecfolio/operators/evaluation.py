"""How well similarity ranks profiles of one group before others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_accuracy(nearest: DataFrame, groups: DataFrame) -> DataFrame:
    """(n, hits, accuracy) of rows (ordinal, nearest) under groups (ordinal, group)."""
    other = groups.select(F.col("ordinal").alias("nearest"), F.col("group").alias("_other"))
    met = nearest.join(groups, "ordinal").join(other, "nearest")
    same = (F.col("group") == F.col("_other")).cast("double")
    return met.agg(F.count(F.lit(1)).alias("n"), F.sum(same).cast("long").alias("hits"), F.avg(same).alias("accuracy"))


def _with_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    left = groups.select(F.col("ordinal").alias("left"), F.col("group").alias("_a"))
    right = groups.select(F.col("ordinal").alias("right"), F.col("group").alias("_b"))
    return pairs.join(left, "left").join(right, "right").withColumn("same", F.col("_a") == F.col("_b"))


def margin(pairs: DataFrame, groups: DataFrame, column: str = "similarity") -> DataFrame:
    """(within, across, margin): mean similarities of ordered pairs (left, right) in a group and across groups."""
    means = _with_groups(pairs, groups).agg(
        F.avg(F.when(F.col("same"), F.col(column))).alias("within"), F.avg(F.when(~F.col("same"), F.col(column))).alias("across")
    )
    return means.withColumn("margin", F.col("within") - F.col("across"))


def ranking(pairs: DataFrame, groups: DataFrame, k: int = 5, column: str = "similarity") -> DataFrame:
    """(n, recall_at_k, mrr) over profiles that have another one in their group."""
    order = Window.partitionBy("left").orderBy(F.desc(column), "right")
    ranked = _with_groups(pairs, groups).withColumn("rank", F.row_number().over(order))
    own = ranked.filter("same").groupBy("left").agg(
        F.count(F.lit(1)).alias("relevant"), F.sum((F.col("rank") <= k).cast("int")).alias("found"), F.min("rank").alias("first")
    )
    return own.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("found") / F.least(F.col("relevant"), F.lit(k))).alias("recall_at_k"),
        F.avg(F.lit(1.0) / F.col("first")).alias("mrr"),
    )
