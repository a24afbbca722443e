"""A library of profiles: no entry twice, the newest kept, and its totals.

Entries are rows (label, duration_s, revision, interval_s, fraction, position, …).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import profile_name

KEPT = 80


def signature() -> Column:
    """What makes two entries the same: name, duration, model revision, interval and trim fraction."""
    c = F.col
    return F.concat_ws(
        "::",
        F.lower(profile_name(c("label"))),
        F.format_string("%.2f", F.coalesce("duration_s", F.lit(0.0))),
        F.coalesce("revision", F.lit("unknown")),
        F.coalesce(F.nullif(c("interval_s"), F.lit(0)).cast("string"), F.lit("unknown")),
        F.regexp_replace(F.coalesce("fraction", F.lit(0.0)).cast("string"), r"\.0$", ""),
    )


def merged(library: DataFrame, additions: DataFrame) -> DataFrame:
    """The library and those additions whose signature it hasn't; of equal additions the first.

    The first of a signature is an aggregate, made in part before the shuffle.
    """
    both = library.withColumn("source", F.lit(0)).unionByName(additions.withColumn("source", F.lit(1)))
    keyed = both.withColumn("signature", signature())
    place = F.struct("source", "position")
    first = keyed.filter("source = 1").groupBy("signature").agg(F.min("position").alias("position")).withColumn("source", F.lit(1))
    known = keyed.filter("source = 0").select("signature").distinct()
    added = keyed.filter("source = 1").join(first, ["signature", "position", "source"], "left_semi").join(known, "signature", "left_anti")
    return keyed.filter("source = 0").unionByName(added)


def newest(entries: DataFrame, kept: int = KEPT) -> DataFrame:
    """The last entries by (source, position)."""
    return entries.orderBy(F.desc("source"), F.desc("position")).limit(kept)


def totals(entries: DataFrame) -> DataFrame:
    """Sums of a collection's windows, clips, hours and processing seconds."""
    return entries.agg(
        F.count(F.lit(1)).alias("profiles"),
        F.sum("retained").alias("retained"),
        F.sum("considered").alias("considered"),
        F.sum("core").alias("core"),
        F.sum("duration_s").alias("duration_s"),
        (F.sum("total_ms") / 1000).alias("processing_s"),
    )
