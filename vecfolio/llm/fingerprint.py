"""Canonical exact digests of documents, in Spark expressions only.

A text is put into Unicode form NFKC, case-folded, put into NFKC again, and its
runs of white space become one blank, outer ones none. The fingerprint is two
chained 64-bit xxhashes of that canonical text (128 bits). Groups are formed by
fingerprint and then by the bytes of the canonical text.

Defined results: a null text counts as empty; empty texts share one fingerprint;
equal texts have equal fingerprints whatever else a row holds; repeated rows are
kept; other columns are ignored; no rows give no rows. Neighbours of equal
doc_id are ordered by text; a null doc_id comes last in descending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, table

#: The characters of Unicode's White_Space property.
SPACES = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"

#: Ids that are broadcast at most; each is a long.
MOST_SENT = 200_000


def _nfkc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(_nfkc(folded), SPACES, " "))


def wide_hash(text: Column) -> Column:
    """128 bits of chained xxhash64 as 32 hex digits."""
    halves = (F.xxhash64(text), F.xxhash64(F.lit("wide"), text))
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))


def exact_groups(texts: DataFrame) -> DataFrame:
    """(fingerprint, canonical, class_id, class_size) of rows (doc_id, fingerprint, canonical).

    Rows of one class have byte-equal canonical texts; class_id is the smallest
    doc_id. Counts are pre-aggregated before the shuffle, so a hot group costs
    one row a task.
    """
    return texts.groupBy("fingerprint", "canonical").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")
    )


def repeated_classes(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(fingerprint, class_id, class_size, bucket_texts) of the fingerprints that several rows have.

    Only their rows' texts are fetched, and their bytes compared. ``docs`` has
    (doc_id, text), ``digests`` (doc_id, fingerprint); other rows of the same ids come along and do no harm.
    """
    often = materialise(digests.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"))
    ids = materialise(digests.join(often, "fingerprint", "left_semi").select(F.col("doc_id").alias("_id")).distinct())
    # a list of ids is sent to the texts as long as it is short; a longer one meets them in a shuffle
    ids = F.broadcast(ids) if ids.count() <= MOST_SENT else ids.hint("merge")
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("doc_id", canonical(F.col("text")).alias("canonical"))
    groups = exact_groups(texts.withColumn("fingerprint", wide_hash(F.col("canonical"))))
    # a table of its own, so that joins with it read two shuffles and a hot fingerprint's rows can be dealt to several tasks
    return materialise(
        groups.groupBy("fingerprint").agg(
            F.min("class_id").alias("class_id"), F.sum("class_size").alias("class_size"), F.count(F.lit(1)).alias("bucket_texts")
        )
    )


def _below(cuts: list[int], x: Column) -> Column:
    """How many of the sorted cuts are below x: first among every step-th one, then in the stretch that follows."""
    step = max(1, int(len(cuts) ** 0.5))
    every, coarse = (F.array(*[F.lit(c).cast("long") for c in some]).cast("array<bigint>") for some in (cuts, cuts[step - 1 :: step]))
    passed = F.size(F.filter(coarse, lambda c: c < x)) * step
    return passed + F.size(F.filter(F.slice(every, passed + 1, F.lit(step)), lambda c: c < x))


def with_next_text(docs: DataFrame) -> DataFrame:
    """Adds ``next_text``: the text of the next row by descending doc_id, after the last the first.

    Rows are dealt to id ranges; the first row of each range is also sent,
    marked, to the range before it, so every window sees its successor.
    """
    spark = docs.sparkSession
    n = 4 * shuffle_partitions(spark)
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    # range 0 holds the largest ids; a null id goes to the last range
    ranged = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), n).otherwise(len(cuts) - _below(cuts, F.col("doc_id"))))
    tops = [
        (r["_range"], r["top"])
        for r in ranged.groupBy("_range").agg(F.max("doc_id").alias("top")).orderBy("_range").collect()
    ]  # at most one row a range
    marks = [(tops[i - 1][0] if i else tops[-1][0], r, t) for i, (r, t) in enumerate(tops)]
    heads = spark.createDataFrame(marks, "_to int, _range int, _top long")
    sentinels = (
        ranged.join(F.broadcast(heads), "_range")
        .filter(F.col("doc_id").eqNullSafe(F.col("_top")))
        .select("doc_id", "text", F.col("_to").alias("_range"), F.lit(True).alias("_mark"))
    )
    order = [F.col("_mark").asc(), F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    window = Window.partitionBy("_range").orderBy(*order)
    both = ranged.select("doc_id", "text", "_range", F.lit(False).alias("_mark")).unionByName(sentinels)
    return both.withColumn("next_text", F.lead("text").over(window)).filter(~F.col("_mark")).drop("_mark", "_range")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    pairs = with_next_text(docs).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        canonical(F.col("text")).alias("_own"),
        canonical(F.col("next_text")).alias("_next"),
        F.concat(
            F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)
        ).alias("_edited"),
    )
    pairs = pairs.withColumn("_edited_own", canonical(F.col("_edited")))
    digests = materialise(
        pairs.select(
            "doc_id",
            "n_chars",
            F.sha2("_edited", 256).alias("edited_sha256"),
            wide_hash(F.col("_own")).alias("fingerprint"),
            wide_hash(F.col("_edited_own")).alias("edited_fingerprint"),
            (F.col("_own") == F.col("_edited_own")).cast("double").alias("near_edited"),
            (F.col("_own") == F.col("_next")).cast("double").alias("near_next"),
        )
    )
    classes = repeated_classes(docs, digests)
    alone = F.col("class_size").isNull()
    return digests.join(classes, "fingerprint", "left").select(
        *digests.columns,
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("bucket_texts", F.lit(1)).alias("bucket_texts"),
    )
