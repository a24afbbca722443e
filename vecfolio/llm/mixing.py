"""Mixing sources to target weights, in DataFrame operations only.

Every source's words are packed, document after document, into blocks of fixed
length. The mix is a row of slots, cut into output shards. All slots of all
sources are numbered, and one pseudorandom permutation of those numbers deals
them to positions, so that the counts of sources in a shard are a multinomial
draw on the condition that the shards together meet each source's total. Slot j
of a source reads, in pass j / blocks, the block to which that pass's own index
permutation maps j mod blocks; no pass reads a block twice. Slots and blocks
meet by index. The last slot of a source takes only the first words of its
block, so that a source's words meet its target, rounded to a whole word.

Defined results: a null text has no words; a document without words, or a
source without any, is taken 0 times; a null source is a source of its own;
documents lie in their source by (bucket of the row's hash, doc_id, hash of the
row), so reruns agree; repeated rows are documents of their own; other columns
are carried only by ``mixed_documents``; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, in_order, materialise, packed, shuffle_partitions, table, unpacked

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 32
SHARD_SLOTS = 4096
SEED = 17
#: Documents that a bucket holds at least; of more documents, a bucket holds the square root of their number.
BUCKET_DOCS = 500
#: Slots that one row of the slot generator makes.
SLOT_CHUNK = 50_000


def permuted(i: Column, n: Column, *key: Column, rounds: int = 8, back: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1 at i, or its inverse: the swap-or-not shuffle."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        swap = F.xxhash64(r, F.greatest(x, partner), *key).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    order = range(rounds)[::-1] if back else range(rounds)
    return F.aggregate(F.array(*[F.lit(r).cast("long") for r in order]), i.cast("long"), step)


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_ix, source_size, target) for rows (source, size).

    Sources by code point, null last, take the weights in turn and share all
    words; a target stops at ``most`` times its source's words and what is over
    goes to the others by weight, in rounds, until none is above: every target
    is then min(cap, level * weight). A round is one sum over the sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = in_order(sources, [F.col("source").asc_nulls_last()], "source_size")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", cycle[(F.col("place") % len(weights)).cast("int")])
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") <= level * F.col("weight")
        sums = ranked.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("caps"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"), F.sum(over.cast("long")).alias("capped"),
        ).first()
        if not sums["free"] or sums["capped"] == capped:
            break
        capped, level = sums["capped"], (sums["words"] - sums["caps"]) / sums["free"]
    target = F.least("cap", F.lit(level) * F.col("weight"))
    return ranked.select("source", F.col("place").alias("source_ix"), "source_size", target.alias("target"))


def placed(sized: DataFrame, plan: DataFrame, n_docs: int) -> DataFrame:
    """Each document's first word in its source: ``start``; (source_ix, bucket, rank) names a row.

    Running sums in two steps, over documents in a bucket and over buckets in a
    source, so that no window holds the documents of a hot source.
    """
    n_buckets = n_docs // max(BUCKET_DOCS, math.isqrt(n_docs)) + 1
    keyed = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select(
        "doc_id", "row_hash", "size", "source_ix", "source_size", "target",
        F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(n_buckets)).alias("bucket"),
    )
    inside = Window.partitionBy("source_ix", "bucket").orderBy("doc_id", "row_hash")
    over = Window.partitionBy("source_ix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("source_ix", "bucket").agg(F.sum("size").alias("words"))
        .select("source_ix", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("offset"))
    )
    local = keyed.withColumn("rank", F.row_number().over(inside)).withColumn(
        "local", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    return local.join(offsets, ["source_ix", "bucket"]).withColumn("start", F.col("offset") + F.col("local")).drop("offset", "local")


def slots(plan: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(position, shard, source_ix, pass, block, most), one row for each block of the mix; it takes ``most`` words at most."""
    words = F.round("target").cast("long")
    # Spark may count before it filters, so a source without words has null blocks
    counted = plan.filter("source_size > 0").select(
        "source_ix", "source_size", "target", F.nullif(F.ceil(F.col("source_size") / block), F.lit(0).cast("long")).alias("blocks"),
        F.expr("cast(round(target) as long) div nullif(source_size, 0L)").alias("passes"),
    ).withColumn("rest", words - F.col("passes") * F.col("source_size"))
    # a source's last block may be short by some words; in the last pass it is read at this slot
    short = F.col("blocks") * block - F.col("source_size")
    key = (F.lit(seed), F.col("source_ix"), F.col("passes"))
    counted = counted.withColumn("short", short).withColumn("late", permuted(F.col("blocks") - 1, F.col("blocks"), *key, back=True))
    even = F.ceil(F.col("rest") / block)
    more = F.when(F.col("late") < even, F.ceil((F.col("rest") + F.col("short")) / block)).otherwise(even)
    numbered = in_order(counted.withColumn("slots", F.col("passes") * F.col("blocks") + more).filter("slots > 0"), [F.col("source_ix")], "slots")
    numbered = materialise(numbered.withColumnRenamed("before", "first").drop("place"))
    n = numbered.agg(F.sum("slots")).first()[0] or 0
    chunks = numbered.withColumn(
        "from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(SLOT_CHUNK).cast("long")))
    )
    spread = chunks.repartition(shuffle_partitions(plan.sparkSession), "source_ix", "from")
    each = spread.withColumn("j", F.explode(F.sequence("from", F.least(F.col("from") + SLOT_CHUNK, F.col("slots")) - 1)))
    each = each.withColumn("pass", F.expr("j div blocks"))
    position = permuted(F.col("first") + F.col("j"), F.lit(n).cast("long"), F.lit(seed))
    index = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source_ix"), F.col("pass"))
    place = F.col("j") % F.col("blocks")
    had = place * block - F.when(F.col("late") < place, F.col("short")).otherwise(0)
    limit = F.when(F.col("pass") == F.col("passes"), F.least(F.lit(block), F.col("rest") - had)).otherwise(block)
    return each.select(position.alias("position"), "source_ix", "pass", index.alias("block"), limit.cast("long").alias("most")).withColumn(
        "shard", F.expr(f"position div {shard_slots}")
    )


def shard_counts(mix: DataFrame) -> DataFrame:
    """The drawn counts: (shard, source_ix, n)."""
    return mix.groupBy("shard", "source_ix").agg(F.count(F.lit(1)).alias("n"))


def pieces(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The part of a document in each block that it reaches: (..., block, skip, words).

    ``skip`` words of the document come before. A document without words has
    one empty piece in block -1.
    """
    end = F.col("start") + F.col("size")
    reach = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    cut = docs.withColumn("block", F.explode(F.coalesce(reach, F.array(F.lit(-1).cast("long")))))
    first = F.greatest("start", F.col("block") * block)
    return cut.withColumn("skip", F.when(F.col("size") > 0, first - F.col("start")).otherwise(0)).withColumn(
        "words", F.when(F.col("size") > 0, F.least(end, (F.col("block") + 1) * block) - first).otherwise(0)
    )


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes and targets of rows (doc_id, source, text, ...), written once."""
    sized = materialise(
        docs.select("doc_id", "source", F.xxhash64(*docs.columns).alias("row_hash"), size_in_words(F.col("text")).alias("size"))
    )
    plan = materialise(targets(sized))
    return placed(sized, plan, sized.count()), plan


def _got(block: int = BLOCK_WORDS) -> Column:
    """Words of a piece among the first ``most`` of its block."""
    return F.greatest(F.lit(0), F.least(F.col("words"), F.col("most") - (F.col("start") + F.col("skip") - F.col("block") * block)))


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_position, first_shard, last_shard) for each row of ``docs``.

    The last three say where the draw put the row's words: the least position of
    its blocks in the mix, and the least and largest shard; null if none is taken.
    """
    where, plan = _prepared(docs)
    # at most one slot of a source takes only a part of its block
    part = F.col("most") < BLOCK_WORDS
    places = (F.min("position").alias("position"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    times = slots(plan).groupBy("source_ix", "block", F.when(part, F.col("most")).alias("most")).agg(F.count(F.lit(1)).alias("times"), *places)
    times = times.withColumn("most", F.coalesce("most", F.lit(BLOCK_WORDS).cast("long")))
    row = ["source_ix", "bucket", "rank", "doc_id", "size", "source_size", "target"]
    # the optimizer can't see how many slots a plan's few rows make, so it isn't to broadcast them
    met = pieces(where).join(times.hint("merge"), ["source_ix", "block"], "left").withColumn("got", F.coalesce(_got() * F.col("times"), F.lit(0)))
    some = F.col("got") > 0
    return (
        met.groupBy(*row)
        .agg(
            F.sum("got").alias("taken"), F.min(F.when(some, F.col("position"))).alias("first_position"),
            F.min(F.when(some, F.col("low"))).alias("first_shard"), F.max(F.when(some, F.col("high"))).alias("last_shard"),
        )
        .select("doc_id", "size", "source_size", "target", "taken", "first_position", "first_shard", "last_shard")
    )


def mixed_blocks(docs: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix itself: (position, shard, source, pass, block, n_words, text), a row for each slot.

    ``text`` is the words of the slot's block, a space apart, in the source's order.
    """
    need = ["doc_id", "source", "text"]
    docs = docs.select(*need)
    where, plan = _prepared(docs)
    drawn = slots(plan, shard_slots=shard_slots, seed=seed)
    parts = (
        pieces(where).filter("words > 0").groupBy("source_ix", "bucket", "rank", "doc_id", "row_hash")
        .agg(F.collect_list(F.struct("block", "skip", "words", (F.col("start") + F.col("skip")).alias("at"))).alias("parts"))
        .withColumnRenamed("doc_id", "_id")
    )
    texts = docs.withColumn("row_hash", F.xxhash64(*docs.columns)).dropDuplicates(["doc_id", "row_hash"])
    met = texts.join(parts, (texts["row_hash"] == parts["row_hash"]) & texts["doc_id"].eqNullSafe(parts["_id"]))
    # the words are a lambda's argument, so they are made once a text and not once a part
    cut = F.expr(
        rf"""transform(array(regexp_extract_all(text, '{WORD.replace(chr(92), chr(92) * 2)}', 0)),
              w -> transform(parts, p -> struct(p.block as block, p.at as at, p.words as words,
                slice(w, cast(p.skip as int) + 1, cast(p.words as int)) as part)))[0]"""
    )
    filled = (
        met.select("source", "source_ix", F.explode(cut).alias("p"))
        .groupBy("source", "source_ix", "p.block")
        .agg(F.sum("p.words").alias("n_words"), F.array_sort(F.collect_list(F.struct("p.at", "p.part"))).alias("has"))
        .select("source", "source_ix", "block", "n_words", F.flatten("has.part").alias("all"))
    )
    both = drawn.hint("merge").join(filled, ["source_ix", "block"]).withColumn("n_words", F.least("n_words", "most"))
    text = F.array_join(F.slice("all", F.lit(1), F.col("n_words").cast("int")), " ")
    return both.select("position", "shard", "source", "pass", "block", "n_words", text.alias("text"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: one for each document and pass that took words of it.

    Its text is what the pass took, in order; all of the text if it took all
    words. n_chars, where there is one, is that text's length. The rows of a
    partition, and so of a written file, come in the order of the draw: by the
    shard and position of the first slot that took words of them.
    """
    need = ["doc_id", "source", "text"] + ["n_chars"] * ("n_chars" in docs.columns)
    columns, docs = docs.columns, packed(docs, need)
    where, plan = _prepared(docs)
    row = ["source_ix", "bucket", "rank", "doc_id", "row_hash", "size"]
    took = (
        pieces(where).join(slots(plan).select("source_ix", "pass", "block", "most", "shard", "position").hint("merge"), ["source_ix", "block"])
        .withColumn("got", _got()).filter("got > 0")
        .groupBy(*row, "pass")
        .agg(F.array_sort(F.collect_list(F.struct("skip", F.col("got").alias("words")))).alias("parts"), F.sum("got").alias("got"), F.min(F.struct("shard", "position")).alias("_drawn"))
        .select("doc_id", "row_hash", "size", "parts", "got", "_drawn")
        .withColumnRenamed("doc_id", "_id")
    )
    # equal rows are one row here and meet each of their places in the mix
    texts = docs.withColumn("row_hash", F.xxhash64(*docs.columns)).dropDuplicates(["doc_id", "row_hash"])
    met = texts.join(took, (texts["row_hash"] == took["row_hash"]) & texts["doc_id"].eqNullSafe(took["_id"])).drop(
        texts["row_hash"]
    )
    # the words are a lambda's argument, so they are made once a text and not once a part
    some = F.expr(
        rf"""transform(array(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*{WORD.replace(chr(92), chr(92) * 2)}', 0)),
              w -> ltrim(array_join(flatten(transform(parts, p -> slice(w, cast(p.skip as int) + 1, cast(p.words as int)))), '')))[0]"""
    )
    met = met.withColumn("text", F.when(F.col("got") == F.col("size"), F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return unpacked(met.sortWithinPartitions("_drawn"), columns, need)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
