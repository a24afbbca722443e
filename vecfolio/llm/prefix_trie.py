"""The trie of conversations' prefixes.

The digest of a prefix is the SHA-256 of the digest before it and of its last
turn's content, so equal prefixes have equal digests. Every prefix of every
conversation is a row; rows of one (depth, digest) are a node.

A node's owner is its least member. All nodes that a conversation owns lie
under each other, at the end of its path: a chain. From then on a node is named
by owner and depth. Sums over a subtree are those of its own chain from there
on, a running sum, and those of the chains that hang from it: each chain's
total goes to every ancestor chain once, at the depth where the path leaves it.
So the exploded rows are as many as the turns, not their squares.

Hot nodes: fewer than ``HOT`` nodes have over one in so many of all prefixes;
those, and no others, are sent to the prefixes instead of being met in a
shuffle. Members that end at a node are written out by blocks of conv_ids
before they meet in one task, whose hash reads them as a stream.

Defined results: turns are in the order of (turn, role, text), nulls first; a
null role or text counts as empty; repeated rows are turns of their own; rows
without a conv_id belong to no conversation; other columns are ignored; no
conversations give no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, crc_mod, materialise, table

#: A node with more than one in so many of all prefixes is hot.
HOT = 2000
#: conv_ids whose text is made together, as a power of two.
ID_BITS = 12


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, ix, content, words) of rows (conv_id, turn, role, text): ix from 1 in order, content a digest of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    content = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    return rows.select("conv_id", F.row_number().over(order).alias("ix"), content.alias("content"), words.alias("words"))


def opened(items: DataFrame, convs: DataFrame) -> DataFrame:
    """``items`` (conv_id, ix, content, words) and a row of ix 0 for each of ``convs``, turnless ones too."""
    none = convs.select("conv_id", F.lit(0).alias("ix"), F.lit(None).cast("binary").alias("content"), F.lit(0).cast("long").alias("words"))
    return none.unionByName(items)


_PREFIX = "conv_id long, depth int, node binary, words long, last boolean"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of conversations that come one after the other, each by ix; one row is held back to see if it is the last."""
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_())
    names = [c.split()[0] for c in _PREFIX.split(", ")]
    held: list = []
    depth, digest = 0, b""
    for batch in batches:
        rows: list = []
        for conv, ix, content, words in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if held:
                rows.append((*held, ix == 0))
            depth, digest = (0, hashlib.sha256().digest()) if ix == 0 else (depth + 1, hashlib.sha256(digest + content).digest())
            held = [conv, depth, digest, words]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*held, True), kinds)], names)


def prefixes(items: DataFrame) -> DataFrame:
    """(conv_id, depth, node, words, last) of rows as ``opened`` gives; words are those of the last turn."""
    rows = items.select("conv_id", "ix", "content", "words").repartition("conv_id").sortWithinPartitions("conv_id", "ix")
    return rows.mapInArrow(_chained, _PREFIX)


def with_owners(found: DataFrame) -> DataFrame:
    """(conv_id, depth, words, last, owner, n_convs) of ``prefixes``, which must be a written table."""
    key = ["depth", "node"]
    nodes = materialise(found.groupBy(*key).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")))
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    hot = F.col("n_convs") * HOT > total
    # fewer than HOT rows: their counts sum to the total at most
    met = found.join(F.broadcast(nodes.filter(hot)), key)
    rest = found.join(F.broadcast(nodes.filter(hot).select(*key)), key, "left_anti").join(nodes.filter(~hot), key)
    return met.unionByName(rest).drop("node")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's texts, which come one after the other, joined by commas."""
    key, digest = None, None

    def out():
        columns = zip((*key, digest.hexdigest()), (pa.int64(), pa.int32(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in columns], ["owner", "depth", "ends_sha256"])

    for batch in batches:
        for owner, depth, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if (owner, depth) == key:
                digest.update(b",")
            else:
                if key:
                    yield out()
                key, digest = (owner, depth), hashlib.sha256()
            digest.update(text.encode())
    if key:
        yield out()


def ends(owned: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of the nodes at which members end."""
    ids = F.expr("array_join(transform(array_sort(collect_list(conv_id)), x -> cast(x as string)), ',')")
    block = owned.filter("last").groupBy("owner", "depth", F.shiftright("conv_id", ID_BITS).alias("block")).agg(ids.alias("ids"))
    rows = block.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block")
    return rows.select("owner", "depth", "ids").mapInArrow(_hashed, "owner long, depth int, ends_sha256 string")


def trie(items: DataFrame) -> DataFrame:
    """One row a node, of rows (conv_id, ix, content, words) with a row of ix 0 for each conversation.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256); conv_id is the owner.
    """
    owned = materialise(with_owners(materialise(prefixes(items))))
    saved = F.sum(F.col("words") * (F.col("n_convs") - 1)).alias("saved")
    parts = materialise(owned.groupBy("conv_id", "owner").agg(F.min("depth").alias("first"), F.max("depth").alias("depth"), saved))
    chains = parts.filter("conv_id = owner").select("conv_id", "first", F.col("depth").alias("end"), "saved")
    # where each chain's path leaves the chains before it; copies of a conversation own no chain
    left = parts.filter("conv_id <> owner").select("conv_id", "owner", "depth").join(chains.select("conv_id", "first"), "conv_id")
    left = left.select("conv_id", "owner", "depth", (F.col("depth") == F.col("first") - 1).alias("direct"))
    hung = left.filter("direct").groupBy("owner", "depth").agg(F.count(F.lit(1)).alias("n"))
    met = chains.join(hung.select(F.col("owner").alias("conv_id"), F.col("depth").alias("end"), "n"), ["conv_id", "end"], "left")
    parents = left.filter("direct").select("conv_id", F.col("owner").alias("above"))
    chains = materialise(met.withColumn("leaf", F.col("n").isNull().cast("long")).drop("n").join(parents, "conv_id", "left"))
    hanging = (
        left.join(chains.select("conv_id", "saved", "leaf"), "conv_id").groupBy("owner", "depth")
        .agg(F.sum("saved").alias("hung_saved"), F.sum("leaf").alias("hung_leaves"), F.sum(F.col("direct").cast("long")).alias("hung"))
    )
    nodes = owned.filter("conv_id = owner").select("owner", "depth", "n_convs", (F.col("words") * (F.col("n_convs") - 1)).alias("own"))
    nodes = nodes.join(hanging, ["owner", "depth"], "left").join(ends(owned), ["owner", "depth"], "left").withColumnRenamed("owner", "conv_id")
    nodes = nodes.join(chains.drop("saved"), "conv_id")
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)

    def held(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0).cast("long"))

    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs", (held("hung") + (F.col("depth") < F.col("end")).cast("long")).alias("n_children"),
        (F.sum(held("hung_leaves")).over(below) + F.col("leaf")).alias("n_leaves"),
        F.sum(F.col("own") + held("hung_saved")).over(below).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """``trie`` of rows (conv_id, turn, role, text)."""
    items = materialise(numbered_turns(turns))
    return trie(opened(items, items.filter("ix = 1")))


#: Conversations that borrow from one, and the first turns they may borrow.
FAMILY, BORROWED = 20, 4


def rebuilt(items: DataFrame) -> DataFrame:
    """``numbered_turns`` with each conversation's first turns replaced by those of its family's first conversation, opened.

    Conversation c of hash h = crc32(c) modulo ``BORROWED`` takes the first h
    turns of c - c % ``FAMILY`` (none if that is absent) for its own.
    """
    convs = items.filter("ix = 1").select("conv_id", crc_mod("conv_id", BORROWED).alias("h"))
    heads = items.filter((F.col("conv_id") % FAMILY == 0) & (F.col("ix") < BORROWED)).withColumnRenamed("conv_id", "base")
    taken = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base").filter("ix <= h")
    kept = items.filter(F.col("ix") > crc_mod("conv_id", BORROWED))
    columns = ["conv_id", "ix", "content", "words"]
    return opened(taken.select(*columns).unionByName(kept.select(*columns)), convs)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(materialise(numbered_turns(turns))))


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of ASCII text, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295, {steps}), {fold}), 4294967295)"


OP12_SQL = rf"""
WITH own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ix FROM
    (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, {crc32_sql('CAST(conv_id AS VARCHAR)')} % {BORROWED} AS h FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
  SELECT c.conv_id, ix, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % {FAMILY} AND ix <= h
  UNION ALL SELECT conv_id, ix, role, text FROM convs JOIN own USING (conv_id) WHERE ix > h
), whole AS (
  SELECT conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY ix) FILTER (ix IS NOT NULL), []) AS s FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id
), prefix AS (
  SELECT conv_id, depth, s[1:depth] AS p, depth = len(s) AS last FROM (SELECT *, unnest(range(len(s) + 1)) AS depth FROM whole)
), node AS (
  SELECT p, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM prefix GROUP BY p
), children AS (
  SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(p[depth].t, '{WORD}')) ELSE 0 END AS saved FROM node n LEFT JOIN children USING (p)
), subtree AS (
  SELECT p[1:a] AS p, CAST(sum(CAST(n_children = 0 AS INT)) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM
    (SELECT *, unnest(range(depth + 1)) AS a FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.depth, q.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN subtree s ON s.p = c.p LEFT JOIN node q ON c.depth > 0 AND q.p = c.p[1:c.depth - 1]
"""
