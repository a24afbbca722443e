"""An inverted file over a table of vectors.

Centres are fitted by spherical k-means rounds on Spark, on a sample of at most
``PER_LIST`` rows a list; every row then goes to the list of its nearest centre.
A list is a partition of the table, in files of about ``FILE_ROWS`` rows, so a
list that holds a third of all rows is read by many tasks. A search ranks the
centres by their inner product with the query and reads the lists of the first
``probes`` only: for few queries their lists are a filter on the partition
column, so the scan never opens the others. Rows of read lists are scored
exactly. With all lists probed a search is exact.

Layout: ``lists`` (list=, part, id, unit), ``centres`` (list, n, centre). At
most ``MOST_LISTS`` lists, so centres are of bounded size wherever they are sent.

Defined results: vectors without a direction (null, zero, a null or non-finite
component) aren't in the index and find nothing; a query's own id is not among
its finds; ties go to the smaller id; repeated rows are found each; no rows
give an index without lists, in which nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import with_unit
from ..scratch import written
from .blocks import vector_sum

MOST_LISTS, PER_LIST, FILE_ROWS = 4096, 256, 65_536
ROUNDS = 8
#: Queries that meet a part of a list at once.
TOGETHER = 4096
#: Queries on which ``probes_for`` measures.
MEASURED = 128


def unit_rows(rows: DataFrame) -> DataFrame:
    """(id, unit) of rows (id, vector) that have a direction."""
    return with_unit(rows, "vector", "unit").select(F.col("id").cast("long").alias("id"), "unit").filter("unit is not null")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` (id, unit) with ``list``, the number of the nearest centre, the first of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column(1))
            near = [np.argmax(unit[at : at + 4096] @ centres.T, axis=1) for at in range(0, len(unit), 4096)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(near), pa.int32())], ["id", "unit", "list"])

    return rows.select("id", "unit").mapInArrow(run, "id long, unit array<double>, list int")


def fitted(rows: DataFrame, n_lists: int, n_rows: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``rows`` (id, unit), by rounds over a sample of ``PER_LIST`` rows a list; a list that gets none keeps its centre.

    The sample and the first centres are those of the smallest hashes of their ids.
    """
    share = min(1.0, 1.2 * PER_LIST * n_lists / max(n_rows, 1))
    order = F.xxhash64("id", F.lit(7))
    sample = rows.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else rows
    sample = written(sample)
    first = sample.orderBy(order, "id").limit(n_lists).select("unit").collect()  # at most MOST_LISTS rows
    centres = np.array([r["unit"] for r in first])
    for _ in range(rounds):
        sums = assigned(sample, centres).groupBy("list").agg(vector_sum("unit").alias("total"))
        moved = centres.copy()
        for r in sums.collect():  # a row a list
            total = np.array(r["total"])
            length = np.linalg.norm(total)
            if length > 0:
                moved[r["list"]] = total / length
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def build(rows: DataFrame, path: str, n_lists: int | None = None) -> None:
    """Write the index of ``rows`` (id, vector) at ``path``; lists by default twice the square root of the rows."""
    spark = rows.sparkSession
    unit = written(unit_rows(rows))
    n = unit.count()
    n_lists = max(1, min(n_lists or ceil(2 * sqrt(n)), MOST_LISTS, n))
    centres = fitted(unit, n_lists, n) if n else np.zeros((0, 1))
    placed = written(assigned(unit, centres) if n else unit.withColumn("list", F.lit(0)))
    sizes = written(placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")))
    parts = F.ceil(F.col("n") / FILE_ROWS)
    # a row a list
    dealt = placed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    dealt.select("list", "part", "id", "unit").repartition("list", "part").sortWithinPartitions("list", "part").write.partitionBy("list").parquet(f"{path}/lists")
    made = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    made.join(sizes, "list").select("list", "n", "centre").coalesce(1).write.parquet(f"{path}/centres")


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # at most MOST_LISTS
    return np.array([r["list"] for r in rows], np.int32), np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 1))


def _ranked(queries: DataFrame, names: np.ndarray, centres: np.ndarray, probes: int) -> DataFrame:
    """(id, unit, list) of queries (id, unit): the lists to read for each."""
    probes = min(probes, len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _matrix(batch.column(1)) @ centres.T
            order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(batch.num_rows), probes))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(names[order].ravel(), pa.int32())], ["id", "unit", "list"])

    return queries.select("id", "unit").mapInArrow(run, "id long, unit array<double>, list int")


def _met(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): of each part of a list its ``k`` rows nearest to each query that reads it."""
    parts = rows.select("list", "part").distinct()
    groups = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("groups"))
    group = F.pmod(F.xxhash64("id", F.lit(3)), F.col("groups")).cast("int")
    queries = asked.join(groups, "list").withColumn("group", group).join(parts, "list").select("list", "part", "group", "id", "unit", F.lit(True).alias("query"))
    held = rows.join(groups, "list").withColumn("group", F.explode(F.sequence(F.lit(0), (F.col("groups") - 1).cast("int"))))
    both = held.select("list", "part", "group", "id", "unit", F.lit(False).alias("query")).unionByName(queries)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t.column("query").to_numpy()
        ids, unit = t.column("id").to_numpy(), _matrix(t.column("unit").chunk(0))
        mine, theirs = np.flatnonzero(~asks), np.flatnonzero(asks)
        mine = mine[np.argsort(ids[mine], kind="stable")]
        out: list[list] = [[], [], []]
        for at in range(0, len(theirs) if len(mine) else 0, 256):
            some = theirs[at : at + 256]
            score = unit[some] @ unit[mine].T
            score[ids[some][:, None] == ids[mine][None, :]] = -np.inf
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(score, order, axis=1)
            good = best > -np.inf
            out[0].append(np.repeat(ids[some], order.shape[1])[good.ravel()])
            out[1].append(ids[mine][order][good])
            out[2].append(best[good])
        columns = [np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(out, (np.int64, np.int64, float))]
        return pa.table([pa.array(c) for c in columns], ["query_id", "id", "score"])

    return both.groupBy("list", "part", "group").applyInArrow(run, "query_id long, id long, score double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, probes: int | None = None) -> DataFrame:
    """(query_id, rank, id, score) of each query's ``k`` nearest by cosine; ``queries`` are (id, vector).

    ``probes`` lists are read for each query, all of them (an exact search) by default.
    """
    names, centres = _centres(spark, path)
    rows = spark.read.schema("part int, id long, unit array<double>, list int").parquet(f"{path}/lists")
    asked = written(_ranked(unit_rows(queries), names, centres, probes or len(names))) if len(names) else unit_rows(queries).limit(0).withColumn("list", F.lit(0))
    if probes and probes < len(names):
        wanted = [r["list"] for r in asked.select("list").distinct().collect()]  # at most MOST_LISTS
        rows = rows.filter(F.col("list").isin(wanted))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = _met(rows, asked, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "id", "score")


def probes_for(spark: SparkSession, path: str, recall: float = 0.95, k: int = 20) -> int:
    """How many lists a search must read to find that share of the ``k`` nearest, measured exactly on ``MEASURED`` indexed rows as queries."""
    names, centres = _centres(spark, path)
    rows = spark.read.parquet(f"{path}/lists")
    sample = written(rows.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(MEASURED).select("id", F.col("unit").alias("vector")))
    true = search(spark, path, sample, k).select(F.col("query_id"), "id")
    lists = true.join(rows.select("id", "list"), "id").select("query_id", "list").collect()  # MEASURED times k rows
    units = {r["id"]: np.array(r["vector"]) for r in sample.collect()}
    place = {int(name): i for i, name in enumerate(names)}
    at = [int(np.flatnonzero(np.argsort(-(centres @ units[r["query_id"]]), kind="stable") == place[r["list"]])[0]) for r in lists]
    if not at:
        return max(len(names), 1)
    return int(np.sort(at)[min(len(at) - 1, ceil(recall * len(at)) - 1)]) + 1
