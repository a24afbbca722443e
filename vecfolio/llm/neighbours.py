"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled by the largest norm and get one more component that makes
all norms 1, so that the largest inner product is the smallest distance. Each
of ``TABLES`` tables hashes them by floors of Gaussian projections that are
made orthogonal. A bucket is the cheaper for a query, the nearer the borders
are over which its cells lie: the squared distances to them, summed over the
hashes, put buckets in the order in which they are likely to hold near vectors.
A query visits all buckets up to a cost. That cost is fitted on the neighbours,
found by brute force among all vectors, of a bounded sample of queries, so that
``RECALL`` of them are met; every vector is in the index, and nothing limits
how many buckets that takes. Candidates of all tables are merged; only their
inner products are made, in double precision.

The first hashes name the cell of about ``CELL`` vectors that a vector is sent
to; a query goes to the cells up to the cost, enumerated by perturbing its own.
Inside a cell the other hashes part the buckets. A cell beyond its size, as by a
very common vector, is cut by id, and so are a cell's queries. Each piece
returns its best k for each query, so nothing is dropped. A query that met
fewer than k candidates is compared with all vectors.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component, of another length than most, or of null id take no part
(as query or candidate); of rows with one id the smallest vector counts; ties go
to the smaller id; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

TABLES, HASHES = 2, 24
WIDTH = 2.0
CELL = 16_384
#: Queries that meet a cell at once.
TOGETHER = 256
#: Queries that the cost is fitted on, and the share of their neighbours to find.
SAMPLE_QUERIES, RECALL = 128, 0.96
SLACK = 8


@dataclass
class Hashing:
    """Projections of the tables, how many hashes name a cell, and the cost up to which buckets are visited."""

    scale: float
    directions: np.ndarray  # table, hash, component
    offsets: np.ndarray  # table, hash
    mixers: np.ndarray  # hash
    prefix: int
    most: float = np.inf

    def raised(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Vectors scaled, with the component that makes candidates' norms 1."""
        v = v / self.scale
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, 1 - (v * v).sum(axis=1)))
        return np.column_stack([v, extra])

    def places(self, v: np.ndarray, query: bool) -> np.ndarray:
        """(table, row, hash): projections in units of the cell width."""
        return (np.einsum("thd,nd->tnh", self.directions, self.raised(v, query)) + self.offsets[:, None, :]) / WIDTH

    def names(self, codes: np.ndarray) -> np.ndarray:
        """One number for each row of a cell's codes."""
        with np.errstate(over="ignore"):
            mixed = (codes.astype(np.int64).view(np.uint64) * self.mixers[: self.prefix]).sum(axis=-1, dtype=np.uint64)
            return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)

    def visits(self, place: np.ndarray) -> np.ndarray:
        """Names of the cells that a query visits in a table: all up to the cost, the cheapest first."""
        place = place[: self.prefix]
        base = np.floor(place)
        codes, heap = [], [(0.0, 0, ())]
        # each hash's moves by their cost: a step to either side, and further ones
        moves = []
        for x in place - base:
            reach = int(np.sqrt(self.most)) + 2 if np.isfinite(self.most) else 1
            steps = [((k - x) ** 2, k) for k in range(1, reach + 1)] + [((x + k - 1) ** 2, -k) for k in range(1, reach + 1)]
            moves.append(sorted(steps))
        while heap:
            cost, first, chosen = heapq.heappop(heap)
            code = base.copy()
            for h, m in chosen:
                code[h] += moves[h][m][1]
            codes.append(code)
            # each set of moves comes once: a move of a later hash is added, or the last one made larger
            if chosen:
                h, m = chosen[-1]
                if m + 1 < len(moves[h]):
                    heapq.heappush(heap, (cost - moves[h][m][0] + moves[h][m + 1][0], first, (*chosen[:-1], (h, m + 1))))
            for h in range(first, len(moves)):
                heapq.heappush(heap, (cost + moves[h][0][0], h + 1, (*chosen, (h, 0))))
            if heap and heap[0][0] > self.most:
                break
        return self.names(np.array(codes).reshape(len(codes), self.prefix))

    def costs(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(query, row): what the rows' buckets cost a query, by the query's places and the rows' codes."""
        low, n = int(codes.min()), int(codes.max() - codes.min()) + 1
        cells = np.arange(low, low + n)
        away = np.maximum(0, np.maximum(cells - queries[:, :, None], queries[:, :, None] - cells - 1)) ** 2
        member = np.zeros((codes.shape[1] * n, len(codes)), np.float32)
        for h in range(codes.shape[1]):
            member[h * n + codes[:, h].astype(int) - low, np.arange(len(codes))] = 1
        return away.reshape(len(queries), -1).astype(np.float32) @ member


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows (vec_id, embedding) that take part."""
    good = (
        F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    kept = vectors.filter(F.coalesce(good, F.lit(False))).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = materialise(kept.groupBy("vec_id").agg(F.min("v").alias("v")))
    lengths = one.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return one.filter(F.size("v") == (lengths["n"] if lengths else 0))


def brute_force(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, v): for some queries, the k nearest of all vectors; a bounded number a task and query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, names = np.stack(part.column(1).to_numpy(zero_copy_only=False)), part.column(0).to_numpy()
                score = queries @ x.T
                score[ids[:, None] == names[None, :]] = -np.inf
                at_best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                new = (np.take_along_axis(score, at_best, 1), names[at_best], x[at_best])
                if best is not None:
                    new = tuple(np.concatenate([a, b], axis=1) for a, b in zip(best, new))
                    order = np.argsort(-new[0], axis=1, kind="stable")[:, :k]
                    new = (np.take_along_axis(new[0], order, 1), np.take_along_axis(new[1], order, 1), np.take_along_axis(new[2], order[:, :, None], 1))
                best = new
        if best is not None:
            i, j = np.nonzero(best[0] > -np.inf)
            columns = [pa.array(ids[i]), pa.array(best[1][i, j]), pa.array(best[0][i, j]), pa.array(list(best[2][i, j]), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "v"])

    found = vectors.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double, v array<double>")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fit(vectors: DataFrame, k: int, seed: int = 11) -> Hashing | None:
    """Hashing for rows (vec_id, v); the cost is fitted on the neighbours of ``SAMPLE_QUERIES`` rows, those of the least id hashes."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m"), F.max(F.size("v")).alias("d")).first()
    if not stats["n"]:
        return None
    n, d = stats["n"], stats["d"] + 1
    hashes = min(HASHES, d)
    random = np.random.default_rng(seed)
    # orthogonal directions of the length that Gaussian ones have
    directions = np.stack([np.linalg.qr(random.normal(size=(d, d)))[0][:hashes] * np.sqrt(d) for _ in range(TABLES)])
    hashing = Hashing(
        float(np.sqrt(stats["m"])),
        directions,
        random.uniform(0, WIDTH, (TABLES, hashes)),
        random.integers(1, 2**63, hashes).astype(np.uint64) * np.uint64(2) + np.uint64(1),
        # a hash parts the vectors about as 1.2 bits do
        prefix=min(hashes, max(0, round(np.log2(max(n / CELL, 1)) / 1.2))),
    )
    asked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).collect()
    ids, queries = np.array([r["vec_id"] for r in asked]), np.array([r["v"] for r in asked])
    near = brute_force(vectors, ids, queries, k).select("query_id", "v").collect()  # k rows a query
    if not near:
        return hashing
    row = {i: at for at, i in enumerate(ids.tolist())}
    places = hashing.places(queries, True)[:, [row[r["query_id"]] for r in near]]
    codes = np.floor(hashing.places(np.array([r["v"] for r in near]), False))
    cost = (np.maximum(0, np.maximum(codes - places, places - codes - 1)) ** 2).sum(axis=2).min(axis=0)
    return replace(hashing, most=float(np.quantile(cost, RECALL)) + 1e-6)


def _entries(vectors: DataFrame, hashing: Hashing, query: bool) -> DataFrame:
    """Rows (tab, cell, vec_id, query, v) of the index, or of the cells that queries visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                places = hashing.places(np.stack(part.column(1).to_numpy(zero_copy_only=False)), query)

                def rows():
                    for t in range(TABLES):
                        if query:
                            yield from ((t, c, i) for i in range(part.num_rows) for c in hashing.visits(places[t, i]).tolist())
                        else:
                            names = hashing.names(np.floor(places[t, :, : hashing.prefix])).tolist()
                            yield from ((t, c, i) for i, c in enumerate(names))

                left = rows()
                while some := list(islice(left, 8192)):
                    t, c, i = zip(*some)
                    at = pa.array(i, pa.int64())
                    columns = [pa.array(t, pa.int32()), pa.array(c, pa.int64()), part.column(0).take(at), part.column(1).take(at)]
                    yield pa.RecordBatch.from_arrays(columns, ["tab", "cell", "vec_id", "v"])

    entries = vectors.select("vec_id", "v").mapInArrow(run, "tab int, cell long, vec_id long, v array<double>")
    return entries.withColumn("query", F.lit(query))


def candidates(hashing: Hashing, tab: int, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(query, row): whether a query visits the row's bucket."""
    if not np.isfinite(hashing.most):
        return np.ones((len(q), len(codes)), bool)
    return hashing.costs(hashing.places(q, True)[tab], codes) <= hashing.most


def best_of(queries: tuple, vectors: tuple, met: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of the best k candidates of each query; each side is (ids, matrix), ``met`` marks candidates.

    Only candidates' inner products are made.
    """
    q_ids, q = queries
    x_ids, x = vectors
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in range(len(q_ids)):
        j = np.flatnonzero(met[i])
        j = j[x_ids[j] != q_ids[i]]
        if not len(j):
            continue
        some = x[j]
        rough = some @ q[i]
        if len(j) > k:
            # ties in exact scores may differ in the last bits here, so all near the edge stay
            edge = -np.partition(-rough, k - 1)[k - 1]
            near = rough >= edge - 1e-9 * (1 + abs(edge))
            j, some = j[near], some[near]
        score = (q[i] * some).sum(axis=1)
        order = np.lexsort((x_ids[j], -score))[:k]
        out.append((np.full(len(order), q_ids[i]), x_ids[j[order]], score[order]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _search(index: DataFrame, queries: DataFrame, hashing: Hashing, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each piece of a cell for each query that visits it."""
    key = ["tab", "cell"]
    both = materialise(index.unionByName(queries).select(*key, "vec_id", "query", "v"))
    sizes = both.groupBy(*key).agg(
        F.sum(F.when(~F.col("query"), 1).otherwise(0)).alias("nx"), F.sum(F.when(F.col("query"), 1).otherwise(0)).alias("nq")
    )
    sizes = sizes.filter("nx > 0 and nq > 0").select(
        *key, F.ceil(F.col("nx") / CELL).cast("int").alias("parts"), F.ceil(F.col("nq") / CELL).cast("int").alias("slices")
    )
    cut = both.join(sizes, key)
    own = F.pmod(F.xxhash64("vec_id"), F.when(F.col("query"), F.col("slices")).otherwise(F.col("parts"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("query"), F.col("parts")).otherwise(F.col("slices")) - 1)
    cut = cut.withColumn("own", own).withColumn("other", F.explode(others))
    part = F.when(F.col("query"), F.col("other")).otherwise(F.col("own"))
    slice_ = F.when(F.col("query"), F.col("own")).otherwise(F.col("other"))
    cut = cut.select(*key, part.alias("part"), slice_.alias("slice"), "vec_id", "query", "v")

    def run(t: pa.Table) -> pa.Table:
        query = t.column("query").to_numpy()
        tab = t.column("tab")[0].as_py()

        def side(mask):
            s = t.filter(pa.array(mask)).combine_chunks()
            return s.column("vec_id").to_numpy(), np.stack(s.column("v").to_numpy()) if s.num_rows else np.zeros((0, 1))

        q, x = side(query), side(~query)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        codes = np.floor(hashing.places(x[1], False)[tab]) if len(x[0]) else None
        for at in range(0, len(q[0]) if len(x[0]) else 0, TOGETHER):
            some = tuple(c[at : at + TOGETHER] for c in q)
            found.append(best_of(some, x, candidates(hashing, tab, some[1], codes), k))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "score"])

    # dealt by pieces; else those of one cell would stay in one task
    piece = [*key, "part", "slice"]
    return cut.repartition(*piece).groupBy(*piece).applyInArrow(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest in ``vectors``.

    Both are (vec_id, v) as ``usable`` returns; a row with the query's own id is no candidate.
    """
    spark = vectors.sparkSession
    hashing = fit(vectors, k)
    if hashing is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if np.isfinite(hashing.most):
        found = materialise(_ranked(_search(_entries(vectors, hashing, False), _entries(queries, hashing, True), hashing, k), k))
    else:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    n = vectors.count()
    full = found.filter(F.col("rank") == F.lit(min(k, n - 1))).select(F.col("query_id").alias("vec_id"))
    short = materialise(queries.join(full, "vec_id", "left_anti"))
    # those go to every piece of the vectors
    pieces = n // CELL + 1
    first = F.lit(0).alias("tab")
    index = vectors.select(first, F.pmod(F.xxhash64("vec_id"), F.lit(pieces)).alias("cell"), "vec_id", "v", F.lit(False).alias("query"))
    asked = short.select(first, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("cell"), "vec_id", "v", F.lit(True).alias("query"))
    again = _search(index if short.take(1) else index.limit(0), asked, replace(hashing, most=np.inf), k)
    return _ranked(found.select("query_id", "vec_id", "score").unionByName(again), k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)
