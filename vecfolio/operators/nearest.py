"""Each profile's nearest in a whole catalogue, by blocks that bounds keep apart.

Profiles are dealt to blocks of like global vectors. A block's three vectors
(global, both clusters) lie in balls about a centre, by angle. The blend of two
profiles is at most a quarter of the greatest cosine that their blocks' global
balls allow and three quarters of the greatest that any of the four pairs of
cluster balls allows, as weights sum to 1. First every block is compared with
itself; then each with the ``FIRST`` most promising others; then with all others
whose bound isn't below the worst best so far of its profiles. Only profiles
whose own best isn't above the bound take part in a pair. So the result is that
of all pairs, whatever the bounds save; ``report`` counts what they saved.

Blocks have about ``BLOCK`` profiles, or more where that would make more than
``MOST_BLOCKS``, so a row a block is of bounded size wherever it is sent. A block
is one row of a table, its vectors as bytes; pairs of blocks are the product of
that table with itself, whose tasks read two partitions each. So disk grows with
the profiles, and only time with their square.

Defined results: profiles are pivoted rows with a unique ``ordinal``, which
leaves a profile out of its own search; ties go to the smaller ordinal; a
profile that is alone has no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from .catalogue import CLUSTER_WEIGHT, GLOBAL_WEIGHT
from .vector_index import assigned, fitted

BLOCK, MOST_BLOCKS, FIRST = 1024, 4096, 4
#: Bounds are that much higher, for rounding.
SLACK = 1e-9
_VECTORS = ("g", "c1", "c2")
_BEST = "ordinal long, nearest long, similarity double"
_BLOCKS = "block int, ids array<long>, rows binary, centres array<double>, radii array<double>, seen array<long>, nearest array<long>, similarity array<double>"
#: Rows of a block that are compared at once, and pairs of blocks that come to a task at once.
TILE, PAIRS = 128, 2


@dataclass
class Report:
    """Ordered pairs of different blocks, how many were compared, and the products of profiles made in all."""

    blocks: int = 0
    pairs: int = 0
    compared: int = 0

    @property
    def skipped(self) -> float:
        return 1 - self.compared / self.pairs if self.pairs else 0.0


def _sides(t: pa.Table) -> dict:
    """The profiles of a table as matrices, by ordinal."""
    order = np.argsort(t.column("ordinal").to_numpy(), kind="stable")
    part = {n: np.stack(t.column(n).to_numpy()[order]) for n in _VECTORS}
    return part | {"w": np.column_stack([t.column(n).to_numpy()[order] for n in ("w1", "w2")]), "id": t.column("ordinal").to_numpy()[order]}


def _packed(side: dict) -> bytes:
    return np.hstack([*(side[n] for n in _VECTORS), side["w"]]).tobytes()


def _unpacked(ids: np.ndarray, rows: pa.Scalar) -> dict:
    every = np.frombuffer(rows.as_buffer(), float).reshape(len(ids), -1)
    d = (every.shape[1] - 2) // len(_VECTORS)
    part = {n: np.ascontiguousarray(every[:, k * d : (k + 1) * d]) for k, n in enumerate(_VECTORS)}
    return part | {"w": every[:, -2:], "id": ids}


def _some(side: dict, rows: np.ndarray | slice) -> dict:
    return {k: v[rows] for k, v in side.items()}


class _Room:
    """Memory for matrices of scores, which the next ones use again."""

    def __init__(self):
        self.held = np.empty(0)

    def parts(self, k: int, n: int, m: int) -> np.ndarray:
        if self.held.size < k * n * m:
            self.held = np.empty(k * n * m)
        return self.held[: k * n * m].reshape(k, n, m)


def _scores(a: dict, b: dict, whole_only: bool, room: _Room) -> np.ndarray:
    score, s11, s12, s21, s22, left, more = room.parts(7, len(a["id"]), len(b["id"]))
    np.matmul(a["g"], b["g"].T, out=score)
    if whole_only:
        return score
    for x, y, s in (("c1", "c1", s11), ("c1", "c2", s12), ("c2", "c1", s21), ("c2", "c2", s22)):
        np.matmul(a[x], b[y].T, out=s)
    np.maximum(s11, s12, out=left)
    left *= a["w"][:, 0, None]
    np.maximum(s21, s22, out=more)
    more *= a["w"][:, 1, None]
    left += more
    right, more = np.maximum(s11, s21, out=s11), np.maximum(s12, s22, out=s12)
    right *= b["w"][:, 0]
    more *= b["w"][:, 1]
    right += more
    left += right
    left *= CLUSTER_WEIGHT * 0.5
    score *= GLOBAL_WEIGHT
    score += left
    return score


def _best(a: dict, b: dict, whole_only: bool) -> tuple[np.ndarray, ...]:
    """(ordinal, nearest, similarity) of the rows of ``a`` among those of ``b``."""
    b = _some(b, np.argsort(b["id"], kind="stable"))
    found, room = [], _Room()
    for at in range(0, len(a["id"]), TILE):
        some = _some(a, slice(at, at + TILE))
        score = _scores(some, b, whole_only, room)
        score[some["id"][:, None] == b["id"][None, :]] = -np.inf
        near = np.argmax(score, axis=1)
        value = score[np.arange(len(near)), near]
        seen = value > -np.inf
        found.append((some["id"][seen], b["id"][near][seen], value[seen]))
    return tuple(np.concatenate(c) for c in zip(*found))


@dataclass
class _Tops:
    """The best so far of a block's profiles, in the order of their ids."""

    ids: np.ndarray
    value: np.ndarray
    near: np.ndarray

    @staticmethod
    def none(ids: np.ndarray) -> _Tops:
        return _Tops(ids, np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max))

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Better ones for ``rows`` of a matrix of scores, a row each, whose columns are profiles ``ids`` in order."""
        most = scores.max(axis=1)
        good = np.flatnonzero(most >= self.value[rows])
        rows, most, near = rows[good], most[good], ids[np.argmax(scores[good] == most[good, None], axis=1)]
        better = (most > self.value[rows]) | (near < self.near[rows])
        self.value[rows[better]], self.near[rows[better]] = most[better], near[better]


def _meet(a: dict, b: dict, tops: _Tops, others: _Tops | None, rows: np.ndarray, whole_only: bool, room: _Room) -> None:
    """``tops`` of some rows of ``a`` among all of ``b``; with ``others``, whose rows must be all, those of ``b`` too."""
    for at in range(0, len(rows), TILE):
        some = rows[at : at + TILE]
        scores = _scores(_some(a, some), b, whole_only, room)
        tops.take(some, scores, b["id"])
        if others is not None:
            others.take(np.arange(len(b["id"])), scores.T, a["id"][some])


def in_blocks(profiles: DataFrame, n: int, whole_only: bool = False) -> DataFrame:
    """Blocks of pivoted rows, as a written table: a row each, with its profiles' ordinals, their vectors and weights as bytes,
    its balls (centres, radii), and each profile's best in the block."""
    rows = profiles.select(F.col("ordinal").cast("long").alias("ordinal"), F.xxhash64(F.col("ordinal").cast("long")).alias("hash"), *_VECTORS, "w1", "w2")
    size = max(BLOCK, ceil(n / MOST_BLOCKS))
    unit = rows.select(F.col("ordinal").alias("id"), F.col("g").alias("unit"))
    centres = fitted(unit, ceil(n / size), n)
    parts = np.ones(len(centres), np.int64)
    for r in assigned(unit, centres).groupBy("list").count().collect():  # a row a list
        parts[r["list"]] = ceil(r["count"] / size)
    before = np.cumsum(parts) - parts

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = np.concatenate([np.argmax(g[at : at + 4096] @ centres.T, axis=1) for at in range(0, len(g), 4096)] or [np.zeros(0, int)])
            block = before[near] + np.mod(batch.column(1).to_numpy(), parts[near])
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), batch.column(0), *batch.columns[2:]], ["block", "ordinal", *_VECTORS, "w1", "w2"])

    lists = ", ".join(f"{n} array<double>" for n in _VECTORS)
    placed = rows.select("ordinal", "hash", *[F.col(c).cast("array<double>").alias(c) for c in _VECTORS], F.col("w1").cast("double").alias("w1"), F.col("w2").cast("double").alias("w2"))
    placed = placed.mapInArrow(dealt, f"block int, ordinal long, {lists}, w1 double, w2 double")

    def packed(t: pa.Table) -> pa.Table:
        side, middle, radii = _sides(t), [], []
        for name in _VECTORS:
            total = side[name].sum(axis=0)
            length = np.linalg.norm(total)
            centre = total / length if length > 1e-9 else side[name][0]
            middle += centre.tolist()
            radii.append(float(np.arccos(np.clip(side[name] @ centre, -1, 1)).max()))
        best = [pa.array([c], kind) for c, kind in zip(_best(side, side, whole_only), (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())))]
        doubles = pa.list_(pa.float64())
        made = [t.column("block").slice(0, 1), pa.array([side["id"]], pa.list_(pa.int64())), pa.array([_packed(side)], pa.binary()), pa.array([middle], doubles), pa.array([radii], doubles), *best]
        return pa.table(made, [c.split()[0] for c in _BLOCKS.split(", ")])

    return written(placed.groupBy("block").applyInArrow(packed, _BLOCKS))


def upper_bounds(centres: np.ndarray, radii: np.ndarray, some: np.ndarray, whole_only: bool) -> np.ndarray:
    """The greatest similarity that profiles of blocks ``some`` and of every block can have."""
    d = centres.shape[1] // 3

    def most(x: int, y: int) -> np.ndarray:
        angle = np.arccos(np.clip(centres[some, x * d : (x + 1) * d] @ centres[:, y * d : (y + 1) * d].T, -1, 1))
        return np.cos(np.maximum(0.0, angle - radii[some, x, None] - radii[None, :, y]))

    whole = most(0, 0)
    if whole_only:
        return whole + SLACK
    return GLOBAL_WEIGHT * whole + CLUSTER_WEIGHT * np.maximum.reduce([most(x, y) for x in (1, 2) for y in (1, 2)]) + SLACK


def _promising(worst: DataFrame, balls: list, whole_only: bool, first: int | None) -> DataFrame:
    """(block, asks, n): a 1 for each of the ``n`` other blocks that a block is to be compared with, the ``first`` by bound, or those after them; none whose bound is below ``worst``."""
    names = np.array([r["block"] for r in balls])
    centres, radii = np.array([r["centres"] for r in balls]), np.array([r["radii"] for r in balls])
    place = {int(b): i for i, b in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, limits = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(blocks), 64):
                some = np.array([place[int(b)] for b in blocks[at : at + 64]])
                bound = upper_bounds(centres, radii, some, whole_only)
                bound[np.arange(len(some)), some] = -np.inf
                order = np.argsort(-bound, axis=1, kind="stable")
                order = order[:, :FIRST] if first else order[:, FIRST:]
                found = np.take_along_axis(bound, order, axis=1)
                # a block none of whose profiles has a partner yet has no limit
                good = (found > -np.inf) & (np.isnan(limits[at : at + 64])[:, None] | (found >= limits[at : at + 64, None]))
                row, col = np.nonzero(good)
                asks = np.full((len(some), names.max() + 1), ord("0"), np.uint8)
                asks[row, names[order[row, col]]] = ord("1")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 64), pa.array([r.tobytes().decode() for r in asks]), pa.array(good.sum(axis=1), pa.int64())], ["block", "asks", "n"]
                )

    return worst.select("block", "worst").mapInArrow(run, "block int, asks string, n long")


def _across(blocks: DataFrame, asked: DataFrame, balls: list, whole_only: bool) -> DataFrame:
    """Bests of the blocks' rows in the other blocks that theirs asks for, or that asks for theirs; of the tasks that a row is in, one each.

    Each two partitions of the table are read by a task, so nothing is shuffled but
    bests. A pair of blocks is compared once for both; rows that have a better one than the bound stay out.
    """
    # a character for each two blocks, at most twice MOST_BLOCKS a block
    mine = blocks.select("block", "ids", "rows").join(F.broadcast(asked.select("block", "asks")), "block")
    theirs = mine.select(F.col("block").alias("other"), F.col("ids").alias("other_ids"), F.col("rows").alias("other_rows"), F.col("asks").alias("other_asks"))
    wants, wanted = F.expr("substring(asks, other + 1, 1) = '1'"), F.expr("substring(other_asks, block + 1, 1) = '1'")
    both = mine.join(theirs.hint("shuffle_replicate_nl"), (F.col("block") < F.col("other")) & (wants | wanted))
    both = both.select("block", "other", wants.alias("wants"), wanted.alias("wanted"), "ids", "other_ids", "rows", "other_rows")
    place = {r["block"]: i for i, r in enumerate(balls)}
    centres, radii = np.array([r["centres"] for r in balls]), np.array([r["radii"] for r in balls])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, _Tops] = {}
        room = _Room()
        last, a, bounds = None, {}, np.zeros(0)
        for batch in batches:
            for i in range(batch.num_rows):
                block, other, wants, wanted = (batch.column(c)[i].as_py() for c in range(4))
                if block != last:
                    last, a = block, _unpacked(batch.column(4)[i].values.to_numpy().copy(), batch.column(6)[i])
                    bounds = upper_bounds(centres, radii, np.array([place[block]]), whole_only)[0]
                b = _unpacked(batch.column(5)[i].values.to_numpy().copy(), batch.column(7)[i])
                left, right = (tops.setdefault(k, _Tops.none(s["id"])) for k, s in ((block, a), (other, b)))
                live = [np.flatnonzero((t.value <= bounds[place[other]]) & w) for t, w in ((left, wants), (right, wanted))]
                if len(live[0]) + len(live[1]) > max(len(a["id"]), len(b["id"])):
                    _meet(a, b, left, right, np.arange(len(a["id"])), whole_only, room)
                else:
                    _meet(a, b, left, None, live[0], whole_only, room)
                    _meet(b, a, right, None, live[1], whole_only, room)
        for t in tops.values():
            seen = t.value > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(c[seen]) for c in (t.ids, t.near, t.value)], ["ordinal", "nearest", "similarity"])

    return both.mapInArrow(run, _BEST)


@contextmanager
def _few_at_once(spark: SparkSession) -> Iterator[None]:
    """Rows of two blocks come to Python ``PAIRS`` at once, so that a task holds few of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, PAIRS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _merged(*found: DataFrame) -> DataFrame:
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.max(F.struct("similarity", (-F.col("nearest")).alias("minus"))).alias("best")
    return every.groupBy("ordinal").agg(best).select("ordinal", (-F.col("best.minus")).alias("nearest"), F.col("best.similarity").alias("similarity"))


def nearest_in_catalogue(profiles: DataFrame, whole_only: bool = False, report: Report | None = None, keep: bool = True) -> DataFrame:
    """(ordinal, nearest, similarity): each profile's nearest among all pivoted rows with a unique ``ordinal``.

    Rows are read four times, from a table written first; without ``keep`` they are made again each time.
    """
    profiles = written(profiles) if keep else profiles
    n = profiles.count()
    if not n:
        return profiles.sparkSession.createDataFrame([], _BEST)
    blocks = in_blocks(profiles, n, whole_only)
    own = blocks.select(F.explode(F.arrays_zip("seen", "nearest", "similarity")).alias("x")).select(F.col("x.seen").alias("ordinal"), "x.nearest", "x.similarity")
    best, balls = written(own), blocks.select("block", "centres", "radii").collect()  # at most twice MOST_BLOCKS rows
    rows = blocks.select("block", F.explode("ids").alias("ordinal"))
    report = report or Report()
    report.blocks, report.pairs = len(balls), len(balls) * (len(balls) - 1)
    for first in (FIRST, None):
        if len(balls) <= (1 if first else FIRST + 1):
            break
        # -1 is below any similarity, so profiles without a partner keep their block open
        met = rows.join(best, "ordinal", "left")
        worst = met.groupBy("block").agg(F.min(F.coalesce("similarity", F.lit(-2.0))).alias("worst"))
        asked = written(_promising(worst, balls, whole_only, first))
        report.compared += asked.agg(F.sum("n")).first()[0]
        with _few_at_once(blocks.sparkSession):
            best = written(_merged(best, _across(blocks, asked, balls, whole_only)))
    return best
