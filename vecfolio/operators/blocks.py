"""Profiles of more clips than one task should hold.

The functions give what ``density``, ``profiles`` and ``diagnostics`` give for a
group in memory, but for groups cut into blocks of ``BLOCK`` clip numbers. A
block is a row (profile_id, part, clips) with its clips in order. Each pass over
the blocks returns sums or best clips of a block; those are added up or compared
over a profile. Vectors are moved once, into their blocks; only density, which
is about all pairs, meets each stretch of ``STRETCH`` blocks with each other.

Two-centre clustering keeps a row a profile: its centres and the rule by which
clips were dealt last (those centres, and a cut in the order of lean and clip
where minimum support decided). A round deals anew, tells if any clip changed
its side, and adds up both sides; profiles that have settled take no part in
later rounds. Only the number of those still moving comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import dot, with_unit
from ..scratch import written

BLOCK, STRETCH = 4096, 4
#: Coordinates differ by no more than this when a centre has settled, as numpy's ``allclose`` has it.
NEAR, NEAR_SHARE = 1e-8, 1e-5


def larger(clips: DataFrame, most: int) -> DataFrame | None:
    """(profile_id) of the profiles with more than ``most`` clips, or None if there are none; reads no vector."""
    found = clips.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("profile_id")
    return None if found.isEmpty() else written(found)


def blocked(clips: DataFrame) -> DataFrame:
    """Blocks (profile_id, part, clips) of rows (profile_id, clip_ix, unit), as a written table."""
    rows = clips.select("profile_id", F.col("clip_ix").cast("int").alias("clip_ix"), "unit")
    rows = rows.withColumn("part", F.floor(F.col("clip_ix") / BLOCK).cast("int"))
    # clip numbers are unique within a profile, so a list has BLOCK clips at most
    return written(rows.groupBy("profile_id", "part").agg(F.array_sort(F.collect_list(F.struct("clip_ix", "unit"))).alias("clips")))


def _clips(column: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Clip numbers and vectors of row i."""
    row = column[i].values
    return row.field(0).to_numpy(), row.field(1).flatten().to_numpy().reshape(len(row), -1)


def each_block(blocks: DataFrame, facts: DataFrame, run: Callable[..., Iterator[tuple]], columns: str) -> DataFrame:
    """(profile_id and ``columns``): the rows that ``run(ix, unit, facts)`` yields for each block.

    ``facts`` has one row a profile; profiles without one are left out. It is
    met block by block, so a profile of many blocks is many keys.
    """
    given = facts.join(blocks.select("profile_id", "part"), "profile_id")
    names = [c for c in facts.columns if c != "profile_id"]
    met = blocks.join(given, ["profile_id", "part"]).select("profile_id", "clips", *names)
    schema = StructType([met.schema["profile_id"], *StructType.fromDDL(columns)])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                known = {n: batch.column(n)[i].as_py() for n in names}
                known = {n: np.array(v) if isinstance(v, list) else v for n, v in known.items()}
                rows += [(batch.column(0)[i].as_py(), *made) for made in run(*_clips(batch.column(1), i), known)]
            if rows:
                from pyspark.sql.pandas.types import to_arrow_schema

                kinds = to_arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return met.mapInArrow(batches, schema)


def vector_sum(column: str) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column))))


def means(blocks: DataFrame) -> DataFrame:
    """(profile_id, n, first, mean, vector): the mean of a profile's clips and its direction; first is the least clip number."""
    none = blocks.select("profile_id").distinct().withColumn("none", F.lit(0))
    parts = each_block(blocks, none, lambda ix, unit, _: [(len(ix), int(ix[0]), unit.sum(axis=0).tolist())], "n long, first int, total array<double>")
    whole = parts.groupBy("profile_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), vector_sum("total").alias("total"))
    return with_unit(whole.withColumn("mean", F.transform("total", lambda x: x / F.col("n"))), "mean", "vector", strict=True).drop("total")


# --- density -----------------------------------------------------------------


def density(blocks: DataFrame) -> DataFrame:
    """(profile_id, clip_ix, density): the mean of a clip's largest similarities to others of its profile."""
    sizes = blocks.groupBy("profile_id").agg(F.sum(F.size("clips")).alias("n"), F.max(F.floor(F.col("part") / STRETCH)).alias("last"), F.min(F.floor(F.col("part") / STRETCH)).alias("least"))
    # half to even, as Python and numpy round
    k = F.least(F.col("n") - 1, F.greatest(F.lit(3), F.bround(F.sqrt("n")))).cast("int").alias("k")
    ends = sizes.select("profile_id", "least", "last", k)
    at = F.floor(F.col("part") / STRETCH)
    met = blocks.join(ends.join(blocks.select("profile_id", "part"), "profile_id"), ["profile_id", "part"])
    met = met.withColumn("own", at).withColumn("other", F.explode(F.sequence("least", "last")))
    met = met.select("profile_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "clips")
    schema = StructType([met.schema["profile_id"], *StructType.fromDDL("clip_ix int, k int, nearest array<double>")])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        own, clips, k = t.column("own").to_numpy(), t.column("clips").chunk(0), t.column("k")[0].as_py()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        sides = {s: [_clips(clips, r) for r in np.flatnonzero(own == s)] for s in {i, j}}
        ix, near = [], []

        def best(rows: list, others: list) -> None:
            for names, unit in rows:
                top = np.full((len(names), 0), -np.inf)
                for others_names, other in others:
                    score = unit @ other.T
                    if names is others_names:
                        np.fill_diagonal(score, -np.inf)
                    top = np.concatenate([top, score], axis=1)
                    if top.shape[1] > k:
                        top = np.partition(top, -k, axis=1)[:, -k:]
                ix.extend(names.tolist())
                near.extend(row[row > -np.inf] for row in top)

        best(sides[i], sides[j])
        if i != j:
            best(sides[j], sides[i])
        who = t.column("profile_id").take(pa.array(np.zeros(len(ix), int)))
        return pa.table([who, pa.array(ix, pa.int32()), pa.array(np.full(len(ix), k), pa.int32()), pa.array(near, pa.list_(pa.float64()))], ["profile_id", "clip_ix", "k", "nearest"])

    found = met.groupBy("profile_id", "i", "j").applyInArrow(run, schema)
    merged = found.groupBy("profile_id", "clip_ix").agg(F.max("k").alias("k"), F.flatten(F.collect_list("nearest")).alias("all"))
    top = F.slice(F.sort_array("all", asc=False), F.lit(1), F.col("k"))
    return merged.select("profile_id", "clip_ix", (F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.col("k")).alias("density"))


# --- clustering --------------------------------------------------------------


def seeds(blocks: DataFrame) -> DataFrame:
    """(profile_id, n, first_clip, second_clip, c0, c1): the clips that begin the clustering, and their vectors."""

    def most(ix, unit, known):
        at = int(np.argmax(unit @ known["vector"]))
        return [(float(unit[at] @ known["vector"]), int(ix[at]), unit[at].tolist())]

    def least(ix, unit, known):
        score = unit @ known["c0"]
        at = int(np.argmin(score))
        return [(-float(score[at]), int(ix[at]), unit[at].tolist())]

    kind = "score double, clip_ix int, unit array<double>"
    order = F.struct("score", (-F.col("clip_ix")).alias("minus"), "unit")
    whole = means(blocks)
    first = each_block(blocks, whole.select("profile_id", "vector"), most, kind).groupBy("profile_id").agg(F.max(order).alias("a"))
    first = written(first.select("profile_id", (-F.col("a.minus")).alias("first_clip"), F.col("a.unit").alias("c0")))
    second = each_block(blocks, first.select("profile_id", "c0"), least, kind).groupBy("profile_id").agg(F.max(order).alias("b"))
    met = first.join(second, "profile_id").join(whole.select("profile_id", "n"), "profile_id")
    return met.select("profile_id", "n", "first_clip", (-F.col("b.minus")).alias("second_clip"), "c0", F.col("b.unit").alias("c1"))


def _second(ix: np.ndarray, unit: np.ndarray, a, b, cut: float | None, at: int | None) -> tuple[np.ndarray, np.ndarray]:
    """How far each clip leans to the first centre, and whether it goes to the second."""
    lean = unit @ a - unit @ b
    return lean, lean < 0 if cut is None else (lean < cut) | ((lean == cut) & (ix >= at))


def _dealt(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """(profile_id, n0, same, s0, s1): each profile's clips dealt to its centres and added up, and whether none changed sides."""

    def run(ix, unit, known):
        _, second = _second(ix, unit, known["c0"], known["c1"], known["cut"], known["cut_ix"])
        same = known["p0"] is not None and bool((second == _second(ix, unit, known["p0"], known["p1"], known["p_cut"], known["p_cut_ix"])[1]).all())
        return [(int((~second).sum()), same, unit[~second].sum(axis=0).tolist(), unit[second].sum(axis=0).tolist())]

    parts = each_block(blocks, state.select("profile_id", "c0", "c1", "cut", "cut_ix", "p0", "p1", "p_cut", "p_cut_ix"), run, "n0 long, same boolean, s0 array<double>, s1 array<double>")
    return parts.groupBy("profile_id").agg(F.sum("n0").alias("n0"), F.min("same").alias("same"), vector_sum("s0").alias("s0"), vector_sum("s1").alias("s1"))


def _cuts(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """(profile_id, cut, cut_ix): the first clip, in the order of lean, that goes to the second side, of rows with ``place``."""

    def run(ix, unit, known):
        lean, _ = _second(ix, unit, known["c0"], known["c1"], None, None)
        return zip(ix.tolist(), lean.tolist())

    leans = each_block(blocks, state.select("profile_id", "c0", "c1"), run, "clip_ix int, lean double")
    rank = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.col("lean").desc(), "clip_ix")) - 1
    met = leans.withColumn("r", rank).join(state.select("profile_id", "place"), "profile_id").filter("r = place")
    return met.select("profile_id", F.col("lean").alias("cut"), F.col("clip_ix").alias("cut_ix"))


def _settled(a: str, b: str) -> Column:
    near = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.lit(NEAR) + NEAR_SHARE * F.abs(y))
    return F.forall(near, lambda ok: ok)


def cluster_states(blocks: DataFrame, rounds: int, support: int, ordering: int) -> DataFrame:
    """One row a profile, as a written table: the two centres, larger side first, and the rule by which clips are dealt.

    (profile_id, n, n0, n1, c0, c1, forced, rounds, p0, p1, p_cut, p_cut_ix,
    swapped): a clip's side follows from the rule, by ``_second``, and is the
    other one if ``swapped``.
    """
    none = {"cut": "double", "cut_ix": "int", "p0": "array<double>", "p1": "array<double>", "p_cut": "double", "p_cut_ix": "int"}
    state = seeds(blocks).select("profile_id", "n", "c0", "c1", F.lit(False).alias("forced"), *[F.lit(None).cast(k).alias(c) for c, k in none.items()])
    state, done = written(state), None
    least = F.ceil(F.col("n") / support)
    for k in range(1, rounds + 1):
        dealt = written(_dealt(blocks, state))
        short = F.least("n0", F.col("n") - F.col("n0")) < least
        counted = state.join(dealt.select("profile_id", "n0"), "profile_id").filter(short)
        cut = state
        if not counted.isEmpty():
            few = written(counted.withColumn("place", F.when(F.col("n0") < least, least).otherwise(F.col("n") - least)).drop("n0"))
            few = written(few.drop("cut", "cut_ix", "place").join(_cuts(blocks, few), "profile_id").withColumn("forced", F.lit(True)))
            rest = state.join(few.select("profile_id"), "profile_id", "left_anti")
            dealt = written(dealt.join(few.select("profile_id"), "profile_id", "left_anti").unionByName(_dealt(blocks, few)))
            cut = rest.unionByName(few.select(*state.columns))
        moved = cut.join(dealt, "profile_id")
        # a sum has the direction of its mean, but an error is about the mean's length
        moved = moved.withColumn("s0", F.transform("s0", lambda x: x / F.col("n0"))).withColumn("s1", F.transform("s1", lambda x: x / (F.col("n") - F.col("n0"))))
        moved = with_unit(with_unit(moved, "s0", "m0", strict=True), "s1", "m1", strict=True)
        over = F.lit(k == rounds) | (F.col("same") & _settled("m0", "c0") & _settled("m1", "c1"))
        moved = written(
            moved.select(
                "profile_id", "n", "n0", "forced", over.alias("over"), F.lit(k).alias("rounds"), F.col("m0").alias("c0"), F.col("m1").alias("c1"), F.col("c0").alias("p0"), F.col("c1").alias("p1"),
                F.col("cut").alias("p_cut"), F.col("cut_ix").alias("p_cut_ix"), *[F.lit(None).cast(none[c]).alias(c) for c in ("cut", "cut_ix")],
            )
        )
        ended = moved.filter("over")
        done = ended if done is None else done.unionByName(ended)
        state = moved.filter("not over").select(*state.columns)
        if state.isEmpty():
            break
    head = [F.slice(c, 1, ordering) for c in ("c0", "c1")]
    n1 = F.col("n") - F.col("n0")
    later = F.struct((-n1).alias("n"), head[1].alias("c")) < F.struct((-F.col("n0")).alias("n"), head[0].alias("c"))
    out = done.withColumn("n1", n1).withColumn("swapped", later)
    pairs = {("n0", "n1"), ("c0", "c1")}
    for a, b in pairs:
        out = out.withColumn("_a", F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a))).withColumn(b, F.when(F.col("swapped"), F.col(a)).otherwise(F.col(b))).withColumn(a, F.col("_a"))
    return written(out.drop("_a", "over", "cut", "cut_ix"))


def sides(blocks: DataFrame, states: DataFrame) -> DataFrame:
    """(profile_id, clip_ix, cluster) by the rules of ``cluster_states``."""

    def run(ix, unit, known):
        _, second = _second(ix, unit, known["p0"], known["p1"], known["p_cut"], known["p_cut_ix"])
        return zip(ix.tolist(), (second ^ known["swapped"]).astype(int).tolist())

    return each_block(blocks, states.select("profile_id", "p0", "p1", "p_cut", "p_cut_ix", "swapped"), run, "clip_ix int, cluster int")


# --- axes --------------------------------------------------------------------


def principal(blocks: DataFrame, most: int = 3) -> DataFrame:
    """(profile_id, variance, low_clip, high_clip): shares of the first axes, and the ends of the first."""
    whole = means(blocks).select("profile_id", "n", "first", "mean")

    def scatter(ix, unit, known):
        centred = unit - known["mean"]
        return [((centred.T @ centred).ravel().tolist(), bool(np.allclose(centred, 0.0)))]

    parts = each_block(blocks, whole.select("profile_id", "mean"), scatter, "scatter array<double>, flat boolean")
    added = parts.groupBy("profile_id").agg(vector_sum("scatter").alias("scatter"), F.min("flat").alias("flat")).join(whole, "profile_id")
    kind = StructType([added.schema["profile_id"], *StructType.fromDDL("first int, mean array<double>, variance array<double>, axis array<double>")])

    def axes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares, axis = [], []
            for i in range(batch.num_rows):
                if batch.column("flat")[i].as_py():
                    shares.append([])
                    axis.append(None)
                    continue
                flat = batch.column("scatter")[i].values.to_numpy()
                d = int(np.sqrt(len(flat)))
                values, vectors = np.linalg.eigh(flat.reshape(d, d))
                values, first = np.maximum(values[::-1], 0.0), vectors[:, -1]
                shares.append((values / values.sum())[: min(most, d)])
                axis.append(first if first[np.argmax(np.abs(first))] > 0 else -first)
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("profile_id", "first", "mean")), pa.array(shares, lists), pa.array(axis, lists)], ["profile_id", "first", "mean", "variance", "axis"])

    found = written(added.mapInArrow(axes, kind))

    def ends(ix, unit, known):
        along = (unit - known["mean"]) @ known["axis"]
        low, high = int(np.argmin(along)), int(np.argmax(along))
        return [(float(along[low]), int(ix[low]), float(along[high]), int(ix[high]))]

    parts = each_block(blocks, found.filter("axis is not null").select("profile_id", "mean", "axis"), ends, "low double, low_clip int, high double, high_clip int")
    low, high = F.min(F.struct("low", "low_clip")), F.max(F.struct("high", (-F.col("high_clip")).alias("minus")))
    outer = parts.groupBy("profile_id").agg(low.alias("l"), high.alias("h"))
    met = found.join(outer, "profile_id", "left")
    return met.select("profile_id", "variance", F.coalesce("l.low_clip", "first").alias("low_clip"), F.coalesce(-F.col("h.minus"), "first").alias("high_clip"))


def closeness(whole: DataFrame, vectors: DataFrame) -> DataFrame:
    """(profile_id, diversity): one less the mean similarity to ``vectors`` (profile_id, vector); ``whole`` as ``means`` gives."""
    met = whole.select("profile_id", "mean").join(vectors.select("profile_id", "vector"), "profile_id")
    return met.select("profile_id", (F.lit(1.0) - dot(F.col("mean"), F.col("vector"))).alias("diversity"))
