"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


#: Scratch tables of this driver, in the order in which they were asked for.
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/vecfolio-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Only where a local session names none (tests) is a folder of our own set.
    """
    _MADE.append(f"{_scratch_root(spark)}/{uuid.uuid4().hex}")
    return _MADE[-1]


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application wrote there; frames that read it can't be used any more."""
    _delete(spark, _scratch_root(spark))


def settled(make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What ``make`` returns, written and read again, and where; the tables written on the way are deleted."""
    first = len(_MADE)
    out = materialise(make())
    for name in _MADE[first:-1]:
        _delete(out.sparkSession, name)
    path = _MADE[-1]
    del _MADE[first:]
    return out, path


def forget(spark: SparkSession, path: str | None) -> None:
    """Deletes a table that ``settled`` wrote."""
    if path:
        _delete(spark, path)


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, needed: list[str]) -> DataFrame:
    """The needed columns and the others as one struct ``_rest``, so that no other name can clash."""
    others = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]).alias("_rest"))


def unpacked(rows: DataFrame, columns: list[str], needed: list[str], made: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the packed frame in their order, then those made; one of the same name gives way."""
    kept = [F.col(c) if c in needed else F.col("_rest")[c].alias(c) for c in columns if c not in made]
    return rows.select(*kept, *made)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(rows: DataFrame, order: list[Column], value: str) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in the order, and ``before``, the sum of ``value`` over those before.

    Rows are dealt to ranges, so no task holds them all; only a row a range is summed in one place.
    """
    parted = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    parted = materialise(parted.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    parts = parts.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", "v")])
    inside = Window.partitionBy("_part").orderBy("_at")
    local = parted.withColumn("_rank", F.row_number().over(inside) - 1).withColumn(
        "_sum", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    )
    met = local.join(F.broadcast(parts), "_part")  # a row a range
    return met.withColumn("place", F.col("_n") + F.col("_rank")).withColumn("before", F.col("_v") + F.col("_sum")).select(*rows.columns, "place", "before")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def per_worker(key: tuple, make: Callable):
    """What ``make`` returns, made once in a Python worker process and kept for its later tasks.

    Functions travel by value, so their own modules don't outlive a task.
    """
    name = "vecfolio_worker"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def gathered_ids(at: np.ndarray, counts: np.ndarray, flat: np.ndarray, lengths: np.ndarray, each: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Items of texts, one after the other, and how many each has.

    ``at`` are the texts' words, numbered, and ``counts`` how many each text
    has; ``flat`` holds the words' items one after the other, ``lengths`` of them each.
    """
    each = lengths[at] if each is None else each
    ends = np.cumsum(each)
    shift = (np.cumsum(lengths) - lengths)[at] - (ends - each)
    # positions below 2**31: a slice of texts is far smaller
    place = np.repeat(shift.astype(np.int32), each)
    place += np.arange(len(place), dtype=np.int32)
    bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))]
    return flat[place], np.diff(bounds)


class IdTable:
    """A hash table from integers that aren't negative to such integers, read for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(np.asarray(keys, np.int64))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 where there is none."""
        at = self._home(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.values[at], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[left]]
            hit = held == keys[left]
            found[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return found


def text_slices(texts: pa.Array, size: int):
    """Slices of a string array of about ``size`` bytes, one text at least; nulls as empty."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        before = lengths[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(lengths, before + size, "right")))
        # an array of its own: kernels work on all of the buffer that a slice shares
        yield at, pa.array([t or "" for t in texts.slice(at, to - at).to_pylist()], pa.large_string())
        at = to
