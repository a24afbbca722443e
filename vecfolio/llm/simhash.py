"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's 64-bit fingerprint has a bit set where over half of its word
shingles' hashes have it. To find all fingerprints within ``distance`` bits,
the bits are parted, correlated bits together, and part i gets a threshold t_i
with sum(t_i + 1) = distance + 1: two fingerprints that close differ in at most
t_i bits of some part. Candidate counts of every part are estimated from all
fingerprints, and dynamic programming allots the thresholds (also none) that
cost least. Fingerprints meet in buckets of a part's value, probing with up to
t_i bits flipped, and every meeting is verified over all 64 bits.

Copies fold into one fingerprint before the search. A bucket's links are
returned as a spanning forest, which keeps components and not all pairs; a
bucket over ``BUCKET`` rows is cut into blocks, and pairs of blocks are worked
on apart.

Classes by similarity of shingle sets come from the same search, over a wider
distance; sets similar but further apart meet in buckets of least hashes, and
of all that met the sets themselves decide.

Defined results: a null or empty text has fingerprint 0 and links like any
other; fewer words than a shingle are one shingle; repeated rows are all kept
and share a component; a null doc_id is never a component's id unless all are
null; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, packed, table, unpacked
from .components import connected_components

BITS = 64
SEED = 42
DISTANCE = 3
#: Rows of a bucket that one task compares at once.
BUCKET = 4096
#: Up to so many rows, a bucket is compared along with its neighbours in one numpy pass.
SMALL = 16
#: Cost of comparing a candidate pair against that of shuffling a row.
PAIR_COST = 0.02
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word shingles, repeats included, of the text with A-Z in lower case."""
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: str | None, width: int) -> int:
    """The SimHash of a text as an unsigned integer."""
    parts = shingles(text, width)
    if not parts:
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(parts), 8192):
        digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in parts[i : i + 8192]])
        # digests are big-endian, so the first column is the highest bit
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp): signed 64-bit SimHash of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# --- plan of the search ---------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often bits i and j are set together; from all rows."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            for i in range(0, len(values), 65536):
                part = values[i : i + 65536].astype("<i8").view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
                n += len(bits)
        row, column = np.triu_indices(BITS)
        ids = np.append(row * BITS + column, -1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.append(total[row, column], n))], ["ij", "c"])

    # one number for each pair of bits
    sums = fps.select("fp").mapInArrow(run, "ij long, c long").groupBy("ij").agg(F.sum("c").alias("c")).collect()
    together, n = np.zeros((BITS, BITS), np.int64), 0
    for r in sums:
        if r["ij"] < 0:
            n = r["c"]
        else:
            i, j = divmod(r["ij"], BITS)
            together[i, j] = together[j, i] = r["c"]
    return n, together


def correlated_parts(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m parts of like size, each grown by the bit most correlated with it."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    linked = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(linked, 0)
    left, parts = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [max(left, key=lambda b: (linked[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: (linked[b, part].sum(), -b)))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def allot(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Units to parts so that all are used at least cost; costs[i][u] is part i's cost with u units."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, given) in best.items():
            for u in range(min(units - used, len(row) - 1) + 1):
                got = (cost + row[u], [*given, u])
                if used + u not in step or got < step[used + u]:
                    step[used + u] = got
        best = step
    return best[units]


def plan_search(fps: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to search, by estimated candidate counts over all fingerprints."""
    n, together = bit_statistics(fps)
    share = np.diag(together) / max(n, 1)
    differ = np.clip(2 * share * (1 - share), 0, 0.5)
    plans = {m: correlated_parts(n, together, m) for m in range(1, distance + 2)}
    named = [(m, i, part) for m, parts in plans.items() for i, part in enumerate(parts)]
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("v")) for k, (_, _, p) in enumerate(named)])
    same = (
        fps.select(F.explode(values).alias("x")).groupBy("x.k", "x.v").count()
        .groupBy("k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
    )
    pairs = {r["k"]: r["pairs"] for r in same.collect()}  # one row a part
    best = None
    for m, parts in plans.items():
        costs = []
        for k, (_, _, part) in enumerate(named):
            if named[k][0] != m:
                continue
            odds = [differ[b] / (1 - differ[b]) for b in part]
            row, met, probes = [0.0], 0.0, 0.0
            # pairs that differ in t bits of a part, from those that differ in none
            symmetric = [1.0] + [0.0] * (distance + 1)
            for o in odds:
                for t in range(distance + 1, 0, -1):
                    symmetric[t] += symmetric[t - 1] * o
            ways = 1.0
            for t in range(distance + 1):
                if t:
                    ways = ways * (len(part) - t + 1) / t
                met += pairs.get(k, 0.0) * symmetric[t]
                probes += max(n, 1) * ways / (2 if t else 1)
                row.append(probes + PAIR_COST * met)
            costs.append(row)
        cost, units = allot(costs, distance + 1)
        if best is None or cost < best[0]:
            best = (cost, [(p, u - 1) for p, u in zip(parts, units) if u])
    return best[1]


# --- search -----------------------------------------------------------------


def _probes(plan: list[tuple[list[int], int]]) -> Column:
    """Rows (part, value) of a fingerprint: its own value, and those with bits flipped.

    Of two values that differ, one has a 0 in the lowest bit where they do, so
    only flips whose lowest bit is 0 are made.
    """
    rows = []
    for k, (part, threshold) in enumerate(plan):
        value = F.col("fp").bitwiseAND(F.lit(_mask(part)))
        rows.append(F.struct(F.lit(k).alias("part"), value.alias("value")))
        for t in range(1, threshold + 1):
            for flips in combinations(part, t):
                low = F.col("fp").bitwiseAND(F.lit(_mask([flips[0]]))) == 0
                flipped = F.struct(F.lit(k).alias("part"), value.bitwiseXOR(F.lit(_mask(list(flips)))).alias("value"))
                rows.append(F.when(low, flipped))
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def _forest(fps: np.ndarray, side: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) of a spanning forest of the fingerprints within ``distance``; with sides, only across them."""

    def near(i: int, waiting: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[waiting] ^ fps[i]) <= distance

    return spanning_forest(len(fps), side, near)


def _linked(fps: np.ndarray, distance: int) -> np.ndarray:
    """The rows that have another within ``distance``."""
    step = max(1, 1_000_000 // max(1, len(fps)))
    near = [(np.bitwise_count(fps[i : i + step, None] ^ fps) <= distance).sum(axis=1) for i in range(0, len(fps), step)]
    return np.flatnonzero(np.concatenate(near) > 1)  # one is the row itself


def spanning_forest(n: int, side: np.ndarray | None, near) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that connect n rows as all links do; ``near(i, rows)`` tells which rows link to row i."""
    a, b = [np.empty(0, int)], [np.empty(0, int)]
    waiting = np.arange(n)
    while len(waiting):
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            reached = []
            for i in front:
                if not len(waiting):
                    break
                hit = near(i, waiting)
                if side is not None:
                    hit = hit & (side[waiting] != side[i])
                if hit.any():
                    reached.append(waiting[hit])
                    waiting = waiting[~hit]
                    a.append(np.full(len(reached[-1]), i))
                    b.append(reached[-1])
            front = np.concatenate(reached) if reached else waiting[:0]
    return np.concatenate(a), np.concatenate(b)


def _bucket_links(keys: np.ndarray, fps: np.ndarray, sides: np.ndarray, apart: np.ndarray, distance: int):
    """Links (row, row) in complete buckets; ``keys`` numbers the buckets of the sorted rows."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.append(0, cuts), np.append(cuts, len(keys))
    sizes = np.repeat(ends - starts, ends - starts)
    a, b = [np.empty(0, int)], [np.empty(0, int)]
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL) & ~apart)
    k, f = keys[small], fps[small]
    for d in range(1, SMALL):
        if len(f) <= d:
            break
        hit = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= distance))
        a.append(small[hit])
        b.append(small[hit + d])
    for i in np.flatnonzero((ends - starts > SMALL) | apart[starts]):
        s = starts[i]
        rows = s + _linked(fps[s : ends[i]], distance)
        x, y = _forest(fps[rows], sides[rows] if apart[s] else None, distance)
        a.append(rows[x])
        b.append(rows[y])
    return np.concatenate(a), np.concatenate(b)


_CELL = ["part", "value", "i", "j"]


def bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of nodes that share a bucket and lie within ``distance`` bits.

    ``rows`` are (part, value, node, fp); (part, value) names a bucket. A
    bucket's links are a spanning forest if it has over ``SMALL`` rows.
    """
    large = rows.groupBy("part", "value").count().filter(F.col("count") > BUCKET)
    large = large.select("part", "value", F.ceil(F.col("count") / BUCKET).cast("int").alias("n"))
    cut = rows.join(large, ["part", "value"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    # a row of block i goes to every pair of blocks that has i
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "part", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "fp"
    )

    def run(batches):
        held = None

        def links(t: pa.Table):
            c = {n: t.column(n).to_numpy() for n in t.column_names}
            new = np.zeros(len(c["fp"]), bool)
            for n in _CELL:
                new[1:] |= c[n][1:] != c[n][:-1]
            a, b = _bucket_links(np.cumsum(new), c["fp"].astype(np.int64).view(np.uint64), c["own"], c["i"] != c["j"], distance)
            return pa.RecordBatch.from_arrays([pa.array(c["node"][a]), pa.array(c["node"][b])], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            last = {n: t.column(n)[-1].as_py() for n in _CELL} if t.num_rows else {}
            # the last bucket may go on in the next batch
            open_rows = np.logical_and.reduce([t.column(n).to_numpy() == v for n, v in last.items()]) if last else np.zeros(0, bool)
            first = len(open_rows) - int(open_rows.sum())
            held = t.slice(first)
            if first:
                yield links(t.slice(0, first))
        if held is not None and held.num_rows:
            yield links(held)

    return met.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(run, "a long, b long").distinct()


def near_links(fps: DataFrame, distance: int = DISTANCE, node: str = "fp") -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp``, by their ``node``, within ``distance`` bits that connect as all such links do."""
    plan = plan_search(fps, distance)
    probes = fps.select(F.col(node).alias("node"), "fp", F.explode(_probes(plan)).alias("x"))
    return bucket_links(probes.select("x.part", "x.value", "node", "fp"), distance)


def near_classes(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of rows (doc_id, fp)."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(distinct.select("fp"), distance))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(ids, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fps = materialise(fingerprints(docs, width=3))
    return near_classes(fps).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- similarity of shingle sets ------------------------------------------------

SIMILARITY = 0.8
SHINGLE = 5
#: SimHash bits within which the pigeonhole search finds all pairs of sets; more cost rows and pairs (README).
NEAR_DISTANCE = 8
#: For pairs further apart: buckets a document is put in, each by so many least hashes: at similarity 0.8
#: two documents share none with a chance of (1 - 0.8 ** 5) ** 20 = 0.0004.
BANDS, BAND_HASHES = 20, 5
#: SimHash bits in which documents of similarity 0.8 may differ: 9.7 are expected, with a deviation of 2.9.
WIDE_DISTANCE = 24
#: Shingle sets that one task compares at once from each of two blocks, and their bytes, about.
BLOCK_SETS, BLOCK_BYTES = 512, 48_000_000


def shingle_set(text: str | None, width: int = SHINGLE) -> tuple[int, np.ndarray]:
    """The SimHash of a text's distinct shingles, and their hashes in order.

    How often a shingle is repeated counts in neither, so the bits differ as the sets do.
    """
    digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles(text, width)])
    hashes = np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))
    raw = hashes.astype(">u8").tobytes()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(raw), 65536):
        ones += np.unpackbits(np.frombuffer(raw[i : i + 65536], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big"), hashes


def _set_name(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def signatures(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, row_hash, node, fp, size, bands) of rows (doc_id, row_hash, text).

    ``node`` names the set of ``size`` shingles; ``bands`` are hashes of its least hashes.
    """

    def run(batches):
        random = np.random.default_rng(5)
        flips = random.integers(0, 2**63, (BANDS * BAND_HASHES, 1)).astype(np.uint64)
        odd = random.integers(0, 2**63, (BANDS * BAND_HASHES, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        mix = random.integers(0, 2**63, BAND_HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            nodes, fps, sizes, bands = [], [], [], []
            for text in batch.column(2):
                fp, hashes = shingle_set(text.as_py(), width)
                fps.append(fp)
                nodes.append(_set_name(hashes))
                sizes.append(len(hashes))
                least = np.full((BANDS * BAND_HASHES, 1), np.uint64(2**64 - 1))
                for i in range(0, len(hashes), 4096):
                    least = np.minimum(least, ((hashes[i : i + 4096] ^ flips) * odd).min(axis=1, keepdims=True))
                mixed = (least.reshape(BANDS, BAND_HASHES) * mix).sum(axis=1, dtype=np.uint64)
                bands.append((mixed ^ (mixed >> np.uint64(31))).view(np.int64) if len(hashes) else np.empty(0, np.int64))
            offsets = np.append(0, np.cumsum([len(b) for b in bands])).astype(np.int32)
            flat = pa.array(np.concatenate([*bands, np.empty(0, np.int64)]))
            as_long = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *as_long, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                ["doc_id", "row_hash", "node", "fp", "size", "bands"],
            )

    schema = "doc_id long, row_hash long, node long, fp long, size long, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), "row_hash", "text").mapInArrow(run, schema)


def set_links(nodes: DataFrame, distance: int = NEAR_DISTANCE) -> DataFrame:
    """Links (a, b) of rows (node, fp) that connect as do all pairs within ``distance`` bits, by the pigeonhole search."""
    fps = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(fps, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return near_links(fps, distance, "first").unionByName(same)


def verified_links(sets: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """Links (a, b) of nodes of one group whose shingle sets have that Jaccard similarity, as spanning forests.

    ``sets`` are (group, node, text), a row a node. A group of over
    ``BLOCK_SETS`` nodes or ``BLOCK_BYTES`` is cut into blocks, and pairs of
    blocks are compared.
    """

    def hashed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingle_set(t.as_py(), width)[1] for t in part.column(2)]
                right = np.array([_set_name(h) for h in found], np.uint64).view(np.int64) == part.column(1).to_numpy()
                part = part.filter(pa.array(right))
                packed = pa.array([h.tobytes() for h, ok in zip(found, right) if ok], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], ["group", "node", "hashes"])

    rows = sets.select("group", "node", "text").mapInArrow(hashed, "group long, node long, hashes binary")
    rows = materialise(rows.dropDuplicates(["group", "node"]))
    many, large = F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum(F.octet_length("hashes")) / BLOCK_BYTES)
    # no more blocks than sets
    sizes = rows.groupBy("group").agg(F.greatest(F.lit(1), F.least(F.count(F.lit(1)), F.greatest(many, large))).cast("int").alias("n"))
    cut = rows.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "hashes"
    )

    def run(t: pa.Table) -> pa.Table:
        nodes, own = t.column("node").to_numpy(), t.column("own").to_numpy()
        each = [np.frombuffer(h, np.uint64) for h in t.column("hashes").to_pylist()]
        lengths = np.array([len(h) for h in each])
        codes = np.unique(np.concatenate(each), return_inverse=True)[1]
        starts = np.append(0, np.cumsum(lengths)[:-1])
        held = np.zeros(codes.max() + 1 if len(codes) else 1, np.int64)

        def near(i, waiting):
            mine = codes[starts[i] : starts[i] + lengths[i]]
            held[mine] = 1
            shared = np.add.reduceat(held[codes], starts)[waiting]
            held[mine] = 0
            return shared >= similarity * (lengths[waiting] + lengths[i] - shared) - 1e-9

        apart = t.column("i")[0] != t.column("j")[0]
        a, b = spanning_forest(len(nodes), own if apart else None, near)
        return pa.table([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    # dealt by pairs of blocks; else those of one group would stay in one task
    return met.repartition("group", "i", "j").groupBy("group", "i", "j").applyInArrow(run, "a long, b long").distinct()


def similar_classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """(doc_id, row_hash, node, first_id, first_hash) of rows (doc_id, row_hash, text).

    Documents whose shingle sets are linked by similarity form a class, named
    by its least (doc_id, row_hash). Candidate groups are linked by the
    pigeonhole search over SimHashes and, for pairs beyond its distance, by
    shared buckets; the sets themselves decide. Texts without words are alike.
    """
    marked = materialise(signatures(docs, width))
    least = F.min(F.struct("doc_id", "row_hash")).alias("least")
    nodes = materialise(marked.groupBy("node").agg(least, *[F.first(c).alias(c) for c in ("fp", "size", "bands")]))
    # a smaller set is no other's like, even if it lacks one shingle of it only
    sets = nodes.filter(F.col("size") >= similarity * (F.col("size") + 1) - 1e-9)
    banded = sets.select("node", "fp", F.posexplode("bands").alias("part", "value"))
    links = set_links(sets.select("node", "fp")).unionByName(bucket_links(banded, WIDE_DISTANCE))
    groups = materialise(connected_components(links))
    wanted = groups.join(nodes, "node").select("node", F.col("root").alias("group"), F.col("least.doc_id").alias("_id"), F.col("least.row_hash").alias("_hash"))
    found = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]) & (docs["row_hash"] == wanted["_hash"]))
    classes = connected_components(verified_links(found.select("group", "node", "text"), similarity, width))
    named = nodes.join(classes, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias("first"))
    of_node = named.join(firsts, "root").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.row_hash").alias("first_hash"))
    return marked.select("doc_id", "row_hash", "node").join(of_node, "node").select("doc_id", "row_hash", "node", "first_id", "first_hash")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each class of similar texts: the one of the least (doc_id, row hash)."""
    need = ["doc_id", "text"]
    keyed = packed(docs, need).withColumn("row_hash", F.xxhash64(*need, "_rest"))
    classes = similar_classes(keyed.select("doc_id", "row_hash", "text"), similarity, width)
    kept = classes.select(F.col("first_id").alias("_id"), F.col("first_hash").alias("_hash")).distinct()
    found = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["_id"]) & (keyed["row_hash"] == kept["_hash"]), "left_semi")
    return unpacked(found.dropDuplicates(["doc_id", "row_hash"]), docs.columns, need)
