"""Token ids in bit-packed files.

Layout of a folder: ``blocks`` holds rows (shard, block, first, n_ids, bits,
doc_ids, doc_lens, payload). A block is a run of whole documents; it is closed
once it has ``block_ids`` ids. ``payload`` stores each id in ``bits`` bits, the
fewest that hold the vocabulary, lowest bit first and without gaps, so id i is
at bit i * bits: one numpy call unpacks a block and ``ids_at`` reads a range of
it. ``first`` is the block's offset in its shard; ``shards`` holds each shard's
number of ids and the offset of its first id among all ids.

Defined results: documents lie in ascending (doc_id, text), a null doc_id
first; a null text counts as empty and has the end id only; repeated rows are
all kept; other columns are ignored; no rows give an empty folder.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered_ids, per_worker, scratch, shuffle_partitions, table, text_slices

BLOCK_IDS = 65_536
#: Distinct words that a Python worker keeps ids of.
CACHED_WORDS = 300_000
#: Text that is encoded at once, about; its ids take several times the room.
ENCODED_BYTES = 3_000_000
#: Runs of letters that are one text for the library.
TOGETHER = 128


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Unsigned 32-bit ids in ``bits`` bits each."""
    wide = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return wide[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def ids_at(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """Ids start..start+n of a block, reading only the bytes that hold them."""
    low, high = start * bits // 8, -(-(start + n) * bits // 8)
    raw = np.frombuffer(payload, np.uint8)[low:high]
    wide = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        wide[:, : bits // 8] = raw.reshape(n, bits // 8)
    elif n:
        skip = start * bits - low * 8
        each = np.unpackbits(raw, bitorder="little")[skip : skip + n * bits].reshape(n, bits)
        packed = np.packbits(each, axis=1, bitorder="little")
        wide[:, : packed.shape[1]] = packed
    return wide.view("<u4").reshape(-1)


def _safe_letters() -> str:
    """Letters below U+0530 that composing leaves alone and whose lower case is one such letter, as a regex class body.

    No combining mark is among them, so a word of these and ASCII characters
    is parted alike before and after the tokenizer's normalising.
    """

    def stays(c: str) -> bool:
        low = c.lower()
        return c.isalpha() and len(low) == 1 and low.isalpha() and all(unicodedata.is_normalized("NFC", x) and not unicodedata.combining(x) for x in (c, low))

    good = [i for i in range(0x80, 0x530) if stays(chr(i))]
    starts = [i for i in good if i - 1 not in good]
    ends = [i for i in good if i + 1 not in good]
    return "A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


def word_encoder(path: str, own: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Texts to 32-bit ids by a tokenizers file: all ids, and how many each text has.

    Words go to ``own``, if given, else to the library.

    For tokenizers that put text into NFC and lower case, drop white space,
    and part runs of letters from all else (but after an apostrophe). A text's
    ids are then those of its words between ASCII white space. Each distinct
    word is encoded once and remembered for a while. Words of ASCII and such
    letters as normalising can't join to others are parted further; all others
    go to the library as they are.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
    ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    letters = _safe_letters()
    # a comma or stop after a letter, digit or blank begins a token; ASCII case folds alike but before a combining mark
    special = rf"<\||[^0-9{letters}\s][.,]|[A-Z][^\x00-\x7F{letters}]"
    plain = re.compile(rf"[\x21-\x26\x28-\x7e{letters}]+")
    parts_of = re.compile(f"[{letters}]+|[^{letters}]+")
    starts_letter = re.compile(f"[{letters}]")
    known: dict[str, int] = {}
    held = [np.empty(0, "<u4")]  # ids of the known words, one after the other, in runs
    sizes = [np.empty(0, np.int64)]

    def keep(words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        known.update(zip(words, range(len(known), len(known) + len(words))))
        held.append(ids)
        sizes.append(counts)

    def merged() -> tuple[np.ndarray, np.ndarray]:
        held[:], sizes[:] = [np.concatenate(held)], [np.concatenate(sizes)]
        return held[0], sizes[0]

    def alone(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)

    def together(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters in few calls, parted where a token ends a word."""
        lines = [" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        found = [e.ids for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.array([i for line in found for i in line], "<u4")
        ends = np.flatnonzero(ends_word[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return alone(words)
        return ids, np.diff(ends, prepend=0)

    def learn(words: pa.Array) -> None:
        whole = pc.match_substring_regex(words, f"^[{letters}]+$")
        runs, others, mixed = dict.fromkeys(words.filter(whole).to_numpy(zero_copy_only=False)), {}, []
        for w in words.filter(pc.invert(whole)).to_numpy(zero_copy_only=False):
            if not plain.fullmatch(w) or "<|" in w:
                others[w] = None
                continue
            parts = parts_of.findall(w)
            if len(parts) > 1:
                mixed.append((w, parts))
            for p in parts:
                if p not in known:
                    (runs if starts_letter.match(p) else others)[p] = None
        for group, encode_ in ((list(runs), own or together), (list(others), own or alone)):
            if group:
                keep(group, *encode_(group))
        if mixed:
            counts = np.array([len(parts) for _, parts in mixed])
            at = np.array([known[p] for _, parts in mixed for p in parts])
            keep([w for w, _ in mixed], *gathered_ids(at, counts, *merged()))

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, special)
        apart = pc.ascii_lower(pc.replace_substring(pc.replace_substring(texts, ",", " ,"), ".", " ."))
        lists = pc.ascii_split_whitespace(pc.if_else(odd, texts, apart) if pc.any(odd).as_py() else apart)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False)
        at = np.fromiter(map(known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new):
            learn(words.dictionary.take(pa.array(new)))
            at[new] = [known[w] for w in distinct[new]]
        ids, counts = merged()
        found = gathered_ids(at[words.indices.to_numpy()], lists.value_lengths().to_numpy(), ids, counts)
        if len(known) > CACHED_WORDS:  # those of the last texts stay
            known.clear()
            held.clear(), sizes.clear()
            keep(distinct.tolist(), *gathered_ids(at, np.ones(len(at), np.int64), ids, counts))
        return found

    return encode


def encoded(batches: Iterator[pa.RecordBatch], encode) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of batches (doc_id, text), some texts at a time."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        for at, texts in text_slices(batch.column(1), ENCODED_BYTES):
            ids, counts = encode(texts)
            ends = np.cumsum(counts).tolist()
            for i, (start, end) in enumerate(zip([0, *ends], ends)):
                yield names[at + i], ids[start:end]
            pa.default_memory_pool().release_unused()


_BLOCKS = "shard int, block int, first long, n_ids int, bits int, doc_ids array<long>, doc_lens array<int>, payload binary"


def write_token_files(
    docs: DataFrame,
    path: str,
    make_encoder: Callable[[], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]],
    vocab_size: int,
    end_id: int,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write rows (doc_id, text) as token files at ``path``; one shard for each range of doc_id."""
    bits = max(1, int(max(vocab_size - 1, end_id)).bit_length())
    end = np.array([end_id], "<u4")

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = make_encoder(), TaskContext.get().partitionId()
        first, block = 0, 0
        names: list = []
        lens: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            row = [shard, block, first, len(ids), bits, list(names), list(lens), pack(ids, bits)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in _BLOCKS.split(", ")])

        for name, ids in encoded(batches, encode):
            names.append(name)
            lens.append(len(ids) + 1)
            parts += [ids, end]
            held += len(ids) + 1
            if held >= block_ids:
                yield closed()
                first, block, held = first + held, block + 1, 0
                names, lens, parts = [], [], []
        if names:
            yield closed()

    spark = docs.sparkSession
    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )
    ordered.mapInArrow(to_blocks, _BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    # a row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    shards.withColumn("shard_first", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path}/shards")


def token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks at ``path`` with ``start``, the offset of their first id among all ids."""
    shards = spark.read.parquet(f"{path}/shards").select("shard", "shard_first")
    blocks = spark.read.parquet(f"{path}/blocks")
    return blocks.join(shards, "shard").withColumn("start", F.col("first") + F.col("shard_first")).drop("shard_first")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of batches (start, n_ids, bits, doc_ids, doc_lens, payload)."""
    for batch in batches:
        for i in range(batch.num_rows):
            start, n_ids, bits, names, lens, payload = (batch.column(c)[i].as_py() for c in range(6))
            ids, at = ids_at(payload, bits, 0, n_ids), 0
            for name, n in zip(names, lens):
                yield name, start + at, ids[at : at + n]
                at += n


_READ = ["start", "n_ids", "bits", "doc_ids", "doc_lens", "payload"]


def _read(spark: SparkSession, path: str, last: str, value: Callable, kind: pa.DataType) -> DataFrame:
    name = last.split()[0]

    def rows(batches):
        held: list = []

        def out():
            columns = list(zip(*held))
            types = (pa.int64(), pa.int64(), pa.int64(), kind)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "start", "n_tokens", name])

        size = 0
        for doc_id, start, ids in _documents(batches):
            held.append((doc_id, start, len(ids), value(ids)))
            size += len(ids)
            if len(held) >= 5000 or size > 2_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return token_blocks(spark, path).select(*_READ).mapInArrow(rows, f"doc_id long, start long, n_tokens long, {last}")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document."""
    return _read(spark, path, "ids array<int>", lambda ids: ids.astype(np.int32), pa.list_(pa.int32()))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the crc32 of the ids as little-endian 32-bit integers."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tokenizers import Tokenizer

    path, name = scratch(spark), public_tokenizers.path("word_bpe_49k.json")
    size = Tokenizer.from_file(name).get_vocab_size(with_added_tokens=True)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    write_token_files(docs, path, lambda: per_worker(("words", name), lambda: word_encoder(name)), size, end_id=2)
    return read_digests(spark, path)
