"""BPE encoding by speculation, and decoding.

Merging by rank leaves pieces t1 .. tn as they are exactly if it makes each of
them from its own symbols and leaves each two neighbours apart. So a word is
first cut greedily, the longest piece at each place, and all pairs of neighbours
of all words are then tested at once: going back in time from both pieces to
single symbols, no two parts that faced each other may have had a merge that
came before the next merge of either. Words with a pair that fails are merged
symbol by symbol in the order of ranks; all others are done. Pieces that
merging never makes from their own symbols aren't proposed.

Words are runs of bytes, the last of which is a symbol of its own (``</w>``).
Each distinct word is encoded once and remembered for a while. A file's
normaliser, its rule for parting words and its special tokens are the
tokenizers library's; merging isn't.

Defined results: a null or empty text has no ids and decodes to an empty text;
strings of special tokens inside texts become their ids, as in the library;
repeated rows are all kept; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import IdTable, packed, per_worker, table, text_slices, unpacked
from .token_files import ENCODED_BYTES, word_encoder

#: Symbols: a byte, or the byte that ends a word.
SYMBOLS = 512
END = "</w>"
_NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if it shows, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class BpeCodec:
    """Encoder and decoder for a tokenizers file of byte-level BPE whose words end in ``</w>``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain BPE with words that end in </w> is known here")
        self.library = Tokenizer.from_file(path)
        vocabulary, letters = model["vocab"], byte_letters()
        try:
            self.symbol_ids = np.array([vocabulary[c + end] for end in ("", END) for c in letters], np.int32)
        except KeyError as e:
            raise ValueError(f"the vocabulary lacks the symbol {e}") from None
        self.bytes_of_letters = {ord(c): chr(b) for b, c in enumerate(letters)}
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special, self.special_strings = special, re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        strings = dict(sorted((i, s) for s, i in (vocabulary | special).items()))
        self.size = max(strings) + 1
        self.strings = pa.array([strings.get(i, "") for i in range(self.size)], pa.large_string())
        self.joined = pa.array([strings.get(i, "") + " " for i in range(self.size)], pa.large_string())
        self._build([p.split(" ") if isinstance(p, str) else p for p in model["merges"]], vocabulary)

    # --- tables

    def _build(self, merges: list, vocabulary: dict[str, int]) -> None:
        n = self.size
        #: The rank of the merge that makes a piece (-1: a symbol), and the two parts it is made of.
        self.made, self.halves = np.full(n, -1, np.int64), np.full((n, 2), -1, np.int64)
        pairs = np.array([[vocabulary[a], vocabulary[b], vocabulary[a + b]] for a, b in merges], np.int64).reshape(-1, 3)
        twice = np.zeros(n, bool)  # pieces that more than one merge makes are left to merging
        for rank, (a, b, ab) in enumerate(pairs.tolist()):
            twice[ab] |= self.made[ab] >= 0
            self.made[ab], self.halves[ab] = rank, (a, b)
        self.ranks = IdTable(pairs[:, 0] * n + pairs[:, 1], np.arange(len(pairs)))
        self.rank_of = {(a, b): (rank, ab) for rank, (a, b, ab) in enumerate(pairs.tolist())}
        ends = np.zeros(n, bool)
        ends[pairs[:, 2]] = True
        whole = np.flatnonzero(ends)
        alone = np.zeros(n, bool)
        alone[whole] = self._apart(self.halves[whole, 0], self.halves[whole, 1], self.made[whole]) & ~twice[whole]
        alone[self.symbol_ids] = True
        spelled: dict[int, tuple[int, ...]] = {i: (s,) for s, i in enumerate(self.symbol_ids.tolist())}
        for a, b, ab in pairs.tolist():
            alone[ab] &= alone[a] and alone[b]
            if a in spelled and b in spelled:
                spelled[ab] = spelled[a] + spelled[b]
        nodes, keys, piece_at = {(): 0}, [], [-1]
        for piece, symbols in spelled.items():
            if not alone[piece]:
                continue
            for k in range(1, len(symbols) + 1):
                if symbols[:k] not in nodes:
                    nodes[symbols[:k]] = len(nodes)
                    keys.append(nodes[symbols[: k - 1]] * SYMBOLS + symbols[k - 1])
                    piece_at.append(-1)
            piece_at[nodes[symbols]] = piece
        self.children = IdTable(np.array(keys), np.arange(1, len(nodes)))
        self.firsts = self.children.get(np.arange(SYMBOLS))
        self.piece_of_node = np.array(piece_at, np.int64)

    def _apart(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging keeps the parts of each left and right piece apart, at the ranks before ``before``."""
        ok, row = np.ones(len(left), bool), np.arange(len(left))
        left, right = left.astype(np.int64), right.astype(np.int64)
        until_left = np.full(len(left), _NEVER) if before is None else before.astype(np.int64)
        until_right = until_left.copy()
        while len(row):
            rank = self.ranks.get(left * self.size + right).astype(np.int64)
            # of equal merges the leftmost is made first
            crossed = (rank >= 0) & (rank < until_left) & (rank <= until_right)
            if before is not None:
                crossed &= rank < before[row]
            ok[row[crossed]] = False
            of_left, of_right = self.made[left], self.made[right]
            on = ~crossed & ((of_left >= 0) | (of_right >= 0))
            row, left, right, of_left, of_right = row[on], left[on], right[on], of_left[on], of_right[on]
            until_left, until_right = until_left[on], until_right[on]
            late = of_left > of_right  # the left part was made last
            until_left, until_right = np.where(late, of_left, until_left), np.where(late, until_right, of_right)
            left, right = np.where(late, self.halves[left, 1], left), np.where(late, right, self.halves[right, 0])
        return ok

    # --- encoding

    def _longest(self, symbols: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest piece that begins at each place, and its symbols; ``end`` is where the place's word ends."""
        piece, length = self.symbol_ids[symbols].astype(np.int64), np.ones(len(symbols), np.int64)
        row, node, far = np.arange(len(symbols)), self.firsts[symbols], 0
        while len(row):
            far += 1
            inside = row + far < end[row]
            row, node = row[inside], node[inside]
            node = self.children.get(node.astype(np.int64) * SYMBOLS + symbols[row + far])
            row, node = row[node >= 0], node[node >= 0]
            found = self.piece_of_node[node]
            some = np.flatnonzero(found >= 0)
            piece[row[some]], length[row[some]] = found[some], far + 1
        return piece, length

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of the normalised text, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        stop = np.cumsum(sizes)
        start = stop - sizes
        symbols[stop[sizes > 0] - 1] += 256
        piece, length = self._longest(symbols, np.repeat(stop, sizes))
        begins = np.zeros(len(symbols), bool)
        at, to = start[sizes > 0], stop[sizes > 0]
        while len(at):
            begins[at] = True
            at = at + length[at]
            at, to = at[at < to], to[at < to]
        ids, word = piece[begins], np.repeat(np.arange(len(words)), sizes)[begins]
        counts = np.bincount(word, minlength=len(words))
        pair = np.flatnonzero(word[1:] == word[:-1])
        keys, where = np.unique(ids[pair] * self.size + ids[pair + 1], return_inverse=True)
        apart = self._apart(keys // self.size, keys % self.size)[where]
        failing = np.unique(word[pair[~apart]])
        if not len(failing):
            return ids.astype("<u4"), counts
        merged = {w: self.merge(symbols[start[w] : stop[w]]) for w in failing.tolist()}
        first = np.cumsum(counts) - counts
        counts_now = counts.copy()
        counts_now[failing] = [len(merged[w]) for w in failing.tolist()]
        first_now = np.cumsum(counts_now) - counts_now
        out = np.empty(int(counts_now.sum()), "<u4")
        good = np.ones(len(words), bool)
        good[failing] = False
        kept = np.flatnonzero(good[word])
        out[first_now[word[kept]] + kept - first[word[kept]]] = ids[kept]
        for w, found in merged.items():
            out[first_now[w] : first_now[w] + len(found)] = found
        return out, counts_now

    def merge(self, symbols: np.ndarray) -> list[int]:
        """The ids of one word by its merges, the best rank and then the leftmost first."""
        ids = self.symbol_ids[symbols].tolist()
        n, known = len(ids), self.rank_of
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(known[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in known]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # a part has been merged since
            ids[i], ids[j] = known[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (ids[x], ids[y]) in known:
                    heapq.heappush(heap, (known[ids[x], ids[y]][0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def words_of(self, text: str) -> list[bytes | int]:
        """A text's words as the file's normaliser and its parting rule give them, and ids of special tokens."""
        out: list[bytes | int] = []
        for part in self.special_strings.split(text) if self.special_strings else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                out += [w.translate(self.bytes_of_letters).encode("latin-1") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and how many each has."""
        words, owners, special = [], [], []
        for i, text in enumerate(texts):
            for w in [text.encode()] if text.isascii() and text.isalpha() and text.islower() else self.words_of(text):
                special.append(w if isinstance(w, int) else -1)
                words.append(b"" if isinstance(w, int) else w)
                owners.append(i)
        ids, counts = self.encode_words(words)
        given = np.array(special, np.int64)
        at = np.flatnonzero(given >= 0)
        if len(at):
            ids = np.insert(ids, (np.cumsum(counts) - counts)[at], given[at])
            counts[at] = 1
        return ids, np.bincount(owners, counts, len(texts)).astype(np.int64) if owners else np.zeros(len(texts), np.int64)

    # --- decoding

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """The library's text of each run of ids, special tokens included, in UTF-8."""
        ends = np.cumsum(counts)
        if self.library.decoder is not None:
            for a, b in zip(ends - counts, ends):
                yield self.library.decode(ids[a:b].tolist(), skip_special_tokens=False).encode()
            return
        spelled = self.joined.take(pa.array(ids.astype(np.int64)))
        edges = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset : spelled.offset + len(ids) + 1]
        raw = memoryview(spelled.buffers()[2] or b"")
        for a, b in zip((ends - counts).tolist(), ends.tolist()):
            yield bytes(raw[edges[a] : edges[b] - 1]) if b > a else b""


def codec(path: str) -> BpeCodec:
    return per_worker(("bpe", path), lambda: BpeCodec(path))


def _encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    return per_worker(("bpe words", path), lambda: word_encoder(path, codec(path).encode_texts))


def _passed(docs: DataFrame, path: str, columns: str, kinds: list[pa.DataType], make: Callable) -> DataFrame:
    """``docs`` with columns that ``make(codec, ids, counts)`` lists for slices of its texts; a column of the same name gives way."""
    need = ["doc_id", "text"]
    made = tuple(c.split()[0] for c in columns.split(", "))
    rows = packed(docs, need)
    names = [*rows.columns, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bpe = _encoder(path), codec(path)
        for batch in batches:
            for at, texts in text_slices(batch.column(1), ENCODED_BYTES):
                ids, counts = encode(texts)
                new = [pa.array(v, k) for v, k in zip(make(bpe, ids, counts), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, *new], names)
                pa.default_memory_pool().release_unused()

    return unpacked(rows.mapInArrow(run, StructType([*rows.schema, *StructType.fromDDL(columns)])), docs.columns, need, made)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``ids array<int>``."""

    def make(bpe, ids, counts):
        edges = np.append(0, np.cumsum(counts))
        return [[ids[a:b].astype(np.int32) for a, b in zip(edges, edges[1:])]]

    return _passed(docs, path, "ids array<int>", [pa.list_(pa.int32())], make)


def decode_documents(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            found = codec(path).decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in found], pa.string())], ["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def document_digests(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with the number of ids and the digests of the ids and of their decoded text, made where the ids are."""

    def make(bpe, ids, counts):
        edges, raw = np.append(0, np.cumsum(counts)), ids.astype("<u4")
        return (
            counts,
            [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(edges, edges[1:])],
            [hashlib.sha256(t).hexdigest() for t in bpe.decode(ids, counts)],
        )

    return _passed(docs, path, _DIGESTS, [pa.int64(), pa.string(), pa.string()], make)


def op11_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return document_digests(docs, public_tokenizers.path("word_bpe_49k.json"))
