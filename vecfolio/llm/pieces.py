"""SentencePiece encoding and decoding by a streaming Viterbi scan.

A text's lattice has an edge for every piece of the model at every place. A
unigram model keeps, for each boundary, the best sum of scores. A BPE model has
merge ranks and not log-probabilities as scores; there a path survives only if
each piece may follow the one before it, that is, if merging the two by rank
leaves them as they are, and of every prefix exactly one path survives. Either
way a boundary depends on as many boundaries before it as the longest piece has
characters. Only a window of that many is scanned at a time; then the
backpointer paths of all boundaries that a later piece can start from are
followed to where they meet, the ids up to there are given out, and the scan
goes on from there alone. So memory doesn't grow with a text, however long a
stretch without blanks is.

No piece holds a blank after another character, so all paths meet at each
blank. The stretches between blanks are scanned side by side, each distinct one
of some megabytes of text once, by numpy; no words are kept for later. A long
stretch is parted where no piece has both neighbours; what is still long is
scanned by itself, character by character.

Defined results: a null or empty text has no ids; characters that the model
lacks become its byte pieces, or its unknown piece if it has none; repeated rows
are all kept; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IdTable, gathered_ids, packed, per_worker, table, text_slices, unpacked

BLANK = "▁"
#: Text that is encoded at once, about; its ids take twice the room.
ENCODED_BYTES = 3_000_000
#: Stretches that are scanned side by side.
LANES = 16_384
#: Longer stretches are scanned by themselves.
LONG_STRETCH = 512
#: Pairs of pieces whose order is remembered.
REMEMBERED_PAIRS = 1 << 20
#: What an unknown character costs below the worst score, as the library has it.
UNKNOWN_PENALTY = 10.0
#: No piece begins here.
_NONE = -2


class PieceCodec:
    """Encoder and decoder for a SentencePiece model file of type unigram or BPE."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kind = type(model.pieces[0])
        self.bpe = model.trainer_spec.model_type == model.trainer_spec.BPE
        normal = model.normalizer_spec
        #: Whether normalising only puts a blank before the text and writes blanks as ``BLANK``.
        self.plain = not normal.precompiled_charsmap and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.vocabulary: dict[str, int] = {}
        self.scores = np.array([p.score for p in model.pieces])
        shown: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        for i, p in enumerate(model.pieces):
            text = p.piece.replace(BLANK, " ").encode()
            if p.type == kind.NORMAL or p.type == kind.USER_DEFINED:
                self.vocabulary[p.piece] = i
            elif p.type == kind.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                text = bytes([int(p.piece[3:5], 16)])
            elif p.type == kind.UNKNOWN:
                self.unknown, text = i, model.trainer_spec.unk_surface.encode()
            else:
                text = b""
            shown.append(text)
        #: The bytes that each id stands for, one after the other.
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_sizes = np.array([len(x) for x in shown], np.int64)
        self.longest = max(map(len, self.vocabulary))
        self.worst = min(self.scores[i] for i in self.vocabulary.values()) - UNKNOWN_PENALTY
        self.words = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self._build()

    # --- tables

    def _build(self) -> None:
        """The pieces as a prefix tree over numbered characters, and their merges."""
        letters = sorted(set("".join(self.vocabulary)))
        self.letters = len(letters) + 1
        #: Number of a character; 0 is one that the model lacks.
        self.letter = np.zeros(0x110000, np.int16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, self.letters)
        self.alone = np.array([-1] + [self.vocabulary.get(c, -1) for c in letters])
        nodes, keys = {"": 0}, []
        for piece in self.vocabulary:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                    keys.append(nodes[piece[: n - 1]] * self.letters + int(self.letter[ord(piece[n - 1])]))
        self.children = IdTable(np.array(keys), np.arange(1, len(nodes)))
        #: Neighbouring characters in pieces; between any others all paths meet.
        inner = sorted({p[i : i + 2] for p in self.vocabulary for i in range(len(p) - 1)})
        self.inner = IdTable(np.array([int(self.letter[ord(a)]) * self.letters + int(self.letter[ord(b)]) for a, b in inner]), np.zeros(len(inner), np.int64))
        #: The nodes of first characters.
        self.firsts = self.children.get(np.arange(self.letters))
        self.piece_of_node = np.array([self.vocabulary.get(p, -1) for p in nodes], np.int32)
        if not self.bpe:
            return
        n = len(self.scores)
        pairs = [(self.vocabulary[p[:i]] * n + self.vocabulary[p[i:]], piece) for p, piece in self.vocabulary.items() for i in range(1, len(p)) if p[:i] in self.vocabulary and p[i:] in self.vocabulary]
        #: What two pieces make together.
        self.merged = IdTable(*np.array(pairs, np.int64).reshape(-1, 2).T)
        #: The two parts whose merge makes a piece; -1 for a character, or if merging never does.
        self.halves = np.full((n, 2), -1, np.int32)
        self.mergeable = np.ones(n + 1, bool)
        #: The score of the merge that made a piece; a character was there from the beginning.
        self.made = np.full(n, np.inf)
        for piece, i in self.vocabulary.items():
            if len(piece) > 1:
                found = self._last_merge(piece)
                self.mergeable[i] = found is not None
                self.made[i] = self.scores[i]
                if found:
                    self.halves[i] = [self.vocabulary[h] for h in found]
        self.seen = np.full(REMEMBERED_PAIRS, -1, np.int64)
        self.order = np.zeros(REMEMBERED_PAIRS, bool)

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes a piece of two characters or more; None if merging never does."""
        vocabulary, scores, parts = self.vocabulary, self.scores, list(piece)
        while len(parts) > 2:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                made = vocabulary.get(parts[i] + parts[i + 1])
                if made is not None and scores[made] > best:  # leftmost first
                    best, at = scores[made], i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if all(p in vocabulary for p in parts) else None

    # --- merge ranks

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging left + right by rank ends in just these two pieces (left beyond all pieces: in right alone)."""
        key = left.astype(np.int64) * (len(self.scores) + 1) + right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (REMEMBERED_PAIRS - 1)
        new = np.flatnonzero(self.seen[slot] != key)
        ok = self.order[slot]
        if len(new):
            distinct, first, where = np.unique(key[new], return_index=True, return_inverse=True)
            made = self._apart(left[new[first]], right[new[first]])
            ok[new] = made[where]
            self.seen[slot[new[first]]], self.order[slot[new[first]]] = distinct, made
        return ok

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``may_follow`` of distinct pairs.

        Goes back in time from both pieces to characters. The parts that face
        each other at a time were there until one of them was merged on; they
        would have been merged with each other had that had the better rank.
        """
        n = len(self.scores)
        ok = self.mergeable[right]
        row = np.flatnonzero(ok & (left < n))
        left, right = left[row], right[row]
        until = np.full(len(row), -np.inf)  # the score of the merge that ended this state
        also = np.zeros(len(row), bool)
        while len(row):
            both = self.merged.get(left.astype(np.int64) * n + right)
            score = np.where(both >= 0, self.scores[both], -np.inf)
            joined = (both >= 0) & ((score > until) | (also & (score == until)))
            ok[row[joined]] = False
            of_left, of_right = self.made[left], self.made[right]
            on = ~joined & ~(np.isinf(of_left) & np.isinf(of_right))
            row, left, right, of_left, of_right = row[on], left[on], right[on], of_left[on], of_right[on]
            late = of_left < of_right  # the left piece came last
            until, also = np.where(late, of_left, of_right), ~late
            left, right = np.where(late, self.halves[left, 1], left), np.where(late, right, self.halves[right, 0])
        return ok

    # --- the scan

    def _window(self, chars: np.ndarray, base: np.ndarray, rest: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, length) that end at each boundary of a window, for stretches side by side.

        A stretch goes on at ``base`` after the piece ``left`` and has ``rest``
        characters. A piece of -1 is an unknown character; length 0 marks a
        boundary that no path reaches. Pieces start in the first ``longest``
        places, or in the first two times as many if the stretch ends there.
        """
        n, wide, none = len(base), 2 * self.longest, len(self.scores)
        piece, back = np.full((n, wide + 1), none, np.int32), np.zeros((n, wide + 1), np.int8)
        piece[:, 0], back[:, 0] = left, 1
        value = None if self.bpe else np.where(np.arange(wide + 1) == 0, 0.0, np.full((n, 1), -np.inf))
        stop = np.where(rest <= wide, rest, self.longest)
        for start in range(int(stop.max(initial=0))):
            live = np.flatnonzero((stop > start) & (back[:, start] > 0))
            row, node = live, np.zeros(len(live), np.int64)
            for length in range(1, self.longest + 1):
                inside = rest[row] >= start + length
                row, node = row[inside], node[inside]
                following = chars[base[row] + (start + length - 1)]
                node = self.children.get(node * self.letters + following) if length > 1 else self.firsts[following]
                row, node = row[node >= 0], node[node >= 0].astype(np.int64)
                if not len(row):
                    break
                found, end = self.piece_of_node[node], start + length
                if self.bpe:
                    some = np.flatnonzero((found >= 0) & (back[row, end] == 0))
                    some = some[self.may_follow(piece[row[some], start], found[some])]
                else:
                    score = value[row, start] + self.scores[found]
                    some = np.flatnonzero((found >= 0) & (score > value[row, end]))
                    value[row[some], end] = score[some]
                piece[row[some], end], back[row[some], end] = found[some], length
            odd = live[self.alone[chars[base[live] + start]] < 0]
            if not self.bpe:
                score = value[odd, start] + self.worst
                odd = odd[score > value[odd, start + 1]]
                value[odd, start + 1] = value[odd, start] + self.worst
            odd = odd[back[odd, start + 1] == 0] if self.bpe else odd
            piece[odd, start + 1], back[odd, start + 1] = none, 1
        return piece, back

    @staticmethod
    def _meeting(back: np.ndarray, longest: int) -> np.ndarray:
        """The last boundary on the paths of all boundaries after the first ``longest`` places."""
        at = np.where(back[:, longest:] > 0, np.arange(longest, back.shape[1]), -1)
        at = np.where(at < 0, at.max(axis=1, keepdims=True), at)
        rows = np.arange(len(at))
        while True:
            latest = at.max(axis=1)
            if (at == latest[:, None]).all():
                return latest
            step = np.where(at.min(axis=1) < latest, back[rows, latest], 0)
            at -= np.where(at == latest[:, None], step[:, None], 0)

    def scan(self, chars: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """For each character the piece that begins there (-1: unknown), or ``_NONE``.

        ``chars`` are the numbered characters of stretches that begin at ``base`` and have ``rest`` of them.
        """
        begun = np.full(len(chars), _NONE, np.int32)
        base, left = base.copy(), np.full(len(base), len(self.scores), np.int32)
        while len(base):
            piece, back = self._window(chars, base, rest, left)
            met = rest.copy()
            more = np.flatnonzero(rest > 2 * self.longest)
            if len(more):
                met[more] = self._meeting(back[more], self.longest)
                for i in more[met[more] == 0]:  # paths that don't meet for long
                    self._slowly(chars, int(base[i]), int(rest[i]), int(left[i]), begun)
                    rest[i] = 0
            row, at = np.arange(len(base)), np.where(rest > 0, met, 0)
            while True:
                row, at = row[at > 0], at[at > 0]
                if not len(row):
                    break
                size = back[row, at]
                made = piece[row, at]
                at = at - size
                begun[base[row] + at] = np.where(made == len(self.scores), -1, made)
            on = np.flatnonzero(rest > met)
            left, base, rest = piece[on, met[on]], base[on] + met[on], rest[on] - met[on]
        return begun

    def _slowly(self, chars: np.ndarray, base: int, rest: int, left: int, begun: np.ndarray) -> None:
        """The scan of one stretch, a character at a time."""
        children, value_of = self.children, self.scores
        none, end, done = len(self.scores), 0, 0
        piece, back, value = {0: left}, {0: 0}, {0: 0.0}
        walks: list[tuple[int, int]] = []  # starts, and the nodes of what follows them
        orders: dict[int, bool] = {}

        def path(to: int) -> None:
            while to > done:
                to, made = back[to], piece[to]
                begun[base + to] = -1 if made == none else made

        for c in chars[base : base + rest].tolist():
            walks = [*walks, (end, 0)] if end in piece else walks
            nodes = children.get(np.array([n for _, n in walks], np.int64) * self.letters + c)
            walks = [(s, n) for (s, _), n in zip(walks, nodes.tolist()) if n >= 0]
            end += 1
            best = None
            for start, node in walks:  # the earliest first
                found = int(self.piece_of_node[node])
                if found < 0:
                    continue
                if self.bpe:
                    key = piece[start] * (none + 1) + found
                    if key not in orders:
                        if len(orders) > 100_000:
                            orders.clear()
                        orders[key] = bool(self.may_follow(np.array([piece[start]]), np.array([found]))[0])
                    if orders[key]:
                        best = (start, found, 0.0)
                        break
                else:
                    score = value[start] + value_of[found]
                    if best is None or score > best[2]:
                        best = (start, found, score)
            if self.alone[c] < 0 and end - 1 in piece:
                score = value[end - 1] + self.worst
                if best is None or not self.bpe and score > best[2]:
                    best = (end - 1, none, score)
            if best:
                back[end], piece[end], value[end] = best
            # boundaries that a later piece can start from, or that one already began at
            at = {s for s, _ in walks} | ({end} if best else set())
            if len(at) > 1 and end % 4:
                continue  # look for a meeting point now and then
            while len(at) > 1 and max(at) > done:
                latest = max(at)
                at = (at - {latest}) | {back[latest]}
            met = max(min(at, default=done), done)
            if met > done and len(at) == 1:
                path(met)
                done = met
                for b in [b for b in piece if b < min([done, *(s for s, _ in walks)])]:
                    del piece[b], back[b], value[b]
        path(end)

    # --- ids

    def _parted(self, chars: np.ndarray, bases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where stretches begin and their sizes, long ones parted wherever no piece has both neighbours."""
        first, size = [bases], [sizes.copy()]
        for i in np.flatnonzero(sizes > LONG_STRETCH):
            own = chars[bases[i] : bases[i] + sizes[i]].astype(np.int64)
            at = np.append(0, np.flatnonzero(self.inner.get(own[:-1] * self.letters + own[1:]) < 0) + 1)
            first.append(bases[i] + at[1:])
            size.append(np.diff(np.append(at, sizes[i]))[1:])
            size[0][i] = at[1] if len(at) > 1 else sizes[i]
        first, size = np.concatenate(first), np.concatenate(size)
        order = np.argsort(first, kind="stable")
        return first[order], size[order]

    def _encode(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct stretches, one after the other, and how many each has."""
        sizes = pc.utf8_length(stretches).to_numpy().astype(np.int64)
        raw = np.frombuffer("".join(stretches.to_numpy(zero_copy_only=False)).encode("utf-32-le"), np.uint32)
        chars = self.letter[raw]
        ends = np.cumsum(sizes)
        bases = ends - sizes
        begun = np.full(len(chars), _NONE, np.int32)
        first, size = self._parted(chars, bases, sizes)
        usual = np.flatnonzero((size > 0) & (size <= LONG_STRETCH))
        for at in range(0, len(usual), LANES):
            some = usual[at : at + LANES]
            low, high = int(first[some[0]]), int(first[some[-1]] + size[some[-1]])
            found = self.scan(chars[low:high], first[some] - low, size[some])
            part = begun[low:high]
            part[found != _NONE] = found[found != _NONE]
        for i in np.flatnonzero(size > LONG_STRETCH):
            self._slowly(chars, int(first[i]), int(size[i]), len(self.scores), begun)
        where = np.flatnonzero(begun != _NONE)
        ids, each = begun[where], np.ones(len(where), np.int64)
        odd = np.flatnonzero(ids < 0)
        if len(odd) and self.byte_ids:
            spelled = [chr(x).encode() for x in raw[where[odd]]]
            each[odd] = [len(s) for s in spelled]
            ids = np.repeat(ids, each)
            ids[ids < 0] = [self.byte_ids[b] for s in spelled for b in s]
        else:
            ids = np.where(ids < 0, self.unknown, ids)
        upto = np.append(0, np.cumsum(each))[np.searchsorted(where, np.append(0, ends))]
        return ids, np.diff(upto)

    def _of_words(self, words: pa.Array, counts: np.ndarray, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        words = words.dictionary_encode()
        distinct = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (prefix, words.dictionary, "")))
        return gathered_ids(words.indices.to_numpy(), counts, *self._encode(distinct))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (none null), one after the other, and how many each has.

        Texts with single blanks inside only are parted by Arrow, others by the library's normaliser.
        """
        odd = pc.match_substring_regex(texts, f"^ |  |{BLANK}|^$").to_numpy(zero_copy_only=False) if self.plain else np.ones(len(texts), bool)
        usual = texts.filter(pa.array(~odd)) if odd.any() else texts
        lists = pc.split_pattern(usual, " ")
        ids, counts = self._of_words(lists.flatten(), lists.value_lengths().to_numpy(), BLANK)
        if not odd.any():
            return ids, counts
        parted = [self.words.findall(self.library.normalize(t)) for t in texts.filter(pa.array(odd)).to_pylist()]
        others, sizes = self._of_words(pa.array([w for p in parted for w in p], pa.large_string()), np.array([len(p) for p in parted]), "")
        each = [iter(np.split(a, np.cumsum(n)[:-1])) if len(n) else None for a, n in ((ids, counts), (others, sizes))]
        found = [next(each[int(o)]) for o in odd]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        return self.encode_all(pa.array([text or ""], pa.large_string()))[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """What the ids of each text stand for, as UTF-8."""
        sizes = self.shown_sizes[ids]
        flat, lengths = gathered_ids(ids, counts, self.shown, self.shown_sizes, sizes)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        if self.prefix:
            some = lengths > 0
            starts[some] += flat[starts[some]] == 32
        raw = flat.tobytes()
        return [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist())]

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        ids = np.asarray(ids, np.int64)
        return self.decode_all(ids, np.array([len(ids)]))[0].decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of their texts, and ``round_trip``: whether decoding gives the text again."""
    columns, docs = docs.columns, packed(docs, ["text"])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(("pieces", model_path), lambda: PieceCodec(model_path))
        for batch in batches:
            for at, texts in text_slices(batch.column(names.index("text")), ENCODED_BYTES):
                part = batch.slice(at, len(texts))
                ids, counts = codec.encode_all(texts)
                back = pa.array(codec.decode_all(ids, counts), pa.large_binary())
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                made = [pa.ListArray.from_arrays(offsets, pa.array(ids)), pc.equal(back, texts.cast(pa.large_binary()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*names, "ids", "round_trip"])
                del texts, part, ids, back, made
                pa.default_memory_pool().release_unused()

    schema = docs.limit(0).withColumn("ids", F.lit(None).cast("array<int>")).withColumn("round_trip", F.lit(None).cast("boolean")).schema
    return unpacked(docs.mapInArrow(run, schema), columns, ["text"], ("ids", "round_trip"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, piece_model())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
