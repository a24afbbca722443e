"""Toxicity, language, tokens, pieces, SimHash and neighbours against brute force, exact round trips or held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecfolio.llm import common, components, language, neighbours, pieces, simhash, token_files, toxicity
from vecfolio.llm.queries import QUERIES


def crc_mod(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def best_segments(scores):
    """Maximal scoring segments by definition: the best run, then those left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[0] or total == best[0] and j - i < best[2] - best[1]):
                best = (total, i, j)
    if best is None:
        return []
    left = best_segments(scores[: best[1]])
    return left + [best] + [(s, i + best[2] + 1, j + best[2] + 1) for s, i, j in best_segments(scores[best[2] + 1 :])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-7.0, -4.0, -1.0, 0.5, 3.0, 5.25, 8.0, None]), max_size=14))
def test_segments(scores):
    drift = 0.8125
    hits = [(i, s) for i, s in enumerate(scores) if s is not None]
    found = toxicity.segments(hits, drift)
    wanted = best_segments([-drift if s is None else s for s in scores])
    assert sorted(round(s, 9) for s, _, _ in found) == sorted(round(s, 9) for s, _, _ in wanted)
    for s, i, j in found:
        assert abs(s - sum(-drift if x is None else x for x in scores[i : j + 1])) < 1e-9


def test_karlin_altschul():
    scores, shares = np.array([3.0, 1.0, -1.0]), np.array([0.05, 0.1, 0.85])
    assert abs((shares * np.exp(toxicity.karlin_altschul(scores, shares) * scores)).sum() - 1) < 1e-6


def toxic_tables(spark, folder):
    random = np.random.default_rng(8)
    docs, labels = [], []
    for i in range(400):
        words = [f"w{k}" for k in random.integers(0, 300, 60)]
        toxic = i % 4 == 0
        if toxic:
            for at in random.integers(0, 60, 4):
                words[at] = f"vile{random.integers(0, 5)}"
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, ""), (1001, None), (1002, " ".join(f"new{i}" for i in range(5000)) + " vile1 vile2 vile0 vile3")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_toxicity(spark, tmp_path):
    toxic_tables(spark, tmp_path)
    found = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, str(tmp_path)).collect()}
    assert all(r["held_out"] == (crc_mod(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in found.items())
    right = [found[i]["predicted"] == (i % 4 == 0) for i in range(400) if crc_mod(i, 5) == 0]
    assert np.mean(right) > 0.95
    assert found[1000]["predicted"] == found[1001]["predicted"] == 0
    last = found[1002]["passages"]
    assert found[1002]["predicted"] == 1 and [(p["first"], p["last"]) for p in last] == [(5000, 5003)]


def test_toxicity_never_sees_held_out_labels(spark, tmp_path):
    toxic_tables(spark, tmp_path)
    before = {r["doc_id"]: r["score"] for r in QUERIES["op1_toxicity"](spark, str(tmp_path)).collect()}
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    (tmp_path / "other").mkdir()
    spark.read.parquet(f"{tmp_path}/documents.parquet").write.parquet(f"{tmp_path}/other/documents.parquet")
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/other/labels.parquet")
    assert {r["doc_id"]: r["score"] for r in QUERIES["op1_toxicity"](spark, f"{tmp_path}/other").collect()} == before


def test_language(spark, small):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = QUERIES["op10_language_id"](spark, small).collect()
    assert all(r["held_out"] == (crc_mod(r["doc_id"], 4) == 2) for r in found)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"]]) > 0.95


def test_language_cases(spark):
    letters = language._letters()
    assert language.counts(None, letters) is None and language.counts("12 !?", letters) is None
    long = "abc déf " * 200_000
    got, one = language.counts(long, letters), language.counts("abc déf ", letters)
    assert got.sum() > 190_000 * one.sum() // 2 and (got[one > 0] > 0).all()
    rows = [("aa", *sparse(f"ab ba abba {i}", letters)) for i in range(30)] + [("bb", *sparse(f"xy yx xyxy {i}", letters)) for i in range(30)]
    model = language.train(rows)
    assert language.predict("baab ab", model, letters)[0] == "aa" and language.predict("yx xy", model, letters)[0] == "bb"
    assert (model.weights == 0).mean() > 0.9
    assert language.predict("x", None, letters) == ("und", 0.0) == language.predict("77", model, letters)
    one = language.train([("aa", *sparse("only", letters))])
    assert language.predict("whatever", one, letters) == ("aa", 1.0)


def test_language_sample_is_bounded_in_bytes(spark):
    """Each language's first rows stay; none is lost however uneven the ids' hashes are."""
    rows = [(lang, k, b"x" * 4 * n, b"y" * 4 * n) for lang, n in (("aa", 10), ("bb", 100), ("cc", 5)) for k in range(1, 21)]
    found = spark.createDataFrame(rows, "lang string, k int, ids binary, values binary")
    kept = {(r["lang"], r["k"]) for r in language.bounded(found, 8 * 115 * 3 + 8 * 10).collect()}
    assert kept == {(lang, k) for lang in ("aa", "bb", "cc") for k in (1, 2, 3)} | {("aa", 4)}
    assert len(language.bounded(found, 1).collect()) == 1 and not language.bounded(found.limit(0)).collect()
    docs = [(7, f"text {i % 3}", "rare") for i in range(300)] + [(i, f"words {i}", "usual") for i in range(3000)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    counts = {r["lang"]: r["count"] for r in language.training_rows(table, F.lit(True)).groupBy("lang").count().collect()}
    assert counts["usual"] == 1500 and counts["rare"] >= 3


def sparse(text, letters):
    c = language.counts(text, letters)
    return np.flatnonzero(c), c[np.flatnonzero(c)]


# --- tokens ---------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=40), st.data())
def test_packing(bits, ids, data):
    ids = np.array(ids, "<u4") & np.uint32(2**bits - 1)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    start = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - start))
    assert token_files.ids_at(packed, bits, start, n).tolist() == ids[start : start + n].tolist()


TEXTS = [
    "", "a", "don't, DON'T. we'll!", "<|endoftext|>. x<|endoftext|>y <|ENDOFTEXT|>", "İstanbul ΑΣ. éa, éá.́x \x1cy",
    "3.14 a1b2 ﬁn. Ⅷ ² ª_b", "x.. y,, .,. ! ?", "日本語。テスト, emoji😀.", "  lead  and\ttrail \n", "''s 'Ll rock'n'roll $$$ab###", "x" * 3000,
]


@pytest.fixture(scope="module")
def word_file():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_encoder(word_file):
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(word_file), token_files.word_encoder(word_file)
    batch = pa.record_batch([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["doc_id", "text"])
    for _ in range(2):
        for i, ids in token_files.encoded([batch], encode):
            assert ids.tolist() == plain.encode(TEXTS[i], add_special_tokens=False).ids, TEXTS[i]


@pytest.fixture(scope="module")
def word_ids(word_file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_file), token_files.word_encoder(word_file)


def check_word_ids(word_ids, texts):
    plain, encode = word_ids
    ids, counts = encode(pa.array(texts, pa.large_string()))
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_word_encoder_every_character(word_ids):
    """Marks after a letter that folds to two characters or takes a combining mark stay with them."""
    check_word_ids(word_ids, ["İ,", "İ.", "T̈", "H̱", "J̌", "W̊", "Y̊", "H̱amad said", "it's a dog's", "<|ENDOFTEXT|>", "a<|endoftext|>b, c."])
    each = [chr(i) for i in range(1, 0x2100)]
    for shape in ("{}", "a{},b", "A{}. B{}", "{}'s", "{}\u0308,"):
        check_word_ids(word_ids, [shape.format(c, c) for c in each])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abATHY ,.'\n1İñÜб\u0308\u0331\u030c"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=20))
def test_word_encoder_any_text(word_ids, texts):
    check_word_ids(word_ids, texts)


def test_texts_in_slices(spark, small, word_file, codec, monkeypatch):
    """Texts that are encoded in many slices of a batch have the same ids."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "ENCODED_BYTES", 5000)
    plain = Tokenizer.from_file(word_file)
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [None, ""] + TEXTS
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"]).slice(3)
    slices = list(common.text_slices(batch.column(1), 5000))
    assert len(slices) > 50 and [t for _, s in slices for t in s.to_pylist()] == [t or "" for t in texts[3:]]
    for i, ids in token_files.encoded([batch], token_files.word_encoder(word_file)):
        assert ids.tolist() == plain.encode(texts[i] or "", add_special_tokens=False).ids
    for at, some in slices:
        ids, counts = codec.encode_all(some)
        for k, x in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
            assert x.tolist() == codec.library.encode(texts[3 + at + k] or "")


@pytest.mark.parametrize("which", ["small", "nasty"])
def test_token_files(spark, request, which, word_file):
    from tokenizers import Tokenizer

    folder, plain = request.getfixturevalue(which), Tokenizer.from_file(word_file)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()))
    start, wanted = 0, []
    for i, text in docs:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        wanted.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = sorted((tuple(r) for r in QUERIES["op3_token_files"](spark, folder).collect()), key=lambda r: r[1])
    assert found == wanted


def test_token_blocks_are_small_and_packed(spark, small, tmp_path, word_file):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    token_files.write_token_files(docs, str(tmp_path), lambda: token_files.word_encoder(word_file), 49_408, 2, block_ids=500)
    blocks = token_files.token_blocks(spark, str(tmp_path)).collect()
    assert len(blocks) > 100 and all(b["bits"] == 16 and len(b["payload"]) == 2 * b["n_ids"] for b in blocks)
    assert {b["start"] for b in blocks} == set(np.cumsum([0] + [b["n_ids"] for b in sorted(blocks, key=lambda b: b["start"])])[:-1].tolist())
    whole = {r["doc_id"]: r for r in token_files.read_token_files(spark, str(tmp_path)).collect()}
    b = blocks[7]
    at = 0
    for name, n in zip(b["doc_ids"], b["doc_lens"]):
        assert whole[name]["ids"] == token_files.ids_at(b["payload"], b["bits"], at, n).tolist() and whole[name]["start"] == b["start"] + at
        at += n


# --- pieces ---------------------------------------------------------------------

ODD = ["", " ", "   ", "  a  b   c    ", "日本語テキスト😀", "a" * 60, "<s></s><unk>", "ab" * 500, "\n\n\t", "http://x.example/i?x=1 3.14", "." * 50, "-" * 33 + " " * 40 + "z", "Ünï\x00\x01"]


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(pieces.piece_model())


def test_pieces_equal_the_library(codec, spark, small):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    wanted = codec.library.encode(texts)
    assert [codec.encode(t).tolist() for t in texts] == wanted
    ids, counts = codec.encode_all(pa.array(texts, pa.large_string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == wanted
    assert all(codec.decode(i) == t == codec.library.decode(i) for i, t in zip(wanted, texts))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="etaoin thr.,▁0\n", max_size=60))
def test_pieces_any_text(codec, text):
    assert codec.encode(text).tolist() == codec.library.encode(text)


def test_text_without_blanks(codec):
    """Long stretches of many scripts, with and without places where no piece goes across."""
    random = np.random.default_rng(4)
    letters = [chr(c) for c in random.integers(0x4E00, 0x5400, 300)] + list("，。的是ab😀")
    texts = ["".join(random.choice(letters, n)) for n in (511, 513, 20_000)] + ["的" * 2000, "ab" * 2000, "=-" * 700]
    ids, counts = codec.encode_all(pa.array(texts, pa.large_string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == codec.library.encode(texts)


def test_the_scan_keeps_a_window(codec, monkeypatch):
    """However long a stretch is, a window of twice the longest piece is held, and each window commits ids."""
    text = "thereforenotwithstanding" * 400
    wanted = codec.library.encode(text)
    chars = codec.letter[np.frombuffer((pieces.BLANK + text).encode("utf-32-le"), np.uint32)]
    windows, plain = [], codec._window

    def window(chars, base, rest, left):
        piece, back = plain(chars, base, rest, left)
        windows.append((int(base[0]), piece.shape))
        return piece, back

    monkeypatch.setattr(codec, "_window", window)
    begun = codec.scan(chars, np.array([0]), np.array([len(chars)]))
    assert begun[begun != -2].tolist() == wanted
    assert {shape for _, shape in windows} == {(1, 2 * codec.longest + 1)}
    starts = [at for at, _ in windows]
    assert all(0 < b - a <= 2 * codec.longest for a, b in zip(starts, starts[1:])) and len(starts) > 400
    slowly = np.full(len(chars), -2, np.int32)
    codec._slowly(chars, 0, len(chars), len(codec.scores), slowly)
    assert (slowly == begun).all()


def test_unigram_scores(codec, tmp_path):
    """With log-probabilities as scores, a path's score is the best there is."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(open(pieces.piece_model(), "rb").read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = -float(np.log(i + 2)) * (1 + i * 7919 % 1000 / 5000)
    (tmp_path / "unigram.model").write_bytes(model.SerializeToString())
    own = pieces.PieceCodec(str(tmp_path / "unigram.model"))
    score = {i: own.scores[i] for i in own.vocabulary.values()}
    for text in ("the quick brown fox", "internationalisation of things", "a" * 80, "étés à la mode 日本"):
        got, wanted = own.encode(text).tolist(), own.library.encode(text)
        total = [sum(score.get(i, 0.0) for i in ids) for ids in (got, wanted)]
        assert abs(total[0] - total[1]) < 1e-3 and own.decode(got) == text


# --- SimHash ----------------------------------------------------------------------


def components_of(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text, width):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one Two", "a b c", "A É ß a b A É ß", " ".join(map(str, range(9000)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == brute_fingerprint(text, 3)


@pytest.mark.parametrize("bucket, small", [(4096, 16), (8, 2)])
def test_links_find_every_component(spark, monkeypatch, bucket, small):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "SMALL", small)
    random = np.random.default_rng(6)
    base = [int(x) for x in random.integers(0, 2**63, 40)]
    fps = set(base) | {0}
    for x in base:
        for _ in range(12):
            for b in random.choice(64, random.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(np.array(list(fps), np.uint64).view(np.int64).tolist())
    u = np.array(fps, np.int64).view(np.uint64)
    linked = [(i, int(j)) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3) if j > i]
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = simhash.near_links(rows)
    place = {x: i for i, x in enumerate(fps)}
    found = [(place[r["a"]], place[r["b"]]) for r in links.collect()]
    assert set((min(p), max(p)) for p in found) <= set(linked)
    assert components_of(len(fps), found) == components_of(len(fps), linked)


def test_plan_is_a_pigeonhole_cover(spark):
    random = np.random.default_rng(1)
    rows = spark.createDataFrame([(int(x),) for x in random.integers(0, 2**63, 500)], "fp long")
    for distance in (1, 3, 5):
        plan = simhash.plan_search(rows, distance)
        bits = [b for part, _ in plan for b in part]
        assert len(set(bits)) == len(bits) and sum(t + 1 for _, t in plan) == distance + 1
        for _ in range(300):
            flipped = set(random.choice(64, distance, replace=False).tolist())
            assert any(len(flipped & set(part)) <= t for part, t in plan)
    assert simhash.allot([[0, 5, 9], [0, 1, 9]], 2) == (6, [1, 1])


@pytest.mark.parametrize("shape", ["path", "star", "mixed"])
def test_components(spark, shape):
    random = np.random.default_rng(3)
    n = 60
    edges = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(7, i) for i in range(n)], "mixed": [tuple(map(int, e)) for e in random.integers(0, n, (40, 2))]}[shape]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    wanted = components_of(n, edges)
    assert all(found.get(i, i) == wanted[i] for i in range(n))


def test_simhash_query(spark, nasty):
    rows = QUERIES["op5_simhash"](spark, nasty).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{nasty}/documents.parquet").collect()]
    u = np.array([simhash.fingerprint(t, 3) for _, t in docs], np.uint64)
    roots = components_of(len(u), [(i, int(j)) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3)])
    ids = {}
    for root, (i, _) in zip(roots, docs):
        if i is not None:
            ids[root] = min(ids.get(root, i), i)
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    wanted = [(i, f"{int(x):016x}", ids.get(root)) for (i, _), x, root in zip(docs, u, roots)]
    assert sorted((tuple(r) for r in rows), key=key) == sorted(wanted, key=key)


def test_similar_classes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_SETS", 4)
    random = np.random.default_rng(4)
    docs = []
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(120)]
        for copy in range(7):
            edited = list(words)
            for at in random.choice(120, copy, replace=False):
                edited[at] = f"e{family}{copy}{at}"
            docs.append((len(docs), " ".join(edited)))
    docs += [(100, ""), (101, None), (102, " "), (103, "a b"), (104, "A b"), (105, "b a")]
    sets = [set(simhash.shingle_set(t)[1].tolist()) for _, t in docs]
    linked = [
        (i, j) for i in range(len(docs)) for j in range(i)
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0
    ]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row_hash", F.xxhash64("doc_id"))
    found = {r["doc_id"]: r["first_id"] for r in simhash.similar_classes(rows).collect()}
    roots = components_of(len(docs), linked)
    assert found == {i: docs[root][0] for (i, _), root in zip(docs, roots)}


def test_similar_classes_of_repeats(spark):
    body, docs = " ".join(f"w{i}" for i in range(300)), []
    for family in range(12):
        start = body.replace("w", f"f{family}w")
        phrase = " ".join(f"p{family}q{i}" for i in range(7 if family % 2 else 1))
        docs += [(2 * family + i, f"{start} " + " ".join([phrase] * n)) for i, n in enumerate((1, 400))]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row_hash", F.xxhash64("doc_id"))
    found = {r["doc_id"]: r["first_id"] for r in simhash.similar_classes(rows).collect()}
    assert found == {i: i - i % 2 for i, _ in docs}


def test_similar_classes_meet_by_pigeonholes(spark):
    # pairs of similarity 43/53 that share no bucket of least hashes, 5 to 8 SimHash bits apart
    docs = []
    for seed in (11850, 20510, 24949, 35173, 55422, 59061):
        words = [f"s{seed}w{i}" for i in range(52)]
        docs += [" ".join(words), " ".join([*words[:20], "new", *words[21:]])]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("row_hash", F.xxhash64("doc_id"))
    found = {r["doc_id"]: r["first_id"] for r in simhash.similar_classes(rows).collect()}
    assert found == {i: i - i % 2 for i in range(len(docs))}


@pytest.mark.parametrize("bucket, small", [(4096, 16), (8, 2)])
def test_set_links_are_all_within_the_distance(spark, monkeypatch, bucket, small):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "SMALL", small)
    random = np.random.default_rng(8)
    nodes = {0: 0}
    for x in random.integers(0, 2**63, 30):
        for _ in range(10):
            for b in random.choice(64, random.integers(0, 12), replace=False):
                x ^= np.int64(1) << np.int64(b)
            nodes[len(nodes)] = int(x)
    u = np.array(list(nodes.values()), np.int64).view(np.uint64)
    linked = [(i, int(j)) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 8) if j > i]
    found = [(r["a"], r["b"]) for r in simhash.set_links(spark.createDataFrame(list(nodes.items()), "node long, fp long")).collect()]
    assert {(min(p), max(p)) for p in found} <= set(linked)
    assert components_of(len(u), found) == components_of(len(u), linked)


# --- neighbours ---------------------------------------------------------------------


def brute_nearest(vectors, queries, k):
    out = []
    for q in queries:
        near = sorted(((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return out


def test_neighbours_awkward(spark, nasty):
    rows = [tuple(r) for r in QUERIES["op7_nearest_neighbours"](spark, nasty).collect()]
    vectors = {i: np.array(v) for i, v in ((0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (9, [-2.0, 0.5]), (10, [3.0, 4.0]))}
    assert sorted(rows) == brute_nearest(vectors, [0, 20], 20)


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 256)
    random = np.random.default_rng(5)
    x = random.normal(size=(3000, 12)) * random.uniform(0.5, 2, (3000, 1))
    x[100:400] = x[100]  # a very common vector
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<double>")
    queries = list(range(0, 3000, 20))
    found = {}
    for r in neighbours.nearest(rows, rows.filter("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r["query_id"], []).append(r)
    hits = 0
    for q in queries:
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]
        got = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert all(abs(r["score"] - float((x[q] * x[r["vec_id"]]).sum())) < 1e-9 for r in got)
        hits += len({r["vec_id"] for r in got} & set(order))
    assert hits / (20 * len(queries)) >= 0.9
    # ties go to the smaller ids
    common = sorted(r["vec_id"] for r in found[200] if abs(r["score"] - float((x[200] ** 2).sum())) < 1e-9)
    assert common in (list(range(100, 120)), [])


def test_visited_cells_are_all_up_to_the_cost():
    random = np.random.default_rng(2)
    hashing = neighbours.Hashing(1.0, np.zeros((1, 4, 3)), np.zeros((1, 4)), random.integers(1, 2**63, 4).astype(np.uint64), prefix=3, most=1.7)
    cells = np.array([(a, b, c) for a in range(-6, 7) for b in range(-6, 7) for c in range(-6, 7)])
    for place in random.uniform(-2, 2, (20, 4)):
        cost = hashing.costs(place[None, :3], cells)[0]
        assert set(hashing.visits(place).tolist()) == set(hashing.names(cells[cost <= 1.7]).tolist())
        assert hashing.visits(place)[0] == hashing.names(np.floor(place[None, :3]))[0]


def test_neighbours_prune(spark, monkeypatch):
    """Well under half of all pairs are compared where neighbours are hardly nearer than others, and the recall is reached."""
    monkeypatch.setattr(neighbours, "CELL", 2000)
    x = np.random.default_rng(6).normal(size=(20_000, 48))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<double>")
    hashing = neighbours.fit(rows, 20)
    queries = np.arange(0, 20_000, 200)
    codes = np.floor(hashing.places(x, False))
    met = np.logical_or.reduce([neighbours.candidates(hashing, t, x[queries], codes[t]) for t in range(neighbours.TABLES)])
    assert hashing.prefix > 1 and met.mean() < 0.45
    found = {}
    for r in neighbours.nearest(rows, rows.filter("vec_id % 200 = 0"), 20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i, q in enumerate(queries.tolist()):
        order = np.argsort(-(x @ x[q]), kind="stable")
        near = order[order != q][:20]
        # what a bucket up to the cost holds is found, whatever its cell
        assert set(near[met[i, near]].tolist()) <= found[q]
        hits += len(found[q] & set(near.tolist()))
    assert hits / (20 * len(queries)) >= 0.92


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Texts of the smallest hashes until the bytes are used up, one at least; no bound that isn't reached changes anything."""
    from vecfolio.llm import toxicity

    docs = spark.createDataFrame([(i, f"{i:03d}" + "x" * 97) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    whole = {r["text"] for r in toxicity.training_sample(docs, labels)[0].collect()}
    assert len(whole) == 60
    for most, n in ((1000, 10), (1, 1)):
        monkeypatch.setattr(toxicity, "SAMPLE_BYTES", most)
        rows = toxicity.training_sample(docs, labels)[0].collect()
        assert sorted(r["label"] for r in rows) == [0] * n + [1] * n
