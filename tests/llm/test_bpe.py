"""BPE by speculation against the tokenizers library and against merging alone."""

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from vecfolio.llm import bpe
from vecfolio.llm.token_files import word_encoder


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec(path):
    return bpe.BpeCodec(path)


def texts_of(seed, n):
    r = random.Random(seed)
    letters = "abcdeinrstoéñßüАбωΣς" + "aaaa"
    special = ["<|endoftext|>", "<|startoftext|>x", "<|ENDOFTEXT|>", "don't", "I'LL", "'s's", "ΣΑΣ", "İ", "ﬁ", "é", "가나", "한글", "😀👍🏽", " ", "１２"]

    def word():
        kind = r.random()
        if kind < 0.4:
            return "".join(r.choice(letters) for _ in range(r.randint(1, 30)))
        if kind < 0.6:
            return r.choice("az9!") * r.randint(1, 60)
        if kind < 0.8:
            return r.choice(special)
        return "".join(chr(r.choice([r.randint(32, 126), r.randint(0xA0, 0x530), r.randint(0x300, 0x36F)])) for _ in range(r.randint(1, 12)))

    return [r.choice([" ", "\n", "\t "]).join(word() for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_same_as_the_library(path, codec):
    texts = [*texts_of(1, 3000), "", " ", "z" * 50_000, "ab" * 20_000 + "!"]
    ids, counts = word_encoder(path, codec.encode_texts)(pa.array(texts, pa.large_string()))
    ends = np.append(0, np.cumsum(counts))
    wanted = codec.library.encode_batch(texts, add_special_tokens=False)
    decoded = list(codec.decode(ids, counts))
    for i, w in enumerate(wanted):
        assert ids[ends[i] : ends[i + 1]].tolist() == w.ids, texts[i][:80]
        assert decoded[i].decode() == codec.library.decode(w.ids, skip_special_tokens=False)


def test_speculation_is_checked(codec):
    """Words whose greedy pieces hold are left; the others are merged; both are what merging alone gives."""
    r = random.Random(2)
    words = ["".join(r.choice("thesanigoulybr") for _ in range(r.randint(1, 14))).encode() for _ in range(4000)]
    merged = []
    calls = codec.merge
    codec.merge = lambda symbols: merged.append(1) or calls(symbols)
    ids, counts = codec.encode_words(words)
    codec.merge = calls
    assert 0 < len(merged) < len(words)  # made-up words fail more often than those of a language
    ends = np.append(0, np.cumsum(counts))
    for i, w in enumerate(words):
        symbols = np.frombuffer(w, np.uint8).astype(np.int64)
        symbols[-1] += 256
        assert ids[ends[i] : ends[i + 1]].tolist() == codec.merge(symbols)


def test_ties_of_one_merge(codec):
    for n in range(1, 40):
        for w in ("a" * n, "ab" * n, "aab" * n):
            found, _ = codec.encode_words([w.encode()])
            assert found.tolist() == codec.library.encode(w, add_special_tokens=False).ids


def test_operators(spark, path, nasty):
    docs = spark.read.parquet(f"{nasty}/documents.parquet").withColumnRenamed("part", "n_tokens")
    encoded = bpe.encode_documents(docs, path)
    assert encoded.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    rows = encoded.collect()
    library = bpe.BpeCodec(path).library
    assert len(rows) == docs.count()
    for row in rows:
        assert row["ids"] == library.encode(row["text"] or "", add_special_tokens=False).ids
    back = bpe.decode_documents(encoded, path).collect()
    assert sorted(r["decoded"] for r in back) == sorted(library.decode(r["ids"], skip_special_tokens=False) for r in rows)


def test_query(spark, path, small):
    rows = bpe.op11_bpe_encoding(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    library = bpe.BpeCodec(path).library
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
