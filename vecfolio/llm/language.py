"""Language identification: sparse logistic regression on character n-grams.

A text in lower case, with every run of other characters than letters one
blank, is cut into n-grams of 1 to ``ORDER`` characters, hashed to ``SPACE``
features. Features weigh count times inverse document frequency, scaled to unit
length. A multinomial logistic regression is trained by follow-the-
regularised-leader with L1 and L2 penalties; a temperature fitted on rows that
training left out calibrates its probabilities.

It is fitted on at most ``SAMPLE`` labelled rows of a language, those of the
smallest id hashes, ``SAMPLE_ALL`` in all (one of each language at least) and
``SAMPLE_BYTES`` of features, which executors make; every language's first rows
come before any one's later rows.

Defined results: a text that is null or has no letter is ``und`` with score 0;
rows of null text or language, or of a text without letters, are not learned
from; with nothing to learn from every text is ``und``; repeated rows are all
predicted; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, in_order, materialise, per_worker, table

ORDER = 3
SPACE = 1 << 15
SAMPLE = 1500
SAMPLE_ALL = 12_000
SAMPLE_BYTES = 256_000_000
EPOCHS = 3
#: Parts of a language that are ranked apart where its id hashes are uneven.
PARTS = 64
UNKNOWN = "und"
_CHUNK = 1 << 20


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0


def _letters() -> np.ndarray:
    return per_worker(("letters",), lambda: np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))


def counts(text: str | None, letters: np.ndarray) -> np.ndarray | None:
    """How often each hashed n-gram occurs in the whole text; None without a letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.where(letters[raw], raw, 32) if len(raw) else raw
    if not (kept != 32).any():
        return None
    kept = kept[np.append(True, (kept[1:] != 32) | (kept[:-1] != 32))]
    kept = np.concatenate(([32], kept, [32])).astype(np.uint64)
    total = np.zeros(SPACE, np.int64)
    for at in range(0, len(kept), _CHUNK):
        part = kept[at : at + _CHUNK + ORDER - 1]
        key = np.zeros(len(part), np.uint64)
        for n in range(1, ORDER + 1):
            if len(part) < n:
                break
            key = key[: len(part) - n + 1] * np.uint64(0x110000) + part[n - 1 :]
            mixed = (key + np.uint64(n << 61)) * np.uint64(0x9E3779B97F4A7C15)
            # grams that begin in the next chunk are counted there
            total += np.bincount(((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(20)).astype(np.int64)[: min(len(mixed), _CHUNK)] & (SPACE - 1), minlength=SPACE)
    return total


def training_rows(docs: DataFrame, usable: Column) -> DataFrame:
    """(lang, k, text) of a bounded sample of the usable rows (doc_id, text, lang); k numbers a language's rows."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id"))
    sizes = materialise(rows.groupBy("lang").count())
    n = max(1, min(SAMPLE, SAMPLE_ALL // max(1, sizes.count())))
    # hashes are even, so twice the share asked for holds enough but by a rare chance; the rank then bounds it
    near = rows.join(sizes, "lang").filter(F.col("h").cast("double") / 2.0**63 < -1 + 4.0 * n / F.col("count"))
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    found = materialise(ranked.filter(F.col("k") <= n).select("lang", "k", "text"))
    # ids that repeat have uneven hashes: a language that got too few is ranked as a whole, in parts first
    got = found.groupBy("lang").agg(F.count(F.lit(1)).alias("got"))
    lacking = sizes.join(got, "lang", "left").filter(F.coalesce("got", F.lit(0)) < F.least("count", F.lit(n))).select("lang")
    if lacking.isEmpty():
        return found
    lacking = materialise(lacking)
    order = ["h", "doc_id", "text"]
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS))
    few = rows.join(lacking, "lang", "left_semi").groupBy("lang", *order).agg(F.count(F.lit(1)).alias("copies")).withColumn("part", part)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("k") <= n)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("k") <= n)
    return found.join(lacking, "lang", "left_anti").unionByName(few.select("lang", "k", "text"))


def features(rows: DataFrame) -> DataFrame:
    """(lang, k, ids, values): n-gram counts of rows (lang, k, text), made on the executors."""

    def run(batches):
        letters = _letters()
        for batch in batches:
            out = []
            for lang, k, text in zip(*(batch.column(i) for i in range(3))):
                c = counts(text.as_py(), letters)
                if c is not None:
                    ids = np.flatnonzero(c)
                    out.append((lang.as_py(), k.as_py(), ids.astype("<i4").tobytes(), c[ids].astype("<i4").tobytes()))
            columns = list(zip(*out)) or [(), (), (), ()]
            types = (pa.string(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["lang", "k", "ids", "values"])

    return rows.select("lang", "k", "text").mapInArrow(run, "lang string, k int, ids binary, values binary")


def bounded(found: DataFrame, most: int = SAMPLE_BYTES) -> DataFrame:
    """The feature rows that come first by (k, lang) and hold so many bytes together; the first row in any case."""
    sizes = found.select("k", "lang", (2 * F.octet_length("ids")).cast("long").alias("bytes"))
    placed = in_order(sizes, [F.col("k"), F.col("lang")], "bytes")
    last = placed.filter((F.col("before") + F.col("bytes") <= most) | (F.col("place") == 0)).agg(F.max(F.struct("k", "lang")).alias("x")).first()["x"]
    return found.filter(F.struct("k", "lang") <= F.struct(F.lit(last["k"]), F.lit(last["lang"]))) if last else found


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], alpha=0.5, beta=1.0, l1=0.02, l2=0.5, seed=7) -> LanguageModel | None:
    """FTRL-proximal with elastic net on rows (language, ids, counts); every fifth row is kept for the temperature."""
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    frequency = np.zeros(SPACE)
    for _, ids, _ in rows:
        frequency[ids] += 1
    idf = np.log((1 + len(rows)) / (1 + frequency)) + 1
    data = []
    for lang, ids, values in rows:
        x = values * idf[ids]
        data.append((languages.index(lang), ids, x / np.sqrt((x * x).sum())))
    order = np.random.default_rng(seed).permutation(len(data))
    kept, learned = (order[::5], np.delete(order, np.s_[::5])) if len(data) >= 50 else (order, order)
    size = (SPACE + 1, len(languages))  # the last row is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weight(at):
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(EPOCHS):
        for i in learned:
            y, ids, x = data[i]
            at, x = np.append(ids, SPACE), np.append(x, 0.1)
            w = weight(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = np.outer(x, p)
            was = n[at]
            sigma = (np.sqrt(was + g * g) - np.sqrt(was)) / alpha
            z[at] += g - sigma * w
            n[at] = was + g * g
    w = weight(np.s_[:])
    model = LanguageModel(languages, idf, w[:-1].astype(np.float32), 0.1 * w[-1])
    logits = np.array([x @ w[ids] + model.bias for _, ids, x in (data[i] for i in kept)])
    truth = np.array([data[i][0] for i in kept])

    def loss(t: float) -> float:
        p = _softmax(logits / t)
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean()

    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(docs: DataFrame, usable: Column) -> LanguageModel | None:
    rows = bounded(materialise(features(training_rows(docs, usable)))).collect()  # SAMPLE_BYTES at most
    sparse = [(r["lang"], np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["values"], "<i4")) for r in rows]
    return train(sorted(sparse, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes())))


def predict(text: str | None, model: LanguageModel | None, letters: np.ndarray) -> tuple[str, float]:
    c = counts(text, letters) if model else None
    if c is None:
        return UNKNOWN, 0.0
    ids = np.flatnonzero(c)
    x = c[ids] * model.idf[ids]
    p = _softmax(((x / np.sqrt((x * x).sum())) @ model.weights[ids] + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            found = [predict(t.as_py(), model, letters) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod("doc_id", 4) == 2
    model = fit(docs, ~held)
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
