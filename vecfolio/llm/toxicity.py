"""Toxic passages as maximum-scoring segments of token log-odds.

A token's score is its log-odds of toxic against clean documents under a
Dirichlet prior (uniform mass plus the tokens' overall shares), if it is
significant and strong; every other token costs ``DRIFT``. One linear scan
(Ruzzo and Tompa) finds all maximal segments of a text. A segment's score S in a
text of n tokens has, by extreme-value statistics, -ln p = lambda S - ln(K n)
in clean text; lambda solves the Karlin-Altschul equation and K is fitted to
clean texts. What is positive of it adds up over a text, and a logistic curve
fitted on the training rows turns the sum into a probability.

The model is fitted on at most ``SAMPLE`` labelled rows of each label, those of
the smallest id hashes; equal texts among them count once. Counting runs on
Spark, once for the model and for the lexicons that leave a fold out; the model
holds every significant token of the sample.

Defined results: a null or empty text scores as one without passages; labels
other than 0 and 1, null labels and labels of absent documents are not used; of
several labels of one document the largest counts; repeated rows are all
scored; with no usable label of either kind every score is the share of label 1
(0 without labels); other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, materialise, packed, table, unpacked

SAMPLE = 20_000
#: Bytes of their texts; those of the smallest hashes until they are used up, one text at least.
SAMPLE_BYTES = 256_000_000
DRIFT = 0.05
#: Prior mass: of each token, and of all tokens together by their shares.
PRIOR_EACH, PRIOR_SHARED = 0.5, 1000.0
LEAST_Z, LEAST_ODDS = 2.5, 1.0
FOLDS = 4
_TOKEN = re.compile(r"\w+")


@dataclass
class ToxicityModel:
    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    base: float = -50.0


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of tokens that cost ``drift`` but at ``hits``.

    Ruzzo and Tompa's linear scan; runs of other tokens are one step.
    """
    found: list[list] = []  # [sum before, sum up to its end, first, last]
    links: list[int] = []  # for each, the nearest before it with a smaller sum before, or -1
    total, last = 0.0, -1
    for at, score in hits:
        total -= drift * (at - last - 1)
        last = at
        before, total = total, total + score
        if score <= 0:
            continue
        new = [before, total, at, at]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j = links[j]
            if j < 0 or found[j][1] >= new[1]:
                found.append(new)
                links.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], links[j:]
    return [(right - left, first, end) for left, right, first, end in found]


def passages(text: str | None, model: ToxicityModel) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and the significant passages (first, last, -ln p) of a text."""
    tokens = _TOKEN.findall((text or "").lower())
    scores = model.scores
    hits = [(i, scores[t]) for i, t in enumerate(tokens) if t in scores]
    if not hits:
        return len(tokens), []
    bar = math.log(max(model.k * len(tokens), 1e-12))
    found = [(a, b, model.lam * s - bar) for s, a, b in segments(hits, DRIFT)]
    return len(tokens), [x for x in found if x[2] > 0]


def probability(evidence: float, model: ToxicityModel) -> float:
    x = model.base + model.slope * math.log1p(evidence)
    return 1 / (1 + math.exp(-min(max(x, -50.0), 50.0)))


def token_counts(sample: DataFrame) -> DataFrame:
    """(token, fold, toxic, clean): in how many texts of rows (text, label, fold) a token occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            rows = [(token, fold, n * label, n * (1 - label)) for (token, fold, label), n in counts.items()]
            counts.clear()
            columns = list(zip(*rows)) or [(), (), (), ()]
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["token", "fold", "toxic", "clean"])

        for batch in batches:
            for text, label, fold in zip(*(batch.column(i) for i in range(3))):
                label, fold = label.as_py(), fold.as_py()
                counts.update((t, fold, label) for t in set(_TOKEN.findall(text.as_py().lower())))
            if len(counts) > 200_000:
                yield out()
        yield out()

    partial = sample.select("text", "label", "fold").mapInArrow(run, "token string, fold int, toxic long, clean long")
    return partial.groupBy("token", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(text, label, fold) of at most ``per_label`` documents and ``SAMPLE_BYTES`` a label, and each label's number of rows."""
    known = labels.filter(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    parts = [
        known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for label in (0, 1)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * per_label rows of two numbers at most
    texts = materialise(docs.join(chosen, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label"))
    held = texts.groupBy("label").agg(F.sum(F.octet_length("text")).alias("size"))
    if not held.filter(F.col("size") > SAMPLE_BYTES).isEmpty():
        # 2 * per_label rows, and no text, in the window
        sizes = texts.groupBy("label", "doc_id").agg(F.sum(F.octet_length("text")).alias("size"))
        order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
        upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
        sizes = sizes.withColumn("upto", upto).withColumn("rank", F.row_number().over(order))
        over = sizes.filter((F.col("upto") > SAMPLE_BYTES) & (F.col("rank") > 1)).select("doc_id", "label")
        texts = texts.join(F.broadcast(over), ["doc_id", "label"], "left_anti")
    texts = texts.groupBy("text").agg(F.max("label").alias("label"))
    return materialise(texts.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))), totals


def lexicons(counts: DataFrame) -> tuple[list, list[dict[str, float]], int]:
    """Rows (token, odds, clean) of the significant and strong tokens, the same as dictionaries without each fold, and all clean counts.

    ``counts`` are (token, fold, toxic, clean). Log-odds are those under the
    Dirichlet prior; a lexicon without a fold subtracts its counts.
    """
    sides = ("toxic", "clean")
    wide = materialise(
        counts.groupBy("token").agg(*[F.sum(F.when(F.col("fold") == f, F.col(x)).otherwise(0)).alias(f"{x}{f}") for x in sides for f in range(FOLDS)])
    )
    total = {x: sum((F.col(f"{x}{f}") for f in range(1, FOLDS)), F.col(f"{x}0")) for x in sides}
    # the whole comes last
    each = [{x: total[x] - F.col(f"{x}{f}") for x in sides} for f in range(FOLDS)] + [total]
    sums = wide.agg(
        *[F.sum(n[x]).alias(f"{x}{m}") for m, n in enumerate(each) for x in sides],
        *[F.sum((n["toxic"] + n["clean"] > 0).cast("long")).alias(f"v{m}") for m, n in enumerate(each)],
    ).first()
    kept = []
    for m, n in enumerate(each):
        nt, nc, v = (float(sums[f"{x}{m}"] or 0) for x in ("toxic", "clean", "v"))
        prior = F.lit(PRIOR_EACH) + PRIOR_SHARED * (n["toxic"] + n["clean"]) / max(nt + nc, 1.0)
        mass = PRIOR_EACH * v + PRIOR_SHARED
        t, c = n["toxic"] + prior, n["clean"] + prior
        odds = F.log(t / (nt + mass - t)) - F.log(c / (nc + mass - c))
        strong = (n["toxic"] + n["clean"] > 0) & (F.abs(odds / F.sqrt(1 / t + 1 / c)) >= LEAST_Z) & (F.abs(odds) >= LEAST_ODDS)
        kept.append(F.when(strong, odds).alias(f"odds{m}"))
    found = wide.select("token", total["clean"].alias("clean"), *kept)
    rows = found.filter(F.coalesce(*[f"odds{m}" for m in range(FOLDS + 1)]).isNotNull()).orderBy("token").collect()  # significant tokens of the sample
    whole = [(r["token"], r[f"odds{FOLDS}"], r["clean"]) for r in rows if r[f"odds{FOLDS}"] is not None]
    return whole, [{r["token"]: r[f"odds{f}"] for r in rows if r[f"odds{f}"] is not None} for f in range(FOLDS)], int(sums[f"clean{FOLDS}"] or 0)


def karlin_altschul(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with sum(shares * exp(lambda * scores)) = 1."""

    def total(x: float) -> float:
        return float((shares * np.exp(np.minimum(x * scores, 700))).sum())

    low, high = 0.0, 1.0
    while total(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return max(high, 1e-3)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> ToxicityModel:
    """A model of rows (doc_id, text) with labels (doc_id, label).

    K and the curve are fitted to evidence by lexicons that left the text's own fold out.
    """
    sample, totals = training_sample(docs, labels, per_label)
    model = ToxicityModel()
    if not totals.get(0) or not totals.get(1):
        share = totals.get(1, 0) / max(sum(totals.values()), 1)
        model.base = math.log((share + 1e-12) / (1 - share + 1e-12))
        return model
    rows, folds, clean_all = lexicons(token_counts(sample))
    model.scores = {token: odds for token, odds, _ in rows}
    share = np.array([(clean + PRIOR_EACH) / (clean_all + PRIOR_EACH * len(rows)) for _, _, clean in rows])
    odds = np.array([odds for _, odds, _ in rows])
    model.lam = karlin_altschul(np.append(odds, -DRIFT), np.append(share, max(0.0, 1 - share.sum())))
    # K by maximum likelihood from the best segment of each clean text
    tops = _evidence(sample, folds, None).filter("label = 0")
    fitted = tops.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("tokens") * F.exp(-model.lam * F.col("value"))).alias("s")
    ).first()
    model.k = min(1.0, max(1e-6, fitted["n"] / max(fitted["s"] or 0.0, 1e-9))) if fitted["n"] else 1.0
    # the curve from a histogram of evidence, rows weighted to the labels' real numbers
    bins = _evidence(sample, folds, model).groupBy(F.round("value", 1).alias("x"), "label").count().collect()
    seen = Counter()
    for r in bins:
        seen[r["label"]] += r["count"]
    # two clean texts without evidence are added, so that few labels don't condemn a text that has none
    x = np.log1p(np.array([r["x"] for r in bins] + [0.0]))
    y = np.array([r["label"] for r in bins] + [0], float)
    weight = np.array([r["count"] * totals[r["label"]] / max(seen[r["label"]], 1) for r in bins] + [2.0])
    model.base, model.slope = _logistic(x, y, weight)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not negative) by Newton's method with a slight ridge."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def _evidence(sample: DataFrame, folds: list[dict[str, float]], model: ToxicityModel | None) -> DataFrame:
    """(tokens, value, label) of rows (text, label, fold) by the fold's own lexicon.

    The value is the evidence under the model's lambda and K; without a model,
    the score of the best segment.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text, fold in zip(batch.column(0), batch.column(2)):
                own = folds[fold.as_py()]
                if model:
                    n, found = passages(text.as_py(), replace(model, scores=own))
                    rows.append((n, sum(x[2] for x in found)))
                else:
                    tokens = _TOKEN.findall(text.as_py().lower())
                    hits = [(i, own[t]) for i, t in enumerate(tokens) if t in own]
                    rows.append((len(tokens), max((s for s, _, _ in segments(hits, DRIFT)), default=0.0)))
            n, value = zip(*rows) if rows else ((), ())
            columns = [pa.array(n, pa.int64()), pa.array(value, pa.float64()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["tokens", "value", "label"])

    return sample.select("text", "label", "fold").mapInArrow(run, "tokens long, value double, label int")


_MADE = {"score": "double", "predicted": "int", "passages": "array<struct<first:int,last:int,neg_log_p:double>>"}
_PASSAGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("neg_log_p", pa.float64())]))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score, predicted and passages; columns of those names give way.

    A passage is (first, last, neg_log_p), in tokens from 0.
    """
    columns, rows = docs.columns, packed(docs, ["text"])

    def run(batches):
        for batch in batches:
            found = [passages(t.as_py(), model)[1] for t in batch.column(0)]
            scores = [probability(sum(x[2] for x in p), model) for p in found]
            made = [
                pa.array(scores, pa.float64()),
                pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                pa.array([[dict(zip(("first", "last", "neg_log_p"), x)) for x in p] for p in found], _PASSAGE),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *_MADE])

    schema = rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in _MADE.items()]).schema
    return unpacked(rows.mapInArrow(run, schema), columns, ["text"], tuple(_MADE))


def held_out_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> ToxicityModel:
    """The model of the labels that are not held out (crc32 of the id modulo 5 is not 0)."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    return fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, held_out_model(spark, sf_dir, docs))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "passages")
