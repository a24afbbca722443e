"""Toxicity, language and the pipeline against plain versions that share no code with them."""

import math
import re
import zlib
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from vecfolio.llm import mixing
from vecfolio.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc_mod(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# --- toxicity -------------------------------------------------------------------

DRIFT = 0.05


def all_segments(scores):
    """Maximal scoring segments by definition: the best run, then those left and right of it."""
    best = (0.0, 0, 0)
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best[0] + 1e-12:
                best = (total, i, j)
    if not best[0]:
        return []
    return all_segments(scores[: best[1]]) + [best[0]] + all_segments(scores[best[2] + 1 :])


def tokens_of(text):
    return re.findall(r"\w+", (text or "").lower())


def plain_lexicon(texts, without=None):
    """Token to log-odds of the significant and strong ones, and the number of clean texts of each token."""
    seen = {0: Counter(), 1: Counter()}
    for text, (label, fold) in texts.items():
        if fold != without:
            seen[label].update(set(tokens_of(text)))
    vocabulary = set(seen[0]) | set(seen[1])
    n = {label: sum(c.values()) for label, c in seen.items()}
    mass = 0.5 * len(vocabulary) + 1000.0
    found = {}
    for token in vocabulary:
        prior = 0.5 + 1000.0 * (seen[0][token] + seen[1][token]) / max(n[0] + n[1], 1)
        t, c = seen[1][token] + prior, seen[0][token] + prior
        odds = math.log(t / (n[1] + mass - t)) - math.log(c / (n[0] + mass - c))
        if abs(odds) >= 1.0 and abs(odds / math.sqrt(1 / t + 1 / c)) >= 2.5:
            found[token] = odds
    return found, seen[0]


def root_of(f, low, high):
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def plain_toxicity(docs, labels):
    known = {}
    for i, label in labels:
        if crc_mod(i, 5) and label in (0, 1):
            known[i] = max(label, known.get(i, 0))
    totals = Counter(known.values())
    texts = {}
    for i, text in docs.items():
        if i in known:
            fold = xxhash.xxh64_intdigest((text or "").encode(), 42) % 4
            texts[text or ""] = (max(known[i], texts.get(text or "", (0,))[0]), fold)
    scores, clean = plain_lexicon(texts)
    folds = [plain_lexicon(texts, f)[0] for f in range(4)]
    all_clean = sum(clean.values()) + 0.5 * len(scores)
    share = {t: (clean[t] + 0.5) / all_clean for t in scores}
    rest = max(0.0, 1 - sum(share.values()))
    lam = root_of(lambda x: sum(share[t] * math.exp(x * s) for t, s in scores.items()) + rest * math.exp(-DRIFT * x) - 1, 1e-9, 50.0)

    def segments(text, lexicon):
        return all_segments([lexicon.get(t, -DRIFT) for t in tokens_of(text)])

    worst = [(len(tokens_of(x)), max(segments(x, folds[f]), default=0.0)) for x, (label, f) in texts.items() if not label]
    k = min(1.0, max(1e-6, len(worst) / sum(n * math.exp(-lam * s) for n, s in worst)))

    def evidence(text, lexicon):
        n = len(tokens_of(text))
        return sum(max(0.0, lam * s - math.log(k * n)) for s in segments(text, lexicon))

    seen = Counter(label for label, _ in texts.values())
    rows = [(math.log1p(math.floor(evidence(x, folds[f]) * 10 + 0.5) / 10), label, totals[label] / seen[label]) for x, (label, f) in texts.items()]
    rows.append((0.0, 0, 2.0))
    base = slope = 0.0
    for _ in range(4000):  # Newton's method, short steps
        g, h = np.zeros(2), np.eye(2) * 1e-3
        for x, y, w in rows:
            p = 1 / (1 + math.exp(-min(max(base + slope * x, -50), 50)))
            v = np.array([1.0, x])
            g += w * (y - p) * v
            h += w * p * (1 - p) * np.outer(v, v)
        step = np.linalg.solve(h, g - 1e-3 * np.array([base, slope]))
        base, slope = np.array([base, slope]) + np.clip(step, -1, 1)
        if abs(step).max() < 1e-10:
            break
    return {i: 1 / (1 + math.exp(-min(max(base + max(slope, 0.0) * math.log1p(evidence(x, scores)), -50), 50))) for i, x in docs.items()}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic words, repeated passages and near copies, and labels of most of them."""
    random = np.random.default_rng(8)
    folder = tmp_path_factory.mktemp("corpus")
    passage = [" ".join(f"p{line}_{k}" for k in range(18)) for line in range(4)]
    docs, labels = {}, []
    for i in range(240):
        words = [f"w{k}" for k in random.integers(0, 250, 48)]
        if i % 4 == 0:
            for at in random.integers(0, 48, 5):
                words[at] = f"Vile{random.integers(0, 4)}"
        lines = [" ".join(words[k : k + 12]) for k in range(0, 48, 12)]
        if i % 5 == 1:
            at = int(random.integers(0, 4))
            lines[at:at] = passage
        if i % 7 == 2:
            lines.insert(1, "a line that is common")
        docs[i] = "\n".join(lines)
        labels.append((i, int(i % 4 == 0)))
    for i in range(240, 280):
        docs[i] = docs[i - 239].replace("w1", "changed", 1) if i % 2 else docs[i - 200]
    docs[280], docs[281], docs[282] = "", None, "one"
    rows = [(i, t, "en", "abcd"[min(3, i * i % 7)], len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, labels


def test_toxicity_by_hand(spark, corpus):
    folder, docs, labels = corpus
    wanted = plain_toxicity(docs, labels)
    found = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, folder).collect()}
    assert set(found) == set(docs)
    for i, r in found.items():
        assert r["score"] == pytest.approx(wanted[i], abs=1e-5) and r["predicted"] == int(wanted[i] >= 0.5)
    assert 20 < sum(r["predicted"] for r in found.values()) < 150


# --- language -------------------------------------------------------------------

SPACE = 1 << 15


def plain_features(text):
    clean = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())).strip()
    if not clean:
        return None
    clean, found = f" {clean} ", Counter()
    for n in (1, 2, 3):
        for i in range(len(clean) - n + 1):
            key = 0
            for c in clean[i : i + n]:
                key = (key * 0x110000 + ord(c)) % 2**64
            mixed = (key + (n << 61)) * 0x9E3779B97F4A7C15 % 2**64
            found[(mixed ^ (mixed >> 29)) >> 20 & (SPACE - 1)] += 1
    return found


def plain_language(docs):
    """Predictions (language, score) by a slow follow-the-regularised-leader."""
    learn = [(lang, plain_features(text)) for i, (text, lang) in docs.items() if crc_mod(i, 4) != 2 and text is not None and lang is not None]
    learn = [(lang, f) for lang, f in learn if f]

    def order(row):
        ids = np.array(sorted(row[1]), "<i4")
        return row[0], ids.tobytes(), np.array([row[1][i] for i in sorted(row[1])], "<i4").tobytes()

    learn.sort(key=order)
    languages = sorted({lang for lang, _ in learn})
    frequency = Counter(i for _, f in learn for i in f)

    def weighed(f):
        x = {i: c * (math.log((1 + len(learn)) / (1 + frequency[i])) + 1) for i, c in f.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {i: v / norm for i, v in x.items()} | {"bias": 0.1}

    data = [(languages.index(lang), weighed(f)) for lang, f in learn]
    places = np.random.default_rng(7).permutation(len(data)).tolist()
    kept = places[::5] if len(data) >= 50 else places
    trained = [p for k, p in enumerate(places) if k % 5] if len(data) >= 50 else places
    z, n = {}, {}

    def weight(i, c):
        a = z.get((i, c), 0.0)
        return 0.0 if abs(a) <= 0.02 else -(a - math.copysign(0.02, a)) / ((1.0 + math.sqrt(n.get((i, c), 0.0))) / 0.5 + 0.5)

    def shares(logits):
        e = [math.exp(v - max(logits)) for v in logits]
        return [v / sum(e) for v in e]

    each = range(len(languages))
    for _ in range(3):
        for p in trained:
            y, x = data[p]
            w = {(i, c): weight(i, c) for i in x for c in each}
            q = shares([sum(v * w[i, c] for i, v in x.items()) for c in each])
            for i, v in x.items():
                for c in each:
                    g = v * (q[c] - (c == y))
                    was = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / 0.5 * w[i, c]
                    n[i, c] = was + g * g
    final = {key: weight(*key) for key in z}

    def logits(x):
        return [sum(v * final.get((i, c), 0.0) for i, v in x.items()) for c in each]

    held = [(data[p][0], logits(data[p][1])) for p in kept]

    def loss(t):
        return sum(-math.log(max(shares([v / t for v in row])[y], 1e-12)) for y, row in held)

    t = min(np.geomspace(0.05, 5, 60).tolist(), key=loss)
    found = {}
    for i, (text, _) in docs.items():
        f = plain_features(text)
        q = shares([v / t for v in logits(weighed(f))]) if f else None
        found[i] = (languages[q.index(max(q))], max(q)) if f else ("und", 0.0)
    return found


def test_language_by_hand(spark, tmp_path):
    random = np.random.default_rng(4)
    parts = {"aa": ["ka", "lo", "mi", "ren"], "bb": ["schu", "tä", "ber", "ein"], "cc": ["lo", "ción", "que", "mi"]}
    docs = {}
    for i in range(90):
        lang = "abc"[i % 3] * 2
        text = " ".join("".join(random.choice(parts[lang], 3)) for _ in range(int(random.integers(1, 9))))
        docs[i] = (text, lang)
    docs |= {90: (None, "aa"), 91: ("12 !", "bb"), 92: ("Kalo Miren", None), 93: ("", "cc"), 94: ("x" * 3000, None)}
    spark.createDataFrame([(i, t, g) for i, (t, g) in docs.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = plain_language(docs)
    found = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, str(tmp_path)).collect()}
    for i, r in found.items():
        assert r["held_out"] == (crc_mod(i, 4) == 2)
        assert r["score"] == pytest.approx(wanted[i][1], abs=1e-4)
        assert r["lang_pred"] == wanted[i][0] or r["score"] < 0.51


# --- pipeline -------------------------------------------------------------------


def plain_line_dedup(docs):
    """Texts without chunks of lines that an earlier place has, chunks ending at the edges of passages."""
    lines = {}
    for i, text in docs.items():
        whole = (text or "").split("\n")
        filled = [(pos, line) for pos, line in enumerate(whole) if WORD.search(line)]
        lines[i] = [(k, pos, (filled[k + 1][0] if k + 1 < len(filled) else len(whole)), line) for k, (pos, line) in enumerate(filled)]
    often = Counter(x[3] for each in lines.values() for x in each)
    runs = []
    for i, each in lines.items():
        for x in each:
            if often[x[3]] > 1:
                if runs and runs[-1][0] == i and runs[-1][1][-1][0] == x[0] - 1:
                    runs[-1][1].append(x)
                else:
                    runs.append((i, [x]))
    pairs = Counter((a[3], b[3]) for _, run in runs for a, b in zip(run, run[1:]) if a[3] != b[3])
    chunks = []
    for i, run in runs:
        if len(run) == 1 and len(WORD.findall(run[0][3])) < 50:
            continue
        ended = True
        for k, x in enumerate(run):
            before = run[k - 1][3] if k else None
            edge = k == 0 or before == x[3] or pairs[before, x[3]] == 1
            long = len(WORD.findall(x[3])) >= 50
            if edge or ended or long:
                chunks.append((i, []))
            chunks[-1][1].append(x)
            text = ("" if edge else md5(before.encode()).hexdigest()) + md5(x[3].encode()).hexdigest()
            ended = md5(text.encode()).hexdigest()[0] < "8" or long
    first, gone = {}, {}
    for i, chunk in sorted(chunks, key=lambda c: (c[0], c[1][0][0])):
        key = tuple(x[3] for x in chunk)
        if first.setdefault(key, (i, chunk[0][0])) != (i, chunk[0][0]):
            gone.setdefault(i, set()).update(p for x in chunk for p in range(x[1], x[2]))
    return {i: t if i not in gone else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in docs.items()}


def plain_near_dedup(docs):
    """The least id of each class of texts that similarity of five-word shingles links."""
    sets = {}
    for i, text in docs.items():
        words = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        words = WORD.findall(words)
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
    least = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for i in docs:
            for j in docs:
                both = len(sets[i] & sets[j])
                alike = both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9
                if least[j] < least[i] and alike:
                    least[i], changed = least[j], True
    return {i: t for i, t in docs.items() if least[i] == i}


def test_pipeline_by_hand(spark, corpus):
    folder, docs, labels = corpus
    scores = plain_toxicity(docs, labels)
    clean = {i: t for i, t in docs.items() if scores[i] < 0.5}
    kept = plain_near_dedup(plain_line_dedup(clean))
    assert len(kept) < len(clean) < len(docs)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    got = table
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, folder)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == kept
    # the mix takes each source's target of words, in words of the texts and their order; ids are the library's
    source = {r["doc_id"]: r["source"] for r in table.collect()}
    rows = corpus_pipeline.run(spark, folder).collect()
    taken, times = Counter(), Counter()
    library = __import__("sentencepiece").SentencePieceProcessor(model_file=__import__("public_tokenizers").path("piece_bpe_32k.model"))
    for r in rows:
        words, own = WORD.findall(r["text"]), iter(WORD.findall(kept[r["doc_id"]]))
        assert all(any(w == x for x in own) for w in words)
        taken[r["source"]] += len(words)
        times[r["doc_id"]] += 1
        assert r["ids"] == library.encode(r["text"]) and r["round_trip"]
    assert max(times.values()) <= 3
    sizes = Counter()
    for i, t in kept.items():
        sizes[source[i]] += len(WORD.findall(t or ""))
    plan = {r["source"]: r["target"] for r in mixing.targets(got.select("source", mixing.size_in_words(got["text"]).alias("size"))).collect()}
    assert sum(plan.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - plan[s]) <= 0.5 for s in sizes)
