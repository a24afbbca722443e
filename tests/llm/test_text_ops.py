"""Chat formatting, fingerprints, line dedup and mixing against SQL or brute force."""

import hashlib
import re
import unicodedata

import pytest
import xxhash
from helpers import duck, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecfolio.llm import chat, fingerprint, line_dedup, mixing
from vecfolio.llm.common import in_order
from vecfolio.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, small, name):
    assert rows_of(QUERIES[name](spark, small).toPandas()) == rows_of(duck(small).execute(ORACLE_SQL[name]).df())


def test_chat_reads_back(spark, nasty):
    rows = [tuple(r) for r in QUERIES["op8_chat_formatting"](spark, nasty).collect()]
    wanted = duck(nasty).execute(chat.OP8_SQL).fetchall()
    assert sorted(rows, key=str) == sorted(wanted, key=str)
    formatted = chat.format_conversations(spark.read.parquet(f"{nasty}/conversations.parquet"))
    by_id = {r["conv_id"]: r for r in formatted.collect()}
    assert by_id[1]["formatted"] == "<turn user>a<part><part></turn>\n<turn >&lt;x&gt; &amp; &lt;/turn&gt;\n</turn>\n"
    assert by_id[3]["formatted"].endswith("</turn>\n<turn a&gt;b>&lt;part&gt;</turn>\n")
    for r in by_id.values():
        masked = "".join(r["formatted"][s["start"] : s["start"] + s["len"]] for s in r["loss_spans"])
        assert len(masked) == sum(s["len"] for s in r["loss_spans"])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a>b"]), st.text(alphabet="<>&/turnpa;\\ \né\U0001F600", max_size=30)), min_size=1, max_size=6))
def test_chat_any_text(spark, turns):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(rows)).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == turns
    assert back["loss_text"] == "".join(t for r, t in turns if r == "assistant")


SPACES = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(f"[{SPACES}]+", " ", folded).strip(" ")


def wide(text):
    raw = canonical(text).encode()
    return f"{xxhash.xxh64_intdigest(raw, 42):016x}{xxhash.xxh64_intdigest(raw, xxhash.xxh64_intdigest(b'wide', 42)):016x}"


@pytest.mark.parametrize("which, sent", [("small", 0), ("nasty", 0), ("nasty", 200_000)])
def test_fingerprints(spark, request, monkeypatch, which, sent):
    monkeypatch.setattr(fingerprint, "MOST_SENT", sent)
    folder = request.getfixturevalue(which)
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs.sort(key=lambda d: (d[0] is None, -(d[0] or 0), d[1].encode()))
    wanted = []
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        wanted.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), wide(text), wide(edited), float(canonical(text) == canonical(edited)), float(canonical(text) == canonical(after))))
    rows = QUERIES["op9_document_fingerprints"](spark, folder)
    found = [tuple(r)[:7] for r in rows.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(found, key=key) == sorted(wanted, key=key)
    classes = {}
    for i, text in docs:
        if i is not None:
            classes[canonical(text)] = min(classes.get(canonical(text), i), i)
    by_print = {wide(t): classes.get(canonical(t)) for _, t in docs}
    sizes = {}
    for _, text in docs:
        sizes[wide(text)] = sizes.get(wide(text), 0) + 1
    for r in rows.collect():
        assert (r["class_id"], r["class_size"], r["bucket_texts"]) == (by_print[r["fingerprint"]], sizes[r["fingerprint"]], 1)


def test_case_and_space_folding(spark):
    rows = spark.createDataFrame([("ﬁne ÉTÉ",), ("  fine été\n",), ("fine ete",)], "text string")
    prints = [r["f"] for r in rows.select(fingerprint.wide_hash(fingerprint.canonical(F.col("text"))).alias("f")).collect()]
    assert prints[0] == prints[1] != prints[2]


def test_line_dedup_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    three = "\n".join(" ".join(f"{k}_{i}" for i in range(20)) for k in range(3))
    rows = spark.createDataFrame(
        [
            (1, f"a a\n{long}\nb"),
            (2, f"c\n{long}"),
            (3, f"{three}\nd"),
            (4, f"e\n\n{three}"),
            (5, f"{long}\nshift\n{three}\n\ntail"),
            (6, "b\nunlike"),
            (7, None),
            (8, ""),
            (9, f"x\n{long}\n{long}"),
            (10, long),
        ],
        "doc_id long, text string",
    )
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(rows).collect()}
    assert out[1] == f"a a\n{long}\nb" and out[2] == "c"
    assert out[3] == f"{three}\nd" and out[4].strip() == "e"
    assert out[5].replace("\n", "") == "shifttail"
    assert out[6] == "b\nunlike" and out[7] is None and out[8] == "" and out[9] == "x" and out[10] == ""


def test_line_dedup_edges(spark):
    line = lambda name: " ".join(f"{name}_{i}" for i in range(12))
    docs, hot = [], [line(f"hot{i}") for i in range(12)]
    for i, h in enumerate(hot):
        docs += [(1000 + 2 * i, f"u{i}\n{h}\nv{i}"), (1001 + 2 * i, f"x{i}\n{h}\ny{i}")]
    for i in range(6):  # a passage in each of two documents, beside other common lines
        body = "\n".join(line(f"p{i}_{k}") for k in range(5))
        docs += [(2 * i, f"{hot[i]}\n{body}\n{hot[i + 1]}"), (2 * i + 1, f"{hot[11 - i]}\n{body}\n{hot[10 - i]}")]
    docs += [(50, "start\n" + "\n".join([line("again")] * 7)), (51, "\n".join([line("again")] * 4) + "\nend")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(rows, edges=True).collect()}
    assert all(out[2 * i].count(f"p{i}_") == 60 and f"p{i}_" not in out[2 * i + 1] for i in range(6))
    assert out[50] == "start\n" + line("again") and out[51] == "end"
    plain = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(rows, edges=False).collect()}
    assert any(f"p{i}_" in plain[2 * i + 1] for i in range(6))
    assert all(out[i] == t for i, t in docs if i >= 1000)


def water_fill(sizes, most=3):
    """Targets by resharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in capped]
        left = total - sum(most * sizes[n] for n in capped)
        share = {n: left * weight[n] / sum(weight[x] for x in free) for n in free}
        over = {n for n in free if share[n] > most * sizes[n] + 1e-9}
        if not over:
            return {n: most * sizes[n] if n in capped else share[n] for n in names}
        capped |= over


@pytest.mark.parametrize("which", ["small", "nasty"])
def test_mixing(spark, request, which):
    folder = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = QUERIES["op2_mixing"](spark, folder).collect()
    again = QUERIES["op2_mixing"](spark, folder).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    words = re.compile(r"[^\x20\x09-\x0D]+")
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words.findall(r["text"] or ""))
    wanted = water_fill(sizes)
    assert sorted(round(x, 6) for x in {r["target"] for r in rows}) == sorted(round(x, 6) for x in set(wanted.values()))
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(r["size"] for r in rows) == sum(sizes.values())
    taken = {}
    for r in rows:
        taken[r["target"]] = taken.get(r["target"], 0) + r["taken"]
    for t, got in taken.items():
        like = [x for x in wanted.values() if abs(x - t) < 1e-6]
        assert abs(got - sum(like)) <= 0.5 * len(like) + 1e-6


@pytest.mark.parametrize("sizes, wanted", [((20, 20, 20), (37.5, 15.0, 7.5)), ((40, 20), (42.857143, 17.142857)), ((1, 1, 1, 1), (20 / 9, 8 / 9, 4 / 9, 4 / 9)), ((33, 64, 1000, 5), None)])
def test_small_sources_meet_their_targets(spark, sizes, wanted):
    rows = [(i, chr(97 + i), " ".join(f"w{k}" for k in range(n))) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted(mixing.taken_words(docs).collect(), key=lambda r: r["doc_id"])
    filled = water_fill({chr(97 + i): n for i, n in enumerate(sizes)})
    for r, n in zip(got, sizes):
        assert r["target"] == pytest.approx(filled[chr(97 + r["doc_id"])])
        assert abs(r["taken"] - r["target"]) <= 0.5 and r["taken"] <= 3 * n
    mixed = {}
    for r in mixing.mixed_documents(docs).collect():
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + len(r["text"].split(" "))
    assert mixed == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_places_in_order(spark):
    """Numbers and running sums over ranges equal those of one ordered window."""
    rows = [(f"s{i * 7919 % 1000:03d}" if i else None, i) for i in range(1000)]
    found = in_order(spark.createDataFrame(rows, "k string, v long"), [F.col("k").asc_nulls_last()], "v").collect()
    place = before = 0
    for k, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or "")):
        assert (k, v, place, before) in {tuple(r) for r in found if r["k"] == k}
        place, before = place + 1, before + v


def test_permutation_and_shards(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r["p"] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))
    back = [r["p"] for r in spark.range(n).select(mixing.permuted(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)), F.lit(n).cast("long"), F.lit(3), back=True).alias("p")).collect()]
    assert back == list(range(n))
    plan = spark.createDataFrame([("a", 0, 64_000, 64_000.0), ("b", 1, 6400, 12_800.0), ("c", 2, 0, 0.0)], "source string, source_ix long, source_size long, target double")
    mix = mixing.slots(plan, 64, shard_slots=100).collect()
    assert sorted(r["position"] for r in mix) == list(range(1200))
    seen = {}
    for r in mix:
        seen.setdefault((r["source_ix"], r["pass"]), []).append(r["block"])
    assert sorted(map(len, seen.values())) == [100, 100, 1000] and all(sorted(b) == list(range(len(b))) for b in seen.values())
    counts = [r["n"] for r in mixing.shard_counts(mixing.slots(plan, 64, shard_slots=100)).collect() if r["source_ix"] == 1]
    # a hypergeometric draw: 200 of 1200 slots, 100 a shard
    assert sum(counts) == 200 and 2 < max(counts) - min(counts) < 25


@pytest.mark.parametrize("which", ["small", "nasty"])
def test_mix_is_drawn(spark, request, which):
    docs = spark.read.parquet(f"{request.getfixturevalue(which)}/documents.parquet")
    rows = mixing.taken_words(docs.select("doc_id", "source", "text")).collect()
    mix = sorted(mixing.mixed_blocks(docs).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in mix] == list(range(len(mix)))
    assert all(r["shard"] == r["position"] // mixing.SHARD_SLOTS and r["n_words"] == len(r["text"].split(" ")) for r in mix)
    assert sum(r["n_words"] for r in mix) == sum(r["taken"] for r in rows)
    passes = {}
    for r in mix:
        passes.setdefault((r["source"], r["block"]), []).append(r["pass"])
    assert all(len(set(p)) == len(p) for p in passes.values())
    words = {}
    for r in docs.collect():
        words.setdefault(r["source"], set()).update(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert all(set(r["text"].split(" ")) <= words[r["source"]] for r in mix)
    assert min(r["first_position"] for r in rows if r["taken"]) == 0
    assert all((r["first_position"] is None) == (r["taken"] == 0) for r in rows)
    assert {r["first_shard"] for r in rows if r["taken"]} <= {r["shard"] for r in mix}


def test_mixed_documents(spark, nasty):
    docs = spark.read.parquet(f"{nasty}/documents.parquet")
    taken = {}
    for r in mixing.taken_words(docs).collect():
        taken.setdefault(r["doc_id"], 0)
        taken[r["doc_id"]] += r["taken"]
    whole = {}
    for r in docs.collect():
        whole.setdefault(r["doc_id"], []).append(r["text"])
    got = {}
    for r in mixing.mixed_documents(docs).collect():
        assert r["n_chars"] == len(r["text"])
        assert r["text"] in whole[r["doc_id"]] or any(set(r["text"].split()) <= set((t or "").split()) for t in whole[r["doc_id"]])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert sum(got.values()) == sum(taken.values())
