
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_hash long, ids string, removed int, score double, predicted int, part string, _id long, h string, n_removed string"


def documents(spark, rows, extras=True):
    """A documents table of (doc_id, text, lang, source) with other columns of awkward names."""
    full = [(*r, len(r[1]) if r[1] is not None else None, 1, "x", 2, 0.5, 7, "p", 3, "h", "y") for r in rows]
    out = spark.createDataFrame(full, DOCS)
    return out if extras else out.select("doc_id", "text", "lang", "source", "n_chars")


LONG_LINE = " ".join(f"passage{i}" for i in range(60))
SHORT_LINES = "\n".join(" ".join(f"l{k}w{i}" for i in range(20)) for k in range(4))
BODY = " ".join(f"word{i % 37} other{i % 23}" for i in range(150))

NASTY = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "   \n\n\t ", "en", "a"),
    (4, "one", "en", "b"),
    (5, BODY, "en", "b"),
    (6, BODY, "en", "b"),
    (7, BODY.replace("word5 ", "changed ", 1), "en", "b"),
    (7, "the same id again", "de", "c"),
    (8, "repeated row", "fr", None),
    (8, "repeated row", "fr", None),
    (None, "no id", "en", "a"),
    (9, "first\n" + LONG_LINE + "\nlast", "en", "a"),
    (10, "another\n" + LONG_LINE, "en", "a"),
    (11, SHORT_LINES + "\nx", "en", "a"),
    (12, "y\n\n" + SHORT_LINES, "en", "c"),
    (13, "z" * 100_000, "en", "d"),
    (14, " ".join(f"w{i}" for i in range(30_000)), "en", "d"),
    (15, "ﬁne Été ÉTÉ   tab\tend", "fr", "d"),
    (16, "fine été Été tab end ", "fr", "d"),
    (17, "&<turn a>\\ </turn>\n### Assistant: 😀 \u0001", "en", "e"),
    (-5, "12345 !!! ...", "en", "e"),
]


@pytest.fixture(scope="session")
def nasty(spark, tmp_path_factory):
    """A folder of small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""
    folder = tmp_path_factory.mktemp("nasty")
    documents(spark, NASTY).write.parquet(f"{folder}/documents.parquet")
    labels = [(5, 1, 0), (7, 1, 1), (9, None, None), (99, 1, 1), (None, 1, 1), (14, 1, 0), (14, 1, 1), (10, 1, 0), (4, 0, 5)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    turns = [(1, 0, "user", "a"), (1, 1, "user", None), (1, 1, "user", None), (1, 2, None, "<x> & </turn>\n"), (2, None, "assistant", ""), (None, 0, "assistant", "b"), (3, 5, "a>b", "<part>"), (3, 4, "assistant", "x" * 50_000)]
    spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, parts int").write.parquet(f"{folder}/conversations.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (9, [-2.0, 0.5]), (9, [-2.0, 0.5]), (None, [1.0, 1.0]), (10, [3.0, 4.0])]
    spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, cell string").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark, nasty, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{nasty}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


