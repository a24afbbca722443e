"""The inverted file against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfolio.operators import vector_index


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(8)
    hills = r.normal(size=(12, 16))
    x = hills[r.integers(0, 12, 3000)] + 0.5 * r.normal(size=(3000, 16))
    x[5:45] = x[5]  # equal vectors: ties go to the smaller id
    return x


def brute(x, ids, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        score = unit @ unit[q]
        order = sorted((i for i in ids if i != q), key=lambda i: (-round(score[i], 9), i))[:k]
        out[q] = order
    return out


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(vectors)]
    odd = [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] * 16), (4003, [None] * 16)]
    vector_index.FILE_ROWS, kept = 200, vector_index.FILE_ROWS
    vector_index.build(spark.createDataFrame(rows + odd, "id long, vector array<double>"), path, 24)
    vector_index.FILE_ROWS = kept
    return path


def asked(spark, vectors, ids):
    return spark.createDataFrame([(i, [float(v) for v in vectors[i]]) for i in ids], "id long, vector array<double>")


def test_exact_search(spark, vectors, index):
    ids = [0, 5, 7, 100, 2999]
    found = {}
    for r in vector_index.search(spark, index, asked(spark, vectors, ids), 10).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    assert found == brute(vectors, range(len(vectors)), ids, 10)


def test_probed_search_prunes_and_recalls(spark, vectors, index):
    probes = vector_index.probes_for(spark, index, 0.95, 10)
    assert 1 <= probes < 16
    ids = list(range(0, 3000, 100))
    wanted = brute(vectors, range(len(vectors)), ids, 10)
    rows = vector_index.search(spark, index, asked(spark, vectors, ids), 10, probes).collect()
    hits = sum(r["id"] in wanted[r["query_id"]] for r in rows)
    assert hits / (10 * len(ids)) >= 0.9
    plan = vector_index.search(spark, index, asked(spark, vectors, [3]), 10, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan


def test_every_row_is_indexed_and_lists_are_split(spark, vectors, index):
    rows = spark.read.parquet(f"{index}/lists")
    assert rows.count() == len(vectors) and rows.select("id").distinct().count() == len(vectors)
    assert rows.select("list", "part").distinct().count() > rows.select("list").distinct().count()
    largest = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < len(vectors)


def test_odd_queries_and_an_empty_index(spark, tmp_path, vectors, index):
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 16)], "id long, vector array<double>")
    assert not vector_index.search(spark, index, odd).count()
    none = spark.createDataFrame([], "id long, vector array<double>")
    vector_index.build(none, f"{tmp_path}/none")
    assert not vector_index.search(spark, f"{tmp_path}/none", asked(spark, vectors, [1])).count()
