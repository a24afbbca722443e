"""Profiles in blocks equal those in one group, at any size; the queries equal their SQL beyond 5,000 vectors."""

import numpy as np
import pytest
from helpers import duck, rows_of
from pyspark.sql import functions as F

from vecfolio.operators import blocks, density, diagnostics, profiles
from vecfolio.plans.queries import ORACLE_SQL, QUERIES


def clips(spark, groups):
    rows = [(name, i, [float(x) for x in v]) for name, vectors in groups.items() for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "profile_id string, clip_ix int, embedding array<double>")


@pytest.fixture(scope="module")
def mixed():
    """Two hills and isolates, equal clips, and a profile that stays small."""
    r = np.random.default_rng(5)
    hill = r.normal(size=(150, 8)) * 0.2 + [1, 0, 0, 0, 0, 0, 0, 0]
    two = np.concatenate([hill[:90], r.normal(size=(50, 8)) * 0.1 + [0, 1, 0, 0, 0, 0, 0, 0], r.normal(size=(4, 8))])
    return {"two": r.permutation(two), "equal": np.tile(hill[:1], (110, 1)), "small": hill[:40]}




def by_id(rows):
    return {r["profile_id"]: r for r in rows}


def test_summary(spark, mixed, monkeypatch, fraction=0.1):
    rows = clips(spark, mixed)
    wanted = by_id(profiles.aggregate(rows, fraction).collect())
    monkeypatch.setattr(density, "MOST_CLIPS", 100)
    monkeypatch.setattr(blocks, "BLOCK", 32)
    monkeypatch.setattr(blocks, "STRETCH", 2)
    found = by_id(profiles.aggregate(rows, fraction).collect())
    assert set(found) == set(wanted)
    for name, w in wanted.items():
        f = found[name]
        for c in ("assignments", "strategy", "core_count", "outliers"):
            assert f[c] == w[c], (name, c)
        if name != "equal":
            assert (f["low_clip"], f["high_clip"]) == (w["low_clip"], w["high_clip"])
        assert np.allclose(f["variance"], w["variance"]) and abs(f["diversity"] - w["diversity"]) < 1e-12
        assert f["threshold"] == w["threshold"] or abs(f["threshold"] - w["threshold"]) < 1e-12
        for a, b in zip(f["vectors"], w["vectors"]):
            assert a["role"] == b["role"] and abs(a["weight"] - b["weight"]) < 1e-12 and np.allclose(a["vector"], b["vector"])
    assert wanted["equal"]["strategy"] == profiles.FORCED and wanted["two"]["strategy"] == profiles.PLAIN
    assert wanted["two"]["outliers"]


def test_parts(spark, mixed, monkeypatch):
    unit = profiles.normalised(clips(spark, {k: v for k, v in mixed.items() if k != "equal"}))
    makers = [density.local_density, profiles.seed_clips, diagnostics.pca]
    wanted = [m(unit).orderBy(*m(unit).columns[:2]).toPandas() for m in makers]
    monkeypatch.setattr(density, "MOST_CLIPS", 100)
    monkeypatch.setattr(blocks, "BLOCK", 32)
    for make, w in zip(makers, wanted):
        f = make(unit).orderBy(*w.columns[:2]).toPandas()
        assert list(f.columns) == list(w.columns)
        for c in w.columns:
            same = np.allclose(np.stack(f[c]), np.stack(w[c])) if w[c].dtype == object and not isinstance(w[c][0], str) else np.allclose(f[c], w[c]) if w[c].dtype == float else (f[c] == w[c]).all()
            assert same, c


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Tables of more vectors: ten labels about their own directions, some clips isolated."""

    def made(n):
        folder = tmp_path_factory.mktemp(f"many{n}")
        value = lambda i: F.sin(F.col("id") * 7.3 + i * i * 1.7 + F.sin(F.col("id") * 0.37 * i)) + F.when((i == F.col("id") % 10) & (F.col("id") % 101 != 0), 2.0).otherwise(0.0)
        rows = spark.range(n).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"), F.transform(F.sequence(F.lit(0), F.lit(15)), value).cast("array<float>").alias("embedding"))
        rows.write.parquet(f"{folder}/embeddings.parquet")
        return str(folder)

    return {n: made(n) for n in (6000, 12_000)}


def narrowed(sql):
    """The SQL for vectors of 16 coordinates."""
    return sql.replace("range(64)", "range(16)").replace("u[64]", "u[16]")


NAMES = ["nearest_profile", "nearest_in_catalogue", "rerank_profiles", "profile_export_rows", "kmeans_assignments"]


@pytest.mark.parametrize("n, name", [(6000, n) for n in NAMES] + [(12_000, "stream_profile_global")])
def test_queries_beyond_5000_vectors(spark, many, n, name, monkeypatch):
    if name == "kmeans_assignments":  # in blocks
        monkeypatch.setattr(density, "MOST_CLIPS", 500)
        monkeypatch.setattr(blocks, "BLOCK", 256)
    found = QUERIES[name](spark, many[n]).toPandas()
    wanted = duck(many[n], ["embeddings"]).execute(narrowed(ORACLE_SQL[name])).df()
    assert len(found) and rows_of(found) == rows_of(wanted)


def test_a_profile_of_50000_clips(spark):
    n = 50_000
    rows = spark.range(n, numPartitions=8).select(
        F.lit("p").alias("profile_id"), F.col("id").cast("int").alias("clip_ix"),
        F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.sin(F.col("id") * (1.3 + i)) + F.when(i == F.col("id") % 2, 3.0).otherwise(0.0)).alias("embedding"),
    )
    found = profiles.aggregate(rows).first()
    assert found["core_count"] == n and found["strategy"] == profiles.PLAIN
    parity = np.array(found["assignments"]) ^ (np.arange(n) % 2)
    assert len(set(parity.tolist())) == 1
    x = np.array([r["embedding"] for r in rows.orderBy("clip_ix").collect()])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    whole = profiles.unit_mean(unit)
    assert np.allclose(found["vectors"][0]["vector"], whole) and abs(found["diversity"] - (1 - (unit @ whole).mean())) < 1e-9
    # the densities of some clips by brute force
    dense = {r["clip_ix"]: r["density"] for r in density.local_density(profiles.normalised(rows)).filter("clip_ix % 9973 = 0").collect()}
    k = density.neighbours(n)
    for i, value in dense.items():
        near = np.delete(unit @ unit[i], i)
        assert abs(np.sort(near)[-k:].mean() - value) < 1e-9
