"""Similarity, map, retrieval, contract, library, jobs and settings on small inputs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfolio import config
from vecfolio.operators import atlas, catalogue, contract, evaluation, jobs, library, nearest

VECTORS = "map_id int, ordinal int, id string, role string, weight double, vector array<double>"


def profile(ordinal, angle, name=None, map_id=1):
    def at(t):
        return [math.cos(t), math.sin(t), 0.0]

    name = name or str(ordinal)
    return [
        (map_id, ordinal, name, "global", 1.0, at(angle)),
        (map_id, ordinal, name, "cluster_1", 0.6, at(angle - 0.08)),
        (map_id, ordinal, name, "cluster_2", 0.4, at(angle + 0.08)),
    ]


def pivot(spark, *rows):
    return catalogue.pivoted(spark.createDataFrame([r for p in rows for r in p], VECTORS), "map_id", "ordinal")


def test_nearest_and_alone(spark):
    rows = pivot(spark, profile(0, 0.0), profile(1, 0.1), profile(2, 2.0), profile(0, 1.0, map_id=2))
    found = {(r["map_id"], r["ordinal"]): r["nearest"] for r in catalogue.request_nearest(rows).collect()}
    assert found == {(1, 0): 1, (1, 1): 0, (1, 2): 1, (2, 0): None}
    blocks = nearest.nearest_in_catalogue(rows.filter("map_id = 1"))
    assert {r["ordinal"]: r["nearest"] for r in blocks.collect()} == {0: 1, 1: 0, 2: 1}


def test_equal_ids_and_ties(spark):
    rows = pivot(spark, *[profile(i, 0.3, "same") for i in range(3)])
    found = {r["ordinal"]: r["nearest"] for r in catalogue.request_nearest(rows).collect()}
    assert found == {0: 1, 1: 0, 2: 0}
    assert {r["ordinal"]: r["nearest"] for r in nearest.nearest_in_catalogue(rows).collect()} == found


@pytest.mark.parametrize("whole_only", [False, True])
def test_pruned_blocks_match_all_pairs(spark, monkeypatch, whole_only):
    """The rows of brute force, with most pairs of blocks skipped where profiles form groups."""
    monkeypatch.setattr(nearest, "BLOCK", 12)
    r = np.random.default_rng(2)
    hills = r.normal(size=(30, 24))
    x = {n: hills[np.arange(360) % 30] + s * r.normal(size=(360, 24)) for n, s in (("g", 0.05), ("c1", 0.05), ("c2", 0.1))}
    x = {n: v / np.linalg.norm(v, axis=1, keepdims=True) for n, v in x.items()}
    for v in x.values():
        v[7], v[300] = v[37], v[37]  # equal profiles: ties
    w = r.uniform(0.5, 1, 360)
    rows = [(3 * i, *[x[n][i].tolist() for n in x], float(w[i]), float(1 - w[i])) for i in range(360)]
    report = nearest.Report()
    table = spark.createDataFrame(rows, "ordinal int, g array<double>, c1 array<double>, c2 array<double>, w1 double, w2 double")
    found = {r["ordinal"]: (r["nearest"], round(r["similarity"], 9)) for r in nearest.nearest_in_catalogue(table, whole_only, report).collect()}
    side = {**x, "w": np.column_stack([w, 1 - w]), "id": 3 * np.arange(360)}
    ids, near, value = nearest._best(side, side, whole_only)
    assert found == {int(i): (int(b), round(float(v), 9)) for i, b, v in zip(ids, near, value)}
    assert report.blocks > 20 and report.skipped > 0.5
    assert not nearest.nearest_in_catalogue(table.limit(0)).count() and not nearest.nearest_in_catalogue(table.limit(1)).count()


def test_pairs_of_blocks_shuffle_no_vectors(spark, monkeypatch):
    """What lies on disk grows with the profiles: blocks meet where they are read, and only bests are dealt anew."""
    monkeypatch.setattr(nearest, "BLOCK", 8)
    plans, kept = [], nearest.written
    monkeypatch.setattr(nearest, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    x = np.random.default_rng(4).normal(size=(96, 6))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()
    rows = spark.createDataFrame([(i, v, v, v[::-1], 0.75, 0.25) for i, v in enumerate(x)], "ordinal long, g array<double>, c1 array<double>, c2 array<double>, w1 double, w2 double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert nearest.nearest_in_catalogue(rows, keep=False).count() == 96
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    met = [p for p in plans if "CartesianProduct" in p]
    assert len(met) == 2
    for plan in met:
        dealt = [line for line in plan.splitlines() if " Exchange " in line]
        assert dealt and all("ordinal" in line for line in dealt)


def test_coverage_is_symmetric_and_bounded(spark):
    light = [(1, 1, "b", "global", 1.0, [0.6, 0.8]), (1, 1, "b", "cluster_1", 1.0, [0.6, 0.8]), (1, 1, "b", "cluster_2", 0.0, [0.6, 0.8])]
    other = [(1, 0, "a", "global", 1.0, [1.0, 0.1]), (1, 0, "a", "cluster_1", 0.75, [1.0, 0.0]), (1, 0, "a", "cluster_2", 0.25, [0.0, 1.0])]
    found = catalogue.request_similarities(pivot(spark, light, other)).collect()
    assert len(found) == 2 and found[0]["cluster_similarity"] == found[1]["cluster_similarity"] <= 1
    # a covers b by max(.6, .8); b covers a by .75 * .6 + .25 * .8
    assert math.isclose(found[0]["cluster_similarity"], 0.5 * (0.8 + 0.75 * 0.6 + 0.25 * 0.8))


@pytest.mark.parametrize("spoil", [lambda r: r[:2], lambda r: [*r[:2], (*r[2][:5], [0.0, 0.0, 0.0])], lambda r: [*r[:2], (*r[2][:5], [1.0])]])
def test_bad_profiles(spark, spoil):
    with pytest.raises(Exception, match="three roles"):
        pivot(spark, spoil(profile(0, 0.0))).collect()


def test_map_frozen_and_session(spark):
    def vectors(*angles):
        return spark.createDataFrame([(i, [math.cos(a), math.sin(a), 0.0]) for i, a in enumerate(angles)], "id int, vector array<double>")

    reference = vectors(0.0, 0.5, 1.4)
    projection, frozen = atlas.projection_for(vectors(0.0, 0.1), reference)
    assert frozen
    two = {r["id"]: (r["x"], r["y"]) for r in atlas.transform(vectors(0.0, 0.5), projection).collect()}
    three = {r["id"]: (r["x"], r["y"]) for r in atlas.transform(vectors(0.0, 0.5, 2.4), projection).collect()}
    assert two == {k: three[k] for k in two}
    again = atlas.fit(reference.repartition(3)).first()
    assert again["version"] == projection.first()["version"] and again["reference_count"] == 3
    fitted, frozen = atlas.projection_for(vectors(0.0, 0.1), None)
    assert not frozen and atlas.header(fitted, frozen, 2).first()["method"] == "collection_pca_v2"
    farthest = max(abs(r["x"]) for r in atlas.transform(reference, projection).collect())
    assert math.isclose(farthest, math.tanh(1), abs_tol=1e-9)
    with pytest.raises(Exception, match="another length"):
        atlas.transform(spark.createDataFrame([(0, [1.0, 0.0])], "id int, vector array<double>"), projection).collect()


def test_map_of_equal_vectors(spark):
    rows = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(3)], "id int, vector array<double>")
    fitted = atlas.fit(rows).first()
    assert fitted["axis_1"] == [1.0, 0.0] and fitted["axis_2"] == [0.0, 1.0] and fitted["variance"] == [0.0, 0.0]
    with pytest.raises(ValueError, match="no vector"):
        atlas.fit(rows.limit(0))


def test_projection_matches_svd(spark):
    x = np.random.default_rng(4).normal(size=(25, 6))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.linalg.svd(unit - unit.mean(axis=0), compute_uv=False) ** 2
    assert np.allclose(atlas.fit(rows).first()["variance"], (s / s.sum())[:2])


def test_payload_of_one(spark):
    rows = pivot(spark, profile(0, 0.2))
    points = atlas.transform(rows.select("map_id", "ordinal", "g"), atlas.fit(rows, "g"), "g").withColumn("id", F.lit("0")).withColumn("label", F.lit("solo"))
    shown = json.loads(atlas.payload(points, catalogue.request_nearest(rows)).first()["json"])
    assert shown["nearest"] is None and set(shown["points"]) == {"global"} and shown["points"]["global"]["weight"] == 1.0


def test_match_vectors(spark):
    rows = spark.createDataFrame([(p, r, [float(x), 1.0], "m1" if p else "m2") for p in range(3) for r, x in (("global", p), ("cluster_1", p))], "profile_id int, role string, vector array<double>, model_revision string")
    found = catalogue.match_vectors(rows, [0.0, 1.0], 0).collect()
    assert [(r["profile_id"], r["role"]) for r in found] == [(0, "cluster_1")]
    assert [r["profile_id"] for r in catalogue.match_vectors(rows, [0.0, 1.0], 5, "global", "m1").collect()] == [1, 2]


def test_evaluation(spark):
    rows = pivot(spark, *[profile(i, a) for i, a in enumerate((0.0, 0.1, 2.0, 2.1))])
    groups = rows.select("ordinal", F.floor(F.col("ordinal") / 2).alias("group"))
    assert evaluation.nearest_accuracy(catalogue.request_nearest(rows).select("ordinal", "nearest"), groups).first()["hits"] == 4
    pairs = catalogue.request_similarities(rows)
    assert evaluation.margin(pairs, groups).first()["margin"] > 0
    assert evaluation.ranking(pairs, groups).first().asDict() == {"n": 4, "recall_at_k": 1.0, "mrr": 1.0}


def test_map_request_limits(spark):
    rows = spark.createDataFrame([(1, i, "x") for i in range(101)] + [(2, 0, ""), (3, 0, "ok"), (4, 0, None)], "map_id int, ordinal int, label string")
    assert {(r["map_id"], r["rule"]) for r in contract.map_request_problems(rows).collect()} == {(1, "profile_count"), (2, "label_length"), (4, "label_length")}


def test_too_large_a_request_is_an_error(spark):
    rows = [(1, i, r, 0.5, [1.0, 0.1 * i]) for i in range(101) for r in ("global", "cluster_1", "cluster_2")]
    wide = catalogue.pivoted(spark.createDataFrame(rows, "map_id int, ordinal int, role string, weight double, vector array<double>"), "map_id", "ordinal")
    with pytest.raises(Exception, match="more than 100 profiles"):
        catalogue.request_similarities(wide).collect()


def test_the_last_of_equal_roles_counts(spark):
    rows = [(1, "global", 1.0, [1.0, 0.0]), (1, "cluster_1", 0.5, [0.9, 0.1]), (1, "cluster_2", 0.5, [0.0, 1.0]), (1, "cluster_1", 0.2, [0.1, 0.2])]
    placed = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place int, id int, role string, weight double, vector array<double>")
    assert catalogue.pivoted(placed, "id").first()["w1"] == pytest.approx(0.2 / 0.7)


def test_tables(spark):
    vectors = spark.createDataFrame([("a", "global"), ("a", "global"), ("b", "global")], "profile_id string, role string")
    held = spark.createDataFrame([("a",)], "profile_id string")
    assert contract.duplicate_roles(vectors).collect()[0]["n"] == 2
    assert contract.orphan_vectors(vectors, held).count() == 1 == contract.without_deleted(vectors, held).count()


def test_library(spark):
    fields = "label string, duration_s double, revision string, interval_s int, fraction double, position int"
    old = spark.createDataFrame([("Set.MP3", 10.0, "r", 25, 0.0, 0)], fields)
    new = spark.createDataFrame([("set.wav", 10.0, "r", 25, 0.0, 1), ("Other.flac", 10.0, None, 0, None, 2), ("other", 10.0, None, None, 0.0, 3), ("other", 10.0, None, None, 0.1, 4)], fields)
    assert sorted(r["position"] for r in library.merged(old, new).collect()) == [0, 2, 4]
    many = spark.createDataFrame([(f"s{i}", 1.0, "r", 25, 0.0, i) for i in range(85)], fields)
    kept = library.newest(library.merged(many, many.limit(0))).collect()
    assert sorted(r["position"] for r in kept) == list(range(5, 85))


def test_jobs(spark):
    rows = spark.createDataFrame([(1, 10, "a", "job_submitted"), (2, 20, "a", "job_failed"), (3, 20, "b", "job_submitted")], "event_id int, created_at int, job_id string, event_name string")
    found = jobs.latest(rows).withColumn("status", jobs.status(F.col("event_name")))
    assert {r["job_id"]: r["status"] for r in found.collect()} == {"a": "failed", "b": "queued"}
    shown = jobs.public(spark.createDataFrame([("complete", "r", 1), ("failed", "r", 1)], "status string, result string, created_at int"))
    assert shown.columns == ["status", "result"] and {r["result"] for r in shown.collect()} == {"r", None}
    steps = spark.createDataFrame([("probe", 0), ("sample", 1), ("aggregate", 0), ("complete", 0)], "stage string, done int")
    got = [r["p"] for r in steps.select(jobs.progress(F.col("stage"), F.col("done"), F.lit(2)).alias("p")).collect()]
    assert [round(x, 6) for x in got] == [0.02, 0.48, 0.94, 1.0]
    events = spark.createDataFrame([("job_failed", '{"error_type":"ValueError"}')], "event_name string, properties string")
    assert jobs.parsed(events, "job_failed").first()["properties"]["error_type"] == "ValueError"


def test_settings(spark):
    assert config.settings({}) == config.Settings()
    assert config.settings({"VECFOLIO_TELEMETRY_ENABLED": "FALSE", "VECFOLIO_SAMPLE_INTERVAL_SECONDS": "30"}).telemetry_enabled is False
    with pytest.raises(ValueError, match="VECFOLIO_BATCH_SIZE"):
        config.settings({"VECFOLIO_BATCH_SIZE": "x"})
    with pytest.raises(ValueError, match="sample_interval"):
        config.settings({"VECFOLIO_SAMPLE_INTERVAL_SECONDS": "7"})
    assert config.health(spark, config.Settings()).first()["embedder_ready"]
