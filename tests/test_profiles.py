"""Sampling, quality, density, clustering and diagnostics on small inputs with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfolio.functions import display
from vecfolio.operators import density, diagnostics, embedding, profiles, quality, sampling


def clips(spark, groups):
    rows = [(name, i, [float(x) for x in v]) for name, vectors in groups.items() for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "profile_id string, clip_ix int, embedding array<double>")


def line(n, step, last=None):
    return [[1.0, step * i] for i in range(n)] + ([last] if last else [])


@pytest.mark.parametrize(
    "duration, interval, starts",
    [(7.5, 30, [0]), (112, 30, [0, 30, 60, 90, 102]), (70, 30, [0, 30, 60]), (18, 25, [0]), (7.5, 0, [0])],
)
def test_offsets(spark, duration, interval, starts):
    row = spark.range(1).select(sampling.offsets(F.lit(float(duration)), F.lit(float(interval))).alias("o")).first()
    assert row["o"] == [float(s) for s in starts]


def test_offsets_need_an_interval(spark):
    with pytest.raises(Exception, match="interval"):
        spark.range(1).select(sampling.offsets(F.lit(20.0), F.lit(0.0))).collect()


def test_offset_counts(spark):
    cases = [(14_400, 20, 721), (14_400, 25, 577), (14_400, 30, 481), (91.4 * 60, 30, 184), (81.8 * 60, 30, 164), (102.2 * 60, 30, 205), (7200, 30, 241), (7140, 30, 239), (91.6 * 60, 30, 184)]
    rows = spark.createDataFrame([(float(d), float(i), n) for d, i, n in cases], "d double, i double, n int")
    assert all(r["k"] == r["n"] for r in rows.withColumn("k", F.size(sampling.offsets(F.col("d"), F.col("i")))).collect())


def test_timecode_rounds_to_even(spark):
    rows = spark.createDataFrame([(102.5, "00:01:42"), (103.5, "00:01:44"), (360_000.0, "100:00:00")], "s double, t string")
    assert all(r["a"] == r["t"] for r in rows.withColumn("a", display.timecode(F.col("s"))).collect())


def tone(seconds, rate=48_000, level=0.2):
    return level * np.sin(2 * np.pi * 440 * np.arange(int(seconds * rate)) / rate)


def mls(order=15, hold=8):
    state, out = [1] * order, []
    for _ in range(2**order - 1):
        out.append(state[-1])
        state = [state[-1] ^ state[-2], *state[:-1]]
    return np.repeat(np.where(np.array(out) == 1, 0.2, -0.2), hold)


def test_quality_reasons(spark):
    quiet = tone(2)
    quiet[len(quiet) // 10 :] = 0
    windows = {
        "zeros": (np.zeros(48_000), "low_energy"),
        "ones": (np.ones(48_000), "clipped"),
        "tone": (tone(2), None),
        "gap": (quiet, "mostly_silent"),
        "offset": (tone(2) + 0.3, "dc_offset"),
        "noise": (np.random.default_rng(42).normal(0, 0.1, 48_000), None),
        "mls": (mls(), "broadband_noise"),
        "nan": (np.where(np.arange(20_000) == 7, np.nan, 0.1), "invalid"),
        "one": (np.array([0.1]), None),
    }
    wide = spark.createDataFrame([(k, [float(x) for x in v]) for k, (v, _) in windows.items()], "w string, s array<double>")
    found = {r["w"]: r["reason"] for r in quality.analyse(wide.withColumnRenamed("s", "samples")).collect()}
    assert found == {k: reason for k, (_, reason) in windows.items()}


def test_quality_of_odd_windows(spark):
    """Signs are compared by their bit, so -0.0 is negative; nothing, nulls and infinities are invalid."""
    rules = quality.QualityRules(frame=4, stride=1)
    assert quality.measure([0.5, -0.0, 0.5, -0.0], rules)["zero_crossing_rate"] == 1.0
    assert quality.measure([0.5], rules)["zero_crossing_rate"] is None and quality.measure([0.5], rules)["active_ratio"] == 1.0
    rows = [("none", None), ("empty", []), ("null", [0.1, None]), ("infinite", [0.1, float("inf")])]
    found = quality.analyse(spark.createDataFrame(rows, "w string, samples array<double>"), rules).collect()
    assert [(r["reason"], r["keep"], r["peak"]) for r in found] == [("invalid", False, None)] * 4


def test_one_pass_equals_the_parts(spark):
    """The grouped summary has what trimming, clustering, axes and diversity give apart."""
    random = np.random.default_rng(3)
    groups = {f"p{n}": random.normal(size=(n, 6)) + [3, 0, 0, 0, 0, 0] for n in (1, 2, 7, 8, 40, 200)}
    rows = clips(spark, {k: v.tolist() for k, v in groups.items()})
    unit = profiles.normalised(rows)
    whole = {r["profile_id"]: r for r in profiles.aggregate(rows, 0.1).collect()}
    trim = density.trimmed(unit, 0.1)
    kept = density.core(unit, trim)
    gone = {}
    for r in sorted(trim.filter("outlier").collect(), key=lambda r: (r["density"], r["clip_ix"])):
        gone.setdefault(r["profile_id"], []).append(r["clip_ix"])
    for r in trim.collect():
        assert (r["threshold"] is None) == (whole[r["profile_id"]]["threshold"] is None)
        assert r["threshold"] is None or abs(r["threshold"] - whole[r["profile_id"]]["threshold"]) < 1e-12
    for r in profiles.assignments(kept).collect():
        assert whole[r["profile_id"]]["assignments"][r["clip_ix"]] == r["cluster"]
    for r in profiles.representatives(kept).collect():
        own = {v["role"]: v for v in whole[r["profile_id"]]["vectors"]}[r["role"]]
        assert abs(own["weight"] - r["weight"]) < 1e-12 and np.allclose(own["vector"], r["vector"])
    for r in diagnostics.pca(unit).collect():
        own = whole[r["profile_id"]]
        assert np.allclose(own["variance"], r["variance"]) and (own["low_clip"], own["high_clip"]) == (r["low_clip"], r["high_clip"])
    for r in diagnostics.diversity(unit, profiles.global_vectors(kept)).collect():
        assert abs(whole[r["profile_id"]]["diversity"] - r["diversity"]) < 1e-12
    for name, row in whole.items():
        assert row["outliers"] == gone.get(name, []) and row["core_count"] == len(groups[name]) - len(row["outliers"])
    assert gone


def test_spectral_embedder(spark):
    x = np.random.default_rng(42).normal(0, 0.1, 48_000)
    rows = spark.createDataFrame([("a", x.tolist()), ("b", x.tolist()), ("silent", [0.0] * 48_000)], "w string, samples array<double>")
    found = {r["w"]: np.array(r["embedding"]) for r in embedding.embed_windows(rows).collect()}
    assert found["a"].shape == (512,) and (found["a"] == found["b"]).all()
    assert math.isclose(np.linalg.norm(found["a"]), 1, abs_tol=1e-9) and not found["silent"].any()
    with pytest.raises(ValueError, match="unknown embedder"):
        embedding.make_embedder("none")


def test_spectra_of_single_samples_equal_their_sql(spark, tmp_path):
    """Flat spectra: only rounding is left of them."""
    from helpers import duck, rows_of

    from vecfolio.plans.queries import ORACLE_SQL, QUERIES

    c = F.col("id")
    rows = spark.range(2000).select(c.alias("event_id"), (c % 1990).alias("user_id"), (c * 37 % 12_000 / 100).alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["spectral_embed"](spark, str(tmp_path)).toPandas()
    wanted = duck(tmp_path, ["events"]).execute(ORACLE_SQL["spectral_embed"]).df()
    assert len(found) == 8 * 1990 and rows_of(found) == rows_of(wanted)


def test_four_clips(spark):
    row = profiles.aggregate(clips(spark, {"p": [(1, 0), (0.98, 0.02), (0.9, 0.1), (0, 1)]})).first()
    assert [v["role"] for v in row["vectors"]] == list(profiles.ROLES)
    assert [round(v["weight"], 6) for v in row["vectors"]] == [1.0, 0.75, 0.25]
    assert all(math.isclose(np.linalg.norm(v["vector"]), 1, abs_tol=1e-9) for v in row["vectors"])
    assert row["assignments"] == [0, 0, 0, 1] and row["outliers"] == [] and row["threshold"] is None


def test_single_clip(spark):
    row = profiles.aggregate(clips(spark, {"p": [(3, 4)]}), 0.1).first()
    assert np.allclose(row["vectors"][0]["vector"], [0.6, 0.8])
    assert [v["weight"] for v in row["vectors"]] == [1.0, 1.0, 0.0]
    assert row["strategy"] == "single_embedding_duplicate" and row["core_count"] == 1


def test_isolated_clip_is_trimmed(spark):
    vectors = [[1.0, x] for x in np.linspace(0, 0.2, 19)] + [[0.0, 1.0]]
    row = profiles.aggregate(clips(spark, {"p": vectors}), 0.1).first()
    assert row["outliers"] == [19, 0] and row["core_count"] == 18
    assert row["assignments"][19] == -1 and row["assignments"][0] == -1
    assert [round(v["weight"], 6) for v in row["vectors"][1:]] == [0.5, 0.5]


def test_diversity_is_about_the_clips_that_are_kept(spark):
    vectors = [[1.0, x] for x in np.linspace(0, 0.2, 19)] + [[0.0, 1.0]]
    rows = clips(spark, {"p": vectors})
    assert round(profiles.aggregate(rows, 0.1).first()["diversity"], 6) == 0.046499
    assert round(profiles.aggregate(rows).first()["diversity"], 6) == 0.045462


def test_trim_gate_and_cap(spark):
    unit = profiles.normalised(clips(spark, {"eight": line(7, 0.01, [0, 1]), "seven": line(6, 0.01, [0, 1])}))
    found = {(r["profile_id"], r["clip_ix"]) for r in density.trimmed(unit, 0.1).filter("outlier").collect()}
    assert found == {("eight", 7)}
    assert not density.trimmed(unit, 0.1, strict=True).filter("outlier").count()
    with pytest.raises(ValueError, match="trim fraction"):
        density.trimmed(unit, 0.2)


def test_trim_is_off_by_default(spark):
    row = profiles.aggregate(clips(spark, {"p": line(10, 0.01, [0, 1])})).first()
    assert row["core_count"] == 11 and row["outliers"] == []
    assert [round(v["weight"] * 11) for v in row["vectors"][1:]] == [9, 2]
    assert row["strategy"] == "minimum_support_spherical_kmeans"


def test_minimum_support(spark):
    groups = {"line": [[1, 0.001 * i, 0] for i in range(30)] + [[0, 0, 1]], "pair": [[1, 0]] * 2, "dozen": [[1, 0]] * 12}
    found = {r["profile_id"]: r for r in profiles.aggregate(clips(spark, groups)).collect()}
    sizes = {k: [round(v["weight"] * len(groups[k])) for v in r["vectors"][1:]] for k, r in found.items()}
    assert sizes == {"line": [27, 4], "pair": [1, 1], "dozen": [10, 2]}
    assert {r["strategy"] for r in found.values()} == {"minimum_support_spherical_kmeans"}


@pytest.mark.parametrize("vectors", [[(0, 0, 0)] * 2, [(1, 0), (-1, 0)], [(float("nan"), 1)], [(float("inf"), 1)]])
def test_no_direction_is_an_error(spark, vectors):
    with pytest.raises(Exception, match="direction"):
        profiles.aggregate(clips(spark, {"p": vectors})).collect()


def test_order_of_rows_does_not_matter(spark):
    vectors = np.random.default_rng(3).normal(size=(60, 8)).tolist()
    rows = clips(spark, {"p": vectors})
    a = profiles.aggregate(rows, 0.1).first()
    b = profiles.aggregate(rows.repartition(4).orderBy(F.rand(5)), 0.1).first()
    assert a["assignments"] == b["assignments"] and a["outliers"] == b["outliers"]


def test_density_against_brute_force(spark):
    x = np.random.default_rng(9).normal(size=(40, 5))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T
    np.fill_diagonal(near, -np.inf)
    k = density.neighbours(40)
    wanted = np.sort(near, axis=1)[:, -k:].mean(axis=1)
    found = density.local_density(profiles.normalised(clips(spark, {"p": x.tolist()}))).orderBy("clip_ix").collect()
    assert np.allclose([r["density"] for r in found], wanted)


def test_principal_axes(spark):
    shares, _ = diagnostics.principal(np.array([[1, 0], [0.98, 0.02], [0.9, 0.1], [0, 1.0]]))
    assert shares[0] > 0.8
    assert diagnostics.principal(np.ones((3, 2))) == ([], (0, 0))
    x = np.random.default_rng(1).normal(size=(30, 6))
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert np.allclose(diagnostics.principal(x)[0], (s / s.sum())[:3])
    wide = x[:4]
    s = np.linalg.svd(wide - wide.mean(axis=0), compute_uv=False) ** 2
    assert np.allclose(diagnostics.principal(wide)[0], (s / s.sum())[:3])


def test_extreme_snippets(spark):
    unit = profiles.normalised(clips(spark, {"p": line(5, 0.1)}))
    starts = unit.select("profile_id", "clip_ix", (F.col("clip_ix") * 25.0).alias("start_s"))
    found = diagnostics.extreme_snippets(diagnostics.pca(unit), starts).collect()
    assert {r["side"] for r in found} == {"low", "high"} and {r["clip_ix"] for r in found} == {0, 4}
