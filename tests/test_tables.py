"""Tables that streams and commits keep: repeated batches, compaction, cascades, failed commits, SQL functions."""

import os

import pytest
from pyspark.sql import functions as F

from vecfolio.operators import catalogue, jobs
from vecfolio.sources.keyed import KeyedCatalogue
from vecfolio.streaming import tables


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_keyed_sink(spark, tmp_path):
    schema = "k long, v long"
    path = str(tmp_path / "t")
    step = tables.keyed_sink(path, ["k"], every=3)
    wanted = {}
    for n in range(8):
        new = {k: 100 * n + k for k in range(n, n + 3)}
        wanted |= new
        batch = spark.createDataFrame(sorted(new.items()), schema)
        step(batch, n)
        step(batch, n)  # a repeated batch changes nothing
        assert rows_of(tables.current(spark, path, ["k"], batch.schema)) == sorted(wanted.items())
    names = sorted(os.listdir(path))
    assert {"base=2", "base=5"} < set(names) and "base=7" not in names
    # an unfinished base isn't read
    os.remove(f"{path}/base=5/_SUCCESS")
    assert rows_of(tables.current(spark, path, ["k"], batch.schema)) == sorted(wanted.items())
    # a batch's bytes are those of its keys
    assert spark.read.parquet(f"{path}/batch=7").count() == 3


def test_update_stream_goes_on(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(3):
        spark.createDataFrame([(i % 4 + n, 1.0) for i in range(8)], "k long, v double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long, v double").parquet(source).groupBy("k").agg(F.sum("v").alias("total"))
        found = tables.drained(stream, path, ["k"])
        assert rows_of(found) == rows_of(spark.read.parquet(source).groupBy("k").agg(F.sum("v")))
    assert not tables.current(spark, str(tmp_path / "none"), ["k"], found.schema).count()


def test_events_are_recorded_once(spark, tmp_path):
    """Repeated within a batch, in a later one, and beyond the watermark."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id string, created_at timestamp, job_id string"
    at = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS t").first()["t"]
    day = at.resolution * 86_400_000_000

    def add(*events):
        spark.createDataFrame([(e, at + day * d, "j") for e, d in events], schema).coalesce(1).write.mode("append").parquet(source)
        return rows_of(tables.recorded(spark.readStream.schema(schema).parquet(source), path, "2 days").select("event_id", "created_at"))

    assert [r[0] for r in add(("a", 0), ("a", 0), ("b", 1))] == ["a", "b"]
    assert [r[0] for r in add(("b", 1), ("c", 1), ("a", 0.5))] == ["a", "b", "c"]
    assert [r[0] for r in add(("d", 9))] == ["a", "b", "c", "d"]
    # later than the watermark: it can't be told from a repetition any more, and is left out
    assert [r[0] for r in add(("e", 1), ("f", 9))] == ["a", "b", "c", "d", "f"]
    batch = spark.createDataFrame([("x", at, "j")], schema)
    step = tables.event_sink(str(tmp_path / "sink"))
    step(batch, 5)
    step(batch, 5)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 1


PROFILES, VECTORS = "profile_id long, name string", "profile_id long, role string, vector array<double>"


def put(spark, table, ids, name, roles=("global", "cluster_1")):
    profiles = spark.createDataFrame([(i, name) for i in ids], PROFILES)
    vectors = spark.createDataFrame([(i, r, [float(i)]) for i in ids for r in roles], VECTORS)
    return table.commit(profiles, vectors)


def test_keyed_catalogue(spark, tmp_path):
    table = KeyedCatalogue(spark, str(tmp_path / "c"), PROFILES, VECTORS, buckets=8)
    assert table.versions() == [] and not table.read("profiles").count()
    first = put(spark, table, range(20), "old")
    put(spark, table, range(5), "new", ("global",))
    assert rows_of(table.read("profiles")) == [(i, "new" if i < 5 else "old") for i in range(20)]
    assert table.read("vectors").count() == 5 + 30  # a profile put again loses its vectors of before
    third = table.commit(deleted=spark.createDataFrame([(i,) for i in (3, 7, 99)], "profile_id long"))
    assert {r["profile_id"] for r in table.read("vectors").collect()} == set(range(20)) - {3, 7}
    assert not table.find("vectors", 7).count() and table.find("vectors", 4).count() == 1
    # versions are seen whole
    assert table.read("profiles", first).count() == 20 and table.read("vectors", first).count() == 40
    assert table.versions() == [0, 1, third]
    # only touched buckets were rewritten
    made = {d: sorted(os.listdir(f"{tmp_path}/c/profiles/{d}")) for d in os.listdir(f"{tmp_path}/c/profiles") if d.startswith("bucket=")}
    assert any("version=2" not in v for v in made.values())
    # all rows of all buckets may go
    table.commit(deleted=table.read("profiles").select("profile_id"))
    assert not table.read("profiles").count() and not table.read("vectors").count()


def test_failed_commit_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    table = KeyedCatalogue(spark, str(tmp_path / "c"), PROFILES, VECTORS, buckets=4)
    put(spark, table, range(10), "a")
    write, calls = table._write, []

    def failing(name, *rest):
        write(name, *rest)
        calls.append(name)
        raise OSError("lost")

    monkeypatch.setattr(table, "_write", failing)
    with pytest.raises(OSError):
        put(spark, table, range(10), "b")
    monkeypatch.setattr(table, "_write", write)
    assert calls == ["profiles"] and rows_of(table.read("profiles")) == [(i, "a") for i in range(10)]
    assert put(spark, table, range(10), "c") == 1
    assert rows_of(table.read("profiles")) == [(i, "c") for i in range(10)] and table.read("vectors").count() == 20
    with pytest.raises(ValueError, match="doesn't put"):
        table.commit(vectors=spark.createDataFrame([(1, "global", [1.0])], VECTORS))
    with pytest.raises(ValueError, match="without an id"):
        table.commit(spark.createDataFrame([(None, "x")], PROFILES))


def test_match_in_sql(spark, tmp_path):
    rows = [(f"p{i}", role, [1.0, 0.1 * i], f"r{i % 2}") for i in range(8) for role in ("global", "cluster_1")]
    path = str(tmp_path / "v")
    spark.createDataFrame(rows, "profile_id string, role string, vector array<double>, model_revision string").write.partitionBy("model_revision", "role").parquet(path)
    vectors = spark.read.parquet(path)
    vectors.createOrReplaceTempView("some_vectors")
    catalogue.register_match(spark, "some_vectors", "match_some")
    for role, revision in (("global", "r1"), (None, "r0"), (None, None)):
        wanted = catalogue.match_vectors(vectors, [1.0, 0.35], 3, role, revision).collect()
        text = ", ".join("NULL" if x is None else f"'{x}'" for x in (role, revision))
        found = spark.sql(f"SELECT * FROM match_some(array(1D, 0.35D), 3, {text})")
        assert sorted((r["profile_id"], r["role"], round(r["similarity"], 12)) for r in found.collect()) == sorted((r["profile_id"], r["role"], round(r["similarity"], 12)) for r in wanted)
    plan = spark.sql("SELECT * FROM match_some(array(1D, 0.35D), 3, 'global', 'r1')")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :][:300]
    assert "role" in filters and "model_revision" in filters


def test_variants(spark):
    rows = [("a", '{"k": 3, "deep": {"x": "y"}}'), ("b", "[1]"), ("c", '{"k": "no number"}'), ("d", "{"), ("e", None)]
    found = jobs.loosely_parsed(spark.createDataFrame(rows, "event_id string, properties string"))
    got = found.select("event_id", jobs.property_of("$.k", "int").alias("k"), jobs.property_of("$.deep.x", "string").alias("x"), "problem", "raw").collect()
    assert [tuple(r)[:4] for r in got] == [("a", 3, "y", None), ("b", None, None, "not an object"), ("c", None, None, None), ("d", None, None, "not JSON"), ("e", None, None, "no properties")]
    assert [r["raw"] for r in got] == [t for _, t in rows]
