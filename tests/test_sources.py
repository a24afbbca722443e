"""Recordings, documents, tables, telemetry and streams, written and read."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfolio.operators import contract, jobs, profile_job, profiles, quality
from vecfolio.plans import queries
from vecfolio.sources import events, recordings
from vecfolio.sources import profiles as documents
from vecfolio.streaming import profiles as streams


def by_file(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["window_ix"] is None, r["window_ix"] or 0)):
        out.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    return out


def test_recordings_to_windows(spark, tmp_path):
    tone = 0.5 * np.sin(np.arange(8000 * 45) / 5)
    for name, x in (("a.wav", tone), ("short.WAV", tone[:4000]), ("long.wav", np.zeros(8000 * 70))):
        (tmp_path / name).write_bytes(recordings.wave_bytes(x, 8000, 2))
    (tmp_path / "bad.wav").write_bytes(b"no wave")
    (tmp_path / "other.mp3").write_bytes(b"no audio")
    (tmp_path / "notes.txt").write_text("x")
    # many tasks read a file, each the windows that begin in its range
    frame = recordings.read_windows(spark, str(tmp_path), 20.0, range_bytes=100_000, most_seconds=60)
    assert frame.rdd.getNumPartitions() > 20
    found = by_file(frame.collect())
    assert [(r["window_ix"], r["start_s"], r["rate"], len(r["samples"])) for r in found["a.wav"]] == [(0, 0.0, 48_000, 480_000), (1, 20.0, 48_000, 480_000), (2, 35.0, 48_000, 480_000)]
    assert {n: [r["error"] for r in rows] for n, rows in found.items() if n != "a.wav"} == {
        "short.WAV": ["the window at 0.0 s is too short"], "long.wav": [recordings.TOO_LONG], "bad.wav": [found["bad.wav"][0]["error"]], "other.mp3": [found["other.mp3"][0]["error"]]
    }
    assert found["bad.wav"][0]["error"] and found["other.mp3"][0]["error"]
    # the tone is at the same place after its rate has changed
    first = found["a.wav"][1]["samples"]
    at = np.arange(480_000) / 6 + 160_000
    assert np.abs(np.array(first) - np.interp(at, np.arange(len(tone)), tone)).max() < 1e-3
    windows = spark.createDataFrame([("w", first)], "w string, samples array<double>")
    assert quality.analyse(windows).first()["keep"]
    # as values, for stores that only Spark opens
    values = by_file(recordings.binary_windows(recordings.binary_files(spark, str(tmp_path)), recordings.Plan(20.0, most_seconds=60)).collect())
    assert {n: [(r["window_ix"], r["error"], r["samples"]) for r in rows] for n, rows in values.items()} == {n: [(r["window_ix"], r["error"], r["samples"]) for r in rows] for n, rows in found.items()}
    capped = recordings.read_windows(spark, str(tmp_path), 20.0, most_bytes=1_000_000).filter("window_ix is null and path like '%long.wav'").collect()
    assert [r["error"] for r in capped] == ["the file is over 1000000 bytes"]


def test_filters_on_path_drop_files(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.wav").write_bytes(recordings.wave_bytes(np.full(16_000 * 3, 0.1 * k), 16_000))
    assert recordings.read_windows(spark, str(tmp_path), 20.0).rdd.getNumPartitions() == 1  # small files go together
    frame = recordings.read_windows(spark, str(tmp_path), 20.0, range_bytes=100_000)
    one = frame.filter(F.col("path") == str(tmp_path / "2.wav"))
    assert frame.rdd.getNumPartitions() == 4 and one.rdd.getNumPartitions() == 1
    assert [round(r["samples"][5], 2) for r in one.collect()] == [0.2]
    assert frame.filter(F.col("path").isin(str(tmp_path / "0.wav"), str(tmp_path / "3.wav"))).count() == 2
    assert recordings.read_windows(spark, str(tmp_path / "1.wav"), 20.0).count() == 1


@pytest.mark.parametrize("width, channels", [(1, 1), (2, 2), (3, 1), (4, 2)])
def test_wave_headers(width, channels):
    """All widths, other chunks before the samples, RF64, and files whose length was never written."""
    import io
    import struct

    frames = np.linspace(-0.9, 0.9, 64)
    whole = np.round(frames * (2 ** (8 * width - 1) - 1)).astype(np.int64)
    raw = b"".join((int(v) + 128).to_bytes(1, "little") if width == 1 else int(v).to_bytes(width, "little", signed=True) for v in whole for _ in range(channels))
    shape = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, 32, 32 * channels * width, channels * width, 8 * width)
    odd = struct.pack("<4sI", b"LIST", 3) + b"abc\0"
    for head, length in ((b"RIFF", len(raw)), (b"RIFF", 0xFFFFFFFF), (b"RIFF", 0), (b"RF64", 0xFFFFFFFF)):
        wide = struct.pack("<4sIQQQ", b"ds64", 24, 0, len(raw), 0) if head == b"RF64" else b""
        body = struct.pack("<4sI4s", head, 0, b"WAVE") + wide + odd + shape + struct.pack("<4sI", b"data", length) + raw
        wave = recordings.wave_header(io.BytesIO(body), len(body))
        assert (wave.frames, wave.seconds, wave.channels, wave.width) == (64, 2.0, channels, width)
        x = recordings.wave_window(io.BytesIO(body), wave, 1.0, 1.0, 32)
        assert np.abs(x - frames[32:]).max() < 2.1 / 2 ** (8 * width - 1) + 1e-6
    with pytest.raises(ValueError):
        recordings.wave_header(io.BytesIO(struct.pack("<4sI4s", b"RIFF", 0, b"WAVE") + odd), 24)


def test_cut_against_slices():
    r = np.random.default_rng(1)
    x = r.normal(size=5000)
    for _ in range(50):
        spans = sorted((int(a), int(a + n)) for a, n in zip(r.integers(0, 5500, 6), r.integers(0, 900, 6)))
        edges = [0, *sorted(r.integers(0, 5000, 9)), 5000]
        found = list(recordings.cut((x[a:b] for a, b in zip(edges, edges[1:])), spans))
        assert len(found) == 6 and all(len(f) == len(x[a:b]) and (f == x[a:b]).all() for f, (a, b) in zip(found, spans))


DECODER = """#!{python}
import sys, json
sys.path.insert(0, {root!r})
import numpy as np
from vecfolio.sources import recordings as r
name = sys.argv[sys.argv.index("-i") + 1] if "-i" in sys.argv else sys.argv[-1]
body = open(name, "rb")
size = body.seek(0, 2)
body.seek(0)
wave = r.wave_header(body, size)
if "-i" in sys.argv:
    sys.stdout.buffer.write(r.wave_window(body, wave, 0.0, wave.seconds, int(sys.argv[sys.argv.index("-ar") + 1])).astype("<f4").tobytes())
else:
    print(json.dumps(dict(format=dict(duration=str(wave.seconds)))))
"""


def test_other_formats_by_a_stand_in_decoder(spark, tmp_path, monkeypatch):
    """The decoder's output is cut as the file is; programs of its name stand in for it."""
    import os
    import sys
    from pathlib import Path

    tools, audio = tmp_path / "bin", tmp_path / "in"
    tools.mkdir(), audio.mkdir()
    for name in ("ffmpeg", "ffprobe"):
        (tools / name).write_text(DECODER.format(python=sys.executable, root=str(Path(__file__).parent.parent)))
        (tools / name).chmod(0o755)
    monkeypatch.setenv("PATH", f"{tools}:{os.environ['PATH']}")
    x = 0.5 * np.sin(np.arange(16_000 * 31) / 7)
    body = recordings.wave_bytes(x, 16_000)
    (audio / "a.flac").write_bytes(body)
    (audio / "broken.mp3").write_bytes(body[:20])
    plan = recordings.Plan(10.0, 4.0, 16_000)

    def rows(local):
        with open(audio / "a.flac", "rb") as f:
            return [b.to_pylist()[0] for b in recordings.windows_of("/a.flac", f, len(body), plan, local=local)]

    for found in (rows(str(audio / "a.flac")), rows(None)):
        assert [(r["start_s"], len(r["samples"]), r["duration_s"]) for r in found] == [(0.0, 64_000, 31.0), (10.0, 64_000, 31.0), (20.0, 64_000, 31.0), (27.0, 64_000, 31.0)]
        assert np.abs(np.array(found[1]["samples"]) - x[160_000:224_000]).max() < 1e-3
    with open(audio / "broken.mp3", "rb") as f:
        assert [b.to_pylist()[0]["error"] is not None for b in recordings.windows_of("/broken.mp3", f, 20, plan, local=str(audio / "broken.mp3"))] == [True]


def test_files_to_exports(spark, tmp_path):
    """One call; a file with a window that can't be read has no export, and doesn't stop the others."""
    tone = 0.2 * np.sin(np.arange(8000 * 45) / 9)
    for name, x in (("good", tone), ("silent", np.zeros(8000 * 12)), ("long", np.zeros(8000 * 90))):
        (tmp_path / f"{name}.wav").write_bytes(recordings.wave_bytes(x, 8000))
    cut = recordings.wave_bytes(tone, 8000)
    (tmp_path / "header.wav").write_bytes(cut[:30])
    # the last window of a file that ends early is too short: the header promises 45 s
    whole = bytearray(recordings.wave_bytes(tone[: 8000 * 25], 8000))
    (tmp_path / "tail.wav").write_bytes(bytes(whole))
    made = profile_job.run_files(spark, str(tmp_path), 24.5, most_seconds=60)
    found = {r["profile_id"].rsplit("/", 1)[1]: r for r in made.collect()}
    assert {n: r["error_type"] for n, r in found.items()} == {"good.wav": None, "silent.wav": "NoUsableWindows", "long.wav": "RecordingTooLong", "header.wav": "UnreadableRecording", "tail.wav": None}
    export = profile_job.export_rows(made, 0.0)
    assert contract.violations(export).count() == 0 and export.count() == 2
    times = next(r["timing_ms"] for r in export.collect() if r["profile_id"].endswith("good.wav"))
    assert set(times) == {"probe", "decode_and_filter", "filter_compute", "embed", "aggregate", "total"}
    assert times["total"] >= max(v for k, v in times.items() if k != "total") - 1
    # a window in error fails the recording, whatever came before it
    windows = recordings.read_windows(spark, str(tmp_path / "good.wav"), 20.0).withColumnRenamed("path", "profile_id").drop("rate")
    late = F.when(F.col("window_ix") == 2, "the window at 35.0 s is too short")
    failed = windows.withColumn("samples", F.when(F.col("window_ix") < 2, F.col("samples"))).withColumn("error", late)
    row = profile_job.outcomes(profile_job.embedded(failed)).first()
    assert row["error"].startswith("the window at 35") and row["vectors"] is None


def test_jobs_do_not_stop_each_other(spark):
    """Silence, length and missing windows are errors of their own recording; a job's telemetry can't fail it."""
    tone = (0.2 * np.sin(np.arange(16_384) / 9)).tolist()
    windows = [("good", i, 25.0 * i, tone) for i in range(3)] + [("silent", 0, 0.0, [0.0] * 16_384), ("long", 0, 0.0, tone), ("good", 3, 75.0, None)]
    lengths = [("good", 85.0), ("silent", 10.0), ("long", 1e6), ("gone", 10.0), ("broken", None)]
    made = profile_job.run_jobs(
        spark.createDataFrame(lengths, "profile_id string, duration_s double"),
        spark.createDataFrame(windows, "profile_id string, window_ix int, start_s double, samples array<double>"),
    )
    found = {r["profile_id"]: r for r in made.collect()}
    assert {k: r["error"] for k, r in found.items()} == {
        "good": None, "silent": profile_job.NO_WINDOWS, "long": profile_job.TOO_LONG, "gone": profile_job.UNREADABLE, "broken": profile_job.UNREADABLE
    }
    good = found["good"]
    assert (good["considered"], good["retained"], good["filtered"], good["filter_counts"]) == (4, 3, 1, {"invalid": 1})
    assert min(good["filter_ms"], good["embed_ms"], good["aggregate_ms"]) > 0
    export = profile_job.export_rows(made, 0.0)
    assert contract.violations(export).count() == 0
    times = export.first()["timing_ms"]
    assert {"filter_compute", "embed", "aggregate", "total"} < set(times) and times["total"] >= max(times["embed"], times["aggregate"])
    sink = jobs.outcome_events(made, 25, 0.0, 64)
    with pytest.raises(Exception, match="/proc"):
        events.append(sink.withColumn("created_at", F.current_timestamp()), "/proc/nowhere")
    assert made.count() == 5


@pytest.fixture(scope="module")
def exports(spark, small):
    return queries._exports(spark, small)


def test_documents(spark, exports, tmp_path):
    bodies = [json.loads(r["json"]) for r in documents.profile_json(exports).limit(2).collect()]
    doc = {"schema_version": "batch-1.0", "profiles": [{"label": "a", "result": bodies[0]}, {"label": "b", "profile": bodies[1]}, {"label": "c"}]}
    path = tmp_path / "batch.json"
    path.write_text(json.dumps(doc))
    assert sorted(r["label"] for r in documents.initial(spark, str(path)).collect()) == ["a", "b"]
    assert documents.initial(spark, None).count() == 0
    with pytest.raises(ValueError, match="every entry"):
        documents.imported(spark, str(path))
    path.write_text(json.dumps(doc | {"profiles": doc["profiles"][:2]}))
    rows = documents.imported(spark, str(path))
    assert rows.count() == 2
    again = tmp_path / "again.json"
    again.write_text(documents.batch_documents(rows).first()["json"])
    assert documents.imported(spark, str(again)).first()["result"]["model"]["dimensions"] == 64
    for bad in ("[1, 2", json.dumps({"profiles": None})):
        path.write_text(bad)
        with pytest.raises(Exception, match="list of profiles|reading file|[Mm]alformed"):
            documents.entries(spark, str(path)).collect()


def test_catalogue_tables(spark, exports, tmp_path):
    documents.write_catalogue(exports, str(tmp_path))
    vectors = documents.read_vectors(spark, str(tmp_path))
    assert vectors.count() == 30 == 3 * spark.read.parquet(f"{tmp_path}/profiles").count()
    plan = vectors.filter("role = 'global' and model_revision = 'spectral-1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" in plan
    documents.write_profiles(exports, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 10


def test_telemetry(spark, tmp_path):
    rows = spark.sql("SELECT '1' AS event_id, timestamp'2024-01-01' AS created_at, 'j' AS job_id, 'job_failed' AS event_name, 1.0D AS duration_ms, '{}' AS properties")
    path = str(tmp_path / "t")
    events.append(rows, path, enabled=False)
    events.append(rows, path)
    events.append(rows, path)
    assert events.read(spark, path).filter("event_name = 'job_failed'").count() == 2


def test_stream_refreshes_touched_profiles(spark, tmp_path):
    schema = "profile_id string, clip_ix int, embedding array<double>"
    vectors = np.random.default_rng(1).normal(size=(40, 4)).tolist()
    source = tmp_path / "in"
    step = streams.refresh_profiles(str(tmp_path / "out"), str(tmp_path / "clips"), lambda c: profiles.aggregate(c))

    def add(name, first, last):
        rows = [(name, i, vectors[i]) for i in range(first, last)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        started = spark.readStream.schema(schema).parquet(str(source)).writeStream.foreachBatch(step)
        started.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    add("a", 0, 10)
    add("b", 0, 12)
    add("a", 10, 20)
    found = {r["profile_id"]: r for r in streams.current_profiles(spark.read.parquet(str(tmp_path / "out"))).collect()}
    wanted = spark.createDataFrame([("a", i, vectors[i]) for i in range(20)] + [("b", i, vectors[i]) for i in range(12)], schema)
    for r in profiles.aggregate(wanted).collect():
        assert found[r["profile_id"]]["assignments"] == r["assignments"]


def test_profiles_are_not_broadcast(spark, small):
    """Their rows hold three vectors each, whatever the optimizer takes them for."""
    made = queries.QUERIES["profile_job_contract"](spark, small)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "LeftOuter" in line]
