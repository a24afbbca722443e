"""The job machine on a stream, stopped and started again, against a plain loop."""

import datetime as dt
import random

from vecfolio.streaming import jobs as machines

SCHEMA = "job_id long, event_id long, created_at timestamp, event_name string, progress double"
START = dt.datetime(2024, 1, 1)


def made(n=400, jobs=12):
    r = random.Random(3)
    names = [*machines.ALLOWED, "job_processing", "job_processing", "job_submitted", "other", None]
    rows = []
    for i in range(n):
        job = r.randrange(jobs)
        rows.append((job, i, START + dt.timedelta(seconds=900 * (i // 2) + 7 * (i % 2)), r.choice(names), r.choice([None, round(r.random(), 3)])))
    return rows


def plain(rows, expiry, watermark):
    out, state = [], {}
    for job, event, at, name, progress in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        status, done, updated = state.get(job, ("", 0.0, START))
        if status in ("queued", "processing") and at > updated + expiry:
            status, updated = "failed", updated + expiry
            out.append((job, -1, "failed", done, True))
        sources, target = machines.ALLOWED.get(name, (set(), ""))
        good = status in sources
        if good:
            done = 1.0 if target == "complete" else max(done, progress) if target == "processing" and progress is not None else done
            status, updated = target, at
        state[job] = (status, done, updated)
        out.append((job, event, status or None, done, good))
    for job, (status, done, updated) in state.items():
        if status in ("queued", "processing") and updated + expiry < watermark:
            out.append((job, -1, "failed", done, True))
    return sorted(out, key=str)


def outcomes(spark, source, path, expiry):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    found = machines.drained(spark, machines.job_outcomes(stream, "10 minutes", expiry), path)
    return sorted(((r["job_id"], r["event_id"], r["status"], r["progress"], r["accepted"]) for r in found.collect()), key=str)


def test_restarted_machine(spark, tmp_path):
    rows = made()
    expiry = dt.timedelta(hours=6)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    half = rows[200][2]
    for part in ([x for x in rows if x[2] < half], [x for x in rows if x[2] >= half]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        found = outcomes(spark, source, path, 6 * 3600)
    wanted = plain(rows, expiry, max(x[2] for x in rows) - dt.timedelta(minutes=10))
    assert found == wanted
    assert any(x[1] == -1 for x in found) and any(not x[4] for x in found)
    # nothing new: nothing is given twice
    assert outcomes(spark, source, path, 6 * 3600) == wanted


def test_progress_stays_on_failure(spark, tmp_path):
    at = [START + dt.timedelta(minutes=m) for m in range(6)]
    rows = [(1, 0, at[0], "job_submitted", None), (1, 1, at[1], "job_processing", 0.4), (1, 2, at[2], "job_processing", 0.2), (1, 3, at[3], "job_failed", None), (1, 4, at[4], "job_completed", None), (2, 5, at[5], "job_completed", 0.5)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    found = outcomes(spark, f"{tmp_path}/in", f"{tmp_path}/out", 3600)
    assert found == sorted([(1, 0, "queued", 0.0, True), (1, 1, "processing", 0.4, True), (1, 2, "processing", 0.4, True), (1, 3, "failed", 0.4, True), (1, 4, "failed", 0.4, False), (2, 5, None, 0.0, False)], key=str)
