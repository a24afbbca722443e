"""Jobs and their telemetry, derived from an append-only table of events.

Events are rows (event_id, created_at, job_id, event_name, duration_ms,
properties): properties are compact JSON with sorted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile_job import timing

#: Event names and what they say about a job.
STATUS_OF = {"job_submitted": "queued", "job_processing": "processing", "job_completed": "complete", "job_failed": "failed"}
#: Progress at the steps of a job.
PROBED, SAMPLING, SAMPLED, AGGREGATING, DONE = 0.02, 0.06, 0.84, 0.94, 1.0
#: Properties of the event kinds.
PROPERTIES = {
    "job_submitted": "sample_interval_seconds int, max_outlier_fraction double",
    "job_completed": "windows_considered int, windows_retained int, windows_filtered int, filter_counts map<string,int>, aggregation_core_clip_count int, "
    "embedding_outlier_count int, duration_seconds double, timing_ms map<string,int>, model_load_ms int, batch_size int, torch_threads int, "
    "interval_seconds int, embedding_outlier_max_fraction double",
    "job_failed": "error_type string",
}


def progress(stage: Column, done: Column, planned: Column) -> Column:
    """Progress of a job by its stage; while sampling by windows done."""
    share = F.lit(SAMPLING) + F.lit(SAMPLED) * done / F.greatest(planned, F.lit(1))
    return (
        F.when(stage == "probe", PROBED).when(stage == "sample", share).when(stage == "aggregate", AGGREGATING).when(stage == "complete", DONE)
    )


def latest(events: DataFrame, job: str = "job_id") -> DataFrame:
    """(job_id, event_name, created_at, event_id, n_events) of each job's last event, by time and then id."""
    last = F.max(F.struct("created_at", "event_id", "event_name")).alias("last")
    found = events.groupBy(job).agg(last, F.count(F.lit(1)).alias("n_events"))
    return found.select(job, "last.event_name", "last.created_at", "last.event_id", "n_events")


def status(event_name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])[event_name]


def public(jobs: DataFrame) -> DataFrame:
    """Job rows as shown: without created_at, and the result only once complete."""
    return jobs.withColumn("result", F.when(F.col("status") == "complete", F.col("result"))).drop("created_at")


def properties_json(**values: Column) -> Column:
    """Compact JSON of the values with sorted keys."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))


def parsed(events: DataFrame, event_name: str) -> DataFrame:
    """Events of one kind with their properties as a typed struct; ``raw`` is the text."""
    kind = events.filter(F.col("event_name") == event_name).withColumn("raw", F.col("properties"))
    return kind.withColumn("properties", F.from_json("properties", PROPERTIES[event_name]))


def loosely_parsed(events: DataFrame) -> DataFrame:
    """Events with their properties as a VARIANT, whatever their kind; ``problem`` names properties that aren't JSON objects, and none are lost."""
    rows = events.withColumn("properties", F.try_parse_json("raw")) if "raw" in events.columns else events.withColumn("raw", F.col("properties")).withColumn("properties", F.try_parse_json("properties"))
    shape = F.schema_of_variant("properties")
    wrong = F.when(F.col("raw").isNull(), "no properties").when(F.col("properties").isNull(), "not JSON").when(~shape.startswith("OBJECT"), "not an object")
    return rows.withColumn("problem", wrong)


def property_of(path: str, kind: str) -> Column:
    """A property of ``loosely_parsed`` events by its path; null if it isn't there or isn't of that kind."""
    return F.try_variant_get(F.col("properties"), path, kind)


def outcome_events(outcomes: DataFrame, interval: int, fraction: float, batch: int) -> DataFrame:
    """(job_id, event_name, duration_ms, properties) of finished jobs, rows as ``profile_job.run_jobs`` returns."""
    c = F.col
    stages, spent = timing()
    times = F.create_map(*[x for n, ms in {**stages, "total": spent}.items() for x in (F.lit(n), F.round(ms).cast("int"))])
    done = properties_json(
        windows_considered=c("considered"), windows_retained=c("retained"), windows_filtered=c("filtered"), filter_counts=c("filter_counts"),
        aggregation_core_clip_count=c("core_count").cast("int"), embedding_outlier_count=F.size("outliers"), duration_seconds=c("duration_s"),
        timing_ms=times, model_load_ms=F.coalesce(F.round("load_ms").cast("int"), F.lit(0)), batch_size=F.lit(batch), torch_threads=F.lit(1), interval_seconds=F.lit(interval),
        embedding_outlier_max_fraction=F.lit(fraction),
    )
    failed = c("error").isNotNull()
    return outcomes.select(
        c("profile_id").cast("string").alias("job_id"),
        F.when(failed, "job_failed").otherwise("job_completed").alias("event_name"),
        F.coalesce(spent, F.lit(0.0)).alias("duration_ms"),
        F.when(failed, properties_json(error_type=c("error_type"))).otherwise(done).alias("properties"),
    )
