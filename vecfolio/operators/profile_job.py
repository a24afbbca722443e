"""The whole job: recordings in, by file or as decoded windows, one profile export each out.

Windows are measured and the usable ones embedded in one Arrow pass, where they
are decoded; only vectors are shuffled, once, to their recording. A recording
that can't have a profile gets a row with its error and doesn't stop the others;
one window that can't be decoded fails its recording.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.display import timecode
from ..functions.vectors import shown_vector
from . import contract, density, profiles, sampling
from ..sources.recordings import TOO_LONG, read_windows
from .embedding import BATCH, EMBEDDERS, MODELS, make_embedder
from .quality import TOGETHER, QualityRules, measure, reason_of

NO_WINDOWS = "no window is usable"
UNREADABLE = "the recording can't be decoded"
NO_DIRECTION = "a window's vector has no direction"
#: What telemetry calls the errors; any other is one of reading.
ERROR_TYPES = {NO_WINDOWS: "NoUsableWindows", TOO_LONG: "RecordingTooLong", NO_DIRECTION: "NoDirection"}


def error_type(error: Column) -> Column:
    """The kind of an error, without its message; null without one."""
    kind = F.lit("UnreadableRecording")
    for message, name in ERROR_TYPES.items():
        kind = F.when(error == message, name).otherwise(kind)
    return F.when(error.isNotNull(), kind)


def embedded(windows: DataFrame, rules: QualityRules = QualityRules(), embedder: str = "spectral", batch: int = BATCH, **options) -> DataFrame:
    """``windows`` with reason, filter_ms, embed_ms, load_ms and embedding in place of their array column ``samples``.

    Only windows without a reason are embedded, up to ``batch`` at once.
    """
    make = EMBEDDERS[embedder] if embedder in EMBEDDERS else make_embedder(embedder)
    kept = [c for c in windows.columns if c != "samples"]
    made = {"reason": StringType(), "filter_ms": DoubleType(), "embed_ms": DoubleType(), "load_ms": DoubleType(), "embedding": ArrayType(DoubleType())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began = time.perf_counter()
        embed = make(**options)
        load = 1000 * (time.perf_counter() - began)
        for whole in batches:
            for at in range(0, whole.num_rows, max(batch, TOGETHER)):
                part = whole.slice(at, max(batch, TOGETHER))
                samples = part.column(len(kept)).to_numpy(zero_copy_only=False)
                reasons, filtering = [], []
                for x in samples:
                    began = time.perf_counter()
                    reasons.append(reason_of(measure(x, rules), rules))
                    filtering.append(1000 * (time.perf_counter() - began))
                good = [i for i, r in enumerate(reasons) if r is None]
                vectors: list = [None] * len(samples)
                spent = [0.0] * len(samples)
                for first in range(0, len(good), batch):
                    some = good[first : first + batch]
                    began = time.perf_counter()
                    for i, v in zip(some, embed([samples[i] for i in some])):
                        vectors[i] = v
                    for i in some:
                        spent[i] = 1000 * (time.perf_counter() - began) / len(some)
                columns = [pa.array(reasons, pa.string()), pa.array(filtering, pa.float64()), pa.array(spent, pa.float64()), pa.array([load] * len(spent)), pa.array(vectors, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], [*kept, *made])

    fields = [windows.schema[c] for c in kept] + [StructField(n, kind) for n, kind in made.items()]
    return windows.select(*kept, "samples").mapInArrow(run, StructType(fields))


#: Times of a recording; elapsed is from its first window's beginning to its profile.
TIMES = ("probe_ms", "decode_ms", "filter_ms", "embed_ms")
_COUNTS = (
    "error string, duration_s double, considered int, retained int, filtered int, filter_counts map<string,int>, dimensions int, low_start double, high_start double, "
    "probe_ms double, decode_ms double, filter_ms double, embed_ms double, load_ms double, elapsed_ms double"
)
#: Columns of windows that needn't be there.
_OPTIONAL = {"error": "string", "duration_s": "double", "probe_ms": "double", "decode_ms": "double", "load_ms": "double", "began": "double"}


def outcomes(rows: DataFrame, fraction: float = 0.0) -> DataFrame:
    """One row for each profile of rows as ``embedded`` returns: its counts, times and ``profiles.SUMMARY``, or an error.

    A row with an ``error`` is no window but fails its profile; of several the
    first by window counts.
    """
    density.check_fraction(fraction)
    kind = rows.schema["profile_id"].dataType.simpleString()
    columns = f"{_COUNTS}, {profiles.SUMMARY}"
    kinds = (pa.string(), pa.float64(), *[pa.int32()] * 3, pa.map_(pa.string(), pa.int32()), pa.int32(), *[pa.float64()] * 8)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        who = t.column("profile_id").slice(0, 1)
        t = t.sort_by("window_ix")
        known = {c: [v for v in t.column(c).to_pylist() if v is not None] for c in (*TIMES, "error", "duration_s", "load_ms", "began")}
        t = t.filter(pc.is_null(t.column("error"))) if known["error"] else t
        reasons, starts = t.column("reason").to_pylist(), t.column("start_s").to_numpy(zero_copy_only=False)
        counts: dict[str, int] = {}
        for r in sorted(r for r in reasons if r is not None):
            counts[r] = counts.get(r, 0) + 1
        good = np.array([r is None for r in reasons], bool)
        unit = [v for v, ok in zip(t.column("embedding").to_numpy(), good) if ok]
        error = known["error"][0] if known["error"] else None if len(unit) else NO_WINDOWS
        made, ends, size = [None] * len(profiles.KINDS), (None, None), None
        if len(unit) and error is None:
            matrix = np.stack(unit)
            lengths = np.sqrt((matrix * matrix).sum(axis=1))
            if (lengths <= profiles.LEAST_NORM).any() or not np.isfinite(lengths).all():
                error = NO_DIRECTION
            else:
                size, matrix = matrix.shape[1], matrix / lengths[:, None]
                made = [c[0] for c in profiles.summary(np.arange(len(matrix)), matrix, fraction)]
                at = dict(zip(names[len(kinds) :], made))
                ends = tuple(float(starts[good][at[f"{side}_clip"].as_py()]) for side in ("low", "high"))
        spent = [float(sum(known[c])) for c in TIMES]
        elapsed = 1000 * (time.time() - min(known["began"])) if known["began"] else None
        first = [error, max(known["duration_s"], default=None), len(reasons), int(good.sum()), int((~good).sum()), list(counts.items()), size, *ends, *spent, max(known["load_ms"], default=None), elapsed]
        arrays = [pa.array([v], k) for v, k in zip(first, kinds)]
        arrays += [pa.array([v.as_py() if v is not None else None], k) for v, k in zip(made, profiles.KINDS)]
        return pa.table([who, *arrays], ["profile_id", *names])

    optional = [(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in _OPTIONAL.items()]
    narrow = rows.select("profile_id", "window_ix", F.col("start_s").cast("double").alias("start_s"), "reason", "filter_ms", "embed_ms", "embedding", *optional)
    return narrow.groupBy("profile_id").applyInArrow(run, f"profile_id {kind}, {columns}")


def run_jobs(
    recordings: DataFrame,
    windows: DataFrame,
    rules: QualityRules = QualityRules(),
    fraction: float = 0.0,
    most_seconds: float = 14_400.0,
    embedder: str = "spectral",
    **options,
) -> DataFrame:
    """A row for each of ``recordings`` (profile_id, duration_s): ``error``, or what an export holds.

    ``windows`` are (profile_id, window_ix, start_s, samples), and may have an
    ``error``, which fails the recording, and times of decoding as ``read_windows`` gives.
    """
    allowed = sampling.within_limit(F.col("duration_s"), most_seconds)
    taken = windows.join(recordings.filter(allowed).select("profile_id"), "profile_id", "left_semi")
    found = outcomes(embedded(taken, rules, embedder, **options), fraction)
    # profiles look small to the optimizer, and hold three vectors each: never sent whole
    met = recordings.select("profile_id", "duration_s").join(found.drop("duration_s").hint("merge"), "profile_id", "left")
    why = F.when(F.col("duration_s").isNull(), UNREADABLE).when(~allowed, TOO_LONG).when(F.col("considered").isNull(), UNREADABLE)
    return met.withColumn("error", F.coalesce(why, "error")).withColumn("error_type", error_type(F.col("error")))


def run_files(
    spark: SparkSession,
    path: str,
    interval: float = 25.0,
    rules: QualityRules = QualityRules(),
    fraction: float = 0.0,
    most_seconds: float = 14_400.0,
    embedder: str = "spectral",
    reading: dict | None = None,
    **options,
) -> DataFrame:
    """From files to profiles: a row for each audio file below ``path`` (its path as profile_id), as ``run_jobs`` returns.

    ``reading`` are further options of the source of windows; ``export_rows`` makes the documents.
    """
    windows = read_windows(spark, path, interval, most_seconds=most_seconds, **(reading or {})).withColumnRenamed("path", "profile_id")
    found = outcomes(embedded(windows.drop("rate"), rules, embedder, **options), fraction)
    return found.withColumn("error_type", error_type(F.col("error")))


def timing() -> tuple[dict[str, Column], Column]:
    """Milliseconds that the stages of a job took, and its total: what passed by, or the stages' sum if they ran side by side."""
    spent = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in (*TIMES, "aggregate_ms", "elapsed_ms")}
    stages = {
        "probe": spent["probe_ms"], "decode_and_filter": spent["decode_ms"] + spent["filter_ms"], "filter_compute": spent["filter_ms"],
        "embed": spent["embed_ms"], "aggregate": spent["aggregate_ms"],
    }
    total = F.greatest(spent["elapsed_ms"], stages["probe"] + stages["decode_and_filter"] + stages["embed"] + stages["aggregate"])
    return stages, total


def export_rows(
    jobs: DataFrame, fraction: float, interval: int = 25, window: float = sampling.WINDOW_SECONDS, embedder: str = "spectral"
) -> DataFrame:
    """The export documents, as rows of the contract's columns, of the jobs without an error."""
    model = MODELS[embedder]

    def snippet(side: str) -> Column:
        start = F.round(f"{side}_start", 3)
        return F.struct(
            F.lit(side).alias("side"), F.col(f"{side}_clip").alias("retained_clip_index"), start.alias("start_seconds"), timecode(start).alias("timecode")
        )

    def ms(c: Column) -> Column:
        return F.round(c).cast("int")

    stages, total = timing()
    vectors = F.transform("vectors", lambda v: F.struct(v["role"].alias("role"), F.round(v["weight"], 6).alias("weight"), shown_vector(v["vector"], 8).alias("vector")))
    return jobs.filter("error is null").select(
        F.col("profile_id").cast("string").alias("profile_id"),
        F.lit(contract.SCHEMA_VERSION).alias("schema_version"),
        F.struct(
            F.lit(model["id"]).alias("id"), F.lit(model["revision"]).alias("revision"), "dimensions",
            F.lit("cpu").alias("device"), F.lit(model["backend"]).alias("backend"), F.coalesce(ms(F.col("load_ms")), F.lit(0)).alias("load_duration_ms"),
        ).alias("model"),
        F.struct(
            F.round("duration_s", 3).alias("duration_seconds"), F.lit(interval).alias("sample_interval_seconds"), F.lit(window).alias("window_seconds"),
            F.col("considered").alias("windows_considered"), F.col("retained").alias("windows_retained"), F.col("filtered").alias("windows_filtered"), "filter_counts",
        ).alias("source"),
        F.struct(
            F.lit(contract.METHOD).alias("method"), F.lit(contract.METHOD_VERSION).alias("version"), F.col("strategy").alias("cluster_strategy"),
            F.lit(contract.OUTLIER_METHODS[int(fraction > 0)]).alias("outlier_method"), F.lit(fraction).alias("max_outlier_fraction"),
            F.size("assignments").alias("input_clip_count"), F.col("core_count").cast("int").alias("core_clip_count"),
            F.size("outliers").alias("embedding_outlier_count"), F.round("threshold", 8).alias("local_density_threshold"), vectors.alias("vectors"),
        ).alias("aggregation"),
        F.struct(
            F.transform("variance", lambda x: F.round(x, 6)).alias("pca_explained_variance_ratio"),
            F.array(snippet("low"), snippet("high")).alias("pca_extreme_snippets"), F.round("diversity", 6).alias("diversity"),
        ).alias("diagnostics"),
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in (*stages, "total")]), F.array(*[ms(c) for c in (*stages.values(), total)])
        ).alias("timing_ms"),
    )
