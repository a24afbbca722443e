"""The profile queries, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display
from ..functions.vectors import dot, shown
from ..operators import atlas, catalogue, contract, density, diagnostics, embedding, evaluation, jobs, library, nearest, profiles, quality, sampling, vector_index
from ..operators import profile_job as profile_job_operator
from ..sources import profiles as documents
from ..sources import keyed, recordings
from ..scratch import scratch
from ..streaming import jobs as machines
from ..streaming import profiles as streams
from ..streaming import tables as stream_tables
from . import clips as data

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: The shared tables have 45 to 99 samples a window, so frames and strides are short.
RULES = quality.QualityRules(frame=8, stride=1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("WITH ", "WITH RECURSIVE ", 1) if "UNION ALL" in sql and sql.startswith("WITH ") and "RECURSIVE" not in sql else sql
        return f

    return add


# --- SQL parts -----------------------------------------------------------------

_UNIT = """
clips AS (SELECT CAST(label AS INTEGER) AS profile_id,
  CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS clip_ix, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
unit AS (SELECT profile_id, clip_ix, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM clips)"""
_HALVES = _UNIT.replace("CAST(label AS", "CAST(label * 2 + vec_id % 2 AS").replace("BY label", "BY label, vec_id % 2")


def _of_source(sql: str) -> str:
    """The SQL over a table ``src`` of named profiles."""
    return sql.replace("CAST(label AS INTEGER)", "label").replace("FROM embeddings", "FROM src")


def _means(rows: str, keys: str, name: str) -> str:
    """CTEs: unit mean vector ``g`` of column u over rows, by keys."""
    return f"""
{name}_p AS (SELECT {keys}, unnest(u) AS x, unnest(range(len(u))) AS d FROM {rows}),
{name}_m AS (SELECT {keys}, list(m ORDER BY d) AS m FROM (SELECT {keys}, d, avg(x) AS m FROM {name}_p GROUP BY {keys}, d) GROUP BY {keys}),
{name} AS (SELECT {keys}, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS g FROM {name}_m)"""


_GLOBAL = _UNIT + "," + _means("unit", "profile_id", "whole")

_DENSITY = (
    _UNIT
    + """,
sims AS (SELECT a.profile_id, a.clip_ix, list_dot_product(a.u, b.u) AS s FROM unit a JOIN unit b ON a.profile_id = b.profile_id AND a.clip_ix <> b.clip_ix),
sizes AS (SELECT profile_id, count(*) AS n FROM unit GROUP BY profile_id),
ranked AS (SELECT s.*, n, row_number() OVER (PARTITION BY s.profile_id, clip_ix ORDER BY s DESC) AS r FROM sims s JOIN sizes USING (profile_id)),
density AS (SELECT profile_id, clip_ix, any_value(n) AS n, avg(s) AS density FROM ranked WHERE r <= least(n - 1, greatest(3, round(sqrt(n)))) GROUP BY ALL),
med AS (SELECT profile_id, any_value(n) AS n, median(density) AS median FROM density GROUP BY profile_id),
lim AS (SELECT profile_id, any_value(m.n) AS n, any_value(median) AS median, median(abs(density - median)) AS mad
  FROM density JOIN med m USING (profile_id) GROUP BY profile_id),
limits AS (SELECT *, median - 3.5::DOUBLE * greatest(1.4826::DOUBLE * mad, 1e-6::DOUBLE) AS threshold FROM lim)"""
)

_KMEANS_TAIL = (
    ","
    + _means("{unit}", "profile_id", "whole")
    + """,
first_ AS (SELECT profile_id, arg_max(clip_ix, (s, -clip_ix)) AS first_clip FROM
  (SELECT u.profile_id, clip_ix, list_dot_product(u.u, g.g) AS s FROM {unit} u JOIN whole g USING (profile_id)) GROUP BY profile_id),
second_ AS (SELECT profile_id, any_value(first_clip) AS first_clip, arg_min(clip_ix, (s, clip_ix)) AS second_clip FROM
  (SELECT u.profile_id, u.clip_ix, f.first_clip, list_dot_product(u.u, c.u) AS s FROM {unit} u JOIN first_ f USING (profile_id)
   JOIN {unit} c ON c.profile_id = u.profile_id AND c.clip_ix = f.first_clip) GROUP BY profile_id),
state AS (
  SELECT 0 AS k, s.profile_id, a.u AS c0, b.u AS c1, false AS forced, CAST(NULL AS INT[]) AS sides, CAST(0 AS BIGINT) AS n0, CAST(0 AS BIGINT) AS n, false AS settled FROM second_ s
    JOIN {unit} a ON a.profile_id = s.profile_id AND a.clip_ix = s.first_clip JOIN {unit} b ON b.profile_id = s.profile_id AND b.clip_ix = s.second_clip"""
)


#: The sum of the vectors of a side, in clip order.
_SIDE_SUM = "list_reduce(list(u ORDER BY clip_ix) FILTER (side = {k}), lambda a, b: list_transform(list_zip(a, b), lambda x: x[1] + x[2]))"


def _near(a: str, b: str) -> str:
    return f"list_bool_and(list_transform(list_zip({a}, {b}), lambda x: abs(x[1] - x[2]) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(x[2])))"


def _kmeans(unit: str) -> str:
    """CTEs: two-centre clustering by plain rounds until its stop rule; ``done`` has (profile_id, clip_ix, cluster) and ``placed`` the centres."""
    unit_of = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"
    return _KMEANS_TAIL.replace("{unit}", unit) + f"""
  UNION ALL
  SELECT k, profile_id, m0, m1, forced, sides, n0, n, coalesce(sides = before AND {_near('m0', 'c0')} AND {_near('m1', 'c1')}, false) FROM (
    SELECT *, {unit_of.format('s0')} AS m0, {unit_of.format('s1')} AS m1 FROM (
      SELECT profile_id, any_value(k) + 1 AS k, any_value(c0) AS c0, any_value(c1) AS c1, any_value(before) AS before, bool_or(forced) AS forced,
        list(side ORDER BY clip_ix) AS sides, count(*) FILTER (side = 0) AS n0, count(*) AS n, {_SIDE_SUM.format(k=0)} AS s0, {_SIDE_SUM.format(k=1)} AS s1 FROM (
        SELECT *, CASE WHEN least(on0, size - on0) >= (size + 9) // 10 THEN CAST(p < 0 AS INT)
            WHEN on0 < (size + 9) // 10 THEN CAST(r > (size + 9) // 10 AS INT) ELSE CAST(r > size - (size + 9) // 10 AS INT) END AS side,
          before_forced OR least(on0, size - on0) < (size + 9) // 10 AS forced FROM (
          SELECT *, count(*) OVER w AS size, count(*) FILTER (p >= 0) OVER w AS on0, row_number() OVER (PARTITION BY profile_id ORDER BY p DESC, clip_ix) AS r FROM (
            SELECT u.profile_id, u.clip_ix, u.u, s.k, s.c0, s.c1, s.sides AS before, s.forced AS before_forced, list_dot_product(u.u, s.c0) - list_dot_product(u.u, s.c1) AS p
            FROM {unit} u JOIN state s USING (profile_id) WHERE NOT s.settled AND s.k < 50)
          WINDOW w AS (PARTITION BY profile_id)))
      GROUP BY profile_id))),
last_ AS MATERIALIZED (SELECT * FROM state WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY k DESC) = 1),
each_ AS (SELECT profile_id, 0 AS side, n0 AS n, c0 AS g, forced FROM last_ UNION ALL SELECT profile_id, 1, n - n0, c1, forced FROM last_),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, g[1:8]) - 1 AS cluster FROM each_),
listed AS (SELECT profile_id, unnest(sides) AS side, unnest(range(len(sides))) AS i FROM last_),
done AS (SELECT l.profile_id, c.clip_ix, cluster FROM listed l JOIN placed p USING (profile_id, side)
  JOIN (SELECT profile_id, clip_ix, row_number() OVER (PARTITION BY profile_id ORDER BY clip_ix) - 1 AS i FROM {unit}) c ON c.profile_id = l.profile_id AND c.i = l.i)"""


def _axes(rows: str, key: str, n_axes: int, squarings: int = 13) -> str:
    """CTEs: principal axes of vectors u of rows (key, c, u): ``cen`` (key, c, d, x), ``scatter``, and ``axis{k}`` (key, i, x) with ``value{k}`` (key, v, whole).

    The scatter matrix, squared again and again, turns into its first axis; then that is taken out.
    """
    sql = f"""
cen AS MATERIALIZED (SELECT {key}, c, d, x - avg(x) OVER (PARTITION BY {key}, d) AS x FROM (SELECT {key}, c, unnest(u) AS x, unnest(range(len(u))) AS d FROM {rows})),
scatter0 AS MATERIALIZED (SELECT {key}, a.d AS i, b.d AS j, sum(a.x * b.x) AS v FROM cen a JOIN cen b USING ({key}, c) GROUP BY ALL)"""
    for k in range(n_axes):
        before = f"scatter{k}"
        for q in range(squarings):
            sql += f""",
p{k}_{q} AS MATERIALIZED (SELECT {key}, i, j, v / sum(CASE WHEN i = j THEN v ELSE 0 END) OVER (PARTITION BY {key}) AS v FROM
  (SELECT {key}, a.i, b.j, sum(a.v * b.v) AS v FROM {before} a JOIN {before} b USING ({key}) WHERE a.j = b.i GROUP BY ALL))"""
            before = f"p{k}_{q}"
        sql += f""",
axis{k} AS MATERIALIZED (SELECT {key}, i, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS x FROM {before} JOIN
  (SELECT {key}, arg_max(j, v) AS j FROM {before} WHERE i = j GROUP BY {key}) USING ({key}, j)),
value{k} AS MATERIALIZED (SELECT {key}, sum(s.v * a.x * b.x) AS v, sum(CASE WHEN s.i = s.j THEN s.v ELSE 0 END) AS left_ FROM scatter{k} s
  JOIN axis{k} a USING ({key}, i) JOIN (SELECT {key}, i AS j, x FROM axis{k}) b USING ({key}, j) GROUP BY {key}),
scatter{k + 1} AS MATERIALIZED (SELECT {key}, s.i, j, s.v - l.v * a.x * b.x AS v FROM scatter{k} s
  JOIN axis{k} a USING ({key}, i) JOIN (SELECT {key}, i AS j, x FROM axis{k}) b USING ({key}, j) JOIN value{k} l USING ({key}))"""
    return sql + f""",
whole_value AS (SELECT {key}, sum(v) AS v FROM scatter0 WHERE i = j GROUP BY {key}),
shares AS (""" + " UNION ALL ".join(f"SELECT {key}, {k} AS axis, greatest(value{k}.v, 0) / w.v AS share FROM value{k} JOIN whole_value w USING ({key})" for k in range(n_axes)) + ")"


_CLUSTERED = _UNIT + _kmeans("unit")
_HALVES_CLUSTERED = _HALVES + _kmeans("unit")


def _quality(raw: str, keys: str, frame: int = 2048, stride: int = 8, cap: int = 65_536) -> str:
    """CTEs: the metrics and reasons ``decided`` of windows named by ``keys``, of rows (keys, n, x)."""
    red = f"{keys}, n // {stride} AS i, x"
    return f"""
every AS ({raw}),
bad AS (SELECT {keys}, bool_or(isnan(x)) AS bad FROM every GROUP BY {keys}),
raw AS (SELECT e.* FROM every e JOIN bad USING ({keys}) WHERE NOT bad),
tm AS (SELECT {keys}, 20 * log10(greatest(sqrt(avg(x * x)), 1e-12::DOUBLE)) AS rms_dbfs, max(abs(x)) AS peak,
  avg(CASE WHEN abs(x) >= CAST(0.999 AS FLOAT)::DOUBLE THEN 1::DOUBLE ELSE 0::DOUBLE END) AS clipped_ratio, abs(avg(x)) AS dc_offset FROM raw GROUP BY {keys}),
fr AS (SELECT {keys}, n // {frame} AS f, sqrt(avg(x * x)) AS rms, count(*) AS size FROM raw GROUP BY ALL),
act AS (SELECT {keys}, coalesce(avg(CASE WHEN rms > pow(10::DOUBLE, -2.7::DOUBLE) THEN 1::DOUBLE ELSE 0::DOUBLE END) FILTER (size = {frame}), 1::DOUBLE) AS active_ratio FROM fr GROUP BY {keys}),
red AS (SELECT {red} FROM raw WHERE n % {stride} = 0),
zc AS (SELECT {keys}, avg(CASE WHEN low <> next THEN 1::DOUBLE ELSE 0::DOUBLE END) FILTER (next IS NOT NULL) AS zero_crossing_rate FROM
  (SELECT {keys}, signbit(x) AS low, lead(signbit(x)) OVER (PARTITION BY {keys} ORDER BY i) AS next FROM red) GROUP BY {keys}),
len AS (SELECT {keys}, count(*) AS m FROM red WHERE i < {cap} GROUP BY {keys}),
freq AS (SELECT {keys}, m, unnest(range(m // 2 + 1)) AS k FROM len),
dft AS (SELECT {keys}, k, pow(sum(x * cos(2 * pi() * ((k * i) % m) / m)), 2) + pow(sum(x * sin(2 * pi() * ((k * i) % m) / m)), 2) AS p
  FROM freq f JOIN red r USING ({keys}) WHERE i < {cap} GROUP BY ALL),
fl AS (SELECT {keys}, exp(avg(ln(p + 1e-12::DOUBLE))) / greatest(avg(p), 1e-12::DOUBLE) AS spectral_flatness FROM dft GROUP BY {keys}),
decided AS (SELECT *, CASE WHEN bad THEN 'invalid' WHEN rms_dbfs < -48 THEN 'low_energy' WHEN active_ratio < 0.2 THEN 'mostly_silent' WHEN clipped_ratio > 0.02 THEN 'clipped'
  WHEN dc_offset > 0.2 THEN 'dc_offset' WHEN spectral_flatness > 0.92 AND coalesce(zero_crossing_rate, 0) > 0.35 THEN 'broadband_noise' END AS reason
  FROM bad LEFT JOIN tm USING ({keys}) LEFT JOIN act USING ({keys}) LEFT JOIN zc USING ({keys}) LEFT JOIN fl USING ({keys}))"""


_WAVE = _quality(
    """SELECT user_id, event_id // 100000 AS window_ix, row_number() OVER (PARTITION BY user_id, event_id // 100000 ORDER BY event_id) - 1 AS n,
  greatest(-1::DOUBLE, least(1::DOUBLE, (CASE WHEN event_id % 2 = 0 THEN 1::DOUBLE ELSE -1::DOUBLE END) * value / 100::DOUBLE
    * [1e-5::DOUBLE, 1::DOUBLE, 0.1::DOUBLE, 0.3::DOUBLE][user_id % 4 + 1] + CASE WHEN user_id % 4 = 3 THEN 0.3::DOUBLE ELSE 0::DOUBLE END)) AS x FROM events""",
    "user_id, window_ix", frame=8, stride=1,
)


def _generated(places: str, keys: str, length: int) -> str:
    """Rows (keys, n, x) of generated windows for a table of (keys, r, w)."""
    return f"""SELECT {keys}, n, CASE WHEN (r * 7 + w) % 40 = 39 AND n = 7 THEN 'nan'::DOUBLE ELSE CASE (r * 7 + w) % 8
    WHEN 3 THEN s * 0::DOUBLE WHEN 4 THEN CASE WHEN n < {length / 10}::DOUBLE THEN s * 0.2::DOUBLE ELSE 0::DOUBLE END WHEN 5 THEN CASE WHEN s > 0 THEN 1::DOUBLE ELSE -1::DOUBLE END
    WHEN 6 THEN s * 0.2::DOUBLE + 0.3::DOUBLE WHEN 7 THEN ((n * 7919 + (r * 31 + w) * 104729) % 10007)::DOUBLE / 10007::DOUBLE * 0.4::DOUBLE - 0.2::DOUBLE
    ELSE s * 0.2::DOUBLE END END AS x
  FROM (SELECT *, sin((2 * pi()) * (200 + 37 * ((r * 31 + w * 17) % 50)) / 48000::DOUBLE * n + 0.1::DOUBLE) AS s FROM ({places}), range({length}) t(n))"""


def _embedded(keys: str) -> str:
    """CTEs: unit vectors ``unit`` (keys, u) of the kept windows by the spectral embedder's default settings."""
    return f"""
few AS (SELECT {keys}, n // 16 AS i, x FROM raw JOIN decided USING ({keys}) WHERE reason IS NULL AND n % 16 = 0),
bins AS (SELECT b, 1 + b * 4095 // 511 AS k FROM range(512) t(b)),
mag AS (SELECT {keys}, b, ln(1 + sqrt(pow(sum(x * cos(2 * pi() * ((k * i) % 8192) / 8192)), 2) + pow(sum(x * sin(2 * pi() * ((k * i) % 8192) / 8192)), 2))) AS l FROM few, bins GROUP BY ALL),
mid AS (SELECT {keys}, b, l - avg(l) OVER (PARTITION BY {keys}) AS l FROM mag),
unit AS (SELECT {keys}, list(l / n ORDER BY b) AS u FROM (SELECT *, sqrt(sum(l * l) OVER (PARTITION BY {keys})) AS n FROM mid) GROUP BY {keys})"""


_DEFAULT = _quality(
    f"""SELECT w, (event_id % {data.TOGETHER}) * {data.HELD} + h AS n, CASE WHEN w % 16 = 15 AND event_id % {data.TOGETHER} = 3 THEN 'nan'::DOUBLE ELSE x END AS x FROM (
  SELECT event_id // {data.TOGETHER} AS w, event_id, greatest(-1::DOUBLE, least(1::DOUBLE, (CASE WHEN event_id % 2 = 0 THEN 1::DOUBLE ELSE -1::DOUBLE END) * value / 97::DOUBLE
    * [1e-5::DOUBLE, 1::DOUBLE, 0.1::DOUBLE, 0.3::DOUBLE][event_id // {data.TOGETHER} % 4 + 1] + CASE WHEN event_id // {data.TOGETHER} % 4 = 3 THEN 0.3::DOUBLE ELSE 0::DOUBLE END)) AS x FROM events),
  range({data.HELD}) t(h)""",
    "w",
)
_JOB = (
    f"""
recs AS (SELECT CAST(s_suppkey AS INTEGER) AS profile_id, CASE WHEN s_suppkey % 5 = 3 THEN {data.JOB_LONG}::DOUBLE ELSE {data.JOB_SECONDS}::DOUBLE END AS duration_s FROM supplier),
places AS (SELECT profile_id, w AS window_ix, CASE WHEN profile_id % 5 = 4 THEN 0 ELSE profile_id END AS r, CASE WHEN profile_id % 5 = 4 THEN 3 ELSE w END AS w
  FROM recs, range({data.JOB_WINDOWS}) t(w) WHERE duration_s <= 14400.5),"""
    + _quality(_generated("SELECT * FROM places", "profile_id, window_ix", data.JOB_SAMPLES), "profile_id, window_ix")
)

# --- sampling --------------------------------------------------------------------

_OFFSETS = """
off AS (SELECT doc_id AS recording_id, n_chars::DOUBLE AS d, n_chars::DOUBLE - 10 AS last,
  CAST(floor((n_chars::DOUBLE - 10 + 1e-6::DOUBLE) / 25) AS BIGINT) AS steps FROM documents),
grid AS (SELECT recording_id, 0::DOUBLE AS start_s FROM off WHERE d <= 10
  UNION ALL SELECT recording_id, unnest(range(steps + 1)) * 25::DOUBLE FROM off WHERE d > 10
  UNION ALL SELECT recording_id, last FROM off WHERE d > 10 AND last - steps * 25 >= 10)"""


@query(f"""WITH {_OFFSETS} SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_s) - 1 AS INTEGER) AS window_ix, start_s FROM grid""")
def sample_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.windows(data.recordings(spark, sf_dir), 25).select("recording_id", "window_ix", "start_s")


@query(f"WITH {_OFFSETS} SELECT recording_id, count(*) AS n FROM grid GROUP BY recording_id")
def offset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = sampling.offsets(F.col("duration_s"), F.lit(25.0))
    return data.recordings(spark, sf_dir).select("recording_id", F.size(starts).cast("long").alias("n"))


@query("""SELECT doc_id AS recording_id, printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) AS timecode
  FROM (SELECT doc_id, CAST(round_even(n_chars / 2.0::DOUBLE, 0) AS BIGINT) AS s FROM documents)""")
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.recordings(spark, sf_dir).select("recording_id", display.timecode(F.col("duration_s") / 2).alias("timecode"))


@query("""SELECT doc_id AS recording_id, n_chars <= 14400.5 AS within_limit,
  CASE WHEN coalesce(nullif(doc_id % 4 * 10, 0), 25) IN (20, 25, 30) THEN CAST(coalesce(nullif(doc_id % 4 * 10, 0), 25) AS DOUBLE) END AS interval_s,
  CASE WHEN doc_id % 5 / 20.0::DOUBLE IN (0, 0.05, 0.1) THEN doc_id % 5 / 20.0::DOUBLE END AS fraction FROM documents""")
def request_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.recordings(spark, sf_dir)
    return rows.select(
        "recording_id",
        sampling.within_limit(F.col("duration_s"), 14_400.0).alias("within_limit"),
        sampling.chosen_interval(F.col("recording_id") % 4 * 10).cast("double").alias("interval_s"),
        sampling.chosen_fraction(F.col("recording_id") % 5 / 20.0).alias("fraction"),
    )


# --- quality ---------------------------------------------------------------------

_KEY = ["user_id", "window_ix"]


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.analyse(data.windows(spark, sf_dir), RULES)


@query(f"WITH {_WAVE} SELECT user_id, window_ix, round(rms_dbfs, 3) AS rms_dbfs, round(peak, 6) AS peak, round(clipped_ratio, 6) AS clipped_ratio, round(dc_offset, 6) AS dc_offset FROM decided")
def signal_time_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select(*_KEY, *quality.shown_metrics()).select(*_KEY, "rms_dbfs", "peak", "clipped_ratio", "dc_offset")


@query(f"WITH {_WAVE} SELECT user_id, window_ix, round(active_ratio, 6) AS active_ratio FROM decided")
def signal_active_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select(*_KEY, shown(F.col("active_ratio")).alias("active_ratio"))


@query(f"WITH {_WAVE} SELECT user_id, window_ix, round(zero_crossing_rate, 6) AS zero_crossing_rate FROM decided")
def signal_zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select(*_KEY, shown(F.col("zero_crossing_rate")).alias("zero_crossing_rate"))


@query(f"WITH {_WAVE} SELECT user_id, window_ix, round(spectral_flatness, 6) AS spectral_flatness FROM decided")
def signal_spectral_flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select(*_KEY, shown(F.col("spectral_flatness")).alias("spectral_flatness"))


@query(f"WITH {_WAVE} SELECT user_id, window_ix, reason, reason IS NULL AS keep FROM decided")
def signal_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select(*_KEY, "reason", "keep")


@query(f"""WITH {_WAVE} SELECT recording, CAST(sum(n) AS BIGINT) AS considered, CAST(coalesce(sum(n) FILTER (reason IS NULL), 0) AS BIGINT) AS retained,
  CAST(coalesce(sum(n) FILTER (reason IS NOT NULL), 0) AS BIGINT) AS filtered,
  coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason) FILTER (reason IS NOT NULL), '') AS filter_counts
  FROM (SELECT user_id % 10 AS recording, reason, count(*) AS n FROM decided GROUP BY ALL) GROUP BY recording""")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.reason_histogram(_measured(spark, sf_dir), F.col("user_id") % 10)
    return found.withColumn("filter_counts", _pairs("filter_counts"))


def _pairs(column: str) -> Column:
    """A map from names to counts as sorted text."""
    each = F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(each, ",")


@query(f"""WITH {_DEFAULT} SELECT w, reason, round(rms_dbfs, 3) AS rms_dbfs, round(peak, 6) AS peak, round(clipped_ratio, 6) AS clipped_ratio, round(active_ratio, 6) AS active_ratio,
  round(dc_offset, 6) AS dc_offset, round(zero_crossing_rate, 6) AS zero_crossing_rate, round(spectral_flatness, 6) AS spectral_flatness FROM decided""")
def signal_default_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a second at 48 kHz of events, by the rules as they are shipped."""
    return quality.analyse(data.event_windows(spark, sf_dir)).select("w", "reason", *quality.shown_metrics())


@query(f"WITH {_DEFAULT},{_embedded('w')} SELECT w, i, round(u[i + 1], 6) + 0.0 AS value FROM unit, range(512) t(i)")
def spectral_embed_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept windows' vectors by the embedder's settings as they are shipped."""
    rows = profile_job_operator.embedded(data.event_windows(spark, sf_dir)).filter("reason is null")
    each = rows.select("w", F.posexplode("embedding").alias("i", "x"))
    return each.select("w", F.col("i").cast("long").alias("i"), shown(F.col("x")).alias("value"))


_WAVE_BINS = """
mag AS (SELECT user_id, window_ix, unnest([1, 3, 5, 7, 9, 11, 13, 16]) AS k FROM len),
spec AS (SELECT user_id, window_ix, k, ln(1 + sqrt(pow(sum(x * cos(2 * pi() * k * n / 32)), 2) + pow(sum(x * sin(2 * pi() * k * n / 32)), 2))) AS l
  FROM mag m JOIN raw r USING (user_id, window_ix) WHERE n < 32 GROUP BY ALL),
mid AS (SELECT user_id, window_ix, k, l - avg(l) OVER (PARTITION BY user_id, window_ix) AS l FROM spec)"""


@query(f"""WITH {_WAVE},{_WAVE_BINS}
SELECT user_id, window_ix, k AS bin, round(l / greatest(sqrt(sum(l * l) OVER (PARTITION BY user_id, window_ix)), 1e-12::DOUBLE), 6) + 0.0 AS value FROM mid""")
def spectral_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding.embed_windows(data.windows(spark, sf_dir), "spectral", n_fft=32, bins=8, stride=1)
    bins = F.array(*[F.lit(k) for k in (1, 3, 5, 7, 9, 11, 13, 16)])
    each = found.select(*_KEY, F.posexplode("embedding").alias("i", "x"))
    return each.select(*_KEY, bins[F.col("i")].alias("bin"), shown(F.col("x")).alias("value"))


# --- recordings ------------------------------------------------------------------------


#: Samples a second of the files that the events are written to, seconds of a window and between windows.
FILE_RATE, FILE_WINDOW, FILE_INTERVAL = 16, 2.0, 5.0

_FILES = f"""
sound AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n,
  trunc(greatest(-1::DOUBLE, least(1::DOUBLE, (CASE WHEN event_id % 2 = 0 THEN 1::DOUBLE ELSE -1::DOUBLE END) * value / 100::DOUBLE
    * [1e-5::DOUBLE, 1::DOUBLE, 0.1::DOUBLE, 0.3::DOUBLE][user_id % 4 + 1] + CASE WHEN user_id % 4 = 3 THEN 0.3::DOUBLE ELSE 0::DOUBLE END)) * 32767) / 32768 AS x FROM events),
lengths AS (SELECT user_id, count(*) / {FILE_RATE}::DOUBLE AS d FROM sound GROUP BY user_id),
steps AS (SELECT *, CAST(floor((d - {FILE_WINDOW} + 1e-6::DOUBLE) / {FILE_INTERVAL}) AS BIGINT) AS steps FROM lengths WHERE d <= 100.5 AND user_id % 7 <> 5),
grid AS (SELECT user_id, 0::DOUBLE AS start_s FROM steps WHERE d <= {FILE_WINDOW}
  UNION ALL SELECT user_id, unnest(range(steps + 1)) * {FILE_INTERVAL}::DOUBLE FROM steps WHERE d > {FILE_WINDOW}
  UNION ALL SELECT user_id, round_even(d - {FILE_WINDOW}, 3) FROM steps WHERE d > {FILE_WINDOW} AND d - {FILE_WINDOW} - steps * {FILE_INTERVAL} >= {FILE_WINDOW}),
placed AS (SELECT user_id, start_s, row_number() OVER (PARTITION BY user_id ORDER BY start_s) - 1 AS window_ix FROM grid),
heard AS (SELECT user_id, window_ix, start_s, n - round_even(start_s * {FILE_RATE}, 0) AS n, CAST(x AS FLOAT)::DOUBLE AS x FROM placed JOIN sound USING (user_id)
  WHERE n >= round_even(start_s * {FILE_RATE}, 0) AND n < round_even(start_s * {FILE_RATE}, 0) + {int(FILE_WINDOW * FILE_RATE)})"""


def _event_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of wave files, written by tasks: each user's events as one; some end before their format."""
    root = scratch(spark, "waves")
    rows = data.table(spark, sf_dir, "events").select("user_id", "event_id", data.event_sound().alias("x"))

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by("event_id")
        who = t.column("user_id")[0].as_py()
        body = recordings.wave_bytes(t.column("x").to_numpy(), FILE_RATE, 1 + who % 2)
        store, base = pafs.FileSystem.from_uri(root if ":" in root else os.path.abspath(root))
        store.create_dir(base)
        with store.open_output_stream(f"{base}/{who}.wav") as f:
            f.write(body[:10] if who % 7 == 5 else body)
        return pa.table({"size": [len(body)]})

    rows.groupBy("user_id").applyInArrow(write, "size long").agg(F.sum("size")).collect()  # one row
    return root


@query(f"""WITH {_FILES}
SELECT user_id, CAST(window_ix AS INTEGER) AS window_ix, start_s, count(*) AS n, round(avg(x), 6) + 0.0 AS level, CAST(NULL AS VARCHAR) AS error FROM heard GROUP BY ALL
UNION ALL SELECT user_id, -1, NULL, -1, NULL, CASE WHEN user_id % 7 = 5 THEN 'unreadable' ELSE 'too long' END FROM lengths WHERE user_id % 7 = 5 OR d > 100.5""")
def decoded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as wave files, read by the source of windows."""
    found = recordings.read_windows(spark, _event_files(spark, sf_dir), FILE_INTERVAL, seconds=FILE_WINDOW, rate=FILE_RATE, most_seconds=100, range_bytes=1024)
    level = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x) / F.size("samples")
    error = F.when(F.col("error") == recordings.TOO_LONG, "too long").when(F.col("error").isNotNull(), "unreadable")
    user = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("user_id")
    return found.select(user, "window_ix", "start_s", F.size("samples").cast("long").alias("n"), shown(level).alias("level"), error.alias("error")).fillna(-1, ["window_ix", "n"])


@query("""SELECT doc_id, lower(regexp_extract(name, '\\.([^./]+)$', 1)) IN ('mp3', 'wav', 'flac', 'm4a', 'aac', 'ogg', 'opus') AS audio FROM
  (SELECT doc_id, '/in/Set ' || doc_id || ['.MP3', '.txt', '.opus', '', '.mp3.zip', '.Wav'][doc_id % 6 + 1] AS name FROM documents)""")
def audio_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.array(*[F.lit(x) for x in (".MP3", ".txt", ".opus", "", ".mp3.zip", ".Wav")])[(F.col("doc_id") % 6).cast("int")]
    name = F.concat(F.lit("/in/Set "), F.col("doc_id").cast("string"), ending)
    return data.table(spark, sf_dir, "documents").select("doc_id", display.is_audio(name).alias("audio"))


# --- the whole job -------------------------------------------------------------------


@query(f"""WITH {_FILES},
{_quality('SELECT user_id, window_ix, n, x FROM heard', 'user_id, window_ix', frame=8, stride=1)},
counted AS (SELECT user_id, count(*) AS considered, count(*) FILTER (reason IS NULL) AS retained, count(reason) AS filtered FROM decided GROUP BY user_id),
named AS (SELECT user_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS filter_counts FROM
  (SELECT user_id, reason, count(*) AS n FROM decided WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 7 = 5 THEN 'UnreadableRecording' WHEN d > 100.5 THEN 'RecordingTooLong' WHEN retained = 0 THEN 'NoUsableWindows' END AS error_type,
  CAST(coalesce(considered, 0) AS INTEGER) AS considered, CAST(coalesce(retained, 0) AS INTEGER) AS retained, CAST(coalesce(filtered, 0) AS INTEGER) AS filtered,
  coalesce(filter_counts, '') AS filter_counts, coalesce(retained, 0) AS core_count FROM lengths LEFT JOIN counted USING (user_id) LEFT JOIN named USING (user_id)""")
def file_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to profiles in one call: the events' wave files, and why some have none."""
    reading = {"seconds": FILE_WINDOW, "rate": FILE_RATE, "range_bytes": 1 << 16}
    made = profile_job_operator.run_files(spark, _event_files(spark, sf_dir), FILE_INTERVAL, RULES, most_seconds=100, reading=reading, n_fft=32, bins=8, stride=1)
    found = made.fillna(0, ["considered", "retained", "filtered", "core_count"])
    user = F.regexp_extract("profile_id", r"(\d+)\.wav$", 1).cast("long").alias("user_id")
    return found.select(user, "error_type", "considered", "retained", "filtered", F.coalesce(_pairs("filter_counts"), F.lit("")).alias("filter_counts"), "core_count")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_job_operator.run_jobs(*data.job_tables(spark, sf_dir))


@query(f"""WITH {_JOB},
counted AS (SELECT profile_id, count(*) AS considered, count(*) FILTER (reason IS NULL) AS retained, count(reason) AS filtered FROM decided GROUP BY profile_id),
named AS (SELECT profile_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS filter_counts FROM
  (SELECT profile_id, reason, count(*) AS n FROM decided WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY profile_id)
SELECT profile_id, CASE WHEN duration_s > 14400.5 THEN 'the recording is too long' WHEN retained = 0 THEN 'no window is usable' END AS error,
  CAST(coalesce(considered, 0) AS INTEGER) AS considered, CAST(coalesce(retained, 0) AS INTEGER) AS retained, CAST(coalesce(filtered, 0) AS INTEGER) AS filtered,
  CASE WHEN considered IS NOT NULL THEN coalesce(filter_counts, '') END AS filter_counts, CASE WHEN retained > 0 THEN 512 ELSE 0 END AS dimensions, coalesce(retained, 0) AS core_count
FROM recs LEFT JOIN counted USING (profile_id) LEFT JOIN named USING (profile_id)""")
def profile_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From decoded windows to a profile: what each recording's job counted, or why it has no profile."""
    found = _jobs(spark, sf_dir).fillna(0, ["considered", "retained", "filtered", "dimensions", "core_count"])
    return found.select("profile_id", "error", "considered", "retained", "filtered", _pairs("filter_counts").alias("filter_counts"), "dimensions", "core_count")


@query(f"""WITH {_JOB},{_embedded('profile_id, window_ix')},{_means('unit', 'profile_id', 'whole')}
SELECT CAST(profile_id AS VARCHAR) AS profile_id, i, round(round(g[i + 1], 8), 6) + 0.0 AS value FROM whole, (SELECT unnest([0, 1, 100, 255, 400, 511]) AS i)""")
def profile_job_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some coordinates of the global vectors in the jobs' exports."""
    rows = documents.vector_rows(profile_job_operator.export_rows(_jobs(spark, sf_dir), 0.0)).filter("role = 'global'")
    picked = F.explode(F.array(*[F.lit(i) for i in (0, 1, 100, 255, 400, 511)])).alias("i")
    return rows.select("profile_id", picked, "vector").select("profile_id", "i", shown(F.expr("vector[i]")).alias("value"))


# --- vectors and profiles ------------------------------------------------------


@query(f"WITH {_UNIT} SELECT profile_id, clip_ix, round(sqrt(list_dot_product(u, u)), 6) AS length, round(u[1], 6) + 0.0 AS head, round(u[64], 6) + 0.0 AS tail FROM unit")
def normalized_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = data.unit_clips(spark, sf_dir)
    return unit.select(
        "profile_id", "clip_ix", shown(F.sqrt(dot(F.col("unit"), F.col("unit")))).alias("length"),
        shown(F.col("unit")[0]).alias("head"), shown(F.col("unit")[63]).alias("tail"),
    )


@query(f"WITH {_GLOBAL} SELECT profile_id, d AS i, round(g[d + 1], 6) + 0.0 AS value FROM (SELECT profile_id, g, unnest(range(64)) AS d FROM whole)")
def profile_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.global_vectors(data.unit_clips(spark, sf_dir))
    return found.select("profile_id", F.posexplode("vector").alias("i", "x")).select("profile_id", F.col("i").cast("long").alias("i"), shown(F.col("x")).alias("value"))


@query(f"WITH {_DENSITY} SELECT profile_id, clip_ix, round(density, 6) AS density FROM density")
def local_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.local_density(data.unit_clips(spark, sf_dir)).select("profile_id", "clip_ix", shown(F.col("density")).alias("density"))


@query(f"WITH {_DENSITY} SELECT profile_id, n, round(median, 6) AS median, round(mad, 6) AS mad, round(threshold, 6) AS threshold FROM limits")
def density_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = density.thresholds(density.local_density(data.unit_clips(spark, sf_dir)))
    return found.select("profile_id", "n", *[shown(F.col(c)).alias(c) for c in ("median", "mad", "threshold")])


#: Clips about a direction of their label, but for isolates: ``planted_clips``.
_PLANTED = f"""
src AS (SELECT CAST(label AS INTEGER) AS label, vec_id, list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i - 1 = label AND vec_id % {data.ISOLATED} <> 0 THEN 3::DOUBLE ELSE 0::DOUBLE END) AS embedding FROM embeddings)"""
#: CTEs of a table of clips: the clips that trimming at a tenth leaves, ``core``, and their clusters.
_TRIMMED = """,
ordered AS (SELECT d.profile_id, d.clip_ix, d.density, d.n, CASE WHEN d.n >= 8 THEN threshold END AS threshold,
  row_number() OVER (PARTITION BY d.profile_id ORDER BY d.density, d.clip_ix) AS r FROM density d JOIN limits USING (profile_id)),
judged AS MATERIALIZED (SELECT *, coalesce(density < threshold AND r <= greatest(1, floor(n * 0.1)), false) AS outlier FROM ordered),
core AS MATERIALIZED (SELECT u.* FROM unit u JOIN judged USING (profile_id, clip_ix) WHERE NOT outlier)"""


@query(f"""WITH {_PLANTED},{_of_source(_DENSITY)}{_TRIMMED}
SELECT profile_id, clip_ix, round(threshold, 6) AS threshold, outlier FROM judged""")
def density_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolates among clips about a direction: which are trimmed."""
    found = density.trimmed(profiles.normalised(data.planted_clips(spark, sf_dir)), 0.1)
    return found.select("profile_id", "clip_ix", shown(F.col("threshold")).alias("threshold"), "outlier")


@query(f"""WITH {_DENSITY},
ordered AS (SELECT d.profile_id, d.clip_ix, d.density, d.n, threshold, row_number() OVER (PARTITION BY d.profile_id ORDER BY d.density, d.clip_ix) AS r
  FROM density d JOIN limits USING (profile_id))
SELECT profile_id, count(*) FILTER (NOT (density < threshold AND r <= greatest(1, floor(n * 0.1)))) AS core_count, any_value(n) AS input_count FROM ordered GROUP BY profile_id""")
def core_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = data.unit_clips(spark, sf_dir)
    kept = density.core(unit, density.trimmed(unit, 0.1)).groupBy("profile_id").agg(F.count(F.lit(1)).alias("core_count"))
    return kept.join(unit.groupBy("profile_id").agg(F.count(F.lit(1)).alias("input_count")), "profile_id")


@query(f"WITH {_UNIT}{_KMEANS_TAIL.replace('{unit}', 'unit')}) SELECT profile_id, first_clip, second_clip FROM second_")
def kmeans_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.seed_clips(data.unit_clips(spark, sf_dir))


@query(f"WITH {_CLUSTERED} SELECT profile_id, clip_ix, CAST(cluster AS INTEGER) AS cluster FROM done")
def kmeans_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.assignments(data.unit_clips(spark, sf_dir))


@query(f"WITH {_CLUSTERED} SELECT profile_id, CAST(cluster AS INTEGER) AS cluster, d AS i, round(g[d + 1], 6) + 0.0 AS value FROM (SELECT profile_id, cluster, g, unnest(range(64)) AS d FROM placed)")
def kmeans_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.clusters(data.unit_clips(spark, sf_dir))
    each = found.select("profile_id", "cluster", F.posexplode("vector").alias("i", "x"))
    return each.select("profile_id", "cluster", F.col("i").cast("long").alias("i"), shown(F.col("x")).alias("value"))


@query(f"WITH {_CLUSTERED} SELECT profile_id, CAST(cluster AS INTEGER) AS cluster, round(n / sum(n) OVER (PARTITION BY profile_id), 6) AS weight FROM placed")
def cluster_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.clusters(data.unit_clips(spark, sf_dir)).select("profile_id", "cluster", shown(F.col("weight")).alias("weight"))


@query(f"WITH {_CLUSTERED} SELECT profile_id, CASE WHEN bool_or(forced) THEN 'minimum_support_spherical_kmeans' ELSE 'spherical_kmeans' END AS strategy FROM placed GROUP BY profile_id")
def cluster_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.clusters(data.unit_clips(spark, sf_dir)).filter("cluster = 0").select("profile_id", "strategy")


@query(f"""WITH {_PLANTED},{_of_source(_UNIT)}{_kmeans('unit')}
SELECT profile_id, CAST(cluster AS INTEGER) AS cluster, n AS size, round(n / sum(n) OVER (PARTITION BY profile_id), 6) AS weight,
  CASE WHEN bool_or(forced) OVER (PARTITION BY profile_id) THEN 'minimum_support_spherical_kmeans' ELSE 'spherical_kmeans' END AS strategy FROM placed""")
def min_support_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far isolates make a side of their own that is too small."""
    found = profiles.clusters(profiles.normalised(data.planted_clips(spark, sf_dir)))
    size = F.round(F.col("weight") * F.col("n")).cast("long")
    return found.select("profile_id", "cluster", size.alias("size"), shown(F.col("weight")).alias("weight"), "strategy")


@query("""WITH u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings)
SELECT vec_id AS profile_id, CAST(k AS INTEGER) AS cluster, 1::DOUBLE - k AS weight, 'single_embedding_duplicate' AS strategy, round(u[1], 6) + 0.0 AS head FROM u, range(2) t(k)""")
def single_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a profile of one clip: its clusters are the clip twice."""
    rows = data.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("profile_id"), F.lit(0).alias("clip_ix"), "embedding")
    found = profiles.clusters(profiles.normalised(rows))
    return found.select("profile_id", "cluster", "weight", "strategy", shown(F.col("vector")[0]).alias("head"))


_PCA = f"WITH {_UNIT}, named AS (SELECT profile_id, clip_ix AS c, u FROM unit)," + _axes("named", "profile_id", 3)


@query(f"{_PCA} SELECT profile_id, CAST(axis AS INTEGER) AS axis, round(share, 6) AS share FROM shares")
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnostics.pca(data.unit_clips(spark, sf_dir))
    return found.select("profile_id", F.posexplode("variance").alias("axis", "x")).select("profile_id", "axis", shown(F.col("x")).alias("share"))


@query(f"""{_PCA},
turned AS (SELECT profile_id, i AS d, x * (SELECT sign(arg_max(x, abs(x))) FROM axis0 b WHERE b.profile_id = a.profile_id) AS x FROM axis0 a),
along AS (SELECT profile_id, c, sum(n.x * t.x) AS p FROM cen n JOIN turned t USING (profile_id, d) GROUP BY profile_id, c)
SELECT profile_id, CAST(arg_min(c, p) AS INTEGER) AS low_clip, CAST(arg_max(c, p) AS INTEGER) AS high_clip FROM along GROUP BY profile_id""")
def pca_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.pca(data.unit_clips(spark, sf_dir)).select("profile_id", "low_clip", "high_clip")


@query(f"WITH {_GLOBAL} SELECT profile_id, round(1 - avg(list_dot_product(u, g)), 6) AS diversity FROM unit JOIN whole USING (profile_id) GROUP BY profile_id")
def profile_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = data.unit_clips(spark, sf_dir)
    return diagnostics.diversity(unit, profiles.global_vectors(unit)).select("profile_id", shown(F.col("diversity")).alias("diversity"))


@query(ORACLE_SQL["pca_extremes"].replace("SELECT profile_id, CAST(arg_min(c, p) AS INTEGER) AS low_clip, CAST(arg_max(c, p) AS INTEGER) AS high_clip FROM along GROUP BY profile_id", """,
ends AS (SELECT profile_id, 'low' AS side, arg_min(c, p) AS clip_ix FROM along GROUP BY profile_id UNION ALL SELECT profile_id, 'high', arg_max(c, p) FROM along GROUP BY profile_id)
SELECT profile_id, side, CAST(clip_ix AS INTEGER) AS clip_ix, clip_ix * 25::DOUBLE AS start_s, printf('%02d:%02d:%02d', clip_ix * 25 // 3600, clip_ix * 25 // 60 % 60, clip_ix * 25 % 60) AS timecode FROM ends"""))
def extreme_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = data.unit_clips(spark, sf_dir)
    starts = unit.select("profile_id", "clip_ix", (F.col("clip_ix") * 25).cast("double").alias("start_s"))
    found = diagnostics.extreme_snippets(diagnostics.pca(unit), starts)
    return found.select("profile_id", "side", "clip_ix", "start_s", "timecode")


# --- export ----------------------------------------------------------------------


def _exports(spark: SparkSession, sf_dir: str, clips: DataFrame | None = None) -> DataFrame:
    """Export rows of the labels' profiles, of any size: each clip is a usable window, every 25 s, that was embedded before."""
    clips = data.clips(spark, sf_dir) if clips is None else clips
    found = profiles.aggregate(clips, 0.1)
    counts = clips.groupBy("profile_id").agg(F.count(F.lit(1)).cast("int").alias("considered"), F.max(F.size("embedding")).alias("dimensions"))
    none = F.lit(None)
    rows = found.join(counts, "profile_id").select(
        "*", none.cast("string").alias("error"), (F.col("considered") * 25).cast("double").alias("duration_s"), F.col("considered").alias("retained"), F.lit(0).alias("filtered"),
        F.create_map().cast("map<string,int>").alias("filter_counts"), *[(F.col(f"{s}_clip") * 25).cast("double").alias(f"{s}_start") for s in ("low", "high")],
        *[none.cast("double").alias(c) for c in (*profile_job_operator.TIMES, "load_ms", "elapsed_ms")],
    )
    return profile_job_operator.export_rows(rows, 0.1)


@query(f"""WITH {_DENSITY}{_TRIMMED}{_kmeans('core')}
SELECT CAST(profile_id AS VARCHAR) AS profile_id, role, round(weight, 6) AS weight, round(round(g[1], 8), 6) + 0.0 AS head FROM (
  SELECT profile_id, 'global' AS role, 1::DOUBLE AS weight, g FROM whole UNION ALL
  SELECT profile_id, 'cluster_' || (cluster + 1), n / sum(n) OVER (PARTITION BY profile_id), g FROM placed)""")
def profile_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.vector_rows(_exports(spark, sf_dir))
    return rows.select("profile_id", "role", "weight", shown(F.col("vector")[0]).alias("head"))


_TRIMMED_EXPORT = f"{_PLANTED},{_of_source(_DENSITY)}{_TRIMMED}{_kmeans('core')}"


@query(f"""WITH {_TRIMMED_EXPORT}
SELECT CAST(s.profile_id AS VARCHAR) AS profile_id, CAST(any_value(n) AS INTEGER) AS clips, CAST(count(*) FILTER (NOT outlier) AS INTEGER) AS core, CAST(count(*) FILTER (outlier) AS INTEGER) AS outliers,
  round(any_value(threshold), 6) AS threshold, round(1 - avg(list_dot_product(u, g)), 6) AS diversity, any_value(strategy) AS strategy
FROM judged s JOIN unit USING (profile_id, clip_ix) JOIN whole USING (profile_id)
JOIN (SELECT profile_id, CASE WHEN bool_or(forced) THEN 'minimum_support_spherical_kmeans' ELSE 'spherical_kmeans' END AS strategy FROM placed GROUP BY profile_id) USING (profile_id) GROUP BY s.profile_id""")
def export_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of profiles that lose clips: what is counted, and all clips' diversity about the vector of those kept."""
    rows = _exports(spark, sf_dir, data.planted_clips(spark, sf_dir))
    found = rows.select(
        "profile_id", F.col("aggregation.input_clip_count").alias("clips"), F.col("aggregation.core_clip_count").alias("core"), F.col("aggregation.embedding_outlier_count").alias("outliers"),
        shown(F.col("aggregation.local_density_threshold")).alias("threshold"), F.col("diagnostics.diversity").alias("diversity"), F.col("aggregation.cluster_strategy").alias("strategy"),
    )
    return found


#: Fields of made-up exports by their number i: name, value that is right, and a wrong one in SQL that Spark and DuckDB share.
#: Each order is an export, of number i by its key; export i has the fields wrong whose place is i modulo the number of fields, or whose place divides i beyond them.
_FIELDS = {
    "schema_version": ("'1.0'", "'2.0'"), "dimensions": ("3", "0"), "device": ("'cpu'", "'gpu'"), "backend": ("'clap'", "'other'"),
    "load_ms": ("0", "-1"), "duration": ("100.0", "0.0"), "interval": ("25", "26"), "win": ("10.0", "0.0"), "considered": ("5", "0"),
    "retained": ("4", "0"), "filtered": ("1", "-1"), "counted": ("1", "2"), "method": ("'robust_spherical_kmeans'", "'kmeans'"), "version": ("'3'", "'4'"),
    "strategy": ("'spherical_kmeans'", "'none'"), "outlier_method": ("'disabled'", "'all'"), "fraction": ("0.05", "0.2"), "clips": ("4", "0"),
    "core": ("4", "0"), "outliers": ("0", "-1"), "n_vectors": ("3", "2"), "size": ("3", "0"), "weight": ("0.5", "1.5"), "role": ("'cluster_1'", "'cluster_2'"),
    "n_extremes": ("2", "1"), "side": ("'low'", "'left'"), "clip_ix": ("0", "-1"), "start_s": ("0.0", "-1.0"), "diversity": ("0.1", "-0.1"),
}
_N_EXPORTS = 3 * len(_FIELDS)
_FIELD_SQL = [
    f"CASE WHEN i % {len(_FIELDS)} = {k} OR (i >= {2 * len(_FIELDS)} AND i % {k + 2} = 0) THEN {bad} ELSE {good} END AS {name}"
    for k, (name, (good, bad)) in enumerate(_FIELDS.items())
]
#: What must hold, over the flat fields; vectors are the first n of (global, weight 1), (role, weight), (cluster_2, weight 0.5), each of size zeros.
_RULES_SQL = {
    "schema_version": "schema_version = '1.0'", "positive_dimensions": "dimensions > 0", "device": "device = 'cpu'", "backend": "backend IN ('clap', 'fake')",
    "load_duration": "load_ms >= 0", "positive_duration": "duration > 0", "sample_interval": "interval IN (20, 25, 30)", "positive_window": "win > 0",
    "window_counts": "considered > 0 AND retained > 0 AND filtered >= 0", "method": "method = 'robust_spherical_kmeans' AND version = '3'",
    "cluster_strategy": "strategy IN ('spherical_kmeans', 'minimum_support_spherical_kmeans', 'single_embedding_duplicate')",
    "outlier_method": "outlier_method IN ('disabled', 'knn_density_mad_3.5')", "outlier_fraction": "fraction BETWEEN 0 AND 0.1",
    "clip_counts": "clips > 0 AND core > 0 AND outliers >= 0", "three_vectors": "n_vectors = 3", "vectors_not_empty": "size > 0",
    "weight_range": "weight BETWEEN 0 AND 1", "role_order": "n_vectors = 3 AND role = 'cluster_1'", "vector_length": "size = dimensions",
    "weights_sum": "abs(weight + CASE WHEN n_vectors = 3 THEN 0.5 ELSE 0 END - 1) <= 1e-5", "counts_reconcile": "core + outliers = clips",
    "two_extremes": "n_extremes = 2", "extremes": "side IN ('low', 'high') AND clip_ix >= 0 AND start_s >= 0", "diversity": "diversity >= 0",
}
_WARNINGS_SQL = {"windows_reconcile": "retained + filtered = considered", "filter_counts_reconcile": "counted = filtered"}


@query(
    f"WITH flat AS (SELECT id, {', '.join(_FIELD_SQL)} FROM (SELECT o_orderkey AS id, o_orderkey % {_N_EXPORTS} AS i FROM orders)) "
    + " UNION ALL ".join(
        f"SELECT CAST(id AS VARCHAR) AS profile_id, '{name}' AS rule, '{severity}' AS severity FROM flat WHERE NOT ({ok})"
        for severity, group in (("error", _RULES_SQL), ("warning", _WARNINGS_SQL))
        for name, ok in group.items()
    )
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the contract over exports with one wrong field, and with many."""
    keyed = data.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % _N_EXPORTS).alias("i"))
    flat = keyed.selectExpr("id", *_FIELD_SQL)
    for name in ("duration", "win", "fraction", "weight", "start_s", "diversity"):
        flat = flat.withColumn(name, F.col(name).cast("double"))
    c = F.col

    def vector(role: Column, weight: Column) -> Column:
        return F.struct(role.alias("role"), weight.cast("double").alias("weight"), F.array_repeat(F.lit(0.0), c("size")).alias("vector"))

    vectors = F.slice(F.array(vector(F.lit("global"), F.lit(1.0)), vector(c("role"), c("weight")), vector(F.lit("cluster_2"), F.lit(0.5))), F.lit(1), c("n_vectors"))
    extreme = F.struct(c("side").alias("side"), c("clip_ix").alias("retained_clip_index"), c("start_s").alias("start_seconds"), F.lit("00:00:00").alias("timecode"))
    rows = flat.select(
        c("id").cast("string").alias("profile_id"), "schema_version",
        F.struct("dimensions", "device", "backend", c("load_ms").alias("load_duration_ms")).alias("model"),
        F.struct(
            c("duration").alias("duration_seconds"), c("interval").alias("sample_interval_seconds"), c("win").alias("window_seconds"), c("considered").alias("windows_considered"),
            c("retained").alias("windows_retained"), c("filtered").alias("windows_filtered"), F.create_map(F.lit("clipped"), c("counted")).alias("filter_counts"),
        ).alias("source"),
        F.struct(
            "method", "version", c("strategy").alias("cluster_strategy"), "outlier_method", c("fraction").alias("max_outlier_fraction"), c("clips").alias("input_clip_count"),
            c("core").alias("core_clip_count"), c("outliers").alias("embedding_outlier_count"), vectors.alias("vectors"),
        ).alias("aggregation"),
        F.struct(F.array_repeat(extreme, c("n_extremes")).alias("pca_extreme_snippets"), "diversity").alias("diagnostics"),
    )
    return contract.violations(rows)


@query("SELECT '' AS profile_id, '' AS rule, '' AS severity WHERE false UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'no_profile', 'job' FROM supplier WHERE s_suppkey % 5 IN (3, 4)")
def profile_job_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs' exports hold the whole contract; the recordings without one are listed."""
    jobs_ = _jobs(spark, sf_dir)
    failed = jobs_.filter("error is not null").select(F.col("profile_id").cast("string").alias("profile_id"), F.lit("no_profile").alias("rule"), F.lit("job").alias("severity"))
    return contract.violations(profile_job_operator.export_rows(jobs_, 0.0)).unionByName(failed)


@query("""WITH v AS (SELECT CAST(o_orderkey % 50 AS INTEGER) AS map_id, CAST(o_orderkey AS INTEGER) AS ordinal, repeat('x', CAST(o_orderkey % 203 AS INTEGER)) AS label FROM orders)
SELECT map_id, 'profile_count' AS rule FROM (SELECT map_id FROM v GROUP BY map_id HAVING count(*) > 100) UNION ALL
SELECT map_id, 'label_length' FROM (SELECT map_id FROM v GROUP BY map_id HAVING bool_or(length(label) NOT BETWEEN 1 AND 200))
UNION ALL SELECT 50, 'profile_count'""")
def map_request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as map requests, and request 50 that has no profiles."""
    key = F.col("o_orderkey")
    rows = data.table(spark, sf_dir, "orders").select(
        (key % 50).cast("int").alias("map_id"), key.cast("int").alias("ordinal"), F.repeat(F.lit("x"), (key % 203).cast("int")).alias("label")
    )
    asked = spark.range(51).select(F.col("id").cast("int").alias("map_id"))
    return contract.map_request_problems(rows, asked.filter("map_id = 50").unionByName(rows.select("map_id").distinct()))


@query("""WITH v AS (SELECT l_orderkey AS profile_id, l_linenumber % 3 AS role FROM lineitem)
SELECT 'duplicate_role' AS problem, count(*) AS n FROM (SELECT 1 FROM v GROUP BY profile_id, role HAVING count(*) > 1) UNION ALL
SELECT 'orphan', count(*) FROM v WHERE profile_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) UNION ALL
SELECT 'left_after_delete', count(*) FROM v WHERE profile_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)""")
def catalogue_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's keys over order lines as vectors: roles twice, vectors without a profile, and what a cascade leaves."""
    vectors = data.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("profile_id"), (F.col("l_linenumber") % 3).alias("role"))
    orders = data.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("profile_id"))
    parts = {
        "duplicate_role": contract.duplicate_roles(vectors),
        "orphan": contract.orphan_vectors(vectors, orders.filter("profile_id % 7 <> 0")),
        "left_after_delete": contract.without_deleted(vectors, orders.filter("profile_id % 5 = 0")),
    }
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n") for name, rows in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 65 ELSE 64 END AS dims, o_orderkey % 13 AS duration, o_orderkey % 17 AS considered, o_orderkey % 19 AS retained,
  o_orderkey % 23 - 1 AS filtered FROM orders WHERE o_orderkey % 7 <> 0),
v AS (SELECT l_orderkey AS id, ['global', 'cluster_1', 'cluster_2', 'other'][l_linenumber % 4 + 1] AS role, l_quantity % 13 / 10 AS weight, CASE WHEN l_partkey % 29 = 0 THEN 63 ELSE 64 END AS size FROM lineitem)
SELECT id AS profile_id, problem FROM (SELECT id, unnest([CASE WHEN dims <> 64 THEN 'dimensions' END, CASE WHEN duration <= 0 THEN 'duration_seconds' END, CASE WHEN considered <= 0 THEN 'windows_considered' END,
  CASE WHEN retained <= 0 THEN 'windows_retained' END, CASE WHEN filtered < 0 THEN 'windows_filtered' END]) AS problem FROM p) WHERE problem IS NOT NULL UNION ALL
SELECT id, problem FROM (SELECT id, unnest([CASE WHEN role = 'other' THEN 'role' END, CASE WHEN weight > 1 THEN 'weight' END, CASE WHEN size <> 64 THEN 'vector' END]) AS problem FROM v) WHERE problem IS NOT NULL UNION ALL
SELECT id, 'role_twice' FROM v GROUP BY id, role HAVING count(*) > 1 UNION ALL SELECT id, 'no_profile' FROM v WHERE id NOT IN (SELECT id FROM p)""")
def catalogue_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' constraints over orders as profiles and order lines as vectors."""
    key = F.col("o_orderkey")
    held = data.table(spark, sf_dir, "orders").filter(key % 7 != 0).select(
        key.alias("profile_id"), F.when(key % 11 == 0, 65).otherwise(64).alias("dimensions"), (key % 13).alias("duration_seconds"),
        (key % 17).alias("windows_considered"), (key % 19).alias("windows_retained"), (key % 23 - 1).alias("windows_filtered"),
    )
    roles = F.array(*[F.lit(r) for r in ("global", "cluster_1", "cluster_2", "other")])
    vectors = data.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("profile_id"), roles[(F.col("l_linenumber") % 4).cast("int")].alias("role"), (F.col("l_quantity") % 13 / 10).alias("weight"),
        F.array_repeat(F.lit(0.0), F.when(F.col("l_partkey") % 29 == 0, 63).otherwise(64)).alias("vector"),
    )
    return contract.table_violations(held, vectors, 64)


@query("SELECT CAST(label AS VARCHAR) AS profile_id, 64 AS dimensions, count(*) AS windows FROM embeddings GROUP BY label")
def export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports written as JSON documents and parsed again by the contract's schema."""
    body = "struct<" + ",".join(p.replace(" ", ":", 1) for p in contract.SCHEMA.split(", ")[1:]) + ">"
    back = documents.profile_json(_exports(spark, sf_dir)).select("profile_id", F.from_json("json", body).alias("e"))
    return back.select("profile_id", "e.model.dimensions", F.col("e.source.windows_retained").cast("long").alias("windows"))


@query("""SELECT CAST(label AS VARCHAR) AS id, 'Set ' || label AS label, 64 AS dimensions, count(*) AS windows, 3 AS vectors FROM embeddings GROUP BY embeddings.label""")
def batch_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports as batch documents of four, written as files, and every entry imported again."""
    made = _exports(spark, sf_dir)
    body = F.struct(*[c for c in made.columns if c != "profile_id"])
    rows = made.select(
        F.col("profile_id").cast("int").alias("position"), F.col("profile_id").alias("id"), F.concat(F.lit("Set "), "profile_id").alias("label"), F.lit("2024-01-01").alias("created_at"), body.alias("result")
    )
    path = scratch(spark, "batches")
    documents.batch_documents(rows, 4).select(F.col("json").alias("value")).repartition(3).write.text(path)
    back = documents.imported(spark, path)
    result = F.col("result")
    return back.select("id", "label", result["model"]["dimensions"].alias("dimensions"), result["source"]["windows_retained"].cast("long").alias("windows"), F.size(result["aggregation"]["vectors"]).alias("vectors"))


# --- catalogue ---------------------------------------------------------------------


def _catalogue(spark: SparkSession, sf_dir: str, halves: bool = False) -> DataFrame:
    """Pivoted profiles, ordinals by profile; all are one map request."""
    unit = data.half_clips(spark, sf_dir) if halves else data.unit_clips(spark, sf_dir)
    rows = profiles.representatives(unit).withColumn("map_id", F.lit(0).cast("long")).withColumnRenamed("profile_id", "ordinal")
    return catalogue.pivoted(rows, "map_id", "ordinal")


_PAIRS = """,
prof AS (SELECT g.profile_id, g.g, any_value(p.g) FILTER (cluster = 0) AS c1, any_value(p.g) FILTER (cluster = 1) AS c2,
  max(p.n) FILTER (cluster = 0) / sum(p.n) AS w1, max(p.n) FILTER (cluster = 1) / sum(p.n) AS w2
  FROM whole g JOIN placed p ON p.profile_id = g.profile_id GROUP BY g.profile_id, g.g),
cos4 AS (SELECT a.profile_id AS l, b.profile_id AS r, list_dot_product(a.g, b.g) AS gs, a.w1 AS aw1, a.w2 AS aw2, b.w1 AS bw1, b.w2 AS bw2,
  list_dot_product(a.c1, b.c1) AS s11, list_dot_product(a.c1, b.c2) AS s12, list_dot_product(a.c2, b.c1) AS s21, list_dot_product(a.c2, b.c2) AS s22
  FROM prof a JOIN prof b ON a.profile_id <> b.profile_id),
cov AS (SELECT l, r, gs, 0.5::DOUBLE * (aw1 * greatest(s11, s12) + aw2 * greatest(s21, s22) + bw1 * greatest(s11, s21) + bw2 * greatest(s12, s22)) AS cs FROM cos4),
pairs AS (SELECT l, r, gs, cs, 0.25::DOUBLE * gs + 0.75::DOUBLE * cs AS bs FROM cov),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY bs DESC, r) AS k FROM pairs) WHERE k = 1)"""
_MAP = _CLUSTERED + _PAIRS
_HALVES_MAP = _HALVES_CLUSTERED + _PAIRS


def _scores(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return catalogue.request_similarities(_catalogue(spark, sf_dir)).select("left", "right", shown(F.col(column)).alias("score"))


@query(f'WITH {_MAP} SELECT l AS "left", r AS "right", round(gs, 6) + 0.0 AS score FROM pairs')
def global_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "global_similarity")


@query(f'WITH {_MAP} SELECT l AS "left", r AS "right", round(cs, 6) + 0.0 AS score FROM pairs')
def cluster_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "cluster_similarity")


@query(f'WITH {_MAP} SELECT l AS "left", r AS "right", round(bs, 6) + 0.0 AS score FROM pairs')
def blended_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "similarity")


@query(f"WITH {_MAP} SELECT l AS profile_id, r AS nearest_id, round(bs, 6) + 0.0 AS similarity, round(gs, 6) + 0.0 AS global_similarity, round(cs, 6) + 0.0 AS cluster_similarity FROM near")
def nearest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalogue.request_nearest(_catalogue(spark, sf_dir))
    return found.select(
        F.col("ordinal").alias("profile_id"), F.col("nearest").alias("nearest_id"),
        *[shown(F.col(c)).alias(c) for c in ("similarity", "global_similarity", "cluster_similarity")],
    )


@query(f"WITH {_HALVES_MAP} SELECT CAST(l AS BIGINT) AS profile_id, CAST(r AS BIGINT) AS nearest_id, round(bs, 6) + 0.0 AS similarity FROM near")
def nearest_in_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.nearest_in_catalogue(_catalogue(spark, sf_dir, halves=True))
    return found.select(F.col("ordinal").alias("profile_id"), F.col("nearest").alias("nearest_id"), shown(F.col("similarity")).alias("similarity"))


# --- nearest over many profiles, and the index ---------------------------------------

_PATCHES = """
src AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings),
near0 AS (SELECT a.id AS l, b.id AS r, list_dot_product(a.u, b.u) AS gs,
  0.5::DOUBLE * (0.75::DOUBLE * greatest(list_dot_product(a.u, b.u), list_dot_product(a.u, b.t)) + 0.25::DOUBLE * greatest(list_dot_product(a.t, b.u), list_dot_product(a.t, b.t))
    + 0.75::DOUBLE * greatest(list_dot_product(a.u, b.u), list_dot_product(a.t, b.u)) + 0.25::DOUBLE * greatest(list_dot_product(a.u, b.t), list_dot_product(a.t, b.t))) AS cs
  FROM turned a JOIN turned b ON a.id <> b.id)"""


@query(f"""WITH {_PATCHES.replace('near0 AS', 'turned AS (SELECT id, u, list_concat(u[33:64], u[1:32]) AS t FROM src), near0 AS')}
SELECT l AS vec_id, r AS nearest_id, round(bs, 6) + 0.0 AS similarity FROM (SELECT l, r, 0.25::DOUBLE * gs + 0.75::DOUBLE * cs AS bs FROM near0)
QUALIFY row_number() OVER (PARTITION BY l ORDER BY bs DESC, r) = 1""")
def nearest_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a profile (itself, itself with weight 3/4, its halves exchanged with 1/4): the nearest of all others."""
    unit = vector_index.unit_rows(data.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    turned = F.concat(F.slice("unit", 33, 32), F.slice("unit", 1, 32))
    rows = unit.select(F.col("id").alias("ordinal"), F.col("unit").alias("g"), F.col("unit").alias("c1"), turned.alias("c2"), F.lit(0.75).alias("w1"), F.lit(0.25).alias("w2"))
    found = nearest.nearest_in_catalogue(rows, keep=False)
    return found.select(F.col("ordinal").alias("vec_id"), F.col("nearest").alias("nearest_id"), shown(F.col("similarity")).alias("similarity"))


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """An index of all vectors, and the queries: those whose vec_id is divisible by 100."""
    rows = data.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path = scratch(spark, "index")
    vector_index.build(rows, path)
    return path, rows.filter("id % 100 = 0")


@query("""WITH src AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
scored AS (SELECT q.id AS query_id, c.id AS vec_id, list_cosine_similarity(q.v, c.v) AS s FROM src q JOIN src c ON q.id <> c.id WHERE q.id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, round(s, 6) + 0.0 AS score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, vec_id) QUALIFY rank <= 20""")
def index_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each query, all lists of the index read."""
    path, asked = _indexed(spark, sf_dir)
    return vector_index.search(spark, path, asked, 20).select("query_id", "rank", F.col("id").alias("vec_id"), shown(F.col("score")).alias("score"))


@query()
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found in as many lists as give a recall of 0.95 on measured queries."""
    path, asked = _indexed(spark, sf_dir)
    probes = vector_index.probes_for(spark, path, 0.95, 20)
    return vector_index.search(spark, path, asked, 20, probes).select("query_id", "rank", F.col("id").alias("vec_id"), shown(F.col("score")).alias("score"))


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in data.table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]]


_QUERY_VECTOR = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"
_ROLES = """,
roles AS (SELECT profile_id, 'global' AS role, g FROM whole UNION ALL SELECT profile_id, 'cluster_' || (cluster + 1), g FROM placed),
scored AS (SELECT profile_id, role, list_cosine_similarity(g, q.v) AS s FROM roles, (SELECT {q} AS v) q)""".replace("{q}", _QUERY_VECTOR)


@query(f"WITH {_CLUSTERED}{_ROLES} SELECT profile_id, role, round(s, 6) + 0.0 AS similarity FROM scored ORDER BY s DESC, profile_id, role LIMIT 20")
def match_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k report: the 20 role vectors nearest to the first clip."""
    rows = profiles.representatives(data.unit_clips(spark, sf_dir))
    found = catalogue.match_vectors(rows, _first_vector(spark, sf_dir), 20)
    return found.withColumn("similarity", shown(F.col("similarity")))


@query(f"WITH {_CLUSTERED}{_ROLES} SELECT profile_id, role, round(s, 6) + 0.0 AS similarity FROM scored WHERE role = 'global' ORDER BY s DESC, profile_id LIMIT 5")
def match_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k report: the five global vectors nearest to the first clip."""
    rows = profiles.representatives(data.unit_clips(spark, sf_dir))
    found = catalogue.match_vectors(rows, _first_vector(spark, sf_dir), 5, role="global")
    return found.withColumn("similarity", shown(F.col("similarity")))


@query(f"""WITH {_MAP}, short AS (SELECT * FROM pairs WHERE l = 0 ORDER BY gs DESC, r LIMIT 5)
SELECT r AS profile_id, round(bs, 6) + 0.0 AS similarity, round(gs, 6) + 0.0 AS global_similarity, round(cs, 6) + 0.0 AS cluster_similarity,
  CAST(row_number() OVER (ORDER BY bs DESC, r) AS INTEGER) AS rank FROM short""")
def rerank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k report: profile 0's five nearest by global vector, ranked by the blend."""
    rows = _catalogue(spark, sf_dir).drop("map_id").withColumnRenamed("ordinal", "profile_id")
    found = catalogue.reranked(rows, rows.filter("profile_id = 0"), 5)
    return found.select("profile_id", *[shown(F.col(c)).alias(c) for c in ("similarity", "global_similarity", "cluster_similarity")], "rank")


_ATLAS = (
    f"WITH {_CLUSTERED}{_PAIRS}, named AS (SELECT 0 AS one, profile_id AS c, g AS u FROM whole),"
    + _axes("named", "one", 2)
    + """,
spots AS (SELECT k, c, sum(n.x * a.x) AS p FROM cen n JOIN (SELECT 0 AS k, i AS d, x FROM axis0 UNION ALL SELECT 1, i, x FROM axis1) a USING (d) GROUP BY k, c),
far AS (SELECT k, arg_max(p, abs(p)) AS p FROM spots GROUP BY k),
xy AS (SELECT c AS profile_id, max(CASE WHEN k = 0 THEN tanh(s.p / f.p) END) AS x, max(CASE WHEN k = 1 THEN tanh(s.p / f.p) END) AS y FROM spots s JOIN far f USING (k) GROUP BY c)"""
)


@query(f"{_ATLAS} SELECT profile_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM xy")
def map_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = profiles.global_vectors(data.unit_clips(spark, sf_dir)).select("profile_id", "vector")
    found = atlas.transform(vectors, atlas.fit(vectors))
    return found.select("profile_id", shown(F.col("x")).alias("x"), shown(F.col("y")).alias("y"))


@query(f"""{_ATLAS},
numbers AS (SELECT 0 AS part, d AS place, avg(x) AS v FROM (SELECT unnest(u) AS x, unnest(range(len(u))) AS d FROM named) GROUP BY d
  UNION ALL SELECT 1, i, x * sign(p) FROM axis0, far WHERE k = 0 UNION ALL SELECT 2, i, x * sign(p) FROM axis1, far WHERE k = 1 UNION ALL SELECT 3, k, greatest(abs(p), 1e-6) FROM far),
texts AS (SELECT part, string_agg(replace(printf('%.6f', v), '-0.000000', '0.000000'), ',' ORDER BY place) AS t FROM numbers GROUP BY part),
name AS (SELECT 'pca-' || left(sha256(string_agg(t, ';' ORDER BY part) || ';' || (SELECT count(*) FROM named)), 12) AS version FROM texts)
SELECT 'frozen_reference_pca_v1' AS method, version AS projection_version, true AS projection_is_stable, (SELECT count(*) FROM named) AS reference_profile_count,
  'quarter_global_three_quarter_weighted_cluster_v1' AS similarity_method, (SELECT count(*) FROM named) AS relative_to_profile_count,
  (SELECT round(share, 6) FROM shares WHERE axis = 0) AS axis_1_share, (SELECT round(share, 6) FROM shares WHERE axis = 1) AS axis_2_share FROM name""")
def map_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = profiles.global_vectors(data.unit_clips(spark, sf_dir)).select("profile_id", "vector")
    projection, frozen = atlas.projection_for(vectors, vectors)
    found = atlas.header(projection, frozen, vectors.count())
    shares = [F.col("axis_explained_variance_ratio")[k].alias(f"axis_{k + 1}_share") for k in (0, 1)]
    return found.select("*", *shares).drop("axis_explained_variance_ratio")


_HALVES_LEFT = (
    ORACLE_SQL["map_header"].replace("CAST(label AS INTEGER)", "CAST(label * 2 + vec_id % 2 AS INTEGER)").replace("BY label ORDER", "BY label, vec_id % 2 ORDER")
    .replace("g AS u FROM whole)", "g AS u FROM whole WHERE profile_id % 4 <> 3)")
)


@query(_HALVES_LEFT)
def map_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of the halves after one in four was taken off, from moments kept as they came and went."""
    vectors = profiles.global_vectors(data.half_clips(spark, sf_dir)).select("profile_id", "vector")
    goes = F.col("profile_id") % 4 == 3
    kept = scratch(spark, "moments")
    for rows, removed in ((vectors.filter("profile_id % 2 = 0"), False), (vectors.filter("profile_id % 2 = 1"), False), (vectors.filter(goes), True)):
        atlas.moment_row(rows, removed=removed).write.mode("append").parquet(kept)
    left = vectors.filter(~goes)
    found = atlas.header(atlas.refit(spark.read.schema(atlas.MOMENTS).parquet(kept), left), True, left.count())
    shares = [F.col("axis_explained_variance_ratio")[k].alias(f"axis_{k + 1}_share") for k in (0, 1)]
    return found.select("*", *shares).drop("axis_explained_variance_ratio")


@query(f"""{_ATLAS} SELECT CAST(0 AS BIGINT) AS map_id, x.profile_id AS ordinal, CAST(x.profile_id AS VARCHAR) AS id, 'Set ' || x.profile_id AS label, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y,
  CAST(r AS VARCHAR) AS nearest_id, 'Set ' || r AS nearest_label, round(bs, 6) AS similarity FROM xy x LEFT JOIN near n ON n.l = x.profile_id""")
def map_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's JSON, read back."""
    rows = _catalogue(spark, sf_dir)
    points = atlas.transform(rows.select("map_id", "ordinal", "g"), atlas.fit(rows, "g"), "g")
    points = points.select("map_id", "ordinal", F.col("ordinal").cast("string").alias("id"), F.concat(F.lit("Set "), "ordinal").alias("label"), "x", "y")
    shape = "id string, label string, points struct<global:struct<x:double,y:double>>, nearest struct<id:string,label:string,similarity:double>"
    read = atlas.payload(points, catalogue.request_nearest(rows)).select("map_id", "ordinal", F.from_json("json", shape).alias("j"))
    return read.select(
        "map_id", "ordinal", "j.id", "j.label", shown(F.col("j.points.global.x")).alias("x"), shown(F.col("j.points.global.y")).alias("y"),
        F.col("j.nearest.id").alias("nearest_id"), F.col("j.nearest.label").alias("nearest_label"), "j.nearest.similarity",
    )


@query(f"""WITH {_GLOBAL},
two AS (SELECT profile_id, g, row_number() OVER (ORDER BY profile_id) - 1 AS n FROM whole QUALIFY n < 2),
sides AS (SELECT profile_id, CASE WHEN g[1] < 0 THEN -1::DOUBLE ELSE 1::DOUBLE END AS v FROM whole),
line AS (SELECT profile_id, v, avg(v) OVER () AS c FROM sides)
SELECT 'one' AS name, 'collection_pca_v2' AS method, profile_id AS n, 0::DOUBLE AS x, 0::DOUBLE AS y FROM two WHERE n = 0
UNION ALL SELECT 'equal', 'collection_pca_v2', k, 0::DOUBLE, 0::DOUBLE FROM range(2) t(k)
UNION ALL SELECT 'two', 'collection_pca_v2', a.profile_id, round(CASE WHEN a.g < b.g THEN 1 ELSE -1 END * tanh(1::DOUBLE), 6), 0::DOUBLE FROM two a JOIN two b ON a.n <> b.n
UNION ALL SELECT 'line', 'frozen_reference_pca_v1', profile_id,
  round(CASE WHEN abs(c) = 1 THEN 0::DOUBLE WHEN c >= 0 THEN tanh((c - v) / (1 + c)) ELSE tanh((v - c) / (1 - c)) END, 6) + 0.0, 0::DOUBLE FROM line""")
def map_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of one profile, of equal ones and of two, which have no axes or one; and of vectors of one dimension."""
    whole = profiles.global_vectors(data.unit_clips(spark, sf_dir)).select(F.col("profile_id").alias("n"), "vector")
    first = whole.orderBy("n").limit(1)
    twice = first.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), "vector")
    line = whole.select("n", F.array(F.when(F.col("vector")[0] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))).alias("vector"))
    maps = []
    for name, rows in {"one": first, "equal": twice, "two": whole.orderBy("n").limit(2), "line": line}.items():
        projection, frozen = atlas.projection_for(rows, rows)
        at = atlas.transform(rows, projection).select(F.lit(name).alias("name"), "n", shown(F.col("x")).alias("x"), shown(F.col("y")).alias("y"))
        maps.append(at.join(atlas.header(projection, frozen, rows.count()).select("method")))
    return maps[0].unionByName(maps[1]).unionByName(maps[2]).unionByName(maps[3]).select("name", "method", "n", "x", "y")


# --- evaluation --------------------------------------------------------------------


def _groups(rows: DataFrame) -> DataFrame:
    return rows.select("ordinal", F.floor(F.col("ordinal") / 2).alias("group"))


@query(f"WITH {_HALVES_MAP} SELECT count(*) AS n, count(*) FILTER (l // 2 = r // 2) AS hits, round(avg(CAST(l // 2 = r // 2 AS INT)), 6) AS accuracy FROM near")
def nn_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalogue(spark, sf_dir, halves=True)
    found = evaluation.nearest_accuracy(catalogue.request_nearest(rows).select("ordinal", "nearest"), _groups(rows))
    return found.withColumn("accuracy", shown(F.col("accuracy")))


@query(f"""WITH {_HALVES_MAP} SELECT round(avg(bs) FILTER (l // 2 = r // 2), 6) + 0.0 AS within, round(avg(bs) FILTER (l // 2 <> r // 2), 6) + 0.0 AS across,
  round(avg(bs) FILTER (l // 2 = r // 2) - avg(bs) FILTER (l // 2 <> r // 2), 6) + 0.0 AS margin FROM pairs""")
def similarity_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalogue(spark, sf_dir, halves=True)
    found = evaluation.margin(catalogue.request_similarities(rows), _groups(rows))
    return found.select(*[shown(F.col(c)).alias(c) for c in ("within", "across", "margin")])


@query(f"""WITH {_HALVES_MAP}, rk AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY bs DESC, r) AS k FROM pairs),
own AS (SELECT l, count(*) AS relevant, count(*) FILTER (k <= 5) AS found, min(k) AS first FROM rk WHERE l // 2 = r // 2 GROUP BY l)
SELECT count(*) AS n, round(avg(found / least(relevant, 5)), 6) AS recall_at_k, round(avg(1.0::DOUBLE / first), 6) AS mrr FROM own""")
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalogue(spark, sf_dir, halves=True)
    found = evaluation.ranking(catalogue.request_similarities(rows), _groups(rows))
    return found.select("n", shown(F.col("recall_at_k")).alias("recall_at_k"), shown(F.col("mrr")).alias("mrr"))


# --- telemetry, jobs, library --------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("created_at"), F.col("user_id").alias("job_id"), F.col("event_type").alias("event_name"),
        F.col("value").alias("duration_ms"), F.col("props").alias("properties"),
    )


@query("""SELECT event_type AS event_name, count(*) AS n, round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms, round(max(value), 6) AS longest_ms
  FROM events GROUP BY event_type""")
def event_duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = "duration_ms"
    return _events(spark, sf_dir).groupBy("event_name").agg(
        F.count(F.lit(1)).alias("n"), shown(F.avg(ms)).alias("mean_ms"), shown(F.median(ms)).alias("median_ms"), shown(F.max(ms)).alias("longest_ms")
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{\"event\":\"' || event_type || '\",\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS properties FROM events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("properties", "k int")["k"]
    return _events(spark, sf_dir).select("event_id", k.alias("k"), jobs.properties_json(k=k, event=F.col("event_name")).alias("properties"))


@query("""SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS event_name, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events
  FROM events GROUP BY user_id""")
def latest_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(_events(spark, sf_dir)).select("job_id", "event_name", "event_id", "n_events")


@query("""SELECT user_id AS job_id, stage, round(CASE stage WHEN 'probe' THEN 0.02 WHEN 'sample' THEN 0.06 + 0.84 * least(n, 100) / 100.0::DOUBLE WHEN 'aggregate' THEN 0.94 ELSE 1.0 END, 6) AS progress,
  CASE WHEN stage = 'complete' THEN 'r' || user_id END AS result FROM
  (SELECT user_id, count(*) AS n, ['probe', 'sample', 'aggregate', 'complete'][user_id % 4 + 1] AS stage FROM events GROUP BY user_id)""")
def public_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs at a stage: how far they are, and what is shown of them."""
    stages = F.array(*[F.lit(s) for s in ("probe", "sample", "aggregate", "complete")])
    rows = _events(spark, sf_dir).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("created_at"))
    rows = rows.withColumn("stage", stages[(F.col("job_id") % 4).cast("int")]).withColumn("status", F.when(F.col("stage") == "complete", "complete").otherwise("processing"))
    shown_jobs = jobs.public(rows.withColumn("result", F.concat(F.lit("r"), F.col("job_id").cast("string"))))
    done = shown(jobs.progress(F.col("stage"), F.least("n", F.lit(100)), F.lit(100)))
    return shown_jobs.select("job_id", "stage", done.alias("progress"), "result")


@query(f"""WITH {_JOB},
counted AS (SELECT profile_id, count(*) AS considered, count(*) FILTER (reason IS NULL) AS retained FROM decided GROUP BY profile_id)
SELECT CAST(profile_id AS VARCHAR) AS job_id, CASE WHEN retained > 0 THEN 'job_completed' ELSE 'job_failed' END AS event_name,
  CASE WHEN retained > 0 THEN CAST(considered AS INTEGER) ELSE 0 END AS windows_considered, CASE WHEN retained > 0 THEN CAST(considered - retained AS INTEGER) ELSE 0 END AS windows_filtered,
  CASE WHEN retained > 0 THEN 25 ELSE 0 END AS interval_seconds, CASE WHEN retained > 0 THEN 13 ELSE 1 END AS n_properties,
  CASE WHEN retained > 0 THEN NULL WHEN duration_s > 14400.5 THEN 'RecordingTooLong' ELSE 'NoUsableWindows' END AS error_type
FROM recs LEFT JOIN counted USING (profile_id)""")
def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs' telemetry, written as JSON properties and parsed again by kind."""
    made = jobs.outcome_events(_jobs(spark, sf_dir), 25, 0.0, 64)
    n = F.size(F.json_object_keys("raw")).alias("n_properties")
    done = jobs.parsed(made, "job_completed").select(
        "job_id", "event_name", *[f"properties.{c}" for c in ("windows_considered", "windows_filtered", "interval_seconds")], n, F.lit(None).cast("string").alias("error_type")
    )
    failed = jobs.parsed(made, "job_failed").select("job_id", "event_name", *[F.lit(0).alias(c) for c in done.columns[2:5]], n, "properties.error_type")
    return done.unionByName(failed)


def _library_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as library entries whose names and lengths repeat."""
    c = F.col
    return data.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("Set "), (c("doc_id") % 97).cast("string"), F.when(c("doc_id") % 2 == 0, ".MP3").otherwise(".wav")).alias("label"),
        (c("n_chars") % 7).cast("double").alias("duration_s"), F.lit("r1").alias("revision"), F.lit(25).alias("interval_s"), F.lit(0.0).alias("fraction"),
        c("doc_id").alias("position"), c("n_chars").alias("considered"), F.floor(c("n_chars") / 2).alias("retained"),
        F.floor(c("n_chars") / 3).alias("core"), c("n_chars").alias("total_ms"),
    )


_LIBRARY = """
entries AS (SELECT doc_id AS position, doc_id % 3 = 0 AS old, lower('Set ' || doc_id % 97) || '::' || printf('%.2f', (n_chars % 7)::DOUBLE) || '::r1::25::0' AS signature FROM documents),
merged AS (SELECT position, signature, 0 AS source FROM entries WHERE old UNION ALL
  SELECT min(position), signature, 1 FROM entries WHERE NOT old AND signature NOT IN (SELECT signature FROM entries WHERE old) GROUP BY signature)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _library_entries(spark, sf_dir)
    return library.merged(rows.filter("position % 3 = 0"), rows.filter("position % 3 <> 0"))


@query(f"WITH {_LIBRARY} SELECT position, signature, source FROM merged")
def library_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("position", "signature", "source")


@query(f"WITH {_LIBRARY} SELECT position, signature FROM merged ORDER BY source DESC, position DESC LIMIT 80")
def library_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library keeps its last 80 entries: the limit is the feature."""
    return library.newest(_merged(spark, sf_dir)).select("position", "signature")


@query("""SELECT count(*) AS profiles, CAST(sum(n_chars // 2) AS BIGINT) AS retained, CAST(sum(n_chars) AS BIGINT) AS considered, CAST(sum(n_chars // 3) AS BIGINT) AS core,
  sum((n_chars % 7)::DOUBLE) AS duration_s, sum(n_chars) / 1000 AS processing_s FROM documents""")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.totals(_library_entries(spark, sf_dir))


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10) WHEN b < 1073741824 THEN printf('%.1f MB', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(b / 1073741824.0::DOUBLE * 10 + 0.5) / 10) END AS size,
  CASE WHEN m < 60 THEN m || ' min' ELSE (m // 60) || 'h' || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || 'm' ELSE '' END END AS duration,
  regexp_replace(regexp_replace(lower(source || ' ' || lang || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  CASE WHEN length(label) > 32 THEN left(label, 31) || '…' ELSE label END AS short FROM (
  SELECT doc_id, source, lang, n_chars * 1000 AS b, CAST(floor(n_chars / 60.0::DOUBLE + 0.5) AS BIGINT) AS m, 'A recording of document number ' || doc_id AS label FROM documents)""")
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("A recording of document number "), F.col("doc_id").cast("string"))
    return data.table(spark, sf_dir, "documents").select(
        "doc_id",
        display.byte_size(F.col("n_chars") * 1000).alias("size"),
        display.duration(F.col("n_chars").cast("double")).alias("duration"),
        display.slug(F.concat(F.col("source"), F.lit(" "), F.col("lang"), F.lit("!"))).alias("slug"),
        display.short_label(label).alias("short"),
    )


# --- streaming ----------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table read as a stream of its files: one file, or a folder of one or more."""
    # a stream's path is a folder or a pattern; this pattern is the table's own path
    return spark.readStream.schema(data.table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query(ORACLE_SQL["profile_global"])
def stream_profile_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "embeddings").select(F.col("label").alias("profile_id"), "embedding")
    found = streams.vectors_of(stream_tables.drained(streams.running_sums(rows), scratch(spark, "sums"), ["profile_id", "i"]))
    return found.select("profile_id", F.posexplode("vector").alias("i", "x")).select("profile_id", F.col("i").cast("long").alias("i"), shown(F.col("x")).alias("value"))


@query(ORACLE_SQL["cluster_weights"])
def stream_refreshed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters kept up to date by batches of a stream, each batch's profiles from all their clips."""
    rows = _stream(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("profile_id"), F.col("vec_id").cast("int").alias("clip_ix"), "embedding")
    root = scratch(spark, "refreshed")
    step = streams.refresh_profiles(f"{root}/profiles", f"{root}/clips", lambda c: profiles.clusters(profiles.normalised(c)).select("profile_id", "cluster", "weight"))
    started = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/progress")
    started.trigger(availableNow=True).start().awaitTermination()
    kept = "profile_id int, cluster int, weight double, batch int"
    return streams.current_profiles(spark.read.schema(kept).parquet(f"{root}/profiles")).select("profile_id", "cluster", shown(F.col("weight")).alias("weight"))


@query(ORACLE_SQL["latest_job_state"])
def stream_latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), F.col("user_id").alias("job_id"), F.col("event_type").alias("event_name"))
    return stream_tables.drained(streams.latest_jobs(rows), scratch(spark, "jobs"), ["job_id"]).select("job_id", "event_name", "event_id", "n_events")


_MACHINE = """
events_ AS MATERIALIZED (SELECT user_id * 10 + (day(ts) - 1) // 10 AS job_id, event_id, ts, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS progress,
  CASE event_type WHEN 'signup' THEN 'job_submitted' WHEN 'purchase' THEN 'job_completed' WHEN 'error' THEN 'job_failed' ELSE 'job_processing' END AS name FROM events),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM events_),
run AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS i, '' AS status, 0::DOUBLE AS progress, CAST(NULL AS TIMESTAMP) AS updated, false AS accepted, false AS expired FROM events_
  UNION ALL
  SELECT job_id, i, CASE WHEN good THEN target ELSE status END, CASE WHEN good AND target = 'complete' THEN 1 WHEN good AND target = 'processing' THEN greatest(progress, told) ELSE progress END,
    CASE WHEN good THEN ts ELSE updated END, good, expired FROM (
    SELECT *, coalesce((status = '' AND target = 'queued') OR (status IN ('queued', 'processing') AND target IN ('processing', 'failed')) OR (status = 'processing' AND target = 'complete'), false) AS good FROM (
      SELECT r.job_id, p.i, p.ts, p.progress AS told, r.progress, r.status IN ('queued', 'processing') AND p.ts > r.updated + INTERVAL 12 HOUR AS expired,
        CASE WHEN r.status IN ('queued', 'processing') AND p.ts > r.updated + INTERVAL 12 HOUR THEN 'failed' ELSE r.status END AS status,
        CASE WHEN r.status IN ('queued', 'processing') AND p.ts > r.updated + INTERVAL 12 HOUR THEN r.updated + INTERVAL 12 HOUR ELSE r.updated END AS updated,
        CASE p.name WHEN 'job_submitted' THEN 'queued' WHEN 'job_completed' THEN 'complete' WHEN 'job_failed' THEN 'failed' ELSE 'processing' END AS target
      FROM run r JOIN placed p ON p.job_id = r.job_id AND p.i = r.i + 1))),
known AS MATERIALIZED (SELECT * FROM run),
ends_ AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1)"""


@query(f"""WITH {_MACHINE}
SELECT k.job_id, event_id, name AS event_name, coalesce(nullif(status, ''), 'none') AS status, round(k.progress, 6) AS progress, accepted FROM known k JOIN placed p USING (job_id, i)
UNION ALL SELECT k.job_id, -1, 'job_expired', 'failed', round(b.progress, 6), true FROM known k JOIN known b ON b.job_id = k.job_id AND b.i = k.i - 1 WHERE k.expired
UNION ALL SELECT job_id, -1, 'job_expired', 'failed', round(progress, 6), true FROM ends_ WHERE status IN ('queued', 'processing') AND updated + INTERVAL 13 HOUR < (SELECT max(ts) FROM events_)""")
def job_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of jobs, a job each user and ten days: what became of each, refused ones and expiries too."""
    kind = F.when(F.col("event_type") == "signup", "job_submitted").when(F.col("event_type") == "purchase", "job_completed").when(F.col("event_type") == "error", "job_failed")
    rows = _stream(spark, sf_dir, "events").select(
        (F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 10)).alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("created_at"),
        kind.otherwise("job_processing").alias("event_name"), (F.from_json("props", "k double")["k"] / 100).alias("progress"),
    )
    found = machines.drained(spark, machines.job_outcomes(rows))
    return found.select("job_id", "event_id", "event_name", F.coalesce("status", F.lit("none")).alias("status"), F.round("progress", 6).alias("progress"), "accepted")


@query("""SELECT event_id, user_id AS job_id, event_type AS event_name FROM events""")
def recorded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come up to three times in a stream, each recorded once."""
    rows = _stream(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("job_id"), F.col("event_type").alias("event_name"))
    again = F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3))
    found = stream_tables.recorded(rows.withColumn("again", again).drop("again"), scratch(spark, "telemetry"))
    return found.select("event_id", "job_id", "event_name")


# --- keyed tables and SQL --------------------------------------------------------------


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 5 <> 0),
v AS (SELECT l_orderkey, max(CASE WHEN l_orderkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END) AS weight FROM lineitem
  WHERE l_orderkey % 7 <> 0 OR l_linenumber > 1 GROUP BY l_orderkey, l_linenumber % 3)
SELECT 'profiles' AS name, count(*) AS n, round(sum(price), 2) AS total FROM p
UNION ALL SELECT 'vectors', count(*), round(sum(weight), 2) FROM v WHERE l_orderkey IN (SELECT o_orderkey FROM p)
UNION ALL SELECT 'profiles before', count(*), round(sum(o_totalprice), 2) FROM orders""")
def catalogue_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as profiles and their lines as vectors: all put, a seventh replaced with fewer vectors, a fifth deleted with theirs; then counted."""
    price, weight = F.col("o_totalprice").cast("double"), F.col("l_quantity").cast("double")
    orders = data.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("profile_id"), price.alias("price"))
    lines = data.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("profile_id"), (F.col("l_linenumber") % 3).cast("int").alias("role"), weight.alias("weight"), "l_linenumber")
    lines = lines.join(orders.select("profile_id"), "profile_id", "left_semi")
    table = keyed.KeyedCatalogue(spark, scratch(spark, "catalogue"), "profile_id long, price double", "profile_id long, role int, weight double", 16)
    first = table.commit(orders, lines)
    seventh = F.col("profile_id") % 7 == 0
    table.commit(orders.filter(seventh).withColumn("price", F.col("price") * 2), lines.filter(seventh & (F.col("l_linenumber") > 1)).withColumn("weight", F.col("weight") + 1))
    table.commit(deleted=orders.filter("profile_id % 5 = 0"))

    def counted(name: str, rows: DataFrame, value: str) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.lit(name).alias("name"), "n", "total")

    now = counted("profiles", table.read("profiles"), "price").unionByName(counted("vectors", table.read("vectors"), "weight"))
    return now.unionByName(counted("profiles before", table.read("profiles", first), "price"))


@query(ORACLE_SQL["match_global"])
def match_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k report: the five global vectors nearest to the first clip, asked in SQL."""
    rows = profiles.representatives(data.unit_clips(spark, sf_dir)).withColumn("model_revision", F.lit("r1"))
    rows.createOrReplaceTempView("catalogue_vectors")
    catalogue.register_match(spark)
    asked = ", ".join(f"{x!r}D" for x in _first_vector(spark, sf_dir))
    return spark.sql(f"SELECT profile_id, role, round(similarity, 6) + 0D AS similarity FROM match_vectors(array({asked}), 5, 'global', 'r1')")


@query("""SELECT event_id, coalesce(CAST(json_extract(p, '$.k') AS INTEGER), -1) AS k, CASE WHEN NOT json_valid(p) THEN 'not JSON' WHEN json_type(CASE WHEN json_valid(p) THEN p END) <> 'OBJECT' THEN 'not an object' END AS problem FROM (
  SELECT event_id, CASE event_id % 50 WHEN 7 THEN left(props, 5) WHEN 9 THEN '[' || event_id || ']' ELSE props END AS p FROM events) WHERE json_valid(p)
UNION ALL SELECT event_id, -1, 'not JSON' FROM events WHERE event_id % 50 = 7""")
def event_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties read without a schema; of some events they are cut off or a list, and those rows stay."""
    body = F.when(F.col("event_id") % 50 == 7, F.substring("properties", 1, 5)).when(F.col("event_id") % 50 == 9, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")))
    rows = jobs.loosely_parsed(_events(spark, sf_dir).withColumn("properties", F.coalesce(body, "properties")))
    return rows.select("event_id", F.coalesce(jobs.property_of("$.k", "int"), F.lit(-1)).alias("k"), "problem")
