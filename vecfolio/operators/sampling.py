"""Which time windows stand for a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERVALS = (20, 25, 30)
TRIM_FRACTIONS = (0.0, 0.05, 0.1)
WINDOW_SECONDS = 10.0
#: A recording may be longer than the limit by this.
DURATION_SLACK = 0.5


def offsets(duration: Column, interval: Column, window: float = WINDOW_SECONDS) -> Column:
    """Starts of windows every ``interval`` seconds, and of a last one if a whole window is left after them.

    A recording no longer than a window has the one start 0, whatever the
    interval; otherwise the interval must be positive.
    """
    last = duration - window
    steps = F.when(interval > 0, F.floor((last + 1e-6) / interval)).otherwise(
        F.raise_error(F.lit("the sample interval must be positive")).cast("long")
    )
    grid = F.transform(F.sequence(F.lit(0).cast("long"), steps), lambda i: F.bround(i * interval, 3))
    tail = F.when(last - steps * interval >= window, F.array(F.bround(last, 3))).otherwise(F.array().cast("array<double>"))
    return F.when(duration <= window, F.array(F.lit(0.0))).otherwise(F.concat(grid, tail))


def starts_of(duration: float, interval: float, window: float = WINDOW_SECONDS) -> list[float]:
    """``offsets`` of one recording, where a task knows its length only once it has opened the file."""
    if duration <= window:
        return [0.0]
    if interval <= 0:
        raise ValueError("the sample interval must be positive")
    last = duration - window
    steps = int((last + 1e-6) // interval)
    tail = [round(last, 3)] if last - steps * interval >= window else []
    return [round(i * interval, 3) for i in range(steps + 1)] + tail


def windows(recordings: DataFrame, interval: float, window: float = WINDOW_SECONDS) -> DataFrame:
    """(…, window_ix, start_s) for rows with ``duration_s``: one for each window."""
    starts = offsets(F.col("duration_s").cast("double"), F.lit(float(interval)), window)
    return recordings.select("*", F.posexplode(starts).alias("window_ix", "start_s"))


def chosen_interval(asked: Column, default: int = 25) -> Column:
    """The interval asked for, the default for none or 0; null if it isn't allowed."""
    value = F.coalesce(F.nullif(asked, F.lit(0)), F.lit(default))
    return F.when(value.isin(*INTERVALS), value)


def chosen_fraction(asked: Column, default: float = 0.0) -> Column:
    """The trim fraction asked for, or the default for none; null if it isn't allowed."""
    value = F.coalesce(asked, F.lit(default))
    return F.when(value.isin(*TRIM_FRACTIONS), value)


def within_limit(duration: Column, most: float) -> Column:
    return duration <= most + DURATION_SLACK
