"""Display formats of durations, sizes, labels and points as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file name endings that name audio.
AUDIO_SUFFIXES = ("mp3", "wav", "flac", "m4a", "aac", "ogg", "opus")


def timecode(seconds: Column) -> Column:
    """HH:MM:SS of seconds rounded to a whole one, halves to even; hours may pass 99."""
    whole = F.bround(seconds, 0).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def is_audio(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*AUDIO_SUFFIXES)


def profile_name(label: Column) -> Column:
    """A label without its audio ending; an empty or null one has a stand-in."""
    named = F.when(F.coalesce(label, F.lit("")) == "", F.lit("Untitled set")).otherwise(label)
    return F.regexp_replace(named, rf"(?i)\.({'|'.join(AUDIO_SUFFIXES)})$", "")


def byte_size(n: Column) -> Column:
    """Bytes in steps of 1024 up to GB; one decimal from KB on."""
    out = F.format_string("%.1f GB", n / float(1 << 30))
    for unit, power in (("MB", 20), ("KB", 10)):
        out = F.when(n < 1 << (power + 10), F.format_string(f"%.1f {unit}", n / float(1 << power))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def duration(seconds: Column) -> Column:
    """Whole minutes below an hour, hours and minutes from there on."""
    minutes = F.floor(F.coalesce(seconds, F.lit(0.0)) / 60 + 0.5)
    rest = minutes % 60
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), F.when(rest > 0, F.format_string(" %dm", rest)).otherwise(""))
    return F.when(minutes < 60, F.format_string("%d min", minutes)).otherwise(hours)


def slug(label: Column) -> Column:
    """Lower case, other runs than letters and digits one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_label(label: Column, most: int = 32) -> Column:
    return F.when(F.length(label) > most, F.concat(F.substring(label, 1, most - 1), F.lit("…"))).otherwise(label)


def screen_x(x: Column) -> Column:
    return F.lit(500.0) + F.lit(385.0) * x


def screen_y(y: Column) -> Column:
    return F.lit(280.0) - F.lit(215.0) * y
