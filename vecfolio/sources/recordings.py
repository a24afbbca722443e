"""Recordings: files in, windows of samples out, at one rate and in one channel.

``WindowSource`` is a data source of Spark's, ``recordings``: a row for each
window of each audio file below a path. The driver lists files and nothing more;
a task has a file and a range of its bytes, reads the header, and then only the
windows that begin in its range, so wave files have no limit of size and are
read by as many tasks as they have ranges. Filters on ``path`` drop files before
any task is planned (``spark.sql.python.filterPushdown.enabled``); small files are
put together. Files are
opened by pyarrow's file systems, so by any store that those know. Other formats
have to be decoded from front to back: such a file is one task, which runs
``ffmpeg`` and holds one window and one block.

``binary_windows`` reads rows (path, content) of Spark's ``binaryFile`` the same
way, for stores that only Spark can open; there a file is one value.

Defined results: a file that can't be read has a row with an error; so has one
with a window of under a second, after the windows before it; a file longer than
``most_seconds``, or larger than ``most_bytes`` if that is asked for, has the one
row that says so. Rows of errors have no window.
"""

from __future__ import annotations

import io
import json
import os
import shutil
import struct
import subprocess
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.display import AUDIO_SUFFIXES, is_audio
from ..operators.sampling import DURATION_SLACK, WINDOW_SECONDS, starts_of

RATE = 48_000
LEAST_WINDOW_SECONDS = 1.0
#: Bytes of a wave file that one task reads the windows of.
RANGE_BYTES = 64 << 20
#: Samples of a decoder's output that are taken at once.
BLOCK_SAMPLES = 1 << 18
TOO_LONG = "the recording is too long"
_FAILURES = (ValueError, EOFError, OSError, struct.error, subprocess.SubprocessError)

WINDOWS = (
    "path string, duration_s double, window_ix int, start_s double, rate int, samples array<float>, error string, "
    "probe_ms double, decode_ms double, began double"
)
_KINDS = (pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.float32()), pa.string(), pa.float64(), pa.float64(), pa.float64())
_NAMES = [c.split()[0] for c in WINDOWS.split(", ")]


def missing_tools(names: tuple[str, ...] = ("ffmpeg", "ffprobe")) -> list[str]:
    """Which of the decoder's programs aren't installed on this machine."""
    return [n for n in names if shutil.which(n) is None]


# --- wave files ----------------------------------------------------------------


@dataclass(frozen=True)
class Wave:
    rate: int
    channels: int
    width: int
    first: int  # byte of the first frame
    frames: int

    @property
    def seconds(self) -> float:
        return self.frames / self.rate


def wave_header(f, size: int) -> Wave:
    """What a PCM wave file of ``size`` bytes says of itself; RF64 files and those of unknown length too."""
    kind, _, form = struct.unpack("<4sI4s", f.read(12))
    if kind not in (b"RIFF", b"RF64") or form != b"WAVE":
        raise ValueError("this isn't a wave file")
    shape, wide, at = None, None, 12
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"ds64":
            wide = struct.unpack("<QQ", f.read(16))[1]
        elif name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
            if code not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or not channels or not rate:
                raise ValueError("only PCM of whole bytes is read here")
            shape = rate, channels, bits // 8
        elif name == b"data":
            if shape is None:
                raise ValueError("the wave file has no format")
            left = size - at - 8
            length = min(wide if wide is not None else length if length not in (0, 0xFFFFFFFF) else left, left)
            return Wave(*shape, at + 8, length // (shape[1] * shape[2]))
        at += 8 + length + length % 2
    raise ValueError("the wave file has no samples")


def wave_bytes(samples, rate: int = RATE, channels: int = 1) -> bytes:
    """A 16-bit wave file of samples in [-1, 1], the same in each channel."""
    body = np.repeat((np.asarray(samples, float) * 32767).astype("<i2"), channels).tobytes()
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(body), b"WAVE") + form + struct.pack("<4sI", b"data", len(body)) + body


def _scaled(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples in [-1, 1], channels averaged."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1)


def _resampled(x: np.ndarray, rate: int, n: int, to: int) -> np.ndarray:
    """``n`` samples at the rate ``to`` of samples at another rate, on straight lines between them."""
    if rate == to:
        return x[:n].astype(np.float32)
    return np.interp(np.arange(n) * (rate / to), np.arange(len(x)), x).astype(np.float32) if len(x) else np.zeros(0, np.float32)


def wave_window(f, wave: Wave, start: float, seconds: float, to: int) -> np.ndarray:
    """The samples of a window, from the bytes that hold it alone."""
    at = min(round(start * wave.rate), wave.frames)
    count = min(round(seconds * wave.rate) + 1, wave.frames - at)
    frame = wave.channels * wave.width
    f.seek(wave.first + at * frame)
    raw = f.read(count * frame)
    n = min(round(seconds * to), int((wave.frames - at) * to / wave.rate))
    return _resampled(_scaled(raw[: len(raw) // frame * frame], wave.width, wave.channels), wave.rate, n, to)


# --- other formats -------------------------------------------------------------


def cut(blocks: Iterator[np.ndarray], spans: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """The samples of spans (from, to), in the order of their starts, of a signal that comes in blocks; fewer where it ends."""
    held: dict[int, list[np.ndarray]] = {}
    given, end = 0, 0
    for block in blocks:
        begin, end = end, end + len(block)
        for i in range(given, len(spans)):
            first, last = spans[i]
            if first >= end:
                break
            held.setdefault(i, []).append(block[max(first - begin, 0) : max(last - begin, 0)])
        while given < len(spans) and spans[given][1] <= end:
            yield np.concatenate(held.pop(given, [block[:0]]))
            given += 1
        if given == len(spans):
            return
    for i in range(given, len(spans)):
        yield np.concatenate(held.pop(i, [np.zeros(0, np.float32)]))


def decoded(name: str, starts: list[float], seconds: float, to: int) -> Iterator[np.ndarray]:
    """The windows of a file on this machine, in one run of the decoder."""
    if missing_tools(("ffmpeg",)):
        raise ValueError("ffmpeg isn't installed")
    command = ["ffmpeg", "-v", "error", "-i", name, "-vn", "-ac", "1", "-ar", str(to), "-f", "f32le", "pipe:1"]
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as decoder:
        raw = iter(lambda: decoder.stdout.read(4 * BLOCK_SAMPLES), b"")
        spans = [(first, first + round(seconds * to)) for first in (round(s * to) for s in starts)]
        try:
            yield from cut((np.frombuffer(r[: len(r) // 4 * 4], "<f4") for r in raw), spans)
        finally:
            decoder.terminate()


def probed(name: str) -> float:
    """Seconds of a file on this machine, as ffprobe tells."""
    if missing_tools(("ffprobe",)):
        raise ValueError("ffprobe isn't installed")
    command = ["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "json", name]
    done = subprocess.run(command, capture_output=True, timeout=60, check=True)
    return float(json.loads(done.stdout).get("format", {}).get("duration", "nan"))


# --- windows of a file -----------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """What is asked of each file."""

    interval: float = 25.0
    seconds: float = WINDOW_SECONDS
    rate: int = RATE
    most_seconds: float = float("inf")
    most_bytes: float = float("inf")

    def starts(self, duration: float) -> list[float]:
        if not np.isfinite(duration) or duration <= 0:
            raise ValueError("the duration isn't positive")
        if duration > self.most_seconds + DURATION_SLACK:
            raise ValueError(TOO_LONG)
        return starts_of(duration, self.interval, self.seconds)


def _local_copy(f, suffix: str):
    """A task's own copy of a file that the decoder's programs can't open where it is."""
    copy = tempfile.NamedTemporaryFile(suffix=suffix)
    shutil.copyfileobj(f, copy, 1 << 20)
    copy.flush()
    return copy


def windows_of(path: str, f, size: int, plan: Plan, first: int = 0, last: int | None = None, local: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of ``WINDOWS``: the windows of an open file that begin in bytes first .. last (all by default), or an error.

    ``local`` names the file on this machine, if it is there; else formats other
    than wave are copied to a temporary file first.
    """
    began, ready, spent = time.time(), 0.0, 0.0

    def row(duration, ix, start, rate, samples, error):
        values = (path, duration, ix, start, rate, samples, error, ready, spent, began)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS)], _NAMES)

    copy, duration = None, None
    try:
        if size > plan.most_bytes:
            raise ValueError(f"the file is over {plan.most_bytes:.0f} bytes")
        if path.lower().endswith(".wav"):
            wave = wave_header(f, size)
            duration = wave.seconds
            starts = plan.starts(duration)
            place = wave.channels * wave.width * wave.rate
            mine = [(i, s) for i, s in enumerate(starts) if first <= wave.first + s * place and (last is None or wave.first + s * place < last)]
            found = (wave_window(f, wave, s, plan.seconds, plan.rate) for _, s in mine)
        else:
            copy = None if local else _local_copy(f, os.path.splitext(path)[1])
            name = local or copy.name
            duration = probed(name)
            mine = list(enumerate(plan.starts(duration)))
            found = decoded(name, [s for _, s in mine], plan.seconds, plan.rate)
        ready = 1000 * (time.time() - began)
        for ix, start in mine:
            at = time.time()
            samples = next(found)
            spent = 1000 * (time.time() - at)
            if len(samples) < LEAST_WINDOW_SECONDS * plan.rate:
                raise ValueError(f"the window at {start} s is too short")
            yield row(duration, ix, start, plan.rate, samples, None)
            ready = 0.0
    except _FAILURES as e:
        # of a file that can't be read at all, its first task says so
        if duration is not None and str(e) != TOO_LONG or first == 0:
            yield row(duration, None, None, None, None, str(e) or type(e).__name__)
    finally:
        if copy:
            copy.close()


# --- the data source -------------------------------------------------------------


@dataclass
class FileRange:
    path: str
    size: int
    first: int
    last: int | None


@dataclass
class Task(InputPartition):
    """What one task reads: a range of a large file, or some small files."""

    ranges: list[FileRange]


class WindowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.plan = options["path"], Plan(
            float(options.get("interval", 25)), float(options.get("seconds", WINDOW_SECONDS)), int(options.get("rate", RATE)), float(options.get("most_seconds", "inf")), float(options.get("most_bytes", "inf")),
        )
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("path",):
                wanted = set(f.value)
            else:
                yield f
                continue
            self.paths = wanted if self.paths is None else self.paths & wanted

    def files(self) -> list[tuple[str, int]]:
        store, base = pafs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else os.path.abspath(self.root))
        info = store.get_file_info(base)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(base, recursive=True))
        return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(tuple(f".{s}" for s in AUDIO_SUFFIXES)))

    def partitions(self) -> list[Task]:
        """Ranges of about ``range_bytes``; opening a file counts as a 64th of one."""
        out, held, room = [Task([])], 0, self.range_bytes
        for path, size in self.files():
            if self.paths is not None and path not in self.paths:
                continue
            if path.lower().endswith(".wav") and size > self.range_bytes:
                edges = list(range(0, size, room))
                out += [Task([FileRange(path, size, a, b)]) for a, b in zip(edges, [*edges[1:], None])]
                held = room
                continue
            if held + size > room:
                out.append(Task([]))
                held = 0
            out[-1].ranges.append(FileRange(path, size, 0, None))
            held += size + room // 64
        return [t for t in out if t.ranges] or out

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else os.path.abspath(self.root))
        for r in partition.ranges:
            local = r.path if isinstance(store, pafs.LocalFileSystem) else None
            with store.open_input_file(r.path) as f:
                yield from windows_of(r.path, f, r.size, self.plan, r.first, r.last, local)


class WindowSource(DataSource):
    """Options: path (a file or folder), interval, seconds, rate, most_seconds, most_bytes, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return WINDOWS

    def reader(self, schema) -> WindowReader:
        return WindowReader(self.options)


def read_windows(spark: SparkSession, path: str, interval: float = 25.0, **options) -> DataFrame:
    """Rows of ``WINDOWS`` of the audio files below a path."""
    spark.dataSource.register(WindowSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("recordings").option("path", path).option("interval", str(interval))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


# --- files as values --------------------------------------------------------------


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the audio files below a path that Spark can open."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(is_audio(F.col("path"))).select("path", "length", "content")


def binary_windows(files: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Rows of ``WINDOWS`` of rows (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                yield from windows_of(path, io.BytesIO(content or b""), content.size if content else 0, plan)

    return files.select("path", "content").mapInArrow(run, WINDOWS)
