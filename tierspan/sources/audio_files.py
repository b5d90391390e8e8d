"""Recordings read by byte ranges: what a file is, exact windows of its samples, and MFCC of some frames without the rest of it.

A RIFF (or RF64) file is walked chunk by chunk from its head; samples are then read from where they lie. PCM of 8, 16, 24 and 32 bits and
floats of 32 and 64 bits, of any number of channels, become mono float32. Windows and ranges of frames are rows, so one recording is
read by many tasks and no task holds more than a window or RANGE_FRAMES frames of it. Paths are what Arrow's file systems open.

Defined cases: a file that can't be read is a row with `error`, never a failed job, where rows say what files are; windows of such a
file are an error. A window is cut at the recording's ends; one that begins beyond them is empty. A header whose size is missing or too large is
taken to end with the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspan.operators import audio
from tierspan.operators.writes import require_empty
from tierspan.session import ship
from tierspan.sources.riff import decoded, layout, open_file, read_samples

INFO = "path string, sample_rate long, n_channels int, bits int, n_samples long, duration long, error string"


def describe(paths: DataFrame) -> DataFrame:
    """(path, sample_rate, n_channels, bits, n_samples, duration in ms, error) of each file in `path`, from its head alone."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    with open_file(path) as file:
                        at = layout(file)
                    rows.append((path, at.rate, at.channels, at.bits, at.samples, at.samples * 1000 // at.rate, None))
                except (OSError, ValueError, TypeError, ZeroDivisionError, struct.error) as e:
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in INFO.split(", ")])

    ship(paths.sparkSession)
    return paths.select("path").mapInArrow(look, INFO)


def windows(wanted: DataFrame) -> DataFrame:
    """`wanted` (path, first, last and other columns) with `samples`, those of [first, last) of the file; a null end is the file's."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (path, first, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "first", "last")), strict=True)):
                samples, rate = read_samples(path, first, last)
                found = pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples))
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns), pa.array([rate], pa.int64()), found], [*batch.schema.names, "rate", "samples"])

    ship(wanted.sparkSession)
    return wanted.mapInArrow(cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields) + ", rate long, samples array<float>")


def segment_samples(segments: DataFrame, audios: DataFrame) -> DataFrame:
    """(identifier, rate, samples) of segments (audio_id, start, end in ms), from audios (audio_id, path, sample_rate)."""
    at = lambda c: F.floor(F.col(c) * F.col("sample_rate") / 1000).cast("long")
    wanted = segments.select("identifier", "audio_id", "start", "end").join(audios.select("audio_id", "path", "sample_rate"), "audio_id")
    return windows(wanted.select("identifier", "path", at("start").alias("first"), at("end").alias("last"))).select("identifier", "rate", "samples")


def _samples_of(first: int, last: int, rate: int, total: int) -> tuple[int, int, int]:
    """(first sample, end, first frame) of what frames first to last, and those their derivatives look at, are made of."""
    win, hop = round(rate * 0.025), round(rate * 0.010)
    end = (total - win) // hop
    low, high = max(0, first - audio.CONTEXT), min(end, last + audio.CONTEXT)
    return low * hop, high * hop + win, low


def range_frames(ranges: DataFrame, frames: int = audio.RANGE_FRAMES) -> DataFrame:
    """(audio_id, frame, mfcc) of ranges of frames (audio_id, path, first, last), each cut into rows of so many frames, dealt to all tasks.

    A task reads the bytes of its frames and of the CONTEXT frames around them, so results are those of the whole recording.
    """
    kind = ranges.schema["audio_id"].dataType.simpleString()
    parts = ranges.where("first <= last").withColumn("_at", F.explode(F.sequence("first", "last", F.lit(frames))))
    parts = parts.select("audio_id", "path", F.col("_at").alias("first"), F.least(F.col("last"), F.col("_at") + frames - 1).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (path, first, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "first", "last")), strict=True)):
                with open_file(path) as file:
                    at = layout(file)
                    start, stop, low = _samples_of(first, last, at.rate, at.samples)
                    raw = file.read_at(max(0, stop - start) * at.frame, at.data_at + start * at.frame)
                matrix = audio.recording_mfcc(decoded(raw, at), at.rate)[first - low : last + 1 - low]
                n, width = matrix.shape
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("audio_id").take(pa.array(np.full(n, k))), pa.array(np.arange(first, first + n)), rows], ["audio_id", "frame", "mfcc"])

    ship(ranges.sparkSession)
    dealt = parts.repartition("path", "first")
    return dealt.mapInArrow(run, f"audio_id {kind}, frame long, mfcc array<float>")


def recording_frames(audios: DataFrame) -> DataFrame:
    """(audio_id, frame, mfcc) of whole recordings (audio_id, path), by many tasks each."""
    known = audios.join(describe(audios.select("path").distinct()).where("error IS NULL").select("path", "n_samples", F.col("sample_rate").alias("_rate")), "path")
    last = F.floor((F.col("n_samples") - audio.window_samples(F.col("_rate"))) / audio.hop_samples(F.col("_rate")))
    return range_frames(known.select("audio_id", "path", F.lit(0).cast("long").alias("first"), last.cast("long").alias("last")))


def batch_mfcc(segments: DataFrame, audios: DataFrame, *, even_only: bool = True) -> DataFrame:
    """(identifier, frame, mfcc) of segments (with their audio's duration and sample_rate), from audios (audio_id, path).

    As `audio.batch_mfcc`, but no task holds a whole recording: frames that segments need are merged to ranges, and those are dealt out.
    """
    require_empty(audio.invalid_spans(segments).select("identifier"), "segments without length or outside their audio")
    first, last = audio.frame_range(F.col("start"), F.col("end"), F.col("duration"), F.col("sample_rate"))
    needed = audio.merged_ranges(segments.select("audio_id", first.alias("first"), last.alias("last")).where("first <= last"))
    frames = range_frames(needed.join(audios.select("audio_id", "path"), "audio_id"))
    return audio.segment_mfcc(segments, frames, even_only=even_only)
