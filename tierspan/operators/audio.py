"""Frame grids and MFCC matrices. The grid is plain arithmetic; spectra are numpy per recording."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierspan.operators.writes import require_empty
from tierspan.session import ship
from tierspan.sources import riff

MELS, COEFFICIENTS, WIDTH = 40, 13, 9
CONTEXT = WIDTH // 2


def window_samples(rate: Column) -> Column:
    return F.rint(rate * 0.025).cast("long")


def hop_samples(rate: Column) -> Column:
    return F.rint(rate * 0.010).cast("long")


def frame_range(start: Column, end: Column, duration: Column, rate: Column) -> tuple[Column, Column]:
    """First and last 10 ms frame whose window meets [start, end) ms; last < first where there is none."""
    s, e, n = F.floor(start * rate / 1000), F.floor(end * rate / 1000), F.floor(duration * rate / 1000)
    win, hop = window_samples(rate), hop_samples(rate)
    first = F.greatest(F.lit(0), F.floor((s - win) / hop) + 1)
    last = F.least(F.floor((n - win) / hop), F.floor((e - 1) / hop))
    return first.cast("long"), last.cast("long")


def frame_indices(first: Column, last: Column, *, even_only: bool = False) -> Column:
    every = F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    return F.filter(every, lambda i: i % 2 == 0) if even_only else every


def invalid_spans(segments: DataFrame) -> DataFrame:
    """Segments without length or outside their audio."""
    return segments.where("end <= start OR start < 0 OR end > duration OR duration IS NULL")


def _mel(hz):
    hz = np.asarray(hz, dtype=float)
    return np.where(hz < 1000, 3 * hz / 200, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def _hz(mel):
    mel = np.asarray(mel, dtype=float)
    return np.where(mel < 15, 200 * mel / 3, 1000 * np.exp(np.log(6.4) * (mel - 15) / 27))


def mel_filters(rate: int, n_fft: int) -> np.ndarray:
    """Triangles of unit area, evenly spaced on the mel scale."""
    edges = _hz(np.linspace(_mel(0), _mel(rate / 2), MELS + 2))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def _polynomial(order: int, degree: int) -> np.ndarray:
    """Rows of weights for the derivative of a fitted polynomial at each place of a window."""
    x = np.arange(-CONTEXT, CONTEXT + 1)
    fit = np.linalg.pinv(np.vander(x, degree + 1, increasing=True))
    return fit[order] * (2 if order == 2 else 1)


def delta(matrix: np.ndarray, order: int) -> np.ndarray:
    padded = np.pad(matrix, ((CONTEXT, CONTEXT), (0, 0)), mode="edge")
    weights = _polynomial(order, order)
    return sum(w * padded[k : k + len(matrix)] for k, w in enumerate(weights))


def recording_mfcc(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 39): 13 cepstra on a 10 ms grid with their first and second derivatives."""
    win, hop = round(rate * 0.025), round(rate * 0.010)
    if len(samples) < win:
        return np.zeros((0, 3 * COEFFICIENTS), dtype=np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, win)[::hop]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)
    power = np.abs(np.fft.rfft(frames * hann, axis=1)) ** 2
    db = 10 * np.log10(np.maximum(1e-10, power @ mel_filters(rate, win).T))
    k = np.arange(COEFFICIENTS)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(MELS) + 1) / (2 * MELS)) * np.sqrt(np.where(k == 0, 1, 2) / MELS)
    cepstra = db @ basis.T
    return np.concatenate([cepstra, delta(cepstra, 1), delta(cepstra, 2)], axis=1).astype(np.float32)


def read_wave(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] of a file's bytes and their rate; channels are averaged."""
    file = pa.BufferReader(content)
    at = riff.layout(file)
    return riff.decoded(file.read_at(at.samples * at.frame, at.data_at), at), at.rate


def mfcc_frames(audios: DataFrame) -> DataFrame:
    """(audio_id, frame, mfcc) from (audio_id, content): one recording at a time, streamed."""

    def run(batches):
        for pdf in batches:
            for audio_id, content in zip(pdf["audio_id"], pdf["content"], strict=True):
                matrix = recording_mfcc(*read_wave(content))
                yield pd.DataFrame({"audio_id": audio_id, "frame": np.arange(len(matrix)), "mfcc": list(matrix)})

    ship(audios.sparkSession)
    kind = audios.schema["audio_id"].dataType.simpleString()
    return audios.select("audio_id", "content").mapInPandas(run, f"audio_id {kind}, frame long, mfcc array<float>")


def merged_ranges(ranges: DataFrame, gap: int = 2 * CONTEXT + 1) -> DataFrame:
    """(audio_id, first, last): ranges of frames of one recording that are at most `gap` apart are one."""
    along = Window.partitionBy("audio_id").orderBy("first", "last")
    reach = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("_opens", F.coalesce((F.col("first") > reach + gap).cast("int"), F.lit(1)))
    numbered = opened.withColumn("_k", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("audio_id", "_k").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_k")


def range_mfcc(samples: np.ndarray, rate: int, first: int, last: int) -> np.ndarray:
    """Rows first to last of `recording_mfcc`, from the samples that these frames and their derivatives need."""
    win, hop = round(rate * 0.025), round(rate * 0.010)
    end = (len(samples) - win) // hop
    low, high, last = max(0, first - CONTEXT), min(end, last + CONTEXT), min(end, last)
    return recording_mfcc(samples[low * hop : high * hop + win], rate)[first - low : max(first, last + 1) - low]


#: Frames that are computed together.
RANGE_FRAMES = 1 << 13


def batch_mfcc(segments: DataFrame, audios: DataFrame, *, even_only: bool = True) -> DataFrame:
    """(identifier, frame, mfcc) of segments (with their audio's duration and sample_rate), from audios (audio_id, content).

    Each frame is computed once however many segments share it, and frames that no segment needs aren't. Segments without length or
    outside their audio are rejected; a recording of another rate than its segments say is an error.
    """
    require_empty(invalid_spans(segments).select("identifier"), "segments without length or outside their audio")
    first, last = frame_range(F.col("start"), F.col("end"), F.col("duration"), F.col("sample_rate"))
    needed = merged_ranges(segments.select("audio_id", first.alias("first"), last.alias("last")).where("first <= last"))
    rates = segments.groupBy("audio_id").agg(F.min("sample_rate").alias("rate"), F.max("sample_rate").alias("_most"))
    listed = needed.groupBy("audio_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges")).join(rates, "audio_id")

    def run(batches):
        for pdf in batches:
            for audio_id, content, ranges, rate, most in zip(pdf["audio_id"], pdf["content"], pdf["ranges"], pdf["rate"], pdf["_most"], strict=True):
                samples, found = read_wave(content)
                if not rate == most == found:
                    raise ValueError(f"{audio_id} has {found} samples a second, its segments say {rate} to {most}")
                for r in ranges:
                    for at in range(r["first"], r["last"] + 1, RANGE_FRAMES):
                        matrix = range_mfcc(samples, rate, at, min(r["last"], at + RANGE_FRAMES - 1))
                        yield pd.DataFrame({"audio_id": audio_id, "frame": np.arange(at, at + len(matrix)), "mfcc": list(matrix)})

    ship(audios.sparkSession)
    kind = audios.schema["audio_id"].dataType.simpleString()
    frames = audios.select("audio_id", "content").join(listed, "audio_id").mapInPandas(run, f"audio_id {kind}, frame long, mfcc array<float>")
    return segment_mfcc(segments, frames, even_only=even_only)


def segment_mfcc(segments: DataFrame, frames: DataFrame, *, even_only: bool = True) -> DataFrame:
    """Frames of each segment, joined on (audio, frame)."""
    first, last = frame_range(F.col("start"), F.col("end"), F.col("duration"), F.col("sample_rate"))
    wanted = segments.select("identifier", "audio_id", F.explode(frame_indices(first, last, even_only=even_only)).alias("frame"))
    return wanted.join(frames, ["audio_id", "frame"]).select("identifier", "frame", "mfcc")
