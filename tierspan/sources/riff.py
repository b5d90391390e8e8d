"""What a RIFF (or RF64) file of samples holds and where, from its chunks' heads, and its samples as mono float32.

PCM of 8, 16, 24 and 32 bits and floats of 32 and 64 bits are read, of any number of channels.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs

_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Layout:
    """Where a file's samples lie and what they are."""

    rate: int
    channels: int
    bits: int
    is_float: bool
    data_at: int
    samples: int

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8


def open_file(path: str) -> pa.NativeFile:
    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(name)


def layout(file: pa.NativeFile) -> Layout:
    """The layout of a RIFF file from its chunks' heads."""
    size = file.size()
    head = file.read_at(12, 0)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("no RIFF file of samples")
    at, kind, long_size = 12, None, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", file.read_at(8, at))
        body = at + 8
        if name == b"ds64":
            long_size = struct.unpack("<QQ", file.read_at(16, body))[1]
        elif name == b"fmt ":
            raw = file.read_at(min(length, 40), body)
            if len(raw) < 16:
                raise ValueError("the format chunk is cut off")
            code, channels, rate, _, block, bits = struct.unpack("<HHIIHH", raw[:16])
            if code == _EXTENSIBLE and len(raw) >= 26:
                code = struct.unpack("<H", raw[24:26])[0]
            if not channels or (code, bits) not in {(_PCM, 8), (_PCM, 16), (_PCM, 24), (_PCM, 32), (_FLOAT, 32), (_FLOAT, 64)} or block != channels * bits // 8:
                raise ValueError(f"samples of format {code} with {bits} bits aren't read")
            kind = (rate, channels, bits, code == _FLOAT)
        elif name == b"data":
            if kind is None:
                raise ValueError("samples stand before their format")
            length = long_size if length == 0xFFFFFFFF and long_size is not None else length
            length = min(length, size - body)
            return Layout(*kind, body, length // (kind[1] * kind[2] // 8))
        at = body + length + length % 2
    raise ValueError("no samples")


def decoded(raw: bytes, at: Layout) -> np.ndarray:
    """Mono float32 of interleaved samples, integers scaled to [-1, 1)."""
    if at.is_float:
        x = np.frombuffer(raw, f"<f{at.bits // 8}").astype(np.float32)
    elif at.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif at.bits == 24:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = (np.frombuffer(raw, f"<i{at.bits // 8}") / float(1 << (at.bits - 1))).astype(np.float32)
    return x if at.channels == 1 else x.reshape(-1, at.channels).mean(axis=1, dtype=np.float32)


def read_samples(path: str, start: int | None = None, stop: int | None = None) -> tuple[np.ndarray, int]:
    """Samples [start, stop) of a file, as mono, and its rate. Only their bytes are read."""
    with open_file(path) as file:
        at = layout(file)
        first, last = min(max(start or 0, 0), at.samples), at.samples if stop is None else min(max(stop, 0), at.samples)
        raw = file.read_at(max(0, last - first) * at.frame, at.data_at + first * at.frame)
        return decoded(raw, at), at.rate
