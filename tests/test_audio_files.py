import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierspan.operators import audio, writes
from tierspan.sources import audio_files, riff


def pcm(x, bits):
    if bits == 8:
        return (np.round(x * 127) + 128).astype(np.uint8).tobytes()
    whole = np.round(x * ((1 << (bits - 1)) - 1)).astype(np.int64)
    if bits == 24:
        return b"".join(int(v).to_bytes(4, "little", signed=True)[:3] for v in whole)
    return whole.astype(f"<i{bits // 8}").tobytes()


def made_file(body, rate, channels, bits, code=1, before=(), size=None, extensible=False):
    block = channels * bits // 8
    head = struct.pack("<HHIIHH", 0xFFFE if extensible else code, channels, rate, rate * block, block, bits)
    if extensible:
        head += struct.pack("<HHIH", 22, bits, 0, code) + b"\0" * 14
    chunks = b"".join(n + struct.pack("<I", len(c)) + c + b"\0" * (len(c) % 2) for n, c in [*before, (b"fmt ", head), (b"LIST", b"odd")])
    chunks += b"data" + struct.pack("<I", len(body) if size is None else size) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def tone(n, rate=16000):
    t = np.arange(n) / rate
    return 0.4 * np.sin(2 * np.pi * (200 + 300 * t) * t) + 0.1 * np.cos(2 * np.pi * 1700 * t)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at, x = tmp_path_factory.mktemp("wav"), tone(4000)
    made = {f"pcm{bits}": made_file(pcm(x, bits), 16000, 1, bits) for bits in (8, 16, 24, 32)}
    made["float32"] = made_file(x.astype("<f4").tobytes(), 16000, 1, 32, code=3)
    made["float64"] = made_file(x.astype("<f8").tobytes(), 16000, 1, 64, code=3)
    made["extensible"] = made_file(pcm(x, 24), 16000, 1, 24, extensible=True)
    made["stereo"] = made_file(np.stack([np.frombuffer(pcm(x, 16), "<i2"), np.frombuffer(pcm(x / 2, 16), "<i2")], axis=1).tobytes(), 16000, 2, 16, before=[(b"junk", b"abc")])
    made["unsized"] = made_file(pcm(x, 16), 16000, 1, 16, size=0xFFFFFFFF)
    made |= {"empty": b"", "text": b"no sound at all here", "headless": b"RIFF" + struct.pack("<I", 4) + b"WAVE", "mulaw": made_file(b"\1" * 100, 8000, 1, 8, code=7), "nosound": made_file(b"", 16000, 1, 16)}
    for name, content in made.items():
        (at / f"{name}.wav").write_bytes(content)
    return at


def test_samples_of_all_formats(files):
    x = tone(4000)
    for name in ("pcm16", "pcm24", "pcm32", "float32", "float64", "extensible", "unsized", "pcm8", "stereo"):
        got, rate = riff.read_samples(f"{files}/{name}.wav")
        assert rate == 16000 and got.dtype == np.float32 and len(got) == 4000
        np.testing.assert_allclose(got, 0.75 * x if name == "stereo" else x, atol=0.01 if name == "pcm8" else 1e-4)
        for start, stop in ((None, 10), (100, 200), (3990, None), (3990, 9999), (9999, None), (20, 10), (-5, 5)):
            part, _ = riff.read_samples(f"file://{files}/{name}.wav", start, stop)
            assert np.array_equal(part, got[max(start or 0, 0) : stop])
    same, _ = audio.read_wave((files / "pcm16.wav").read_bytes())
    assert np.array_equal(same, riff.read_samples(f"{files}/pcm16.wav")[0])


def test_bad_files_are_rows(spark, files):
    paths = spark.createDataFrame([(f"{files}/{p.name}",) for p in files.iterdir()] + [(f"{files}/none.wav",), (None,)], "path string")
    got = {(r["path"] or "").rsplit("/", 1)[-1]: r for r in audio_files.describe(paths).collect()}
    assert {k for k, r in got.items() if r["error"]} == {"empty.wav", "text.wav", "headless.wav", "mulaw.wav", "none.wav", ""}
    assert (got["stereo.wav"]["n_channels"], got["pcm24.wav"]["bits"], got["pcm24.wav"]["n_samples"], got["pcm24.wav"]["duration"]) == (2, 24, 4000, 250)
    assert got["nosound.wav"]["n_samples"] == 0


def test_windows_and_segments(spark, files):
    whole, _ = riff.read_samples(f"{files}/pcm24.wav")
    asked = spark.createDataFrame([(1, f"{files}/pcm24.wav", 5, 9), (2, f"{files}/pcm24.wav", 3998, None), (3, f"{files}/pcm24.wav", None, 3)], "k int, path string, first long, last long")
    got = {r["k"]: r["samples"] for r in audio_files.windows(asked).collect()}
    assert np.allclose(got[1], whole[5:9]) and np.allclose(got[2], whole[3998:]) and np.allclose(got[3], whole[:3])
    segments = spark.createDataFrame([("s", "a", 10, 21)], "identifier string, audio_id string, start long, end long")
    audios = spark.createDataFrame([("a", f"{files}/pcm24.wav", 16000)], "audio_id string, path string, sample_rate long")
    assert np.allclose(audio_files.segment_samples(segments, audios).first()["samples"], whole[160:336])


@pytest.mark.parametrize("rate", [16000, 11025])
def test_ranges_of_frames_equal_the_whole_recording(spark, tmp_path, monkeypatch, rate):
    n = rate * 3 + 17
    content = made_file(pcm(tone(n, rate), 24), rate, 1, 24)
    (tmp_path / "a.wav").write_bytes(content)
    whole = audio.recording_mfcc(riff.read_samples(f"{tmp_path}/a.wav")[0], rate)
    audios = spark.createDataFrame([("a", f"{tmp_path}/a.wav")], "audio_id string, path string")
    asked = spark.createDataFrame([("a", f"{tmp_path}/a.wav", 0, len(whole) - 1)], "audio_id string, path string, first long, last long")
    for got in (audio_files.range_frames(asked, 7), audio_files.range_frames(asked, 1), audio_files.recording_frames(audios)):
        rows = got.orderBy("frame").collect()
        assert [r["frame"] for r in rows] == list(range(len(whole)))
        np.testing.assert_allclose(np.array([r["mfcc"] for r in rows]), whole, rtol=1e-4, atol=1e-3)
    assert audio_files.range_frames(asked, 7).rdd.getNumPartitions() >= 1
    # bytes that are read follow the frames asked for
    read = []
    kept = riff.open_file

    class Counting:
        def __init__(self, path):
            self.file = kept(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            read.append(n)
            return self.file.read_at(n, at)

    monkeypatch.setattr(riff, "open_file", Counting)
    riff.read_samples(f"{tmp_path}/a.wav", 1000, 1100)
    assert sum(read) < 100 * 3 + 100 < len(content)


def test_segments_of_files_equal_those_of_contents(spark, tmp_path):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(16000)
        f.writeframes(pcm(tone(48000), 16))
    (tmp_path / "a.wav").write_bytes(out.getvalue())
    segments = spark.createDataFrame([("x", "a", 0, 300), ("y", "a", 250, 900), ("z", "a", 2900, 3000)], "identifier string, audio_id string, start long, end long").withColumns({"duration": F.lit(3000).cast("long"), "sample_rate": F.lit(16000).cast("long")})
    show = lambda df: {(r["identifier"], r["frame"]): r["mfcc"] for r in df.collect()}
    a = show(audio_files.batch_mfcc(segments, spark.createDataFrame([("a", f"{tmp_path}/a.wav")], "audio_id string, path string")))
    b = show(audio.batch_mfcc(segments, spark.createDataFrame([("a", bytearray(out.getvalue()))], "audio_id string, content binary")))
    assert a.keys() == b.keys() and a
    np.testing.assert_allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-4, atol=1e-3)
    with pytest.raises(writes.Rejected):
        audio_files.batch_mfcc(segments.withColumn("end", F.lit(9999)), spark.createDataFrame([("a", "x")], "audio_id string, path string"))
