import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierspan.operators import audio, staging, writes
from tierspan.plans.query import Query
from tierspan.plans.schema import GRAPH, SCHEMAS

#: (level, identifier, parent, audio, speaker, start, end, code)
ROWS = [
    ("phrases", "p1", None, "A", "s1", 0, 1000, None),
    ("phrases", "p2", None, "A", "s2", 900, 2000, None),
    ("words", "w1", "p1", "A", "s1", 0, 400, None),
    ("words", "w2", "p1", "A", "s1", 400, 1000, None),
    ("words", "w3", "p2", "A", "s2", 900, 2000, None),
    ("syllables", "y1", "w1", "A", "s1", 0, 400, 1),
    ("syllables", "y2", "w2", "A", "s1", 400, 1000, None),
    ("phones", "f1", "y1", "A", "s1", 0, 200, 1),
    ("phones", "f2", "y2", "A", "s1", 400, 600, 2),
    ("phones", "f3", None, "A", "s1", 600, 700, 9),
]


@pytest.fixture(scope="module")
def tables(spark):
    out = {}
    for level in ("phrases", "words", "syllables", "phones"):
        schema = SCHEMAS[level]
        rows = []
        for kind, ident, parent, at, speaker, start, end, code in ROWS:
            if kind == level:
                own = {"identifier": ident.encode(), "parent_id": parent and parent.encode(), "audio_id": at.encode(), "speaker_id": speaker.encode(), "start": start, "end": end, "overlap_code": {"p1": 1, "p2": 0}.get(ident, 9), "stress_code": code, "position_code": code, "label": ident}
                rows.append(tuple(own.get(f.name) for f in schema.fields))
        out[level] = spark.createDataFrame(rows, schema)
    for name in ("audios", "speakers"):
        out[name] = spark.createDataFrame([(k.encode(), *[None] * (len(SCHEMAS[name]) - 1)) for k in (["A"] if name == "audios" else ["s1", "s2"])], SCHEMAS[name])
    return staging_linked(out)


def staging_linked(tables):
    return tables | staging.link_trees({k: tables[k] for k in ("phrases", "words", "syllables", "phones")})


def ids(query):
    return sorted(r["identifier"].decode() for r in query.rows().collect())


def test_links_reach_all_levels(tables):
    phones = {r["identifier"].decode(): r for r in tables["phones"].collect()}
    assert phones["f1"]["phrase_id"] == b"p1" and phones["f1"]["phrase_start"] == 0 and phones["f1"]["parent_start"] == 0
    assert phones["f2"]["phrase_id"] == b"p1" and phones["f2"]["parent_start"] == 400
    assert phones["f3"]["phrase_id"] is None and phones["f3"]["parent_start"] is None
    assert tables["words"].columns == SCHEMAS["words"].names


def test_bad_links_are_rejected(tables):
    words, phrases = tables["words"], tables["phrases"]
    for bad in (words.withColumn("parent_id", F.lit(b"none")), words.withColumn("audio_id", F.lit(b"B")), words.withColumn("audio_id", F.lit(None).cast("binary")), words.withColumn("speaker_id", F.lit(b"s9"))):
        with pytest.raises(writes.Rejected):
            staging.link(bad, phrases, "words")
    assert staging.link(words.withColumn("speaker_id", F.lit(None).cast("binary")), phrases, "words").count() == 3
    assert staging.link(words.limit(0), phrases.limit(0), "words").count() == 0


def test_children_are_displaced(tables):
    first = tables["phrases"].where("label = 'p1'")
    staged = tables["words"].where("label = 'w1'").withColumn("identifier", F.lit(b"w9"))
    got = staging.replace_children(tables["words"], first, staged, "words")
    assert sorted(r["identifier"] for r in got.collect()) == [b"w3", b"w9"]
    with pytest.raises(writes.Rejected):
        staging.replace_children(tables["words"], first, tables["words"].where("label = 'w3'"), "words")


def test_identity_stays(tables):
    phrases = tables["phrases"]
    writes.same_identity(phrases, phrases.withColumn("end", F.col("end") + 1))
    for column in ("audio_id", "speaker_id"):
        with pytest.raises(writes.Rejected):
            writes.same_identity(phrases, phrases.withColumn(column, F.lit(b"other")))


def test_computed_attributes(tables):
    of = lambda entity: Query(tables, GRAPH, entity)
    assert ids(of("words").filter(duration__gt=400)) == ["w2", "w3"]
    assert ids(of("words").filter(start_seconds__gte=0.4, middle__lt=1000)) == ["w2"]
    assert ids(of("phrases").filter(overlap=True)) == ["p1"] and ids(of("words").filter(overlap=None)) == ["w1", "w2", "w3"]
    assert ids(of("phrases").filter(words__duration=600)) == ["p1"] and ids(of("words").filter(phrase__duration=1100)) == ["w3"]
    assert ids(of("syllables").filter(stress="primary")) == ["y1"] and ids(of("phones").filter(position="nucleus")) == ["f2"]
    assert ids(of("phones").filter(stress="primary")) == ["f1"] and ids(of("phones").filter(stress__in=["unknown"])) == ["f2", "f3"]
    assert ids(of("phones").exclude(stress="unknown", duration__gt=100)) == ["f1", "f3"]
    assert ids(of("words").filter(syllables__phones__stress="unknown")) == ["w2"]
    assert [r["identifier"] for r in of("words").order_by("-duration").df().collect()] == [b"w3", b"w2", b"w1"]
    assert [r["identifier"] for r in of("phones").order_by("stress", "-start").df().collect()] == [b"f1", b"f3", b"f2"]
    with pytest.raises(AttributeError):
        of("words").filter(stress="primary")


def test_relation_accessors(tables):
    of = lambda entity: Query(tables, GRAPH, entity)
    assert ids(of("audios").related("words")) == ["w1", "w2", "w3"]
    assert ids(of("phrases").filter(label="p1").related("words").filter(duration__gt=400)) == ["w2"]
    assert ids(of("phrases").filter(label="p1").related("phones")) == ["f1", "f2"]
    assert ids(of("phones").related("syllable").related("word")) == ["w1", "w2"]
    assert ids(of("words").filter(label="w3").related("speaker")) == ["s2"]
    with pytest.raises(AttributeError):
        of("words").related("label")


def test_batch_mfcc_equals_whole_recordings(spark, monkeypatch):
    monkeypatch.setattr(audio, "RANGE_FRAMES", 40)
    rng = np.random.default_rng(3)
    rows = []
    for name in "AB":
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(16000)
            f.writeframes((rng.normal(0, 3000, 32000)).astype("<i2").tobytes())
        rows.append((name, bytearray(out.getvalue())))
    audios = spark.createDataFrame(rows, "audio_id string, content binary")
    made = [("x", "A", 100, 900), ("y", "A", 150, 160), ("z", "A", 1900, 2000), ("u", "A", 0, 30), ("same", "A", 100, 900), ("v", "B", 700, 1500)]
    segments = spark.createDataFrame([(*m, 2000, 16000) for m in made], "identifier string, audio_id string, start long, end long, duration long, sample_rate long")
    for even in (False, True):
        want = {(r["identifier"], r["frame"]): r["mfcc"] for r in audio.segment_mfcc(segments, audio.mfcc_frames(audios), even_only=even).collect()}
        got = {(r["identifier"], r["frame"]): r["mfcc"] for r in audio.batch_mfcc(segments, audios, even_only=even).collect()}
        assert got.keys() == want.keys() and len(got) > 100 // (1 + even)
        assert max(np.abs(np.array(got[k]) - np.array(want[k])).max() for k in got) < 1e-3
    with pytest.raises(writes.Rejected):
        audio.batch_mfcc(segments.withColumn("end", F.lit(5000)), audios)
    with pytest.raises(Exception, match="samples a second"):
        audio.batch_mfcc(segments.withColumn("sample_rate", F.lit(8000)), audios).collect()


def test_merged_ranges(spark):
    rows = spark.createDataFrame([("A", 0, 5), ("A", 14, 20), ("A", 30, 31), ("A", 2, 3), ("B", 7, 7)], "audio_id string, first long, last long")
    assert sorted(tuple(r) for r in audio.merged_ranges(rows).collect()) == [("A", 0, 20), ("A", 30, 31), ("B", 7, 7)]
