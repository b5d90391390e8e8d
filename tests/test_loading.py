import json

import pytest
from pyspark.sql import functions as F

from tests.test_ingest import MAP, grid_text
from tierspan.operators import writes
from tierspan.plans.corpus import Corpus
from tierspan.sources import recordings, textgrid, utterances, webmaus

WORDS = [(0, 0.4, "pak"), (0.4, 1, ""), (1, 1.4, "pak")]
SEGMENTS = [(0, 0.1, "p"), (0.1, 0.3, "A"), (0.3, 0.4, "k"), (0.4, 1, "[]"), (1, 1.1, "p"), (1.1, 1.3, "A"), (1.3, 1.4, "k")]
FON = [(0, 0.4, "pAk"), (0.4, 1, ""), (1, 1.4, "pAk")]


def counts(rows):
    return {r["kind"]: r["n"] for r in rows.collect()}


def test_resumed_imports_audit_and_repair(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/checkpoints")
    names = [f"r{k}" for k in range(5)]

    def write(name, label="pak pak", segments=SEGMENTS):
        for side, tiers in (("ort", [("N1", [(0, 2, label)])]), ("awd", [("N1", WORDS), ("N1_FON", FON), ("N1_SEG", segments)])):
            (tmp_path / side).mkdir(exist_ok=True)
            (tmp_path / side / f"{name}.TextGrid").write_text(grid_text(tiers))

    def run(some, folder="ort", audit=2):
        rows = [textgrid.read_textgrids(spark, f"file://{tmp_path}/{side}").withColumn("file", F.regexp_extract("file", r"([^/]+)\.TextGrid$", 1)) for side in ("ort", "awd")]
        sources = spark.createDataFrame([(n, f"/{folder}/{n}", (tmp_path / "ort" / f"{n}.TextGrid").stat().st_size) for n in some], "file string, path string, size long")
        return counts(recordings.resume_pairs(corpus, sources, *rows, MAP, speakers, "test", audit))

    speakers = spark.createDataFrame([("N1", 30, 1)], "name string, age int, gender_code int")
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    labels = lambda: {bytes(r["audio_id"]).decode(): r["label"] for r in corpus.tables["phrases"].collect()}
    for name in names:
        write(name)
    assert run(names[:3]) == {"recordings_saved": 3, "skipped_marker": 3}
    assert run(names) == {"recordings_saved": 2, "recordings_audited": 2, "recordings_skipped": 1, "skipped_marker": 4}
    assert {r["object_type"]: r["n"] for r in corpus.counts().collect()} == {"audios": 5, "speakers": 1, "phrases": 5, "words": 10, "syllables": 10, "phones": 30, "speaker_audio": 5}
    assert corpus.tables["imports"].where("source = '/ort/r3' AND size > 0 AND signature LIKE '1:%'").count() == 1
    # one of the last two has changed, and one further back whose size tells; one further back of the same size isn't looked at
    files = {f.path for f in corpus.files["phones"]}
    write("r4", "pak kap", SEGMENTS[:-1])
    write("r0", "pak pak pak")
    write("r1", "kap pak")
    assert run(names) == {"recordings_repaired": 2, "recordings_audited": 1, "recordings_skipped": 2, "skipped_marker": 3}
    assert labels() == {"r0": "pak pak pak", "r1": "pak pak", "r2": "pak pak", "r3": "pak pak", "r4": "pak kap"}
    assert corpus.tables["phones"].count() == 29 and corpus.tables["words"].count() == 10 and files != {f.path for f in corpus.files["phones"]}
    assert run(names, audit=0) == {"recordings_skipped": 5}
    # what fails leaves no trace
    number = corpus.number
    with pytest.raises(writes.Rejected, match="elsewhere"):
        run(names, "moved")
    with pytest.raises(writes.Rejected, match="twice"):
        run([*names, "r0"])
    (tmp_path / "awd" / "r4.TextGrid").write_text("broken")
    with pytest.raises(writes.Rejected, match="can't be read"):
        run(names)
    assert Corpus(spark, corpus.path).number == number and labels()["r4"] == "pak kap"


def aligned(tmp_path, name, words, kan=None, leave=()):
    """An alignment of words (start, end, text), each one syllable and two phones."""
    kan = kan or [(a, b, w and f"{w} {w}") for a, b, w in words]
    syllables = [(a, b, w or "<p:>") for a, b, w in words]
    phones = [x for a, b, w in words for x in ([(a, (a + b) / 2, "p"), ((a + b) / 2, b, "a")] if w else [(a, b, "(.)")])]
    tiers = [(n, t) for n, t in (("ORT-MAU", words), ("KAN-MAU", kan), ("MAS", syllables), ("MAU", phones)) if n not in leave]
    (tmp_path / f"{name}.TextGrid").write_text(grid_text(tiers))


RECORD = "output_filename string, audio_filename string, tier_name string, start_time double, speaker_ids_audio array<string>"


def test_alignments_are_loaded_by_status_and_policy(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/checkpoints")
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    table = lambda name, rows, schema: recordings._fit(spark.createDataFrame(rows, schema), name)
    corpus.commit({"audios": table("audios", [("A", "/a.wav"), ("B", "/b.wav"), ("B2", "/b.wav")], "identifier string, filename string"), "speakers": table("speakers", [("S", "N1"), ("T", "N2")], "identifier string, name string")})
    (tmp_path / "tg").mkdir()
    said = [(0.0, 0.5, "hallo"), (0.5, 0.7, ""), (0.7, 1.0, "daar")]
    aligned(tmp_path / "tg", "one", said)
    aligned(tmp_path / "tg", "two", said)
    aligned(tmp_path / "tg", "apart", said, kan=[(0.0, 0.6, "x"), (0.6, 0.7, ""), (0.7, 1.0, "y")])
    aligned(tmp_path / "tg", "short", said, leave=("MAS",))
    aligned(tmp_path / "tg", "nobody", said)
    (tmp_path / "tg" / "damaged.TextGrid").write_text("x")
    read = lambda: textgrid.read_textgrids(spark, f"file://{tmp_path}/tg")
    path = lambda n: f"file:{tmp_path}/tg/{n}.TextGrid"
    assert read().where(F.col("file") == path("one")).count() > 0
    rows = [(path("one"), "/a.wav", "N1", 10.0, ["N1"]), (path("two"), "/b.wav", "N2", 2.5, ["N1", "N2"]), (path("none"), "/a.wav", "N1", 0.0, ["N1"]), (path("nobody"), "/x.wav", "N9", 0.0, ["N9"])]
    rows += [(path(n), "/a.wav", "N1", 30.0, ["N1"]) for n in ("apart", "short", "damaged")]
    records = spark.createDataFrame(rows, RECORD)
    assert counts(webmaus.load(corpus, records, read())) == {"added": 5, "no_textgrid": 1, "error": 1, "damaged file": 1, "missing tier": 1, "words and transcriptions differ": 1}
    phrases = {r["filename"]: r for r in corpus.tables["phrases"].collect()}
    one, two = phrases[path("one")], phrases[path("two")]
    assert len(phrases) == 2 and (one["start"], one["end"], one["label"], one["overlap_code"]) == (10000, 11000, "hallo daar", 0)
    assert (two["start"], bytes(two["audio_id"]), bytes(two["speaker_id"]), two["overlap_code"]) == (2500, b"B", b"T", 9)
    assert corpus.query("phones").filter(syllable__word__label="daar", phrase__filename=path("two")).count() == 2
    word = corpus.query("words").filter(label="hallo", phrase__filename=path("one")).get()
    assert word["ipa"] == "hallo hallo" and word["parent_start"] == 10000
    assert sorted((bytes(r["speaker_id"]), bytes(r["audio_id"])) for r in corpus.tables["speaker_audio"].collect()) == [(b"S", b"A"), (b"T", b"B")]
    # again: what is loaded is skipped, replaced, or rejected
    assert counts(webmaus.load(corpus, records.limit(2), read().where(F.col("file").isin(path("one"), path("two"))))) == {"skipped": 2}
    aligned(tmp_path / "tg", "one", [(0.0, 0.5, "hallo"), (0.5, 0.9, "weer")])
    webmaus.load(corpus, records.limit(1), read().where(F.col("file") == path("one")), "replace")
    assert {r["filename"]: r["label"] for r in corpus.tables["phrases"].collect()} == {path("one"): "hallo weer", path("two"): "hallo daar"}
    assert corpus.tables["words"].count() == 4 and corpus.tables["phones"].count() == 8
    with pytest.raises(writes.Rejected):
        webmaus.load(corpus, records.limit(1), read().where(F.col("file") == path("one")), "append")
    with pytest.raises(ValueError, match="existing is one of"):
        webmaus.load(corpus, records, read(), "whatever")
    names, twice = webmaus.named(corpus.tables["audios"], "filename")
    assert [tuple(r) for r in twice.collect()] == [("/b.wav", 2)] and {r["name"]: bytes(r["identifier"]) for r in names.collect()}["/b.wav"] == b"B"


def test_utterance_records(spark):
    intervals = spark.createDataFrame(
        [("f1", "N1", 0, 0, 0.0, 1.2345, "ja hallo*v daar."), ("f1", "N1", 0, 1, 1.2345, 2.0, "xxx ggg."), ("f1", "N1", 0, 2, 2.0, 3.0, " "), ("f1", "N2", 1, 0, 0.5, 0.75, "d'r zo-iets, één?"), ("f1", "BACKGROUND", 2, 0, 0.0, 3.0, "muziek"), ("f2", "N3", 0, 0, 0.0, 1.0, "stil"), ("f3", "!error", -1, -1, 0.0, 0.0, "bad")],
        textgrid.INTERVALS,
    )
    audios = spark.createDataFrame([("f1", "/data/comp-a/nl/f1.x.wav", "nl")], "file string, audio_filename string, language string")
    got = sorted((r.asDict() for r in utterances.utterances(intervals, audios, "/out/").collect()), key=lambda r: r["tier_name"])
    assert [(r["tier_name"], r["text"], r["raw_text"]) for r in got] == [("N1", "ja hallo daar", "ja hallo*v daar."), ("N2", "d'r zo-iets één", "d'r zo-iets, één?")]
    assert got[0]["output_filename"] == "/out/N1/f1.x_s-0-e-1234-ms.TextGrid" and got[1]["output_filename"] == "/out/N2/f1.x_s-500-e-750-ms.TextGrid"
    assert got[0]["speaker_ids_audio"] == ["N1", "N2"] and got[0]["component"] == "a" and got[0]["output_directory"] == "/out/N1"


def test_json_sources_are_made_once_and_may_grow(spark, tmp_path):
    path, made = f"file://{tmp_path}/infos", []

    def make():
        made.append(1)
        return spark.createDataFrame([("a", len(made))], "name string, age int")

    load = lambda schema="name string, age int", **kind: sorted(tuple(r) for r in utterances.json_source(spark, path, schema, make, **kind).collect())
    assert load() == load() == [("a", 1)] and len(made) == 1
    assert load(overwrite=True) == [("a", 2)] and not list(tmp_path.glob("infos.new"))
    (tmp_path / "infos" / "later.json").write_text(json.dumps({"name": "b", "age": "old", "region": "x"}) + "\n" + json.dumps({"name": "c"}))
    assert load() == sorted([("a", 2, None), ("b", None, "x"), ("c", None, None)])
    assert utterances.json_source(spark, path, "name string, sex string").columns == ["name", "sex", "age", "region"]
    with pytest.raises(FileNotFoundError):
        utterances.json_source(spark, f"{path}-none", "name string")
    with pytest.raises(ZeroDivisionError):
        utterances.json_source(spark, path, "name string", lambda: 1 // 0, overwrite=True)
    assert len(load()) == 3
    empty = utterances.json_source(spark, f"{path}-empty", "name string", lambda: spark.createDataFrame([], "name string"))
    assert empty.columns == ["name"] and empty.count() == 0


def test_streams_write_the_files_of_their_audios(spark, tmp_path):
    from tests.test_operators import SPEECH, spoken
    from tierspan.streaming import imports

    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    for audio in "abc":
        corpus.append({"phrases": spoken(spark, [audio])})

    def run(name, rows, policy):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        query = imports.corpus_stream(spark.readStream.schema(SPEECH).parquet(f"{tmp_path}/{name}"), f"{tmp_path}/{name}-seen", corpus, "phrases", ["audio_id", "start"], policy)
        query.awaitTermination()
        corpus.refresh()
        return sorted((r["filename"], r["start"], r["label"]) for r in corpus.tables["phrases"].collect())

    before = {f.path for f in corpus.files["phrases"]}
    got = run("one", spoken(spark, ["b"], "new", 1), "upsert")
    assert ("b", 0, "new") in got and ("b", 100, "x") in got and len(got) == 6
    assert len(before - {f.path for f in corpus.files["phrases"]}) < len(before)
    assert run("one", spoken(spark, ["c"], "new", 1), "upsert").count(("c", 0, "new")) == 1
    # rows that are stored aren't appended again
    assert len(run("two", spoken(spark, ["a", "d"]), "append")) == 8
    with pytest.raises(Exception, match="no row to replace"):
        run("three", spoken(spark, ["z"]), "replace")
    with pytest.raises(ValueError, match="unknown policy"):
        imports.corpus_stream(spark.readStream.schema(SPEECH).parquet(f"{tmp_path}/one"), f"{tmp_path}/x", corpus, "phrases", ["audio_id"], "other")
