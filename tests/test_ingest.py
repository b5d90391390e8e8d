import pytest
from pyspark.sql import functions as F

from tests.test_operators import grid_text
from tierspan.operators import resume, resyllabify
from tierspan.sources import awd, synthetic, textgrid

MAP = {"p": "p", "t": "t", "k": "k", "A": "ɑ", "a": "aː", "E+": "ɛi", "O~": "ɒ̃ː"}
SCHEMA = "file string, tier string, tier_idx int, idx int, xmin double, xmax double, mark string"


def grid(spark, **tiers):
    rows = [("r", t, k, i, float(a), float(b), m) for k, (t, v) in enumerate(tiers.items()) for i, (m, a, b) in enumerate(v)]
    return spark.createDataFrame(rows, SCHEMA)


def test_pairs_of_annotations(spark):
    ort = grid(spark, N1=[("pak", 0, 0.7), ("ta", 0.7, 1.2)])
    rows = grid(spark, N1=[("", 0, 0.1), ("pak", 0.1, 0.6), ("ta", 0.6, 0.9)], N1_FON=[("", 0, 0.1), ("pAk", 0.1, 0.6), ("ta", 0.6, 0.9)], N1_SEG=[("p", 0.1, 0.2), ("A", 0.2, 0.5), ("k", 0.5, 0.6), ("t", 0.6, 0.72), ("a", 0.72, 0.9)])
    got = awd.build(ort, rows, MAP)
    assert sorted((r["start"], r["end"], r["label"]) for r in got["phrases"].collect()) == [(100, 600, "pak"), (600, 900, "ta")]
    assert sorted(r["ipa"] for r in got["words"].collect()) == ["pɑk", "taː"]
    assert [(r["label"], r["position_code"]) for r in got["phones"].orderBy("start").collect()] == [("p", 1), ("ɑ", 2), ("k", 3), ("t", 1), ("aː", 2)]
    assert got["issues"].count() == 0
    assert awd.speaker_tier_differences(ort, rows).count() == 0


def test_special_marks(spark):
    ort = grid(spark, N1=[("special", 0, 1)])
    rows = grid(spark, N1=[("!ggg.", 0, 0.3), ("_", 0.3, 0.4), ("a", 0.4, 0.8)], N1_FON=[("!#", 0, 0.3), ("_", 0.3, 0.4), ("a", 0.4, 0.8)], N1_SEG=[("!#", 0, 0.3), ("t", 0.3, 0.45), ("[]", 0.45, 0.55), ("#", 0.55, 0.65), ("a", 0.65, 0.8)])
    got = awd.build(ort, rows, MAP)
    kinds = {r["kind"]: r["count"] for r in got["issues"].groupBy("kind").count().collect()}
    assert kinds["skipped_marker"] == 2 and kinds["fallback_syllable"] == 1 and kinds["unreliable"] == 1
    assert {(r["label"], r["position_code"]) for r in got["phones"].collect()} == {("t", 9), ("aː", 2)}


def test_sources_are_paired(spark):
    t = lambda *stems: spark.createDataFrame([(s, f"/{s}") for s in stems], "stem string, path string")
    rows = {r["stem"]: r["complete"] for r in awd.pair_sources(ort=t("a", "b"), awd=t("a"), audio=t("a", "c")).collect()}
    assert rows == {"a": True, "b": False, "c": False}


def test_resyllabification(spark):
    def word(w, labels, cuts):
        return [(w, f"{w}s{c}", "spk", f"{w}p{k}", 100 * k, 100 * k + 100, s) for k, (s, c) in enumerate(zip(labels.split(), cuts, strict=True))]

    rows = word("w", "ɑ p r ɪ l", "00111") + word("m", "ɑ p ɪ l", "0122") + word("u", "ɑ XYZ", "00") + word("k", "ɑ p r ɪ l", "01111")
    phones = spark.createDataFrame(rows, "word_id string, parent_id string, speaker_id string, identifier string, start long, end long, label string")
    found = resyllabify.outcomes(phones)
    got = {r["word_id"]: (r["ok"], r["applied"], r["count_mismatch"]) for r in found.collect()}
    assert got == {"w": (False, True, False), "m": (False, False, True), "u": (False, False, False), "k": (True, False, False)}
    syllables = spark.createDataFrame([("ws0", "w", 0, 200, "ɑ p", 1), ("ws1", "w", 200, 500, "r ɪ l", 0)], "identifier string, parent_id string, start long, end long, label string, stress_code int")
    new, moved = resyllabify.rewritten(found, syllables, phones)
    assert sorted((r["start"], r["end"], r["label"], r["stress_code"]) for r in new.collect()) == [(0, 100, "ɑ", 1), (100, 500, "p r ɪ l", 0)]
    assert moved.count() == 5 and moved.select("parent_id").distinct().count() == 2


def test_resumed_import(spark):
    sources = spark.createDataFrame([(f"a{k}",) for k in range(8)], "audio_id string")
    stored = spark.createDataFrame([(f"a{k}", "s", 0, 10, "x") for k in range(6)], "audio_id string, speaker_id string, start long, end long, label string")
    got = {r["audio_id"]: r["action"] for r in resume.plan(sources, stored, [F.col("audio_id")]).collect()}
    assert [got[f"a{k}"] for k in range(8)] == ["skip"] * 3 + ["audit"] * 3 + ["import"] * 2
    staged = stored.withColumn("label", F.when(F.col("audio_id") == "a4", "y").otherwise(F.col("label")))
    assert [r["audio_id"] for r in resume.differing(stored, staged).collect()] == ["a4"]


def test_synthetic_corpus(spark):
    made = synthetic.generate(spark, 3)
    assert made["phrases"].count() == 15 and made["words"].count() == 3 * sum(len(p.split()) for p in synthetic.PHRASES)
    assert made["words"].where("end <= start").count() == 0
    spans = made["words"].groupBy("parent_id").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    assert spans.join(made["phrases"], spans["parent_id"] == F.col("identifier")).where("s <> start OR e <> end").count() == 0


def test_textgrid_values():
    rows = list(textgrid.parse(grid_text([("A", [(0, "1e-05", "[]"), ("1e-05", 1.5, "see [12] there"), (1.5, "+2.0E0", '3 ""x"" 4 ')])])))
    assert [r[3:] for r in rows] == [(0.0, 1e-05, "[]"), (1e-05, 1.5, "see [12] there"), (1.5, 2.0, '3 "x" 4 ')]
    short = 'File type = "ooTextFile"\n"TextGrid"\n0\n2\n<exists>\n2\n"TextTier"\n"P"\n0\n2\n1\n0.5\n"x"\n"IntervalTier"\n"A"\n0\n2\n1\n0\n2\n"12"\n'
    assert list(textgrid.parse(short)) == [("A", 1, 0, 0.0, 2.0, "12")]
    for bad in (short + '"more"', short.replace('"A"\n0\n2\n1', '"A"\n0\n2\n2'), short.replace('"12"', "12"), short.replace("TextTier", "Other"), short.replace("<exists>\n2", "<exists>\n2.5"), '"ooTextFile" "TextGrid"'):
        with pytest.raises(ValueError):
            list(textgrid.parse(bad))


def test_pairs_from_files(spark, tmp_path):
    words = [(0, 0.4, "pak"), (0.4, 1, "")]
    triple = lambda n, fon=words: [(n, words), (f"{n}_FON", fon), (f"{n}_SEG", [(0, 0.1, "p"), (0.1, 0.3, "A"), (0.3, 0.4, "k"), (0.4, 1, "[]")])]
    moved = [(0, 0.4 + 5e-7, "pAk"), (0.4 + 5e-7, 1, "")]
    cases = {
        "good": ([("N1", [(0, 1, "pak")]), ("N2", [(0, 1, " ")]), ("COMMENT", [(0, 1, "x")])], triple("N1", moved)),
        "times": ([("N1", [(0, 1, "pak")])], triple("N1", [(0, 0.41, "pAk"), (0.41, 1, "")])),
        "sizes": ([("N1", [(0, 1, "pak")])], triple("N1", [(0, 0.4, "pAk")])),
        "order": ([("N1", [(0, 1, "pak")])], [triple("N1")[k] for k in (0, 2, 1)]),
        "twice": ([("N1", [(0, 1, "pak")])], triple("N1") * 2),
        "speaker": ([("N1", [(0, 1, "pak")]), ("N2", [(0, 1, "ta")])], triple("N1")),
    }
    for side, which in (("ort", 0), ("awd", 1)):
        (tmp_path / side).mkdir()
        for name, tiers in cases.items():
            (tmp_path / side / f"{name}.TextGrid").write_text(grid_text(tiers[which]))
        (tmp_path / side / "damaged.TextGrid").write_text("x")
    read = lambda side: textgrid.read_textgrids(spark, f"file://{tmp_path}/{side}").withColumn("file", F.regexp_extract("file", r"([^/]+)\.TextGrid$", 1)).cache()
    levels, errors = awd.read_pairs(read("ort"), read("awd"), MAP)
    got = {}
    for r in errors.collect():
        got.setdefault(r["file"], set()).add(r["error"])
    assert got == {"times": {"times of words and transcription"}, "sizes": {"size of words and transcription"}, "order": {"tier triple"}, "twice": {"duplicate tier"}, "speaker": {"speaker only in ort"}, "damaged": {"damaged file"}}
    assert {r["file"] for r in levels["words"].collect()} == {"good"} and levels["phones"].count() == 3
    assert [r["kind"] for r in levels["issues"].collect()] == ["skipped_marker"]


def test_files_become_a_corpus(spark, tmp_path):
    from tierspan.plans.corpus import Corpus
    from tierspan.sources import recordings

    words = [(0, 0.4, "pak"), (0.4, 1, ""), (1, 1.4, "pak")]
    segments = [(0, 0.1, "p"), (0.1, 0.3, "A"), (0.3, 0.4, "k"), (0.4, 1, "[]"), (1, 1.1, "p"), (1.1, 1.3, "A"), (1.3, 1.4, "k")]
    fon = [(0, 0.4, "pAk"), (0.4, 1, ""), (1, 1.4, "pAk")]
    triple = [("N1", words), ("N1_FON", fon), ("N1_SEG", segments)]

    def read(side, name, tiers):
        (tmp_path / side).mkdir(exist_ok=True)
        (tmp_path / side / f"{name}.TextGrid").write_text(grid_text(tiers))

    def run():
        rows = [textgrid.read_textgrids(spark, f"file://{tmp_path}/{side}").withColumn("file", F.regexp_extract("file", r"([^/]+)\.TextGrid$", 1)) for side in ("ort", "awd")]
        return {r["kind"]: r["n"] for r in recordings.import_pairs(corpus, *rows, MAP, speakers, "test").collect()}

    speakers = spark.createDataFrame([("N1", 30, 1), ("N7", 40, 2)], "name string, age int, gender_code int")
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    # a recording that is stored already isn't read again
    corpus.commit({"audios": spark.createDataFrame([(b"old", "old")], "identifier binary, filename string").select(*[F.col(f.name) if f.name in ("identifier", "filename") else F.lit(None).cast(f.dataType).alias(f.name) for f in corpus.schemas["audios"].fields])})
    read("ort", "old", [("N1", [(0, 2, "pak pak")])])
    read("awd", "old", triple)
    # the last word lies outside the only phrase
    read("ort", "a", [("N1", [(0, 1, "pak")])])
    read("awd", "a", triple)
    read("ort", "bad", [("N2", [(0, 1, "pak")])])
    read("awd", "bad", triple)
    assert run() == {"skipped_marker": 1, "word_outside_phrase": 1, "speaker only in ort": 1, "speaker only in awd": 1}
    count = lambda: {r["object_type"]: r["n"] for r in corpus.counts().collect()}
    assert count() == {"audios": 2, "speakers": 1, "phrases": 1, "words": 1, "syllables": 1, "phones": 3, "speaker_audio": 1}
    phone = corpus.query("phones").filter(position="nucleus", phrase__label="pak", speaker__name="N1", syllable__word__ipa__len_gt=0).get()
    assert phone["phrase_start"] == 0 and phone["parent_start"] == 0 and phone["start"] == 100


def test_streamed_import(spark, tmp_path):
    from tierspan.streaming import imports

    schema, state = "k int, v string", {}
    state["rows"] = spark.createDataFrame([(1, "a"), (2, "b")], schema)

    def commit(df):
        state["rows"] = spark.createDataFrame(df.collect(), schema)

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def run(name, policy):
        imports.import_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}"), f"{tmp_path}/{name}-seen", lambda: state["rows"], commit, ["k"], policy).awaitTermination()
        return sorted(map(tuple, state["rows"].collect()))

    put("up", [(2, "B"), (3, "C")])
    assert run("up", "upsert") == run("up", "upsert") == [(1, "a"), (2, "B"), (3, "C")]
    put("more", [(3, "C"), (4, "d"), (4, "d")])
    assert run("more", "append") == [(1, "a"), (2, "B"), (3, "C"), (4, "d"), (4, "d")]
    put("odd", [(7, "x"), (7, "y")])
    with pytest.raises(Exception, match="keys occur twice"):
        run("odd", "upsert")
    with pytest.raises(ValueError):
        imports.import_stream(None, "", None, None, ["k"], "none")
    rows = spark.createDataFrame([(1, "2024", "a"), (1, "2025", "b"), (1, "2025", "c")], "k int, at string, v string")
    assert [r["v"] for r in resume.latest(rows, "k", "at").collect()] == ["c"]
