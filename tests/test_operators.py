import hashlib
import io
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierspan.functions import columns, phonology
from tierspan.operators import audio, hierarchy, intervals, positions, writes
from tierspan.plans.corpus import Corpus, sample_rows
from tierspan.sources import textgrid

#: Digest of the vectors of all 74 symbols.
VECTORS = "0514ee22f174b2d594f43e4994731e61425303f5943739c56eb54f5b69699b57"
SPAN = "audio_id string, speaker_id string, identifier string, start long, end long"


def spans(spark, *rows):
    return spark.createDataFrame([("A", *r) for r in rows], SPAN)


def test_maximal_onsets():
    parts = lambda text: ["".join(text.split()[k] for k in g) for g in phonology.syllabify(text.split())]
    assert parts("ɑ p r ɪ l") == ["ɑ", "prɪl"]
    assert parts("a p i l") == ["a", "pil"]
    assert parts("h ɛ t ɛi") == ["hɛ", "tɛi"]
    assert parts("m ɑ n z eː") == ["mɑn", "zeː"]
    for bad in ("s t", "ɑ XYZ"):
        with pytest.raises(ValueError):
            phonology.syllabify(bad.split())


def test_syllables_equal_the_rule_on_random_words(spark):
    rng = random.Random(4)
    symbols = sorted(phonology.PHONES)
    likely = ["s", "t", "r", "k", "n", "l", "ŋ", "h", "ʃ", "p", "ɡ", "f", "j", "ɑ", "i", "ɛi"]
    words = [[rng.choice(likely if rng.random() < 0.85 else symbols) for _ in range(rng.randint(1, 12))] for _ in range(1500)] + [["ɑ", "XYZ"], ["s", "t"]]
    rows = [(w, k, k + 1, f"{w}/{k:02}", x) for w, word in enumerate(words) for k, x in enumerate(word)]
    got = {}
    for r in phonology.syllable_groups(spark.createDataFrame(rows, "word int, start int, end int, identifier string, label string"), "word").orderBy("word", "syllable").collect():
        got.setdefault(r["word"], []).append(None if r["syllable"] is None else (r["syllable"], r["label"], r["start"], r["end"], len(r["phone_ids"])))
    for w, word in enumerate(words):
        try:
            want = [(k, " ".join(word[i] for i in part), part[0], part[-1] + 1, len(part)) for k, part in enumerate(phonology.syllabify(word))]
        except ValueError:
            want = [None]
        assert got[w] == want, word


def test_phone_table(spark):
    rows = {r["symbol"]: r for r in phonology.phone_table(spark).collect()}
    assert len(rows) == 74 and all(len(r["vector"]) == 25 for r in rows.values())
    assert rows["p"]["features"]["voice"] == "-" and rows["p"]["features"]["labial"] == "+" and rows["ɛi"]["components"] == ["ɛ", "i"]
    told = ";".join(f"{s} {rows[s]['type']} {','.join(map(str, rows[s]['vector']))}" for s in sorted(rows))
    assert hashlib.sha256(told.encode()).hexdigest() == VECTORS
    assert rows["ɛi"]["vector"] == rows["ɛ"]["vector"] and rows["h"]["features"]["consonantal"] == "-"


def test_syllables_across_words(spark):
    phones = spark.createDataFrame([("P", "w1", "1", 0, 80, "h"), ("P", "w1", "2", 80, 180, "ɛ"), ("P", "w1", "3", 180, 260, "t"), ("P", "w2", "4", 260, 500, "ɛi")], "phrase_id string, word_id string, identifier string, start long, end long, label string")
    got = sorted(map(tuple, phonology.syllabify_phrase(phones, None, "phrase_id").select("label", "start", "end", "word_id").collect()))
    assert got == [("h ɛ", 0, 180, "w1"), ("t ɛi", 180, 500, "w2")]


def test_symbol_mapping(spark):
    text, odd = phonology.map_symbols(F.col("t"), {"p": "p", "t": "t", "k": "k", "A": "ɑ", "a": "aː", "E+": "ɛi", "O~": "ɒ̃ː"})
    rows = spark.createDataFrame([("E+_O~",), ("pAk",), ("J",), ("",)], "t string").select(text, odd).collect()
    assert [r[0] for r in rows] == ["ɛi_ɒ̃ː", "pɑk", "J", ""] and [r[1] for r in rows] == [[], [], ["J"], []]


def test_positions(spark):
    rows = [("s1", k, k + 1, f"p{k}", v) for k, v in enumerate([False, False, True, True, False])] + [("s2", 0, 1, "q0", True), ("s2", 1, 2, "q1", False), ("s2", 2, 3, "q2", True), ("s3", 0, 1, "r0", False), ("s4", 0, 1, "t0", None)]
    df = spark.createDataFrame(rows, "syl string, start long, end long, identifier string, is_vowel boolean")
    got = {r["identifier"]: (r["position_code"], r["valid"]) for r in positions.positions(df, "syl").collect()}
    assert [got[f"p{k}"][0] for k in range(5)] == [1, 1, 2, 2, 3]
    assert got["q0"] == (9, False) and got["r0"] == (1, True) and got["t0"] == (9, False)


def test_intervals(spark):
    p = spans(spark, ("x", "a", 0, 300), ("y", "b", 0, 100), ("x", "c", 300, 400), ("x", "d", 350, 360))
    assert {r["identifier"]: r["overlap_code"] for r in intervals.overlap_codes(p).collect()} == {"a": 1, "b": 1, "c": 0, "d": 0}
    assert [r["identifier"] for r in intervals.same_speaker_overlaps(p).collect()] == ["d"]
    assert sorted(r["identifier"] for r in intervals.bucketed_overlaps(p, p, 50).collect()) == sorted(r["identifier"] for r in intervals.overlaps(p, p).collect())
    words = spans(spark, ("", "w1", 100, 600), ("", "w2", 600, 900))
    points = spark.createDataFrame([("A", "a", 599), ("A", "b", 600), ("A", "c", 900), ("A", "d", 901), ("A", "e", 0)], "audio_id string, identifier string, at long")
    assert {r["identifier"]: r["span_id"] for r in intervals.as_of(words, points).collect()} == {"a": "w1", "b": "w2", "c": "w2", "d": None, "e": None}
    anchors = spans(spark, ("", "1", 0, 700), ("", "2", 700, 1200))
    assert {r["identifier"]: r["span_id"] for r in intervals.midpoint(anchors, words).collect()} == {"w1": "1", "w2": "2"}
    runs = lambda pause: intervals.pause_runs(spans(spark, ("s", "m", 0, 100), ("s", "n", 200, 300), ("s", "z", 1000, 1100)), pause).select("run").distinct().count()
    assert runs(500) == 2 and runs(700) == 2 and runs(2000) == 1
    frames = spark.createDataFrame([("r", 0, 10), ("r", 19, 30), ("r", 5, 6), ("r", 50, 60)], "rec string, first long, last long")
    assert sorted((r["first"], r["last"]) for r in intervals.islands(frames, ["rec"], 9).collect()) == [(0, 30), (50, 60)]


def test_rounding_and_labels(spark):
    row = spark.createDataFrame([(0.0005, 1.9999, "!ggg.", "_", "Zee,")], "a double, b double, c string, d string, e string")
    got = row.select(columns.ms_half_even(F.col("a")), columns.ms_truncated(F.col("b")), columns.clean_label(F.col("c")), columns.clean_label(F.col("d")), columns.clean_label(F.col("e"))).first()
    assert tuple(got) == (0, 1999, "!ggg", "_", "Zee")


def test_write_policies(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    show = lambda df: sorted(map(tuple, df.collect()))
    assert show(writes.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert show(writes.add_missing(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert len(show(writes.append(old, new, ["k"]))) == 4
    assert show(writes.insert(old, new, ["k"], overwrite=True)) == show(writes.upsert(old, new, ["k"]))
    for bad in (lambda: writes.insert(old, new, ["k"]), lambda: writes.replace(old, new, ["k"]), lambda: writes.upsert(old.union(old), new, ["k"])):
        with pytest.raises(writes.Rejected):
            bad()


def test_corpus_snapshots(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    assert corpus.query("words").count() == 0
    phrase = spark.createDataFrame([(bytearray(b"a"), 0, 100, bytearray(b"p"), bytearray(b"s"), 9, "x", "f")], "audio_id binary, start long, end long, identifier binary, speaker_id binary, overlap_code int, label string, filename string")
    before = corpus.tables["phrases"]
    corpus.commit({"phrases": phrase})
    assert corpus.query("phrases").filter(label="x").count() == 1 and before.count() == 0
    corpus.commit(writes.delete_phrases(corpus.tables, phrase))
    assert Corpus(spark, corpus.path).query("phrases").count() == 0
    assert {r["object_type"]: r["n"] for r in corpus.counts().collect()}.get("phrases", 0) == 0


def test_corpus_commits(spark, tmp_path, monkeypatch):
    row = lambda k: (bytearray(b"a"), 0, 100, bytearray(k), bytearray(b"s"), 9, "x", "f")
    schema = "audio_id binary, start long, end long, identifier binary, speaker_id binary, overlap_code int, label string, filename string"
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    corpus.commit({"phrases": spark.createDataFrame([row(b"p"), row(b"q")], schema)})
    corpus.commit({"speakers": corpus.tables["speakers"]})
    # unchanged tables are kept by reference
    assert len(list(tmp_path.glob("corpus/v-*/phrases"))) == 1 and corpus.query("phrases").count() == 2
    other = Corpus(spark, corpus.path)
    # a writer that dies between its steps leaves the corpus as it was
    for step in ("_fs", "_numbers"):
        with monkeypatch.context() as m:
            m.setattr(Corpus, step, lambda self, *_: (_ for _ in ()).throw(RuntimeError("crash")))
            with pytest.raises(RuntimeError):
                corpus.commit({"phrases": corpus.tables["phrases"].limit(0)})
        assert Corpus(spark, corpus.path).query("phrases").count() == 2
    (tmp_path / "corpus" / "_pointer-dead").touch()  # what a dead writer left aside stands in nobody's way
    corpus.commit({"phrases": writes.delete(corpus.tables["phrases"], spark.createDataFrame([(bytearray(b"p"),)], "identifier binary"), ["identifier"], missing_ok=False)})
    assert corpus.number == 3 and corpus.query("phrases").count() == 1
    with pytest.raises(ValueError, match="another writer"):
        other.commit({"phrases": other.tables["phrases"]})
    with pytest.raises(ValueError, match="no such tables"):
        corpus.commit({"letters": other.tables["phrases"]})
    with pytest.raises(writes.Rejected):
        writes.delete(corpus.tables["phrases"], spark.createDataFrame([(bytearray(b"z"),)], "identifier binary"), ["identifier"], missing_ok=False)
    corpus.truncate()
    assert corpus.query("phrases").count() == 0
    corpus.close()
    for action in (corpus.refresh, lambda: corpus.query("words"), lambda: corpus.commit({})):
        with pytest.raises(ValueError, match="closed"):
            action()


SPEECH = "audio_id binary, start long, end long, identifier binary, speaker_id binary, overlap_code int, label string, filename string"


def spoken(spark, audios, label="x", n=2):
    return spark.createDataFrame([(a.encode(), 100 * k, 100 * k + 90, f"{a}/{k}".encode(), b"s", 9, label, a) for a in audios for k in range(n)], SPEECH)


def test_a_rival_between_a_writers_steps_is_never_lost(spark, tmp_path, monkeypatch):
    mine, other = (Corpus(spark, f"file://{tmp_path}/corpus") for _ in range(2))
    taken = Corpus._take

    def late(self, *args):
        if self is mine:
            other.append({"phrases": spoken(spark, ["b"])})  # the other writer comes between this one's look and its step
        return taken(self, *args)

    monkeypatch.setattr(Corpus, "_take", late)
    with pytest.raises(ValueError, match="another writer"):
        mine.append({"phrases": spoken(spark, ["a"])})
    now = Corpus(spark, mine.path)
    assert {r["filename"] for r in now.tables["phrases"].collect()} == {"b"} and now.number == 1
    # what the rejected writer wrote is gone, and it may try again
    assert len(list(tmp_path.glob("corpus/v-*"))) == 1 and not list(tmp_path.glob("corpus/_pointer*"))
    monkeypatch.undo()
    mine.refresh().append({"phrases": spoken(spark, ["a"])})
    assert {r["filename"] for r in mine.tables["phrases"].collect()} == {"a", "b"}


def test_changes_write_the_touched_files_alone(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    files = lambda: {f.path for f in corpus.files["phrases"]}
    show = lambda: sorted((r["filename"], r["start"], r["label"]) for r in corpus.tables["phrases"].collect())
    for audio in ("a", "b", "c", "d" * 100):
        before = corpus.files.get("phrases") and files()
        corpus.append({"phrases": spoken(spark, [audio])})
        assert not before or before < files()
    assert len(files()) >= 4 and all(f.rows and f.low <= f.high for f in corpus.files["phrases"])
    before, rows = files(), show()
    corpus.merge("phrases", spoken(spark, ["b"], "new", 3), ["audio_id", "start"])
    gone = before - files()
    assert gone and all({r["filename"] for r in spark.read.parquet(f"{corpus.path}/{f}").collect()} == {"b"} for f in gone)
    assert show() == sorted([r for r in rows if r[0] != "b"] + [("b", 100 * k, "new") for k in range(3)])
    # an id that is longer than what a pointer holds of it
    before = files()
    corpus.merge("phrases", spoken(spark, ["d" * 99]), ["audio_id", "start"])
    corpus.merge("phrases", spoken(spark, ["d" * 100], "newer"), ["audio_id", "start"])
    assert [r for r in show() if r[0] == "d" * 100] == [("d" * 100, 0, "newer"), ("d" * 100, 100, "newer")] and len(show()) == 11
    # nothing touched: nothing but added files
    before = files()
    corpus.merge("phrases", spoken(spark, ["e"]), ["audio_id", "start"], writes.add_missing)
    assert before < files()
    corpus.rewrite(spoken(spark, ["a", "c"]).select("audio_id"), ["phrases"], lambda part: {"phrases": part["phrases"].where("filename NOT IN ('a', 'c')")})
    assert {r[0] for r in show()} == {"b", "d" * 99, "d" * 100, "e"}
    with pytest.raises(ValueError, match="audio_id"):
        corpus.merge("phrases", spoken(spark, ["a"]), ["start"])
    with pytest.raises(writes.Rejected):
        corpus.merge("phrases", spoken(spark, ["zz"]), ["audio_id", "start"], writes.replace)
    assert {r[0] for r in show()} == {"b", "d" * 99, "d" * 100, "e"}


def test_one_audio_is_split_over_files_and_old_pointers_are_read(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    rows = spark.range(4000).select(F.lit(b"one").alias("audio_id"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), F.col("id").cast("string").cast("binary").alias("identifier"), F.lit(b"s").alias("speaker_id"), F.lit(9).alias("overlap_code"), F.lit("x").alias("label"), F.lit("f").alias("filename"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus.append({"phrases": rows})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(corpus.files["phrases"]) > 1 and max(f.rows for f in corpus.files["phrases"]) < 4000
    folder = corpus.files["phrases"][0].path.rsplit("/", 1)[0]
    (tmp_path / "corpus" / "pointer-2").write_text('{"phrases": "%s"}' % folder)
    old = Corpus(spark, corpus.path)
    assert old.query("phrases").count() == 4000
    old.merge("phrases", rows.limit(5).withColumn("label", F.lit("y")), ["audio_id", "start"])
    assert old.query("phrases").count() == 4000 and old.query("phrases").filter(label="y").count() == 5


def test_samples_are_exact(spark):
    rows = spark.range(5000).withColumnRenamed("id", "identifier")
    for n in (0, 1, 7, 2500, 4999, 5000, 9000):
        got = [r["identifier"] for r in sample_rows(rows, n, 3).collect()]
        assert len(got) == len(set(got)) == min(n, 5000)
        assert set(got) == {r["identifier"] for r in sample_rows(rows.repartition(5), n, 3).collect()}


def test_rekeyed_rows_are_followed(spark):
    tables = {
        "phrases": spark.createDataFrame([("p", "s"), ("q", "s")], "identifier string, speaker_id string"),
        "words": spark.createDataFrame([("w", "p", "s"), ("v", "q", "s")], "identifier string, parent_id string, speaker_id string"),
        "phones": spark.createDataFrame([("f", "w", "p", "s")], "identifier string, parent_id string, phrase_id string, speaker_id string"),
        "speakers": spark.createDataFrame([("s",)], "identifier string"),
    }
    renamed = lambda *pairs: spark.createDataFrame(list(pairs), "old string, new string")
    show = lambda t: {n: sorted(map(tuple, df.collect())) for n, df in t.items()}
    assert show(writes.rekey(tables, "phrases", renamed(("p", "r")))) == {"phrases": [("q", "s"), ("r", "s")], "words": [("v", "q", "s"), ("w", "r", "s")], "phones": [("f", "w", "r", "s")]}
    assert show(writes.rekey(tables, "phrases", renamed(("p", "q"), ("q", "p"))))["phones"] == [("f", "w", "q", "s")]
    assert all(r[-1] == "t" for n, rows in show(writes.rekey(tables, "speakers", renamed(("s", "t")))).items() for r in rows)
    for bad in ([("x", "y")], [("p", "q")], [("p", "r"), ("q", "r")], [("p", "r"), ("p", "u")]):
        with pytest.raises(writes.Rejected):
            writes.rekey(tables, "phrases", renamed(*bad))


def test_interval_joins_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for k in range(260):
        start = rng.randint(0, 400)
        rows.append((rng.choice("AB"), rng.choice(["x", "y", None]), f"i{k:03}", start, start + rng.choice([0, 0, 1, 3, 20, 300])))
    half = rows[:130]
    df, some = spark.createDataFrame(rows, SPAN), spark.createDataFrame(half, SPAN)
    meets = lambda r, o: r[0] == o[0] and r[2] != o[2] and r[3] < o[4] and o[3] < r[4]
    for left, right, a, b in ((df, df, rows, rows), (df, some, rows, half), (some, df, half, rows)):
        assert sorted(r["identifier"] for r in intervals.overlaps(left, right).collect()) == [r[2] for r in a if any(meets(r, o) for o in b)]
        assert sorted(r["identifier"] for r in intervals.overlaps(left, right, other_speaker=True).collect()) == [r[2] for r in a if any(meets(r, o) and r[1] != o[1] for o in b)]
    codes = {r["identifier"]: r["overlap_code"] for r in intervals.overlap_codes(some, df).collect()}
    assert codes == {r[2]: int(any(meets(r, o) and r[1] != o[1] for o in half)) for r in rows}
    holds = {r[2]: max(((o[3], o[2]) for o in half if o[0] == r[0] and o[3] <= r[3] and r[4] <= o[4]), default=None) for r in rows}
    assert {r["identifier"]: r["parent_id"] for r in intervals.contained(some, df).collect()} == {k: v[1] for k, v in holds.items() if v}
    mids = {r[2]: min(((o[3], o[2]) for o in half if o[0] == r[0] and o[3] <= (r[3] + r[4]) / 2 <= o[4]), default=None) for r in rows}
    assert {r["identifier"]: r["span_id"] for r in intervals.midpoint(some, df).collect()} == {k: v[1] for k, v in mids.items() if v}


def grid_text(tiers):
    parts = ['File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = 2\ntiers? <exists>\nsize = %d\nitem []:' % len(tiers)]
    for k, (name, rows) in enumerate(tiers):
        parts.append(f'item [{k + 1}]:\nclass = "IntervalTier"\nname = "{name}"\nxmin = 0\nxmax = 2\nintervals: size = {len(rows)}')
        parts += [f'intervals [{i + 1}]:\nxmin = {a}\nxmax = {b}\ntext = "{t}"' for i, (a, b, t) in enumerate(rows)]
    return "\n".join(parts)


def test_textgrid_to_levels(spark, tmp_path):
    tiers = [("ORT-MAU", [(0, 0.5, "hello"), (0.5, 1, "world"), (1, 1.2, "")]), ("KAN-MAU", [(0, 0.5, "h e"), (0.5, 1, "w d"), (1, 1.2, "")]), ("MAS", [(0, 0.5, "hel"), (0.5, 1, "wor"), (1, 1.2, "<p:>")]), ("MAU", [(0, 0.25, "h"), (0.25, 0.5, "e"), (0.5, 0.75, "w"), (0.75, 1, "d"), (1, 1.1, "x"), (1.1, 1.2, "(...)")])]
    (tmp_path / "a.TextGrid").write_text(grid_text(tiers))
    (tmp_path / "bad.textgrid").write_text("no grid")
    rows = textgrid.read_textgrids(spark, f"file://{tmp_path}").cache()
    assert rows.where("tier = '!error'").count() == 1
    good = rows.where("tier <> '!error'")
    levels = textgrid.aligned_levels(good)
    assert {k: v.count() for k, v in levels.items()} == {"phrases": 1, "words": 2, "syllables": 2, "phones": 5}
    phones = {r["label"]: r for r in levels["phones"].collect()}
    assert phones["x"]["parent_id"] is None and phones["x"]["phrase_id"] is not None and phones["h"]["parent_id"].endswith("s/0")
    assert levels["phrases"].first()["label"] == "hello world" and {r["ipa"] for r in levels["words"].collect()} == {"h e", "w d"}
    assert textgrid.zip_tiers(good, "ORT-MAU", "KAN-MAU").where("NOT aligned").count() == 0
    assert [r["tier"] for r in textgrid.missing_tiers(good, ["MAU", "FON"]).collect()] == ["FON"]


def test_mfcc(spark):
    t = np.arange(16000) / 16000
    samples = (0.4 * np.sin(2 * np.pi * (180 * t + 300 * t * t)) * 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(16000)
        f.writeframes(samples.tobytes())
    audios = spark.createDataFrame([("A", bytearray(out.getvalue()))], "audio_id string, content binary")
    frames = audio.mfcc_frames(audios).cache()
    assert frames.count() == 98 and len(frames.first()["mfcc"]) == 39
    segments = spark.createDataFrame([("x", "A", 100, 200, 1000, 16000), ("y", "A", 0, 5, 1000, 16000), ("z", "A", 986, 1000, 1000, 16000), ("u", "A", 975, 985, 1000, 16000)], "identifier string, audio_id string, start long, end long, duration long, sample_rate long")
    count = lambda even: {r["identifier"]: r["count"] for r in audio.segment_mfcc(segments, frames, even_only=even).groupBy("identifier").count().collect()}
    assert count(False)["x"] == 12 and count(False)["y"] == 1
    assert count(True) == {"x": 6, "y": 1, "u": 1}
    assert audio.invalid_spans(segments).count() == 0


def test_frame_slices(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "f array<double>")
    cut = lambda a, b: row.select(hierarchy.frame_slice(F.col("f"), F.lit(a), F.lit(b), F.lit(0), F.lit(100))).first()[0]
    assert cut(25, 50) == [2.0] and cut(0, 100) == [1.0, 2.0, 3.0, 4.0] and cut(99, 100) == [4.0]


def test_phrases_from_phones(spark):
    from tierspan.operators import resyllabify

    cases = {
        "het ei": "h 0 80 het, ɛ 80 180 het, t 180 260 het, ɛi 260 500 ei",
        "reduced": "t 0 120 het, ɛi 120 500 ei",
        "man zee": "m 0 100 man, ɑ 100 200 man, n 200 300 man, z 1000 1100 zee, eː 1100 1300 zee",
        "no vowel": "s 0 100 st, t 100 200 st",
        "one bad run": "m 0 100 man, ɑ 100 200 man, s 1000 1100 st, t 1100 1200 st",
        "unknown": "ɑ 0 100 a, XYZ 100 200 a",
    }
    rows = [(u, "a", "s", f"{u}/{w}", f"{u}{k}", int(a), int(b), x) for u, text in cases.items() for k, (x, a, b, w) in enumerate(p.split() for p in text.split(", "))]
    schema = "unit string, audio_id string, speaker_id string, word_id string, identifier string, start long, end long, label string"
    phones = spark.createDataFrame(rows, schema)
    words = phones.select(F.col("word_id").alias("identifier"), F.split_part("word_id", F.lit("/"), F.lit(2)).alias("label")).distinct()

    def made(max_pause):
        got = {}
        for r in resyllabify.syllabify_phones(phones, words, "unit", max_pause).orderBy("unit", "phrase_start", "start", "end").collect():
            row = None if r["run"] is None else (r["phrase_start"], r["phrase_end"], r["phrase_label"], r["word_label"], r["start"], r["end"], [s["label"] for s in r["syllables"]])
            got.setdefault(r["unit"], []).append(row)
        return got

    got = made(500)
    assert got["het ei"] == [(0, 500, "het ei", "het", 0, 180, ["h ɛ"]), (0, 500, "het ei", "ei", 180, 500, ["t ɛi"])]
    assert got["reduced"] == [(0, 500, "het ei", "het", 0, 0, []), (0, 500, "het ei", "ei", 0, 500, ["t ɛi"])]
    assert got["man zee"] == [(0, 300, "man", "man", 0, 300, ["m ɑ n"]), (1000, 1300, "zee", "zee", 1000, 1300, ["z eː"])]
    assert got["no vowel"] == got["one bad run"] == got["unknown"] == [None]
    assert [r[:4] for r in made(2000)["man zee"]] == [(0, 1300, "man zee", "man"), (0, 1300, "man zee", "zee")]
    assert resyllabify.syllabify_phones(phones.limit(0), words, "unit").count() == 0
    for column in ("speaker_id", "audio_id"):
        with pytest.raises(ValueError):
            resyllabify.syllabify_phones(phones.withColumn(column, F.col("identifier")), words, "unit")
