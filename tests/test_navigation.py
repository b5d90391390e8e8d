import random

import pytest
from pyspark.sql import functions as F

from tierspan.operators import hierarchy, intervals, writes
from tierspan.plans.corpus import Corpus

SPAN = "audio_id string, speaker_id string, start long, end long, identifier long, parent_id long, label string"


def spans(spark, seed, n, longest, audios=("a",)):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        start = draw.randrange(5000)
        rows.append((draw.choice(audios), draw.choice("st"), start, start + draw.choice([0, 1, draw.randint(1, 40), draw.randint(1, longest)]), seed * 1000 + i, draw.randrange(50), "x"))
    rows += [(None, "s", 1, 9, seed * 1000 + n, 0, "x"), ("a", "s", None, 9, seed * 1000 + n + 1, None, "x")]
    return spark.createDataFrame(rows, SPAN), [r for r in rows if r[0] is not None and r[2] is not None]


@pytest.mark.parametrize("audios", [("a",), ("a", "b", "c")])
def test_points_meet_the_spans_they_start_in(spark, audios):
    outer, p = spans(spark, 1, 120, 5000, audios)
    inner, r = spans(spark, 2, 150, 50, audios)
    got = sorted((x["p_identifier"], x["identifier"]) for x in hierarchy.in_window(outer, inner).collect())
    assert got == sorted((a[4], b[4]) for a in p for b in r if a[0] == b[0] and a[2] <= b[2] < a[3])
    others = sorted((x["p_identifier"], x["identifier"]) for x in hierarchy.overlapping(outer, inner).collect())
    assert others == sorted((a[4], b[4]) for a in p for b in r if a[0] == b[0] and a[2] <= b[2] < a[3] and b[5] != a[4])
    plan = hierarchy.in_window(outer, inner)._jdf.queryExecution().optimizedPlan().toString()
    assert "_pc" in plan and "Cartesian" not in plan
    assert hierarchy.in_window(outer.limit(0), inner).count() == hierarchy.in_window(outer, inner.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_bucketed_overlaps_equal_the_sweep(spark, width):
    rows, p = spans(spark, 3, 100, 5000, ("a", "b"))
    others, r = spans(spark, 4, 60, 5000, ("a", "b"))
    want = sorted(a[4] for a in p if any(a[0] == b[0] and a[2] < b[3] and b[2] < a[3] for b in r))
    assert sorted(x["identifier"] for x in intervals.bucketed_overlaps(rows, others, width).collect()) == want
    both = sorted(a[4] for a in p if any(a[0] == b[0] and a[2] < b[3] and b[2] < a[3] and a[4] != b[4] for b in p))
    assert sorted(x["identifier"] for x in intervals.bucketed_overlaps(rows, rows, width).collect()) == both


LEVELS = {
    "phrases": [(1, None, 0, 1000)],
    "words": [(11, 1, 0, 400), (12, 1, 400, 1000), (13, 99, 0, 10)],
    "syllables": [(111, 11, 0, 200), (112, 11, 200, 400), (121, 12, 400, 1000)],
    "phones": [(1111, 111, 0, 100), (1112, 111, 100, 200), (1211, 121, 400, 1000), (1311, 131, 0, 10)],
}
FRAMES = {1: [[float(k)] for k in range(10)], 11: [[100.0 + k] for k in range(4)], 1112: [[7.0]], 121: []}


@pytest.fixture()
def levels(spark):
    out = {}
    for name, rows in LEVELS.items():
        phrase = {11: 1, 12: 1, 13: 99}
        word = {111: 11, 112: 11, 121: 12, 131: 13}
        up = lambda name, p: phrase.get(p) if name == "syllables" else phrase.get(word.get(p))
        out[name] = spark.createDataFrame([(i, p, s, e, up(name, p), i % 4) for i, p, s, e in rows], "identifier long, parent_id long, start long, end long, phrase_id long, position_code int")
    return out


def embed(spark, levels, name, **kind):
    above = {k: levels[k] for k in ("syllables", "words", "phrases")[("phones", "syllables", "words").index(name) :]}
    frames = spark.createDataFrame(list(FRAMES.items()), "identifier long, frames array<array<double>>")
    return {r["identifier"]: (r["depth"], r["source"], r["frames"]) for r in hierarchy.segment_embeddings(levels[name], above, frames, **kind).collect()}


def test_embeddings_of_segments_or_their_nearest_ancestors(spark, levels):
    got = embed(spark, levels, "phones", missing="null")
    assert got[1112] == (0, 1112, [[7.0]])
    assert got[1111] == (2, 11, [[100.0]])  # a quarter of the word
    assert got[1211] == (1, 121, [])
    assert got[1311] == (None, None, None)
    words = embed(spark, levels, "words", missing="null")
    assert words[12] == (1, 1, [[float(k)] for k in range(4, 10)]) and words[13] == (None, None, None)
    assert embed(spark, levels, "words", missing="null", fallback=False) == {11: (0, 11, FRAMES[11]), 12: (None, None, None), 13: (None, None, None)}
    with pytest.raises(Exception, match="no embedding for 13"):
        embed(spark, levels, "words")
    with pytest.raises(Exception, match="its ancestors may have one"):
        embed(spark, levels, "words", fallback=False)
    with pytest.raises(ValueError):
        embed(spark, levels, "words", missing="ignore")


def test_descendants_siblings_and_positions(spark, levels):
    ids = lambda df: sorted(r["identifier"] for r in df.collect())
    word = levels["words"].where("identifier = 11")
    assert ids(hierarchy.descendants(word, "words", levels, "syllables")) == [111, 112]
    assert ids(hierarchy.descendants(word, "words", levels, "phones")) == [1111, 1112]
    assert ids(hierarchy.descendants(levels["phrases"], "phrases", levels, "phones")) == [1111, 1112, 1211]
    assert ids(hierarchy.siblings_of(word, levels["words"])) == [12]
    assert ids(hierarchy.siblings_of(levels["words"].where("identifier IN (11, 12)"), levels["words"])) == []
    assert ids(hierarchy.by_position(levels["phones"], "coda")) == [1111, 1211, 1311]
    for bad in (lambda: hierarchy.descendants(word, "words", levels, "phrases"), lambda: hierarchy.by_position(levels["phones"], "rhyme")):
        with pytest.raises(ValueError):
            bad()


def test_graceful_inserts_and_speaker_links(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    added = spark.createDataFrame([(1, "b"), (2, "c"), (3, "d"), (3, "e")], "k int, v string")
    table, left = writes.insert_gracefully(old, added, ["k"])
    assert sorted(map(tuple, table.collect())) == [(1, "a"), (2, "c")] and sorted(map(tuple, left.collect())) == [(1, "b"), (3, "d"), (3, "e")]
    links = spark.createDataFrame([("s", "a")], "speaker_id string, audio_id string")
    more = writes.link_speakers(links, spark.createDataFrame([("a", "s"), ("a", "t"), ("a", "t")], "audio_id string, speaker_id string"))
    assert sorted(map(tuple, more.collect())) == [("s", "a"), ("t", "a")]
    assert [tuple(r) for r in writes.unlink_speakers(more, links).collect()] == [("t", "a")]


def trees(spark, phrases, words=()):
    base = "identifier string, audio_id string, speaker_id string, start long, end long"
    out = {"phrases": spark.createDataFrame(phrases, base), "words": spark.createDataFrame(list(words), f"{base}, parent_id string")}
    return out | {name: spark.createDataFrame([], f"{base}, parent_id string, phrase_id string") for name in ("syllables", "phones")}


def test_all_violations_come_at_once(spark):
    staged = trees(
        spark,
        [("p", "a", "s", 0, 10), ("q", "a", "s", 5, 20), ("r", "a", "t", 0, 10), ("r", "a", "t", 30, 40), ("u", "b", "s", 0, None), ("v", "b", "t", 7, 9), ("w", "b", "t", 7, 8)],
        [("x", "a", "s", 0, 5, "p"), ("x", "a", "s", 5, 9, "p"), ("y", "a", "t", 0, 5, "p"), ("z", "a", "s", 0, 5, None)],
    )
    found = {r["kind"]: r["n"] for r in writes.tree_violations(staged).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert found == {
        "phrases of one speaker overlap": 2,
        "ids of phrases occur twice": 2,
        "phrases without id, audio or times": 1,
        "phrases occur twice": 2,
        "ids of words occur twice": 2,
        "words and their phrase differ in speaker or audio": 1,
        "words without id, audio, times or parent_id": 1,
    }
    stored = trees(spark, [("p", "a", "other", 0, 10), ("k", "a", "s", 18, 25), ("l", "a", "s", 100, 200), ("m", "a", "s", 150, 160)])
    kinds = {r["kind"]: r["n"] for r in writes.tree_violations(trees(spark, [("p", "a", "s", 0, 10), ("n", "a", "s", 20, 30)]), stored).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    # k stays and is overlapped; that l and m overlap was there before
    assert kinds == {"phrases of one speaker overlap": 1, "audio and speaker can't change once stored": 1}
    with pytest.raises(writes.Rejected, match="overlap.*occur twice|occur twice.*overlap"):
        writes.validate_trees(staged)
    with pytest.raises(writes.Rejected, match="items of a batch"):
        writes.validate_trees(staged | {"phrases": staged["words"]})
    with pytest.raises(writes.Rejected, match="need phones"):
        writes.validate_trees({k: v for k, v in staged.items() if k != "phones"})


def test_targets_are_protected(spark, tmp_path):
    (tmp_path / "file").touch()
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "notes.txt").touch()
    Corpus.create(spark, f"{tmp_path}/new").append({"speaker_audio": spark.createDataFrame([(bytearray(b"s"), bytearray(b"a"))], "speaker_id binary, audio_id binary")})
    assert Corpus.create(spark, f"file://{tmp_path}/new", resume=True).tables["speaker_audio"].count() == 1
    for path, kind, said in (("new", {}, "isn't empty"), ("file", {}, "isn't a folder"), ("full", {"resume": True}, "other files"), ("old/../old", {"protected": (f"file://{tmp_path}/old",)}, "protected")):
        with pytest.raises(ValueError, match=said):
            Corpus.create(spark, f"{tmp_path}/{path}", **kind)


@pytest.mark.parametrize("order", [("-v", "w"), ("w", "-v"), ("-w",), ("o__name", "-v"), ()])
def test_places_follow_the_order_with_nulls_and_ties(spark, order, monkeypatch):
    from tierspan.plans import query

    draw = random.Random(7)
    rows = [(k, draw.choice([None, *range(6)]), draw.choice([None, "a", "b", "é", "Z"]), draw.choice([None, 1, 2, 9])) for k in range(300)]
    tables = {"t": spark.createDataFrame(rows, "k int, v int, w string, o_id int"), "o": spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, name string")}
    graph = {"t": query.Entity("k", ("k",), {"o": ("o", "o_id")}), "o": query.Entity("id", ("id",))}
    asked = query.Query(tables, graph, "t").filter(k__gte=10).order_by(*order)
    want = [r["k"] for r in asked.df().collect()]
    for ranges in (64, 3, 1):
        monkeypatch.setattr(query, "RANGES", ranges)
        got = asked.numbered("at")
        assert got.columns == ["k", "v", "w", "o_id", "at"]
        placed = {r["at"]: r["k"] for r in got.collect()}
        assert [placed[n] for n in range(1, 291)] == want
    assert query.Query(tables, graph, "t").filter(k__lt=0).numbered().count() == 0
