"""What keeps queries within their limits on large tables: no step deals out, sorts or makes anew what it needn't. Repeated ids."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tierspan import catalog
from tierspan.functions import phonology
from tierspan.operators import resyllabify, writes
from tierspan.plans import project

DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def plan(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_repositioning_is_no_single_plan(spark, plan):
    said = plan(__spark_entry__.queries()["t05_reposition"](spark, DATA))
    assert said.count("Exchange hashpartitioning") <= 6 and len(said) < 20000


def test_phrases_deal_out_phones_once_by_their_unit(spark, plan):
    assert plan(__spark_entry__.queries()["t03_phrases"](spark, DATA)).count("Exchange hashpartitioning") <= 6


def test_phrases_with_a_symbol_that_is_none_are_one_row(spark):
    phone = lambda k, word, label, by: (k, k * 10, k * 10 + 10, label, word, by, "a", "s")
    phones = spark.createDataFrame([phone(1, 1, "t", 1), phone(2, 1, "a", 1), phone(3, 2, "n", 1), phone(99, 3, "o", 1), phone(5, 4, "?", 2), phone(6, 4, "a", 2)], "identifier long, start long, end long, label string, word_id long, phrase_id long, audio_id string, speaker_id string")
    words = spark.createDataFrame([(1, "ta"), (2, "n"), (3, "o"), (4, "?a")], "identifier long, label string")
    rows = {(r["phrase_id"], r["word_id"]): r for r in resyllabify.syllabify_phones(phones, words, "phrase_id", 50).collect()}
    assert set(rows) == {(1, 1), (1, 2), (1, 3), (2, None)}
    assert [(s["label"], s["phone_ids"]) for s in rows[1, 1]["syllables"]] == [("t a n", [1, 2, 3])] and rows[1, 2]["syllables"] == []
    assert (rows[1, 1]["phrase_label"], rows[1, 1]["phrase_end"], rows[1, 2]["start"], rows[1, 3]["run"]) == ("ta n", 40, 40, 1)
    assert all(v is None for k, v in rows[2, None].asDict().items() if k != "phrase_id")


@pytest.mark.parametrize("name", ["h06_descendants_of", "s10_descendants", "v01_violations"])
def test_what_hangs_on_a_row_is_not_sorted(spark, plan, name):
    said = plan(__spark_entry__.queries()[name](spark, DATA))
    assert "SortMergeJoin" not in said and "ShuffledHashJoin" in said


def test_positions_are_made_once(spark, plan):
    assert "Window" not in plan(__spark_entry__.queries()["w03_assign"](spark, DATA))


def test_outcomes_deal_out_phones_once(spark, plan):
    assert plan(__spark_entry__.queries()["t04_outcomes"](spark, DATA)).count("Exchange hashpartitioning") <= 3


def test_repeated_ids_of_vectors_and_turns_equal_sql(spark, tmp_path):
    """A word of turn 0 and a later turn share an id from 10000 conversations on, and so do their vectors."""
    turns = [(2, 0, "user", "ab cd ef"), (20000, 0, "user", "gh ij"), (3, 0, "user", "kl"), (4, 0, "user", "m no"), (4, 0, "assistant", "pq rst")]
    spark.createDataFrame(turns[:4], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(k, [k * 0.5, 1.0, 2.0, 3.0, 4.0], 0) for k in (2, 3, 4, 20000, 40000)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["h22_frames"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["h22_frames"](spark, str(tmp_path)).collect()]
    assert len(want) > 8 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_words_in_pieces_equal_sql(spark, tmp_path):
    texts = ["", None, " \n a\n\nb  ", "x " * 100, "\n".join(f"w{k}é" for k in range(65)), "a\tb \U0001f600c\r d", " ".join("k" * (k % 7 + 1) for k in range(64))]
    spark.createDataFrame([(k % 2, k, "user", t) for k, t in enumerate(texts)], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    sql = __spark_entry__.oracle_sql()["h02_children"]
    want = con.execute(sql[: sql.rindex(" SELECT")] + ' SELECT identifier, "start", "end", label FROM words').fetchall()
    got = project.words(spark, str(tmp_path)).select("identifier", "start", "end", F.col("label")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_rows_before_a_phone_are_made_once(spark, plan):
    """A window function is made anew wherever it is written: the three rows before a vowel are three columns."""
    phones = spark.createDataFrame([(1, 0, 10, 1, "t")], "w long, start long, end long, identifier long, label string")
    said = plan(phonology.syllable_rows(phones, ["w"]))
    assert 0 < said.count("lag(") <= 3 and said.count("Window [") <= 3


def test_phones_of_texts_are_made_once_and_their_speakers_told_on_the_way(spark, monkeypatch):
    made, empty = [], []
    store, reject = catalog.materialise, resyllabify.require_empty
    monkeypatch.setattr(catalog, "materialise", lambda df, label: made.append(label) or store(df, label))
    monkeypatch.setattr(resyllabify, "require_empty", lambda df, what: empty.append(df.inputFiles()) or reject(df, what))
    assert __spark_entry__.queries()["t05_reposition"](spark, DATA).count() > 0
    assert made == ["phones"] and len(empty) == 1 and all("/applied-" in name for name in empty[0])


def test_resyllabifying_words_of_several_speakers_is_rejected(spark):
    phones = spark.createDataFrame([(k, k * 10, k * 10 + 10, label, k // 2, "a", speaker) for k, (label, speaker) in enumerate([("t", "s"), ("a", "s"), ("n", "s"), ("a", "z")])], "identifier long, start long, end long, label string, parent_id long, audio_id string, speaker_id string")
    syllables = spark.createDataFrame([(k, 7, k * 20, k * 20 + 20, "", "s") for k in (0, 1)], "identifier long, parent_id long, start long, end long, label string, speaker_id string")
    words = spark.createDataFrame([(7, "s")], "identifier long, speaker_id string")
    with pytest.raises(writes.Rejected, match="a word has several speakers"):
        resyllabify.resyllabify(words, syllables, phones)
