import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tierspan.llm import language_id
from tierspan.llm.language_id import SMOOTHING, WINDOW, Vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, lang_pred string, score double"
PIECES = ["▁", "▁th", "▁the", "the", "th", "he", "e", "t", "h", "a", "in", "n", "ng", "i", "▁in", "der", "d", "er", "r", "é", "eé"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "web", "mine", 9.0) for r in rows], SCHEMA)


def brute_words(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            run += c.lower() if len(c.lower()) == 1 else c
        else:
            out += [run[i : i + WINDOW] for i in range(0, len(run), WINDOW)]
            run = ""
    return out


def segmentations(word):
    """All ways to cut a word with its start mark into pieces, letter by letter where there is none."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in PIECES or k == 1:
            for rest in segmentations(word[k:]):
                yield [word[:k], *rest]


def brute_model(rows, rounds):
    learned = [(t, x) for i, t, x in rows if zlib.crc32(str("" if i is None else i).encode()) % 3 != 1 and t is not None and x is not None]
    langs = sorted({x for _, x in learned})
    chance = {x: defaultdict(lambda: 1 / len(PIECES)) for x in langs}
    for _ in range(rounds):
        counts = {x: defaultdict(float) for x in langs}
        for text, lang in learned:
            for word in brute_words(text):
                ways = [(way, math.prod(chance[lang][p] for p in way)) for way in segmentations("▁" + word)]
                for way, p in ways:
                    for piece in way:
                        counts[lang][piece] += p / sum(q for _, q in ways)
        for x in langs:
            total = sum(counts[x][p] for p in PIECES)
            new = defaultdict(lambda: SMOOTHING / len(PIECES))
            new |= {p: (1 - SMOOTHING) * counts[x][p] / total + SMOOTHING / len(PIECES) if total else SMOOTHING / len(PIECES) for p in PIECES}
            chance[x] = new
    share = {x: sum(y == x for _, y in learned) / len(learned) for x in langs}
    return langs, share, chance


def brute(rows, rounds=2):
    langs, share, chance = brute_model(rows, rounds)
    out = []
    for i, text, _ in rows:
        words = brute_words(text)
        out_held = zlib.crc32(str("" if i is None else i).encode()) % 3 == 1
        if not words or not langs:
            out.append((i, out_held, "und", 0.0))
            continue
        logs = [math.log(share[x]) + sum(math.log(sum(math.prod(chance[x][p] for p in way) for way in segmentations("▁" + w))) for w in words) for x in langs]
        best = logs.index(max(logs))
        out.append((i, out_held, langs[best], 1 / sum(math.exp(v - logs[best]) for v in logs)))
    return out


def same(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[2], round(r[3], 6))) for x in (map(tuple, got), want))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    np.testing.assert_allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-4, atol=1e-9)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(language_id, "load_vocabulary", lambda path=None: Vocabulary.of(PIECES))


def texts(seed, n):
    draw = random.Random(seed)
    kinds = {"en": ["the", "thing", "in", "then", "he", "a", "hat"], "de": ["der", "den", "in", "er", "rede", "dein"], "fr": ["été", "en", "dire", "ni", "hé"]}
    out = []
    for i in range(n):
        lang = draw.choice([*kinds, "en"])
        out.append((i, draw.choice([" ", "\n", ", ", "́"]).join(draw.choice(kinds[lang]).title() for _ in range(draw.randint(1, 9))), lang if draw.random() < 0.9 else None))
    return out


def test_equals_all_segmentations_written_out(spark, small):
    rows = texts(1, 60)
    got = language_id.identify(frame(spark, rows))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    same(got.collect(), brute(rows))


def test_odd_rows(spark, small):
    rows = texts(2, 30)
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 !? €", "fr"), (None, "the thing", "en"), (5, *rows[5][1:]), (5, *rows[5][1:]), (103, "中文 the", None), (104, "xyz" * 4, "en")]
    same(language_id.identify(frame(spark, rows)).collect(), brute(rows))


def test_nothing_learned_or_nothing_at_all(spark, small):
    assert [tuple(r)[2:] for r in language_id.identify(frame(spark, [(1, "the", None), (2, None, "en")])).collect()] == [("und", 0.0)] * 2
    assert language_id.identify(frame(spark, [])).count() == 0


def test_long_texts_and_long_runs(spark, small):
    rows = [*texts(3, 30), (200, "the thing in " * 200_000, "en"), (201, "the" * 100_000, None), (202, "derer" * 3000, "de")]
    got = {r.doc_id: r for r in language_id.identify(frame(spark, rows)).collect()}
    assert got[200].lang_pred == "en" and got[201].lang_pred == "en" and got[202].lang_pred == "de"


def test_parts_of_a_text_change_nothing(small, monkeypatch):
    model = language_id.Model(Vocabulary.of(PIECES), ["a", "b"], np.log([0.5, 0.5]), np.random.default_rng(0).random((len(PIECES) + 1, 2)) / 30)
    said = [t.replace("\u0301", " ") for _, t, _ in texts(4, 40)] + [None, ""]
    counts, logs = language_id.likelihoods(said, model)
    monkeypatch.setattr(language_id, "CHUNK", 12)
    monkeypatch.setattr(language_id, "CELLS", 6)
    again, parts = language_id.likelihoods(said, model)
    assert counts.tolist() == again.tolist()
    np.testing.assert_allclose(logs, parts)


def test_held_out_accuracy_with_the_public_vocabulary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 300 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
