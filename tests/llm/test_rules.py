import itertools
import math
import random
import re
from collections import Counter

import xxhash

from tierspan.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force_and_junk_is_dropped(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choices(["the", "sea", "and", "a", "sky", "of", "blue", "wind"], k=rng.randint(20, 60))) for _ in range(60)]
    junk = [" ".join(rng.choices(["x%%%", "y$$$", "z&&&"], k=40)) for _ in range(10)]
    odd = ["", None, " \n\t ", "a b c d e " * 40, "one\n one\none\n\n\n", "x y\x0bz\x1c w", "é漢 #*$%&|<>", "a b c d e f a b c d e", "a a a a a a", " ".join(map(str, range(20000))) + " 0 1 2 3 4", "a\r\nb\r\na\r\n"]
    rows = [(k, t, "x", 1) for k, t in enumerate((good + junk + odd) * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, kept int")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] * 2 + [(65, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rules.filter_documents(docs, labels).collect()}
    assert len(got) == len(rows)
    for k, text, *_ in rows:
        want, r = brute(text), got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert all(got[k]["score"] > rules.MIN_SCORE for k in range(60)) and not any(got[k]["kept"] for k in range(60, 70))


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.filter_documents(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a b " * 9)], "doc_id long, text string")
    assert rules.filter_documents(some, labels).first()["score"] == 0


def grams(text):
    """Buckets of words and neighbouring pairs, by an independent xxHash64 with the seed of Spark's."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in itertools.pairwise(hashes)]
    return [h % rules.BUCKETS for h in hashes + pairs]


def test_scores_and_verdicts_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["é漢", "%%"]
    texts = [" ".join(rng.choices(words[: rng.choice([20, 120, 302])], k=rng.choice([0, 1, 9, 10, 60, 400]))) for _ in range(120)] + [None, "", " \n", "a b " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    trusted = [k for k in range(120) if k % 3 == 0]
    labels = spark.createDataFrame([(k, int(k in trusted), 0) for k in range(120)], "doc_id long, quality int, toxic int")
    raw, target = Counter(b for t in texts for b in grams(t)), Counter(b for k in trusted for b in grams(texts[k]))
    n_raw, n_target = (c.total() + rules.BUCKETS for c in (raw, target))
    got = {r["doc_id"]: r for r in rules.filter_documents(docs, labels).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        found = grams(text)
        score = sum(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in found) / max(1, len(found))
        assert math.isclose(got[k]["score"], score, abs_tol=1e-9), text
        n_words, *_, repeated = brute(text)
        failed = n_words < 10 or 100 * repeated > 20 * n_words
        assert got[k]["kept"] == (not failed and score >= rules.MIN_SCORE)
    assert {r["kept"] for r in got.values()} == {True, False}
