import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tierspan.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "mine", -1) for i, t in rows], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = counts(rows)
    out, form = [], {}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def check(spark, rows):
    got = spelling.group_variants(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def texts(seed, docs, letters="aberüÿ", words=60):
    draw = random.Random(seed)
    base = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 9))) for _ in range(words)]
    out = []
    for i in range(docs):
        said = []
        for _ in range(draw.randint(0, 60)):
            w = draw.choice(base)
            if draw.random() < 0.3:
                k = draw.randrange(len(w))
                w = draw.choice([w[:k] + w[k + 1 :], w[:k] + draw.choice(letters) + w[k:], w[:k] + draw.choice(letters) + w[k + 1 :]])
            said.append(w.upper() if draw.random() < 0.1 else w)
        out.append((i, draw.choice([" ", ", ", "1", "œ"]).join(said)))
    return out


def test_equals_brute_force(spark):
    for seed in range(3):
        check(spark, texts(seed, 120))


def test_repeated_letters_and_ties(spark):
    said = "aaaaa aaaaaa aaaaaaa abababa bababab ababab aaaab aabaa baaaa anananan nananana ananana"
    check(spark, [(i, said) for i in range(9)] + [(i, said + " aaaaa ababab") for i in range(9, 15)])


def test_odd_rows(spark):
    rows = texts(5, 40)
    rows += [(None, rows[3][1]), (4, rows[4][1]), (4, rows[4][1]), (50, None), (51, ""), (52, "  \n"), (53, "x" * 100_000 + " " + "x" * 99_999), (54, ("y" * 70 + " ") * 9 + ("y" * 69 + " ") * 4), (55, "×÷×÷× " * 7), (56, "hello world " * 30_000)]
    check(spark, rows)


def test_chains_of_forms(spark):
    check(spark, [(1, "wordaaaa " * 100 + "wordaaab " * 50 + "wordaabb " * 25 + "wordabbb " * 12 + "wordbbbb " * 6 + "sordbbbb " * 3)])


def test_empty_table(spark):
    check(spark, [])


def test_hot_bigrams_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 5)
    check(spark, texts(9, 150, letters="ab"))


def test_checksums_are_those_of_zlib():
    draw = random.Random(1)
    pieces = [bytes(draw.randrange(256) for _ in range(draw.choice([1, 3, 9, 64, 65, 200]))) for _ in range(300)]
    ends = np.cumsum([len(x) for x in pieces])
    before = np.array([draw.randrange(1 << 32) for _ in pieces], np.uint32)
    got = spelling.checksums(np.frombuffer(b"".join(pieces), np.uint8), ends - [len(x) for x in pieces], ends, before)
    assert got.tolist() == [zlib.crc32(x, int(b)) for x, b in zip(pieces, before)]


def test_prefixes_of_words_one_apart_meet():
    draw = random.Random(2)
    rank = {a + b: k for k, (a, b) in enumerate(draw.sample([(a, b) for a in "abc" for b in "abc"], 9))}
    for _ in range(3000):
        w = "".join(draw.choice("abc") for _ in range(draw.randint(5, 8)))
        k = draw.randrange(len(w))
        longer = w[:k] + draw.choice("abc") + w[k:]
        other = w[:k] + draw.choice("abc") + w[k + 1 :]
        mine = spelling.prefix(w, rank)
        assert {(g, i) for g, i, _ in mine} & {(g, i) for g, i, _ in spelling.prefix(other, rank)}
        reach = {(g, i + d) for g, i, nth in mine if nth < 3 for d in (0, 1)}
        assert reach & {(g, i) for g, i, _ in spelling.prefix(longer, rank)}
        assert bin((spelling.letter_mask(w) ^ spelling.letter_mask(longer)) & (1 << 64) - 1).count("1") <= 2


def test_chunks_of_one_batch_agree(monkeypatch):
    rows = texts(11, 60)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})

    def total():
        n = Counter()
        for x in spelling._count_batch(batch):
            n.update(dict(zip(x.column(0).to_pylist(), [0] * x.num_rows)))
            for w, c in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                n[w] += c
        return n

    whole = total()
    monkeypatch.setattr(spelling, "CHUNK", 100)
    assert total() == whole and whole
