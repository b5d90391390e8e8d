import random

import numpy as np
import pyarrow as pa

from tierspan.llm import quality_fm


def corpus(n):
    rng = random.Random(2)
    words = ["the", "sea", "wind", "of", "and", "sky", "blue", "tide", "moon", "salt"]
    rows = []
    for k in range(n):
        good = k % 4 != 0
        text = " ".join(rng.choices(words, k=rng.randint(5, 60))) if good else " ".join(w + rng.choice(["%%%", "!!", "###"]) for w in rng.choices(words, k=40))
        rows.append((k, text, "en", "s", None if k % 7 == 0 else len(text), int(good)))
    return rows


def test_pairwise_sum_equals_brute_force():
    model = quality_fm.Model([])
    rng = np.random.default_rng(0)
    model.v = rng.normal(size=model.v.shape)
    model.w = rng.normal(size=model.w.shape)
    idx, x = rng.choice(1000, 12, replace=False), rng.normal(size=12)
    z, _ = model.margins(1, np.zeros(12, np.int64), idx, x)
    pairs = sum(model.v[idx[i]] @ model.v[idx[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert abs(z[0] - (model.w0 + model.w[idx] @ x + pairs)) < 1e-9


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(800)
    odd = [(1000, None, None, None, None), (1001, "", None, None, 0), (1002, "x" * 200000, None, None, 1), (1002, "x" * 200000, None, None, 1), (None, " \n", None, None, -5)]
    docs = spark.createDataFrame([r[:5] for r in rows] + odd, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows] + [(0, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_fm.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    import zlib

    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["held_out"]]
    assert {r["doc_id"] for r in held} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == rows[r["doc_id"]][5] for r in held]) > 0.97
    again = {(r["doc_id"], round(r["score"], 9)) for r in quality_fm.classify(docs.repartition(5), labels).collect()}
    assert again == {(r["doc_id"], round(r["score"], 9)) for r in got}
    kept = quality_fm.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_fm.classify(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert abs(quality_fm.classify(some, labels).first()["score"] - 0.99) < 1e-6


def test_statistics_do_not_depend_on_neighbours():
    texts = ["a b a b a b a b", "", "X!! é\n\n1 | 2", "x" * 50]
    alone = [next(quality_fm.features(pa.array([t]), None))[5][0] for t in texts]
    both = next(quality_fm.features(pa.array(texts), None))[5]
    assert np.allclose(np.stack(alone), both)


def test_columns_of_any_kind_and_clashing_names(spark):
    texts = ["some plain words here", None, "", "x " * 3000] * 8
    rows = [(k, t, "no number" if k % 3 else str(len(t or "")), "a", 7) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string, _label string, _id int")
    labels = spark.createDataFrame([(k, k % 2, "z") for k in range(32)], "doc_id long, quality int, text string")
    got = quality_fm.classify(docs, labels).collect()
    assert len(got) == 32 and all(0 <= r["score"] <= 1 for r in got)
    kept = quality_fm.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["predicted"])
