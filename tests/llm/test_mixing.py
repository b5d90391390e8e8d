import random

from tierspan.llm import mixing


def test_targets_share_by_weight_within_limits():
    assert mixing.source_targets({"b": 100, "a": 100, None: 100}) == {"a": 50.0, "b": 100.0, None: 150.0}
    got = mixing.source_targets({"a": 1000, "b": 10, "c": 10, "d": 0})
    assert got["b"] == 30 and got["c"] == 30 and got["d"] == 0 and abs(sum(got.values()) - 1020) < 1e-6
    assert mixing.source_targets({}) == {} and mixing.source_targets({"a": 0}) == {"a": 0.0}


def test_flight_keeps_both_totals():
    rng = random.Random(4)
    for n in (1, 2, 3, 50, 3000):
        size = sorted((float(int(rng.paretovariate(1.1) * 20)) for _ in range(n)), reverse=True)
        uid, p = [rng.getrandbits(63) - 2**62 for _ in range(n)], [rng.choice([0.3, 0.7, 1.0, 0.0]) for _ in range(n)]
        mid, end = mixing.flight(uid, size, p, land=False), mixing.flight(uid, size, p, land=True)
        assert sum(0 < x < 1 for x in mid) <= 2 and all(x in (0, 1) for x in end)
        words = lambda q: sum(a * b for a, b in zip(size, q, strict=True))
        assert abs(words(mid) - words(p)) < 1e-6 * words(p) + 1e-6 and abs(sum(mid) - sum(p)) < 0.02 * n + 1
        if n == 3000:
            assert abs(words(end) - words(p)) < 0.002 * words(p) and abs(sum(end) - sum(p)) < 0.02 * n
    assert mixing.flight([1] * 9, [5.0] * 9, [0.5] * 9, land=True).count(1.0) in (4, 5)


def test_mix_comes_near_its_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 400)
    rng = random.Random(9)
    rows = [(k, None if k % 97 == 0 else "w " * int(rng.paretovariate(1.2) * 10), rng.choice(["x", "y", "z", "z", "z", "z", None]), "c") for k in range(3000)]
    rows += [(5000, "same text", "x", "c")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.takes(docs).collect()
    assert len(got) == len(rows)
    again = mixing.takes(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    # two sources have the same weight and so the same target: their sizes tell them apart
    for target, size in {(r["target"], r["source_size"]) for r in got}:
        taken = sum(r["taken"] for r in got if (r["target"], r["source_size"]) == (target, size))
        assert abs(taken - target) < 0.02 * target + 20
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.takes(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_small_sources_come_as_near_as_any_choice():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 12)
        size = sorted((float(rng.randint(0, 50) ** 2) for _ in range(n)), reverse=True)
        p = [rng.choice([0.25, 0.5, 0.8])] * n
        got = mixing.flight(rng.sample(range(1000), n), size, p, land=True)
        want = sum(a * b for a, b in zip(size, p, strict=True))
        best = min(abs(sum(s for k, s in enumerate(size) if way >> k & 1) - want) for way in range(1 << n))
        assert set(got) <= {0.0, 1.0} and abs(abs(sum(a * b for a, b in zip(size, got, strict=True)) - want) - best) < 1e-6


def test_one_very_long_document_per_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 300)
    rng = random.Random(6)
    rows = []
    for k, (source, n, giant) in enumerate([("a", 200, 9000), ("b", 1500, 15000), ("c", 1500, 40000), (None, 900, 3)]):
        rows += [(10_000 * k + i, "w " * rng.randint(1, 40), source) for i in range(n)] + [(10_000 * k + n, "w " * giant, source)]
    got = mixing.takes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    long = {10_000 * k + n: g for k, (n, g) in enumerate([(200, 9000), (1500, 15000), (1500, 40000), (900, 3)])}
    for target, size in {(r["target"], r["source_size"]) for r in got}:
        own = [r for r in got if r["source_size"] == size]
        rate = target / size
        low, high = (sum(int(rate + up) * r["size"] for r in own if r["doc_id"] not in long) for up in (0, 1))
        giants = [int(rate + up) * long[r["doc_id"]] for r in own if r["doc_id"] in long for up in (0, 1)]
        reachable = min(max(0, low + g - target, target - high - g) for g in giants)
        assert abs(sum(r["taken"] for r in own) - target) <= reachable + 0.005 * target, (target, size)
        assert all(r["taken"] <= 3 * r["size"] for r in own)
