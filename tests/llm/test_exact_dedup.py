import hashlib

from tierspan.llm import exact_dedup

ROWS = [(1, "a b", "x"), (2, "a b", "y"), (3, None, "x"), (4, "", "x"), (5, "a c", "x"), (6, "z" * 300 + "1", "x"), (7, "z" * 300 + "2", "x"), (8, "z" * 300 + "1", "x"), (9, "a b ", "x"), (9, "a b ", "x"), (None, "q", "x"), (None, "a b", "x")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, _sha string")


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, _ in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_decisions_equal_brute_force(spark):
    got = exact_dedup.decisions(frame(spark, ROWS), all_digests=True)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS)


def test_drop_duplicates_keeps_largest_id_and_other_columns(spark):
    got = exact_dedup.drop_duplicates(frame(spark, ROWS))
    assert got.columns == ["doc_id", "text", "_sha"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(2, "a b", "y"), (4, "", "x"), (5, "a c", "x"), (7, "z" * 300 + "2", "x"), (8, "z" * 300 + "1", "x"), (9, "a b ", "x"), (None, "q", "x")], key=repr)


def test_empty_table(spark):
    assert exact_dedup.decisions(frame(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(frame(spark, [])).count() == 0
