import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op") and n != "pipeline"))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
    df = __spark_entry__.queries()[name](spark, DATA)
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(plain(tuple(r))) for r in df.select(*names).collect()) == sorted(repr(plain(r)) for r in found.fetchall())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_first_appearance_reads_every_conversation(spark, tmp_path):
    rows = [(k, 0, "user", f"word{k} same") for k in (0, 49, 50, 999)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = __spark_entry__.queries()["w05_first_appearance_all"](spark, str(tmp_path)).collect()
    assert {r["label"] for r in got} == {"word0", "word49", "word50", "word999", "same"}


def test_whole_results_beside_the_limited_ones(spark, tmp_path):
    run = lambda name, d: __spark_entry__.queries()[name](spark, d).collect()
    orders = spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert sorted(r["place"] for r in run("q05_order_by_all", DATA)) == list(range(1, orders + 1))
    spark.createDataFrame([(0, 0, "user", "th1 thea")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {tuple(r) for r in run("t06_symbols_all", str(tmp_path))} == {("th1", "θ1"), ("thea", "θiː")}
    at = "timestamp_ntz'2024-01-01 00:00:0"
    spark.sql(f"SELECT 1L event_id, {at}0' ts, 1L user_id, 'a' event_type, 1.0D value UNION ALL SELECT 2, {at}5', 1, 'b', 0.0D").write.parquet(f"{tmp_path}/events.parquet")
    assert {r[0] for r in run("h12_overlap_bucketed_all", str(tmp_path))} == {r[0] for r in run("h12_overlap", str(tmp_path))} == {1, 2}
