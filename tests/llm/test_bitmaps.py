from pyspark.sql import functions as F

from tierspan.llm import common


def test_bitmaps_of_few_and_many_members(spark):
    """Rows of longs are made in one pass over them, as all of them may be one task's: no search of each place in a map."""
    members = spark.range(0, 30000, 3).withColumn("n", F.col("id") % 2)
    bits = common.bitmap_bits(1)
    made = common.level_bitmap(members, [F.col("id")], [F.lit(True), F.col("n") == 1], bits)
    said = made._jdf.queryExecution().executedPlan().toString()
    assert "map_from_entries" not in said and "element_at(map" not in said
    assert made.where(f"size(_masks0) <> {common.ROW_LONGS} OR size(_masks1) <> {common.ROW_LONGS}").isEmpty()
    slots = members.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("s"), "n").collect()
    for k, want in ((0, {r.s for r in slots}), (1, {r.s for r in slots if r.n == 1})):
        got = {(r["_bits_row"] * common.ROW_LONGS + i) * 64 + b for r in made.collect() for i, x in enumerate(r[f"_masks{k}"]) if x for b in range(64) if x >> b & 1}
        assert got == want
    none = common.flag_level(spark.range(10), [F.col("id")], common.level_bitmap(members.limit(0), [F.col("id")], [F.lit(True)], bits), "f", 1, bits)
    assert none.where("f > 0").isEmpty()
