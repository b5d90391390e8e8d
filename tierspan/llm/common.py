"""Helpers shared by the training-data operators: table access, scratch tables, bounded membership filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierspan.session import CLEANUP, materialise, scratch_path, scratch_root, ship  # noqa: F401

#: ASCII white space, the separator of words in every operator that counts or compares words.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of `sf_dir`, through Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def begin(spark: SparkSession) -> None:
    """Ship this package to the executors and bound the rows of an Arrow batch: batches hold whole texts."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: A bitmap has 8 bits for each member, 2**23 at least and 2**26 at most (8 MB as longs, broadcast). Beyond MOST members it would tell nothing and isn't made.
LEAST, MOST = 1 << 23, 1 << 26
#: Longs of a bitmap that are one row of it: a broadcast of few long rows is hardly larger than its bits.
ROW_LONGS = 128


def bitmap_bits(members: int) -> int:
    """Size of a bitmap of so many members: a power of two, or 0 for no bitmap, where every row may be a member."""
    return 0 if members > MOST else min(MOST, max(LEAST, 1 << (8 * members).bit_length()))


def _slot(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def level_bitmap(members: DataFrame, keys: list[Column], levels: list[Column], bits: int) -> DataFrame | None:
    """One-hash Bloom filters of `keys` as rows (_bits_row, _masks0, _masks1, ...) of ROW_LONGS longs: masks k have the members that meet levels[k]."""
    if not bits:
        return None
    slot = _slot(keys, bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    masks = members.select(F.floor(slot / 64).alias("_word"), *[F.when(level, one).alias(f"_m{k}") for k, level in enumerate(levels)])
    words = masks.groupBy("_word").agg(*[F.bit_or(f"_m{k}").alias(f"_mask{k}") for k in range(len(levels))])
    rows = words.groupBy(F.floor(F.col("_word") / ROW_LONGS).alias("_bits_row")).agg(F.sort_array(F.collect_list(F.struct((F.col("_word") % ROW_LONGS).cast("int").alias("i"), *[f"_mask{k}" for k in range(len(levels))]))).alias("_w"))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)

    def dense(k: int) -> Column:
        # longs in their order, each after the zeros that are missing before it: one pass, as all rows are often one task's
        gap = lambda w, at: w["i"] - F.coalesce(F.get("_w", at - 1)["i"], F.lit(-1)) - 1
        held = F.flatten(F.transform("_w", lambda w, at: F.concat(zeros(gap(w, at)), F.array(F.coalesce(w[f"_mask{k}"], F.lit(0).cast("long"))))))
        return F.concat(held, zeros(ROW_LONGS - 1 - F.element_at("_w", -1)["i"]))

    return rows.select("_bits_row", *[dense(k).alias(f"_masks{k}") for k in range(len(levels))])


def flag_level(df: DataFrame, keys: list[Column], bitmap: DataFrame | None, flag: str, levels: int, bits: int) -> DataFrame:
    """Add integer `flag`: how many of the leading levels the row may meet. It may be too high (a false positive), never too low."""
    if bitmap is None:
        return df.withColumn(flag, F.lit(levels))
    slot = _slot(keys, bits)
    out = df.withColumn("_slot", slot).withColumn("_bits_row", F.floor(F.col("_slot") / (64 * ROW_LONGS))).join(F.broadcast(bitmap), "_bits_row", "left")
    at, bit = F.pmod(F.floor(F.col("_slot") / 64), F.lit(ROW_LONGS)).cast("int"), F.pmod("_slot", F.lit(64)).cast("int")
    level = F.lit(0)
    for k in range(levels):
        level = F.when(F.getbit(F.get(f"_masks{k}", at), bit) == 1, F.lit(k + 1)).otherwise(level)
    return out.withColumn(flag, level).drop("_slot", "_bits_row", *[f"_masks{k}" for k in range(levels)])


def marked(df: DataFrame, members: DataFrame, member: list[str], keys: list[Column], flag: str = "_hit") -> DataFrame:
    """Add boolean `flag`: false means surely no member; true means a member, or a false positive that an exact step sorts out.

    `members`, a scratch table, is counted first; its bitmap grows with it up to a bound, and beyond that every row may be a member.
    """
    bits = bitmap_bits(members.count())
    return flag_level(df, keys, level_bitmap(members, [F.col(c) for c in member], [F.lit(True)], bits), flag, 1, bits).withColumn(flag, F.col(flag) > 0)
