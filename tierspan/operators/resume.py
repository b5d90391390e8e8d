"""Resumed imports: what is known is skipped, except for the last few recordings, which are compared and repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIGNATURE = ["audio_id", "speaker_id", "start", "end", "label"]


def plan(sources: DataFrame, stored: DataFrame, order: list[Column], audit: int = 3) -> DataFrame:
    """(sources' columns, action): `import` what isn't stored, `audit` the last stored ones in source order, `skip` the rest.

    The rank runs over the stored recordings alone, which are one narrow row each.
    """
    there = stored.select("audio_id").distinct().withColumn("_there", F.lit(True))
    found = sources.join(there, "audio_id", "left")
    last = found.where("_there").orderBy(*[c.desc() for c in order]).limit(audit).select("audio_id").withColumn("_last", F.lit(True))
    action = F.when(F.col("_there").isNull(), "import").when(F.col("_last"), "audit").otherwise("skip")
    return found.join(last, "audio_id", "left").withColumn("action", action).drop("_there", "_last")


def differing(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """Recordings whose stored and staged phrases aren't the same multiset: one shuffle of both sides together."""
    counts = stored.select(*SIGNATURE, F.lit(1).alias("_d")).unionByName(staged.select(*SIGNATURE, F.lit(-1).alias("_d")))
    return counts.groupBy(*SIGNATURE).agg(F.sum("_d").alias("_d")).where("_d <> 0").select("audio_id").distinct()


def signatures(phrases: DataFrame) -> DataFrame:
    """(audio_id, signature): a digest of each recording's phrases that doesn't depend on their order."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in SIGNATURE[1:]])
    return phrases.groupBy("audio_id").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(row.cast("decimal(20,0)")).cast("string")).alias("signature"))


def latest(rows: DataFrame, by: str, order: str) -> DataFrame:
    """One row a key: the latest; of several as late the one that is greatest as text."""
    tie = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), tie.desc()))).where("_r = 1").drop("_r")
