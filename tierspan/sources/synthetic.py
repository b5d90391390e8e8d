"""A synthetic corpus of any size: speakers say phrases, words share a phrase's time, phones share a word's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHRASES = ("the sea is calm", "a bird sings at dawn", "wind moves the sand", "ships leave in the morning", "salt and rope")


def generate(spark: SparkSession, speakers: int | DataFrame, phrases: tuple[str, ...] = PHRASES, phrase_ms: int = 8000) -> dict[str, DataFrame]:
    """phrases, words and phones in whole milliseconds, of so many speakers or of those in the first column of a table (whole numbers); ids
    follow from the speaker and the place, so each run is the same."""
    named = spark.range(speakers).withColumnRenamed("id", "speaker_id") if isinstance(speakers, int) else speakers.select(F.col(speakers.columns[0]).cast("long").alias("speaker_id"))
    said = spark.createDataFrame(list(enumerate(phrases)), "k int, label string")
    rows = named.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(phrases) - 1)))).join(F.broadcast(said), "k")
    base = rows.select(F.col("speaker_id").alias("audio_id"), "speaker_id", (F.col("speaker_id") * 1000 + F.col("k")).alias("identifier"), (F.col("k").cast("long") * phrase_ms).alias("start"), ((F.col("k").cast("long") + 1) * phrase_ms).alias("end"), "label")

    def split(outer: DataFrame, parts, factor: int) -> DataFrame:
        cut = outer.select("audio_id", "speaker_id", F.col("identifier").alias("parent_id"), F.col("start").alias("_s"), (F.col("end") - F.col("start")).alias("_d"), F.size(parts).alias("_n"), F.posexplode(parts).alias("_k", "label"))
        at = lambda k: F.col("_s") + F.floor(F.col("_d") * k / F.col("_n"))
        return cut.select("audio_id", "speaker_id", (F.col("parent_id") * factor + F.col("_k")).alias("identifier"), "parent_id", at(F.col("_k")).alias("start"), at(F.col("_k") + 1).alias("end"), "label")

    words = split(base, F.split("label", " "), 100)
    phones = split(words, F.filter(F.split("label", ""), lambda c: c != ""), 100)
    return {"phrases": base, "words": words, "phones": phones}
