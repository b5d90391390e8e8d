"""The general tables seen as annotations: conversations as a timeline of phrases, words and phones; events as spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierspan.plans.query import Entity


#: Words of a turn that are one row while they are dealt out.
PIECE = 32
#: Turns that one task takes apart, on average.
TURNS = 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word for each token of each turn; a conversation's characters are its time axis.

    Turns are dealt out and placed in pieces of PIECE words, each with a space behind it, and only then taken apart: a row per word needs
    many times the memory and shuffle of its text. A task has TURNS of them, whatever their size before they are taken apart, and all
    of a conversation.
    """
    turns = table(spark, sf_dir, "conversations")
    tasks = max(spark.sparkContext.defaultParallelism, -(-turns.count() // TURNS))
    spaced = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\n]+", " "), F.lit(" "))
    pieces = turns.select("conv_id", "turn", "role", F.posexplode(F.regexp_extract_all(spaced, F.lit(f"(?:[^ ]++ ){{1,{PIECE}}}"), F.lit(0))).alias("_piece", "_said")).repartition(tasks, "conv_id")
    end = F.sum(F.length("_said")).over(Window.partitionBy("conv_id").orderBy("turn", "_piece").rowsBetween(Window.unboundedPreceding, 0))
    none = F.array().cast("array<struct<label:string,e:bigint>>")
    said = F.named_struct(F.lit("words"), none, F.lit("e"), (F.col("_end") - F.length("_said")).cast("long"))

    def put(done, label):
        e = done["e"] + F.length(label) + 1
        word = F.named_struct(F.lit("label"), label, F.lit("e"), e)
        return F.named_struct(F.lit("words"), F.concat(done["words"], F.array(word)), F.lit("e"), e)

    tokens = F.aggregate(F.filter(F.split("_said", " "), lambda x: x != ""), said, put, lambda done: done["words"])
    rows = pieces.withColumn("_end", end).select("conv_id", "turn", "role", "_piece", F.posexplode(tokens).alias("_k", "_w"))
    rows = rows.select("conv_id", "turn", "role", (F.col("_piece") * PIECE + F.col("_k")).alias("pos"), F.col("_w.label").alias("label"), F.col("_w.e").alias("_e"))
    return rows.select(
        F.col("conv_id").alias("audio_id"),
        F.col("role").alias("speaker_id"),
        (F.col("_e") - F.length("label") - 1).cast("long").alias("start"),
        (F.col("_e") - 1).cast("long").alias("end"),
        ((F.col("conv_id") * 1000 + F.col("turn")) * 10000 + F.col("pos")).alias("identifier"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("parent_id"),
        "label",
    )


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy("audio_id", "speaker_id", F.col("parent_id").alias("identifier")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_words"))


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of words; a, e, i, o and u are vowels."""
    w = words(spark, sf_dir)
    chars = w.select("audio_id", "speaker_id", F.col("identifier").alias("parent_id"), F.col("parent_id").alias("phrase_id"), F.col("start").alias("_s"), F.posexplode(F.split("label", "")).alias("_k", "label")).where("label <> ''")
    return chars.select("audio_id", "speaker_id", (F.col("_s") + F.col("_k")).alias("start"), (F.col("_s") + F.col("_k") + 1).alias("end"), (F.col("parent_id") * 100 + F.col("_k")).alias("identifier"), "parent_id", "phrase_id", "label", F.lower("label").isin("a", "e", "i", "o", "u").alias("is_vowel"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of milliseconds: users are audios, event types are speakers."""
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("audio_id"), F.col("event_type").alias("speaker_id"), F.col("event_id").alias("identifier"), start.alias("start"), (start + F.floor(F.col("value") * 60000)).alias("end"))


GRAPH = {
    "region": Entity("r_regionkey", ("r_regionkey",), {}, {"nations": ("nation", "n_regionkey")}),
    "nation": Entity("n_nationkey", ("n_nationkey",), {"region": ("region", "n_regionkey")}, {"customers": ("customer", "c_nationkey"), "suppliers": ("supplier", "s_nationkey")}),
    "customer": Entity("c_custkey", ("c_custkey",), {"nation": ("nation", "c_nationkey")}, {"orders": ("orders", "o_custkey")}),
    "supplier": Entity("s_suppkey", ("s_suppkey",), {"nation": ("nation", "s_nationkey")}),
    "orders": Entity("o_orderkey", ("o_orderkey",), {"customer": ("customer", "o_custkey")}, {"lineitems": ("lineitem", "l_orderkey")}, carried={"segment": ("customer__c_mktsegment", "none")}),
    "lineitem": Entity("l_orderkey", ("l_orderkey", "l_linenumber"), {"order": ("orders", "l_orderkey"), "part": ("part", "l_partkey")}, derived={"net": "l_extendedprice * (1 - l_discount)"}),
    "part": Entity("p_partkey", ("p_partkey",)),
}
