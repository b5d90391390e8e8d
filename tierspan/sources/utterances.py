"""Orthographic annotations as utterance records, and tables of records that are made once and kept as JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierspan.functions.columns import component
from tierspan.sources.awd import NO_SPEAKERS

#: Marks of the transcription protocol. Codes such as *v follow a word; xxx, ggg and Xxx stand for what isn't words.
_CODES, _NO_WORDS = r"\*[a-zA-Z]+", ("xxx", "ggg", "Xxx", "mmm")


def clean_text(raw: Column) -> Column:
    """What was said: without codes and stand-ins, marks other than letters, digits, apostrophes and hyphens as spaces, single spaces."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), _CODES, " "), r"[^\p{L}\p{M}\p{N}'\u2019-]+", " ")), " +")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*_NO_WORDS) & w.rlike(r"[\p{L}\p{N}]")), " ")


def output_name(audio: Column, start: Column, end: Column, folder: Column) -> Column:
    """<folder>/<audio's stem>_s-<start>-e-<end>-ms.TextGrid, in whole milliseconds, cut."""
    stem = F.regexp_replace(F.element_at(F.split(audio, "/"), -1), r"(?<=.)\.[^.]*$", "")
    ms = lambda x: F.floor(x * 1000).cast("long").cast("string")
    return F.concat(folder, F.lit("/"), stem, F.lit("_s-"), ms(start), F.lit("-e-"), ms(end), F.lit("-ms.TextGrid"))


def utterances(intervals: DataFrame, audios: DataFrame, folder: str) -> DataFrame:
    """One record for each interval with words in a speaker's tier, from `textgrid.read_textgrids` (the recording in `file`) and audios
    (file, audio_filename, language). Recordings without an audio have no records; damaged files have none either.

    A record names its speaker's tier, all speakers' tiers of the recording, and the file that an aligner is to write.
    """
    tiers = intervals.where(~F.col("tier").isin(*NO_SPEAKERS, "!error"))
    speakers = tiers.groupBy("file").agg(F.array_sort(F.collect_set("tier")).alias("speaker_ids_audio"))
    said = tiers.withColumn("text", clean_text(F.col("mark"))).where("text <> ''").join(audios.select("file", "audio_filename", "language"), "file").join(speakers, "file")
    target = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("tier"))
    return said.select(
        F.col("file").alias("recording"), F.col("tier").alias("tier_name"), F.col("xmin").alias("start_time"), F.col("xmax").alias("end_time"), "text", F.col("mark").alias("raw_text"),
        "audio_filename", component(F.col("audio_filename")).alias("component"), "language", "speaker_ids_audio", target.alias("output_directory"),
        output_name(F.col("audio_filename"), F.col("xmin"), F.col("xmax"), target).alias("output_filename"),
    )


def json_source(spark: SparkSession, path: str, schema: T.StructType | str, make: Callable[[], DataFrame] | None = None, *, overwrite: bool = False) -> DataFrame:
    """The records kept at `path`, made and written first where there are none, or anew with `overwrite`.

    Files of several times may lie there: a column that some don't have is null in their rows, a column beyond `schema` that any file has
    is kept after the others, and a value that isn't of its column's type is null. The folder is written whole before it takes its place, so
    a run that ends early leaves what was there.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at, aside = hadoop.Path(path), hadoop.Path(f"{path}.new")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if overwrite or not fs.exists(at):
        if make is None:
            raise FileNotFoundError(path)
        made = make()
        made.write.mode("overwrite").json(f"{path}.new")
        fs.delete(at, True)
        if not fs.rename(aside, at):
            raise OSError(f"can't create {path}")
    found = spark.read.json(path).schema.fields if any(not s.getPath().getName().startswith(("_", ".")) and s.getLen() for s in fs.listStatus(at)) else []
    more = [f for f in found if f.name not in wanted.names]
    return spark.read.schema(T.StructType([*wanted.fields, *more])).json(path)
