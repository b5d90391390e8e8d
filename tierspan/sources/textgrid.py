"""TextGrid files as one long interval table, and their alignment into words, syllables and phones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierspan.functions.columns import ms_truncated
from tierspan.operators.intervals import contained
from tierspan.session import ship

INTERVALS = "file string, tier string, tier_idx int, idx int, xmin double, xmax double, mark string"
#: Strings, and numbers that stand alone: whatever else is written (names, "=", "[3]:") only helps readers.
_TOKEN = re.compile(r'"((?:[^"]|"")*)"|(?<!\S)([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?!\S)')
_WIDTHS = {"IntervalTier": 3, "TextTier": 2}


def parse(text: str) -> Iterator[tuple[str, int, int, float, float, str]]:
    """(tier, tier_idx, idx, xmin, xmax, mark) of the interval tiers of a TextGrid in long or short notation.

    ValueError where counts, tier kinds or types don't fit, or something follows the last tier.
    """
    values = [m[1].replace('""', '"') if m[1] is not None else float(m[2]) for m in _TOKEN.finditer(text)]
    if values[:2] != ["ooTextFile", "TextGrid"] or len(values) < 5:
        raise ValueError("not a TextGrid")

    def count(value) -> int:
        if not isinstance(value, float) or value != int(value) or value < 0:
            raise ValueError(f"{value!r} is no count")
        return int(value)

    at = 5
    for tier_idx in range(count(values[4])):
        if len(values) < at + 5 or values[at] not in _WIDTHS:
            raise ValueError(f"tier {tier_idx + 1} isn't there or of an unknown kind")
        kind, name, n = values[at], values[at + 1], count(values[at + 4])
        at, width = at + 5, _WIDTHS[kind]
        if len(values) < at + n * width:
            raise ValueError(f"tier {name!r} has fewer than {n} entries")
        for idx in range(n):
            *times, mark = values[at + idx * width : at + (idx + 1) * width]
            if not isinstance(mark, str) or any(isinstance(t, str) for t in times):
                raise ValueError(f"entry {idx + 1} of tier {name!r} isn't times and a mark")
            if width == 3:
                yield str(name), tier_idx, idx, times[0], times[1], mark
        at += n * width
    if at != len(values):
        raise ValueError("there is more than the tiers announced")


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of all TextGrid files below a path; files are parsed where they are read. A damaged file gives one row with tier `!error`."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT]ext[gG]rid").load(path)

    def run(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                raw = bytes(content)
                try:
                    rows += [(name, *r) for r in parse(raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig"))]
                except (ValueError, IndexError, UnicodeError) as e:
                    rows.append((name, "!error", -1, -1, 0.0, 0.0, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INTERVALS.split(", ")])

    return files.select("path", "content").mapInPandas(run, INTERVALS)


def missing_tiers(intervals: DataFrame, names: list[str]) -> DataFrame:
    """(file, tier) for each wanted tier that a file lacks."""
    files = intervals.select("file").distinct().withColumn("tier", F.explode(F.array(*map(F.lit, names))))
    return files.join(intervals.select("file", "tier").distinct(), ["file", "tier"], "left_anti")


def zip_tiers(intervals: DataFrame, left: str, right: str, within: float = 0.0) -> DataFrame:
    """Two parallel tiers by index, with `aligned` false where times differ by more than `within` or one tier is longer."""
    pick = lambda name, p: intervals.where(F.col("tier") == name).select("file", "idx", F.col("xmin").alias(f"{p}min"), F.col("xmax").alias(f"{p}max"), F.col("mark").alias(f"{p}mark"))
    both = pick(left, "l").join(pick(right, "r"), ["file", "idx"], "full")
    return both.withColumn("aligned", F.coalesce((F.abs(F.col("lmin") - F.col("rmin")) <= within) & (F.abs(F.col("lmax") - F.col("rmax")) <= within), F.lit(False)))


def _ids(df: DataFrame, level: str, offset: float | Column) -> DataFrame:
    return df.select(F.col("file").alias("audio_id"), ms_truncated(F.col("xmin") + offset).alias("start"), ms_truncated(F.col("xmax") + offset).alias("end"), F.concat_ws("/", "file", F.lit(level), F.col("idx").cast("string")).alias("identifier"), F.col("mark").alias("label"))


def aligned_levels(intervals: DataFrame, offset: float | Column = 0.0) -> dict[str, DataFrame]:
    """Phrases, words, syllables and phones of aligned recordings, later by `offset` seconds, a number or a column of the intervals. Phones outside any syllable keep a null parent and get the phrase."""
    tier = lambda name: intervals.where(F.col("tier") == name)
    ipa = zip_tiers(intervals, "ORT-MAU", "KAN-MAU").select(F.concat_ws("/", "file", F.lit("w"), F.col("idx").cast("string")).alias("_i"), F.col("rmark").alias("ipa"))
    words = _ids(tier("ORT-MAU").where("mark <> ''"), "w", offset)
    words = words.join(ipa, words["identifier"] == ipa["_i"], "left").drop("_i")
    syllables = _ids(tier("MAS").where("mark <> '<p:>'"), "s", offset)
    phones = _ids(tier("MAU").where(~F.col("mark").rlike(r"^\(.*\)$")), "p", offset)
    ordered = F.array_sort(F.collect_list(F.struct("start", "label")))
    phrases = words.groupBy("audio_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(ordered, lambda x: x["label"]), " ").alias("label"))
    phrases = phrases.withColumn("identifier", F.concat("audio_id", F.lit("/phrase")))
    phrase = phrases.select("audio_id", F.col("identifier").alias("phrase_id"))
    link = lambda inner, outer: inner.join(contained(outer, inner), "identifier", "left")
    return {
        "phrases": phrases,
        "words": words.join(phrase.withColumnRenamed("phrase_id", "parent_id"), "audio_id"),
        "syllables": link(syllables, words).join(phrase, "audio_id", "left"),
        "phones": link(phones, syllables).join(phrase, "audio_id", "left"),
    }


def speakers_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def stems(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(stem, path) of files below a path, by suffix without regard to case; `n` over 1 marks a stem that occurs twice."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    found = files.where(F.lower("path").endswith(suffix.lower())).withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    return found.groupBy("stem").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
