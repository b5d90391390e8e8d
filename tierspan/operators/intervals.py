"""Interval joins, sweeps and islands, without pairs of all rows of a recording.

Overlaps are counted by one sort of starts and ends per recording. Containment and midpoints join points to spans on the recording
and a cell of time whose width follows the span's length, so a point meets only spans near it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _met(rows: DataFrame, others: DataFrame, by: list[str], sign: int) -> DataFrame:
    """(identifier, n): sign times how many of `others` with the same `by` share time with each row.

    Those that start before a row's end, less those that end at or before its start. At one time, ends of empty spans count after
    empty rows have asked, so that two empty spans never meet.
    """
    keys = lambda df: [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in by] + [F.col(c).isNull().alias(f"_no_{c}") for c in by]
    empty = F.col("start") == F.col("end")
    ask = lambda t, k, n: F.struct(F.col(t).alias("t"), k.alias("k"), F.lit(n).alias("n"))
    asks = rows.select(*keys(rows), "identifier", F.explode(F.array(ask("end", F.lit(0), 1), ask("start", F.when(empty, 3).otherwise(5), -1))).alias("e"))
    tells = others.select(*keys(others), F.lit(None).cast(rows.schema["identifier"].dataType).alias("identifier"), F.explode(F.array(ask("start", F.lit(1), 0), ask("end", F.when(empty, 4).otherwise(2), 0))).alias("e"))
    w = Window.partitionBy(*[f"_{c}" for c in by], *[f"_no_{c}" for c in by]).orderBy("e.t", "e.k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = asks.unionByName(tells).withColumns({"_s": F.count(F.when(F.col("e.k") == 1, 1)).over(w), "_e": F.count(F.when(F.col("e.k").isin(2, 4), 1)).over(w)})
    return seen.where("e.n <> 0").select("identifier", (sign * F.when(F.col("e.n") == 1, F.col("_s")).otherwise(-F.col("_e"))).alias("n"))


def overlaps(rows: DataFrame, others: DataFrame, *, other_speaker: bool = False) -> DataFrame:
    """`rows` that share time with another row of the same audio (strictly: touching doesn't count), by running counts over each
    recording's starts and ends. A row of `others` with the same id is the row itself; no span ends before it starts."""
    rows_, others_ = (df.where("audio_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL") for df in (rows, others))
    counts = _met(rows_, others_, ["audio_id"], 1)
    if other_speaker:
        counts = counts.unionByName(_met(rows_, others_, ["audio_id", "speaker_id"], -1))
    else:
        counts = counts.unionByName(others_.where("start < end").select("identifier", F.lit(-1).cast("long").alias("n")))
    hit = counts.groupBy("identifier").agg(F.sum("n").alias("n")).where("n > 0").select("identifier")
    return rows.join(hit, "identifier", "left_semi").select(*rows.columns)


#: Cells of a level are this many times as wide as those of the level below.
CELL_STEP = 4


def _level(length: Column, width: int) -> Column:
    """The lowest level whose cells are as wide as a span of this length; level 0 has cells of `width`."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)) / F.lit(width)) / F.log2(F.lit(float(CELL_STEP))))).cast("int")


def _cell(at: Column, level: Column, width: int) -> Column:
    return F.floor(at / (F.pow(F.lit(float(CELL_STEP)), level) * width))


def _levels(spans: DataFrame) -> Column:
    """The levels that spans have, found when the query runs."""
    return spans.agg(F.collect_set("_k")).scalar()


def _cells(df: DataFrame, level: Column, width: int) -> Column:
    """The cells of a level that a span lies in, its end left out: two, where the level is its own or above."""
    return F.sequence(_cell(F.col("start"), level, width), _cell(F.greatest(F.col("end") - 1, F.col("start")), level, width))


def bucketed_overlaps(rows: DataFrame, others: DataFrame, width: int) -> DataFrame:
    """As `overlaps`, by joins on audio and cells of time. A span lies in two cells of its own level at most, however long it is, and asks
    one or two of each level above that the other side has."""
    named = lambda df, p: df.where("audio_id IS NOT NULL").select(F.col("audio_id").alias(f"{p}audio"), "start", "end", F.col("identifier").alias(f"{p}id"), _level(F.col("end") - F.col("start"), width).alias("_k"))

    def own(df: DataFrame, p: str) -> DataFrame:
        return df.withColumn("_c", F.explode(_cells(df, F.col("_k"), width))).withColumnsRenamed({"start": f"{p}start", "end": f"{p}end", "_k": f"{p}k", "_c": f"{p}c"})

    def asking(df: DataFrame, p: str, levels: Column, least: int) -> DataFrame:
        df = df.withColumn("_l", F.explode(levels)).where(F.col("_l") >= F.col("_k") + least).drop("_k")
        return df.withColumn("_c", F.explode(_cells(df, F.col("_l"), width))).withColumnsRenamed({"start": f"{p}start", "end": f"{p}end", "_l": f"{p}k", "_c": f"{p}c"})

    r, o = named(rows, "r_"), named(others, "o_")
    meet = (F.col("r_audio") == F.col("o_audio")) & (F.col("r_k") == F.col("o_k")) & (F.col("r_c") == F.col("o_c")) & (F.col("r_start") < F.col("o_end")) & (F.col("o_start") < F.col("r_end")) & (F.col("r_id") != F.col("o_id"))
    shorter = asking(r, "r_", _levels(o), 0).join(own(o, "o_"), meet, "left_semi").select("r_id")
    longer = own(r, "r_").join(asking(o, "o_", _levels(r), 1), meet, "left_semi").select("r_id")
    return rows.join(shorter.unionByName(longer).distinct(), F.col("identifier") == F.col("r_id"), "left_semi")


def in_spans(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Points beside each span of their audio that they start in, [start, end), with the span's columns prefixed p_.

    A span lies in two cells of its level at most, and a point asks one cell of each level that spans have: the join is on audio, level
    and cell, so a recording that holds all rows is still many keys, and a long span doesn't meet the points outside it. A task keeps its
    spans in a hash table; points, of which there are many more, aren't sorted.
    """
    s = spans.select(*[F.col(c).alias(f"p_{c}") for c in spans.columns], F.col("audio_id").alias("_a"), "start", "end").where("_a IS NOT NULL AND start < end")
    s = s.withColumn("_k", _level(F.col("end") - F.col("start"), 1))
    p = points.where("audio_id IS NOT NULL AND start IS NOT NULL").withColumn("_pk", F.explode(_levels(s)))
    p = p.withColumn("_pc", _cell(F.col("start"), F.col("_pk"), 1))
    s = s.withColumn("_c", F.explode(_cells(s, F.col("_k"), 1))).drop("start", "end")
    met = (F.col("audio_id") == F.col("_a")) & (F.col("_pk") == F.col("_k")) & (F.col("_pc") == F.col("_c")) & (p["start"] >= F.col("p_start")) & (p["start"] < F.col("p_end"))
    return p.join(s.hint("shuffle_hash"), met).drop("_a", "_k", "_pk", "_c", "_pc")


def overlap_codes(phrases: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(identifier, overlap_code): 1 where a phrase shares time with another speaker's phrase, else 0.

    With `items`, words, syllables or phones inside their own phrase: whether they share time with another speaker's phrase.
    """
    items = phrases if items is None else items
    hit = overlaps(items, phrases, other_speaker=True).select(F.col("identifier").alias("_hit")).distinct()
    return items.join(hit, items["identifier"] == hit["_hit"], "left").select("identifier", F.when(F.col("_hit").isNotNull(), 1).otherwise(0).cast("short").alias("overlap_code"))


def same_speaker_overlaps(rows: DataFrame) -> DataFrame:
    """Rows that start before an earlier row of their audio and speaker has ended: a running maximum, no self-join."""
    w = Window.partitionBy("audio_id", "speaker_id").orderBy("start", "end", "identifier").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_m", F.max("end").over(w)).where("start < _m").drop("_m")


def _near(spans: DataFrame, points: DataFrame, at: Column) -> DataFrame:
    """Points (all columns) with the spans (_s, _e, _i) of their audio that hold the point `at`, ends included.

    A span of up to 2**k lies in two cells of that width at most, and a point asks one cell for each k that spans have.
    """
    level = F.ceil(F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(1)).cast("double"))).cast("int")
    s = spans.where("audio_id IS NOT NULL AND start <= end").withColumn("_k", level)
    levels = _levels(s)
    width = F.pow(F.lit(2.0), F.col("_k"))
    cell = lambda x: F.floor(x / width)
    s = s.select(F.col("audio_id").alias("_a"), "_k", F.explode(F.array_distinct(F.array(cell(F.col("start")), cell(F.col("end"))))).alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("identifier").alias("_i"))
    p = points.withColumn("_at", at).withColumn("_pk", F.explode(levels))
    p = p.withColumn("_pc", F.floor(F.col("_at") / F.pow(F.lit(2.0), F.col("_pk"))))
    return p.join(s, (p["audio_id"] == s["_a"]) & (p["_pk"] == s["_k"]) & (p["_pc"] == s["_c"]) & (F.col("_at") >= F.col("_s")) & (F.col("_at") <= F.col("_e")))


def contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(identifier, parent_id): the last outer row, by start and id, that holds an inner row whole (ends included)."""
    pairs = _near(outer, inner, F.col("start")).where(F.col("end") <= F.col("_e"))
    return pairs.groupBy("identifier").agg(F.max_by("_i", F.struct("_s", "_i")).alias("parent_id"))


def midpoint(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """(identifier, span_id): the first span, by start and id, that holds a row's middle (ends included)."""
    pairs = _near(spans, rows, (F.col("start") + F.col("end")) / 2)
    return pairs.groupBy("identifier").agg(F.min_by("_i", F.struct("_s", "_i")).alias("span_id"))


def as_of(spans: DataFrame, points: DataFrame) -> DataFrame:
    """(identifier, span_id): the latest span that starts at or before a point, if it hasn't ended before it; a later one wins a border.

    One sort of both sides together, no join: spans and points are merged by time and the last span is carried on.
    """
    s = spans.select("audio_id", F.col("start").alias("_t"), F.lit(0).alias("_k"), F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("identifier").alias("i")).alias("_span"), F.lit(None).cast(points.schema["identifier"].dataType).alias("identifier"), F.col("identifier").alias("_tie"))
    p = points.select("audio_id", F.col("at").alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(s.schema["_span"].dataType).alias("_span"), "identifier", F.lit(None).cast(s.schema["_tie"].dataType).alias("_tie"))
    w = Window.partitionBy("audio_id").orderBy("_t", "_k", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = s.unionByName(p).withColumn("_last", F.last("_span", ignorenulls=True).over(w)).where("_k = 1")
    return carried.select("identifier", F.when(F.col("_t") <= F.col("_last.e"), F.col("_last.i")).alias("span_id"))


def pause_runs(rows: DataFrame, max_pause: int = 500, by: tuple[str, ...] = ("audio_id", "speaker_id")) -> DataFrame:
    """Add `run`: a new one starts where the gap to the row before, in start order, is at least `max_pause`."""
    w = Window.partitionBy(*by).orderBy("start", "identifier")
    gap = F.col("start") - F.lag("end").over(w)
    return rows.withColumn("_new", F.when(gap >= max_pause, 1).otherwise(0)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def islands(rows: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Merge spans (first, last) that start at most `gap` after everything before has ended."""
    w = Window.partitionBy(*by).orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(before.isNull() | (F.col("first") > before + gap), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")


def tail(rows: DataFrame, by: list[str], order: list, n: int = 3) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def placeholders(words: DataFrame, by: tuple[str, ...] = ("phrase_id",)) -> DataFrame:
    """Spans of words: empty ones get zero width at the end of the word before, or at the phrase's start."""
    w = Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.coalesce(F.last("end", ignorenulls=True).over(w), F.col("phrase_start"))
    return words.withColumn("_c", cursor).withColumn("start", F.coalesce("start", "_c")).withColumn("end", F.coalesce("end", "_c")).drop("_c")
