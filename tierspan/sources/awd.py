"""Word-aligned and orthographic annotation pairs: one set-oriented job over the intervals of all recordings.

Intervals are the long table of `textgrid.read_textgrids`, with the recording in `file`. A speaker S has word tiers S, S_FON and S_SEG.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspan.functions.columns import clean_label, ms_half_even
from tierspan.functions.phonology import map_symbols, phone_type, syllable_groups
from tierspan.operators.intervals import as_of, midpoint
from tierspan.operators.positions import positions


def pair_sources(**kinds: DataFrame) -> DataFrame:
    """(stem, a path for each kind, complete) from tables (stem, path): full outer joins, so what is missing can be reported."""
    out = None
    for kind, df in kinds.items():
        one = df.select("stem", F.col("path").alias(kind))
        out = one if out is None else out.join(one, "stem", "full")
    return out.withColumn("complete", F.forall(F.array(*[F.col(k) for k in kinds]), lambda p: p.isNotNull()))


#: Tiers of an orthographic annotation that are no speakers.
NO_SPEAKERS = ("BACKGROUND", "COMMENT")
#: Seconds by which the times of a word and its phonetic transcription may differ.
SAME_TIME = 1e-6


def ort_speakers(ort: DataFrame) -> DataFrame:
    """(file, speaker) of tiers with a mark that isn't blank, other than background and comment."""
    return ort.where(~F.col("tier").isin(*NO_SPEAKERS) & (F.trim("mark") != "")).select("file", F.col("tier").alias("speaker")).distinct()


def speaker_tier_differences(ort: DataFrame, awd: DataFrame) -> DataFrame:
    """(file, speaker, side) of speakers that only one annotation has."""
    a, b = ort_speakers(ort), awd.where("tier NOT LIKE '%\\_FON' AND tier NOT LIKE '%\\_SEG'").select("file", F.col("tier").alias("speaker")).distinct()
    return a.subtract(b).withColumn("side", F.lit("ort")).unionByName(b.subtract(a).withColumn("side", F.lit("awd")))


def tier_errors(ort: DataFrame, awd: DataFrame) -> DataFrame:
    """(file, error, detail) of recordings whose word-aligned tiers break the form: triples S, S_FON, S_SEG in order, no speaker twice,
    a transcription of the same times for each word, the same speakers as the orthographic annotation."""
    tiers = awd.select("file", "tier_idx", "tier").distinct()
    place = F.col("tier_idx") % 3
    triples = tiers.groupBy("file", F.floor(F.col("tier_idx") / 3).alias("_k")).agg(*[F.max(F.when(place == k, F.col("tier"))).alias(f"_{k}") for k in range(3)])
    # a word tier that is empty has no rows, so a triple is judged by the tiers it has
    named = F.coalesce("_0", F.regexp_replace(F.coalesce("_1", "_2"), "_(FON|SEG)$", ""))
    wrong = triples.where(~(F.coalesce("_0", named) == named) | ~(F.coalesce(F.col("_1"), F.concat(named, F.lit("_FON"))) == F.concat(named, F.lit("_FON"))) | ~(F.coalesce(F.col("_2"), F.concat(named, F.lit("_SEG"))) == F.concat(named, F.lit("_SEG"))))
    out = wrong.select("file", F.lit("tier triple").alias("error"), F.concat_ws(",", "_0", "_1", "_2").alias("detail"))
    twice = tiers.groupBy("file", "tier").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = out.unionByName(twice.select("file", F.lit("duplicate tier").alias("error"), F.col("tier").alias("detail")))
    base = F.regexp_replace("tier", "_FON$", "")
    side = lambda rows, p: rows.select("file", base.alias("_s"), "idx", F.col("xmin").alias(f"{p}min"), F.col("xmax").alias(f"{p}max"))
    words = awd.where("tier NOT LIKE '%\\_FON' AND tier NOT LIKE '%\\_SEG'")
    both = side(words, "l").join(side(awd.where("tier LIKE '%\\_FON'"), "r"), ["file", "_s", "idx"], "full")
    size = both.where("lmin IS NULL OR rmin IS NULL").select("file", F.lit("size of words and transcription").alias("error"), F.col("_s").alias("detail"))
    time = both.where((F.abs(F.col("lmin") - F.col("rmin")) >= SAME_TIME) | (F.abs(F.col("lmax") - F.col("rmax")) >= SAME_TIME)).select("file", F.lit("times of words and transcription").alias("error"), F.col("_s").alias("detail"))
    differ = speaker_tier_differences(ort, awd).select("file", F.concat(F.lit("speaker only in "), "side").alias("error"), F.col("speaker").alias("detail"))
    return out.unionByName(size).unionByName(time).unionByName(differ).distinct()


def read_pairs(ort: DataFrame, awd: DataFrame, mapping: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(levels of the recordings in good form, errors of the others), from intervals as files gave them."""
    damaged = ort.unionByName(awd).where("tier = '!error'").select("file", F.lit("damaged file").alias("error"), F.col("mark").alias("detail"))
    ort, awd = ort.where("tier <> '!error'"), awd.where("tier <> '!error'")
    errors = damaged.unionByName(tier_errors(ort, awd))
    bad = errors.select("file").distinct()
    return build(ort.join(bad, "file", "left_anti"), awd.join(bad, "file", "left_anti"), mapping), errors


def _tier(rows: DataFrame, suffix: str, level: str) -> DataFrame:
    named = rows.where(F.col("tier").endswith(suffix)) if suffix else rows.where("tier NOT LIKE '%\\_FON' AND tier NOT LIKE '%\\_SEG'")
    speaker = F.expr(f"substring(tier, 1, length(tier) - {len(suffix)})")
    return named.select("file", speaker.alias("speaker_id"), "idx", ms_half_even(F.col("xmin")).alias("start"), ms_half_even(F.col("xmax")).alias("end"), F.trim("mark").alias("mark")).select(
        F.concat_ws("|", "file", "speaker_id").alias("audio_id"), "file", "speaker_id", "idx", "start", "end", "mark", F.concat_ws("/", "file", "speaker_id", F.lit(level), F.col("idx").cast("string")).alias("identifier")
    )


def build(ort: DataFrame, awd: DataFrame, mapping: dict[str, str]) -> dict[str, DataFrame]:
    """words, phrases, phones, syllables and issues (kind, sample) of all recordings."""
    fon = _tier(awd, "_FON", "f").select("audio_id", "idx", F.col("mark").alias("_fon"))
    every = _tier(awd, "", "w")
    words = every.where("mark <> ''").join(fon, ["audio_id", "idx"], "left")
    ipa, odd = map_symbols(F.coalesce("_fon", F.lit("")), mapping)
    words = words.select("audio_id", "file", "speaker_id", "identifier", "start", "end", "mark", clean_label(F.col("mark")).alias("label"), ipa.alias("ipa"), odd.alias("_odd"))
    anchors = _tier(ort, "", "a").where("mark <> ''")
    words = words.join(midpoint(anchors, words).withColumnRenamed("span_id", "parent_id"), "identifier", "left")
    ordered = F.array_sort(F.collect_list(F.struct("start", "label")))
    spans = words.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(ordered, lambda x: x["label"]), " ").alias("_joined"))
    phrases = anchors.select("file", "speaker_id", F.col("identifier").alias("parent_id"), clean_label(F.col("mark")).alias("_own")).join(spans, "parent_id")
    phrases = phrases.select("file", "speaker_id", F.col("parent_id").alias("identifier"), "start", "end", F.when(F.col("_own") == "", F.col("_joined")).otherwise(F.col("_own")).alias("label"))

    # phones go to the word tier's interval at their start; unreliable words and markers give none
    segments = _tier(awd, "_SEG", "p").where("mark <> ''")
    owner = as_of(every, segments.select("audio_id", "identifier", F.col("start").alias("at"))).withColumnRenamed("span_id", "word_id")
    marks = every.select(F.col("identifier").alias("word_id"), F.col("mark").alias("_word"))
    segments = segments.join(owner, "identifier", "left").join(marks, "word_id", "left")
    symbol, unknown = map_symbols(F.col("mark"), mapping)
    kind = (
        F.when(F.col("_word").startswith("!") | F.col("mark").startswith("!"), "unreliable")
        .when(F.col("mark").isin("[]", "#"), "skipped_marker")
        .when(F.coalesce(F.col("_word"), F.lit("")) == "", "no_word")
        .when(F.size(unknown) > 0, "unmapped")
        .otherwise("phone")
    )
    segments = segments.withColumn("kind", kind).withColumn("label", symbol).withColumn("_type", phone_type(F.col("label")))
    phones = segments.where("kind = 'phone'").select("file", "speaker_id", "identifier", "word_id", "start", "end", "label", F.when(F.col("_type") != "other", F.col("_type") == "vowel").alias("is_vowel"))

    # maximal onsets where they can be found, else one syllable of all phones with positions unknown
    groups = syllable_groups(phones, "word_id").where("syllable IS NOT NULL").withColumn("fallback", F.lit(False))
    rest = phones.join(groups.select("word_id").distinct(), "word_id", "left_anti")
    whole = F.array_sort(F.collect_list(F.struct("start", "label", "identifier")))
    single = rest.groupBy("word_id").agg(F.lit(0).alias("syllable"), F.array_join(F.transform(whole, lambda x: x["label"]), "").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.transform(whole, lambda x: x["identifier"]).alias("phone_ids")).withColumn("fallback", F.lit(True))
    syllables = groups.withColumn("label", F.replace("label", F.lit(" "), F.lit(""))).unionByName(single.select(*groups.columns)).withColumn("identifier", F.concat_ws("/", "word_id", F.lit("s"), F.col("syllable").cast("string")))
    link = syllables.select(F.col("identifier").alias("parent_id"), "fallback", F.explode("phone_ids").alias("identifier"))
    phones = positions(phones.join(link, "identifier"), "parent_id")
    phones = phones.withColumn("position_code", F.when(F.col("fallback"), F.lit(9)).otherwise(F.col("position_code")).cast("short")).drop("fallback", "valid")
    issues = segments.where("kind <> 'phone'").select("kind", F.col("mark").alias("sample"))
    issues = issues.unionByName(words.select(F.lit("unmapped_ipa").alias("kind"), F.explode("_odd").alias("sample"))).unionByName(syllables.where("fallback").select(F.lit("fallback_syllable").alias("kind"), F.col("label").alias("sample")))
    issues = issues.unionByName(words.where("parent_id IS NULL").select(F.lit("word_outside_phrase").alias("kind"), F.col("label").alias("sample")))
    return {"words": words.drop("mark", "_odd"), "phrases": phrases, "phones": phones, "syllables": syllables, "issues": issues}
