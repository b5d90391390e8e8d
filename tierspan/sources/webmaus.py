"""Alignments of single utterances, one TextGrid each: which are to be loaded, and their load into a corpus by policy.

An utterance record (`utterances.utterances`) names its TextGrid, its audio, its speaker's tier and when it starts in the recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspan.operators import staging, writes
from tierspan.plans.corpus import Corpus
from tierspan.plans.schema import LEVELS, SCHEMAS
from tierspan.sources import textgrid

TIERS = ["ORT-MAU", "KAN-MAU", "MAS", "MAU"]


def named(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(name, identifier) of each name once, with the smallest id, and the names that occur more than once (name, n)."""
    counted = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min("identifier").alias("identifier"), F.count(F.lit(1)).alias("n"))
    return counted.select("name", "identifier"), counted.where("n > 1").select("name", "n")


def load_status(records: DataFrame, files: DataFrame, speakers: DataFrame, audios: DataFrame, loaded: DataFrame) -> DataFrame:
    """`records` with audio_id, speaker_id, status and detail.

    A record whose TextGrid (output_filename) isn't among `files` (path) is `no_textgrid`; one whose speaker (tier_name) or audio
    (audio_filename) isn't stored is an `error`, told in detail; one whose TextGrid is among `loaded` (filename) is `skipped`; the others
    are `added`. Of names that several rows have, the smallest id counts.
    """
    who, _ = named(speakers, "name")
    what, _ = named(audios, "filename")
    out = records.join(files.select(F.col("path").alias("output_filename"), F.lit(True).alias("_there")).distinct(), "output_filename", "left")
    out = out.join(who.select(F.col("name").alias("tier_name"), F.col("identifier").alias("speaker_id")), "tier_name", "left")
    out = out.join(what.select(F.col("name").alias("audio_filename"), F.col("identifier").alias("audio_id")), "audio_filename", "left")
    out = out.join(loaded.select(F.col("filename").alias("output_filename"), F.lit(True).alias("_loaded")).distinct(), "output_filename", "left")
    lacking = F.concat_ws(" and ", F.when(F.col("speaker_id").isNull(), "speaker"), F.when(F.col("audio_id").isNull(), "audio"))
    status = F.when(F.col("_there").isNull(), "no_textgrid").when(lacking != "", "error").when(F.col("_loaded"), "skipped").otherwise("added")
    detail = F.when((status == "error"), F.concat(F.lit("no such "), lacking))
    return out.select(*records.columns, "audio_id", "speaker_id", status.alias("status"), detail.alias("detail"))


def errors(intervals: DataFrame) -> DataFrame:
    """(file, error, detail) of TextGrids that are damaged, lack a tier, or whose words and transcriptions aren't the same intervals."""
    damaged = intervals.where("tier = '!error'").select("file", F.lit("damaged file").alias("error"), F.col("mark").alias("detail"))
    whole = intervals.where("tier <> '!error'")
    lacking = textgrid.missing_tiers(whole, TIERS).select("file", F.lit("missing tier").alias("error"), F.col("tier").alias("detail"))
    apart = textgrid.zip_tiers(whole, *TIERS[:2]).where("NOT aligned").groupBy("file").agg(F.min("idx").alias("idx"))
    return damaged.unionByName(lacking).unionByName(apart.join(lacking.select("file"), "file", "left_anti").select("file", F.lit("words and transcriptions differ").alias("error"), F.concat(F.lit("interval "), F.col("idx").cast("string")).alias("detail")))


def stage(intervals: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """Linked corpus levels of TextGrids in good form; `sources` (file, audio_id, speaker_id, offset in seconds, several) tell whose they are.

    Phrases know no overlap where the recording has one speaker, else that is undecided. Phones and syllables outside what should hold
    them keep a null parent and get the phrase.
    """
    timed = intervals.join(sources.select("file", "offset"), "file")
    levels = textgrid.aligned_levels(timed, F.col("offset"))
    owner = sources.select(F.col("file").alias("_file"), F.col("audio_id").alias("_audio"), "speaker_id", F.when(F.col("several"), 9).otherwise(0).alias("overlap_code"))
    out = {}
    for name, df in levels.items():
        df = df.join(owner, F.col("audio_id") == F.col("_file")).withColumns({"filename": F.col("_file"), "audio_id": F.col("_audio")})
        out[name] = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])
    starts = out["phrases"].select(F.col("identifier").alias("_p"), F.col("start").alias("_ps"))
    for name in LEVELS[2:]:
        # what hangs on no word or syllable takes the phrase's start from the phrase
        out[name] = out[name].join(starts, F.col("phrase_id") == F.col("_p"), "left").withColumn("phrase_start", F.col("_ps")).drop("_p", "_ps")
    return staging.link_trees(out)


POLICIES = ("append", "skip", "replace")


def load(corpus: Corpus, records: DataFrame, intervals: DataFrame, existing: str = "skip") -> DataFrame:
    """Load the alignments of utterance records in one commit, and return the report (kind, n, samples).

    `intervals` are those of `textgrid.read_textgrids`, with the records' output_filename in `file`. What is stored already is skipped,
    replaced with all that hangs on it, or, with `append`, added once more, which is rejected as its ids are there. Bad files and
    records without a speaker or audio are reported and left out.
    """
    if existing not in POLICIES:
        raise ValueError(f"existing is one of {', '.join(POLICIES)}")
    files = intervals.select(F.col("file").alias("path")).distinct()
    # only the phrases' own names are read of what is stored
    found = load_status(records, files, corpus.tables["speakers"], corpus.tables["audios"], corpus.tables["phrases"].select("filename")).checkpoint()
    bad = errors(intervals).checkpoint()
    take = found.where(F.col("status").isin("added", *([] if existing == "skip" else ["skipped"]))).join(bad.select(F.col("file").alias("output_filename")).distinct(), "output_filename", "left_anti")
    writes.require_empty(writes.duplicate_keys(take, ["output_filename"]), "several records have one TextGrid")
    sources = take.select(F.col("output_filename").alias("file"), "audio_id", "speaker_id", F.col("start_time").alias("offset"), (F.size("speaker_ids_audio") > 1).alias("several")).checkpoint()
    staged = {name: df.checkpoint() for name, df in stage(intervals, sources).items()}
    links = sources.select("speaker_id", "audio_id").distinct()
    audios = sources.select("audio_id").distinct()

    def change(part: dict[str, DataFrame]) -> dict[str, DataFrame]:
        stored = {name: part[name] for name in LEVELS}
        if existing == "replace":
            old = stored["phrases"].join(sources.select(F.col("file").alias("_f")), F.col("filename") == F.col("_f"), "left_semi")
            stored = writes.delete_phrases(stored, old)
        writes.require_none(writes.tree_violations(staged, stored))
        writes.require_empty(writes.existing(staged["phrases"].select("identifier"), stored["phrases"], ["identifier"]), "phrases are stored already")
        return {name: stored[name].unionByName(staged[name]) for name in LEVELS} | {"speaker_audio": writes.link_speakers(part["speaker_audio"], links)}

    corpus.rewrite(audios, [*LEVELS, "speaker_audio"], change)
    told = found.select(F.col("status").alias("kind"), F.col("output_filename").alias("sample")).unionByName(bad.select(F.col("error").alias("kind"), F.concat_ws(": ", "file", "detail").alias("sample")))
    return writes.report(told, "kind", "sample")
