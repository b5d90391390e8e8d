"""From annotation files to a committed corpus: one job over all recordings that the corpus hasn't got."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspan.operators import resume, staging, writes
from tierspan.operators.intervals import overlap_codes
from tierspan.plans.corpus import Corpus
from tierspan.plans.schema import LEVELS, SCHEMAS
from tierspan.sources import awd


def _fit(df: DataFrame, table: str) -> DataFrame:
    """The columns of a corpus table: cast, and null where `df` lacks one."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def stage(levels: dict[str, DataFrame], dataset: str | None = None, sources: DataFrame | None = None) -> dict[str, DataFrame]:
    """Linked corpus tables from what `awd.build` gives, checkpointed as checks read them several times. A word outside any phrase, which the issues name, stays out with what hangs on it.

    `sources` (file, path, size) tell where recordings come from, for the ledger of imports.
    """
    whose = lambda df: df.withColumn("audio_id", F.col("file"))
    phrases = whose(levels["phrases"]).withColumn("filename", F.col("file"))
    words = whose(levels["words"].where("parent_id IS NOT NULL"))
    owner = words.select(F.col("identifier").alias("word_id"), "audio_id", "speaker_id", F.col("parent_id").alias("phrase_id"))
    syllables = levels["syllables"].join(owner, "word_id").withColumn("parent_id", F.col("word_id"))
    phones = whose(levels["phones"]).join(owner.select("word_id", "phrase_id"), "word_id")
    coded = {name: _fit(df.join(overlap_codes(phrases, df), "identifier"), name).checkpoint() for name, df in zip(LEVELS, (phrases, words, syllables, phones), strict=True)}
    staged = staging.link_trees(coded)
    ends = phrases.groupBy(F.col("audio_id").alias("identifier")).agg(F.max("end").alias("duration")).withColumn("filename", F.col("identifier"))
    links = phrases.select("audio_id", "speaker_id").distinct()
    ledger = resume.signatures(phrases.select(*resume.SIGNATURE))
    if sources is not None:
        ledger = ledger.join(sources.select(F.col("file").alias("audio_id"), F.col("path").alias("source"), "size"), "audio_id", "left")
    return staged | {"imports": _fit(ledger, "imports"), "audios": _fit(ends.withColumn("dataset", F.lit(dataset)), "audios"), "speaker_audio": _fit(links, "speaker_audio")}


def import_pairs(corpus: Corpus, ort: DataFrame, awd_rows: DataFrame, mapping: dict[str, str], speakers: DataFrame | None = None, dataset: str | None = None) -> DataFrame:
    """Add the recordings that aren't stored, all in one commit, and return the report (kind, n, samples) of what was left out.

    `ort` and `awd_rows` are the intervals of `textgrid.read_textgrids` with the recording in `file`; `speakers` has the columns of
    the corpus' speakers, its names being the tiers'. Recordings of bad form are reported and left for another run. A run that ends early leaves the
    corpus as it was; files are parsed once, as what was built from them is checkpointed.
    """
    there = corpus.tables["audios"].select(F.col("identifier").cast("string").alias("file"))
    ort, awd_rows = (rows.join(there, "file", "left_anti").checkpoint() for rows in (ort, awd_rows))
    levels, errors = awd.read_pairs(ort, awd_rows, mapping)
    levels = {name: df.checkpoint() for name, df in levels.items()}
    staged = stage(levels, dataset)
    writes.validate_trees({name: staged[name] for name in LEVELS})
    staged |= _new_speakers(corpus, staged, speakers, dataset)
    corpus.append(staged)
    return writes.report(_issues(levels, errors), "kind", "sample")


def _new_speakers(corpus: Corpus, staged: dict[str, DataFrame], speakers: DataFrame | None, dataset: str | None) -> dict[str, DataFrame]:
    """The speakers of staged recordings that aren't stored."""
    if speakers is None:
        return {}
    used = staged["speaker_audio"].select("speaker_id").distinct()
    rows = _fit(speakers.withColumn("identifier", F.col("name")).withColumn("dataset", F.lit(dataset)), "speakers").join(used, F.col("identifier") == F.col("speaker_id"), "left_semi")
    return {"speakers": writes.new(rows, corpus.tables["speakers"], ["identifier"])}


def _issues(levels: dict[str, DataFrame], errors: DataFrame) -> DataFrame:
    return levels["issues"].select("kind", "sample").unionByName(errors.select(F.col("error").alias("kind"), F.concat_ws(": ", "file", "detail").alias("sample")))


#: How many of the recordings that were imported last are compared with their sources when an import is resumed.
AUDITED = 3


def resume_pairs(corpus: Corpus, sources: DataFrame, ort: DataFrame, awd_rows: DataFrame, mapping: dict[str, str], speakers: DataFrame | None = None, dataset: str | None = None, audit: int = AUDITED) -> DataFrame:
    """Go on with an import, in one commit, and return the report (kind, n, samples).

    `sources` (file, path, size) are all recordings; the ledger tells which of them are stored. What isn't is imported. The last `audit`
    of those that are, in the order of their names, and all whose source has another size, are read again: one whose phrases differ from
    the stored ones is replaced with all that hangs on it, in the same commit; the rest are skipped. Rejected, with nothing written, are
    sources that occur twice or have another path than they were imported from, and audited recordings that can't be read any more.
    """
    writes.require_empty(writes.duplicate_keys(sources, ["file"]), "sources occur twice")
    ledger = corpus.tables["imports"].select(F.col("audio_id").cast("string").alias("audio_id"), F.col("source").alias("_was"), F.col("size").alias("_size"))
    known = sources.join(ledger.withColumnRenamed("audio_id", "file"), "file", "left")
    writes.require_empty(known.where("path <> _was").select("file", "_was", "path"), "sources are elsewhere than they were imported from")
    planned = resume.plan(known.withColumnRenamed("file", "audio_id"), ledger, [F.col("audio_id")], audit)
    changed = (F.col("action") == "skip") & ~F.col("size").eqNullSafe(F.col("_size"))
    planned = planned.select(F.col("audio_id").alias("file"), F.when(changed, "audit").otherwise(F.col("action")).alias("action")).checkpoint()
    work, audits = planned.where("action <> 'skip'").select("file"), planned.where("action = 'audit'").select("file")

    ort, awd_rows = (rows.join(work, "file", "left_semi").checkpoint() for rows in (ort, awd_rows))
    levels, errors = awd.read_pairs(ort, awd_rows, mapping)
    errors = errors.checkpoint()
    read = ort.select("file").distinct().join(awd_rows.select("file").distinct(), "file")
    lost = audits.join(read, "file", "left_anti").select("file", F.lit("no intervals").alias("error")).unionByName(errors.join(audits, "file", "left_semi").select("file", "error"))
    writes.require_empty(lost, "audited recordings can't be read")
    levels = {name: df.checkpoint() for name, df in levels.items()}
    staged = stage(levels, dataset, sources)
    writes.validate_trees({name: staged[name] for name in LEVELS})

    checked = audits.select(F.col("file").cast("binary").alias("audio_id"))
    repaired = resume.differing(corpus.tables["phrases"].join(checked, "audio_id", "left_semi"), staged["phrases"].join(checked, "audio_id", "left_semi")).checkpoint()
    fine = checked.join(repaired, "audio_id", "left_anti").select(F.col("audio_id").alias("_fine"))
    key = lambda name: "identifier" if name == "audios" else "audio_id"
    rows = {name: df.join(fine, F.col(key(name)) == F.col("_fine"), "left_anti") for name, df in staged.items()}
    rows |= _new_speakers(corpus, rows, speakers, dataset)

    def change(part: dict[str, DataFrame]) -> dict[str, DataFrame]:
        gone = repaired.select(F.col("audio_id").alias("_gone"))
        return {name: (df if name == "speakers" else df.join(gone, F.col(key(name)) == F.col("_gone"), "left_anti")).unionByName(rows[name]) for name, df in part.items()}

    corpus.rewrite(repaired, list(rows), change)
    mended = repaired.select(F.col("audio_id").cast("string").alias("file"))
    names = F.when(F.col("action") == "import", "recordings_saved").when(F.col("action") == "skip", "recordings_skipped").when(F.col("_mended"), "recordings_repaired").otherwise("recordings_audited")
    done = planned.join(errors.select("file").distinct(), "file", "left_anti").join(mended.withColumn("_mended", F.lit(True)), "file", "left").select(names.alias("kind"), F.col("file").alias("sample"))
    return writes.report(done.unionByName(_issues(levels, errors)), "kind", "sample")
