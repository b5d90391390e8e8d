"""Staged rows find their place in the hierarchy: links are checked for all rows before any is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspan.operators.writes import require_empty

#: Each level's parent level, and that one's columns with the phrase: a phrase is its own.
ABOVE = {"words": ("phrases", "identifier", "start"), "syllables": ("words", "parent_id", "parent_start"), "phones": ("syllables", "phrase_id", "phrase_start")}


def link(children: DataFrame, parents: DataFrame, level: str) -> DataFrame:
    """`children`, rows of `level` with a parent_id, with the parent's start and, below words, its phrase (their own where it has none).

    Rejected where a parent isn't among `parents`, or is of another audio or, where both are known, of another speaker. Rows whose
    parent_id is null stay as they are.
    """
    _, phrase, phrase_start = ABOVE[level]
    up = parents.select(F.col("identifier").alias("_up"), F.col("start").alias("_start"), F.col("audio_id").alias("_a"), F.col("speaker_id").alias("_s"), F.col(phrase).alias("_p"), F.col(phrase_start).alias("_ps"))
    both = children.join(up, F.col("parent_id") == F.col("_up"), "left")
    require_empty(both.where("parent_id IS NOT NULL AND _up IS NULL").select("identifier"), f"{level} without a parent")
    require_empty(both.where("NOT audio_id <=> _a AND _up IS NOT NULL OR speaker_id <> _s").select("identifier"), f"{level} and their parent differ in audio or speaker")
    made = {"parent_start": F.coalesce("_start", *(["parent_start"] if "parent_start" in children.columns else []))}
    if level != "words":
        own = lambda name: [name] if name in children.columns else []
        made |= {"phrase_id": F.coalesce("_p", *own("phrase_id")), "phrase_start": F.when(F.col("_p").isNotNull(), F.col("_ps")).otherwise(F.col("phrase_start") if own("phrase_start") else F.lit(None))}
    return both.withColumns(made).drop("_up", "_start", "_a", "_s", "_p", "_ps")


def link_trees(staged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All levels linked from phrases down, so what a word takes from its phrase reaches its phones."""
    out = {"phrases": staged["phrases"]}
    for level, (above, _, _) in ABOVE.items():
        out[level] = link(staged[level], out[above], level)
    return out


def replace_children(rows: DataFrame, parents: DataFrame, staged: DataFrame, level: str) -> DataFrame:
    """`rows` of a level with all children of `parents` displaced by `staged`, which must hang on these parents."""
    linked = link(staged, parents, level)
    require_empty(linked.where("parent_id IS NULL").select("identifier"), f"{level} without a parent")
    return rows.join(parents.select(F.col("identifier").alias("_up")), F.col("parent_id") == F.col("_up"), "left_anti").unionByName(linked)
