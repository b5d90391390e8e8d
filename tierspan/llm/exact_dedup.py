"""Exact deduplication by progressive refinement: byte length, then prefix hash, then full hash.

Defined results: a null text counts as empty; texts are equal when identical; of equal texts the row with the largest id
stays (null ids rank lowest). Rows repeated with the same id and text are all marked as kept in the decisions, since they
are one document; `drop_duplicates` returns one of them. Empty tables give empty results; other columns are carried only by
`drop_duplicates`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspan.llm.common import marked, materialise

#: Characters that the prefix hash covers.
PREFIX_CHARS = 256


def _candidates(docs: DataFrame, prefix_chars: int) -> DataFrame:
    """Rows (_len, _pfx) shared by two rows at least.

    One scan leaves a narrow table of lengths and prefix hashes; lengths that occur once drop out of it before prefixes are
    grouped. Both counts combine before the shuffle, so one huge group of copies costs one row a task.
    """
    text = F.coalesce("text", F.lit(""))
    keys = materialise(docs.select(F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_pfx")), "dedup-keys")
    lengths = keys.groupBy("_len").count().where("count > 1").select("_len")
    pairs = keys.groupBy("_len", "_pfx").count()
    return pairs.join(lengths, "_len", "left_semi").where("count > 1").select("_len", "_pfx")


def digests(docs: DataFrame, *, all_rows: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(doc_id, _hit, _sha): the full hash of each row that shares length and prefix with another.

    Survivors of the first two levels are known by a bitmap of bounded size, so unique rows are neither shuffled nor hashed
    in full. `all_rows` hashes every row, for callers that report the digest.
    """
    text = F.coalesce("text", F.lit(""))
    keys = [F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, prefix_chars))]
    flagged = marked(docs.select("doc_id", "text"), materialise(_candidates(docs, prefix_chars), "dedup-candidates"), ["_len", "_pfx"], keys)
    sha = F.sha2(text, 256)
    return flagged.select("doc_id", "_hit", (sha if all_rows else F.when(F.col("_hit"), sha)).alias("_sha"))


def decisions(docs: DataFrame, *, all_digests: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256 (null for unhashed unique rows)."""
    rows = materialise(digests(docs, all_rows=all_digests), "dedup-digests")
    hits = rows.where("_hit")
    groups = hits.groupBy("_sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = materialise(groups, "dedup-groups")  # so that the join below may split a large group
    unique = rows.where("NOT _hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    found = hits.join(groups, "_sha", "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    return unique.unionByName(found)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of `docs`.

    Rows whose id isn't among the dropped ones by the bitmap pass without a shuffle; the rest meet the exact list. Repeated
    rows of one id and text leave one.
    """
    made = materialise(decisions(docs), "dedup-decisions")
    twins = made.where("kept AND group_size > 1").groupBy("doc_id").count().where("count > 1").select("doc_id")
    touched = made.where("NOT kept").select("doc_id").distinct()
    doubtful = materialise(touched.unionByName(twins).distinct(), "dedup-doubtful")
    # the row travels whole, so that no column of the input meets one of ours
    wide = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"))
    flagged = marked(wide, doubtful, ["doc_id"], [F.col("_id")], "_doubt")
    sure = flagged.where("NOT _doubt").select("_row.*")
    # ids alone don't settle ids that occur with several texts, so the exact step compares texts
    groups = made.where("group_size > 1").groupBy(F.col("text_sha256").alias("_sha")).agg(F.max("keep_id").alias("_keep"))
    groups = materialise(groups, "dedup-groups")
    rest = flagged.where("_doubt").withColumn("_sha", F.sha2(F.coalesce("_row.text", F.lit("")), 256)).join(groups, "_sha", "left")
    single = rest.where("_keep IS NULL").select("_row.*")
    stay = rest.where("_keep = _id").dropDuplicates(["_id", "_sha"]).select("_row.*")
    return sure.unionByName(single).unionByName(stay)
