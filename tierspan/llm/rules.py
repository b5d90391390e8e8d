r"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio with a fixed threshold.

Words and word pairs of every document are hashed into `BUCKETS` buckets. Two multinomials are counted over them: one over all
documents, one over the trusted documents alone (labels.quality = 1). A document's score is the mean over its n-grams of
log p(trusted) - log p(raw), so length doesn't matter; every document with a score under `MIN_SCORE` is dropped, without
a random draw.

Defined results: a null text has no word; a text without words scores 0 and fails the base rules; repeated rows are answered
each; without trusted documents both multinomials are the same and every score is 0; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierspan.llm.common import SPACE, marked, materialise

BUCKETS = 1 << 14
MIN_SCORE = -0.15
WINDOW = 5
#: Base rules: fewest words, and the share of words in repeated windows, in percent, that is still accepted.
MIN_WORDS, MAX_REPEATED = 10, 20


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(hashes: Column) -> Column:
    """How many words lie in a window of WINDOW words that is found twice or more.

    Most texts have no such window, which a hash set of the windows' hashes tells; the others sort their windows, so that equal
    ones are neighbours, and add up the words that each such window adds to the one before it.
    """
    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(rows: Column) -> Column:
            same = lambda s, k: F.coalesce(F.get(rows, k)["h"] == s["h"], F.lit(False))
            twice = F.filter(rows, lambda s, k: F.when(k > 0, same(s, k - 1)).otherwise(False) | same(s, k + 1))
            return F.array_sort(F.transform(twice, lambda s: s["i"]))

        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
        total = F.aggregate(let(ordered, places), zero, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(found)) < F.size(found), total).otherwise(0)

    return F.when(F.size(hashes) > WINDOW, let(windows, covered)).otherwise(0).cast("long")


def _grams(hashes: Column) -> Column:
    """Buckets of the words and of the pairs of neighbouring words."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.size(hashes) - 2), lambda i: F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.when(F.size(hashes) > 1, F.concat(single, pair)).otherwise(single)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _counts(texts: DataFrame) -> dict[int, int]:
    """How often each bucket occurs: combined in each task first, and as many rows as there are buckets."""
    grams = texts.select(F.explode(let(_hashes(words_of(F.col("text"))), _grams)).alias("b"))
    return {r["b"]: r["count"] for r in grams.groupBy("b").count().collect()}


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts labelled as good, nearly all of them told by bitmaps where they are read.

    A first bitmap, of the good ids, lets some others through; these ids make a second one. A row that meets the first alone is surely
    good, and the few that meet both are joined with the good ids.
    """
    good = materialise(labels.where("quality = 1").select("doc_id").distinct(), "rules-trusted")
    hits = lambda rows: marked(rows, good, ["doc_id"], [F.col("doc_id")]).where("_hit").drop("_hit")
    wrong = materialise(hits(docs.select("doc_id")).join(good, "doc_id", "left_anti").distinct(), "rules-others")
    flagged = marked(hits(docs.select("doc_id", "text")), wrong, ["doc_id"], [F.col("doc_id")])
    return flagged.where("NOT _hit").select("text").unionByName(flagged.where("_hit").join(good, "doc_id", "left_semi").select("text"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log p(trusted) - log p(raw) of each bucket, with one added to each count."""
    import math

    raw, target = _counts(docs.select("text")), _counts(trusted_texts(docs, labels))
    if not target:
        return [0.0] * BUCKETS
    all_raw, all_target = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    return [math.log((target.get(b, 0) + 1) / all_target) - math.log((raw.get(b, 0) + 1) / all_raw) for b in range(BUCKETS)]


def apply_rules(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """One row per document: base counts, base_failed, score (mean log ratio) and kept. One pass, nothing shuffled."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), words_of(F.col("text")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    model = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # a constant of fixed size, folded once
    sums = lambda hashes: F.struct(
        repeated_words(hashes).alias("n_repeat_words"),
        let(_grams(hashes), lambda grams: F.when(F.size(grams) > 0, F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(model, b)) / F.size(grams)).otherwise(0.0)).alias("score"),
    )
    rows = rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        let(_hashes(F.col("_words")), sums).alias("_sums"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return (
        rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "_sums.n_repeat_words", "_sums.score")
        .withColumn("base_failed", failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= MIN_SCORE)).alias("kept"), "score")
    )


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply_rules(docs, log_ratios(docs, labels))
