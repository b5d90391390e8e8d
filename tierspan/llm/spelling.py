"""Operator 12: words that are one letter apart, and the frequent spelling that each rare one stands for.

Words are counted over all texts. Bigrams of the words are ordered by how many words hold them. A word's prefix is its three rarest
bigrams with their positions: one edit touches at most two of a word's bigrams (one of the shorter word, where a letter is inserted), so
that two words one edit apart share a bigram of both prefixes, at the same place, or one further on in a longer word. A join on bigram,
position and length brings such words together, letter masks and the edit distance decide within the join, and pairs alone leave it.

Defined cases: null or empty texts have no words; a null doc_id counts as empty text. Repeated rows count as often as they stand there.
A word that holds one bigram several times has all its places in the prefix where one is; so has a word whose third bigram is tied, as the
order is by frequency and then by bigram. Runs of letters may have any length. No words: no rows. Extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspan.llm.common import begin, materialise
from tierspan.llm.hashing import chunks

LEAST_LETTERS, LEAST_COUNT, ERROR_EVERY = 5, 3, 97
PREFIX = 3
#: Bytes of text looked at together, and bytes of a run whose checksum is taken with those of others.
CHUNK, LONG_RUN = 1 << 20, 64
#: Indexed words of one bigram, position and length that one task compares with its probes; those of a more frequent one are dealt out.
BLOCK = 4096

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST = 0xC3  # U+00C0 to U+00FF are the pairs of this byte with another


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in bytes of the maximal runs of letters of the rows that start at `offsets`."""
    inside = _LETTER[raw] | (raw == _FIRST)
    inside[1:] |= raw[:-1] == _FIRST
    step = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    opens, closes = step[:-1] == 1, step[1:] == -1
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(opens)
    return np.searchsorted(offsets, starts, "right") - 1, starts, np.flatnonzero(closes) + 1


def checksums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run of `raw`, carried on from the checksum `before` it."""
    out = np.empty(len(starts), np.uint32)
    lengths = ends - starts
    for k in np.flatnonzero(lengths > LONG_RUN):
        out[k] = zlib.crc32(raw[starts[k] : ends[k]].tobytes(), int(before[k]))
    order = np.argsort(lengths, kind="stable")
    order = order[: np.searchsorted(lengths[order], LONG_RUN, "right")]
    at, sizes, state = starts[order], lengths[order], ~before[order]
    for k in range(int(sizes[-1]) if len(sizes) else 0):
        on = int(np.searchsorted(sizes, k, "right"))
        state[on:] = _CRC[(state[on:] ^ raw[at[on:] + k]) & 0xFF] ^ (state[on:] >> 8)
    out[order] = ~state
    return out


def _count_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids = ["" if x is None else str(x) for x in batch.column("doc_id").to_pylist()]
    for first, last, raw, offsets in chunks(batch.column("text"), CHUNK):
        raw = _LOWER[raw]
        row, starts, ends = runs(raw, offsets)
        if not len(row):
            continue
        before = np.array([zlib.crc32(f"{x}:".encode()) for x in ids[first:last]], np.uint32)
        h = checksums(raw, starts, ends, before[row])
        letters = ends - starts - np.diff(np.searchsorted(np.flatnonzero(raw == _FIRST), np.stack([starts, ends])), axis=0)[0]
        wrong = h % ERROR_EVERY == 0
        changed = []
        for k in np.flatnonzero(wrong & (letters > LEAST_LETTERS)):
            word = raw[starts[k] : ends[k]].tobytes().decode()
            at = int(h[k]) % len(word)
            changed.append(word[:at] + word[at + 1 :])
        plain = ~wrong & (letters >= LEAST_LETTERS)
        # bytes of the plain runs, one after the other
        edge = np.zeros(len(raw) + 1, np.int8)
        edge[starts[plain]] += 1
        edge[ends[plain]] -= 1
        data = raw[np.cumsum(edge[:-1]).astype(bool)]
        places = np.concatenate([[0], np.cumsum((ends - starts)[plain])]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data))
        for found in (words, pa.array(changed, pa.string())):
            counted = found.value_counts()
            yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "n"])


def count_words(documents: DataFrame) -> DataFrame:
    """(word, n): distinct words of at least LEAST_LETTERS letters that occur LEAST_COUNT times or more, after the planted errors."""
    begin(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _count_batch(batch)

    counted = documents.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_mask(word: str) -> int:
    """Which letters stand in a word an odd number of times, in 64 bits: one edit changes at most two of them."""
    mask = 0
    for c in word:
        k = ord(c)
        mask ^= 1 << (k - 97 if 97 <= k <= 122 else 26 + k % 38)
    return mask - (1 << 64) if mask >> 63 else mask


def prefix(word: str, rank: dict[str, int]) -> list[tuple[int, int, int]]:
    """(bigram's rank, position, 1-based place among the word's distinct ranks) of the PREFIX rarest bigrams, with all places of the last."""
    grams = sorted((rank[word[i : i + 2]], i) for i in range(len(word) - 1))
    last = [grams[min(k, len(grams)) - 1][0] for k in range(1, PREFIX + 1)]
    return [(g, i, next(k for k, x in enumerate(last, 1) if g <= x)) for g, i in grams if g <= last[-1]]


def _ranks(words: DataFrame) -> dict[str, int]:
    """Bigrams by the number of words' places that hold them: at most the square of 90 letters."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    rows = grams.groupBy("gram").count().collect()
    return {gram: k for k, (_, gram) in enumerate(sorted((row["count"], row.gram) for row in rows))}


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): each pair of `words` (word, n; distinct, of four letters at least) that differ by one letter inserted, deleted or replaced, once."""
    spark = words.sparkSession
    begin(spark)
    ranks = spark.sparkContext.broadcast(_ranks(words))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("word", "n", "mask", "letters", "gram", "place", "nth")}
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for gram, place, nth in prefix(word, rank):
                    for name, x in zip(out, (word, n, letter_mask(word), len(word), gram, place, nth)):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("word", pa.string()), *[(name, pa.int64()) for name in ("n", "mask")], *[(name, pa.int32()) for name in ("letters", "gram", "place", "nth")]]))

    indexed = materialise(words.mapInArrow(prefixes, "word string, n long, mask long, letters int, gram int, place int, nth int"), "spelling-prefixes")
    hot = indexed.groupBy("gram", "place", "letters").count().where(F.col("count") > BLOCK)
    hot = materialise(hot.select("gram", "place", "letters", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "spelling-hot")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(hot, ["gram", "place", "letters"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))

    right = dealt(indexed).select("gram", "place", "letters", F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("block"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("mask").alias("mask_b"))
    # a word looks for others of its length, and, with its two rarest, for longer ones: the place then is the same or the next
    same = F.array(F.struct(F.col("letters").alias("letters"), F.col("place").alias("place")))
    longer = F.array(*[F.struct((F.col("letters") + 1).alias("letters"), (F.col("place") + k).alias("place")) for k in (0, 1)])
    asked = indexed.withColumn("to", F.explode(F.when(F.col("nth") < PREFIX, F.concat(same, longer)).otherwise(same)))
    asked = asked.select("gram", "to.place", "to.letters", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("mask").alias("mask_a"), F.col("letters").alias("letters_a"))
    asked = dealt(asked).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ["gram", "place", "letters", "block"]
    left, right = asked.alias("l"), right.alias("r")
    met = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    close = (F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2) & ((F.col("letters_a") < F.col("r.letters")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, [*met, close]).select("a", "b", "n_a", "n_b").distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of all words: the near word of largest n, if that is twice the word's n at least."""
    ways = F.array(*[F.struct(F.col(x).alias("word"), F.col(f"n_{x}").alias("n"), F.struct((-F.col(f"n_{y}")).alias("n"), F.col(y).alias("word")).alias("other")) for x, y in ("ab", "ba")])
    near = pairs.select(F.explode(ways).alias("w")).groupBy("w.word").agg(F.count("*").alias("n_near"), F.min("w.other").alias("best"))
    found = words.select("word", "n").join(near, "word", "left")
    counts = -F.col("best.n") >= 2 * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(counts, F.col("best.word")).alias("form"), F.when(counts, -F.col("best.n")).alias("form_n"))


def roots(linked: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the end of each word's forms. A step looks up where the root so far leads, so that k steps reach 2**k forms on."""
    state = linked.select("word", F.col("form").alias("root"))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = materialise(state.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.drop("moved")


def group_variants(documents: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    words = materialise(count_words(documents), "spelling-words")
    found = materialise(forms(words, near_pairs(words)), "spelling-forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
