r"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score = sigmoid(w0 + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j). The pairwise sum is scored in time linear in a document's
features: half the sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2.

Features: words hashed into `BUCKETS` (logarithmic counts of unit length), and structure statistics of the text and its
n_chars column, each as a standardised value and as one of `BINS` bins. The model is fitted on at most `TRAIN_ROWS` labelled rows,
those with the smallest hash of their id; scoring reads every whole text once and shuffles nothing.

Defined results: a null text counts as empty, and empty texts get a score from their statistics; a null or missing n_chars counts
as the text's own length; of several labels of one id the largest counts, null labels don't; without labels every score is the
prior 0.99; repeated rows are answered each; an empty table gives no row; lang, source and the id are never read as features. An n_chars that is no number counts as missing. The driver holds the features of
the training rows: 8 bytes for each bucket a text has, 262 kB a row at worst, some 3 kB for texts of ordinary length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierspan.llm import hashing
from tierspan.llm.common import begin

BUCKETS, FACTORS, BINS = 1 << 15, 8, 8
TRAIN_ROWS = 8000
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 128, 0.08, 1e-5, 7
THRESHOLD = 0.7
STATISTICS = ("log_words", "word_bytes", "upper", "digits", "symbols", "stops", "bangs", "high", "lines", "distinct", "top_word", "next_same", "windows", "log_chars", "long_words", "bars")
SAMPLE = "label int, idx binary, val binary, stats binary"


def _byte_sets() -> np.ndarray:
    """Rows of byte classes that statistics count."""
    groups = (range(65, 91), range(48, 58), b"#*$%&<>", b".,", b"!?", range(128, 256), b"\n", b"|")
    out = np.zeros((len(groups), 256), dtype=np.int64)
    for k, group in enumerate(groups):
        out[k, list(group)] = 1
    return out


_CLASSES = _byte_sets()


def features(texts: pa.Array, n_chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: (first, last, row, bucket, value, statistics); row counts from `first`."""
    for first, last, raw, offsets in hashing.chunks(texts):
        n = last - first
        hashes, row, starts, ends = hashing.words(raw, offsets)
        bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        pairs, counts = np.unique(row * BUCKETS + bucket, return_counts=True)
        at, value = pairs // BUCKETS, np.log1p(counts.astype(float))
        norm = np.sqrt(np.bincount(at, value * value, n))
        value = value / norm[at]

        n_words = np.bincount(row, minlength=n).astype(float)
        some, size = np.maximum(n_words, 1), np.maximum(np.diff(offsets), 1).astype(float)
        by_class = [np.diff(np.concatenate([[0], np.cumsum(c[raw])])[offsets]) / size for c in _CLASSES]
        _, at_word, often = np.unique(_of_row(hashes, row), return_index=True, return_counts=True)
        who = row[at_word]
        most = np.zeros(n)
        np.maximum.at(most, who, often.astype(float))
        same = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
        window, whose = _windows(hashes, row)
        n_windows = np.bincount(whose, minlength=n).astype(float)
        kinds = whose[np.unique(_of_row(window, whose), return_index=True)[1]]
        length = ends - starts
        own = (size if n_chars is None else np.where(np.isnan(n_chars[first:last]), size, n_chars[first:last])).astype(float)
        upper, digits, symbols, stops, bangs, high, lines, bars = by_class
        stats = np.stack([
            np.log1p(n_words), np.bincount(row, length, n) / some, upper, digits, symbols, stops, bangs, high, lines,
            np.bincount(who, minlength=n) / some, most / some, np.bincount(row[1:][same], minlength=n) / some,
            1 - np.bincount(kinds, minlength=n) / np.maximum(n_windows, 1), np.log1p(np.maximum(own, 0)), np.bincount(row, length > 24, n) / some, bars,
        ], axis=1)
        yield first, last, at, pairs % BUCKETS, value, stats


def _of_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One hash of a row and a hash in it."""
    return hashing.mix(hashes ^ hashing.mix(row.astype(np.uint64) + np.uint64(1)))


def _windows(hashes: np.ndarray, row: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = row[n - 1 :] == row[: len(row) - n + 1]
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
    return out[inside], row[: len(row) - n + 1][inside]


def _column(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).to_numpy(zero_copy_only=False)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, rows = batch.column(2).to_pylist(), []
        for first, last, row, bucket, value, stats in features(batch.column(0), _column(batch)):
            cut = np.searchsorted(row, np.arange(last - first + 1))
            for k in range(last - first):
                part = slice(cut[k], cut[k + 1])
                rows.append((labels[first + k], bucket[part].astype(np.int32).tobytes(), value[part].astype(np.float32).tobytes(), stats[k].tobytes()))
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["label", "idx", "val", "stats"])


class Model:
    """Weights, factors and what standardises the statistics."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        n, k = len(rows), len(STATISTICS)
        y = np.array([r[0] for r in rows], dtype=float)
        stats = np.stack([r[3] for r in rows]) if n else np.zeros((0, k))
        self.mean = stats.mean(0) if n else np.zeros(k)
        self.spread = np.maximum(stats.std(0), 1e-6) if n else np.ones(k)
        self.edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if n else np.zeros((k, BINS - 1))
        size = BUCKETS + k + k * BINS
        rng = np.random.default_rng(SEED)
        prior = float(np.clip((y.sum() + 1) / (n + 1), 0.01, 0.99))
        self.w0, self.w, self.v = np.log(prior / (1 - prior)), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
        if n and 0 < y.sum() < n:
            self._fit(rows, y, stats, rng)
        else:
            self.v[:] = 0

    def dense(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values) of the statistics' features, a row for each text."""
        n, k = stats.shape
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) / np.sqrt(k)
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(k)], axis=1) if n else np.zeros((0, k), np.int64)
        idx = np.concatenate([np.broadcast_to(BUCKETS + np.arange(k), (n, k)), BUCKETS + k + np.arange(k) * BINS + bins], axis=1)
        return idx, np.concatenate([scaled, np.full((n, k), 1 / np.sqrt(k))], axis=1)

    def margins(self, n: int, row: np.ndarray, idx: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores before the sigmoid, sums of v_if x_i) of n rows."""
        vx = self.v[idx] * x[:, None]
        sums = np.stack([np.bincount(row, vx[:, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(row, (vx * vx).sum(1), n)
        return self.w0 + np.bincount(row, self.w[idx] * x, n) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def _fit(self, rows, y, stats, rng) -> None:
        didx, dval = self.dense(stats)
        gw, gv = np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8)
        for epoch in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                idx = np.concatenate([np.concatenate([rows[i][1], didx[i]]) for i in some])
                x = np.concatenate([np.concatenate([rows[i][2], dval[i]]) for i in some])
                row = np.repeat(np.arange(len(some)), [len(rows[i][1]) + didx.shape[1] for i in some])
                z, sums = self.margins(len(some), row, idx, x)
                error = (1 / (1 + np.exp(-z)) - y[some]) / len(some)
                self.w0 -= RATE * error.sum()
                used, inverse = np.unique(idx, return_inverse=True)
                ex = error[row] * x
                grad = np.bincount(inverse, ex, len(used)) + DECAY * self.w[used]
                gw[used] += grad * grad
                self.w[used] -= RATE * grad / np.sqrt(gw[used])
                each = ex[:, None] * (sums[row] - self.v[idx] * x[:, None])
                grad = np.stack([np.bincount(inverse, each[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * self.v[used]
                gv[used] += grad * grad
                self.v[used] -= 0.25 * RATE * grad / np.sqrt(gv[used])

    def score(self, texts: pa.Array, n_chars: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, last, row, bucket, value, stats in features(texts, n_chars):
            n = last - first
            didx, dval = self.dense(stats)
            rows = np.concatenate([row, np.repeat(np.arange(n), didx.shape[1])])
            z, _ = self.margins(n, rows, np.concatenate([bucket, didx.ravel()]), np.concatenate([value, dval.ravel()]))
            out[first:last] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out


def held_out() -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _n_chars(docs: DataFrame) -> Column:
    """The column as a number; anything else counts as missing."""
    return F.col("n_chars").cast("string").try_cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def _texts(docs: DataFrame) -> list[Column]:
    return [F.coalesce("text", F.lit("")).alias("text"), _n_chars(docs).alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` labelled rows that aren't held out; the driver gets their features, a bounded amount."""
    begin(docs.sparkSession)
    known = labels.where("quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select(F.col("doc_id").alias("_id"), *_texts(docs)).join(F.broadcast(chosen), F.col("_id") == F.col("doc_id"))
    found = sample.orderBy(F.xxhash64("_id", "text"), "_id").limit(rows).select("text", "n_chars", "_label").mapInArrow(_featurise, SAMPLE).toArrow().to_pylist()
    found.sort(key=lambda r: (r["stats"], r["idx"]))
    return Model([(r["label"], np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32), np.frombuffer(r["stats"])) for r in found])


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(2), batch.column(3), pa.array(model.value.score(batch.column(0), _column(batch)))], names=["doc_id", "held_out", "score"])

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(*_texts(docs), "doc_id", held_out().alias("held_out"))
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with all columns. One pass: the score is made beside the row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(model.value.score(batch.column(0), _column(batch)) >= THRESHOLD)
            yield pa.RecordBatch.from_arrays(batch.columns[2:], names=names).filter(keep)

    names = docs.columns
    columns = [*_texts(docs), *[F.col(f"`{c}`") for c in names]]
    return docs.select(*[c.alias(f"_{k}") for k, c in enumerate(columns)]).mapInArrow(accepted, docs.schema)
