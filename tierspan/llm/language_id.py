"""Operator 13: language of a text, by the probability of its words summed over all their segmentations.

Each language has a probability for each piece of a fixed public vocabulary (its lower-case letter pieces, the mark of a word's start
included). A word's probability is the sum over all ways to cut it into pieces, found by a forward pass over its letters; a text's is the
product over its words, times the share of its language among the learned texts. Words are counted by language over all learned texts, by
task and then by a grouped shuffle. Learning then alternates forward and backward passes over the distinct words with counting: pieces
are counted by their posterior in all segmentations, first with equal probabilities, then with those of each language. Only (languages x
pieces) numbers come to the driver and are broadcast.

Words are maximal runs of Unicode letters, lower-cased letter by letter; a run of more than WINDOW letters counts as several words of
WINDOW letters. A letter outside the vocabulary has one small probability that is the same in all languages.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text where nothing was learned. Ties go to the
language that is first in code-point order. A null doc_id counts as empty text where documents are held out. Repeated rows are learned from
as often as they stand there and get a row each. Texts may have any length. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierspan.llm.common import begin, materialise

VOCABULARY = "piece_bpe_32k.model"
UNDETERMINED = "und"
ROUNDS, SMOOTHING, WINDOW = 2, 0.05, 40
#: Characters of text looked at together, and probabilities (words x languages) held at a place of them.
CHUNK, CELLS = 1 << 20, 1 << 17
#: Distinct words of the learned texts that are looked at together.
HELD_WORDS = 1 << 16
#: Counts are summed as integers of this fraction, so that their order doesn't matter.
UNIT = 1 << 20
_START = "▁"
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SLOT_BITS = 18
_TABLES: list[np.ndarray] = []


def _characters() -> list[np.ndarray]:
    """(is a letter, its lower-case letter) by code point."""
    if not _TABLES:
        every = [chr(k) for k in range(0x110000)]
        lower = (c.lower() for c in every)
        _TABLES[:] = [np.array([c.isalpha() for c in every]), np.array([ord(x) if len(x) == 1 else k for k, x in enumerate(lower)], np.uint32)]
    return _TABLES


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by number, found by the hash of their letters; the number after the last piece is a letter outside the vocabulary."""

    pieces: list[str]
    keys: np.ndarray
    numbers: np.ndarray
    longest: int

    @staticmethod
    def of(pieces: list[str]) -> Vocabulary:
        keys, numbers = np.zeros(1 << _SLOT_BITS, np.uint64), np.full(1 << _SLOT_BITS, -1, np.int32)
        if 2 * len(pieces) > len(keys):
            raise ValueError(f"at most {len(keys) // 2} pieces")
        for number, piece in enumerate(pieces):
            h = _hash(piece)
            slot = ((h * int(_SPREAD)) & 0xFFFFFFFFFFFFFFFF) >> (64 - _SLOT_BITS)
            while numbers[slot] >= 0:
                slot = (slot + 1) % len(keys)
            keys[slot], numbers[slot] = h, number
        return Vocabulary(pieces, keys, numbers, max(map(len, pieces), default=1))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for none."""
        slot = ((hashes * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = self.numbers[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            out[open_] = self.numbers[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot[open_]] != hashes[open_])]
        return out


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """The lower-case letter pieces of a sentencepiece model."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    return Vocabulary.of([x for x in pieces if x == _START or x.removeprefix(_START).isalpha() and x == x.lower()])


@dataclass(frozen=True)
class Words:
    """The distinct words of some texts, the longest first: their letters, and which word stands at each place, in which text."""

    letters: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    which: np.ndarray
    row: np.ndarray

    def spelled(self) -> list[str]:
        """The distinct words as strings."""
        ends = np.cumsum(self.lengths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts - (ends - self.lengths), self.lengths)
        text = self.letters[places].tobytes().decode("utf-32-le")
        return [text[a:b] for a, b in zip((ends - self.lengths).tolist(), ends.tolist())]


def words(texts: list[str]) -> Words:
    is_letter, lower = _characters()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
    inside = is_letter[points]
    step = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(starts) and (ends - starts).max() > WINDOW:
        parts = -(-(ends - starts) // WINDOW)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * WINDOW
        ends = np.minimum(np.repeat(ends, parts), starts + WINDOW)
    lengths, letters = (ends - starts).astype(np.int16), lower[points]
    order = np.argsort(-lengths, kind="stable")
    at, falling = starts[order], -lengths[order]
    h = np.zeros(len(order), np.uint64)
    for k in range(-int(falling[0]) if len(order) else 0):
        on = int(np.searchsorted(falling, -k, "left"))
        h[:on] = h[:on] * _BASE + letters[at[:on] + k]
    coded = pa.array(h).dictionary_encode()
    inverse = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[inverse[::-1]] = np.arange(len(order))[::-1]
    which = np.empty(len(order), np.int64)
    which[order] = inverse
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return Words(letters, at[first], -falling[first].astype(np.int64), which, np.searchsorted(offsets, starts, "right") - 1)


class Lattice:
    """All pieces within a block of words, sorted by falling length: which words have which piece from letter i to letter j."""

    def __init__(self, found: Words, first: int, last: int, vocabulary: Vocabulary) -> None:
        starts, self.lengths = found.starts[first:last], found.lengths[first:last] + 1
        longest = int(self.lengths[0])
        self.active = [int(np.searchsorted(-self.lengths, -j, "right")) for j in range(longest + 1)]
        self.longer = [*self.active[1:], 0]
        hashes = [np.zeros(last - first, np.uint64)]
        for j in range(1, longest + 1):
            n = self.active[j]
            letter = found.letters[starts[:n] + j - 2] if j > 1 else np.uint64(ord(_START))
            hashes.append(hashes[-1][:n] * _BASE + letter)
        #: (i, j, words, pieces)
        self.arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for j in range(1, longest + 1):
            n = self.active[j]
            for i in range(j - 1, max(-1, j - 1 - vocabulary.longest), -1):
                power = np.uint64(pow(int(_BASE), j - i, 1 << 64))
                piece = vocabulary.find(hashes[j] - hashes[i][:n] * power)
                if i == j - 1:
                    piece[piece < 0] = len(vocabulary.pieces)
                rows = np.flatnonzero(piece >= 0)
                if len(rows):
                    self.arcs.append((i, j, rows, piece[rows]))

    def forward(self, chances: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(sums up to each letter, sums of whole words) over all segmentations, by language: words x languages."""
        sums = [np.ones((self.active[0], chances.shape[1]))] + [np.zeros((n, chances.shape[1])) for n in self.active[1:]]
        for i, j, rows, piece in self.arcs:
            sums[j][rows] += sums[i][rows] * chances[piece]
        whole = np.empty((self.active[0], chances.shape[1]))
        for j, n in enumerate(self.active):
            whole[self.longer[j] : n] = sums[j][self.longer[j] :]
        return sums, whole

    def expected(self, chances: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How often each piece stands in a segmentation, by language of `weights` (words x languages); chances may have one column for all."""
        sums, whole = self.forward(chances)
        back = [np.zeros((n, chances.shape[1])) for n in self.active]
        for j in range(len(back)):
            back[j][self.longer[j] :] = 1.0
        share, pieces, counts = weights / whole, [], []
        for i, j, rows, piece in reversed(self.arcs):
            onward = chances[piece] * back[j][rows]
            back[i][rows] += onward
            pieces.append(piece)
            counts.append(sums[i][rows] * onward * share[rows])
        piece, count = np.concatenate(pieces), np.concatenate(counts)
        return np.stack([np.bincount(piece, count[:, k], len(chances)) for k in range(weights.shape[1])], axis=1)


def _blocks(found: Words, languages: int) -> Iterator[tuple[int, int]]:
    size = max(1, CELLS // max(1, languages))
    for first in range(0, len(found.starts), size):
        yield first, min(first + size, len(found.starts))


def _parts(text: str) -> Iterator[str]:
    """A text in parts of at most CHUNK characters, cut behind white space where there is any."""
    at = 0
    while len(text) - at > CHUNK:
        end = max(text.rfind(" ", at, at + CHUNK), text.rfind("\n", at, at + CHUNK)) + 1
        end = end if end > at else at + CHUNK
        yield text[at:end]
        at = end
    yield text[at:]


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, parts of their texts) of some CHUNK characters."""
    rows: list[int] = []
    group: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        for part in _parts(text or ""):
            rows.append(row)
            group.append(part)
            size += len(part)
            if size >= CHUNK:
                yield rows, group
                rows, group, size = [], [], 0
    if rows:
        yield rows, group


@dataclass(frozen=True)
class Model:
    """Languages in code-point order, the logarithm of their share of learned texts, and chances of pieces (pieces + 1 x languages)."""

    vocabulary: Vocabulary
    languages: list[str]
    shares: np.ndarray
    chances: np.ndarray


def count_words(texts: DataFrame, languages: list[str]) -> DataFrame:
    """(word, lang, n): how often each word stands in the texts of a language, which is given by its number. Counted in each task, then over all."""
    number = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for rows, group in _groups(batch.column("text").to_pylist()):
                found = words(group)
                cells, n = np.unique(found.which * len(number) + langs[np.array(rows)][found.row], return_counts=True)
                spelled = pa.array(found.spelled(), pa.string()).take(pa.array(cells // len(number)))
                yield pa.RecordBatch.from_arrays([spelled, pa.array((cells % len(number)).astype(np.int32)), pa.array(n)], ["word", "lang", "n"])

    return texts.select("text", "lang").mapInArrow(count, "word string, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def _round(counted: DataFrame, model: Model) -> np.ndarray:
    """Expected counts of pieces by language in the words of `counted` (word, lang, n)."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = len(model.languages)
        total = np.zeros((len(model.chances), languages))

        def add(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held)
            found, lang, n = words(rows["word"].to_pylist()), rows["lang"].to_numpy(), rows["n"].to_numpy()
            weights = np.bincount(found.which * languages + lang[found.row], n[found.row], len(found.starts) * languages).reshape(-1, languages)
            for first, last in _blocks(found, languages):
                total[:] += Lattice(found, first, last, model.vocabulary).expected(model.chances, weights[first:last])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= HELD_WORDS:
                add(held)
                held = []
        if held:
            add(held)
        # letters outside the vocabulary, the last number, aren't learned
        piece, lang = np.nonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(np.rint(total[piece, lang] * UNIT).astype(np.int64))], ["lang", "piece", "count"])

    merged = counted.mapInArrow(expect, "lang int, piece int, count long").groupBy("lang", "piece").agg(F.sum("count").alias("count")).toPandas()
    counts = np.zeros((len(model.vocabulary.pieces), len(model.languages)))
    counts[merged["piece"].to_numpy(), merged["lang"].to_numpy()] = merged["count"].to_numpy() / UNIT
    return counts


def learn(texts: DataFrame, vocabulary: Vocabulary | None = None, rounds: int = ROUNDS) -> Model:
    """A model of all rows of `texts` (text, lang) that have both."""
    begin(texts.sparkSession)
    vocabulary = vocabulary or load_vocabulary()
    texts = texts.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    shares = sorted((row.lang, row["count"]) for row in texts.groupBy("lang").count().collect())
    n, size = np.array([x for _, x in shares], float), len(vocabulary.pieces)
    model = Model(vocabulary, [x for x, _ in shares], np.log(n / n.sum()), np.full((size + 1, 1), 1 / size))
    if not shares:
        return model
    counted = materialise(count_words(texts, model.languages), "language-words")
    for _ in range(rounds):
        counts = _round(counted, model)
        chances = (1 - SMOOTHING) * counts / np.maximum(counts.sum(axis=0), 1 / UNIT) + SMOOTHING / size
        model = Model(vocabulary, model.languages, model.shares, np.vstack([chances, np.full(len(shares), SMOOTHING / size)]))
    return model


def likelihoods(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(how many words, the logarithm of the chance of all of them and the language: texts x languages)."""
    n, k = len(texts), len(model.languages)
    counts, total = np.zeros(n, np.int64), np.zeros((n, k))
    for rows, group in _groups(texts):
        found = words(group)
        row = np.array(rows)[found.row] if len(found.row) else found.row
        logs = np.zeros((len(found.starts), k))
        for first, last in _blocks(found, k):
            logs[first:last] = np.log(Lattice(found, first, last, model.vocabulary).forward(model.chances)[1])
        counts += np.bincount(row, minlength=n)
        for lang in range(k):
            total[:, lang] += np.bincount(row, logs[found.which, lang], n)
    return counts, total + model.shares


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the likeliest language and its posterior."""
    begin(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            if model.languages:
                counts, total = likelihoods(batch.column("text").to_pylist(), model)
                best = total.argmax(axis=1)
                posterior = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
            else:
                counts, best, posterior = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            known = counts > 0
            names = [model.languages[k] if is_known else UNDETERMINED for k, is_known in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, posterior, 0.0))], ["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(score, f"doc_id {dict(documents.dtypes)['doc_id']}, lang_pred string, score double")


def held_out() -> Column:
    """Whether a document is kept from learning."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def identify(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those that aren't held out."""
    model = learn(documents.where(~held_out()))
    return predict(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
