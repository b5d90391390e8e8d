"""Operator 11: vectors as short codes. Each of a few consecutive parts of a vector is named by its nearest codebook entry.

Components become integers, so that distances, sums and means are exact and the same wherever they are computed. Codebooks (parts x
entries x components of a part) are broadcast; Arrow batches expand |x - y|**2 to |x|**2 - 2xy + |y|**2 with one integer matrix product
a part. Every task sums the parts of each entry on its own, one row an entry and task; a grouped shuffle adds those up each round.

Defined cases: a vector that is null, or holds a null or non-finite component, is left out; so is one whose length differs from that of
the first vector, by vec_id, with a length that is a positive multiple of the number of parts. Components beyond +-LIMIT / 1024 count as
that bound, so that no distance or sum overflows. An id that stands in several rows counts once in the first codebook, with its smallest
vector; rows with a null id are coded but start no codebook. Rows keep their own codes, repeated ones too. With fewer ids than entries
the codebooks are that short. No vectors: no rows. Labels may be null; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspan.llm.common import begin, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest absolute integer component: differences squared stay below 2**50, so that 8192 of them, and sums of 2**39 components, fit a long.
LIMIT = 1 << 24


@dataclass(frozen=True)
class Codebooks:
    """Integer entries by part, entry and position within the part."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        """Length of the vectors that these codebooks are for."""
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of all components as decimal text, comma-joined by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def components(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their integer components as rows x width) of a column of lists."""
    rows = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width)
    values = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    finite = np.isfinite(values).all(axis=1)
    return rows[finite], np.clip(np.floor(values[finite] * SCALE), -LIMIT, LIMIT).astype(np.int64)


def nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest row of y, the first of equals, for each row of x."""
    distances = x @ (y.T * np.int64(-2))
    distances += (y * y).sum(axis=1)
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(x)), best] + (x * x).sum(axis=1)


def _width(vectors: DataFrame, parts: int) -> int | None:
    """Length of the vectors that are coded."""
    first = _whole(vectors).where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).select("vec_id", F.size("embedding").alias("n"))
    row = first.agg(F.min(F.struct(F.col("vec_id").isNull().alias("late"), "vec_id", "n")).alias("m")).first()
    return row.m.n if row.m else None


def _whole(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has neither null nor non-finite components."""
    return vectors.where(F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)))


def first_codebooks(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors with the smallest ids. At most `entries` rows come to the driver."""
    narrow = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == width))
    # ids first, so that whole vectors of these ids alone are shuffled
    ids = _whole(narrow).select("vec_id").distinct().orderBy("vec_id").limit(entries)
    seeds = _whole(narrow).join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").collect()
    x = np.array([row.embedding for row in seeds], np.float64).reshape(len(seeds), width)
    x = np.clip(np.floor(x * SCALE), -LIMIT, LIMIT).astype(np.int64)
    return Codebooks(np.ascontiguousarray(x.reshape(len(seeds), parts, width // parts).transpose(1, 0, 2)))


def refine(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, and each entry becomes its parts' floored mean; unused entries stay."""
    parts, entries, part_width = books.entries.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total, count = np.zeros_like(books.entries), np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, x = components(batch.column(0), books.width)
            for part in range(parts):
                own = np.ascontiguousarray(x[:, part * part_width : (part + 1) * part_width])
                best, _ = nearest(own, books.entries[part])
                np.add.at(total[part], best, own)
                count[part] += np.bincount(best, minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "count", "sums"]
        )

    by_task = vectors.select("embedding").mapInArrow(sums, "part int, entry int, count long, sums array<long>")
    places = F.array(*[F.sum(F.col("sums")[i]) for i in range(part_width)])
    merged = by_task.groupBy("part", "entry").agg(F.sum("count").alias("count"), places.alias("sums")).collect()
    new = books.entries.copy()
    for row in merged:
        new[row.part, row.entry] = np.array(row.sums, np.int64) // row["count"]
    return Codebooks(new)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks over all of `vectors` (vec_id, embedding); None where no vector can be coded."""
    begin(vectors.sparkSession)
    width = _width(vectors, parts)
    if width is None:
        return None
    books = first_codebooks(vectors, width, parts, entries)
    if not books.entries.shape[1]:
        return None
    for _ in range(rounds):
        books = refine(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, codes, error) of every vector that `books` fits: an entry's number for each part, and the squared distance in all."""
    parts, _, part_width = books.entries.shape
    begin(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            rows, x = components(batch.column("embedding"), books.width)
            codes, error = np.empty((len(rows), parts), np.int32), np.zeros(len(rows), np.int64)
            for part in range(parts):
                codes[:, part], distance = nearest(np.ascontiguousarray(x[:, part * part_width : (part + 1) * part_width]), books.entries[part])
                error += distance
            kept = pa.array(rows)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(kept), batch.column("label").take(kept), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array(error)], ["vec_id", "label", "codes", "error"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("vec_id", "label", "embedding").mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, embedding): the vectors that the codes stand for."""
    shared = coded.sparkSession.sparkContext.broadcast(books)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value.entries
        for batch in batches:
            codes = batch.column("codes").flatten().to_numpy().reshape(batch.num_rows, len(entries))
            vectors = entries[np.arange(len(entries)), codes].reshape(batch.num_rows, -1) / SCALE
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * shared.value.width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], ["vec_id", "embedding"])

    return coded.select("vec_id", "codes").mapInArrow(look, f"vec_id {dict(coded.dtypes)['vec_id']}, embedding array<double>")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector: hex digits of the codes, and errors summed over equal labels."""
    if entries > 256:
        raise ValueError("a code has two hex digits, for at most 256 entries")
    books = fit(vectors, parts, entries, rounds)
    if books is None:
        kind = dict(vectors.dtypes)["vec_id"]
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialise(encode(vectors, books), "vector-codes")
    # one row a label on one side, every vector of it on the other: a hot label's rows can be dealt out by the join
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
