"""Best-fit packing planned over a length histogram.

Documents are tokenised once into pieces of at most `max_tokens`; the plan is made over how many pieces there are of each
length (at most `max_tokens` counts), never over pieces; pieces then take planned slots by joining on their rank within
their length. Defined results: a null text is empty and gives one piece with the end token alone; repeated rows and equal ids
give pieces of their own; an empty table gives no piece; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierspan.llm.common import begin, materialise

MAX_TOKENS = 1024
END_ID = 2
#: Word units a task keeps encoded, of so many characters at most; others are encoded each time, so memory is bounded and results are the same.
CACHED_UNITS, CACHED_CHARS = 1 << 17, 32
#: Pieces per bucket when ranks within a length are dealt out.
RANK_BUCKET = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Units(dict):
    """Little-endian 32-bit ids of a word unit; missing ones are encoded and, up to a bound, kept."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.encode(unit))
        if len(self) < CACHED_UNITS and len(unit) <= CACHED_CHARS:
            self[unit] = ids
        return ids


class Encoder:
    """Token ids of whole texts, as packed little-endian 32-bit integers.

    Byte-level BPE never merges across the start of a white-space run, so a text without two adjacent white-space characters
    is the sequence of its space-led words and its newlines; those units are looked up. Any other text is encoded whole. The units' and
    most texts' ids are made by a second reader of the same vocabulary, several times as fast as `tokenizers`, which encodes texts
    that hold special tokens; tests compare all of it with `tokenizers` over random texts.
    """

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._path = public_tokenizers.path(f"{name}.json")
        with open(self._path, encoding="utf-8") as file:
            self._special = [t["content"] for t in json.load(file)["added_tokens"]]
        self._units = _Units(self._bpe.encode_ordinary)
        self._double = re.compile(r"\s\s")

    @functools.cached_property
    def _full(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def forget(self) -> None:
        self._units.clear()

    def packed(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self._special):
            return b"".join(i.to_bytes(4, "little") for i in self._full.encode(text, add_special_tokens=False).ids)
        if self._double.search(text):
            return b"".join(i.to_bytes(4, "little") for i in self._bpe.encode_ordinary(text))
        get, newline = self._units.__getitem__, self._units["\n"]
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            head = get(first) if first else b""
            lines.append(head + b"".join([get(" " + unit) for unit in rest]) if rest else head)
        return newline.join(lines)


@functools.cache
def encoder() -> Encoder:
    """One for each worker process, since vocabularies load slowly."""
    return Encoder()


def cut(n: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole pieces of `max_tokens`, the remainder first."""
    first = (n - 1) % max_tokens + 1
    return [(0, first), *((s, max_tokens) for s in range(first, n, max_tokens))]


def _pieces(max_tokens: int, keep_ids: bool):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, end = encoder().packed, END_ID.to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * keep_ids)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = packed(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, max_tokens)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(part)) + (part,) * keep_ids)
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
        encoder().forget()

    return make


def pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, *, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, tokenised in one pass over its whole text."""
    begin(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_pieces(max_tokens, keep_ids), PIECES + ", ids binary" * keep_ids)


def plan(counts: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Slots for `counts` of pieces per length: runs (length, first rank, last rank + 1, first sequence, offset).

    Best fit, longest first. Sequences that hold the same fill are one run of consecutive numbers, so the work depends on the
    number of lengths, not of pieces. Rank r of a run takes the sequence first + (r - first rank).
    """
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, count)
    rooms = 0  # bit r is set when open_runs has room r
    runs, sequences = [], 0

    def put(room: int, run: tuple[int, int]) -> None:
        nonlocal rooms
        if room:
            open_runs.setdefault(room, []).append(run)
            rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
                    rooms &= ~(1 << room)
            else:
                room, first, n = max_tokens, sequences, -(-left // (max_tokens // length))
                sequences += n
            # best fit stays in a sequence while another piece of this length fits: fill `each` slots of it at once
            each = room // length
            whole, part = divmod(min(left, n * each), each)
            for slot in range(each):
                used = whole + (slot < part)
                if used:
                    runs.append((length, rank, rank + used, first, max_tokens - room + slot * length))
                    rank += used
                    left -= used
            if whole:
                put(room - each * length, (first, whole))
            if part:
                put(room - part * length, (first + whole, 1))
            if (rest := n - whole - bool(part)) > 0:
                put(room, (first + whole + bool(part), rest))
    return runs


def ranked(rows: DataFrame) -> DataFrame:
    """Add `_rank`, 0 to n - 1 within each length, without bringing a length into one task.

    Each length is dealt over buckets by a hash of the row's number, `_row`, so that repeated rows part too; small counts of the buckets give each its first rank.
    """
    total = rows.groupBy("length").count().withColumn("_buckets", F.ceil(F.col("count") / RANK_BUCKET)).drop("count")
    dealt = rows.join(F.broadcast(total), "length").withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.col("_buckets"))).drop("_buckets")
    first = dealt.groupBy("length", "_bucket").count()
    first = first.withColumn("_first", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32", "_row")) - 1
    return dealt.withColumn("_within", within).join(first, ["length", "_bucket"]).withColumn("_rank", F.col("_first") + F.col("_within")).drop("_bucket", "_within", "_first")


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, *, keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset; few sequences, each of at most `max_tokens` without a gap.

    The driver sees one count per length and makes at most a few thousand runs; those are broadcast.
    """
    spark = docs.sparkSession
    rows = materialise(pieces(docs, max_tokens, keep_ids=keep_ids).withColumn("_row", F.monotonically_increasing_id()), "packing-pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    runs = spark.createDataFrame(plan(counts, max_tokens), "length long, _from long, _to long, _seq long, offset long")
    placed = ranked(rows).join(F.broadcast(runs), "length").where("_rank >= _from AND _rank < _to")
    return placed.withColumn("sequence_id", F.col("_seq") + F.col("_rank") - F.col("_from")).select(*rows.columns, "sequence_id", "offset").drop("_row")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, input_ids) of packed pieces that kept their ids: at most `max_tokens` ids a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("_parts"))
    return joined.mapInArrow(_unpack, "sequence_id long, input_ids array<int>")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype("int32") for parts in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "input_ids"])
