r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole as `<turn>role<text>text</turn>` per turn, encoded once with character offsets, and the
sorted spans of assistant texts are intersected with the sorted token spans by binary search. The three marks are single
tokens, so no token crosses the border of a text. Inside roles and texts a backslash is doubled and a mark or a `###` header
gets a backslash after its first character; dropping the backslash before any character restores the original.

Defined results: null texts and roles count as empty; turns are ordered by turn (null first), role and text, and repeated rows
are turns of their own; rows with a null conv_id form one conversation; an empty table gives no row; other columns are ignored.
A conversation is one output row and so is gathered whole; its turns are never split from each other.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspan.llm.common import begin

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
LEARNED = "assistant"
_CONTROL = re.compile(r"\\|<turn>|<text>|</turn>|###")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
FORMATTED = "conv_id long, formatted string, input_ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the character spans of what is learned, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = f"{TURN}{escape(role)}{TEXT}"
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: marks inside texts are escaped, so plain splitting is exact."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(TURN).partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that lie in one of the sorted spans: two binary searches a span."""
    out = np.zeros(len(starts), dtype=bool)
    for low, high in spans:
        if low < high:
            out[np.searchsorted(ends, low, "right") : np.searchsorted(starts, high, "left")] = True
    return out


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """All text under the mask, unescaped: one piece for each run of masked tokens. Tokens that share a character count it once."""
    on = np.concatenate([[False], loss, [False]])
    first, last = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(on[:-1] & ~on[1:]) - 1
    furthest = np.maximum.accumulate(np.where(loss, ends, 0)) if len(ends) else ends
    return "".join(unescape(formatted[starts[i] : furthest[k]]) for i, k in zip(first, last, strict=True))


@functools.cache
def tokenizer(name: str = "byte_bpe_50k"):
    """The public vocabulary with the marks as tokens of their own behind it."""
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    found.add_tokens([AddedToken(t, normalized=False) for t in (TURN, TEXT, END)])
    return found


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of arrays, without an object for each value."""
    at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(kind.to_pandas_dtype()), kind))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = tokenizer().encode
    for batch in batches:
        texts, ids, starts, ends, masks = [], [], [], [], []
        roles, bodies = (batch.column(1).values.field(c).to_pylist() for c in ("role", "text"))
        at = batch.column(1).offsets.to_numpy()
        for first, last in zip(at[:-1], at[1:], strict=True):
            formatted, spans = render(list(zip(roles[first:last], bodies[first:last], strict=True)))
            got = encode(formatted, add_special_tokens=False)
            offsets = np.fromiter(itertools.chain.from_iterable(got.offsets), np.int32, 2 * len(got)).reshape(-1, 2)
            texts.append(formatted)
            ids.append(np.array(got.ids, dtype=np.int32))
            starts.append(offsets[:, 0])
            ends.append(offsets[:, 1])
            masks.append(mask(offsets[:, 0], offsets[:, 1], spans))
        columns = [batch.column(0).cast(pa.int64()), pa.array(texts, pa.string()), *(_lists(x, pa.int32()) for x in (ids, starts, ends)), _lists(masks, pa.bool_())]
        yield pa.record_batch(columns, names=["conv_id", "formatted", "input_ids", "starts", "ends", "loss_mask"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: its text, token ids, character offsets and loss mask."""
    begin(turns.sparkSession)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    turn = F.struct("turn", text("role"), text("text"))
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    nulls_first = F.concat(F.filter("_turns", lambda t: t["turn"].isNull()), F.filter("_turns", lambda t: t["turn"].isNotNull()))
    return gathered.select("conv_id", nulls_first.alias("_turns")).mapInArrow(_format, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, ends, masks = (batch.column(c) for c in ("starts", "ends", "loss_mask"))
        at = starts.offsets.to_numpy()
        start, end, on = (c.values.to_numpy(zero_copy_only=False) for c in (starts, ends, masks))
        rows = []
        for conv_id, formatted, a, b in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), at[:-1], at[1:], strict=True):
            turns = parse(formatted)
            loss = masked_text(formatted, start[a:b], end[a:b], on[a:b])
            whole = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            rows.append((conv_id, len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of learned text, from the formatted output alone."""
    return formatted.mapInArrow(_read_back, DIGEST)
