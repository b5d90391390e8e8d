"""Incremental import of interval files as a stream: each micro-batch is merged into a corpus under a policy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tierspan.operators import writes
from tierspan.plans.corpus import Corpus

POLICIES = {"append": writes.append_new, "add_missing": writes.add_missing, "replace": writes.replace, "upsert": writes.upsert}


def _policy(name: str, keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name!r}; there are {', '.join(POLICIES)}")

    def merged(old: DataFrame, batch: DataFrame) -> DataFrame:
        if name != "append":
            writes.require_empty(writes.duplicate_keys(batch, keys), "keys occur twice in the batch")
        return POLICIES[name](old, batch, keys)

    return merged


def _start(source: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_stream(source: DataFrame, checkpoint: str, current: Callable[[], DataFrame], commit: Callable[[DataFrame], None], keys: list[str], policy: str = "upsert") -> StreamingQuery:
    """Merge what is there and stop; a rerun goes on from the checkpoint, so files are imported once.

    A batch that holds a key twice is rejected, like any other batch, and the stream stops. A batch that was committed right before
    a failure comes again: the policies but `append` give the same rows then, `append` adds what isn't there row for row.
    """
    merged = _policy(policy, keys)
    return _start(source, checkpoint, lambda batch, _: commit(merged(current(), batch)))


def corpus_stream(source: DataFrame, checkpoint: str, corpus: Corpus, table: str, keys: list[str], policy: str = "upsert") -> StreamingQuery:
    """As `import_stream`, into a table of a corpus: each micro-batch reads and writes only the files that may hold its audios."""
    merged = _policy(policy, keys)

    def merge(batch: DataFrame, _: int) -> None:
        corpus.refresh().merge(table, batch, keys, lambda old, rows, _: merged(old, rows))

    return _start(source, checkpoint, merge)
