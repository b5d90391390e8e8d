"""A corpus: a folder of immutable Parquet files, and numbered pointers that list each table's files with the audios they hold.

A change writes new files and then the next pointer, so several tables change together or not at all; the pointer with the highest
number is current. `append` adds files, `rewrite` and `merge` write only the files that may hold a touched audio anew, `commit` whole
tables; all others are kept by reference, so that a change writes bytes in proportion to what it touches. Rows are dealt to files by
range of audio, start and id, so time and audio filters skip files and row groups, and an audio of any size is split over files.

Pointers are written aside and appear whole under their number, or not at all where the number is taken: a writer that ends half-way
leaves the corpus as it was and stands in nobody's way, and of two writers that began from one pointer, the later is rejected. The file
system must refuse to rename a file onto another (HDFS does), or be local, where links do.

Values of the key column beyond KEY_LENGTH bytes are cut in a pointer, so that what it tells of a file stays true and short. Pointers
that name one path a table, as written before, are read as one file of unknown audios.
"""

from __future__ import annotations

import bisect
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierspan.operators import writes
from tierspan.plans.query import Query
from tierspan.plans.schema import GRAPH, LEDGERS, SCHEMAS, SEGMENT_ORDER
from tierspan.session import ship

#: Buckets of hashes that a sample is cut by.
SAMPLE_BUCKETS = 1 << 14


def sample_rows(rows: DataFrame, n: int, seed: int = 0, key: str = "identifier") -> DataFrame:
    """The n rows (or all) of smallest hash: whole buckets of hashes from one count each, and the last bucket's share by rank."""
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(SAMPLE_BUCKETS)))
    counts = {r["_h"]: r["count"] for r in hashed.groupBy("_h").count().collect()}
    cut, left = -1, n
    for bucket in sorted(counts):
        if counts[bucket] > left:
            break
        cut, left = bucket, left - counts[bucket]
    whole = hashed.where(F.col("_h") <= cut)
    following = min((b for b in counts if b > cut), default=None)
    if left and following is not None:
        whole = whole.unionByName(hashed.where(F.col("_h") == following).orderBy(F.xxhash64(key, F.lit(seed + 1)), key).limit(left))
    return whole.drop("_h")


#: Bytes of an audio's id that a pointer holds at most.
KEY_LENGTH = 64


@dataclass(frozen=True)
class File:
    """A Parquet file or folder of a table, and the audios it may hold: first and last key as hexadecimal bytes, null where unknown."""

    path: str
    low: str | None = None
    high: str | None = None
    rows: int | None = None


def _touched(files: list[File], keys: DataFrame) -> DataFrame:
    """(file): places in `files`, sorted by low, of those that may hold one of `keys` (_key, binary)."""
    lows = [bytes.fromhex(f.low) for f in files]
    # a high is a prefix where it was cut: all that begins with it is below
    highs = [bytes.fromhex(f.high) for f in files]
    reach, most = [], b""
    for high in highs:
        most = max(most, high)
        reach.append(most)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for key in batch.column(0).to_pylist():
                k = bisect.bisect_right(lows, key[:KEY_LENGTH]) - 1
                while k >= 0 and reach[k] >= key[:KEY_LENGTH]:
                    if highs[k] >= key[:KEY_LENGTH]:
                        found.add(k)
                    k -= 1
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["file"])

    ship(keys.sparkSession)
    return keys.mapInArrow(find, "file int").distinct()


class Corpus:
    def __init__(self, spark: SparkSession, path: str, graph=GRAPH, schemas=SCHEMAS) -> None:
        self.spark, self.path, self.graph, self.schemas = spark, path.rstrip("/"), graph, schemas
        self.tables: dict[str, DataFrame] = {}
        self.files: dict[str, list[File]] = {}
        self.number, self.closed = 0, False
        self.refresh()

    @classmethod
    def create(cls, spark: SparkSession, path: str, *, resume: bool = False, protected: tuple[str, ...] = (), **kind) -> Corpus:
        """A corpus to be built: refused where the folder is one of `protected`, isn't a folder, holds other files than a corpus', or, unless an
        earlier build is to be resumed, holds anything."""
        plain = lambda x: os.path.normpath(urlparse(x).path) if urlparse(x).scheme in ("", "file") else x.rstrip("/")
        if plain(path) in map(plain, protected):
            raise ValueError(f"{path} is protected")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            if not fs.getFileStatus(at).isDirectory():
                raise ValueError(f"{path} isn't a folder")
            names = [s.getPath().getName() for s in fs.listStatus(at)]
            if names and not resume:
                raise ValueError(f"{path} isn't empty; resume it, or choose another folder")
            if odd := [x for x in names if not x.startswith(("v-", "pointer-", "_pointer-", "claim-", "."))]:
                raise ValueError(f"{path} holds other files: {', '.join(sorted(odd)[:5])}")
        return cls(spark, path, **kind)

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _numbers(self, kind: str) -> list[int]:
        fs, at = self._fs(f"{self.path}/{kind}-*")
        return [int(s.getPath().getName().rpartition("-")[2]) for s in fs.globStatus(at) or []]

    def _open(self) -> None:
        if self.closed:
            raise ValueError("the corpus is closed")

    def _key(self, table: str) -> str:
        """The column by which a table's rows are dealt to files."""
        return "audio_id" if "audio_id" in self.schemas[table].names else "identifier"

    def close(self) -> None:
        """No query or change after this; frames made before stay usable."""
        self.closed = True

    def refresh(self) -> Corpus:
        """Look at the current pointer; frames made before keep the tables they were made from."""
        self._open()
        self.number = max(self._numbers("pointer"), default=0)
        stored = json.loads(self.spark.read.text(f"{self.path}/pointer-{self.number}", wholetext=True).first()[0]) if self.number else {}
        self.files = {t: [File(at)] if isinstance(at, str) else [File(**f) for f in at] for t, at in stored.items()}
        self.tables = {table: self._read(table, self.files.get(table, [])) for table in self.schemas}
        return self

    def _read(self, table: str, files: list[File]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*[f"{self.path}/{f.path}" for f in files])

    def _write(self, folder: str, table: str, df: DataFrame) -> list[File]:
        """New files of a table, with what they hold."""
        schema, key, at = self.schemas[table], self._key(table), f"{folder}/{table}"
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        order = [c for c in SEGMENT_ORDER if c in schema.names] or [key]
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{self.path}/{at}")
        name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
        raw = F.substring(F.col(key).cast("binary"), 1, KEY_LENGTH)
        held = self.spark.read.schema(schema).parquet(f"{self.path}/{at}").select(name.alias("name"), raw.alias("key"))
        # a row without a key is in a file of unknown audios
        found = held.groupBy("name").agg(F.hex(F.min("key")).alias("low"), F.hex(F.max("key")).alias("high"), F.count(F.lit(1)).alias("rows"), F.bool_or(F.col("key").isNull()).alias("odd")).collect()
        return [File(f"{at}/{r['name']}", None if r["odd"] else r["low"], None if r["odd"] else r["high"], r["rows"]) for r in found]

    def _change(self, make: Callable[[str], dict[str, list[File]]]) -> Corpus:
        """Write what `make` writes into a new folder and make its lists of files current, all or none."""
        self._open()
        folder = f"v-{uuid.uuid4().hex}"
        try:
            self._point(self.files | make(folder))
        except BaseException:
            fs, at = self._fs(f"{self.path}/{folder}")
            fs.delete(at, True)
            raise
        return self.refresh()

    def _known(self, tables) -> None:
        self._open()
        unknown = set(tables) - set(self.schemas)
        if unknown:
            raise ValueError(f"no such tables: {', '.join(sorted(unknown))}")

    def commit(self, changed: dict[str, DataFrame]) -> Corpus:
        """Write whole tables and make them current, all or none."""
        self._known(changed)
        return self._change(lambda folder: {table: self._write(folder, table, df) for table, df in changed.items()})

    def append(self, rows: dict[str, DataFrame]) -> Corpus:
        """Add rows to tables, all or none. What is stored isn't read."""
        self._known(rows)
        return self._change(lambda folder: {table: [*self.files.get(table, []), *self._write(folder, table, df)] for table, df in rows.items()})

    def holding(self, table: str, audios: DataFrame) -> tuple[list[File], list[File]]:
        """(files of a table that may hold rows of some audios, the others). `audios` has their ids in its first column."""
        files = self.files.get(table, [])
        known = sorted((f for f in files if f.low is not None), key=lambda f: bytes.fromhex(f.low))
        keys = audios.select(F.col(audios.columns[0]).cast("binary").alias("_key")).where("_key IS NOT NULL").distinct()
        hit = {r["file"] for r in _touched(known, keys).collect()} if known else set()
        may = [f for f in files if f.low is None] + [f for k, f in enumerate(known) if k in hit]
        return may, [f for k, f in enumerate(known) if k not in hit]

    def rewrite(self, audios: DataFrame, tables: list[str], change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> Corpus:
        """Change what is stored of some audios (ids in the first column), all or none.

        `change` gets the parts of `tables` that may hold these audios, with other audios' rows among them, and returns what takes
        their place. Other files stay as they are.
        """
        self._known(tables)
        split = {table: self.holding(table, audios) for table in tables}

        def make(folder: str) -> dict[str, list[File]]:
            made = change({table: self._read(table, may) for table, (may, _) in split.items()})
            return {table: [*split[table][1], *self._write(folder, table, df)] for table, df in made.items()}

        return self._change(make)

    def merge(self, table: str, rows: DataFrame, keys: list[str], policy: Callable[[DataFrame, DataFrame, list[str]], DataFrame] = writes.upsert) -> Corpus:
        """Merge rows into a table by a policy of `writes`. The keys include the audio, or the id in a table of no audio's rows, so that a
        row and its stored match are in the same files."""
        self._known([table])
        if self._key(table) not in keys:
            raise ValueError(f"keys of {table} must include {self._key(table)}")
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schemas[table].fields])
        return self.rewrite(rows.select(self._key(table)), [table], lambda part: {table: policy(part[table], rows, keys)})

    def _point(self, files: dict[str, list[File]]) -> None:
        """The next pointer: it is written aside, and takes its number only if nothing has it."""
        if max(self._numbers("pointer"), default=0) != self.number:
            raise ValueError("the corpus was changed by another writer; refresh and make the change again")
        fs, tmp = self._fs(f"{self.path}/_pointer-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps({t: [asdict(f) for f in list_] for t, list_ in files.items()}).encode()))
        out.close()
        if not self._take(fs, tmp, f"{self.path}/pointer-{self.number + 1}"):
            fs.delete(tmp, False)
            raise ValueError(f"the corpus was changed by another writer, who took number {self.number + 1}; refresh and make the change again")

    def _take(self, fs, tmp, path: str) -> bool:
        """Give a file its name, unless there is one of that name: one step, whoever else tries."""
        if fs.getUri().getScheme() == "file":
            source = urlparse(tmp.toString()).path
            try:
                os.link(source, urlparse(path).path)
            except FileExistsError:
                return False
            os.unlink(source)
            return True
        return fs.rename(tmp, self._fs(path)[1])

    def truncate(self, *names: str) -> Corpus:
        """Empty some tables, or all; their old files stay for frames that read them."""
        return self.commit({n: self.spark.createDataFrame([], self.schemas[n]) for n in names or self.schemas})

    def query(self, entity: str) -> Query:
        self._open()
        return Query(self.tables, self.graph, entity)

    def counts(self) -> DataFrame:
        """(object_type, n) of all tables of objects."""
        out = None
        for name, df in ((name, df) for name, df in self.tables.items() if name not in LEDGERS):
            one = df.groupBy(F.lit(name).alias("object_type")).agg(F.count(F.lit(1)).alias("n"))
            out = one if out is None else out.unionByName(one)
        return out

    def sample(self, fraction: float, seed: int = 0) -> dict[str, DataFrame]:
        """An exact share of the phrases (one at least), drawn by hash, with all that hangs on them."""
        n = max(1, int(self.tables["phrases"].count() * fraction))
        phrases = sample_rows(self.tables["phrases"], n, seed)
        keep = phrases.select(F.col("identifier").alias("phrase_id"))
        out = {"phrases": phrases, "words": self.tables["words"].join(keep, F.col("parent_id") == F.col("phrase_id"), "left_semi")}
        out |= {level: self.tables[level].join(keep, "phrase_id", "left_semi") for level in ("syllables", "phones")}
        for name, key in (("audios", "audio_id"), ("speakers", "speaker_id")):
            out[name] = self.tables[name].join(phrases.select(F.col(key).alias("_k")).distinct(), F.col("identifier") == F.col("_k"), "left_semi")
        return out
