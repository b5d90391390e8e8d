"""WARC records inside ZIP packages, read by ranges without extraction.

`write_archives` stores gzip-per-record WARC data and an index as uncompressed members of ZIP packages in the shared folder.
`read_archives` parses central directories (ZIP64 included), finds the stored members and their index, and reads record ranges
out of the packages. Files are committed through a manifest that the writing tasks return, so what a lost or repeated task
left behind is never read.

Defined results: a null payload is empty; a null url is empty; of equal payloads of at least `REVISIT_BYTES` bytes the largest
page_id is the response (rows repeated with that id are responses too, and all rows where every id is null), the others are
revisits of it; an empty table gives no archive and no record; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspan.llm.common import begin, marked, materialise, scratch_path

REVISIT_BYTES = 1000
#: A package is closed once it holds so many bytes; ranges of one read; bytes read by one task.
PACKAGE_BYTES, RANGE_BYTES, TASK_BYTES = 64 << 20, 4 << 20, 16 << 20
DATE = "2000-01-01T00:00:00Z"
DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, size long, records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def classify(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, record_type, refers_to). Payloads that surely occur once pass without a shuffle."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    key = F.when(F.octet_length("html") >= min_bytes, F.sha2("html", 256))
    groups = materialise(rows.select("page_id", key.alias("_key")).where("_key IS NOT NULL").groupBy("_key").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "warc-groups")
    flagged = marked(rows.withColumn("_key", key), groups, ["_key"], [F.col("_key")])
    lone = flagged.where("NOT _hit OR _key IS NULL").withColumn("_first", F.lit(None).cast("long"))
    twins = flagged.where("_hit AND _key IS NOT NULL").join(groups, "_key", "left").select(*lone.columns)
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return lone.unionByName(twins).select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def record(page_id: int | None, url: str, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, and so the payload's length, but no payload."""
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    uri = url.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def parse(raw: bytes) -> tuple[tuple, bytes]:
    """The row of RECORDS that a record holds, and its payload (empty for a revisit). Damaged payloads raise ValueError."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(_fields(http)["content-length"])
    page = lambda key: int(x) if (x := fields[key].removeprefix("<urn:page:").removesuffix(">")) else None
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest):
        raise ValueError(f"damaged payload in record {fields['warc-record-id']}")
    return (page("warc-record-id"), fields.get("warc-target-uri", ""), size, digest, kind, page("warc-refers-to") if kind == "revisit" else None), payload


class _Package:
    """A ZIP package that is being written; members are stored, so that ranges of them are ranges of the package."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, at = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.fs, self.at = fs, at
        self.out = fs.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA_MEMBER, "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        body = packer.compress(raw) + packer.flush()
        self.data.write(body)
        self.index.append(json.dumps({"page": page_id, "offset": self.size, "length": len(body)}))
        self.size += len(body)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(INDEX_MEMBER, "w", force_zip64=True) as member:
            member.write("\n".join(self.index).encode())
        self.zip.close()
        self.out.close()
        return self.path, self.size, len(self.index)


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for page_id, url, html, kind, refers_to in zip(*(batch.column(k) for k in range(5)), strict=True):
                package = package or _Package(folder)
                key = page_id.as_py()
                package.add(key, record(key, url.as_py(), html.as_py().encode(), kind.as_py(), refers_to.as_py()))
                if package.size >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "size", "records"])

    return write


def write_archives(classified: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ZIP packages; the manifest (path, size, records) of the packages that count."""
    begin(classified.sparkSession)
    folder = folder or scratch_path(classified.sparkSession, "warc")
    return materialise(classified.mapInArrow(_write(folder), MANIFEST), "warc-manifest")


ReadAt = Callable[[int, int], bytes]


def directory(read_at: ReadAt, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file by its central directory: name -> (method, local header's offset, stored size)."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # those bytes may stand in a comment too
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut short")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read_at(tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("ZIP64 locator missing")
        end = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end of central directory missing")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    entries, at, members = read_at(start, length), 0, {}
    for _ in range(count):
        if entries[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        (method,) = struct.unpack_from("<H", entries, at + 10)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", entries, at + 20)
        (offset,) = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + 46 : at + 46 + n].decode()
        extra = entries[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            kind, long = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values stand here for just those fields that are full
                values = iter(struct.unpack(f"<{long // 8}Q", extra[4 : 4 + long // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + long :]
        members[name] = (method, offset, packed)
        at += 46 + n + m + k
    return members


def stored(read_at: ReadAt, members: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    """Where a stored member's bytes lie in the package: (offset, length)."""
    method, offset, length = members[name]
    if method != 0:
        raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
    head = read_at(offset, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {name}")
    n, m = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n + m, length


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    file = fs.open_input_file(at)
    return file, lambda offset, n: file.read_at(n, offset)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring records, by the index member of each package."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            file, read_at = _open(path)
            with file:
                members = directory(read_at, file.size())
                at, length = stored(read_at, members, INDEX_MEMBER)
                lines = read_at(at, length).decode().splitlines()
                base, _ = stored(read_at, members, DATA_MEMBER)
            runs: list[list[int]] = []
            for line in map(json.loads, lines):
                if not runs or sum(runs[-1][1:]) >= RANGE_BYTES or len(runs[-1]) > 4096:
                    runs.append([base + line["offset"]])
                runs[-1].append(line["length"])
            yield pa.record_batch([pa.array([path] * len(runs)), pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1:] for r in runs], pa.list_(pa.int64()))], names=["path", "start", "lengths"])


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
        names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, read_at = _open(path)
                with file:
                    data = read_at(start, sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    row, payload = parse(zlib.decompress(data[at : at + n], 31))
                    rows.append(row + (payload,) * with_payload)
                    at += n
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return read


def read_archives(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """Every record of the packages of a manifest. Tasks get ranges, so a large package is read by many."""
    begin(manifest.sparkSession)
    total = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    packages, tasks = max(1, min(total[0], 4096)), max(1, -(-total[1] // TASK_BYTES))
    ranges = manifest.select("path").repartition(packages).mapInArrow(_ranges, "path string, start long, lengths array<long>")
    return ranges.repartition(max(tasks, 2)).mapInArrow(_read(with_payload), RECORDS + ", payload binary" * with_payload)
