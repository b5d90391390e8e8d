import hashlib
import io
import zipfile

import pytest

from tierspan.llm import warc

BIG = "<p>é</p>" * 300


def test_records_equal_brute_force(spark):
    rows = [(1, "http://a", BIG, 0), (5, "http://b\r\nX: y", BIG, 0), (3, None, BIG, 0), (2, "u", "short", 0), (4, "u", "short", 0), (6, "u", None, 0), (7, "u", "x\r\n\r\ny" * 200, 0), (5, "u", BIG, 0), (None, "u", BIG, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _key int")
    got = warc.read_archives(warc.write_archives(warc.classify(pages)), with_payload=True).collect()
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        twins = [r[0] for r in rows if r[2] == html and r[0] is not None]
        again = len(data) >= 1000 and i != max(twins)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(twins) if again else None, b"" if again else data))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.classify(pages))).count() == 0


@pytest.mark.parametrize("limit", [None, 10])
def test_directory_with_and_without_zip64(monkeypatch, limit):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("a", b"first member, longer than ten bytes")
        package.writestr("b", b"second PK\x05\x06 member")
        package.writestr("c", b"squeezed" * 99, zipfile.ZIP_DEFLATED)
        package.comment = b"PK\x05\x06 in a comment"
    data = out.getvalue()
    assert (b"PK\x06\x06" in data) == bool(limit)
    read_at = lambda at, n: data[at : at + n]
    members = warc.directory(read_at, len(data))
    for name, want in (("a", b"first member, longer than ten bytes"), ("b", b"second PK\x05\x06 member")):
        assert read_at(*warc.stored(read_at, members, name)) == want
    with pytest.raises(ValueError):
        warc.stored(read_at, members, "c")
    with pytest.raises(ValueError):
        warc.directory(read_at, 30)
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", "response", None).replace(b"abc", b"abd"))
