import base64
import hashlib
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginwise.llm import files, warc
from marginwise.session import scratch_table, stored

ROWS = [
    (1, "http://a/é?q=1 2", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (9, "http://c/", "<p>same</p>"), (4, "http://d/", None), (5, None, ""),
    (6, "http://e/\r\nX: y", "<p>ünlike</p>"), (None, "http://f/", "<p>same</p>"), (None, "http://g/", "alone"), (7, "http://h/", "y" * 200_000),
    (8, "http://i/", "twice"), (8, "http://i/", "twice"),
]


def expected(rows):
    by = defaultdict(list)
    for key, _, html in rows:
        by[html or ""].append(key)
    out = []
    for key, _, html in rows:
        payload = (html or "").encode()
        largest = max((k for k in by[html or ""] if k is not None), default=None)
        refers = largest if largest is not None and key != largest else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((key, len(payload), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes", [10, 1 << 28])
def test_round_trip(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    pages = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "page_id bigint, url string, html string, path int, offset int")
    written = stored(warc.write_archives(pages, scratch_table(spark, "warc-test")), "warc-manifest")
    found = warc.read_archives(written).collect()
    number = lambda x: int(x) if x is not None else None
    got = [(number(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in found]
    assert sorted(got, key=str) == expected(ROWS)
    texts = {r["payload_digest"]: r["payload"] for r in found if r["record_type"] == "response"}
    assert set(texts.values()) == {html or "" for _, _, html in ROWS}
    assert {r["url"] for r in found} == {url or "" for _, url, _ in ROWS}
    assert warc.write_archives(pages.limit(0), scratch_table(spark, "warc-none")).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_directory_of_foreign_archives(tmp_path, monkeypatch, wide):
    if wide:
        # Every size, place and count goes to the ZIP64 records.
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 5)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    path = tmp_path / "x.zip"
    contents = {"archive/a.warc": b"a" * 1000, "deep/b.txt": b"", "ü.txt": b"text" * 50, "packed.txt": b"z" * 5000}
    with zipfile.ZipFile(path, "w") as archive:
        for name, data in contents.items():
            archive.writestr(name, data, zipfile.ZIP_DEFLATED if name == "packed.txt" else zipfile.ZIP_STORED)
        archive.comment = b"PK\x05 a comment"
    reader = files.Reader()
    found = {m[0]: m for m in warc.directory(reader, str(path))}
    assert found.keys() == contents.keys()
    for name, (_, method, place, packed, plain) in found.items():
        assert plain == len(contents[name])
        if method == warc.STORED:
            assert reader.read(warc.content_at(reader, place), packed) == contents[name]
    assert found["packed.txt"][1] != warc.STORED
    if wide:
        assert b"PK\x06\x06" in path.read_bytes()


def test_not_an_archive(tmp_path):
    (tmp_path / "x").write_bytes(b"no archive")
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.directory(files.Reader(), str(tmp_path / "x"))


def test_columns_with_clashing_names(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (2, "u", "<p>a"), (3, "v", None)], "page_id bigint, url string, html string")
    for k, c in enumerate(["_largest", "_digest", "_html", "_refers_to", "digest", "largest", "refers_to", "n"]):
        pages = pages.withColumn(c, F.lit(k))
    found = warc.with_responses(pages, "page_id", "url", "html").collect()
    assert {(r["page_id"], r["html"], r["refers_to"]) for r in found} == {(1, "<p>a", 2), (2, "<p>a", None), (3, "", None)}
    assert sum(r["records"] for r in warc.write_archives(pages, str(tmp_path)).collect()) == 3
