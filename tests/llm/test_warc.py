import base64
import gzip
import hashlib

import pytest

from skyledger.llm import warc_archive as A
from skyledger.llm.common import written

SCHEMA = "page_id long, url string, html string, payload string, digest string"
ROWS = [(i, f"http://site.example/{i % 7}?q=é\r\nX: y", f"<p>page {i % 20}</p>" * (i % 5), "own", "own") for i in range(100)]
ROWS += [(200, None, None, None, None), (201, "", "", None, None), (202, "u", "x" * 3_000_000, None, None), (None, "u", "<p>page 3</p>" * 3, None, None), (203, "u", "alone", None, None),
         (204, "u", "twice", None, None), (204, "u", "twice", None, None), (None, "u", "nobody", None, None), (None, "u", "nobody", None, None)]


def expected(rows, least=0):
    largest = {}
    for page, _, html, *_ in rows:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", page))
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        keep = largest.get(html or "")
        own = len(data) < least or keep is None or keep == page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else keep))
    return sorted(out, key=str)


def answer(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def archived(llm, spark):
    folder = A.archive_folder(spark)
    pages = written(llm.createDataFrame(ROWS, SCHEMA).repartition(4), "pages")
    return folder, A.write_archives(A.with_responses(pages), folder)


def test_what_is_written_is_read_back(archived):
    folder, index = archived
    found = A.read_records(index, folder)
    assert answer(found) == expected(ROWS)
    texts = {r.page_id: bytes(r.payload).decode() for r in found.collect() if r.payload is not None and r.page_id is not None}
    assert all(texts[p] == (h or "") for p, _, h, *_ in ROWS if p in texts)


def test_selected_records_and_plain_tools(archived):
    folder, index = archived
    some = index.where("page_id % 10 = 3")
    assert sorted(r.page_id for r in A.read_records(some, folder).collect()) == [p for p in range(3, 100, 10)] + [203]
    row = index.where("page_id = 203").first()
    with open(f"{folder.removeprefix('file://')}/{row.file}", "rb") as file:
        file.seek(row.offset)
        record = gzip.decompress(file.read(row.length))
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"\r\n\r\nalone\r\n\r\n")


def test_a_damaged_payload_is_noticed():
    record = A._record(1, "u", b"payload", "A" * 32, None, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        A._parsed(record)


def test_small_payloads_and_empty_tables(llm, spark):
    pages = written(llm.createDataFrame(ROWS, SCHEMA), "pages")
    folder = A.archive_folder(spark)
    index = A.write_archives(A.with_responses(pages, least_bytes=13), folder)
    assert answer(A.read_records(index, folder)) == expected(ROWS, 13)
    index = A.write_archives(A.with_responses(pages.limit(0)), folder)
    assert A.read_records(index, folder).count() == 0


def test_ranges_are_joined_when_close():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("b", 0, 4), ("b", 4, 50)]
    assert list(A.coalesced(iter(places), gap=20, most=40)) == [("a", 0, 15, [(0, 10), (10, 5)]), ("a", 100, 5, [(0, 5)]), ("b", 0, 4, [(0, 4)]), ("b", 4, 50, [(0, 50)])]


def test_reads_are_dealt_by_bytes_and_records(archived, monkeypatch):
    folder, index = archived
    monkeypatch.setattr(A, "READ_RECORDS", 10)
    found = A.read_records(index, folder)
    assert found.rdd.getNumPartitions() >= 8 and answer(found) == expected(ROWS)
    monkeypatch.setattr(A, "READ_RECORDS", 10**6)
    monkeypatch.setattr(A, "READ_BYTES", 1000)
    assert A.read_records(index, folder).rdd.getNumPartitions() >= 4


def test_a_common_payload_is_spread(llm, spark, monkeypatch):
    rows = [(i, "u", "common" if i % 3 else f"pair {i // 6}", None, None) for i in range(3000)] + [(None, "u", "common", None, None)]
    pages = written(llm.createDataFrame(rows, SCHEMA), "pages")
    for groups in (1000, 2):  # only the common payload is sent; then, all or nothing
        monkeypatch.setattr(A, "SPREAD_GROUPS", groups)
        found = A.with_responses(pages)
        got = sorted(((r.page_id, r.refers_to) for r in found.collect()), key=str)
        assert got == sorted(((p, refers) for p, _, _, _, refers in expected(rows)), key=str)


def test_a_folder_without_a_scheme_is_on_the_default_file_system(spark):
    assert A.qualified(spark, "/shared/a") == A.qualified(spark, "file:///shared/a") == "file:///shared/a"
