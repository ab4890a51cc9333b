import base64
import gzip
import hashlib

from cairnwork.llm import common, warc

SCHEMA = "page_id long, url string, html string, sha1 string, first int"


def b32(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


def test_round_trip_against_brute_force(spark):
    pages = [
        (3, "http://a", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (7, "http://c", ""), (9, "u\r\nX: y", "x\r\n\r\ny"),
        (None, "http://n", "<p>é</p>"), (11, "http://d", "long " * 200_000), (12, "http://d", "solo"), (12, "http://d", "solo"),
    ]
    df = spark.createDataFrame([(*p, "s", 1) for p in pages], SCHEMA)
    index, folder = warc.archive_pages(spark, df)
    assert index.count() == len(pages)
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index, folder).collect()], key=str)
    want = []
    for i, _, h in pages:
        first = min(p[0] for p in pages if (p[2] or "") == (h or "") and p[0] is not None)
        own = i == first
        want.append((i, len((h or "").encode()), b32(h), "response" if own else "revisit", None if own else first))
    assert got == sorted(want, key=str)


def test_small_payloads_are_responses_and_selection_reads_only_those(spark):
    df = spark.createDataFrame([(i, f"u{i}", "same") for i in range(50)], "page_id long, url string, html string")
    index, folder = warc.archive_pages(spark, df, min_bytes=5)
    assert index.filter("record_type = 'response'").count() == 50
    some = index.filter("page_id % 10 = 0")
    got = warc.read_records(some, folder, section=200, gap=10).collect()
    assert sorted(r.page_id for r in got) == [0, 10, 20, 30, 40] and {bytes(r.payload) for r in got} == {b"same"}


def test_archives_are_gzip_members_that_any_reader_opens(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>"), (2, "v", "<p>x</p>")], "page_id long, url string, html string")
    index, folder = warc.archive_pages(spark, df)
    fs, base = common.filesystem(folder)
    whole = b"".join(gzip.decompress(fs.open_input_file(f"{base}/{a}").read()) for a in sorted({r.archive for r in index.collect()}))
    assert whole.count(b"WARC/1.1\r\n") == 2 and whole.count(b"WARC-Type: revisit") == 1


def test_empty_table_and_coalescing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index, folder = warc.archive_pages(spark, df)
    assert warc.read_records(index, folder).count() == 0
    assert warc.coalesced([(0, 10), (10, 10), (100, 5)], 20, 1000) == [(0, 20, [(0, 10), (10, 10)]), (100, 5, [(100, 5)])]
    assert [r[:2] for r in warc.coalesced([(0, 10), (10, 10)], 20, 15)] == [(0, 10), (10, 10)]
