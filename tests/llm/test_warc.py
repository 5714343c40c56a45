import gzip
import hashlib
import io
import re
import zlib

import pytest

from blockwalk.llm import warc


def write_and_read(spark, tmp_path, rows, schema="page_id long, url string, html string, digest int, payload string", **kw):
    pages = spark.createDataFrame(rows, schema)
    files = warc.write_archives(warc.revisits(pages), f"file://{tmp_path}/w", **kw)
    return pages, files, warc.read_archives(files, keep_payload=True)


def test_round_trip_with_revisits(spark, tmp_path):
    long, other = "<p>é</p>" * 300, "<b>" * 400
    rows = [(i, f"http://x/{i}", long, 1, "z") for i in (3, 9, 5)] + [(7, "u\r\nX: y", other, 1, "z"), (8, None, "short", 1, "z"), (10, "v", "short", 1, "z")]
    rows += [(1, "n", None, 1, "z"), (2, "e", "", 1, "z"), (None, "k", long, 1, "z")]
    pages, files, back = write_and_read(spark, tmp_path, rows)
    got = {r["page_id"]: r for r in warc.resolved(back).collect()}
    assert len(got) == len(rows)
    for number, _, html, *_ in rows:
        body = (html or "").encode()
        r = got[number]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        first = 9 if html == long and number != 9 else None
        assert (r["record_type"], r["refers_to"]) == ("revisit" if first else "response", first)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in back.filter("record_type = 'response'").collect()}
    assert texts == {9: long, 7: other, 8: "short", 10: "short", 1: "", 2: ""}
    assert {r["url"] for r in back.filter("page_id = 7").collect()} == {"u%0D%0AX: y"}
    assert warc.archives(spark, f"file://{tmp_path}/w").count() == files.count()


def test_one_member_per_record_and_rolling_files(spark, tmp_path):
    rows = [(i, "u", str(i) * 2000, 1, "z") for i in range(12)]
    _, files, back = write_and_read(spark, tmp_path, rows, file_bytes=300)
    assert files.count() > 4
    listed = files.collect()
    assert sum(r["records"] for r in listed) == 12
    for r in listed:
        raw = open(r["file"].removeprefix("file://"), "rb").read()
        members, at = 0, raw
        while at:
            d = zlib.decompressobj(31)
            text = d.decompress(at)
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and text.count(b"WARC/1.1") == 1
            members, at = members + 1, d.unused_data
        assert members == r["records"]
    assert back.count() == 12


def test_repeated_rows_and_empty_table(spark, tmp_path):
    same = "y" * 1500
    _, _, back = write_and_read(spark, tmp_path, [(4, "u", same, 1, "z")] * 3 + [(2, "u", same, 1, "z")])
    got = sorted(map(tuple, warc.resolved(back).select("page_id", "payload_bytes", "record_type", "refers_to").collect()))
    assert got == [(2, 1500, "revisit", 4)] + [(4, 1500, "response", None)] * 3
    _, files, back = write_and_read(spark, tmp_path, [], )
    assert files.count() == 0 and warc.resolved(back).collect() == []


def record(payload, **kw):
    return warc.member("response", 1, "u", payload, hashlib.sha1(payload).digest(), None, "2024-01-01T00:00:00Z", 6)


def test_reader_is_incremental_and_large_payloads_pass():
    payload = bytes(range(256)) * 20_000
    raw = record(payload) + record(b"")
    found = list(warc.read_records(io.BytesIO(raw), keep_payload=True))
    assert [r.payload for r in found] == [payload, b""]


@pytest.mark.parametrize("harm", ["digest", "length", "cut", "noise", "two"])
def test_damage_is_reported(harm):
    text = gzip.decompress(record(b"hello world"))
    if harm == "digest":
        text = text.replace(b"hello", b"hallo")
    if harm == "length":
        text = re.sub(rb"Content-Length: (\d+)", lambda m: b"Content-Length: %d" % (int(m[1]) - 1), text)
    if harm == "two":
        text = text + text
    raw = gzip.compress(text)
    raw = raw[:-9] if harm == "cut" else raw + b"noise" if harm == "noise" else raw
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(raw)))
