from __future__ import annotations

import base64
import hashlib
import io
import struct

import pytest
import zstandard

from fleetvitals.llm import warc_zst
from fleetvitals.llm.warc_zst import WarcError

PAGES = "page_id bigint, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_against_plain_rules(spark):
    long = "<p>é日本</p>" * 60_000
    rows = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a\r\nEvil: 1", None), (4, "u", ""), (5, "u", long), (6, "u", long), (None, "n", "<p>x</p>"), (None, "n", "only nulls"), (None, "n", "only nulls"), (7, "u", "same"), (7, "v", "same"), (8, "é", "\r\n\r\n")]
    out = warc_zst.round_trip(spark.createDataFrame(rows, PAGES).repartition(3), with_payload=True).collect()
    least = {}
    for p, _, h in rows:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    want = []
    for p, _, h in rows:
        first = least.get(h or "")
        back = first if first is not None and p != first else None
        want.append((p, len((h or "").encode()), digest(h), "response" if back is None else "revisit", back))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(bytes(r.payload) == b"" for r in out if r.record_type == "revisit")
    assert {r.page_id: bytes(r.payload).decode() for r in out if r.record_type == "response" and r.page_id} == {1: "<p>x</p>", 3: "", 5: long, 7: "same", 8: "\r\n\r\n"}


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    out = warc_zst.round_trip(spark.createDataFrame(rows, PAGES), least_bytes=4).collect()
    assert {r.page_id: r.refers_to for r in out} == {1: None, 2: None, 3: None, 4: 3}


def test_empty_and_clashing(spark):
    assert warc_zst.round_trip(spark.createDataFrame([], PAGES)).collect() == []
    df = spark.createDataFrame([(1, "u", "x", "p", "f", "s")], PAGES + ", payload string, first string, sum string")
    assert [(r.page_id, r.record_type) for r in warc_zst.round_trip(df).collect()] == [(1, "response")]


class Kept(io.BytesIO):
    def close(self):
        self.held = self.getvalue()
        super().close()


def archive(n=400):
    out = Kept()
    made = warc_zst.Archive(out)
    for i in range(n):
        made.add(warc_zst.record(i, f"http://x/{i}", (f"<html><body>page {i} " + "common words here " * 200).encode(), None))
    made.close()
    return out.held


def test_archive_form():
    data = archive()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    held = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)).decompressobj()
    assert first.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n") and first.unused_data
    records = [warc_zst.parse(x) for x in warc_zst.frames(io.BytesIO(data))]
    assert [r["warc-record-id"] for r in records] == [f"<urn:page:{i}>" for i in range(400)]


def test_archive_without_dictionary_and_with_raw_one():
    data = archive(2)
    assert data[:4] == warc_zst.ZSTD_MAGIC
    assert len(list(warc_zst.frames(io.BytesIO(data)))) == 2
    big = archive()
    size = struct.unpack("<I", big[4:8])[0]
    held = zstandard.ZstdDecompressor().decompress(big[8 : 8 + size])
    plain = struct.pack("<II", warc_zst.SKIPPABLE, len(held)) + held + big[8 + size :]
    assert len(list(warc_zst.frames(io.BytesIO(plain)))) == 400
    assert list(warc_zst.frames(io.BytesIO(b""))) == []


def test_damage_is_found():
    data = archive(3)
    with pytest.raises(WarcError):
        list(warc_zst.frames(io.BytesIO(data[:-3])))
    hurt = bytearray(data)
    hurt[len(data) // 2] ^= 0xFF
    with pytest.raises(WarcError):
        [warc_zst.parse(x) for x in warc_zst.frames(io.BytesIO(bytes(hurt)))]
    good = warc_zst.record(1, "u", b"payload", None)
    warc_zst.parse(good)
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/0.9"), good.replace(b"payload\r\n", b"paylord\r\n"), good[:-1], good + b"x",
        good.replace(b"WARC-Date", b"WARC-Bate"), good.replace(b"WARC-Type: response", b"WARC-Type response"),
        good.replace(b"Content-Type: app", b"WARC-Date: app"), good.replace(b"\r\n\r\n", b"\r\n"),
    ):
        with pytest.raises(WarcError):
            warc_zst.parse(bad)
