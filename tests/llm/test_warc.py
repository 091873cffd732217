import base64
import hashlib
import struct

import pytest
import zstandard
from tests.llm.helpers import prose

from flowlens.llm import warc
from flowlens.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, refers_to int, key int"


def pages(spark):
    rows = [(k, f"http://h/{k}?a b", f"<p>{prose(40, k % 5)}</p>é" if k % 3 else "<p>same</p>") for k in range(60)]
    rows += [(70, None, None), (71, "u", ""), (72, "u\r\nX: y", "<b>"), (None, "u", "<p>same</p>"), (73, "long", prose(50_000)), (5, "http://h/5?a b", rows[5][2])]
    return spark.createDataFrame([r + (1, 2) for r in rows], SCHEMA)


def brute(rows):
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(r.page_id, first.get(r.html or "", r.page_id))
    out = []
    for r in rows:
        body = (r.html or "").encode()
        revisit = first.get(r.html or "") is not None and r.page_id != first[r.html or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((r.page_id, len(body), digest, "revisit" if revisit else "response", first[r.html or ""] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    docs = pages(spark)
    manifest = warc.write_archives(docs.repartition(3), scratch_path(spark, "warc-test"))
    assert sum(r.records for r in manifest.collect()) == docs.count()
    got = warc.read_archives(spark, manifest).collect()
    seen = [(None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got]
    assert sorted(seen, key=str) == brute(docs.collect())
    texts = {r.page_id: r.html for r in docs.collect()}
    assert all(bytes(r.payload).decode() == (texts[int(r.page_id)] or "") for r in got if r.record_type == "response" and r.page_id)


def test_frames_are_records_and_the_dictionary_leads(spark):
    manifest = warc.write_archives(pages(spark).repartition(1), scratch_path(spark, "warc-test")).collect()
    raw = open(manifest[0].archive.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and raw[8:12] == b"\x37\xa4\x30\xec"  # a trained dictionary
    words = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    rest, n = raw[8 + size :], 0
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, n = one.unused_data, n + 1
    assert n == manifest[0].records


def test_archives_roll_over(spark, monkeypatch):
    root = scratch_path(spark, "warc-test")
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 2000)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    rows = [(str(k), "u", prose(90, k), None) for k in range(100)]
    import pandas as pd

    done = pd.concat(warc._writer(root)(iter([pd.DataFrame(rows, columns=["page_id", "url", "html", "refers_to"])])))
    assert len(done) > 3 and done["records"].sum() == 100


def test_small_payloads_are_no_revisits_below_the_limit(spark):
    docs = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = warc.read_archives(spark, warc.write_archives(docs, scratch_path(spark, "warc-test"), revisit_bytes=3)).collect()
    assert {r.page_id: r.record_type for r in got} == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_empty_table(spark):
    manifest = warc.write_archives(spark.createDataFrame([], SCHEMA), scratch_path(spark, "warc-test"))
    assert manifest.count() == 0 and warc.read_archives(spark, manifest).count() == 0


def test_damage_is_noticed():
    with pytest.raises(ValueError, match="isn't what was archived"):
        warc._parsed({"WARC-Record-ID": "<urn:x-page:1>", "WARC-Payload-Digest": "sha1:X", "WARC-Type": "response"}, b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\na")


def test_ids_of_any_characters(spark):
    ids = ["null", "", "a\nWARC-Type: revisit", "x>y", "é %41", None, "\r\n\r\n"]
    docs = spark.createDataFrame([(i, "u", f"page {k}") for k, i in enumerate(ids)] + [("zz", "u", "page 2")], "page_id string, url string, html string")
    got = warc.read_archives(spark, warc.write_archives(docs, scratch_path(spark, "warc-test"))).collect()
    assert sorted((r.page_id for r in got), key=str) == sorted([*ids, "zz"], key=str)
    assert [(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"] == [("zz", ids[2])]
