import base64
import hashlib
import re

import pytest
import zstandard

from codefacts.llm import warc_zstd as w


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    return make


def test_round_trip(pages):
    rows = [(i, f"http://x/{i}?é", f"<html>{'body ' * (i % 7)}{i % 40}</html>") for i in range(300)]
    rows += [(400, None, None), (401, "http://y/ \r\nz", ""), (None, "u", "lone"), (402, "u", "lone"), (403, "u", "lone"), (402, "u", "lone"), (403, "u", "lone"), (404, "v", "ñ" * 200000)]
    found = w.round_trip(pages(rows)).collect()
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    expected = []
    for i, _, h in rows:
        h = h or ""
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        revisit = i is not None and i != last[h]
        expected.append((i, len(h.encode()), digest, "revisit" if revisit else "response", last[h] if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == sorted(expected, key=repr)
    bodies = {r.page_id: r.payload for r in found if r.record_type == "response" and r.page_id is not None}
    assert all(bytes(b).decode() == next(h or "" for j, _, h in rows if j == i) for i, b in bodies.items())
    assert w.op1(pages([])).collect() == []


def test_archive_layout():
    records = [w.record(i, "http://a", f"<p>hello {i} world {i * i}</p>".encode() * 9, None) for i in range(300)]
    dictionary = w.trained(records, 4096)
    assert dictionary
    data = w.archive(records, dictionary)
    assert data[:4] == bytes.fromhex("5d2a4d18")
    found = list(w.frames(data))
    assert [r for _, r in found] == records
    at = found[7][0]
    own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj().decompress(data[at : found[8][0]])
    assert own == records[7]
    plain = (0x184D2A5D).to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary + data[found[0][0] :]
    assert [r for _, r in w.frames(plain)] == records
    assert [r for _, r in w.frames(w.archive(records, b""))] == records


def test_frame_ends():
    for level in (1, 19):
        for size in (0, 1, 255, 256, 70000, 400000):
            for known in (True, False):
                body = (b"abc%d" % size * size)[:size]
                coder = zstandard.ZstdCompressor(level=level, write_checksum=known, write_content_size=known)
                data = coder.compress(body) if known else coder.compressobj().compress(body) + b""
                if not known:
                    c = coder.compressobj()
                    data = c.compress(body) + c.flush()
                assert w.frame_end(memoryview(data + b"rest"), 0) == len(data)


def test_what_is_wrong_is_found():
    good = w.record(1, "http://a", b"<p>x</p>", None)
    headers, block = w.parsed(good)
    assert w.page(headers, block)[:4] == (1, "http://a", b"<p>x</p>", 8)
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: 8\r\n\r\nHTTP", good), good.replace(b"\r\n\r\n", b"", 1)):
        with pytest.raises(w.WarcError):
            w.page(*w.parsed(bad))
    with pytest.raises(w.WarcError):
        w.page(*w.parsed(good.replace(b"<p>x</p>", b"<p>y</p>")))
    data = w.archive([good], b"")
    for bad in (data[:-1], b"\0" + data, data[:-3] + b"\0\0\0"):
        with pytest.raises(w.WarcError):
            list(w.frames(bad))


def test_records_that_are_missing_are_noticed(pages, spark, tmp_path):
    rows = pages([(i, "u", f"<p>{i}</p>") for i in range(20)]).coalesce(1)
    w.write(rows, f"file://{tmp_path}/a").collect()
    (name,) = (p.name for p in (tmp_path / "a").glob("*.zst"))
    assert ".r20." in name
    data = (tmp_path / "a" / name).read_bytes()
    last = list(w.frames(data))[-1][0]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / name).write_bytes(data[:last])
    with pytest.raises(Exception, match="19 records, not 20"):
        w.read(spark, f"file://{tmp_path}/b").collect()


def test_record_ids_tell_payloads_apart(pages, spark, tmp_path):
    w.write(pages([(7, "u", "a"), (7, "u", "b"), (8, "u", "a")]), f"file://{tmp_path}/a").collect()
    found = [w.parsed(r)[0] for p in (tmp_path / "a").glob("*.zst") for _, r in w.frames(p.read_bytes())]
    ids = [h["warc-record-id"] for h in found]
    assert len(set(ids)) == 3
    assert [h["warc-refers-to"] in ids for h in found if "warc-refers-to" in h] == [True]


def test_session_settings_stay(pages, spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    w.op1(pages([(1, "u", "a")])).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
