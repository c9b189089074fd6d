"""WARC archives compressed by Zstandard with a dictionary.

An archive begins with a skippable frame that holds its dictionary, followed by one frame for each
record. The reader loads the dictionary from that frame (also if it is compressed itself, and
archives without one), finds each frame's end from its block headers, decodes one frame at a time, and
checks what it reads: the record's version line, its mandatory headers, the length of the block, the
digest of the payload, and the number of records that an archive's name tells. The dictionary is trained on the first 8 KB of an
archive's first SAMPLES payloads; records are whole. ``WarcError`` names the archive and the byte.

Writing is deterministic: rows are dealt and sorted by id, an archive's name comes from its partition
and number, and a file appears under its name only when complete. A task that runs twice, or
twice at once, leaves the same bytes; a lost executor leaves nothing else.

Of records with equal payloads the one with the largest page_id is the response, others are revisits
that refer to it and hold no payload. Groups of copies are aggregated before they are shuffled, and only
ids and digests are; the html moves once, by page_id.

Defined cases: null html is an empty payload; a null url gives a URI made from the id; rows without an
id are responses that nothing refers to; rows with equal ids and payloads are written each, as
responses where that id is the largest, and share a record id (rows of one id and different payloads do not); an empty table gives an empty folder and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import arrow_batches, arrow_schema, saved, shared_dir, sliced

#: Fixed values of the formats: the magic numbers of a dictionary's skippable frame, a frame, a dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: Uncompressed bytes after which an archive ends, bytes of its dictionary, payloads that it is trained on.
ARCHIVE, DICT_BYTES, SAMPLES = 16 << 20, 16 << 10, 200
#: How an archive's name tells its number of records.
COUNT = re.compile(r"\.r([0-9]+)\.warc\.zst$")
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that is not what the format asks for."""


def b32sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record_id(page_id: int | None, digest: str) -> str:
    """Names a record by its id and payload: rows of one id have records of their own unless their payloads are equal too."""
    return f"<{uri(page_id)}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of one record: a response with its HTTP block, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = b32sha1(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else uri(page_id)
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes], most: int = DICT_BYTES) -> bytes:
    """A dictionary; empty if the samples are too few or too alike for one."""
    try:
        return zstandard.train_dictionary(most, [s[:8192] for s in samples if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def archive(records: list[bytes], dictionary: bytes) -> bytes:
    out = io.BytesIO()
    if dictionary:
        packed = zstandard.ZstdCompressor().compress(dictionary)
        out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    for r in records:
        out.write(coder.compress(r))
    return out.getvalue()


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at a byte ends, from its header and its blocks' headers."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise WarcError(f"no frame at byte {at}")
    kind = data[at + 4]
    single, end = kind >> 5 & 1, at + 5
    end += (1 - single) + (0, 1, 2, 4)[kind & 3] + ((1 if single else 0), 2, 4, 8)[kind >> 6]
    while True:
        if end + 3 > len(data):
            raise WarcError(f"the frame at byte {at} is cut off")
        head = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            end += 4 * (kind >> 2 & 1)
            if end > len(data):
                raise WarcError(f"the frame at byte {at} is cut off")
            return end


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(first byte, decoded bytes) of each record's frame."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        own = bytes(view[8:at])
        if len(own) != at - 8:
            raise WarcError("the dictionary is cut off")
        if own[:4] == struct.pack("<I", FRAME):
            own = zstandard.ZstdDecompressor().decompressobj().decompress(own)
        if own[:4] != struct.pack("<I", DICTIONARY):
            raise WarcError("the leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(own)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        end = frame_end(view, at)
        try:
            yield at, decoder.decompressobj().decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {at} can't be decoded: {e}") from e
        at = end


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, checked."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not sep or version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line, or headers without end")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if h not in headers]:
        raise WarcError(f"headers missing: {missing}")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes; Content-Length is {n}")
    return headers, rest[:n]


def page(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of a checked record."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    lengths = [int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.lower() == b"content-length"]
    if not sep or not lengths:
        raise WarcError("no HTTP head with a Content-Length")
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    of = lambda name: int(x) if (x := headers[name].strip("<>").split(":")[2]) else None
    if kind == "response":
        if len(payload) != lengths[0] or b32sha1(payload) != digest:
            raise WarcError("the payload is not as long as stated or has another digest")
        return of("warc-record-id"), headers.get("warc-target-uri"), payload, len(payload), digest, kind, None
    if kind != "revisit" or payload or "warc-refers-to" not in headers:
        raise WarcError(f"neither a response nor a revisit: {kind}")
    return of("warc-record-id"), headers.get("warc-target-uri"), None, lengths[0], digest, kind, of("warc-refers-to")


def write(pages: DataFrame, path: str) -> DataFrame:
    """Write archives of page_id, url and html (others are left out) into a folder; returns name and records of each.

    path: a folder that every executor can write, of a file system that Arrow knows (file, hdfs, s3, gs).
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    keys = rows.select("page_id", F.unhex(F.sha2(F.encode("html", "UTF-8"), 256)).alias("key"))
    largest = keys.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = keys.join(largest, "key").where("page_id <> refers_to").select(F.col("page_id").alias("id"), "key", "refers_to").distinct()
    # Rows with equal ids are told apart by their payloads.
    told = rows.withColumn("own", F.unhex(F.sha2(F.encode("html", "UTF-8"), 256)))
    told = told.join(revisits, (F.col("page_id") == F.col("id")) & (F.col("own") == F.col("key")), "left").select("page_id", "url", "html", "refers_to")
    out = "name string, records long"
    schema = arrow_schema(pages.sparkSession, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        attempt = TaskContext.get().taskAttemptId()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            name = f"part-{part:06d}-{number:05d}.r{len(held)}.warc.zst"
            data = archive([r for r, _ in held], trained([p for _, p in held[:SAMPLES]]))
            with store.open_output_stream(f"{folder}/.{name}.{attempt}") as f:
                f.write(data)
            store.move(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")
            done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], schema=schema)
            number, held, size = number + 1, [], 0
            return done

        for batch in sliced(batches):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                held.append((record(page_id, url, payload, refers_to), payload))
                size += len(payload)
                if size >= ARCHIVE:
                    yield flush()
        if held:
            yield flush()

    with arrow_batches(pages.sparkSession, 256):
        return saved(told.sortWithinPartitions("page_id", "url", "html").mapInArrow(run, out), "manifest")


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark, path: str) -> DataFrame:
    """The checked records of all archives in a folder, by Spark's own reader of binary files."""
    schema = arrow_schema(spark, READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    at = count = 0
                    try:
                        for at, one in frames(data):
                            yield page(*parsed(one))
                            count += 1
                    except WarcError as e:
                        raise WarcError(f"{name}, record at byte {at}: {e}") from e
                    if (told := COUNT.search(name)) and int(told[1]) != count:
                        raise WarcError(f"{name}: {count} records, not {told[1]}")

        held, size = [], 0
        for r in rows():
            held.append(r)
            size += len(r[2] or b"")
            if size > 4 << 20 or len(held) >= 2000:
                yield as_batch(held, schema)
                held, size = [], 0
        if held:
            yield as_batch(held, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("path", "content").mapInArrow(run, READ)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, check that the archives there are as many records as were written, and read.

    An archive's name tells how many records it holds; the reader holds each archive against its name.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    written = write(pages, path).agg(F.sum("records")).first()[0]
    if not written:
        return spark.createDataFrame([], READ)
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    there = names.agg(F.sum(F.regexp_extract("path", COUNT.pattern, 1).cast("long"))).first()[0]
    if there != written:
        raise WarcError(f"{path}: archives of {there} records, not {written}")
    return read(spark, path)


def op1(pages: DataFrame) -> DataFrame:
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last_id FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NULL OR page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL WHEN page_id IS NULL THEN NULL ELSE last_id END AS refers_to
FROM q
"""
