"""Web archives with a Zstandard dictionary: a leading skippable frame holds it, each record is a frame of its own.

Payload digests find equal payloads; of those the record with the smallest page_id is a response and the others revisit it. Each
task buffers its records up to file_bytes, trains a dictionary on them, and writes one archive per buffer to the shared folder.
Reading opens the dictionary frame first and then walks the records.

Defined results: a null html is an empty payload; a null url becomes urn:page:<id>; equal payloads whose smallest page_id is
null (all are) or repeated are responses there; empty tables write nothing; payloads under min_revisit_bytes are all responses.
Memory: file_bytes of records and the dictionary a task.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

FILE_BYTES = 64 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of records that a dictionary is trained on.
SAMPLE_BYTES = 2 << 20
DICTIONARY_FRAME = 0x184D2A5D
_DATE = "2024-01-01T00:00:00Z"


def label(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """pages' page_id, url, html with the smallest page_id that has the same payload in `first_id` (null where there's one record)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    keyed = p.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    groups = keyed.where(F.octet_length("html") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups.drop("n"), "digest", "left").drop("digest")


def record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None) -> bytes:
    """One WARC/1.1 record; a revisit of first_id where that is another id."""
    revisit = first_id is not None and first_id != page_id
    name = "" if page_id is None else str(page_id)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{name}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first_id}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES):
    """A dictionary trained on an even choice of the records; where they're too few to train on, their heads as raw content."""
    import zstandard as z

    step = max(1, sum(map(len, records)) // sample_bytes)
    sample = [r[: 64 << 10] for r in records[::step]]
    try:
        return z.train_dictionary(min(size, max(1024, sum(map(len, sample)) // 10)), sample)
    except z.ZstdError:
        return z.ZstdCompressionDict(b"".join(r[:4096] for r in sample)[-size:] or b"WARC/1.1", z.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3) -> bytes:
    import zstandard as z

    d = dictionary(records)
    raw = d.as_bytes()
    press = z.ZstdCompressor(level=level, dict_data=d, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *map(press.compress, records)])


def records(data: bytes):
    """(headers, http headers, payload) of each record of an archive."""
    import zstandard as z

    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame leads the archive")
    raw = data[8 : 8 + size]
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    d = z.ZstdCompressionDict(raw, z.DICT_TYPE_FULLDICT if trained else z.DICT_TYPE_RAWCONTENT)
    stream = io.BufferedReader(z.ZstdDecompressor(dict_data=d).stream_reader(io.BytesIO(memoryview(data)[8 + size :]), read_across_frames=True), 1 << 16)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("a record does not begin where it should")
        head = {}
        while line := stream.readline().strip():
            key, _, value = line.partition(b":")
            head[key.decode().lower()] = value.strip().decode()
        http, _, payload = stream.read(int(head["content-length"])).partition(b"\r\n\r\n")
        stream.read(4)
        yield head, http, payload


def write(pages: DataFrame, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write the archives; (folder, manifest of file, n_records)."""

    def run(folder):
        def files(batches):
            part, seq, have, size = TaskContext.get().partitionId(), 0, [], 0

            def flush():
                nonlocal seq, have, size
                name = store.put(folder, f"part-{part:06d}-{seq:06d}.warc.zst", archive(have))
                row = pa.RecordBatch.from_pydict({"file": [name], "n_records": [len(have)]})
                seq, have, size = seq + 1, [], 0
                return row

            for batch in batches:
                for page_id, url, html, first_id in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first_id"))):
                    have.append(record(page_id.as_py(), url.as_py(), html.as_py().encode(), first_id.as_py()))
                    size += len(have[-1])
                    if size >= file_bytes:
                        yield flush()
            if have:
                yield flush()

        return files

    return store.write(label(pages, min_revisit_bytes).select("page_id", "url", "html", "first_id"), run, "file string, n_records long", "warc")


def read(spark, folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the archives; with_payload adds url and payload (null for revisits)."""
    schema = "file string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    number = lambda uri: int(x) if uri and (x := uri.strip("<>").removeprefix("urn:page:")) else None

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                rows = []
                for head, http, payload in records(data.as_buffer().to_pybytes()):
                    kind = head["warc-type"]
                    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                    row = (name, number(head["warc-record-id"]), size, head["warc-payload-digest"].removeprefix("sha1:"), kind, number(head.get("warc-refers-to")))
                    rows.append((*row, head["warc-target-uri"], payload if kind == "response" else None) if with_payload else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: 8 if with_payload else 6]
    names = ["file", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: len(types)]
    return store.read(spark, folder, manifest.select("file"), run, schema + (", url string, payload binary" if with_payload else "")).drop("file")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first_id, sha1(h) AS x FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((((strpos('0123456789abcdef', x[(5 * i) // 4 + 1]) - 1) * 16 + coalesce(nullif(strpos('0123456789abcdef', coalesce(nullif(x[(5 * i) // 4 + 2], ''), '0')), 0), 1) - 1) >> (3 - (5 * i) % 4)) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
