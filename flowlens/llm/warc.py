"""WARC archives with a Zstandard dictionary in front.

Every task writes its pages to archives of its own: it holds back the first records, trains a dictionary from them,
puts the dictionary in a leading skippable frame and compresses every record as a frame by itself, so that a reader
can start at any record. An archive ends at a size and the next one trains anew. Which pages are revisits is found
before, by a count of payload digests combined ahead of its shuffle.

Tasks may run twice: archives have names that no other attempt uses, and the manifest, which Spark commits once for
each task, lists those that count.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import small_batches, written

#: Payloads of at least so many bytes are looked for among earlier ones.
REVISIT_BYTES = 0
#: Bytes of records that a dictionary is trained from, its size, and bytes after which an archive ends.
SAMPLE_BYTES, DICT_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 10, 64 << 20
#: The frame type that the WARC-Zstandard specification gives to dictionaries.
DICT_MAGIC = 0x184D2A5D
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, bytes long"
RECORD = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _name(page_id: str | None) -> str:
    """The URN of a page, with all that an id may hold escaped; rows without an id share one."""
    return "<urn:x-no-page:>" if page_id is None else f"<urn:x-page:{quote(page_id, safe='')}>"


def _id(name: str | None) -> str | None:
    return unquote(name[len("<urn:x-page:") : -1]) if name is not None and name.startswith("<urn:x-page:") else None


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response, or a revisit that keeps the HTTP head and leaves out the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_uri(url)}"] if url is not None else []
    lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def train(samples: list[bytes]):
    """A dictionary from the samples; where they are too few to train from, they are the dictionary themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:].rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """One .warc.zst file, written as records come."""

    def __init__(self, root: str, samples: list[bytes]) -> None:
        import zstandard

        self.path = f"{root}/pages-{uuid.uuid4().hex}.warc.zst"
        store, path = _store(self.path)
        self.sink = store.open_output_stream(path, compression=None)  # else the suffix would have it compressed once more
        learned = train(samples)
        self.sink.write(struct.pack("<II", DICT_MAGIC, len(learned.as_bytes())) + learned.as_bytes())
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=learned, write_content_size=True, write_checksum=True).compress
        self.records, self.bytes = 0, 8 + len(learned.as_bytes())

    def add(self, raw: bytes) -> None:
        frame = self.compress(raw)
        self.sink.write(frame)
        self.records, self.bytes = self.records + 1, self.bytes + len(frame)

    def close(self) -> tuple[str, int, int]:
        self.sink.close()
        return self.path, self.records, self.bytes


def _writer(root: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(root)
        store.create_dir(path, recursive=True)
        held: list[bytes] = []
        size, archive, done = 0, None, []

        def begin() -> Archive:
            nonlocal size
            new = Archive(root, held)
            for raw in held:
                new.add(raw)
            held.clear()
            size = 0
            return new

        for batch in batches:
            for page, url, html, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
                raw = record(page, url, html.encode("utf-8", "surrogatepass"), refers)
                if archive is None:
                    held.append(raw)
                    size += len(raw)
                    archive = begin() if size >= SAMPLE_BYTES else None
                else:
                    archive.add(raw)
                if archive is not None and archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if held:
            archive = begin()
        if archive is not None:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes the pages under root and returns the manifest: archive, records, bytes.

    Defined cases: null html is an empty payload; a null url leaves its header out; ids may hold any characters; a null
    id is written as a name of its own and is no candidate to refer to; rows that share the smallest id of their payload are all responses; an empty table
    writes no archive.
    """
    small_batches(pages.sparkSession)
    page_id = F.col(id_col)
    rows = pages.select(page_id.alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha2("html", 256))
    firsts = rows.where(F.octet_length("html") >= revisit_bytes).groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where("n > 1").select("key", "first"), "warc-firsts")
    refers = F.when(F.col("id").isNull() | (F.col("first") < F.col("id")), F.col("first"))
    linked = rows.join(firsts, "key", "left").select(
        F.col("id").cast("string").alias("page_id"), "url", "html", refers.cast("string").alias("refers_to")
    )
    return written(linked.mapInPandas(_writer(root), MANIFEST), "warc-manifest")


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive, one record in memory at a time."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    raw = source.read(size)
    kind = zstandard.DICT_TYPE_AUTO
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind)).stream_reader(source, read_across_frames=True), 1 << 18)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        stream.read(4)
        yield headers, block


def _parsed(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    page = _id(headers["WARC-Record-ID"])
    own, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != own):
        raise ValueError(f"the payload of page {page} isn't what was archived")
    return page, headers.get("WARC-Target-URI"), payload if kind == "response" else None, size, own, kind, _id(headers.get("WARC-Refers-To"))


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        for path in batch["archive"]:
            store, local = _store(path)
            with store.open_input_stream(local, compression=None) as source:
                rows, size = [], 0
                for headers, block in read_records(source):
                    rows.append(_parsed(headers, block))
                    size += len(block)
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records of the manifest's archives: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to. A payload that doesn't match its digest fails the job."""
    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return manifest.select("archive").repartition(n).mapInPandas(_reader, RECORD)
