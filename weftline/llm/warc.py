"""Operator 1: a WARC writer with dictionary compression, and its reader.

Records with equal payloads are found by their digests: one is written whole, the others revisit
it. Every writing task builds a Zstandard dictionary from the first records of each archive,
puts it in a skippable frame before all others and compresses each record to a frame of its own,
so any record can be read with the archive's first frame alone. Tasks write to the shared folder
under names of their own attempt; the manifest names the archives of the attempts that counted, and its rows
are what the reader's tasks open.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import new_dir, shuffle_partitions

#: Magic number of the skippable frame that holds an archive's dictionary.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string"


def _safe(value: str) -> str:
    """A header value on one line: control characters and % as %XX."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 or c == "%" else c for c in value)


def _plain(value: str) -> str:
    parts = value.split("%")
    return parts[0] + "".join(chr(int(x[:2], 16)) + x[2:] for x in parts[1:])


def digest(payload: bytes) -> str:
    """SHA-1 in base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def info(label: str, date: str) -> bytes:
    """The warcinfo record at the beginning of an archive."""
    block = b"software: weftline\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:archive:{label}>", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest_: str, length: int, date: str, copy: str = "") -> bytes:
    """A response record, or with ``refers_to`` a revisit record, which has no payload. ``copy`` tells records of one page_id apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}"]
    lines += [f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}{copy and ':'}{copy}>"]
    lines += [] if url is None else [f"WARC-Target-URI: {_safe(url)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest_}"]
    lines += [] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    number = lambda x: None if x is None or x.startswith("<urn:page:null") else int(x[:-1].split(":")[2])
    url, stated = fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != stated):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    whole = payload if fields["WARC-Type"] == "response" else None
    return number(fields["WARC-Record-ID"]), None if url is None else _plain(url), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), length, stated, whole


class ArchiveWriter:
    """One archive after another in a folder; an archive has at most about ``most`` bytes."""

    def __init__(self, folder: str, level: int, dict_size: int, sample: int, most: int, date: str):
        self.files, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.uri, self.date = folder, date
        self.level, self.dict_size, self.sample, self.most = level, dict_size, sample, most
        context = TaskContext.get()
        self.label = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        self.done: list[tuple[str, int, int]] = []
        self.waiting: list[bytes] = []
        self.held = 0
        self.out = None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= self.sample:
                self.open()
            return
        self.put(data)

    def open(self) -> None:
        """Start an archive with the dictionary of the records that wait."""
        self.name = f"{self.label}-{len(self.done):04d}.warc.zst"
        self.out, self.size, self.count = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0, 0
        try:
            words = zstandard.train_dictionary(self.dict_size, self.waiting).as_bytes()
        except zstandard.ZstdError:  # too few or too small records: what they hold serves as it is
            words = b"".join(self.waiting)[: self.dict_size] + bytes(8)
        kind = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_AUTO)
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=kind, write_checksum=True)
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(words)) + words)
        first = self.packer.compress(info(self.name, self.date))
        self.out.write(first)
        self.size += 8 + len(words) + len(first)
        waiting, self.waiting, self.held = self.waiting, [], 0
        for data in waiting:
            self.add(data)  # waits again if the archive is full by then

    def put(self, data: bytes) -> None:
        frame = self.packer.compress(data)
        self.out.write(frame)
        self.size += len(frame)
        self.count += 1
        if self.size >= self.most:
            self.end()

    def end(self) -> None:
        self.out.close()
        self.done.append((f"{self.uri}/{self.name}", self.count, self.size))
        self.out = None

    def close(self) -> None:
        while self.out is not None or self.waiting:
            if self.out is None:
                self.open()
            else:
                self.end()


def write_archives(
    pages: DataFrame, folder: str, least: int = 0, level: int = 3, dict_size: int = 32 << 10, sample: int = 1 << 20, most: int = 64 << 20, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in ``folder``, a URI that driver and executors share; returns the
    manifest (path, records, bytes).

    Of rows with equal payloads of at least ``least`` bytes that with the smallest page_id is written as a response,
    the others as revisits of it; rows that share that page_id too are all responses. Rows with a null page_id revisit
    one that has an id, or are responses. A null html is an empty payload, a null url has no header; payloads may be of any length.
    Repeated rows are records of their own, with ids of their own. An empty table makes no archive; other columns are ignored.
    ``sample`` bytes of records train an archive's dictionary. Only digests are grouped; payloads are dealt by page and digest.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text.alias("html"), F.sha1(text.cast("binary")).alias("sha1"), F.octet_length(text).alias("length"))
    # rows without an id are told apart by their address
    rows = rows.withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("null:"), F.hex(F.xxhash64("url")))))
    first = rows.where(F.col("length") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = rows.select("page", "page_id", "sha1").join(first, "sha1").where(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    joined = rows.join(again.select("page", "sha1", F.col("first").alias("refers_to")).distinct(), ["page", "sha1"], "left")
    copy = F.row_number().over(Window.partitionBy("page", "sha1").orderBy("url")) - 1
    named = F.when(F.col("page_id").isNull(), F.concat_ws(":", F.substr("page", F.lit(6)), "sha1", copy)).otherwise(F.when(copy > 0, F.concat_ws(":", "sha1", copy)).otherwise(""))
    ready = joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "sha1", "length", "refers_to", named.alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, level, dict_size, sample, most, date)
        for batch in batches:
            for part in range(0, len(batch), 256):
                for row in batch.slice(part, 256).to_pylist():
                    stated = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                    writer.add(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"], stated, row["length"], date, row["copy"]))
        writer.close()
        paths, counts, sizes = zip(*writer.done, strict=True) if writer.done else ((), (), ())
        yield pa.record_batch({"path": pa.array(paths, pa.string()), "records": pa.array(counts, pa.int64()), "bytes": pa.array(sizes, pa.int64())})

    ready.mapInArrow(run, "path string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def frames(source: pa.NativeFile, step: int = 16 << 10) -> Iterator[bytes]:
    """The records of an archive, read as a stream."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    kind = zstandard.ZstdCompressionDict(source.read(size), dict_type=zstandard.DICT_TYPE_AUTO)
    reader = zstandard.ZstdDecompressor(dict_data=kind)
    data = source.read(step)
    while data:
        frame = reader.decompressobj()
        parts = [frame.decompress(data)]
        while not frame.eof:
            data = source.read(step)
            if not data:
                raise ValueError("the last frame is cut off")
            parts.append(frame.decompress(data))
        data = frame.unused_data or source.read(step)
        yield b"".join(parts)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives whose URIs are in ``path``. Payload lengths and digests are checked against what is read; those of a
    revisit are as its record states them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple], archive: str) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = [x.split()[0] for x in RECORDS.split(", ")]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.record_batch([*columns, pa.array([archive] * len(rows), pa.string())], names=names)

        for uri in (x for batch in batches for x in batch.column("path").to_pylist()):
            files, path = pyarrow.fs.FileSystem.from_uri(uri)
            with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as source:
                rows, held = [], 0
                for data in frames(source):
                    if data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo"):
                        continue
                    row = parse(data)
                    rows.append(row if with_payload else (*row[:-1], None))
                    held += len(data)
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield made(rows, uri)
                        rows, held = [], 0
                if rows:
                    yield made(rows, uri)

    return archives.select("path").repartition(shuffle_partitions(archives.sparkSession)).mapInArrow(run, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_dir(spark, "warc"))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_base32 = lambda group: "".join(f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {1 + 5 * group}, 5) AS BIGINT) >> {15 - 5 * k}) & 31), 1)" for k in range(4))
WARC_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, ''{"".join(map(_base32, range(8)))} AS payload_digest, CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first OR page_id IS NULL THEN first END AS refers_to FROM p
"""
