"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a bundle file is a run of frames and a footer, a
skippable frame with the seek table of the public seekable format (compressed and decompressed size of each frame). A
manifest maps every record id to its bundle, its frame, and offset and length inside the decompressed frame, so one
record is read by one frame's bytes.

Tasks write bundles into the shared folder under names made of partition and content, and the manifest is what Spark commits: a
task that is run again, or twice, leaves at most a bundle that no manifest names, and readers ask the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import pick, small_batches, stored
from riskspark.session import shared_folder

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20  # before compression
LEVEL = 6
DATE = "2020-01-01T00:00:00Z"  # records carry no clock time, so archives are the same each time they are made

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

NO_ID = "<urn:page>"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "record_id string, bundle string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
RECORD = "bundle string, record_id string, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None) -> str:
    """The record's URN, on one line for any text; a null id has no part of its own, so no text is taken for it."""
    return NO_ID if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def page_of(urn: str) -> str | None:
    """The page id of a record's URN."""
    return None if urn == NO_ID else unquote(urn.removeprefix("<urn:page:").removesuffix(">"))


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit of the response refers_to, without it."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if refers_to is None:
        block = HTTP_HEAD % len(payload) + payload
        head.append(("Content-Type", "application/http;msgtype=response"))
    else:
        block = b""
        head.append(("WARC-Refers-To", record_id(refers_to)))
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.append(("X-Payload-Length", str(len(payload))))
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[dict]:
    """Headers and payload of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines)
        first = end + 4
        block = data[first : first + int(head["Content-Length"])]
        revisit = head["WARC-Type"] == "revisit"
        payload = b"" if revisit else block[block.index(b"\r\n\r\n") + 4 :]
        yield {
            "record_id": head["WARC-Record-ID"],
            "page_id": page_of(head["WARC-Record-ID"]),
            "url": head.get("WARC-Target-URI"),
            "record_type": head["WARC-Type"],
            "refers_to": page_of(head["WARC-Refers-To"]) if revisit else None,
            "payload": payload,
            "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(payload),
            "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else payload_digest(payload),
            "stated_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
        }
        at = first + len(block) + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame with the (compressed, decompressed) size of every frame."""
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    body = entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int]]:
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    return list(struct.iter_unpack("<II", bundle[-9 - 8 * count : -9]))


class _Bundle:
    """A bundle being written; frames go to the file as they fill."""

    def __init__(self, folder: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder)
        self.draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)
        self.digest = hashlib.sha256()
        self.sizes: list[tuple[int, int]] = []
        self.frame: list[bytes] = []
        self.held = self.offset = self.total = 0
        self.rows: list[dict] = []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, page_id: str | None, record: bytes) -> None:
        if self.frame and self.held + len(record) > FRAME_BYTES:
            self.end_frame()
        self.rows.append({"record_id": record_id(page_id), "frame": len(self.sizes), "record_offset": self.held, "record_bytes": len(record)})
        self.frame.append(record)
        self.held += len(record)
        self.total += len(record)

    def write(self, data: bytes) -> None:
        self.digest.update(data)
        self.out.write(data)

    def end_frame(self) -> None:
        if self.frame:
            data = self.compressor.compress(b"".join(self.frame))
            self.sizes.append((len(data), self.held))
            self.write(data)
            self.frame, self.held = [], 0

    def close(self) -> pa.RecordBatch:
        """Finish the file; its part of the manifest."""
        self.end_frame()
        self.write(seek_table(self.sizes))
        self.out.close()
        name = f"{TaskContext.get().partitionId():06d}-{self.digest.hexdigest()[:40]}.warc.zst"
        self.fs.move(self.draft, f"{self.folder}/{name}")
        offsets = [0]
        for size, _ in self.sizes:
            offsets.append(offsets[-1] + size)
        for row in self.rows:
            row |= {"bundle": name, "frame_offset": offsets[row["frame"]], "frame_bytes": self.sizes[row["frame"]][0]}
        return pa.RecordBatch.from_pylist(self.rows, _MANIFEST_ARROW)


_MANIFEST_ARROW = pa.schema(
    {"record_id": pa.string(), "bundle": pa.string(), "frame": pa.int32(), "frame_offset": pa.int64()}
    | {"frame_bytes": pa.int64(), "record_offset": pa.int64(), "record_bytes": pa.int64()}
)


def plan_records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least: int = 0) -> DataFrame:
    """page_id (as text), url, payload and refers_to of every page.

    Of pages with equal payloads of at least `least` bytes the smallest id is the response. Rows of one id and one
    payload are alike: if theirs is the smallest id, all of them are responses. Null html is the empty payload. A null
    id is never the smallest, so it revisits where another id has the payload. Payloads are matched by SHA-256 and
    length; the digests are counted before they are shuffled, and a payload that many pages share is a skewed join key
    of narrow build side, which adaptive execution splits.
    """
    rows = pick(pages, page_id=id_column, url=url_column, html=html_column).select(
        "page_id", "url", F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    )
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    big = rows.filter(F.octet_length("payload") >= least) if least else rows
    firsts = big.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    joined = rows.join(firsts.select("key", "first"), "key", "left")
    return joined.select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "payload",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).cast("string").alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write bundles of the records into folder; the stored manifest (see MANIFEST)."""
    small_batches(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                bundle = bundle or _Bundle(folder)
                bundle.add(page_id.as_py(), make_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()))
                if bundle.total >= bundle_bytes:
                    yield bundle.close()
                    bundle = None
        if bundle:
            yield bundle.close()

    return stored(records.mapInArrow(write, MANIFEST), "manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The records (see RECORD) of all bundles that the manifest names, frame by frame by their seek tables.

    A response's payload is hashed again; a record whose payload does not match its stated digest is an error.
    """
    small_batches(spark)
    bundles = manifest.select("bundle").distinct()
    if bundles.isEmpty():
        return spark.createDataFrame([], RECORD).drop("bundle")
    files = spark.read.format("binaryFile").load(f"{folder}/*.warc.zst").select("content", F.element_at(F.split("path", "/"), -1).alias("bundle"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema({c.split()[0]: pa.int64() if c.endswith("long") else pa.string() for c in RECORD.split(", ")})
        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, content in zip(batch.column("bundle"), batch.column("content")):
                data, at = content.as_py(), 0
                for size, _ in read_seek_table(data):
                    rows = []
                    for row in read_records(decompressor.decompress(data[at : at + size])):
                        if row["payload_digest"] != row["stated_digest"]:
                            raise ValueError(f"{row['record_id']}: payload does not match its digest")
                        row["bundle"] = bundle.as_py()
                        rows.append({name: row[name] for name in kind.names})
                    at += size
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return files.mapInArrow(read, RECORD).join(bundles, "bundle", "left_semi").drop("bundle")


def fetch_record(folder: str, row: dict) -> bytes:
    """One record by its manifest row: a read of its frame alone."""
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{row['bundle']}") as file:
        file.seek(row["frame_offset"])
        frame = zstandard.ZstdDecompressor().decompress(file.read(row["frame_bytes"]))
    return frame[row["record_offset"] : row["record_offset"] + row["record_bytes"]]


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages as records into the shared folder and read the archives back: page_id and what a record says."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "llm-warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    manifest = write_archives(plan_records(pages, least=least), folder)
    return read_archives(spark, folder, manifest)
