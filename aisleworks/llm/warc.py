"""WARC archives as seekable Zstandard bundles: written in tasks, read back record by record.

Method: a task groups its records into frames that decompress on their own, appends frames to bundle files and
closes each bundle with a footer seek table (a skippable frame listing every frame's compressed and plain size).
The index maps a record to bundle, frame number and offset inside the plain frame. A reader finds the frame in the
seek table, decompresses that frame alone and parses the record at its offset.

Bundles are named by task attempt; only the index of a task that ended well names its bundles, so a lost or repeated
attempt leaves files that nothing refers to. Files are reached by URI, so the shared folder may be any store that
pyarrow can open.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleworks.llm.common import bounded_batches, run_folder, written

#: Plain bytes that a frame reaches before it is closed, and compressed bytes that a bundle reaches.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 32 << 20
#: Payloads shorter than this are stored each.
LEAST_SHARED = 1000
#: Magic numbers of skippable frames and of the seekable format: fixed values.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Profile of a record whose payload another record holds: a fixed value of the WARC standard.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, bundle string, frame int, position int"
RECORDS = "page_id long, record_type string, refers_to long, stated_digest string, payload binary"


def record_uri(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def page_of(uri: str) -> int | None:
    number = uri.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def make_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record where ``refers_to`` is given."""
    block = HTTP_HEAD + (payload or b"")
    kind = "response"
    more = []
    if refers_to is not None:
        kind, block = "revisit", HTTP_HEAD
        more = [f"WARC-Refers-To: <{record_uri(refers_to)}>", f"WARC-Profile: {SAME_PAYLOAD}"]
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else record_uri(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_uri(page_id)}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *more,
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: memoryview, start: int) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of the record at ``start`` of a plain frame."""
    reach = 65536
    while (head_end := bytes(data[start : start + reach]).find(b"\r\n\r\n")) < 0:  # a url may be of any length
        if start + reach >= len(data):
            raise ValueError("a record's head has no end")
        reach *= 4
    head = bytes(data[start : start + head_end]).decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in head[1:])
    body = start + head_end + 4
    block = bytes(data[body : body + int(fields["Content-Length"])])
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    content = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(content)) + content


class BundleWriter:
    """Appends records to frames, frames to bundles; ``places`` has (page id, bundle, frame, position) of what is closed."""

    def __init__(self, folder: str, stem: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.stem, self.bundles = stem, 0
        self.pack = zstandard.ZstdCompressor(level=3)
        self.out = None
        self.frame, self.frame_ids, self.frame_size = [], [], 0
        self.places: list[tuple] = []

    def add(self, page_id: int | None, record: bytes) -> None:
        self.frame_ids.append((page_id, self.frame_size))
        self.frame.append(record)
        self.frame_size += len(record)
        if self.frame_size >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if not self.frame:
            return
        if self.out is None:
            self.name = f"{self.stem}-{self.bundles:05d}.warc.zst"
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.sizes, self.bundles = [], self.bundles + 1
        data = self.pack.compress(b"".join(self.frame))
        self.out.write(data)
        self.places += [(page_id, self.name, len(self.sizes), position) for page_id, position in self.frame_ids]
        self.sizes.append((len(data), self.frame_size))
        self.frame, self.frame_ids, self.frame_size = [], [], 0
        if sum(size for size, _ in self.sizes) >= BUNDLE_BYTES:
            self._close_bundle()

    def _close_bundle(self) -> None:
        if self.out is not None:
            self.out.write(seek_table(self.sizes))
            self.out.close()
            self.out = None

    def close(self) -> None:
        self._close_frame()
        self._close_bundle()

    def taken_places(self) -> pa.RecordBatch:
        columns = list(zip(*self.places, strict=True)) or [()] * 4
        self.places = []
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "bundle", "frame", "position"]
        )


class BundleReader:
    """Plain frames of bundles by number, the last bundle's seek table and the last frame kept."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.unpack = zstandard.ZstdDecompressor()
        self.bundle, self.source, self.at = None, None, (None, -1)

    def _open(self, bundle: str) -> None:
        if self.source is not None:
            self.source.close()
        self.source, self.bundle = self.files.open_input_file(f"{self.folder}/{bundle}"), bundle
        size = self.source.size()
        count, _, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{bundle} has no seek table")
        entries = self.source.read_at(8 * count, size - 9 - 8 * count)
        self.starts, at = [], 0
        for packed, plain in struct.iter_unpack("<II", entries):
            self.starts.append((at, packed, plain))
            at += packed

    def frame(self, bundle: str, number: int) -> memoryview:
        if self.at != (bundle, number):
            if self.bundle != bundle:
                self._open(bundle)
            start, packed, plain = self.starts[number]
            data = self.unpack.decompress(self.source.read_at(packed, start), max_output_size=plain)
            self.at, self.plain = (bundle, number), memoryview(data)
        return self.plain


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes bundles of ``page_id, url, html, digest, refers_to`` rows below ``folder``; the index, written there too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer = BundleWriter(f"{folder}/bundles", f"{context.partitionId():06d}-{context.taskAttemptId()}")
        for batch in bounded_batches(batches, 4 << 20):
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = None if html is None else html.encode("utf-8")
                writer.add(page_id, make_record(page_id, url, payload, digest, refers_to))
            yield writer.taken_places()
        writer.close()
        yield writer.taken_places()

    ordered = pages.select("page_id", "url", "html", "digest", "refers_to")
    ordered.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Records of an index: ``page_id, record_type, refers_to, stated_digest, payload`` (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = BundleReader(f"{folder}/bundles")
        for batch in bounded_batches(batches, 16 << 10):
            rows = []
            for bundle, frame, position in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                fields, payload = parse_record(reader.frame(bundle, frame), position)
                kind = fields["WARC-Type"]
                rows.append(
                    (
                        page_of(fields["WARC-Record-ID"]),
                        kind,
                        page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
                        fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                        payload if kind == "response" else None,
                    )
                )
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["page_id", "record_type", "refers_to", "stated_digest", "payload"],
            )

    dealt = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "position")
    return dealt.mapInArrow(run, RECORDS)


def with_references(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """Digest of each payload and, for copies of a payload of some length, the largest page id that has it."""
    payload = F.encode(F.coalesce(F.col(html_column), F.lit("")), "UTF-8")
    keyed = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).alias("url"),
        F.col(html_column).alias("html"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).alias("bytes"),
    )
    keepers = (
        keyed.where(F.col("bytes") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 AND keeper IS NOT NULL")
        .select(F.col("digest").alias("of_digest"), "keeper")
    )
    copied = (F.col("digest") == F.col("of_digest")) & (F.col("bytes") >= LEAST_SHARED)
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper"))
    return keyed.join(keepers, copied, "left").select(
        "page_id", "url", "html", "digest", F.when(other, F.col("keeper")).alias("refers_to")
    )


def archive_round_trip(
    pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Writes every page to bundles and reads all records back.

    Per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, where bytes and digest are those of
    the payload read back (a revisit's is its response's). A null html is an empty payload; a url may be of any length, a null one is replaced by
    the record's own id; of copies the largest page id is the response, and rows that repeat that id with that payload
    are responses too; rows with a null id revisit unless all copies have null ids. Other columns are not read. An
    empty table gives no row. ``folder`` must be shared by all executors; by default a new one below spark.checkpoint.dir.
    """
    folder = folder or run_folder(pages.sparkSession, "warc")
    index = write_archives(with_references(pages, id_column, url_column, html_column), folder)
    records = read_archives(index, folder).select(
        "page_id",
        "record_type",
        "refers_to",
        "stated_digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    records = written(records, "warc-records")
    responses = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "stated_digest")
    targets = responses.groupBy(F.col("page_id").alias("to_page"), F.col("payload_digest").alias("to_digest")).agg(
        F.max("payload_bytes").alias("payload_bytes")
    )
    found = revisits.join(targets, (F.col("refers_to") == F.col("to_page")) & (F.col("stated_digest") == F.col("to_digest")), "left")
    out = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return responses.select(*out).unionByName(found.withColumn("payload_digest", F.col("to_digest")).select(*out))
