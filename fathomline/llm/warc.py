"""WARC archives with a Zstandard dictionary, and a reader for them.

Each task writes archives of the records it holds. The first records of an archive train its
dictionary, which stands in a leading skippable frame; every record is one more frame. Files get a
name of their own for each attempt, and the manifest, which Spark commits, names those that count: a
lost executor or a repeated task leaves files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import BROADCAST_IDS, new_folder, settle, small

#: Fixed values of the formats: the dictionary frame's magic number, and the profile of revisits.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """``roll_bytes`` of records, before compression, in an archive; ``sample_bytes`` of its first
    records train a dictionary of ``dictionary_bytes``."""

    roll_bytes: int = 256 << 20
    sample_bytes: int = 1 << 20
    dictionary_bytes: int = 16 << 10
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"


ARCHIVE = Archive()


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page: object, url: str | None, payload: bytes, refers_to: object, when: str) -> bytes:
    """One WARC 1.1 record: a response, or a revisit of the page ``refers_to`` if that isn't None."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", when)]
    head += [("WARC-Target-URI", _clean(url))] if url else []
    head += [("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    head += [("X-Page-ID", str(page))] if page is not None else []
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary of the samples; from too few of them, their own last bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Writer:
    """One archive at a time: holds back the first records until there are enough to train on."""

    def __init__(self, files: pa.fs.FileSystem, folder: str, name: str, rules: Archive):
        self.files, self.folder, self.name, self.rules = files, folder, name, rules
        self.held: list[bytes] = []
        self.size, self.count, self.out, self.made = 0, 0, None, 0

    def _start(self) -> None:
        words = train(self.held, self.rules.dictionary_bytes)
        kind = zstandard.DICT_TYPE_AUTO if words[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        self.pack = zstandard.ZstdCompressor(level=self.rules.level, dict_data=zstandard.ZstdCompressionDict(words, dict_type=kind)).compress
        self.path = f"{self.folder}/{self.name}-{self.made:04d}.warc.zst"
        self.out = self.files.open_output_stream(self.path, compression=None)
        self.out.write(SKIPPABLE.to_bytes(4, "little") + len(words).to_bytes(4, "little") + words)
        for r in self.held:
            self.out.write(self.pack(r))
        self.held = []

    def add(self, data: bytes) -> Iterator[dict]:
        self.size, self.count = self.size + len(data), self.count + 1
        if self.out is None:
            self.held.append(data)
            if self.size >= self.rules.sample_bytes:
                self._start()
        else:
            self.out.write(self.pack(data))
        if self.size >= self.rules.roll_bytes:
            yield from self.close()

    def close(self) -> Iterator[dict]:
        if self.count:
            if self.out is None:
                self._start()
            self.out.close()
            yield {"path": self.path, "records": self.count, "plain_bytes": self.size}
        self.size, self.count, self.out, self.made = 0, 0, None, self.made + 1


def frames(source) -> Iterator[bytes]:
    """The records of an archive, one by one, from a stream of its bytes."""
    head = source.read(8)
    if int.from_bytes(head[:4], "little") != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    words = source.read(int.from_bytes(head[4:], "little"))
    if words[:4] == zstandard.FRAME_HEADER:
        words = zstandard.ZstdDecompressor().decompress(words)
    kind = zstandard.DICT_TYPE_AUTO if words[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=kind))
    rest = b""
    while rest or (rest := source.read(1 << 14)):
        one, parts = open_.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            if not (rest := source.read(1 << 14)):
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, with lower-case names, and payload (empty for a revisit) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(first)
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http-content-length"] = re.search(rb"(?i)\ncontent-length: (\d+)", http)[1].decode()
    return fields, payload


#: Names that Spark's file systems and Arrow's have for the same stores.
STORES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as Spark resolves it, by its default file system where no store is named, in Arrow's spelling."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    store, _, rest = whole.partition(":")
    if store not in STORES:
        raise ValueError(f"archives can't be written to {store}:, only to {', '.join(STORES)}")
    return f"{STORES[store]}://{rest.removeprefix('//')}"


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", rules: Archive = ARCHIVE) -> DataFrame:
    """Write a record for each row into archives below ``folder``; returns the manifest.

    Manifest: ``path``, ``records``, ``plain_bytes``, a row for each archive. Of equal payloads, the
    row with the largest id is the response and the others revisit it; rows that repeat that id are
    responses too. A null payload counts as empty, a null url leaves its field out, and a row with a
    null id is a response. Pages stay where they lie: only digests are grouped, and the ids of
    repeated ones joined back. Other columns are ignored. An empty table writes no archive.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "archives")
    folder = qualified(spark, folder)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("mark", F.unhex(F.sha1("payload")))
    heads = rows.groupBy("mark").agg(F.max("id").alias("head"), F.min("id").alias("low")).where("head != low").select(F.col("mark").alias("head_mark"), "head")
    heads = settle(heads, "responses")
    few = heads.count() <= BROADCAST_IDS
    joined = rows.join(F.broadcast(heads) if few else heads, F.col("mark") == F.col("head_mark"), "left")
    joined = joined.select("id", "url", "payload", F.when(F.col("id") != F.col("head"), F.col("head")).alias("refers_to"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        writer = Writer(files, base, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", rules)
        shape = pa.schema([("path", pa.string()), ("records", pa.int64()), ("plain_bytes", pa.int64())])
        for b in small(batches):
            ids, urls, payloads, refers = (c.to_pylist() for c in b.columns)
            for page, url, payload, to in zip(ids, urls, payloads, refers, strict=True):
                if done := list(writer.add(record(page, url, payload.encode("utf-8", "replace"), to, rules.date))):
                    yield pa.RecordBatch.from_pylist(done, schema=shape)
        if done := list(writer.close()):
            yield pa.RecordBatch.from_pylist(done, schema=shape)

    return settle(joined.mapInArrow(each, "path string, records long, plain_bytes long"), "manifest").withColumn("folder", F.lit(folder))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives: ``page_id`` (text), ``url``, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to`` (text), ``payload`` (null for a revisit).

    Length and digest of a response are those of the payload read; those of a revisit, its header's.
    A record without a page id or address has nulls there; an empty payload is read as ''. A manifest
    without rows gives no record; an archive that ends within a record raises an error.
    Archives are dealt out to tasks, and each is read as a stream, a record at a time.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.string())])
        for b in batches:
            for path, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, _ = pa.fs.FileSystem.from_uri(folder)
                out = []
                with files.open_input_stream(path, compression=None) as source:
                    for data in frames(source):
                        f, payload = parse(data)
                        new = f["warc-type"] == "response"
                        digest = payload_digest(payload) if new else f["warc-payload-digest"].removeprefix("sha1:")
                        out.append((f.get("x-page-id"), f.get("warc-target-uri"), len(payload) if new else int(f["http-content-length"]), digest, f["warc-type"], f.get("x-refers-to-page-id"), payload.decode("utf-8", "replace") if new else None))
                        if len(out) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), shape.types, strict=True)], schema=shape)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), shape.types, strict=True)], schema=shape)

    rows = manifest.select("path", "folder").repartitionByRange(max(1, manifest.count()), "path")
    return rows.mapInArrow(each, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload string")
