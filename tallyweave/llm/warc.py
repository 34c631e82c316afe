"""WARC: files of one gzip member per record, and a sequential reader that verifies them.

Both are a Spark data source (``format("warc")``). Each writing task makes whole ``.warc.gz`` files of about
ARCHIVE bytes, and the job's commit writes one manifest of those that count, so tasks may be tried again. Where a
folder has manifests, the reader takes their files, else all. It goes through a file piece by piece: it inflates,
frames blocks by Content-Length and digests them as the bytes come, and holds a record's payload only if asked to. Files are opened by Arrow's file systems (local or shared folders, HDFS,
object stores); archives that only Spark can reach go through :func:`read_records`, with their contents in a column.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tallyweave.session import shared_path, written

#: Compressed bytes after which a file ends, and bytes read or inflated at a time.
ARCHIVE, STEP = 16 << 20, 1 << 16
#: Bytes of the head of a record or message; a longer one is a fault.
HEAD = 1 << 20
#: Records of a batch, at most, and bytes of payload after which a batch ends.
ROWS, BATCH = 1_000, 4 << 20
LEVEL = 4
#: Fixed values of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
MANIFEST = "_manifest-"
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, valid boolean, reason string, archive string, payload binary"
#: What the writer takes.
PAGES = "page long, url string, html string, again boolean, refers_to long, sha1 string, bytes long"


def base32_sha1(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def _uri(page) -> str:
    return f"urn:x-page:{'none' if page is None else page}"


def record(page, url: str | None, payload: bytes, refers_to, revisit: bool, digest: str | None = None, size: int | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A record as one gzip member. A revisit has the head of the HTTP message only."""
    digest = digest or base32_sha1(payload)
    size = len(payload) if size is None else size
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_uri(page)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{_uri(refers_to)}>"]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _whole(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch("[0-9]{1,18}", text) else None


class _Head:
    """Bytes up to an empty line, at most HEAD of them."""

    def __init__(self):
        self.held, self.whole, self.long = bytearray(), False, False

    def feed(self, more: bytes) -> bytes:
        """What follows the head."""
        begin = max(0, len(self.held) - 3)
        self.held += more
        end = self.held.find(b"\r\n\r\n", begin)
        if end < 0:
            if len(self.held) > HEAD:
                self.long = True
                del self.held[HEAD:]
            return b""
        rest = bytes(self.held[end + 4 :])
        del self.held[end:]
        self.whole = True
        return rest


class Record:
    """A record that is read as its bytes are inflated: framed by Content-Length, digested, and kept only where asked for."""

    def __init__(self, payloads: bool, archive: str | None = None):
        self.payloads, self.archive = payloads, archive
        self.head, self.message, self.length, self.kind = _Head(), _Head(), None, None
        self.block, self.sha, self.size, self.got, self.end = hashlib.sha1(), hashlib.sha1(), 0, 0, b""
        self.payload: list[bytes] = []

    def feed(self, more: bytes) -> None:
        if not self.head.whole:
            more = self.head.feed(more)
            if not self.head.whole:
                return
            fields = _fields(bytes(self.head.held))
            self.length, self.kind = _whole(fields.get("content-length")), fields.get("warc-type")
        room = len(more) if self.length is None else max(0, self.length - self.got)
        self.end = (self.end + more[room : room + 5])[:5]
        more = more[:room]
        self.got += len(more)
        self.block.update(more)
        if not self.message.whole:
            more = self.message.feed(more)
        if self.message.whole and self.kind != "revisit":
            self.sha.update(more)
            self.size += len(more)
            if self.payloads:
                self.payload.append(more)

    @property
    def begun(self) -> bool:
        return self.head.held.startswith(b"WARC/")

    def row(self, fault: str | None = None) -> tuple:
        """A row of RECORDS. ``valid`` says whether framing, length, block digest and payload digest hold, ``reason`` what doesn't."""
        fields = _fields(bytes(self.head.held))
        wrong = [fault] if fault else []
        if not self.begun:
            wrong.append("no WARC version")
        if self.head.long or self.message.long:
            wrong.append("long head")
        if self.kind is None or self.length is None:
            wrong += [n for n, v in (("no type", self.kind), ("no content length", self.length)) if v is None]
        if self.length is not None and (self.got != self.length or self.end != b"\r\n\r\n"):
            wrong.append("content length")
        block = lambda h: base64.b32encode(h.digest()).decode()
        if fields.get("warc-block-digest", "").rpartition(":")[2] not in ("", block(self.block)):
            wrong.append("block digest")
        digest, size = fields.get("warc-payload-digest", "").rpartition(":")[2] or None, _whole(_fields(bytes(self.message.held)).get("content-length"))
        if self.kind != "revisit":
            found, size = block(self.sha), self.size
            if digest not in (None, found):
                wrong.append("payload digest")
            digest = found
        name, refers = fields.get("warc-record-id"), fields.get("warc-refers-to")
        keep = b"".join(self.payload) if self.payloads and self.kind != "revisit" else None
        return name.strip("<>") if name else None, self.kind, fields.get("warc-target-uri"), refers.strip("<>") if refers else None, size, digest, not wrong, ", ".join(wrong) or None, self.archive, keep


def _next_member(stream, held: bytes) -> tuple[bytes, bool]:
    """(bytes from the next start of a member on, or none; whether bytes were passed over)."""
    passed = False
    while True:
        at = held.find(MAGIC)
        if at >= 0:
            return held[at:], passed or at > 0
        more = stream.read(STEP)
        if not more:
            return b"", passed or bool(held)
        # the start may be cut by the end of a piece
        keep = next((n for n in (2, 1) if held.endswith(MAGIC[:n])), 0)
        passed = passed or len(held) > keep
        held = held[len(held) - keep :] + more


def records(stream, payloads: bool = False, archive: str | None = None) -> Iterator[tuple]:
    """A row of RECORDS for each gzip member of a file-like object, read and inflated STEP bytes at a time.

    A member that is damaged or cut is one row with what is known of it, and what is wrong; reading goes on at the next
    member that can be inflated or begins a record. Bytes after a whole member that begin none are a row of their own.
    """
    held, lost = stream.read(STEP), False
    while held:
        held, passed = _next_member(stream, held)
        if passed and not lost:
            yield Record(False, archive).row("no gzip member")
        if not held:
            return
        inflate, record, fault, piece = zlib.decompressobj(31), Record(payloads, archive), None, held
        while True:
            try:
                record.feed(inflate.decompress(piece, STEP))
            except zlib.error as e:
                fault, held = f"damaged: {e}", piece[1 if piece is held else 0 :]
                break
            if inflate.eof:
                held = inflate.unused_data
                break
            piece = inflate.unconsumed_tail or stream.read(STEP)
            if not piece:
                record.feed(inflate.flush())
                fault, held = None if inflate.eof else "cut", b""
                break
        if not (lost and fault and not record.begun):
            yield record.row(fault)
        lost = fault is not None
        held = held or stream.read(STEP)


_KINDS = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.binary()]
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _KINDS, strict=True)], names=_NAMES)

    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if len(held) >= ROWS or size >= BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read_records(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records (RECORDS) of archives with a column ``content``, and maybe ``path``. Null contents have none; ``payload`` is null unless asked for.

    A damaged record is a row with ``valid`` false and the ``reason``; what can't be read of it is null.
    """
    path = F.col("path").cast("string") if "path" in archives.columns else F.lit(None).cast("string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if content.is_valid:
                    yield from _batches(records(pa.BufferReader(content.as_buffer()), payloads, name))

    return archives.select(F.col("content"), path.alias("path")).mapInArrow(work, RECORDS)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class _Written(WriterCommitMessage):
    names: tuple[str, ...]


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payloads", ...).load(path)`` and ``df.write.format("warc").save(path)`` of rows like PAGES."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WarcReader(self.options["path"], str(self.options.get("payloads", "false")).lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only added to: write with mode append")
        return _WarcWriter(self.options["path"])


class _WarcReader(DataSourceReader):
    #: Bytes of small files that a task reads one after the other, about.
    PART = 32 << 20

    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads = path, payloads

    def partitions(self) -> list[_Files]:
        """Whole files, by name; those that begin with a dot or an underscore, or are in no manifest where there are any, are not read."""
        store, root = _opened(self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=False)) if f.type == fs.FileType.File]
        told = set()
        for f in found:
            if f.base_name.startswith(MANIFEST):
                with store.open_input_stream(f.path, compression=None) as stream:
                    told.update(json.loads(stream.read()))
        files = sorted((f.path, f.size or 0) for f in found if (f.base_name in told if told else f.base_name[0] not in "._"))
        out, held, size = [], [], 0
        for path, n in files:
            if held and size + n > self.PART:
                out.append(_Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, _Files(tuple(held))]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as stream:
                yield from _batches(records(stream, self.payloads, path.rsplit("/", 1)[-1]))


class _WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        names, out, size = [], None, 0
        for batch in iterator:
            for page, link, text, again, refers, sha, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    names.append(f"part-{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):06d}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                packed = record(page, link, (text or "").encode("utf-8", "surrogatepass"), refers, again, base64.b32encode(bytes.fromhex(sha)).decode(), count)
                out.write(packed)
                size += len(packed)
                if size >= ARCHIVE:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(tuple(names))

    def commit(self, messages: list[_Written | None]) -> None:
        """One manifest makes all files count at once; files of attempts that failed are in none."""
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/.{self.job}", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        store.move(f"{root}/.{self.job}", f"{root}/{MANIFEST}{self.job}.json")

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = _opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{root}/{name}")


def read_files(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the WARC files in a folder, read piece by piece; a task reads whole files."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payloads", payloads).load(path)


def write_archives(pages: DataFrame, path: str | None = None, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write a record for each row of ``pages`` to ``.warc.gz`` files below ``path``, and return that; None stands for a fresh shared folder.

    Of rows with equal payloads of at least ``least`` bytes that with the largest key is the response and the
    others revisit it. Null html is an empty payload; null keys are smaller than any other and null urls left
    out. Rows that repeat the largest key of a payload are all responses. Other columns are not read. Without
    rows there are no files.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # only ids and digests meet to find the responses; the payloads are joined by id, which no group of copies skews
    narrow = rows.select("page", "sha", F.octet_length("html").alias("bytes")).where(F.col("bytes") >= least).select("page", "sha").distinct()
    top = narrow.groupBy("sha").agg(F.max("page").alias("top"))
    revisits = written(narrow.join(top, "sha").where(~F.col("page").eqNullSafe(F.col("top"))).select(F.col("page").alias("p"), F.col("sha").alias("s"), "top"), "warc-revisits")
    full = rows.join(revisits, F.col("page").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")
    full = full.select("page", "url", F.when(F.col("s").isNull(), F.col("html")).alias("html"), F.col("s").isNotNull().alias("again"), F.col("top").alias("refers_to"), F.col("sha").alias("sha1"), F.octet_length("html").cast("long").alias("bytes"))
    path = path or shared_path(spark, "warc")
    full.write.format("warc").mode("append").save(path)
    return path


def write_and_read(pages: DataFrame, least: int = 0, key: str = "page_id") -> DataFrame:
    """Archive ``pages``, read the files back and return what each record says: the key, payload_bytes,
    payload_digest, record_type, refers_to, valid. See :func:`write_archives` for the cases."""
    read = read_files(pages.sparkSession, write_archives(pages, None, least, key))
    number = lambda c: F.regexp_extract(c, "^urn:x-page:(-?[0-9]+)$", 1).try_cast("long")
    return read.select(number("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "valid")
