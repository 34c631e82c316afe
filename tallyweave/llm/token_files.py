"""Token ids as binary files: Arrow streams of fixed-size lists, for random access without copies.

A shard is two files in Arrow's streaming format. ``ids-*.arrow`` holds sequences of equal length and masks of the
places that hold an id, in batches of equally many sequences, so sequence i stands in batch i // BATCH and a
memory-mapped file gives both without copying (:class:`Sequences`). A batch has each different mask once: nearly all
sequences are full and share one. ``documents-*.arrow`` tells where each document
begins and how many ids it has; documents follow one another across sequences and batches, and only the last
sequence of a shard is filled up. The writer is a Spark data source: tasks write whole shards in the order of the
rows, and the job's commit publishes them by one manifest, which readers follow. Files of attempts that failed
aren't in it.

Texts are encoded piece by piece: a piece begins where no pre-token can go on, as at white space that follows a
sign of another kind (:func:`cuts`), so the ids of a text are those of its pieces. Pieces are told apart by hash,
compared byte by byte, and each different one is encoded once by the tokenizers library; those that begin with white
space are handed to it many at a time, as one text.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tallyweave.llm.textscan import bounded_batches, chunks, hashes
from tallyweave.session import shared_path

#: Ids of a sequence, sequences of a batch, and batches after which the next document begins a new shard.
LENGTH, BATCH, SHARD = 2_048, 128, 512
#: Bytes of text that are looked at together, about; bytes in a worker's store of encoded pieces, after which it starts
#: anew; and pieces that are handed to the library as one text.
CHUNK, KEPT, TOGETHER = 1 << 20, 8 << 20, 2_000
MANIFEST = "_manifest.json"
DOCUMENTS = "key long, start long, n_tokens long, ids binary"
_PLACES = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64())])


class PieceEncoder:
    """Encodes texts by a tokenizer file of the tokenizers library, without special tokens; made once in each worker."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(content)
        self.model.encode_special_tokens = True
        words = self.model.get_vocab(with_added_tokens=False)
        # a token has a character for each of its bytes
        self.width = np.zeros(max(words.values()) + 1, np.int64)
        self.width[list(words.values())] = [len(w) for w in words]
        self.forget()

    def forget(self) -> None:
        self.hashes, self.index = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.byte_at, self.id_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _encoded(self, pieces: list[bytes]) -> list[np.ndarray]:
        found = self.model.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def _together(self, content: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each piece has) of pieces that stand one after the other, cut where pre-tokens end."""
        ids, at = [], 0
        for stop in [*range(TOGETHER - 1, len(ends) - 1, TOGETHER), len(ends) - 1]:
            upto = int(ends[stop])
            ids.append(np.array(self.model.encode_batch_fast([content[at:upto].decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32))
            at = upto
        ids = np.concatenate(ids)
        upto = np.cumsum(self.width[ids])
        last = np.searchsorted(upto, ends)
        if not np.array_equal(upto[last], ends):
            raise ValueError("a token goes beyond its piece")
        return ids, np.diff(last, prepend=-1)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        try:
            data.tobytes().decode("utf-8")
            # between these any boundary is one of white space after a sign
            plain = _CLASS[data[starts]] == _SPACE
            plain &= _SOLID[data[ends - 1]]
        except UnicodeDecodeError:
            plain = np.zeros(len(starts), bool)
        order = np.argsort(~plain, kind="stable")
        starts, ends, h, n = starts[order], ends[order], h[order], int(plain.sum())
        width = ends - starts
        upto = np.cumsum(width)
        flat = data[np.repeat(starts, width) + np.arange(width.sum()) - np.repeat(upto - width, width)]
        ids, counts = self._together(flat[: upto[n - 1]].tobytes(), upto[:n]) if n else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        own = self._encoded([data[a:b].tobytes() for a, b in zip(starts[n:].tolist(), ends[n:].tolist(), strict=True)])
        counts = np.append(counts, np.array([len(i) for i in own], np.int64))
        known = len(self.byte_at) - 1
        self.bytes, self.ids = np.concatenate([self.bytes, flat]), np.concatenate([self.ids, ids, *own])
        self.byte_at = np.append(self.byte_at, self.byte_at[-1] + upto)
        self.id_at = np.append(self.id_at, self.id_at[-1] + np.cumsum(counts))
        # both are in order, and a stable sort merges them in one pass
        every, at = np.concatenate([self.hashes, np.sort(h)]), np.concatenate([self.index, known + np.argsort(h)])
        merged = np.argsort(every, kind="stable")
        self.hashes, self.index = every[merged], at[merged]

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, how many each has); the pieces cover ``data``."""
        h = hashes(data, starts, ends)
        different, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, different)
        new = np.flatnonzero(np.append(self.hashes, np.uint64(0))[at] != different) if len(self.hashes) else np.arange(len(different))
        if len(self.hashes):
            past = np.flatnonzero(at == len(self.hashes))
            new = np.union1d(new, past)
        if len(new):
            if self.byte_at[-1] > KEPT:
                self.forget()
                new = np.arange(len(different))
            self._learn(data, starts[first[new]], ends[first[new]], different[new])
        entry = self.index[np.searchsorted(self.hashes, different)][which]
        # the same hash has to be of the same bytes
        width = ends - starts
        odd = self.byte_at[entry + 1] - self.byte_at[entry] != width
        if not odd.all():
            same = np.flatnonzero(~odd)
            spread = np.arange(width[same].sum()) - np.repeat(np.cumsum(width[same]) - width[same], width[same])
            wrong = self.bytes[np.repeat(self.byte_at[entry[same]], width[same]) + spread] != data[np.repeat(starts[same], width[same]) + spread]
            odd[same[np.unique(np.repeat(np.arange(len(same)), width[same])[wrong])]] = True
        counts = self.id_at[entry + 1] - self.id_at[entry]
        begin = self.id_at[entry]
        ids = self.ids
        if odd.any():
            rows = np.flatnonzero(odd)
            own = self._encoded([data[starts[i] : ends[i]].tobytes() for i in rows.tolist()])
            counts[rows] = [len(o) for o in own]
            begin[rows] = len(ids) + np.cumsum(counts[rows]) - counts[rows]
            ids = np.concatenate([ids, *own])
        spread = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return ids[np.repeat(begin, counts) + spread], counts

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        for _, _, data, offsets in chunks(texts, CHUNK):
            cut = cuts(data)
            cut[offsets[offsets < len(data)]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(data))
            found, counts = [], []
            first = 0
            while first < len(starts):
                # a long text is encoded in stretches of whole pieces
                last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, side="right")))
                base = starts[first]
                ids, n = self.pieces(data[base : ends[last - 1]], starts[first:last] - base, ends[first:last] - base)
                found.append(ids)
                counts.append(n)
                first = last
            ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
            upto = np.append(0, np.cumsum(np.concatenate(counts))) if counts else np.zeros(1, np.int64)
            edges = upto[np.searchsorted(starts, offsets)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield ids[a:b]


_LETTER, _DIGIT, _SIGN, _SPACE = 1, 2, 3, 4
#: Kinds of ASCII characters; 0 for control characters and all bytes beyond.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_SOLID = (_CLASS > 0) & (_CLASS != _SPACE)


def cuts(data: np.ndarray) -> np.ndarray:
    """Where pieces begin: at ASCII white space after an ASCII character that is none, or one of U+00C0 to U+00FF; at a
    sign after an ASCII letter or digit; and between ASCII letters and digits."""
    kind = _CLASS[data]
    solid = _SOLID[data]
    solid[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    now, before = kind[1:], kind[:-1]
    word = (before == _LETTER) | (before == _DIGIT)
    out = np.zeros(len(data), bool)
    out[1:] = (now == _SPACE) & solid[:-1]
    out[1:] |= word & (now != before) & (now > 0) & (now < _SPACE)
    return out


_encoders: dict = {}


def encode(docs: DataFrame, tokenizer_file: str, end: int | None = 0, text: str = "text", to: str = "ids") -> DataFrame:
    """Add the column ``to``: ids of the text and the id ``end`` (None: none), as little-endian unsigned 32-bit integers.

    A null text counts as empty. Strings of special tokens within a text are ordinary text. Column ``to`` is replaced
    where it is there already. The tokenizer's file is read on the driver (one vocabulary) and broadcast. Its
    pre-tokens must not go from a character to white space, as is so for byte-level BPE.
    """
    bounded_batches(docs.sparkSession)
    content = Path(tokenizer_file).read_text("utf-8")
    pre = json.loads(content).get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or json.loads(content).get("normalizer"):
        raise ValueError("not a plain byte-level tokenizer: its texts can't be encoded in pieces")
    told = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, content))
    tail = np.array([] if end is None else [end], "<u4").tobytes()

    @F.arrow_udf("binary")
    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        name, content = told.value
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = PieceEncoder(content)
        for part in parts:
            yield pa.array([x.astype("<u4").tobytes() + tail for x in _encoders[name].encode(part)], pa.binary())

    return docs.withColumn(to, ids(F.col(text)))


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def sequence_schema(length: int, vocabulary: int) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))])


class ShardWriter:
    """Writes one shard; documents are added one by one, and a batch is held at most."""

    def __init__(self, store: fs.FileSystem, folder: str, name: str, length: int, vocabulary: int, batch: int = BATCH):
        self.name, self.length, self.schema = name, length, sequence_schema(length, vocabulary)
        self.kind = self.schema.field("ids").type.value_type.to_pandas_dtype()
        self.files = [store.open_output_stream(f"{folder}/{part}-{name}.arrow", compression=None) for part in ("ids", "documents")]
        self.ids, self.places = pa.ipc.new_stream(self.files[0], self.schema), pa.ipc.new_stream(self.files[1], _PLACES)
        self.held, self.n, self.tokens, self.documents, self.sequences, self.rows = np.zeros(batch * length, self.kind), 0, 0, 0, 0, []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.kind).max:
            raise ValueError("an id beyond the vocabulary")
        self.rows.append((key, self.tokens, len(ids)))
        self.tokens, self.documents = self.tokens + len(ids), self.documents + 1
        done = 0
        while done < len(ids):
            take = min(len(self.held) - self.n, len(ids) - done)
            self.held[self.n : self.n + take] = ids[done : done + take]
            self.n, done = self.n + take, done + take
            if self.n == len(self.held):
                self._batch()
        if len(self.rows) >= 10_000:
            self._index()

    def _batch(self) -> None:
        count = -(-self.n // self.length)
        self.held[self.n :] = 0
        full, rest = divmod(self.n, self.length)
        masks = np.concatenate([np.ones(self.length, np.uint8), (np.arange(self.length) < rest).astype(np.uint8)][: 2 if rest else 1])
        ids = pa.FixedSizeListArray.from_arrays(pa.array(self.held[: count * self.length].copy()), type=self.schema.field("ids").type)
        kinds = pa.FixedSizeListArray.from_arrays(pa.array(masks), type=self.schema.field("mask").type.value_type)
        mask = pa.DictionaryArray.from_arrays(pa.array([0] * full + [1] * (count - full), pa.int8()), kinds)
        self.ids.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))
        self.sequences, self.n = self.sequences + count, 0

    def _index(self) -> None:
        if self.rows:
            self.places.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=_PLACES))
        self.rows = []

    def close(self) -> dict:
        if self.n:
            self._batch()
        self._index()
        self.ids.close(), self.places.close()
        for f in self.files:
            f.close()
        return {"name": self.name, "tokens": self.tokens, "documents": self.documents, "sequences": self.sequences}


class Sequences:
    """The sequences of an ``ids-*.arrow`` file on a local disk: ``s[i]`` is (ids, mask), views into the mapped file."""

    def __init__(self, path: str):
        self.map = pa.memory_map(path)
        self.batches = list(pa.ipc.open_stream(self.map))
        self.per = len(self.batches[0]) if self.batches else 1

    def __len__(self) -> int:
        return sum(map(len, self.batches))

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, row = self.batches[i // self.per], i % self.per
        ids, mask = batch.columns
        views = ids.slice(row, 1), mask.dictionary.slice(mask.indices[row].as_py(), 1)
        return tuple(v.flatten().to_numpy(zero_copy_only=True) for v in views)


def documents(store: fs.FileSystem, folder: str, name: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(key, place of the first id in the shard, ids) of a shard's documents, holding one batch and one document."""
    with store.open_input_stream(f"{folder}/ids-{name}.arrow", compression=None) as f, store.open_input_stream(f"{folder}/documents-{name}.arrow", compression=None) as g:
        batches = iter(pa.ipc.open_stream(f))
        held, at = np.zeros(0, np.uint16), 0
        for places in pa.ipc.open_stream(g):
            for key, start, n in zip(*(c.to_pylist() for c in places.columns), strict=True):
                if start != at:
                    raise ValueError(f"{name}: a document begins at {start} and not at {at}")
                got = []
                while n:
                    if not len(held):
                        batch = next(batches)
                        ids, mask = batch.columns
                        # only the last sequence of a shard isn't full
                        full = ids.type.list_size * (len(ids) - 1) + int(mask.dictionary[mask.indices[-1].as_py()].values.to_numpy().sum())
                        held = ids.flatten().to_numpy()[:full]
                    got.append(held[:n])
                    held, n, at = held[n:], n - len(got[-1]), at + len(got[-1])
                yield key, start, np.concatenate(got) if got else held[:0]
        if len(held) or next(batches, None) is not None:
            raise ValueError(f"{name}: ids beyond the last document")


@dataclass
class _Shards(InputPartition):
    shards: tuple[tuple[str, int], ...]


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    shards: tuple[dict, ...]


class TokenFiles(DataSource):
    """``df.write.format("token_files")`` of rows (key long, ids binary) in their order, and ``spark.read.format("token_files")`` of DOCUMENTS."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a folder of token files is written once")
        return _Writer(self.options["path"], int(self.options.get("length", LENGTH)), int(self.options.get("vocabulary", 1 << 32)), int(self.options.get("batch", BATCH)))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, length: int, vocabulary: int, batch: int):
        self.path, self.length, self.vocabulary, self.batch = path.rstrip("/"), length, vocabulary, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        task, shards, out = TaskContext.get(), [], None
        for batch in iterator:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    out = ShardWriter(store, root, f"{task.partitionId():06d}-{len(shards):04d}-{task.taskAttemptId()}", self.length, self.vocabulary, self.batch)
                out.add(key, np.frombuffer(ids.as_buffer(), "<u4") if ids.is_valid else np.zeros(0, np.uint32))
                if out.sequences >= SHARD * self.batch:
                    shards.append(out.close())
                    out = None
        if out is not None:
            shards.append(out.close())
        return _Written(task.partitionId(), tuple(shards))

    def commit(self, messages: list[_Written | None]) -> None:
        """Number the ids through, in the order of the partitions, and publish; the driver holds a row for each shard."""
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        start, shards = 0, []
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            for shard in m.shards:
                shards.append(shard | {"start": start})
                start += shard["tokens"]
        name = f"{root}/_{uuid.uuid4().hex}"
        with store.open_output_stream(name) as f:
            f.write(json.dumps({"length": self.length, "batch": self.batch, "tokens": start, "shards": shards}).encode())
        store.move(name, f"{root}/{MANIFEST}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = _opened(self.path)
        for name in (s["name"] for m in messages if m for s in m.shards):
            for part in ("ids", "documents"):
                store.delete_file(f"{root}/{part}-{name}.arrow")


def manifest(path: str) -> dict:
    """What was published at ``path``: length, batch, tokens, and the shards in order with their first id's place."""
    store, root = _opened(path.rstrip("/"))
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


class _Reader(DataSourceReader):
    #: Ids of small shards that a task reads one after the other, about.
    PART = 8 << 20

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[_Shards]:
        out, held, size = [], [], 0
        for s in manifest(self.path)["shards"]:
            if held and size + s["tokens"] > self.PART:
                out.append(_Shards(tuple(held)))
                held, size = [], 0
            held.append((s["name"], s["start"]))
            size += s["tokens"]
        return [*out, _Shards(tuple(held))]

    def read(self, partition: _Shards) -> Iterator[pa.RecordBatch]:
        store, root = _opened(self.path)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "start", "n_tokens", "ids"])

        for name, start in partition.shards:
            rows, size = [], 0
            for key, at, ids in documents(store, root, name):
                rows.append((key, start + at, len(ids), ids.astype("<u4").tobytes()))
                size += len(ids)
                if size >= 1 << 19 or len(rows) >= 10_000:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def write_ids(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids", length: int = LENGTH, vocabulary: int = 1 << 32, batch: int = BATCH) -> str:
    """Write rows, in their order within partitions and these in order, as token files; returns the folder (None: a fresh shared one).

    Ids are packed little-endian unsigned 32-bit integers, null counting as none; they are stored in 16 bits where
    ``vocabulary`` allows it. Null keys are kept. Without rows the manifest names no shard. Other columns aren't read.
    """
    spark = encoded.sparkSession
    spark.dataSource.register(TokenFiles)
    path = path or shared_path(spark, "token-files")
    encoded.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")).write.format("token_files").option("length", length).option("vocabulary", vocabulary).option("batch", batch).mode("append").save(path)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """DOCUMENTS of the published shards; ``start`` counts all ids of the documents before."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(path)


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) in ascending order of the key, nulls first, rows with one key by a hash of the text.

    Rows are dealt out by ranges of key, hash and place in the input, so one key, null too, fills no task.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).withColumn("_hash", F.xxhash64(text)).withColumn("_at", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in (key, "_hash", "_at")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(key, text)


def write_and_read(docs: DataFrame, tokenizer_file: str, end: int = 0, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts, write them as token files by ascending key, read the files back: (key, start, n_tokens, ids_crc32).

    See :func:`encode`, :func:`in_order` and :func:`write_ids` for nulls, ties, repeats and empty tables.
    """
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(with_added_tokens=True), end + 1)
    coded = encode(in_order(docs, key, text), tokenizer_file, end, text)
    path = write_ids(coded, None, key, "ids", length, size)
    return read_ids(docs.sparkSession, path).select(F.col("key").alias(key), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
