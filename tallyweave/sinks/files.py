"""Records as files."""

from __future__ import annotations

import csv
import io
import itertools
import json
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import written
from tallyweave.sources.contract import opened

#: What a file's writing gave: its name, its bytes, and why it isn't there, if so.
OUTCOMES = "name string, bytes long, problem string"
#: Bytes gathered before a store is called.
BUFFER = 1 << 20


def whole(outcomes: DataFrame) -> DataFrame:
    """The outcomes of a writing that is of use only as a whole: raises if any file isn't there."""
    n = outcomes.where("problem is not null").count()
    if n:
        told = "; ".join(f"{r['name']}: {r['problem']}" for r in outcomes.where("problem is not null").orderBy("name", "problem").take(3))
        raise OSError(f"{n} files were not written, such as {told}")
    return outcomes


def file_names(records: DataFrame, key: str, extension: str) -> DataFrame:
    """(key, name) like ``2026-09-30 1432 dive 452.json``, from ``local`` and ``number``; no number, no ``dive``.

    Records that would share a name, whatever the case, get (2), (3) and so on in the order of the key, which is to be
    unique. A null start is written ``undated``.
    """
    stem = F.concat(F.coalesce(F.date_format("local", "yyyy-MM-dd HHmm"), F.lit("undated")), F.coalesce(F.concat(F.lit(" dive "), F.col("number").cast("string")), F.lit("")))
    rows = records.select(F.col(key), stem.alias("_stem"))
    n = F.row_number().over(Window.partitionBy(F.lower("_stem")).orderBy(key))
    return rows.withColumn("_n", n).select(key, F.concat("_stem", F.when(F.col("_n") > 1, F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(""), F.lit(extension)).alias("name"))


def dropped(records: DataFrame, fields: dict[str, str], kept: Sequence[str]) -> Column:
    """Names (``fields``: column to name) of what a record says and a format without the columns ``kept`` would lose."""
    kinds = dict(records.dtypes)

    def says(c: str) -> Column:
        if kinds[c].startswith(("array", "map")):
            return F.size(c) > 0
        return F.trim(c) != "" if kinds[c] == "string" else F.col(c).isNotNull()

    return F.array_compact(F.array(*[F.when(says(c), F.lit(n)) for c, n in fields.items() if c not in kept], F.lit(None).cast("string")))


def dropped_counts(records: DataFrame, fields: dict[str, str], kept: Sequence[str]) -> DataFrame:
    """(name, n): how many records of a batch would lose what."""
    return records.select(F.explode(dropped(records, fields, kept)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def export_json(records: DataFrame, folder: str, clear: bool = False) -> None:
    """One JSON line a record, without its null fields. Spark commits the files of a job together; ``clear`` replaces what is there."""
    records.write.mode("overwrite" if clear else "append").option("ignoreNullFields", True).json(folder)


def put_pieces(store: fs.FileSystem, root: str, name: str, pieces: Iterator[bytes]) -> int:
    """Write a file piece by piece under another name in its folder and rename it, so that it is there whole or not at all; its bytes."""
    if not name or name.startswith("/") or ".." in re.split(r"[/\\]", name) or "\0" in name:
        raise ValueError("no name for a file")
    folder, _, last = f"{root}/{name}".rpartition("/")
    store.create_dir(folder, recursive=True)
    held, size = f"{folder}/.{uuid.uuid4().hex}", 0
    try:
        with store.open_output_stream(held, compression=None, buffer_size=BUFFER) as f:
            for piece in pieces:
                f.write(piece)
                size += len(piece)
        if store.get_file_info(f"{folder}/{last}").type == fs.FileType.Directory:
            raise IsADirectoryError("a folder has this name")
        store.move(held, f"{folder}/{last}")
    except Exception:
        if store.get_file_info(held).type == fs.FileType.File:
            store.delete_file(held)
        raise
    return size


def write_each(records: DataFrame, folder: str, name: Column, content: Column) -> DataFrame:
    """Write each record to its own file below ``folder`` and return OUTCOMES, a row for each record; the files are there when this returns.

    A file that can't be written is a row with its problem, and the others stand. A null or empty name, one that leads out of
    the folder, and one that several records share are problems too: of the latter none is written. Null content is an
    empty file. A task that is tried again writes the same files again. Text is UTF-8; bytes are written as they are.
    """
    rows = records.select(name.cast("string").alias("name"), F.coalesce(content.cast("binary"), F.lit(b"")).alias("content"))
    # only names meet; of a name that repeats, the rows get to know it by a join with the few that do
    twice = rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1 and name is not null").select(F.col("name").alias("_twice"))
    rows = rows.join(twice, F.col("name") == F.col("_twice"), "left").select("name", "content", F.col("_twice").isNotNull().alias("twice"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder.rstrip("/"))
        for batch in batches:
            out = []
            for file, body, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                size, problem = None, "several records have this name" if shared else None
                if not problem:
                    try:
                        size = put_pieces(store, root, file or "", iter([body.as_py()]))
                    except Exception as e:  # any fault is an outcome of this file
                        problem = f"{type(e).__name__}: {e}".split("\n")[0]
                out.append((file, size, problem))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["name", "bytes", "problem"])

    return written(rows.mapInArrow(work, OUTCOMES), "outcomes")


def write_zip(records: DataFrame, path: str) -> int:
    """Write records (entry, content: a JSON object as text) as one archive, an entry for each name, and return its bytes.

    An entry that ends in ``.csv`` is a table whose header is that of its first record; any other is a JSON array. Entries
    are in the order of their names, records in that of their texts. An archive is one stream, so one task writes it, with a
    record in memory at a time. Records without an entry or content are left out.
    """
    rows = records.where("entry is not null and content is not null").select(F.col("entry").cast("string"), F.col("content").cast("string"))
    folder, _, name = path.rpartition("/")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        held = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(held, compression=None) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            every = ((e, c) for b in batches for e, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for entry, own in itertools.groupby(every, key=lambda r: r[0]):
                with z.open(entry, "w", force_zip64=True) as e:
                    _entry(e, entry, (c for _, c in own))
        size = store.get_file_info(held).size
        store.move(held, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["bytes"])

    return rows.repartition(1).sortWithinPartitions("entry", "content").mapInArrow(work, "bytes long").first()[0]


def _entry(out: IO[bytes], name: str, contents: Iterator[str]) -> None:
    text = io.TextIOWrapper(out, "utf-8", newline="", write_through=True)
    if name.lower().endswith(".csv"):
        table = None
        for c in contents:
            row = json.loads(c)
            if table is None:
                table = csv.DictWriter(text, list(row), extrasaction="ignore")
                table.writeheader()
            table.writerow(row)
    else:
        text.write("[")
        for i, c in enumerate(contents):
            text.write(f",\n{c}" if i else c)
        text.write("]")
    text.detach()
