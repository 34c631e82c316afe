"""Records in the entries of zip archives: JSON arrays and CSV tables, streamed, one task for each entry.

The driver reads an archive's central directory only. A task inflates its entry piece by piece and holds one record of it,
so neither the archive nor an entry ever stands whole in memory. Records keep their entry's place and their own, so
that the first of an id can be kept.
"""

from __future__ import annotations

import codecs
import csv
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition
from pyspark.sql.types import StructType

from tallyweave.sources.contract import RecordSource, Wanted, opened, scan

COLUMNS = "archive string, entry string, entry_at long, record_at long, content string, problem string"
#: Characters read at a time, and of one record at most: a longer one ends the entry with a problem.
STEP, LONGEST = 1 << 16, 64 << 20
#: Records of a batch.
ROWS = 1_000
_BLANK = " \t\r\n,"
#: What may follow a value.
_ENDS = {*",:]} \t\r\n"}


def json_records(text: Iterator[str]) -> Iterator[str]:
    """The objects of a JSON entry, as text: of its array, or of the first array that a value of its object is, else of its values.

    Fails where the text is none. Values that are no objects are passed over.
    """
    decoder, held, done = json.JSONDecoder(), "", False

    def more() -> bool:
        nonlocal held, done
        piece = next(text, None)
        if piece is None:
            done = True
            return False
        held += piece
        if len(held) > LONGEST:
            raise ValueError("a record is too long")
        return True

    def skip(chars: str) -> str:
        """The next character that isn't one of these; nothing at the end."""
        nonlocal held
        while True:
            held = held.lstrip(chars)
            if held or not more():
                return held[:1]

    def value() -> object:
        """The next value, which ends before the text does."""
        nonlocal held
        size = len(held)
        while True:
            try:
                out, end = decoder.raw_decode(held)
                # a number may go on in the next piece, as 12 does in 12.5
                if held[end : end + 1] in _ENDS or not more():
                    held = held[end:]
                    return out
            except ValueError:
                # each try takes twice the text of the last, so long records cost no square
                size *= 2
                grown = more()
                while grown and len(held) < size:
                    grown = more()
                if not grown and done:
                    try:
                        out, end = decoder.raw_decode(held)
                    except ValueError:
                        raise ValueError("no JSON") from None
                    held = held[end:]
                    return out

    def array() -> Iterator[str]:
        nonlocal held
        held = held[1:]
        while True:
            c = skip(_BLANK)
            if c == "]":
                held = held[1:]
                return
            if not c:
                raise ValueError("an array without an end")
            one = value()
            if isinstance(one, dict):
                yield json.dumps(one, ensure_ascii=False)

    begin = skip(" \t\r\n﻿")
    if begin == "[":
        yield from array()
    elif begin == "{":
        # the first array among the values holds the records
        held = held[1:]
        while True:
            c = skip(_BLANK)
            if c == "}":
                return
            if c != '"':
                raise ValueError("no JSON")
            value()
            if skip(" \t\r\n") != ":":
                raise ValueError("no JSON")
            held = held[1:]
            if skip(" \t\r\n") == "[":
                yield from array()
                return
            value()
    else:
        raise ValueError("no JSON")


def csv_records(text: Iterator[str]) -> Iterator[str]:
    """The rows of a CSV entry with a header, as JSON text; quoted fields may hold line ends. Cells beyond the header are left out."""

    def lines() -> Iterator[str]:
        held = ""
        for piece in text:
            *whole, held = (held + piece).splitlines(keepends=True) or [""]
            if held.endswith("\n"):
                whole, held = [*whole, held], ""
            if len(held) > LONGEST:
                raise ValueError("a record is too long")
            yield from whole
        if held:
            yield held

    for row in csv.DictReader(lines(), restkey="\0"):
        row.pop("\0", None)
        yield json.dumps(row, ensure_ascii=False)


@dataclass
class _Entry(InputPartition):
    archive: str
    entry: str | None
    at: int


class ZipSource(RecordSource):
    """``spark.read.format("zip_records").load(path)`` of an archive, or of the ``.zip`` files of a folder: COLUMNS, a row a record.

    Entries that end in ``.json`` or ``.csv``, in whatever case, are read; others are not. A damaged entry gives the
    records before the damage and a row with the problem, a damaged archive one row. Bytes that are no UTF-8 are replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_records"

    def schema(self) -> str:
        return COLUMNS

    def parts(self, wanted: Wanted) -> list[_Entry]:
        store, root = opened(self.options["path"].rstrip("/"))
        if store.get_file_info(root).type == fs.FileType.Directory:
            found = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name.lower().endswith(".zip"))
        else:
            found = [root]
        out = []
        for path in found:
            try:
                with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    out += [_Entry(path, i.filename, at) for at, i in enumerate(z.infolist()) if i.filename.lower().endswith((".json", ".csv"))]
            except (zipfile.BadZipFile, OSError, ValueError):  # Arrow's files say ValueError where a short one is asked for its end
                out.append(_Entry(path, None, 0))
        return out or [_Entry("", None, -1)]

    def rows(self, part: _Entry, wanted: Wanted, columns: StructType) -> Iterator[pa.RecordBatch]:
        if part.at < 0:
            return
        held: list[dict] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], pa.int64() if c.endswith("_at") else pa.string()) for c in columns.names], names=columns.names)

        def row(at: int | None, content: str | None, problem: str | None) -> dict:
            return {"archive": part.archive, "entry": part.entry, "entry_at": part.at, "record_at": at, "content": content, "problem": problem}

        store, _ = opened(self.options["path"].rstrip("/"))
        n = 0
        try:
            with store.open_input_file(part.archive) as f, zipfile.ZipFile(f) as z:
                if part.entry is None:
                    raise ValueError("no zip archive")
                with z.open(z.infolist()[part.at]) as e:
                    text = codecs.iterdecode(iter(lambda: e.read(STEP), b""), "utf-8", "replace")
                    for n, content in enumerate((json_records if part.entry.lower().endswith(".json") else csv_records)(text), 1):
                        held.append(row(n, content, None))
                        if len(held) >= ROWS:
                            yield batch()
                            held.clear()
        except Exception as e:  # any fault is a row of this entry
            held.append(row(n + 1, None, "no zip archive" if part.entry is None else f"{type(e).__name__}: {e}".split("\n")[0]))
        if held:
            yield batch()


def read(spark: SparkSession, path: str) -> DataFrame:
    """COLUMNS of the archives at a path."""
    return scan(spark, ZipSource, path)


def keep_first(records: DataFrame, id_: Column) -> DataFrame:
    """Of the records with one id the first, by archive, entry and place; those without an id, and problems, are left out.

    Places meet, not contents: the least place of an id is found by partial sums, so an id that repeats often is no burden.
    """
    rows = records.where("problem is null").withColumn("_id", id_).where("_id is not null")
    first = rows.groupBy("_id").agg(F.min_by(F.struct(*records.columns), F.struct("archive", "entry_at", "record_at")).alias("r"))
    return first.select("r.*", F.col("_id").alias("id"))
