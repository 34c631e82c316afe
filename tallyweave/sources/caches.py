"""Folders of raw JSON, one object a file, as services' downloads leave them: ``<service>/<account>/data/<name>.json``.

A query on services and accounts lists their folders only, and names like ``12_2024-05-01_102345_17283746.json`` tell id
and start without opening the file (``functions.cells.file_stem``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition
from pyspark.sql.types import StructType

from tallyweave.functions import paths
from tallyweave.sources import services
from tallyweave.sources.contract import RecordSource, Wanted, opened, scan
from tallyweave.sources.store import DEFAULT_ACCOUNT

COLUMNS = "service string, account string, file string, id string, local timestamp_ntz, bytes long, content string, problem string"
DATA = "data"
#: Files of a task, and bytes after which it ends, about.
FILES, PART = 2_000, 64 << 20
_NAME = re.compile(r"[^_]*_([0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{6})_([^_]+)")


def told(name: str) -> tuple[str | None, datetime | None]:
    """(id, start) that a file's name tells, or nothing."""
    found = _NAME.fullmatch(name.rpartition(".")[0])
    if not found:
        return None, None
    try:
        return found[2], datetime.strptime(found[1], "%Y-%m-%d_%H%M%S")
    except ValueError:
        return found[2], None


@dataclass
class _Files(InputPartition):
    #: (service, account, path, bytes) of each.
    files: tuple[tuple[str, str | None, str, int], ...]


class CacheSource(RecordSource):
    """``spark.read.format("json_cache").load(root)``: COLUMNS, a row for each file.

    Of a data folder the files ending in ``.json``, in whatever case, in the order of their names; hidden ones and folders
    below are skipped. The account of the folder ``default`` is null. What is no UTF-8 has a problem and no content. A name
    that tells no start has none, and is read unless a bound of ``local`` rules it out.
    """

    @classmethod
    def name(cls) -> str:
        return "json_cache"

    def schema(self) -> str:
        return COLUMNS

    def parts(self, wanted: Wanted) -> list[_Files]:
        store, root = opened(self.options["path"].rstrip("/"))

        def folders(at: str) -> list[fs.FileInfo]:
            found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
            return sorted((f for f in found if f.type == fs.FileType.Directory and f.base_name[0] != "."), key=lambda f: f.base_name)

        out, held, size = [], [], 0
        for service in folders(root):
            if not wanted.takes("service", service.base_name):
                continue
            for account in folders(service.path):
                name = None if account.base_name == DEFAULT_ACCOUNT else account.base_name
                if not wanted.takes("account", name):
                    continue
                found = store.get_file_info(fs.FileSelector(f"{account.path}/{DATA}", allow_not_found=True))
                for f in sorted(found, key=lambda f: f.base_name):
                    own, local = told(f.base_name)
                    if f.type != fs.FileType.File or f.base_name[0] == "." or not f.base_name.lower().endswith(".json") or not wanted.takes("id", own) or not wanted.overlaps(local, local):
                        continue
                    if held and (size + f.size > PART or len(held) >= FILES):
                        out.append(_Files(tuple(held)))
                        held, size = [], 0
                    held.append((service.base_name, name, f.path, f.size))
                    size += f.size
        return [*out, _Files(tuple(held))]

    def rows(self, part: _Files, wanted: Wanted, columns: StructType) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.options["path"].rstrip("/"))
        kinds = {"local": pa.timestamp("us"), "bytes": pa.int64()}
        for service, account, path, size in part.files:
            own, local = told(path.rpartition("/")[2])
            row = {"service": service, "account": account, "file": path, "id": own, "local": local, "bytes": size, "content": None, "problem": None}
            if "content" in columns.names or "problem" in columns.names:
                try:
                    with store.open_input_stream(path, compression=None) as f:
                        row["content"] = f.read().decode("utf-8-sig")
                except (UnicodeDecodeError, OSError) as e:
                    row["problem"] = f"can't be read: {type(e).__name__}"
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.string())) for c in columns.names], names=columns.names)


def raw(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """The files of all services and accounts below ``root``."""
    return scan(spark, CacheSource, root, columns)


def records(files: DataFrame, service: str, make: Callable[..., DataFrame] | None = None, mapping: str | None = None) -> DataFrame:
    """Records of one service's cached objects, with service, account, file and problem; ``mapping`` is a user's, for garmin.

    ``files`` has the columns of COLUMNS. A file that is no JSON object of the service is a row with a problem and nulls.
    """
    schema, reader = services.READERS[service]
    rows = files.where(F.col("service") == service)
    rows = rows.withColumn("o", F.from_json("content", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    rows = rows.withColumn("problem", F.coalesce("problem", F.when(F.col("o._bad").isNotNull() | F.col("o").isNull(), "not a JSON object of this service")))
    keep = ("service", "account", "file", "problem")
    if make is not None:
        return make(rows, F.col("o"), *keep)
    if service == "garmin":
        return reader(rows, F.col("o"), paths.variant(F.col("content")), *keep, mapping=mapping)
    return reader(rows, F.col("o"), False if service == "divelogs" else None, *keep)
