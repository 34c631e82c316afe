"""What a source of records is to Spark: a Python data source whose partitions are picked by account, kind, id and time.

A new source subclasses :class:`RecordSource`: it names itself, tells its schema, lists parts for what is wanted, and reads
a part. Filters of a query reach ``parts`` and ``rows`` as a :class:`Wanted`, which only ever narrows what is opened: Spark
applies every filter again, so a source may use as much of it as it can.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Columns by which parts are picked, where a source has them.
PICKED = ("service", "account", "kind", "id", "month")
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Wanted:
    """What a query asks for: allowed values of PICKED, and bounds, both included, of ``local``."""

    values: dict[str, set] = field(default_factory=dict)
    since: datetime | None = None
    until: datetime | None = None

    def add(self, f: Filter) -> None:
        """Narrow by a filter on one column; others are left to Spark."""
        place, value = getattr(f, "attribute", ()), getattr(f, "value", None)
        name = place[0] if len(place) == 1 else None
        if name in PICKED and isinstance(f, (EqualTo, In)):
            asked = {value} if isinstance(f, EqualTo) else set(value)
            self.values[name] = self.values[name] & asked if name in self.values else asked
        elif name == "local" and isinstance(value, datetime):
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.since = value if self.since is None else max(self.since, value)
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.until = value if self.until is None else min(self.until, value)

    def takes(self, name: str, value: Any) -> bool:
        return name not in self.values or value in self.values[name]

    def overlaps(self, first: datetime | None, last: datetime | None) -> bool:
        """Whether a part whose times lie from ``first`` to ``last`` may hold rows; None, None is a part without times."""
        if self.since is None and self.until is None:
            return True
        return first is not None and last is not None and (self.since is None or last >= self.since) and (self.until is None or first <= self.until)


class RecordSource(DataSource):
    """Base of sources: define ``name``, ``schema``, ``parts`` and ``rows``."""

    def parts(self, wanted: Wanted) -> Sequence[InputPartition]:
        raise NotImplementedError

    def rows(self, part: InputPartition, wanted: Wanted, columns: StructType) -> Iterator[pa.RecordBatch]:
        """Batches of the columns asked for, in their order."""
        raise NotImplementedError

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self, schema)


class _Reader(DataSourceReader):
    def __init__(self, source: RecordSource, columns: StructType):
        self.source, self.columns, self.wanted = source, columns, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            self.wanted.add(f)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        return self.source.parts(self.wanted)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.source.rows(partition, self.wanted, self.columns)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a place: local, shared, HDFS or an object store."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def scan(spark: SparkSession, source: type[RecordSource], path: str, columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    """The rows of a source; with ``columns``, only these are read, as Spark does not tell Python sources which it needs."""
    spark.dataSource.register(source)
    spark.conf.set(_PUSHDOWN, "true")
    reader = spark.read.format(source.name()).options(**options)
    if columns is not None:
        every = source({"path": path, **options}).schema()
        every = every if isinstance(every, StructType) else StructType.fromDDL(every)
        reader = reader.schema(StructType([every[c] for c in columns]))
    return reader.load(path)


def between(rows: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Rows from ``since`` to ``until``, both included, by their ``local`` time; without bounds all, undated ones too."""
    if since is not None:
        rows = rows.where(F.col("local") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        rows = rows.where(F.col("local") <= F.lit(until).cast("timestamp_ntz"))
    return rows


def by_id(rows: DataFrame, *ids: str) -> DataFrame:
    """The rows of these ids."""
    return rows.where(F.col("id").isin(list(ids)))
