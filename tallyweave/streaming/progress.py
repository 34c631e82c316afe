"""Durable progress for each record: what was sent to a service stays known, however a run ends.

A record's link (the id that the service gave it) is journalled right after it was sent, in a file of its own in a folder
that all executors share, and only then goes on. A stream keeps the links as state by record, so that later versions of a
record know theirs without a look at the journal; the journal serves what was sent in a batch that never ended.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from tallyweave.session import written
from tallyweave.sources.contract import opened

#: ``outcome`` is added, known (sent before, and not again) or failed (with its ``problem``).
OUTCOMES = "key string, link string, outcome string, problem string"
LINKS = "key string, link string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Send = Callable[[dict[str, Any]], str]


class Journal:
    """Links by key, a small file each."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _place(self, key: str) -> tuple[fs.FileSystem, str, str]:
        store, root = opened(self.folder)
        name = hashlib.sha1(key.encode()).hexdigest()
        return store, f"{root}/{name[:2]}", f"{name}.json"

    def get(self, key: str) -> str | None:
        store, folder, name = self._place(key)
        if store.get_file_info(f"{folder}/{name}").type != fs.FileType.File:
            return None
        with store.open_input_stream(f"{folder}/{name}", compression=None) as f:
            return json.loads(f.read())["link"]

    def put(self, key: str, link: str) -> None:
        """The link is there whole when this returns."""
        store, folder, name = self._place(key)
        store.create_dir(folder, recursive=True)
        held = f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(held, compression=None) as f:
            f.write(json.dumps({"key": key, "link": link}).encode())
        store.move(held, f"{folder}/{name}")


def links(spark: SparkSession, folder: str) -> DataFrame:
    """The LINKS of a journal."""
    store, root = opened(folder)
    if not any(f.type == fs.FileType.Directory for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))):
        return spark.createDataFrame([], LINKS)
    return spark.read.schema(LINKS).json(f"{folder.rstrip('/')}/*/*.json")


def _sent(journal: Journal, key: str | None, row: dict[str, Any], send: Send) -> tuple:
    """Send a record unless the journal knows it."""
    if key is None:
        return None, None, "failed", "a record without a key"
    link = journal.get(key)
    if link is not None:
        return key, link, "known", None
    try:
        link = send(row)
    except Exception as e:  # a refused record is an outcome; the others go on
        return key, None, "failed", f"{type(e).__name__}: {e}".split("\n")[0]
    journal.put(key, link)
    return key, link, "added", None


def deliver(records: DataFrame, key: str, send: Send, journal: str) -> DataFrame:
    """Send each record of a batch that the journal doesn't know; returns OUTCOMES, a row a key, when all are through.

    ``send`` gets a record as a dictionary and returns its link, or fails. Of rows with one key the one with the least
    text form is sent; a null key fails. A run that breaks off loses nothing that was sent: the next one begins with it
    known. A record that was being sent when an executor was lost is sent again, so a service should know a key.
    """
    text = F.to_json(F.struct(*records.columns))
    one = records.groupBy(F.col(key).cast("string").alias("_key")).agg(F.min_by(F.struct(*records.columns), text).alias("_row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Journal(journal)
        for batch in batches:
            out = [_sent(known, k, r, send) for k, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["key", "link", "outcome", "problem"])

    return written(one.mapInArrow(work, OUTCOMES), "delivered")


class _Deliver(StatefulProcessor):
    """State of a record: its link, once there is one."""

    def __init__(self, key: str, send: Send, journal: str):
        self.key, self.send, self.journal = key, send, Journal(journal)

    def init(self, handle) -> None:
        self.link = handle.getValueState("link", "link string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for row in rows:
            if self.link.exists():
                yield Row(key=key[0], link=self.link.get()[0], outcome="known", problem=None)
                continue
            given = row.asDict()
            given.pop("_key", None)
            name, link, outcome, problem = _sent(self.journal, key[0], given, self.send)
            if link is not None:
                self.link.update((link,))
            yield Row(key=name, link=link, outcome=outcome, problem=problem)

    def close(self) -> None:
        pass


def deliver_stream(stream: DataFrame, key: str, send: Send, journal: str, checkpoint: str, sink: str) -> None:
    """Send what is there now of a stream and stop; outcomes go to ``sink`` as Parquet, a folder a batch (``_batch=<n>``).

    A record that was sent in any batch is known in later ones by its state. A batch that broke off is run again, and what
    it had sent is known by the journal. Rows without a key are left out. A failed record is tried again when it comes again.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        keyed = stream.withColumn("_key", F.col(key).cast("string")).where("_key is not null")
        found = keyed.groupBy("_key").transformWithState(_Deliver(key, send, journal), StructType.fromDDL(OUTCOMES), "update", "none")

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{sink}/_batch={number}")

        query = found.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)
