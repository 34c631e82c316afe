"""Runs over what is new: a file stream with a checkpoint, batches that may be written twice, and the marks of accounts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A run looks back this far behind its mark.
OVERLAP = "1 day"


def new_files(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet", **options: str) -> DataFrame:
    """A stream of the rows of files that come to ``folder``; a query's checkpoint remembers which it has seen."""
    return spark.readStream.schema(schema).options(**options).format(kind).load(folder)


def land(stream: DataFrame, sink: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> None:
    """Write all that is there now to ``sink`` and stop; the next call goes on where this one ended.

    A batch has its own folder ``_batch=<number>``, overwritten if it comes again after a failure, so each row stands there
    once. ``checkpoint`` and ``sink`` are in a folder that all executors share. Without new files nothing is written.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{sink}/_batch={number}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def newest(landed: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    """The last version of each key among landed rows: by ``order``, then by batch. A null key is a key."""
    rest = [c for c in landed.columns if c not in key and c != "_batch"]
    by = F.struct(*order, *(["_batch"] if "_batch" in landed.columns else []))
    return landed.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*key, "_r.*")


def window_totals(stream: DataFrame, at: str, by: Sequence[str], value: str, every: str, late: str) -> DataFrame:
    """(by, start, n, total) of each window of ``every``; rows later than ``late`` behind the newest seen don't count.

    The state holds open windows only. Rows without a time count nowhere.
    """
    windows = stream.withWatermark(at, late).groupBy(*by, F.window(at, every).alias("_w"))
    return windows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*by, F.col("_w.start").alias("start"), "n", "total")


def since(mark: Column, full: Column, overlap: str = OVERLAP) -> Column:
    """From when on a run looks: the mark less the overlap; null (everything) without a mark or when a full run is asked for."""
    return F.when(~F.coalesce(full, F.lit(False)), mark - F.expr(f"interval {overlap}"))


def fresh(rows: DataFrame, state: DataFrame, by: Sequence[str], at: str, overlap: str = OVERLAP) -> DataFrame:
    """The rows that a run looks at: those of accounts without a mark, and those at or after :func:`since`.

    ``state`` has ``by``, once each, with ``mark`` and ``full``. A row without a time is looked at only where everything is.
    """
    marks = state.select(*by, since(F.col("mark"), F.col("full"), overlap).alias("_since"))
    joined = rows.join(marks, list(by), "left")
    return joined.where(F.col("_since").isNull() | (F.col(at) >= F.col("_since"))).select(*rows.columns)


def finished(state: DataFrame, runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """State after runs (by, started, ended well or not as ``done``): a finished run moves the mark to its start and clears ``full``.

    A run that was stopped changes nothing; of several the latest finished one counts, and no mark moves back. Accounts
    without a state get one from their first finished run.
    """
    last = runs.where("done").groupBy(*by).agg(F.max("started").alias("_started"))
    both = state.select(*by, "mark", "full").join(last, list(by), "full")
    return both.select(*by, F.greatest("mark", "_started").alias("mark"), (F.coalesce("full", F.lit(False)) & F.col("_started").isNull()).alias("full"))


def gone(links: DataFrame, seen: DataFrame, state: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Links whose record was not seen, for accounts whose run looked at everything; elsewhere a missing record says nothing."""
    everything = state.where(since(F.col("mark"), F.col("full")).isNull()).select(*by)
    return links.join(everything, list(by), "left_semi").join(seen.select(*by, key), [*by, key], "left_anti")
