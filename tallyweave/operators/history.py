"""Run history, action counts, conflicts and retention over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_actions(actions: DataFrame, by: Sequence[str] = ("run",), always: Sequence[str] = ()) -> DataFrame:
    """Rows for each kind of action; kinds that didn't occur are left out, but for those of ``always``, which count 0.

    A null action is a kind of its own; an empty table has no runs and so no rows.
    """
    each = F.array(F.struct(F.col("action"), F.lit(1).alias("n")), *[F.struct(F.lit(a).alias("action"), F.lit(0).alias("n")) for a in always])
    return actions.select(*by, F.inline(each)).groupBy(*by, "action").agg(F.sum("n").alias("n"))


def totals(actions: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """added, updated, deleted, skipped, failed and conflicts of each run, by how action names begin.

    ``skipped`` counts ``skipped`` and ``skipped_on_<service>``. Null actions count nowhere, but their run has a row.
    """
    starts = {"added": "uploaded_to_", "updated": "updated_on_", "deleted": "deleted_on_", "skipped": "skipped", "failed": "failed", "conflicts": "conflicts"}
    return actions.groupBy(*by).agg(*[F.count_if(F.startswith("action", F.lit(p))).alias(n) for n, p in starts.items()])


def worth_telling(notify_on: Column, dry_run: Column) -> Column:
    """Whether a finished run is reported: always, or under ``changes`` when it wrote, failed or left a conflict."""
    did = F.col("added") + F.col("updated") + F.col("deleted") + F.col("failed") + F.col("conflicts") > 0
    return (notify_on == "always") | ((notify_on == "changes") & ~dry_run & did)


def latest(runs: DataFrame, by: str, at: str, tie: str) -> DataFrame:
    """The last row of each ``by``."""
    names = [c for c in runs.columns if c != by]
    return runs.groupBy(by).agg(F.max_by(F.struct(*names), F.struct(at, tie)).alias("r")).select(by, "r.*")


def newest(runs: DataFrame, by: Sequence[str], at: str, tie: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each group. Spark keeps no more than that of any group before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(tie))
    return runs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")


def replace_pairs(stored: DataFrame, seen: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored conflicts without those of the pairs seen, and the new ones."""
    return stored.join(seen.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def prune_files(stored: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Stored rows that are kept no more; none if nothing at all is to be kept, as an empty listing is a failed one."""
    some = keep.limit(1).agg(F.count("*").alias("_n"))
    return stored.join(keep.select(key), key, "left_anti").join(F.broadcast(some), F.col("_n") > 0).drop("_n")


def stale(now: DataFrame, before: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Keys to fetch again: new ones, those whose listed fields changed, and incomplete ones."""
    mark = lambda df: F.xxhash64(*[df[c].cast("string") for c in fields])
    a = now.select(now[key], mark(now).alias("_a"))
    b = before.select(before[key], mark(before).alias("_b"), before["incomplete"].alias("_i"))
    reason = F.when(F.col("_b").isNull(), "new").when(F.col("_i"), "incomplete").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "left").withColumn("reason", reason).where("reason is not null").select(key, "reason")
