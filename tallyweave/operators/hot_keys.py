"""Left joins with a table of one row for each key, where a few keys may hold many of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many rows; so there are never more hot keys than this.
HOT = 10_000


def joined(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, null where it has no such key, or the key is null.

    ``facts`` is a table (read twice) with one row for each key and ``count``, how many of ``rows`` have it.
    Hot keys, at most HOT of them, are broadcast, so their rows stay where they are; the others are shuffled.
    """
    names = [c for c in facts.columns if c not in (key, count)]
    total = facts.agg(F.sum(count)).first()[0] or 0
    marked = facts.withColumnRenamed(key, "_hot_key")
    hot = marked.where(F.col(count) * HOT > total)
    cold = marked.where(F.col(count) * HOT <= total)
    tried = rows.join(F.broadcast(hot.select("_hot_key", *names, F.lit(True).alias("_hot"))), F.col(key) == F.col("_hot_key"), "left").drop("_hot_key")
    done = tried.where("_hot").drop("_hot")
    rest = tried.where(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot", *names)
    rest = rest.join(cold.drop(count), F.col(key) == F.col("_hot_key"), "left").drop("_hot_key")
    none = tried.where(F.col("_hot").isNull() & F.col(key).isNull()).drop("_hot")
    return done.unionByName(rest).unionByName(none)
