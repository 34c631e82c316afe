"""What the two classifiers share: folds by document id and a bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import written

#: Labelled rows that a classifier is fitted on, at most; those with the least hash of their id.
MAX_TRAIN = 20_000


def fold(key: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(parts)


def held_out(key: Column, parts: int, rest: int) -> Column:
    """Whether a row belongs to the held-out fold; a null id never does."""
    return F.coalesce(fold(key, parts) == rest, F.lit(False))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores put before it until no column has it; case doesn't count."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, rest: int, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y, part) of at most ``most`` labelled rows outside the held-out fold.

    Rows whose id or label is null don't count. ``part`` is 0 to 9, from a hash of the id. The chosen ids
    are broadcast, at most ``most`` of them; the rows are written, so that several passes read the texts of all documents once.
    """
    chosen = labels.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    chosen = chosen.where(~held_out(F.col("_id"), parts, rest)).orderBy(F.xxhash64("_id"), "_id", "y").limit(most)
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("text"))
    found = rows.join(F.broadcast(chosen), "_id").select("text", "y", F.expr("pmod(xxhash64(_id, 7), 10)").cast("int").alias("part"))
    return written(found, "labelled")
