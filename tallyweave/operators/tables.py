"""What a log of records is asked as a table: first seen, newest, merged, set operations and the user's order.

Keys of null are keys like others in groups and match nothing in joins. Empty tables give no rows. Columns that start
with ``_`` are the operators' own; others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import leading_number, strip
from tallyweave.operators.ranges import within

#: Fixed value: an upload is found again if it starts within so many seconds.
UPLOADED_S = 120


def first_seen(rows: DataFrame, by: Sequence[str], value: str, *order: str, to: str = "values") -> DataFrame:
    """(by, to): the different values of each group as a list, each where it is first seen in ``order``; ties by value. Nulls are left out, but a group of them keeps its row.

    Values are brought to one row each before a list is made, so repeats cost nothing.
    """
    each = rows.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("_at"))
    seen = F.collect_list(F.when(F.col(value).isNotNull(), F.struct("_at", F.col(value).alias("v"))))
    return each.groupBy(*by).agg(F.transform(F.array_sort(seen), lambda x: x["v"]).alias(to))


def union_of(rows: DataFrame, by: Sequence[str], value: str, to: str = "values") -> DataFrame:
    """(by, to): the different values of each group, sorted; nulls are left out."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias(to))


def in_groups(rows: DataFrame, by: Sequence[str], *fields: str, to: str = "items") -> DataFrame:
    """(by, to): the rows of each group as a sorted list of structs of ``fields``: for reports of few rows a group, as conflicts of a pair are."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(to))


def next_number(rows: DataFrame, by: Sequence[str], number: str, to: str = "next") -> DataFrame:
    """The number after the greatest of each group; 1 where there is none."""
    return rows.groupBy(*by).agg(F.coalesce(F.max(number) + 1, F.lit(1)).alias(to))


def span(rows: DataFrame, by: Sequence[str], at: Column) -> DataFrame:
    """(by, oldest, newest); null where no row has a time."""
    return rows.groupBy(*by).agg(F.min(at).alias("oldest"), F.max(at).alias("newest"))


def newest_value(rows: DataFrame, by: Sequence[str], value: str, *order: str, to: str) -> DataFrame:
    """The value, null or not, of the last row of each group in ``order``."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_r")).select(*by, F.col("_r.v").alias(to))


def by_id(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose id begins so; with a whole id that row. An empty prefix finds none."""
    return rows.where(F.col(key).startswith(prefix)) if prefix else rows.limit(0)


def without_id(rows: DataFrame, key: str, one: str) -> DataFrame:
    """Rows but that of an id; those without an id stay."""
    return rows.where(~F.col(key).eqNullSafe(F.lit(one)))


def history(runs: DataFrame, at: str, tie: str, keep: int | None = None, **equal: str | None) -> DataFrame:
    """Runs, newest first, that equal each given value; None asks nothing."""
    asked = reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in equal.items() if v is not None], runs)
    out = asked.orderBy(F.desc(at), tie)
    return out if keep is None else out.limit(keep)


def merged(parts: DataFrame, by: str, order: str) -> DataFrame:
    """One summary of the parts of each record, which are counted in ``order``.

    ``depths`` and ``depth_sum`` (samples and their sum) and ``max_depth`` give mean and depth; ``bottom_time`` and
    ``oxygen_units`` and ``used`` are sums, null unless every part has one; ``cns``, ``nitrogen``, ``pressure`` and the
    position (``lat``, ``lng``) are the last that is known, each for itself; ``elapsed`` goes from the first start to
    the last end (``start`` + ``seconds``). Ties in ``order`` go by start.
    """
    place = F.struct(order, "start")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c)
    every = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c)
    end = F.max_by(F.col("start") + F.col("seconds"), place)
    return parts.groupBy(by).agg(
        (F.sum("depth_sum") / F.when(F.sum("depths") > 0, F.sum("depths"))).alias("mean_depth"),
        F.max("max_depth").alias("max_depth"),
        *[every(c) for c in ("bottom_time", "oxygen_units", "used")],
        *[last(c) for c in ("cns", "nitrogen", "pressure", "lat", "lng")],
        (end - F.min_by("start", place)).alias("elapsed"),
    )


def keep_first(rows: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    """One row of each key: the first in ``order``. Spark keeps one row a key before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    kept = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(*[F.col(c) if c in key else F.col("_r")[c].alias(c) for c in rows.columns])


def concatenated(inputs: dict[str, DataFrame], to: str = "origin") -> DataFrame:
    """The rows of several inputs with the name of theirs; columns that one lacks are null there."""
    named = [df.withColumn(to, F.lit(name)) for name, df in inputs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def absent(wanted: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    """The different keys wanted that aren't present; a null key is always absent."""
    return wanted.select(*key).distinct().join(present.select(*key).distinct(), list(key), "left_anti")


def shared(*tables: DataFrame) -> DataFrame:
    """The different rows that all tables have, as what fields several services share."""
    return reduce(lambda a, b: a.intersect(b), tables).distinct()


def upserted(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those of the same key, and in addition."""
    return stored.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def pruned(rows: DataFrame, rules: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose rule there still is: equal in all of ``key``, nulls to nulls."""
    mine = rows.withColumn("_k", F.struct(*key))
    return mine.join(rules.select(F.struct(*key).alias("_rule")).distinct(), F.col("_k").eqNullSafe(F.col("_rule")), "left_semi").drop("_k")


def unjoined(members: DataFrame, name: str, links: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b), a < b: pairs of members that no link joins, either way round. For the few services of a user: work and result are their number squared."""
    left, right = members.select(F.col(name).alias("a")).distinct(), members.select(F.col(name).alias("b")).distinct()
    joined = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return left.join(right, F.col("a") < F.col("b")).join(joined, ["a", "b"], "left_anti")


def sort_key(kind: str, c: Column) -> Column:
    """What a column is sorted by: ``text`` whatever its case, ``number`` by the number it begins with (0 without one), ``time`` as it is. Blanks are null."""
    text = strip(c.cast("string"))
    if kind == "time":
        return c
    if kind not in ("text", "number"):
        raise ValueError(f"no kind of order: {kind}")
    return F.when(text != "", F.coalesce(leading_number(text), F.lit(0.0)) if kind == "number" else F.lower(text))


def in_users_order(rows: DataFrame, kind: str, column: str, ordinal: str, down: bool = False) -> DataFrame:
    """Rows by a column, blanks last both ways, ties by ``ordinal`` upwards."""
    key = sort_key(kind, F.col(column))
    return rows.orderBy(key.desc_nulls_last() if down else key.asc_nulls_last(), ordinal)


def found_uploads(sent: DataFrame, listed: DataFrame, width: float = UPLOADED_S) -> DataFrame:
    """(i, j): the newest listed row that starts within ``width`` seconds of a sent one. ``sent`` has i and at, ``listed`` j and at; ties to the smaller j."""
    pairs = within(sent.select("i", F.col("at").alias("_a")), listed.where("j is not null").select("j", F.col("at").alias("_b_at")), "_a", "_b_at", width)
    return pairs.groupBy("i").agg(F.min_by("j", F.struct((-F.col("_b_at")).alias("d"), "j")).alias("j"))
