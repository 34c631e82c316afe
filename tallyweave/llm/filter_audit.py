"""Filter interaction audit: what each filter removes, given the filters that come before it, for all orders.

A document's failures are a mask of bits. Only cells, that is counts of documents for each part and mask, go on:
they are unpivoted against the steps of all orders into long form, where a running bit-or over the steps of an
order tells which failures came earlier. Sums under conditions give the counts of each step, and totals over a
filter's steps in all orders its share.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.hot_keys import joined
from tallyweave.session import written

WORDS = r"[^\x20\x09-\x0D]+"
#: All orders are unpivoted, and there are n! of them.
MOST_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: str = "text") -> dict[str, Column]:
    """The filters on a text without nulls: a condition for each letter, true where the document fails.

    Under 50 words; fewer than 65 distinct words of 100; more than 5 capitals of 100 code points; signs of markup.
    """
    t = F.col(text)
    words = F.regexp_extract_all(t, F.lit(WORDS), 0)
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(65) * F.size(words),
        "C": F.lit(100).cast("long") * capitals > F.lit(5).cast("long") * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, filters: dict[str, Column], copies: str | None, part: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, mask, n): how many rows of one key have one text in one part, with the bits of the filters that it fails.

    ``filters`` are conditions over the column ``text``; a null condition passes. ``copies`` names the filter, if
    any, that fails documents whose text a smaller key has, in any part. A null key is nobody's smaller key and
    fails no copies filter; rows that repeat the least key of a text all pass it. Bits go by the letters' order.
    """
    letters = sorted([*filters, *([copies] if copies else [])])
    bit = {f: 1 << i for i, f in enumerate(letters)}
    mask = F.lit(0)
    for f, condition in filters.items():
        mask = mask + F.when(condition, bit[f]).otherwise(0)
    inner = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    rows = inner.select("key", "part", mask.alias("mask"), F.unhex(F.sha2(F.col(text), 256)).alias("sha"))
    rows = rows.groupBy("key", "part", "mask", "sha").agg(F.count("*").alias("n"))
    if not copies:
        return rows.drop("sha")
    rows = written(rows, "audit-rows")
    least = rows.groupBy("sha").agg(F.min("key").alias("least"), F.count("*").alias("same")).where("same > 1")
    told = joined(rows, written(least, "audit-least"), "sha", "same")
    copy = F.coalesce(F.col("key") > F.col("least"), F.lit(False))
    return told.select("key", "part", (F.col("mask") + F.when(copy, bit[copies]).otherwise(0)).alias("mask"), "n")


def cells(failures: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just the filters of the mask.

    ``failures`` is what :func:`masks` gives. A document is good, or toxic, if any row of ``labels`` with its key
    says 1; keys that are null or have no label are neither.
    """
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("int").alias(c)
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(said("quality"), said("toxic"))
    # rows without a key would all meet in one task of the join
    known = failures.where("key is not null").join(marks, "key", "left").select("part", "mask", "n", "quality", "toxic")
    none = failures.where("key is null").select("part", "mask", "n", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    total = lambda c, to: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(to)
    return known.unionByName(none).groupBy("part", "mask").agg(F.sum("n").alias("n"), total("quality", "good"), total("toxic", "toxic"))


def interactions(counted: DataFrame, letters: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step, with COUNTS; ``counted`` is what :func:`cells` gives.

    The filters stand for the bits in the order of their letters. Everything about a part is dealt out once, by
    the part, and is at most 2^n cells times n! orders times n steps, whatever the number of documents.
    """
    letters = sorted(letters)
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters) or any(len(f) != 1 or not f.isalnum() for f in letters):
        raise ValueError(f"1 to {MOST_FILTERS} different letters, please")
    orders = F.split(F.lit(" ".join("".join(o) for o in permutations(letters))), " ")
    long = counted.repartition("part").select("*", F.explode(orders).alias("filter_order"))
    long = long.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    long = long.withColumn("bit", F.expr(f"shiftleft(1, instr('{''.join(letters)}', filter) - 1)"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("failed", F.col("mask").bitwiseAND(F.col("bit"))).withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, gone = F.col("failed") != 0, F.col("earlier") != 0
    total = lambda condition, of, to: F.sum(F.when(condition, F.col(of)).otherwise(0)).alias(to)
    out = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone, "n", "kept"),
        total(fails & ~gone, "n", "removed"),
        total(fails & gone, "n", "redundant"),
        total(F.col("mask") == F.col("bit"), "n", "unique_fails"),
        total(fails & ~gone, "good", "good_lost"),
        total(fails & ~gone, "toxic", "toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).select("part", "filter_order", "step", *COUNTS)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, filter_order, step, COUNTS) of ``filters`` (None: :func:`text_filters`) and the ``copies`` filter, for each part and all orders.

    Counts are of documents, within the part: kept after the step, removed by it, redundant (failing its filter, but
    removed earlier), unique_fails (failing its filter only), good_lost and toxic_lost (removed by it, and labelled
    1), and shapley, what its filter removes, summed over all orders. Null texts are empty; null parts are the empty
    part; repeated rows count each. Without documents the result is empty. Other columns are not read.
    """
    filters = text_filters(text) if filters is None else filters
    counted = written(cells(masks(docs, filters, copies, part, key, text), labels, key), "audit-cells")
    return interactions(counted, [*filters, *([copies] if copies else [])])
