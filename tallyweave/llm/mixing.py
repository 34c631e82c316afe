"""Mixing sources to target weights: a budget handed down a tree, and seeded epochs at its leaves.

The levels of the tree are columns, from the root down (domain, language, source). A node's budget is shared
among its children by weight; a child gets no more than its capacity, that is the tokens below it times the
most epochs, and what it can't take goes to its siblings by weight. As a node's capacity is that of its
children together, a shortage only reaches the siblings of an ancestor when nothing below that ancestor can
take it. A leaf's budget buys whole epochs of its documents and the longest prefix, that fits, of the next
epoch's order, which is that of a seeded hash.

Only leaf totals, bucket totals and one cut per leaf are shuffled. No leaf's documents meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import written

#: Leaves whose cuts are broadcast, at most; beyond it they are joined by a shuffle.
BROADCAST_LEAVES = 20_000
#: Documents in one bucket of an epoch's order, about.
BUCKET = 5_000
#: A budget that is this close to a whole number of epochs, or of tokens, is that number: shares of weights are seldom exact as doubles.
SLACK = 1e-6
WORDS = r"[^\x20\x09-\x0D]+"


def _order(seed: int, epoch: Column, key: Column) -> Column:
    """Place of a document in an epoch: the MD5 of seed, epoch and id as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))  .cast("binary"))


def share(children: DataFrame, parent: list[str], budget: str, weight: str, capacity: str, to: str) -> DataFrame:
    """Add ``to``: each row's part of its parent's budget, by weight and never over its capacity.

    Children are taken by capacity for weight, least first: those that fill up are followed by children that
    all get the same share for their weight. A weight that is null or not positive gets nothing.
    """
    usable = F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.lit(0.0))
    rows = children.withColumn("_w", usable).withColumn("_c", F.when(F.col("_w") > 0, F.col(capacity)).otherwise(F.lit(0.0)))
    rows = rows.withColumn("_r", F.when(F.col("_w") > 0, F.col("_c") / F.col("_w")).otherwise(F.lit(float("-1"))))
    names = [c for c in children.columns if c not in (budget, weight, capacity)]
    ordered = Window.partitionBy(*parent).orderBy("_r", *names)
    before, whole = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_filled", F.coalesce(F.sum("_c").over(before), F.lit(0.0))).withColumn("_rest", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", F.when(F.col("_w") > 0, (F.col(budget) - F.col("_filled")) / F.col("_rest")))
    # of children with the same capacity for weight the first counts, whose level is the highest: later ones take it as filled
    first = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", (-F.col("_level")).alias("_down")))).over(whole)
    rows = rows.withColumn("_line", -first["_down"])
    given = F.when(F.col("_w") <= 0, F.lit(0.0)).when(F.col("_line").isNull(), F.col("_c")).otherwise(F.least(F.col("_c"), F.col("_line") * F.col("_w")))
    return rows.withColumn(to, given).drop("_w", "_c", "_r", "_filled", "_rest", "_level", "_line")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, DataFrame | None], total: float | None, most_epochs: int) -> DataFrame:
    """Leaf budgets. ``leaves`` has the level columns, n_docs and n_tokens, one row for each leaf; adds budget.

    ``weights[level]`` has the columns of the levels down to this one, and weight; a node that it lacks, or
    any where it is None, weighs 1. ``total`` None stands for the tokens that there are.

    Nodes are summed from the leaves up, and each level is joined with its parents' budgets once on the way
    down, so the plan grows with the levels and doesn't double with each.
    """
    nodes = [leaves.select(*levels, "n_docs", "n_tokens")]
    for i in range(len(levels) - 1, 0, -1):
        nodes.insert(0, nodes[0].groupBy(*levels[:i]).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
    budget = F.lit(float(total)) if total is not None else F.sum("n_tokens").over(Window.partitionBy(F.lit(0))).cast("double")
    rows = nodes[0].withColumn("_budget", budget)
    for i, level in enumerate(levels):
        if i:
            rows = _beside(nodes[i], above, levels[:i], "inner")
        given = weights.get(level)
        if given is None:
            rows = rows.withColumn("_weight", F.lit(1.0))
        else:
            here = levels[: i + 1]
            g = given.select(*here, F.col("weight").cast("double").alias("_weight")).dropDuplicates(here)
            rows = _beside(rows, g, here, "left").withColumn("_weight", F.coalesce("_weight", F.lit(1.0)))
        rows = rows.withColumn("_capacity", F.col("n_tokens") * F.lit(float(most_epochs)))
        rows = share(rows, levels[:i] or [F.lit(0)], "_budget", "_weight", "_capacity", "_next")
        above = rows.select(*levels[: i + 1], F.col("_next").alias("_budget"))
    return rows.select(*levels, "n_docs", "n_tokens", F.col("_next").alias("budget"))


def _beside(rows: DataFrame, side: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` with the other columns of ``side``, where all keys are the same; null is a key like others."""
    other = side.withColumnsRenamed({c: f"_k_{c}" for c in keys})
    alike = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    return rows.join(other, alike, how).drop(*[f"_k_{c}" for c in keys])


def _leaf(levels: dict[str, Column]) -> Column:
    """A leaf's name in one column; null levels are a level of their own."""
    return F.concat_ws("/", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in levels.values()])


def cuts(docs: DataFrame, levels: dict[str, Column], weights: dict[str, DataFrame | None], total: float | None, most_epochs: int, seed: int, key: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """(one narrow row for each document, one row for each leaf with its budget, epochs and cut)."""
    names = list(levels)
    narrow = docs.select(F.col(key).alias("_key"), *[c.alias(n) for n, c in levels.items()], _leaf(levels).alias("_leaf"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("n_tokens"))
    narrow = written(narrow, "mix-docs")
    leaves = narrow.groupBy(*names, "_leaf").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    leaves = written(leaves, "mix-leaves")
    planned = budgets(leaves, names, weights, total, most_epochs).withColumn("_leaf", _leaf({n: F.col(n) for n in names}))
    planned = planned.withColumn("epochs", F.when(F.col("n_tokens") > 0, F.floor(F.col("budget") / F.col("n_tokens") + F.lit(SLACK))).otherwise(F.lit(0)))
    planned = planned.withColumn("rest", F.greatest(F.col("budget") - F.col("epochs") * F.col("n_tokens"), F.lit(0.0))).withColumn("buckets", F.expr(f"greatest(1, n_docs div {BUCKET})"))
    planned = written(planned, "mix-plan")
    few = planned.count() <= BROADCAST_LEAVES
    side = F.broadcast if few else (lambda x: x)
    placed = narrow.join(side(planned.select("_leaf", "epochs", "rest", "buckets")), "_leaf").withColumn("_at", _order(seed, F.col("epochs"), F.col("_key")))
    bucket = F.floor(F.conv(F.substring("_at", 1, 8), 16, 10).cast("double") * F.col("buckets") / F.lit(2.0**32))
    placed = placed.withColumn("_bucket", bucket)
    sums = placed.groupBy("_leaf", "_bucket", "rest").agg(F.sum("n_tokens").alias("_sum"))
    run = Window.partitionBy("_leaf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = sums.withColumn("_upto", F.sum("_sum").over(run)).where(F.col("_upto") > F.col("rest") + SLACK).groupBy("_leaf").agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_sum")).alias("before"))).alias("e"))
    edge = written(edge.select("_leaf", F.col("e._bucket").alias("_edge"), F.col("e.before").alias("_before")), "mix-edge")
    inside = placed.join(side(edge), "_leaf").where("_bucket = _edge")
    # rows with the same id stand or fall together
    inside = inside.groupBy("_leaf", "_before", "rest", "_at").agg(F.sum("n_tokens").alias("_n"))
    order = Window.partitionBy("_leaf").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    stop = inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(order)).where(F.col("_upto") > F.col("rest") + SLACK).groupBy("_leaf").agg(F.min("_at").alias("cut"))
    plan = planned.join(stop, "_leaf", "left")
    return narrow, written(plan, "mix-cuts")


def _copies(rows: DataFrame, plan: DataFrame, seed: int, key: str) -> DataFrame:
    """Join each row with its leaf and add copies: whole epochs, and one more before the cut."""
    side = F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan
    both = rows.join(side, "_leaf")
    more = (F.col("rest") > SLACK) & (F.col("cut").isNull() | (_order(seed, F.col("epochs"), F.col(key)) < F.col("cut")))
    return both.withColumn("copies", F.col("epochs").cast("int") + F.when(more, 1).otherwise(0))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, DataFrame | None] | None = None, total: float | None = None, most_epochs: int = 4, seed: int = 0, key: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: the key, the levels, n_tokens, and copies, how often it is taken.

    ``levels`` maps names to expressions over ``docs``, from the root down. Tokens are words unless given.
    Null levels form nodes of their own; null or empty texts have no tokens and go where their hash puts
    them; rows that share a leaf and a key are taken together. A document is never cut: a prefix ends before
    the document that would pass the budget. No rows give no rows.
    """
    tokens = F.regexp_count("text", F.lit(WORDS)) if tokens is None else tokens
    narrow, plan = cuts(docs, levels, weights or {}, total, most_epochs, seed, key, tokens)
    plan = plan.select("_leaf", "epochs", "rest", "cut")
    return _copies(narrow, plan, seed, "_key").select(F.col("_key").alias(key), *levels, "n_tokens", "copies")


def mixed(docs: DataFrame, levels: dict[str, Column], weights: dict[str, DataFrame | None] | None = None, total: float | None = None, most_epochs: int = 4, seed: int = 0, key: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with the same columns."""
    tokens = F.regexp_count("text", F.lit(WORDS)) if tokens is None else tokens
    _, plan = cuts(docs, levels, weights or {}, total, most_epochs, seed, key, tokens)
    columns = docs.columns
    inner = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"), docs[key].alias("_key"), _leaf(levels).alias("_leaf"))
    taken = _copies(inner, plan.select("_leaf", "epochs", "rest", "cut"), seed, "_key").where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_n")).select("_row.*")
