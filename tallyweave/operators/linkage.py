"""Pairing the records of two sides that share no key: links, then time, then keys, then time-zone shifts.

Both sides are DataFrames of the shape ``dive_side`` makes. Every step makes *edges* (candidate pairs) with an order,
and :func:`assign` takes them greedily, one to one. Edges only join within equal ``blocks`` columns, so an
account's records never meet another's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.ranges import within
from tallyweave.session import written

#: Fixed tolerances: depth in metres, duration in seconds, either as a share; starts this close count as equally close.
DEPTH_M, DEPTH_SHARE = 0.5, 0.03
DURATION_S, DURATION_SHARE = 90.0, 0.03
SAME_DISTANCE_S = 60
#: Match keys only count within a day; time-zone shifts are multiples of 15 minutes between these bounds.
KEY_HOURS = 24
SHIFT_STEP_MIN, SHIFT_SLACK_S, SHIFT_LEAST_MIN, SHIFT_MOST_MIN = 15, 180, 30, 840


def _tolerance(a: Column, b: Column, least: float, share: float) -> Column:
    return F.greatest(F.lit(least), F.lit(share) * F.greatest(a, b))


def _known(*columns: Column) -> Column:
    return reduce(lambda x, y: x & y, [F.coalesce(c > 0, F.lit(False)) for c in columns])


def mismatch(d1: Column, t1: Column, d2: Column, t2: Column) -> Column:
    """How far depths and durations differ, in tolerances; a missing one counts as one tolerance."""
    depth = F.when(_known(d1, d2), F.abs(d1 - d2) / _tolerance(d1, d2, DEPTH_M, DEPTH_SHARE)).otherwise(1.0)
    time = F.when(_known(t1, t2), F.abs(t1 - t2) / _tolerance(t1, t2, DURATION_S, DURATION_SHARE)).otherwise(1.0)
    return depth + time


def profiles_agree(d1: Column, t1: Column, d2: Column, t2: Column) -> Column:
    """Both depths and durations known, and each within its tolerance."""
    near = (F.abs(d1 - d2) <= _tolerance(d1, d2, DEPTH_M, DEPTH_SHARE)) & (F.abs(t1 - t2) <= _tolerance(t1, t2, DURATION_S, DURATION_SHARE))
    return _known(d1, t1, d2, t2) & F.coalesce(near, F.lit(False))


def zone_shift(delta_s: Column, grace_s: float) -> Column:
    """Minutes of the time-zone difference that a difference of starts can be, else null."""
    steps = F.rint(delta_s / (SHIFT_STEP_MIN * 60))
    shift = (steps * SHIFT_STEP_MIN).cast("int")
    fits = (F.abs(delta_s) > grace_s) & (F.abs(delta_s - steps * SHIFT_STEP_MIN * 60) <= SHIFT_SLACK_S) & F.abs(shift).between(SHIFT_LEAST_MIN, SHIFT_MOST_MIN)
    return F.when(fits, shift)


def shift_text(minutes: Column) -> Column:
    """``+8:00``, ``-3:30``."""
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("string"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))


def dive_side(df: DataFrame, side: str, ordinal: Column, local_s: Column, depth: Column, duration: Column, utc_s: Column | None = None, number: Column | None = None, own_id: Column | None = None, other_id: Column | None = None, blocks: dict[str, Column | str] | None = None) -> DataFrame:
    """One side: ordinal, start in seconds (local, and UTC where known), depth, duration, key number and ids."""
    none = lambda kind: F.lit(None).cast(kind)
    values = {
        "": ordinal.cast("long"),
        "_local": local_s.cast("double"),
        "_utc": none("double") if utc_s is None else utc_s.cast("double"),
        "_depth": depth.cast("double"),
        "_time": duration.cast("double"),
        "_number": none("string") if number is None else number.cast("string"),
        "_own": none("string") if own_id is None else own_id.cast("string"),
        "_other": none("string") if other_id is None else other_id.cast("string"),
    }
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in (blocks or {}).items()], *[c.alias(side + n) for n, c in values.items()])


def delta(sign_from: str = "i", to: str = "j") -> Column:
    """Signed difference of the starts in seconds: UTC where both know it, else local."""
    a, b = F.col(f"{sign_from}_utc"), F.col(f"{to}_utc")
    return F.when(a.isNotNull() & b.isNotNull(), b - a).otherwise(F.col(f"{to}_local") - F.col(f"{sign_from}_local"))


def time_edges(left: DataFrame, right: DataFrame, width_s: float, blocks: Sequence[str]) -> DataFrame:
    """Pairs whose starts are at most ``width_s`` apart. Pairs that both know UTC join on it, the others on local time."""
    both = within(left.where("i_utc is not null"), right.where("j_utc is not null"), "i_utc", "j_utc", width_s, blocks)
    one = within(left.where("i_utc is null"), right, "i_local", "j_local", width_s, blocks)
    two = within(left.where("i_utc is not null"), right.where("j_utc is null"), "i_local", "j_local", width_s, blocks)
    return both.unionByName(one).unionByName(two)


def scored(edges: DataFrame) -> DataFrame:
    """Edges with their order: minutes apart, mismatch, seconds apart, i, j."""
    apart = F.abs(delta())
    return edges.select("i", "j", F.floor(apart / SAME_DISTANCE_S).alias("near"), mismatch(F.col("i_depth"), F.col("i_time"), F.col("j_depth"), F.col("j_time")).alias("mismatch"), apart.alias("apart"))


ORDER = ("near", "mismatch", "apart", "i", "j")


def _firsts(left: DataFrame, order: Sequence[str]) -> DataFrame:
    """The edges that come first at both their ends."""
    first = lambda end: F.row_number().over(Window.partitionBy(end).orderBy(*order))
    return written(left.withColumn("_i", first("i")).withColumn("_j", first("j")).where("_i = 1 and _j = 1").select("i", "j"), "pairs")


def _without(left: DataFrame, pairs: DataFrame) -> DataFrame:
    return written(left.join(pairs.select("i"), "i", "left_anti").join(pairs.select("j"), "j", "left_anti"), "edges")


def _parts(edges: DataFrame) -> DataFrame:
    """Edges with ``part``, the same for all edges of a connected component.

    Each side takes the least number of its neighbours and then that of the number itself, until nothing changes; the
    jump makes the rounds grow with the logarithm of a chain's length, and a hub costs a row per task and round.
    """
    now = written(edges.withColumn("part", F.col("i")), "parts")
    before = None
    while True:
        for end in ("j", "i"):
            least = now.groupBy(end).agg(F.min("part").alias("_least"))
            now = now.join(least, end).withColumn("part", F.col("_least")).drop("_least")
        now = written(now, "parts")
        up = now.groupBy("i").agg(F.min("part").alias("_up")).withColumnRenamed("i", "part")
        now = written(now.join(up, "part", "left").withColumn("part", F.least("part", "_up")).drop("_up"), "parts")
        state = now.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return now
        before = state


def assign(edges: DataFrame, order: Sequence[str] = ORDER, rounds: int = 3, few: int = 100_000) -> DataFrame:
    """(i, j): what taking edges in order, each if both ends are free, gives. Both ends are long, an edge comes once.

    A round takes every edge that is the first of both its ends; such edges can't be in each other's way, and the
    first edge of all is among them. After ``rounds`` of them chains of ties are left: they are walked in order within
    each connected component that has at most ``few`` edges. What larger components hold goes on in rounds, which end
    as each takes an edge at least. Edges with a null end are left out; nulls
    in the order come first, whatever the component's size. No edges give no pairs.
    """
    left = written(edges.select("i", "j", *[c for c in order if c not in ("i", "j")]).where("i is not null and j is not null"), "edges")
    taken = _firsts(left, order)
    for _ in range(rounds - 1):
        left = _without(left, taken)
        if left.isEmpty():
            return taken
        taken = written(taken.unionByName(_firsts(left, order)), "pairs")
    left = _without(left, taken)
    if left.isEmpty():
        return taken
    parted = _parts(left)
    sized = parted.join(parted.groupBy("part").agg(F.count("*").alias("_n")), "part")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        i_used, j_used, out = set(), set(), []
        for i, j in rows.sort_values(list(order), na_position="first")[["i", "j"]].itertuples(index=False):
            if i not in i_used and j not in j_used:
                i_used.add(i)
                j_used.add(j)
                out.append((i, j))
        return pd.DataFrame(out, columns=["i", "j"])

    small = sized.where(F.col("_n") <= few).drop("_n").groupBy("part").applyInPandas(walk, "i long, j long")
    taken = written(taken.unionByName(small), "pairs")
    left = written(sized.where(F.col("_n") > few).drop("_n", "part"), "edges")
    while not left.isEmpty():
        best = _firsts(left, order)
        taken = written(taken.unionByName(best), "pairs")
        left = _without(left, best)
    return taken


def unpaired(left: DataFrame, right: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of each side that no pair has."""
    return left.join(pairs.select("i"), "i", "left_anti"), right.join(pairs.select("j"), "j", "left_anti")


def link_edges(left: DataFrame, right: DataFrame, links: DataFrame | None = None, blocks: Sequence[str] = ()) -> DataFrame:
    """Pairs by a stored foreign id on either side, or by the table ``links`` (source_id, target_id). Blanks never match."""
    full = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    a = left.withColumn("_ko", full("i_own")).withColumn("_kf", full("i_other"))
    b = right.withColumn("_jo", full("j_own")).withColumn("_jf", full("j_other"))
    same = reduce(lambda x, y: x & y, [a[c] == b[c] for c in blocks], F.lit(True))
    out = a.join(b, same & (F.col("_kf") == F.col("_jo"))).select("i", "j").unionByName(a.join(b, same & (F.col("_ko") == F.col("_jf"))).select("i", "j"))
    if links is not None:
        known = links.select(F.trim("source_id").alias("_ko"), F.trim("target_id").alias("_jo"))
        out = out.unionByName(a.join(known, "_ko").join(b, "_jo").select("i", "j"))
    return out.distinct()


def key_edges(left: DataFrame, right: DataFrame, blocks: Sequence[str] = ()) -> DataFrame:
    """Pairs with the same positive whole number as key, at most KEY_HOURS apart; the time is part of the join, so a common number doesn't meet all others of its kind."""
    whole = lambda c: F.expr(f"try_cast(trim({c}) as double)").cast("long")
    a = left.withColumn("_n", whole("i_number")).where("_n > 0")
    b = right.withColumn("_n", whole("j_number")).where("_n > 0")
    return scored(time_edges(a, b, KEY_HOURS * 3600.0, [*blocks, "_n"]))


def shift_edges(left: DataFrame, right: DataFrame, grace_s: float, blocks: Sequence[str] = ()) -> DataFrame:
    """(i, j, shift): pairs a time-zone shift apart whose profiles agree."""
    wide = time_edges(left, right, float(SHIFT_MOST_MIN * 60 + SHIFT_SLACK_S), blocks)
    agree = profiles_agree(F.col("i_depth"), F.col("i_time"), F.col("j_depth"), F.col("j_time"))
    return wide.where(agree).withColumn("shift", zone_shift(delta(), grace_s)).where("shift is not null").select("i", "j", "shift")


def vote(edges: DataFrame) -> DataFrame:
    """(i, j, shift): pairs whose shift has strictly more candidates than that of any rival of either end.

    Rounds repeat on what is left until one makes no pair; what still has candidates then stays unpaired. Each round but
    the last makes a pair, so they end.
    """
    left, taken = written(edges, "shifts"), None
    while True:
        support = left.join(left.groupBy("shift").agg(F.count("*").alias("n")), "shift")
        for end in ("i", "j"):
            here = Window.partitionBy(end)
            support = support.withColumn(f"_m{end}", F.max("n").over(here)).withColumn(f"_c{end}", F.sum((F.col("n") == F.col(f"_m{end}")).cast("int")).over(here))
        made = written(support.where("n = _mi and n = _mj and _ci = 1 and _cj = 1").select("i", "j", "shift"), "pairs")
        if made.isEmpty():
            return made if taken is None else taken
        taken = made if taken is None else taken.unionByName(made)
        left = written(left.join(made.select("i"), "i", "left_anti").join(made.select("j"), "j", "left_anti"), "shifts")


def match(left: DataFrame, right: DataFrame, grace_s: float = 900.0, links: DataFrame | None = None, keys: bool = True, blocks: Sequence[str] = ()) -> DataFrame:
    """(i, j, tier) of all pairs: links first, then starts within the grace window, then keys, then shifts."""
    pairs = assign(link_edges(left, right, links, blocks), ("i", "j")).withColumn("tier", F.lit("link"))
    a, b = unpaired(left, right, pairs)
    pairs = pairs.unionByName(assign(scored(time_edges(a, b, grace_s, blocks))).withColumn("tier", F.lit("time")))
    if keys:
        a, b = unpaired(left, right, pairs)
        pairs = pairs.unionByName(assign(key_edges(a, b, blocks)).withColumn("tier", F.lit("key")))
    a, b = unpaired(left, right, pairs)
    return pairs.unionByName(vote(shift_edges(a, b, grace_s, blocks)).select("i", "j", F.lit("shift").alias("tier")))


def removed(links: DataFrame, source_ids: DataFrame, target_ids: DataFrame) -> DataFrame:
    """What became of each remembered link: kept, source_gone, target_gone or both_gone."""
    s = source_ids.select(F.col("source_id"), F.lit(True).alias("_s")).distinct()
    t = target_ids.select(F.col("target_id"), F.lit(True).alias("_t")).distinct()
    state = F.when(F.col("_s") & F.col("_t"), "kept").when(F.col("_s"), "target_gone").when(F.col("_t"), "source_gone").otherwise("both_gone")
    return links.join(s, "source_id", "left").join(t, "target_id", "left").select("source_id", "target_id", state.alias("state"))
