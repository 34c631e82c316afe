"""Operators over sample series: long DataFrames with ``dive``, ``t`` (seconds or other whole units), ``seq`` and values.

A dive's samples are one window partition; nothing crosses dives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(*by: str) -> Window:
    return Window.partitionBy("dive").orderBy("t", "seq", *by)


def so_far(*by: str) -> Window:
    return in_order(*by).rowsBetween(Window.unboundedPreceding, 0)


def modal_spacing(samples: DataFrame) -> DataFrame:
    """(dive, rate): the most frequent positive spacing of samples, of equally frequent ones the first seen; 1 without any."""
    gaps = samples.withColumn("gap", F.lead("t").over(in_order()) - F.col("t")).withColumn("_n", F.row_number().over(in_order()))
    counted = gaps.where("gap > 0").groupBy("dive", "gap").agg(F.count("*").alias("n"), F.min("_n").alias("first"))
    rate = counted.groupBy("dive").agg(F.max_by("gap", F.struct("n", -F.col("first"))).alias("rate"))
    return samples.select("dive").distinct().join(rate, "dive", "left").select("dive", F.coalesce("rate", F.lit(1)).cast("long").alias("rate"))


def resample(samples: DataFrame, decimals: tuple[int, int] = (3, 2)) -> DataFrame:
    """(dive, t, depth, temp) on an even grid of each dive's modal spacing, from its first to its last sample.

    Depth is interpolated; temperature too where both neighbours know it, else the left one's is kept; both are
    rounded to ``decimals``. A dive that is even already, or has fewer than two times, stays as it is. Samples without
    a time are left out.
    """
    timed = samples.where("t is not null").select("dive", "t", "seq", "depth", "temp")
    timed = timed.withColumn("_next", F.lead(F.struct("t", "depth", "temp")).over(in_order())).withColumn("_gap", F.col("_next.t") - F.col("t"))
    timed = timed.withColumn("_n", F.row_number().over(in_order()))
    counted = timed.where("_gap > 0").groupBy("dive", "_gap").agg(F.count("*").alias("n"), F.min("_n").alias("first"))
    rate = counted.groupBy("dive").agg(F.max_by("_gap", F.struct("n", -F.col("first"))).alias("rate"), F.count("*").alias("kinds"))
    start = timed.groupBy("dive").agg(F.min("t").alias("t0"))
    both = timed.join(start, "dive").join(rate, "dive", "left")
    even = F.coalesce(F.col("kinds") == 1, F.lit(True))
    kept = both.where(even).select("dive", "t", "depth", "temp")
    # each sample answers for the grid points from itself to before the next
    bent = both.where(~even).where("_next is null or _gap > 0")
    low = F.col("t0") + F.ceil((F.col("t") - F.col("t0")) / F.col("rate")) * F.col("rate")
    high = F.coalesce(F.col("_next.t") - 1, F.col("t"))
    grid = bent.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long")).where("_low <= _high").withColumn("g", F.explode(F.sequence("_low", "_high", F.col("rate").cast("long"))))
    f = (F.col("g") - F.col("t")) / F.col("_gap")
    on = F.col("_next").isNull() | (F.col("g") <= F.col("t"))
    lerp = lambda c: F.col(c) + (F.col(f"_next.{c}") - F.col(c)) * f
    depth = F.when(on, F.col("depth")).otherwise(lerp("depth"))
    temp = F.when(on, F.col("temp")).when(F.col("temp").isNotNull() & F.col("_next.temp").isNotNull(), lerp("temp")).otherwise(F.col("temp"))
    return kept.unionByName(grid.select("dive", F.col("g").alias("t"), F.round(depth, decimals[0]).alias("depth"), F.round(temp, decimals[1]).alias("temp")))


def mean_depth(samples: DataFrame) -> DataFrame:
    """(dive, mean): depth weighted by time, trapezoids between samples; the plain mean where no time passes."""
    rows = samples.withColumn("_t2", F.lead("t").over(in_order())).withColumn("_d2", F.lead("depth").over(in_order()))
    area = F.sum((F.col("depth") + F.col("_d2")) / 2 * (F.col("_t2") - F.col("t")))
    span = F.max("t") - F.min("t")
    return rows.groupBy("dive").agg(F.round(F.when(span > 0, area / span).otherwise(F.avg("depth")), 3).alias("mean"))


def held(samples: DataFrame, columns: Sequence[str], pairs: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Each of ``columns`` as last read at or before each sample. Columns of one of ``pairs`` are one reading: whichever sample has any of them sets all."""
    out = samples
    for c in columns:
        out = out.withColumn(c, F.last(c, ignorenulls=True).over(so_far()))
    for p in pairs:
        any_ = F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in p])
        reading = F.last(F.when(any_, F.struct(*p)), ignorenulls=True).over(so_far())
        out = out.withColumn("_p", reading).select(*[c for c in out.columns if c not in p], *[F.col(f"_p.{c}").alias(c) for c in p])
    return out


def sticky(samples: DataFrame, column: str, present: Column) -> DataFrame:
    """``column`` as last written at or before each sample, where ``present`` says it was written, be it as null."""
    return samples.withColumn(column, F.last(F.when(present, F.struct(F.col(column).alias("v"))), ignorenulls=True).over(so_far())["v"])


def changes(samples: DataFrame, column: str, seed: Column | None = None) -> DataFrame:
    """The samples whose ``column`` is known and differs from the one known before; the first counts unless it equals ``seed``."""
    before = F.last(column, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    if seed is not None:
        before = F.coalesce(before, seed)
    return samples.withColumn("_before", before).where(F.col(column).isNotNull() & ~F.col(column).eqNullSafe(F.col("_before"))).drop("_before")


def rate_of_change(samples: DataFrame, column: str = "depth", to: str = "speed") -> DataFrame:
    """Change of a column per unit of time since the sample before; 0 for the first and where no time passed."""
    gap = F.col("t") - F.lag("t").over(in_order())
    return samples.withColumn(to, F.coalesce(F.when(gap > 0, (F.col(column) - F.lag(column).over(in_order())) / gap), F.lit(0.0)))


def hysteresis(samples: DataFrame, column: str, on: float, off: float, to: str = "deep") -> DataFrame:
    """True from ``on`` upwards until the column falls below ``off``."""
    state = F.last(F.when(F.col(column) >= on, True).when(F.col(column) < off, False), ignorenulls=True).over(so_far())
    return samples.withColumn(to, F.coalesce(state, F.lit(False)))


def timeline(switches: DataFrame, starts: DataFrame) -> DataFrame:
    """(dive, t, gas): which gas is breathed from when. Switches before the start count at it; of one time the last stands."""
    moved = switches.join(starts, "dive").select("dive", F.greatest("t", "start").alias("t"), "seq", "gas")
    first = starts.select("dive", F.col("start").alias("t"), F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("gas"))
    return first.unionByName(moved.select("dive", "t", F.col("seq").cast("long").alias("seq"), F.col("gas").cast("long").alias("gas"))).groupBy("dive", "t").agg(F.max_by("gas", "seq").alias("gas"))


def setpoint_in_force(samples: DataFrame, switches: DataFrame, low: float, high: float) -> DataFrame:
    """Add ``setpoint``: that of the last switch; before the first the other one; null for a dive without switches.

    ``switches`` has dive, t, seq and ``to_high``.
    """
    kind = switches.select("dive", "t", (F.col("seq") - 0.5).alias("seq"), F.col("to_high"))
    both = samples.withColumn("_s", F.lit(True)).unionByName(kind, allowMissingColumns=True)
    before = F.last("to_high", ignorenulls=True).over(so_far())
    after = F.first("to_high", ignorenulls=True).over(in_order().rowsBetween(0, Window.unboundedFollowing))
    value = F.coalesce(before, ~after)
    return both.withColumn("setpoint", F.when(value, high).when(~value, low)).where("_s").select(*samples.columns, "setpoint")


def ceiling(samples: DataFrame, stop: str) -> DataFrame:
    """(dive, t, depth) of known stop depths, for dives that have one deeper than 0."""
    rows = samples.where(F.col(stop).isNotNull()).withColumn("_m", F.max(stop).over(Window.partitionBy("dive")))
    return rows.where("_m > 0").select("dive", "t", F.col(stop).alias("depth"))


def trapezoid(dives: DataFrame) -> DataFrame:
    """A drawn profile of each (dive, duration, max_depth, mean_depth): down, along, up, so that the mean comes out.

    The slopes take the share 1 - (2 * mean / max - 1) of the time, at least a hundredth; without a mean below the
    maximum and above half of it, a fifth each way.
    """
    ratio = F.col("mean_depth") / F.col("max_depth")
    slope = F.when((ratio > 0.5) & (ratio < 1), F.greatest((1 - ratio), F.lit(0.01))).otherwise(0.2)
    edge = F.greatest(F.lit(1), F.round(F.col("duration") * slope)).cast("long")
    point = lambda t, d: F.struct(t.cast("long").alias("t"), d.cast("double").alias("depth"))
    d = F.col("max_depth")
    points = F.array(point(F.lit(0), F.lit(0.0)), point(edge, d), point(F.col("duration") - edge, d), point(F.col("duration"), F.lit(0.0)))
    return dives.where("duration > 0 and max_depth > 0").select("dive", F.explode(points).alias("p")).select("dive", "p.t", "p.depth")


def chains(logs: DataFrame, most_gap_s: int = 7200) -> DataFrame:
    """Number the chains of logs (owner, log, start, end, serial): a log goes on if it starts no earlier than the one before ends, at most ``most_gap_s`` later, and serials don't differ."""
    order = Window.partitionBy("owner").orderBy("start", "log")
    gap = F.col("start") - F.lag("end").over(order)
    other = F.coalesce(F.col("serial") != F.last("serial", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    new = F.coalesce(~gap.between(0, most_gap_s), F.lit(True)) | other
    return logs.withColumn("gap", gap).withColumn("chain", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def merged_keeping_clock(samples: DataFrame) -> DataFrame:
    """Samples of one dive's logs (dive, log, t, seq, depth) with copies of each log's last sample every ``rate`` up to the next log."""
    order = Window.partitionBy("dive").orderBy("t", "log", "seq")
    rows = samples.withColumn("_t2", F.lead("t").over(order)).withColumn("_log2", F.lead("log").over(order)).join(modal_spacing(samples), "dive")
    fill = rows.where("_log2 <> log and _t2 - t > rate").withColumn("t", F.explode(F.expr("sequence(t + rate, _t2 - 1, rate)")))
    return samples.select("dive", "log", "t", "depth").unionByName(fill.select("dive", "log", "t", "depth"))


def merged_closing_gaps(samples: DataFrame) -> DataFrame:
    """The same logs, each moved to start one spacing after the end of the one before."""
    ends = samples.groupBy("dive", "log").agg(F.min("t").alias("first"), F.max("t").alias("last")).join(modal_spacing(samples), "dive")
    order = Window.partitionBy("dive").orderBy("first", "log")
    moved = ends.withColumn("_by", F.coalesce(F.lag("last").over(order) + F.col("rate") - F.col("first"), F.lit(0)))
    moved = moved.withColumn("_by", F.sum("_by").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return samples.join(moved.select("dive", "log", "_by"), ["dive", "log"]).select("dive", "log", (F.col("t") + F.col("_by")).alias("t"), "depth")


def shifted(dives: DataFrame, new_local: Column, offset_minutes: Column) -> DataFrame:
    """Dives (local, utc) with a new local start and the UTC that it means under an offset; sample offsets don't change."""
    return dives.withColumn("local", new_local).withColumn("utc", F.when(offset_minutes.isNotNull(), F.col("local") - F.make_dt_interval(mins=offset_minutes)))


#: Fixed values of the grid: bits of the phase, depths at which "at depth" begins and ends, the surface, and the largest no-stop time.
DIVING, AT_DEPTH, SURFACED = 0x08000000, 0x00010000, 0x04000000
AT_DEPTH_ON_M, AT_DEPTH_OFF_M, SURFACED_M, NDL_MOST_MIN = 8.5, 6.0, 1.0, 99


def fixed_grid(samples: DataFrame, every: int = 5, decimals: tuple[int, int] = (2, 1)) -> DataFrame:
    """(dive, n, t, depth, temp, pressure, ndl, speed, phase) each ``every`` units of time from a dive's first sample to its last.

    ``samples`` has dive, t, seq, depth, temp, pressure and ndl (minutes). Values between two samples are interpolated;
    where only one of them knows it, the earlier one's holds, and a later one's doesn't count yet. Of samples at one time
    the last (by seq) counts. Unknown temperature is 0, unknown no-stop time the largest. Speed is the ascent in units a
    minute since the point before. Samples without a time are left out, as are dives with fewer than two timed ones.
    """
    values = ("depth", "temp", "pressure", "ndl")
    rows = samples.where("t is not null").select("dive", "t", "seq", *values)
    whole = Window.partitionBy("dive")
    rows = rows.withColumn("_next", F.lead(F.struct("t", *values)).over(in_order())).withColumn("_t0", F.min("t").over(whole)).withColumn("_m", F.count("*").over(whole))
    rows = rows.where("_m > 1 and (_next is null or _next.t > t)")
    low = F.col("_t0") + F.ceil((F.col("t") - F.col("_t0")) / F.lit(every)) * every
    rows = rows.withColumn("_low", low.cast("long")).withColumn("_high", F.coalesce(F.col("_next.t") - 1, F.col("t")).cast("long"))
    grid = rows.where("_low <= _high").withColumn("g", F.explode(F.sequence("_low", "_high", F.lit(every).cast("long"))))
    share = (F.col("g") - F.col("t")) / (F.col("_next.t") - F.col("t"))
    between = lambda c: F.when(F.col("_next").isNull() | (F.col("g") <= F.col("t")) | F.col(f"_next.{c}").isNull(), F.col(c)).otherwise(F.col(c) + (F.col(f"_next.{c}") - F.col(c)) * share)
    points = grid.select("dive", F.col("g").alias("t"), F.lit(0).alias("seq"), F.round(between("depth"), decimals[0]).alias("depth"), F.coalesce(F.round(between("temp"), decimals[0]), F.lit(0.0)).alias("temp"), F.round(between("pressure"), decimals[0]).alias("pressure"), F.rint(between("ndl")).alias("ndl"))
    known = F.when(F.col("ndl").isNotNull(), F.least(F.greatest("ndl", F.lit(0)), F.lit(NDL_MOST_MIN)))
    points = points.withColumn("ndl", F.coalesce(known, F.lit(NDL_MOST_MIN)).cast("int"))
    points = hysteresis(points, "depth", AT_DEPTH_ON_M, AT_DEPTH_OFF_M, "_deep")
    phase = F.lit(DIVING) + F.when(F.col("_deep"), AT_DEPTH).otherwise(0) + F.when(F.col("depth") <= SURFACED_M, SURFACED).otherwise(0)
    speed = F.coalesce((F.lag("depth").over(in_order()) - F.col("depth")) / every * 60.0, F.lit(0.0))
    return points.select("dive", F.row_number().over(in_order()).alias("n"), "t", "depth", "temp", "pressure", "ndl", F.round(speed, decimals[1]).alias("speed"), phase.alias("phase"))


def merged_gases(gases: DataFrame) -> DataFrame:
    """(dive, log, at, place, new): the place in the joined list of each gas of a dive's two logs.

    ``gases`` has dive, log (1 or 2), at, oxygen, helium and mode. Log 1 keeps its list. A gas of log 2 takes the place
    of the first equal one (nulls are equal), else a new place after the last of log 1, in the order of log 2; ``new``
    marks the rows that add one. Gases without a place are left out.
    """
    key = [F.struct("oxygen", "helium", "mode").alias("_gas")]
    rows = gases.where("at is not null").select("dive", "log", "at", *key)
    per = rows.groupBy("dive", "_gas").agg(F.min(F.when(F.col("log") == 1, F.col("at"))).alias("_had"), F.min(F.when(F.col("log") == 2, F.col("at"))).alias("_first"))
    ends = rows.groupBy("dive").agg(F.coalesce(F.max(F.when(F.col("log") == 1, F.col("at"))), F.lit(-1)).alias("_end"))
    added = per.where("_had is null").withColumn("_n", F.row_number().over(Window.partitionBy("dive").orderBy("_first")))
    # nested nulls don't match in a join, so gases meet by their text
    text = lambda df: df.withColumn("_gas", F.to_json("_gas"))
    places = text(per).join(text(added).select("dive", "_gas", "_n"), ["dive", "_gas"], "left").join(ends, "dive")
    out = text(rows).join(places, ["dive", "_gas"])
    to = F.when(F.col("log") == 1, F.col("at")).otherwise(F.coalesce(F.col("_had"), F.col("_end") + F.col("_n")))
    return out.select("dive", "log", "at", to.cast("long").alias("place"), ((F.col("log") == 2) & F.col("_had").isNull() & (F.col("at") == F.col("_first"))).alias("new"))


def switch_markers(line: DataFrame, tanks: DataFrame) -> DataFrame:
    """(dive, t, label) of every switch after the first gas of a :func:`timeline`.

    ``tanks`` has dive, gas, name and label. The mix's name is the label, or the tank's own where another tank of the
    dive holds the same mix. A gas that isn't listed has no label.
    """
    shared = tanks.select("dive", "gas", F.when(F.count("*").over(Window.partitionBy("dive", "name")) > 1, F.col("label")).otherwise(F.col("name")).alias("label"))
    later = line.withColumn("_n", F.row_number().over(Window.partitionBy("dive").orderBy("t"))).where("_n > 1")
    return later.join(shared, ["dive", "gas"], "left").select("dive", "t", "label")


def detail(samples: DataFrame, asked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What is known of a dive at a time: each row of ``asked`` (dive, t) with ``columns`` as last read at or before it.

    Several samples at one time count in the order of seq; before the first reading a column is null. One sort by
    (dive, t); no pairs are made. Rows of ``asked`` that repeat are answered each.
    """
    both = samples.select("dive", "t", F.col("seq").cast("double").alias("seq"), *columns, F.lit(False).alias("_asked"))
    both = both.unionByName(asked.select("dive", "t", F.lit(float("inf")).alias("seq"), F.lit(True).alias("_asked")), allowMissingColumns=True)
    return held(both, columns).where("_asked").select("dive", "t", *columns)
