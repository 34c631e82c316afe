"""Lookups of one record in another table, by an exact key first and by nearness next.

All give at most one row for each row asked; rows that find nothing are left out unless said otherwise. Ids are longs
that occur once on their side. Null keys, names, times and positions match nothing. Empty tables give no rows. Only the
columns named are read, so others may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.ranges import nearest_in_time, nearest_place

#: The same start within 120 s; read-back tolerances of depth in metres and of dive time in minutes.
DUPLICATE_S = 120
READBACK_DEPTH_M, READBACK_MIN = 0.5, 1


def _name(c: str) -> Column:
    text = F.lower(F.trim(F.col(c)))
    return F.when(text != "", text)


def find_place(points: DataFrame, places: DataFrame, radius: float, point: tuple[str, str, str, str], place: tuple[str, str, str, str]) -> DataFrame:
    """(point id, place id, metres): the place of the same name, else the nearest within ``radius`` metres.

    ``point`` and ``place`` name id, name, latitude and longitude. Names are compared trimmed and in lower case; of
    several places the smaller id is taken. ``metres`` is null for a place found by name. Places are brought to one
    row a name first, so a common name costs no more than others.
    """
    asked = points.select(F.col(point[0]).alias("_p"), _name(point[1]).alias("_name"), F.col(point[2]).alias("_lat"), F.col(point[3]).alias("_lng"))
    known = places.select(F.col(place[0]).alias("_q"), _name(place[1]).alias("_name"), F.col(place[2]).alias("_lat2"), F.col(place[3]).alias("_lng2"))
    first = known.where("_name is not null").groupBy("_name").agg(F.min("_q").alias("_q"))
    # points without a name would all meet in one task of the join
    nameless = asked.where("_name is null").withColumn("_q", F.lit(None).cast(dict(first.dtypes)["_q"]))
    named = asked.where("_name is not null").join(first, "_name", "left").unionByName(nameless)
    by_name = named.where("_q is not null").select("_p", "_q", F.lit(None).cast("double").alias("metres"))
    near = nearest_place(named.where("_q is null").select("_p", "_lat", "_lng"), known, radius, ("_p", "_lat", "_lng"), ("_q", "_lat2", "_lng2"))
    return by_name.unionByName(near.select("_p", "_q", "metres")).select(F.col("_p").alias(point[0]), F.col("_q").alias(place[0]), "metres")


def place_keys(points: DataFrame, places: DataFrame, radius: float, point: tuple[str, str, str, str], place: tuple[str, str, str, str]) -> DataFrame:
    """(point id, site, made): the key of the place found, else a new one made from name and position, the same for equal ones."""
    found = find_place(points, places, radius, point, place).select(point[0], F.col(place[0]).cast("string").alias("_known"))
    new = F.substring(F.sha1(F.concat_ws("|", F.coalesce(_name(point[1]), F.lit("")), *[F.coalesce(F.round(c, 6).cast("string"), F.lit("")) for c in point[2:]])), 1, 10)
    return points.join(found, point[0], "left").select(point[0], F.coalesce("_known", new).alias("site"), F.col("_known").isNull().alias("made"))


def _of_reference(sent: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of ``sent`` with ``_j``: the first log row of the same reference, else null."""
    filled = lambda df: df.withColumn("_ref", F.when(F.trim("ref") != "", F.col("ref")))
    first = filled(log).where("_ref is not null").groupBy("_ref").agg(F.min("j").alias("_j"))
    asked = filled(sent)
    # rows without a reference would all meet in one task of the join
    without = asked.where("_ref is null").withColumn("_j", F.lit(None).cast(dict(first.dtypes)["_j"]))
    return asked.where("_ref is not null").join(first, "_ref", "left").unionByName(without).drop("_ref")


def duplicates(sent: DataFrame, log: DataFrame, window_s: float = DUPLICATE_S) -> DataFrame:
    """(i, j, how): the logged row that each sent row already is.

    Both have ``ref`` and ``at`` (seconds). The first log row (by j) of the same reference counts, whatever its time,
    else the nearest start within the window, ties to the smaller j.
    """
    asked = _of_reference(sent.select("i", "ref", F.col("at").alias("_at")), log.select("j", "ref"))
    by_ref = asked.where("_j is not null").select("i", F.col("_j").alias("j"), F.lit("reference").alias("how"))
    near = nearest_in_time(asked.where("_j is null").select("i", "_at"), log.select("j", F.col("at").alias("_log_at")), "i", "j", "_at", "_log_at", window_s)
    return by_ref.unionByName(near.select("i", "j", F.lit("start").alias("how")))


def verified(sent: DataFrame, log: DataFrame, window_s: float = DUPLICATE_S, depth_m: float = READBACK_DEPTH_M, minutes: int = READBACK_MIN) -> DataFrame:
    """(i, j, wrong): what each sent row became in a log read again, and which of number, start, depth and time disagree.

    ``sent`` has i, ref, number, at, depth and duration (seconds); ``log`` j, ref, number, at, depth and minutes. A row
    is found by reference, else by its number with a start within the window (first by j). Every sent row is returned;
    one that isn't found has ``wrong`` = [missing]. What the log doesn't know isn't wrong.
    """
    sent = sent.select("i", "ref", "number", "at", "depth", "duration")
    got = log.select("j", F.col("number").alias("_number"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("minutes").alias("_minutes"))
    asked = _of_reference(sent, log.select("j", "ref"))
    # the window is part of the key, so a number that many rows have doesn't meet all of them
    slot = lambda c: F.floor(c / F.lit(float(window_s)))
    numbered = asked.where("_j is null").select("i", F.col("number").alias("_n"), "at", F.explode(F.array(*[slot(F.col("at")) + d for d in (-1, 0, 1)])).alias("_slot"))
    logged = log.select("j", F.col("number").alias("_n"), F.col("at").alias("_at"), slot(F.col("at")).alias("_slot"))
    by_number = numbered.join(logged, ["_n", "_slot"]).where(F.abs(F.col("at") - F.col("_at")) <= window_s).groupBy("i").agg(F.min("j").alias("_by_number"))
    found = asked.join(by_number, "i", "left").withColumn("j", F.coalesce("_j", "_by_number")).join(got, "j", "left")
    bad = {
        "missing": F.col("j").isNull(),
        "number": F.col("j").isNotNull() & ~F.col("_number").eqNullSafe(F.col("number")),
        "start": F.abs(F.col("_at") - F.col("at")) > window_s,
        "depth": F.abs(F.col("_depth") - F.col("depth")) > depth_m,
        "time": F.abs(F.col("_minutes") - F.rint(F.col("duration") / 60.0)) > minutes,
    }
    return found.select("i", "j", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad.items()])).alias("wrong"))


def mix_index(tanks: Column, oxygen: Column, helium: Column, tolerance: float = 0.5) -> Column:
    """Position from 0 of the first tank whose mix is within ``tolerance`` per cent of the given one; a missing share is 0. Null without one."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    same = F.transform(tanks, lambda g: (F.abs(zero(g["oxygen"]) - zero(oxygen)) <= tolerance) & (F.abs(zero(g["helium"]) - zero(helium)) <= tolerance))
    at = F.array_position(same, F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def filled_from(own: Column, twin: Column) -> tuple[Column, Column]:
    """A record with its blank fields from a twin's, and the names of those that were filled.

    Site, buddy and notes are blank when null or white space, weight and visibility when null; their units follow. A
    tank without a volume takes that of the twin's tank at the same place, if it is above 0. A null twin fills nothing.
    """
    texts = {"location": "site", "buddy": "buddy", "notes": "notes"}
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    out, words = own, []
    for field, word in texts.items():
        take = blank(own[field]) & ~blank(twin[field])
        out = out.withField(field, F.when(take, twin[field]).otherwise(own[field]))
        words.append(F.when(take, F.lit(word)))
    for field in ("weight", "visibility"):
        take = own[field].isNull() & twin[field].isNotNull()
        for name in (field, f"{field}_unit"):
            out = out.withField(name, F.when(take, twin[name]).otherwise(own[name]))
        words.append(F.when(take, F.lit(field)))
    volume = lambda i: F.get(twin["tanks"], i)["volume"]
    lacks = lambda t, i: F.coalesce(t["volume"].isNull() & (volume(i) > 0), F.lit(False))
    out = out.withField("tanks", F.transform(own["tanks"], lambda t, i: t.withField("volume", F.when(lacks(t, i), volume(i)).otherwise(t["volume"]))))
    some = F.exists(F.transform(own["tanks"], lacks), lambda x: x)
    return out, F.array_compact(F.array(*words, F.when(some, F.lit("tank volume"))))
