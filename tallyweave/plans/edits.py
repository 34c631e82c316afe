"""Edits of records by a user: what each field takes, checked and put in place, with the reasons where an edit can't be taken."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.times import offset_minutes, zone_minutes, zone_name
from tallyweave.schema import TANK, array_of, text

# Fixed values of the editor: limits of numbers (least, most, whole, needed), texts, words and a tank's numbers.
NUMBERS = {
    "duration": (0, None, True, True), "max_depth": (0, None, False, True), "avg_depth": (0, None, False, False), "temp_min": (-5, 60, False, False), "temp_max": (-5, 60, False, False), "temp_avg": (-5, 60, False, False),
    "air_temp": (-60, 60, False, False), "number": (0, None, True, False), "surface_interval": (0, None, True, False), "bottom_time": (0, None, True, False), "water_density": (900, 1200, False, False),
    "lat": (-90, 90, False, False), "lng": (-180, 180, False, False), "exit_lat": (-90, 90, False, False), "exit_lng": (-180, 180, False, False), "weight": (0, None, False, False), "visibility": (0, None, False, False),
    "gf_low": (0, 100, True, False), "gf_high": (0, 100, True, False), "cns_start": (0, None, False, False), "cns_end": (0, None, False, False), "sac": (0, None, False, False),
}
TEXTS = ("location", "buddy", "notes", "suit", "computer_vendor", "computer_model", "computer_serial", "computer_firmware", "deco_model")
WORDS = {"dive_mode": ("oc_single_gas", "oc_multi_gas", "gauge", "ccr", "scr", "apnea"), "water_type": ("fresh", "salt", "en13319", "custom")}
TANK_NUMBERS = {"oxygen": (0, 100), "helium": (0, 100), "volume": (0, None), "start": (0, None), "end": (0, None)}
#: What the profile decides, if there is one.
LOCKED = ("duration", "max_depth", "avg_depth")
STARTS = ("date", "time", "utc_offset")


def _number(name: str, given: Column, least: float | None, most: float | None, needed: bool = False) -> tuple[Column, Column]:
    """A number, and why a text without outer blanks is none that will do (else null). Null is no value."""
    value = given.try_cast("double")
    wrong = F.when(given.isNull(), f"{name}: a value is needed" if needed else None).when(value.isNull() | F.isnan(value), F.concat(F.lit(f"{name}: not a number: "), given))
    if least is not None:
        wrong = wrong.when(value < least, f"{name}: below {least}")
    if most is not None:
        wrong = wrong.when(value > most, f"{name}: above {most}")
    return value, wrong


def _tank(asked: Column, old: Column) -> Column:
    """(tank, problems) of one row of the table: a name that is left out keeps the old tank's value, a blank clears it."""
    has = lambda n: F.map_contains_key(asked, F.lit(n))
    get = lambda n: F.try_element_at(asked, F.lit(n))
    default = {"oxygen": F.lit(21.0), "helium": F.lit(0.0)}
    values, wrong = {}, []
    for n in ("oxygen", "helium", "start", "end", "volume"):
        value, bad = _number(f"tank {n}", text(get(n)), *TANK_NUMBERS[n])
        empty = default.get(n, F.lit(None).cast("double"))
        values[n] = F.when(has(n), F.coalesce(value, empty)).otherwise(F.coalesce(old[n], empty))
        wrong.append(F.when(has(n), bad))
    for n in ("name", "role"):
        values[n] = F.when(has(n), text(get(n))).otherwise(old[n])
    wrong.append(F.when(values["oxygen"] + values["helium"] > 100 + 1e-9, "tank: O2 and He add up to more than 100 %"))
    return F.struct(F.struct(*[v.alias(n) for n, v in values.items()]).cast(TANK).alias("tank"), F.array_compact(F.array(*wrong)).alias("problems"))


def _start(get: Callable[[str], Column], has: Callable[[str], Column], zones: str) -> tuple[dict[str, Column], list[Column]]:
    """The clocks after an edit of date, time or offset: samples count from the start, so only the start moves."""
    local, utc = F.col("local"), F.col("utc")
    day = F.when(has("date"), get("date")).otherwise(F.date_format(local, "yyyy-MM-dd"))
    clock = F.when(has("time"), get("time")).otherwise(F.date_format(local, "HH:mm:ss"))
    days, clocks = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?$"
    at = lambda c, form, i: F.regexp_extract(c, form, i).try_cast("int")
    second = F.coalesce(at(clock, clocks, 3), F.lit(0))
    made = F.try_make_timestamp_ntz(at(day, days, 1), at(day, days, 2), at(day, days, 3), at(clock, clocks, 1), at(clock, clocks, 2), second)
    real_day = F.try_make_timestamp_ntz(at(day, days, 1), at(day, days, 2), at(day, days, 3), F.lit(0), F.lit(0), F.lit(0))
    asked = get("utc_offset")
    minutes = offset_minutes(asked)
    zone = F.when(has("utc_offset"), zone_name(minutes)).otherwise(F.col("zone"))
    named = F.when(F.find_in_set(zone, F.lit(zones)) > 0, zone)
    by_zone = F.coalesce(made - F.make_dt_interval(mins=zone_minutes(zone)), F.convert_timezone(named, F.lit("UTC"), made))
    # without a zone the distance of the two clocks stays as it was
    moved = F.coalesce(by_zone, F.when(utc.isNotNull(), made - (local - utc)))
    any_ = has("date") | has("time") | has("utc_offset")
    clock_parts = {"local": F.when(any_, made).otherwise(local), "zone": F.when(any_, zone).otherwise(F.col("zone")), "utc": F.when(any_, moved).otherwise(utc)}
    wrong = [
        F.when(has("date") & real_day.isNull(), F.concat(F.lit("date: use YYYY-MM-DD, not "), F.coalesce(day, F.lit("")))),
        F.when(has("time") & F.when(real_day.isNull(), ~F.regexp_like(F.coalesce(clock, F.lit("")), F.lit(clocks))).otherwise(made.isNull()), F.concat(F.lit("time: use HH:MM or HH:MM:SS, not "), F.coalesce(clock, F.lit("")))),
        F.when(has("utc_offset") & asked.isNotNull() & minutes.isNull(), F.concat(F.lit("utc_offset: not an offset: "), asked)),
    ]
    return clock_parts, wrong


def edited(records: DataFrame, asked: str = "asked", tanks: str | None = None) -> DataFrame:
    """Records (:mod:`tallyweave.schema`) with the edits that the column ``asked``, a map from field to text, wants, and ``problems``.

    A field that is left out stays, a blank one is cleared. Numbers are in SI units, but weight and visibility in the
    record's own unit (kilogram and meter if it has none); ``date``, ``time`` and ``utc_offset`` move the start, and UTC
    with it. ``tanks`` names a column with the whole table of tanks, an array of maps, null where tanks stay. What the
    profile decides can't be edited where there is one. If anything in an edit can't be taken, ``problems`` tells
    why and the record stays as it was; a null map asks for nothing. Other columns come along.
    """
    jvm = records.sparkSession._jvm
    zones = jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds())
    wants = F.coalesce(F.col(asked), F.create_map().cast("map<string,string>"))
    known = [*NUMBERS, *TEXTS, *WORDS, *STARTS]
    # each name is looked up once, as columns of its own
    out = records.withColumn("_has", F.struct(*[F.map_contains_key(wants, F.lit(n)).alias(n) for n in known])).withColumn("_in", F.struct(*[text(F.try_element_at(wants, F.lit(n))).alias(n) for n in known]))
    has, get = (lambda n: F.col(f"_has.{n}")), (lambda n: F.col(f"_in.{n}"))
    unknown = F.array_sort(F.array_except(F.map_keys(wants), F.array(*[F.lit(n) for n in known])))
    new, wrong = {}, [F.when(F.size(unknown) > 0, F.concat(F.lit("not an editable field: "), F.array_join(unknown, ", ")))]
    wrong += [F.when(has(n) & (F.size("samples") > 0), f"{n}: set by the profile") for n in LOCKED]
    for n, (least, most, whole, needed) in NUMBERS.items():
        value, bad = _number(n, get(n), least, most, needed)
        value = F.rint(value).try_cast("int") if whole else value
        new[n] = F.when(has(n), value).otherwise(F.col(n))
        if whole:
            bad = F.coalesce(bad, F.when(get(n).isNotNull() & value.isNull(), f"{n}: too large"))
        wrong.append(F.when(has(n), bad))
    for n in TEXTS:
        new[n] = F.when(has(n), get(n)).otherwise(F.col(n))
    for n, words in WORDS.items():
        new[n] = F.when(has(n), get(n)).otherwise(F.col(n))
        wrong.append(F.when(has(n) & ~get(n).isin(*words), F.concat(F.lit(f"{n}: not one of {', '.join(words)}: "), get(n))))
    for n, unit in (("weight", "kilogram"), ("visibility", "meter")):
        new[f"{n}_unit"] = F.when(has(n), F.when(new[n].isNotNull(), F.coalesce(F.nullif(F.col(f"{n}_unit"), F.lit("")), F.lit(unit)))).otherwise(F.col(f"{n}_unit"))
    wrong.append(F.when(new["temp_min"] > new["temp_max"], "temp_min: above temp_max"))
    wrong.append(F.when(new["gf_low"] > new["gf_high"], "gf_low: above gf_high"))
    clocks, bad = _start(get, has, zones)
    new |= clocks
    wrong += bad
    if tanks:
        out = out.withColumn("_tanks", F.transform(F.col(tanks), lambda t, i: _tank(F.coalesce(t, F.create_map().cast("map<string,string>")), F.get("tanks", i))))
        new["tanks"] = F.when(F.col("_tanks").isNotNull(), F.transform("_tanks", lambda t: t["tank"])).otherwise(F.col("tanks"))
    # a column of its own: within the filter of array_compact all checks would be interpreted
    out = out.withColumn("_wrong", F.array(*wrong))
    problems = F.when(F.array_max("_wrong").isNull(), array_of("string")).otherwise(F.array_compact("_wrong"))
    if tanks:
        problems = F.concat(problems, F.coalesce(F.flatten(F.transform("_tanks", lambda t: t["problems"])), array_of("string")))
    out = out.withColumn("problems", problems)
    fine = F.size("problems") == 0
    return out.withColumns({n: F.when(fine, c).otherwise(F.col(n)) for n, c in new.items()}).drop("_tanks", "_has", "_in", "_wrong")
