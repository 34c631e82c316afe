"""What the samples and tanks of one record say, as Columns over its lists. Nothing is exploded, so no rows are shuffled.

Samples and tanks are those of :mod:`tallyweave.schema`, in order. A null list counts as an empty one; null elements
and null fields say nothing. Times need not rise: "first" and "last" go by place in the list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.schema import CHANNELS, MIX, SAMPLE, TANK

#: How far a header may be off in metres, in seconds, and in sample intervals.
HEADER_DEPTH_M, HEADER_S, HEADER_INTERVALS = 1.0, 30, 3
#: Modes and tank roles of a rebreather, and the mix that stands for an unknown one.
LOOP_MODES, LOOP_ROLES, UNKNOWN_MIX = ("ccr", "scr"), ("diluent", "oxygen"), (21.0, 0.0)
#: cells' words are hundred-thousandths of a bar per mV, and a new device's cells hold this word.
CELL_SCALE, CELL_AS_NEW = 100_000.0, 2_100


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _said(samples: Column, field: str) -> Column:
    """The values of a field that are there, in order."""
    return F.filter(F.transform(_list(samples, SAMPLE), lambda s: s[field]), lambda v: v.isNotNull())


def extremes(samples: Column, max_depth: Column | None = None, temp_min: Column | None = None, temp_max: Column | None = None, duration: Column | None = None) -> Column:
    """struct(deepest, coldest, warmest, last).

    Depth and time are the header's if it has them, else the samples', else 0. Temperatures are the samples', else
    the header's, else null.
    """
    none = F.lit(None).cast("double")
    depth, cold, warm = (none if c is None else c.cast("double") for c in (max_depth, temp_min, temp_max))
    time = (none if duration is None else duration).cast("int")
    last = F.try_element_at(_list(samples, SAMPLE), F.lit(-1))["t"]
    temps = _said(samples, "temp")
    return F.struct(
        F.coalesce(depth, F.array_max(_said(samples, "depth")), F.lit(0.0)).alias("deepest"),
        F.coalesce(F.array_min(temps), cold).alias("coldest"),
        F.coalesce(F.array_max(temps), warm).alias("warmest"),
        F.coalesce(time, last, F.lit(0)).alias("last"),
    )


def _readings(samples: Column) -> Column:
    """array<struct<tank,bar>>: every pressure of every tank, in order of samples."""
    each = F.transform(_list(samples, SAMPLE), lambda s: F.filter(F.map_entries(s["channels"]["pressures"]), lambda e: e["value"].isNotNull()))
    return F.flatten(F.filter(each, lambda e: e.isNotNull()))


def tank_readings(samples: Column) -> Column:
    """map<tank, struct(first, last)> of each tank's pressures; tanks without a reading are no key."""
    all_ = _readings(samples)
    tanks = F.array_sort(F.array_distinct(F.transform(all_, lambda e: e["key"])))
    of = lambda k: F.filter(all_, lambda e: e["key"] == k)
    return F.map_from_arrays(tanks, F.transform(tanks, lambda k: F.struct(F.element_at(of(k), 1)["value"].alias("first"), F.element_at(of(k), -1)["value"].alias("last"))))


def filled_pressures(tanks: Column, samples: Column) -> Column:
    """``tanks`` with the first and last reading of the same place where they have no start or end pressure."""
    read = tank_readings(samples)
    of = lambda i, side: F.try_element_at(read, i.cast("int"))[side]
    return F.transform(_list(tanks, TANK), lambda x, i: x.withField("start", F.coalesce(x["start"], of(i, "first"))).withField("end", F.coalesce(x["end"], of(i, "last"))))


def primary_transmitter(samples: Column) -> Column:
    """The least tank with any reading; null without one."""
    return F.array_min(F.transform(_readings(samples), lambda e: e["key"]))


def channel_names(samples: Column) -> Column:
    """Names of the channels, pressures apart, that any sample has a value of, sorted."""
    fields = [f.split(":")[0] for f in CHANNELS.removeprefix("struct<").removesuffix(">").replace("<int,double>", "").split(",")]
    given = lambda name: F.exists(_list(samples, SAMPLE), lambda s: _given(s["channels"], name))
    return F.filter(F.array(*[F.when(given(n), n) for n in sorted(fields) if n != "pressures"]), lambda n: n.isNotNull())


def _given(channels: Column, name: str) -> Column:
    return F.coalesce(F.size(channels[name]) > 0 if name == "o2_cells" else channels[name].isNotNull(), F.lit(False))


def header_problem(samples: Column, max_depth: Column, duration: Column, interval_s: Column) -> Column:
    """``none`` without samples, ``depth`` or ``time`` where header and samples disagree, null where they agree.

    The deepest sample may be a metre off; the last one under water 30 s and three intervals. A header without the
    value isn't checked for it.
    """
    under = F.filter(_list(samples, SAMPLE), lambda s: s["depth"] > 0)
    last = F.coalesce(F.try_element_at(under, F.lit(-1))["t"], F.lit(0))
    deep = F.abs(F.array_max(_said(samples, "depth")) - max_depth) > HEADER_DEPTH_M
    late = F.abs(last - duration) > HEADER_INTERVALS * interval_s + HEADER_S
    return F.when(F.size(_list(samples, SAMPLE)) == 0, "none").when(deep, "depth").when(late, "time")


def mixes(gases: Column) -> Column:
    """The different (oxygen, helium), each where it is first seen; nulls are 0, and a mix of nothing is none."""
    pairs = F.transform(_list(gases, MIX), lambda g: F.struct(F.coalesce(g["oxygen"].cast("double"), F.lit(0.0)).alias("oxygen"), F.coalesce(g["helium"].cast("double"), F.lit(0.0)).alias("helium")))
    return F.array_distinct(F.filter(pairs, lambda p: (p["oxygen"] != 0) | (p["helium"] != 0)))


def on_loop(mode: Column, tanks: Column, samples: Column) -> Column:
    """Whether a record holds anything of a rebreather: its mode, a tank's role, a setpoint or a cell of any sample."""
    role = F.exists(_list(tanks, TANK), lambda x: F.coalesce(x["role"].isin(*LOOP_ROLES), F.lit(False)))
    read = F.exists(_list(samples, SAMPLE), lambda s: _given(s["channels"], "setpoint") | _given(s["channels"], "o2_cells"))
    return F.coalesce(mode.isin(*LOOP_MODES), F.lit(False)) | role | read


def loop_tanks(mode: Column, tanks: Column, breathed: Column, programmed: Column) -> Column:
    """``tanks`` of a rebreather with roles from their names; other records' tanks as they are.

    O2 is oxygen; D and a digit, or DIL with or without one, is a diluent; cases and outer blanks don't count. A tank of
    the mix 21/0, which stands for an unknown one, becomes 100/0 or the mix of its diluent: the n-th of those breathed
    on the loop and then those ``programmed``, each once; the last if there are fewer; none if there are none.
    """
    known = mixes(F.concat(_list(breathed, MIX), _list(programmed, MIX)))
    name = lambda x: F.upper(F.trim(F.coalesce(x["name"], F.lit(""))))
    is_oxygen = lambda x: name(x) == "O2"
    is_diluent = lambda x: name(x).rlike("^D[0-9]$") | name(x).rlike("^DIL[0-9]?$")
    before = lambda i: F.size(F.filter(F.slice(tanks, F.lit(1), i), is_diluent))

    def placed(x: Column, i: Column) -> Column:
        unknown = (F.coalesce(x["oxygen"], F.lit(0.0)) == UNKNOWN_MIX[0]) & (F.coalesce(x["helium"], F.lit(0.0)) == UNKNOWN_MIX[1])
        own = F.try_element_at(known, F.least(before(i) + 1, F.size(known)))
        oxygen = x.withField("role", F.lit("oxygen"))
        diluent = x.withField("role", F.lit("diluent"))
        pure = oxygen.withField("oxygen", F.lit(100.0)).withField("helium", F.lit(0.0))
        mixed = diluent.withField("oxygen", own["oxygen"]).withField("helium", own["helium"])
        return (
            F.when(is_oxygen(x) & unknown, pure)
            .when(is_oxygen(x), oxygen)
            .when(is_diluent(x) & unknown & (F.size(known) > 0), mixed)
            .when(is_diluent(x), diluent)
            .otherwise(x)
        )

    return F.when(F.coalesce(mode.isin(*LOOP_MODES), F.lit(False)), F.transform(tanks, placed)).otherwise(tanks)


def cell_factors(mask: Column, *words: Column) -> Column:
    """map<cell, bar per mV> of the cells whose bit is set; empty where all of those still hold a new device's word."""
    on = [F.coalesce(F.shiftright(mask, i).bitwiseAND(F.lit(1)) == 1, F.lit(False)) & w.isNotNull() for i, w in enumerate(words)]
    cells = F.filter(F.array(*[F.when(o, F.struct(F.lit(i).alias("key"), w.alias("word"))) for i, (o, w) in enumerate(zip(on, words))]), lambda c: c.isNotNull())
    touched = F.filter(cells, lambda c: c["word"] != CELL_AS_NEW)
    used = F.when(F.size(touched) > 0, cells).otherwise(F.slice(cells, 1, 0))
    return F.map_from_entries(F.transform(used, lambda c: F.struct(c["key"].alias("key"), (c["word"] / CELL_SCALE).alias("value"))))


def cell_readings(millivolts: Column, factors: Column) -> Column:
    """map<cell, bar> of the cells that are calibrated, to three decimals."""
    return F.transform_values(F.map_filter(millivolts, lambda k, v: F.map_contains_key(factors, k) & v.isNotNull()), lambda k, v: F.round(v * factors[k], 3))


def logged_channels(stop_depth: Column, minutes: Column, on_circuit: Column, tts_min: Column, setpoint: Column, cns: Column, pressures: Column, tank_of: Column, gas_min: Column | None = None) -> Column:
    """Channels from what a device logs in one number each.

    ``minutes`` is the time of the stop if there is one and the no-stop time otherwise; ``setpoint`` counts on the
    circuit only; ``cns`` is a fraction. ``pressures`` by transmitter become those of the tank that ``tank_of`` gives;
    a transmitter without a tank keeps its number unless a tank's reading has it. Of several transmitters of one tank
    the highest counts. A stop depth of null is no stop.
    """
    stops = F.coalesce(stop_depth > 0, F.lit(False))
    seconds = lambda c: (c * 60).cast("int")
    entries = F.array_sort(F.map_entries(pressures))
    tank = lambda e: F.try_element_at(tank_of, e["key"])
    named = F.transform(F.filter(entries, lambda e: tank(e).isNotNull()), lambda e: F.struct(tank(e).alias("key"), e["value"].alias("value")))
    taken = F.transform(named, lambda e: e["key"])
    highest = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["key"] == e["key"]))
    rest = F.filter(entries, lambda e: tank(e).isNull() & ~F.array_contains(taken, e["key"]))
    values = {
        "pressures": F.map_from_entries(F.concat(highest, rest)),
        "ndl": F.when(~stops, seconds(minutes)),
        "tts": seconds(tts_min),
        "stop_depth": stop_depth,
        "stop_time": F.when(stops, seconds(minutes)),
        "cns": F.round(cns * 100, 1),
        "setpoint": F.when(on_circuit, setpoint),
        "gas_time": seconds(F.lit(None).cast("int") if gas_min is None else gas_min),
    }
    return F.struct(*[v.alias(k) for k, v in values.items()])


def by_hand(*objects: Column) -> Column:
    """Whether any of the variants, or the ``metadataDTO`` in it, says that the record was typed in."""
    flags = [F.try_variant_get(o, f"$.{at}{name}", "boolean") for o in objects for at in ("", "metadataDTO.") for name in ("manualActivity", "isManualActivity")]
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])


def device_name(manual: Column, product: Column, kind: Column, products: Column, kinds: Column) -> Column:
    """The device's name: by hand, the name of its product, that of its kind, else the number of the one or the other.

    ``products`` and ``kinds`` are maps from number to name, given by the caller. Nothing known is an empty text.
    """
    return (
        F.when(F.coalesce(manual, F.lit(False)), "Hand-logged")
        .otherwise(F.coalesce(F.try_element_at(products, product), F.try_element_at(kinds, kind), F.concat(F.lit("Garmin product "), product.cast("string")), F.concat(F.lit("Garmin device type "), kind.cast("string")), F.lit("")))
    )
