"""Dives of UDDF files as records. Sites, buddies, mixes, computers, suits, models and sensors are joined by file and id.

The format has kelvin, pascal, cubic metres and shares. Dives are read by Spark's XML source; one more pass over the files
finds all small tables, which are maps that meet the file's dives. A dive without a start
is left out. Null elements, empty texts and unreadable numbers are null; files without dives give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.paths import bound
from tallyweave.functions.times import parsed, utc_of
from tallyweave.schema import TANK, array_of, channels, event, ids, known_temperature, number, record, rounded, sample, tank, text, whole
from tallyweave.session import written
from tallyweave.sources.xmls import by_key, entities, every_entity, get, in_force, item, listed, standing

# Elements of the format, and what two programs write in their own way.
_REF = "struct<_ref:string>"
_VALUE = "struct<_ref:string,_VALUE:string>"
_MODE = "struct<_type:string,_VALUE:string>"
_WAYPOINT = (
    f"struct<depth:string,divetime:string,temperature:string,tankpressure:array<{_VALUE}>,nodecotime:string,decostop:struct<_decodepth:string,_duration:string>,cns:string,"
    f"calculatedpo2:string,setpo2:string,measuredpo2:array<{_VALUE}>,ppo2:array<{_VALUE}>,gradientfactor:string,remainingbottomtime:string,heartbeat:string,switchmix:array<{_REF}>,"
    f"alarm:array<string>,setmarker:array<string>,divemode:{_MODE}>"
)
_TANKDATA = f"struct<_id:string,link:array<{_REF}>,tankvolume:string,tankpressurebegin:string,tankpressureend:string>"
_USED = f"struct<leadquantity:string,link:array<{_REF}>>"
DIVE = (
    f"_id string, informationbeforedive struct<link:array<{_REF}>,divenumber:string,datetime:string,airtemperature:string,surfaceintervalbeforedive:struct<passedtime:string>,equipmentused:{_USED}>, "
    f"applicationdata struct<tallyweave:struct<exitposition:struct<latitude:string,longitude:string>>>, tankdata array<{_TANKDATA}>, samples struct<waypoint:array<{_WAYPOINT}>>, equipmentused {_USED}, "
    f"informationafterdive struct<greatestdepth:string,averagedepth:string,diveduration:string,lowesttemperature:string,visibility:string,rating:struct<ratingvalue:string>,notes:struct<para:array<string>>,equipmentused:{_USED}>"
)
SITE = "_id string, name string, geography struct<latitude:string,longitude:string>"
BUDDY = "_id string, personal struct<firstname:string,lastname:string,nickname:string>"
MIX = "_id string, o2 string, he string"
COMPUTER = "_id string, name string, model string, serialnumber string, manufacturer struct<name:string>, notes struct<para:array<string>>"
SUIT = "_id string, name string"
MODEL = "_id string, gradientfactorlow string, gradientfactorhigh string"
SENSOR = "_id string"
GENERATOR = "name string"
#: The program whose files hold partial pressures in bar, and pressures from here on as a transmitter's status.
BAR_PROGRAM, STATUS_BAR = "shearwater cloud", 0xFF0 * 2 / 14.5037738
OWN_PROGRAM, FIRMWARE = "tallyweave", "Firmware "
#: The program, and the computer, of which only the first three cells count.
CELL_PROGRAM, CELL_COMPUTER, CELLS = "AP DiveSight", "INSPIRATION", 3
LOOPS = ["closedcircuit", "semiclosedcircuit"]
MODES = {"closedcircuit": "ccr", "semiclosedcircuit": "scr", "apnoe": "apnea"}
MAPS = ("sites", "buddies", "mixes", "computers", "suits", "models")


def celsius(c: Column) -> Column:
    return F.round(number(c) - 273.15, 2)


def bar(c: Column) -> Column:
    return F.round(number(c) / 100_000, 2)


def tank_slots(o: Column, mixes: Column, status_from: Column) -> Column:
    """A struct of ``tanks`` of a dive, ``refs``, the map of pressure references to them, and ``tank_mixes``, the mix of each.

    A reference is a tank's id; ``T<n>`` that names none is the n-th; with one tank any is its. A slot without mix,
    volume, pressure or reading is not in use and left out, and the others move up. ``status_from``: bar from which
    pressures are no readings, and 0 is unknown; null for files where all are.
    """
    used = listed(F.flatten(F.transform(listed(o["samples"]["waypoint"], _WAYPOINT), lambda w: listed(w["tankpressure"], _VALUE))), _VALUE)
    reads = lambda p: number(p["_VALUE"]).isNotNull() & F.when(status_from.isNull(), F.lit(True)).otherwise(bar(p["_VALUE"]) < status_from)
    refs = F.array_sort(F.array_distinct(F.transform(F.filter(used, reads), lambda p: F.coalesce(p["_ref"], F.lit("")))))
    raw = listed(o["tankdata"], _TANKDATA)
    given = F.struct(raw.alias("raw"), refs.alias("refs"), F.transform(raw, lambda t: F.coalesce(t["_id"], F.lit(""))).alias("names"))
    pressure = lambda c: bound(bar(c), lambda v: F.when(status_from.isNull() | (v != 0), v))
    pressed = lambda c: F.coalesce(pressure(c), F.lit(0.0)) != 0
    mix_id = lambda t: F.coalesce(F.try_element_at(t["link"], F.lit(1))["_ref"], F.lit(""))

    def place(x: Column, ref: Column) -> Column:
        """The slot, from 0, that a reference names by id or number."""
        own = F.array_position(x["names"], ref)
        n = F.regexp_extract(ref, r"^T([0-9]+)$", 1).try_cast("int")
        return F.when((own > 0) & (ref != ""), own - 1).when(n.between(1, F.size(x["raw"])), n - 1)

    def kept(x: Column, placed: Column) -> Column:
        read = F.transform(placed, lambda p: F.coalesce(p["place"], F.when(F.size(x["raw"]) == 1, F.lit(0))))
        in_use = lambda t, i, read: (F.size(listed(t["link"], _REF)) > 0) | number(t["tankvolume"]).isNotNull() | pressed(t["tankpressurebegin"]) | pressed(t["tankpressureend"]) | F.array_contains(read, i.cast("long"))
        return bound(read, lambda read: F.filter(F.transform(x["raw"], lambda t, i: F.struct(i.cast("long").alias("i"), t.alias("t"), in_use(t, i, read).alias("used"))), lambda k: k["used"]))

    def told(x: Column, placed: Column, kept: Column, slots: Column) -> Column:
        by_number = lambda i: F.try_element_at(F.filter(placed, lambda p: ~F.array_contains(x["names"], p["ref"]) & (p["place"] == i)), F.lit(1))["ref"]

        def one(k: Column) -> Column:
            t = k["t"]
            name = F.coalesce(F.when(t["_id"] != "", t["_id"]), by_number(k["i"]))
            made = lambda mix: tank(F.round(F.coalesce(mix["oxygen"], F.lit(21.0)), 1), F.round(F.coalesce(mix["helium"], F.lit(0.0)), 1), pressure(t["tankpressurebegin"]), pressure(t["tankpressureend"]), F.round(number(t["tankvolume"]) * 1000, 3), name)
            return bound(get(mixes, mix_id(t)), made)

        to = lambda r: F.array_position(slots, F.coalesce(place(x, r), F.when(F.size(kept) == 1, F.element_at(slots, 1))))
        every = F.array_union(x["refs"], F.filter(x["names"], lambda n: n != ""))
        index = by_key(F.transform(every, lambda r: F.struct(r.alias("k"), bound(to(r), lambda n: F.when(n > 0, n - 1).cast("int")).alias("v"))), "string", "int")
        return F.struct(F.transform(kept, one).alias("tanks"), index.alias("refs"), F.transform(kept, lambda k: mix_id(k["t"])).alias("tank_mixes"))

    def of(x: Column) -> Column:
        placed = F.transform(x["refs"], lambda r: F.struct(r.alias("ref"), place(x, r).alias("place")))
        with_slots = lambda placed, kept: bound(F.transform(kept, lambda k: k["i"]), lambda slots: told(x, placed, kept, slots))
        return bound(placed, lambda placed: bound(kept(x, placed), lambda k: with_slots(placed, k)))

    return bound(given, of)


def modes_so_far(waypoints: Column) -> Column:
    """Where modes change, as the file spells them (see :func:`tallyweave.sources.xmls.standing`)."""
    return standing(F.transform(waypoints, lambda w: F.coalesce(F.nullif(w["divemode"]["_type"], F.lit("")), text(w["divemode"]["_VALUE"]))))


def tanks_of_mixes(waypoints: Column, modes: Column, mixes: Column, order: Column) -> Column:
    """(mix, open, tank) of a dive in a file without tanks: one for each mix; on a rebreather they are diluents, and mixes switched to on open circuit have a bailout tank of their own besides."""
    loop = F.exists(modes, lambda m: m["v"].isin(LOOPS))
    mix = lambda k: mixes[k]
    made = lambda k, role: tank(F.round(mix(k)["oxygen"], 1), F.round(mix(k)["helium"], 1), role=role)
    first = F.transform(order, lambda k: F.struct(k.alias("mix"), F.lit(False).alias("out"), made(k, F.when(loop, "diluent")).alias("tank")))
    switched = F.flatten(F.transform(waypoints, lambda w, i: F.when(F.coalesce(in_force(modes, i).isin(LOOPS), F.lit(False)), array_of("string")).otherwise(F.transform(listed(w["switchmix"], _REF), lambda s: s["_ref"]))))
    out = F.array_distinct(F.filter(switched, lambda k: F.array_contains(order, k)))
    second = F.transform(out, lambda k: F.struct(k.alias("mix"), F.lit(True).alias("out"), made(k, F.lit("bailout")).alias("tank")))
    return F.when(loop, F.concat(first, second)).otherwise(first)


def waypoint_samples(waypoints: Column, refs: Column, n_tanks: Column, sensors: Column, skipped: Column, in_bar: Column) -> Column:
    """Samples of waypoints that have a depth. Cells are those that the file lists; references that it doesn't get the next places in the order of their first use."""
    po2 = lambda c: F.when(in_bar, F.round(number(c), 2)).otherwise(bar(c))
    cells = lambda w: F.concat(listed(w["measuredpo2"], _VALUE), F.filter(listed(w["ppo2"], _VALUE), lambda p: p["_ref"].isNotNull()))
    counts = lambda p: po2(p["_VALUE"]).isNotNull() & ~F.array_contains(skipped, F.coalesce(p["_ref"], F.lit("")))
    seen = F.array_distinct(F.flatten(F.transform(waypoints, lambda w: F.transform(F.filter(cells(w), counts), lambda p: F.coalesce(p["_ref"], F.lit(""))))))
    reads = lambda p: in_bar & (bar(p["_VALUE"]) >= STATUS_BAR)

    def one(w: Column, order: Column, refs: Column, n_tanks: Column) -> Column:
        slot = lambda p: F.coalesce(get(refs, F.coalesce(p["_ref"], F.lit(""))), F.when(n_tanks <= 1, F.lit(0)))
        cell = lambda p: F.array_position(order, F.coalesce(p["_ref"], F.lit(""))) - 1
        none = F.create_map().cast("map<int,double>")
        pressures = by_key(F.transform(w["tankpressure"], lambda p: F.struct(slot(p).alias("k"), F.when(~reads(p), bar(p["_VALUE"])).alias("v"))), "int", "double")
        pressures = F.when(w["tankpressure"].isNotNull(), pressures).otherwise(none)
        o2 = by_key(F.transform(F.filter(cells(w), counts), lambda p: F.struct(cell(p).alias("k"), po2(p["_VALUE"]).alias("v"))), "int", "double")
        o2 = F.when(w["measuredpo2"].isNotNull() | w["ppo2"].isNotNull(), o2).otherwise(none)
        known = {
            "ndl": rounded(w["nodecotime"]), "stop_depth": number(w["decostop"]["_decodepth"]), "stop_time": rounded(w["decostop"]["_duration"]), "cns": number(w["cns"]), "ppo2": po2(w["calculatedpo2"]),
            "setpoint": po2(w["setpo2"]), "gf99": number(w["gradientfactor"]), "gas_time": rounded(w["remainingbottomtime"]), "heart_rate": rounded(w["heartbeat"]),
        }

        def made(x: Column) -> Column:
            main = F.try_element_at(x["pressures"], F.lit(0))
            # the first tank's pressure alone is the sample's own, and needs no channels
            alone = main.isNotNull() & (F.size(x["pressures"]) == 1) & (F.size(x["o2_cells"]) == 0) & F.coalesce(*[x[n].cast("double") for n in known]).isNull()
            return sample(rounded(w["divetime"]), number(w["depth"]), celsius(w["temperature"]), main, F.when(~alone, channels(**{n: x[n] for n in ("pressures", "o2_cells", *known)})))

        return bound(F.struct(pressures.alias("pressures"), o2.alias("o2_cells"), *[c.alias(n) for n, c in known.items()]), made)

    # a dive's own are worked out once, not for each waypoint
    of_dive = F.struct(F.concat(sensors, F.array_except(seen, sensors)).alias("order"), refs.alias("refs"), n_tanks.alias("n_tanks"))
    return bound(of_dive, lambda x: F.transform(waypoints, lambda w: one(w, x["order"], x["refs"], x["n_tanks"])))


def waypoint_events(waypoints: Column, modes: Column, mixes: Column, tank_of: Column, open_circuit: Column) -> Column:
    """Gas switches, alerts, bookmarks and changes of mode, at the waypoint's second, else the one before's. ``tank_of`` maps ``mix|open`` to a tank."""
    t = lambda i: rounded(item(waypoints, i)["divetime"])
    says = lambda w: F.coalesce(w["switchmix"].isNotNull() | w["alarm"].isNotNull() | w["setmarker"].isNotNull() | w["divemode"].isNotNull(), F.lit(False))
    word = lambda m: F.coalesce(*[F.when(m == k, v) for k, v in (*MODES.items(), ("opencircuit", None)) if v], F.when(m == "opencircuit", open_circuit), m)

    def at(w: Column, i: Column, tank_of: Column) -> Column:
        when = F.coalesce(t(i), t(i - 1), F.lit(0))
        out = ~F.coalesce(in_force(modes, i).isin(LOOPS), F.lit(False))
        key = lambda s: F.concat(s["_ref"], F.lit("|"), out.cast("string"))
        switches = F.transform(listed(w["switchmix"], _REF), lambda s: event(when, "gas_switch", None, get(tank_of, key(s)), F.round(get(mixes, s["_ref"])["oxygen"], 1), F.round(get(mixes, s["_ref"])["helium"], 1)))
        alarms = F.transform(listed(w["alarm"], "string"), lambda a: event(when, "alert", text(a)))
        marks = F.transform(listed(w["setmarker"], "string"), lambda a: event(when, "bookmark", text(a)))
        named = F.coalesce(F.nullif(w["divemode"]["_type"], F.lit("")), text(w["divemode"]["_VALUE"]))
        changed = named.isNotNull() & in_force(modes, i - 1).isNotNull() & (word(named) != word(in_force(modes, i - 1)))
        change = F.when(F.coalesce(changed, F.lit(False)), F.array(event(when, "mode_change", word(named)))).otherwise(F.array().cast(_EVENTS))
        return F.concat(switches, alarms, marks, change)

    # few waypoints say something
    some = F.filter(F.transform(waypoints, lambda w, i: F.struct(i.alias("i"), F.when(says(w), w).alias("w"))), lambda x: x["w"].isNotNull())
    return bound(tank_of, lambda tank_of: F.flatten(F.transform(some, lambda x: at(x["w"], x["i"], tank_of))))


_EVENTS = "array<struct<t:int,type:string,name:string,tank:int,oxygen:double,helium:double,value:double>>"


def _gear(o: Column) -> list[Column]:
    return [x["equipmentused"] for x in (o["informationbeforedive"], o, o["informationafterdive"])]


def references(dives: DataFrame) -> DataFrame:
    """Dives (``o``, a struct of DIVE) with the ids that they name: ``_links`` before the dive, and those of the equipment used in ``_used``."""
    o = F.col("o")
    refs = lambda links: F.transform(listed(links, _REF), lambda x: x["_ref"])
    return dives.withColumns({"_links": refs(o["informationbeforedive"]["link"]), "_used": F.flatten(F.array(*[refs(g["link"]) for g in _gear(o)]))})


def looked_up(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows of :func:`references` with their files' maps (see MAPS), which may be large: what a dive names of them is taken out, and only mixes and buddies go on.

    No function with a lambda is used here, as those would look through a map entry by entry without generated code.
    """
    C = F.col  # noqa: N806
    # of the two arrays, the second becomes a set: that is to be the short one
    near = lambda m, of: F.array_intersect(F.map_keys(m), of)
    first = lambda m, of: get(C(m), F.try_element_at(F.array_intersect(of, near(m, of)), F.lit(1)))
    found = {"_site": first("sites", F.reverse("_links")), "_computer": first("computers", C("_used")), "_suit": first("suits", C("_used")), "_model": first("models", C("_links"))}
    return rows.select(*keep, "_links", "buddies", near("buddies", C("_links")).alias("_near"), F.map_contains_key("computers", F.lit(CELL_COMPUTER)).alias("_inspiration"), *[c.alias(n) for n, c in found.items()])


def records(rows: DataFrame, *keep: str) -> DataFrame:
    """Records of rows of :func:`looked_up` with ``o``, a struct of DIVE, and what its file holds: ``mixes``, ``mixes_order``, ``sensors`` (ids in order), ``program`` and ``any_tanks``."""
    o = F.col("o")
    before, after = o["informationbeforedive"], o["informationafterdive"]
    foreign = F.startswith(F.lower(F.coalesce(F.col("program"), F.lit(""))), F.lit(BAR_PROGRAM))
    three = (F.coalesce(F.col("program"), F.lit("")) == CELL_PROGRAM) | F.col("_inspiration")
    waypoints = F.filter(listed(o["samples"]["waypoint"], _WAYPOINT), lambda w: number(w["depth"]).isNotNull())
    from_mixes = (F.size("mixes_order") > 0) & ~F.col("any_tanks") & (F.coalesce(F.col("program"), F.lit("")) != OWN_PROGRAM)
    rows = rows.withColumn("_w", waypoints).withColumn("_modes", modes_so_far(F.col("_w")))
    rows = rows.withColumn("_slots", tank_slots(o, F.col("mixes"), F.when(foreign, F.lit(STATUS_BAR))))
    rows = rows.withColumns({f"_{n}": F.col("_slots")[n] for n in ("tanks", "refs", "tank_mixes")})
    rows = rows.withColumn("_mixed", F.when(from_mixes, tanks_of_mixes(F.col("_w"), F.col("_modes"), F.col("mixes"), F.col("mixes_order"))))
    tanks = F.when(from_mixes, F.transform("_mixed", lambda x: x["tank"])).otherwise(F.col("_tanks"))
    mix_of = F.when(from_mixes, F.transform("_mixed", lambda x: x["mix"])).otherwise(F.col("_tank_mixes"))
    rows = rows.withColumn("_all", tanks).withColumn("_mix_of", mix_of)
    air = F.struct(F.lit(21.0).alias("oxygen"), F.lit(0.0).alias("helium"))
    kinds = F.array_distinct(F.transform("_mix_of", lambda k: F.coalesce(get(F.col("mixes"), k), air)))
    # which tank a switch means: the first with the mix; where tanks were made of mixes, on open circuit the bailout one
    outs = F.transform("_mixed", lambda x, i: F.struct(F.concat(x["mix"], F.lit("|"), x["out"].cast("string")).alias("k"), i.alias("v")))
    both = F.flatten(F.transform("_mixed", lambda x, i: F.when(x["out"], F.array().cast("array<struct<k:string,v:int>>")).otherwise(F.array(*[F.struct(F.concat(x["mix"], F.lit(f"|{b}")).alias("k"), i.alias("v")) for b in ("true", "false")]))))
    plain = F.flatten(F.transform(F.reverse(F.transform("_mix_of", lambda k, i: F.struct(k.alias("k"), i.alias("v")))), lambda x: F.array(*[F.struct(F.concat(x["k"], F.lit(f"|{b}")).alias("k"), x["v"].alias("v")) for b in ("true", "false")])))
    tank_of = F.when(from_mixes, by_key(F.concat(both, outs), "string", "int")).otherwise(by_key(plain, "string", "int"))
    rows = rows.withColumn("_tank_of", tank_of)
    skipped = F.when(three, F.slice("sensors", F.lit(CELLS + 1), F.greatest(F.size("sensors"), F.lit(1)))).otherwise(array_of("string"))
    samples = waypoint_samples(F.col("_w"), F.col("_refs"), F.size("_all"), F.col("sensors"), skipped, foreign)
    circuit = F.when(F.size(kinds) <= 1, "oc_single_gas").otherwise("oc_multi_gas")
    events = waypoint_events(F.col("_w"), F.col("_modes"), F.col("mixes"), F.col("_tank_of"), circuit)
    rows = rows.withColumn("_samples", samples).withColumn("_events", events)
    friends = F.filter(F.transform(F.filter("_links", lambda r: F.array_contains("_near", r)), lambda r: get(F.col("buddies"), r)), lambda n: F.coalesce(n, F.lit("")) != "")
    last_site, computer, model, suit = F.col("_site"), F.col("_computer"), F.col("_model"), F.col("_suit")
    gear = _gear(o)
    weight = reduce(lambda a, b: F.coalesce(a, b), [number(g["leadquantity"]) for g in gear])
    last = F.try_element_at(F.col("_samples"), F.lit(-1))["t"]
    exit_ = o["applicationdata"]["tallyweave"]["exitposition"]
    exits = number(exit_["latitude"]).isNotNull() & number(exit_["longitude"]).isNotNull()
    mode = F.try_element_at(F.col("_modes"), F.lit(1))["v"]
    local = parsed(before["datetime"])
    seen = number(after["visibility"])
    values = {
        "local": local,
        "utc": utc_of(before["datetime"]),
        "duration": F.coalesce(rounded(after["diveduration"]), last, F.lit(0)),
        "max_depth": F.coalesce(number(after["greatestdepth"]), F.array_max(F.transform("_samples", lambda s: s["depth"])), F.lit(0.0)),
        "avg_depth": number(after["averagedepth"]),
        "temp_min": known_temperature(celsius(after["lowesttemperature"])),
        "external_ids": ids(uddf=F.coalesce(F.nullif(o["_id"], F.lit("")), F.concat(F.lit("uddf-"), F.date_format(local, "yyyyMMdd'T'HHmmss")))),
        "tanks": F.col("_all"),
        "location": F.nullif(last_site["name"], F.lit("")),
        "lat": last_site["lat"],
        "lng": last_site["lng"],
        "notes": F.nullif(F.array_join(F.filter(F.transform(listed(after["notes"]["para"], "string"), text), lambda p: p.isNotNull()), "\n"), F.lit("")),
        "number": F.when(F.regexp_like(before["divenumber"], F.lit("^[0-9]+$")), before["divenumber"].try_cast("int")),
        "weight": weight,
        "weight_unit": F.when(weight.isNotNull(), "kilogram"),
        "visibility": seen,
        "visibility_unit": F.when(seen.isNotNull(), "meter"),
        "buddy": F.nullif(F.array_join(friends, ", "), F.lit("")),
        "samples": F.col("_samples"),
        "events": F.col("_events"),
        "service_fields": ids(rating=whole(after["rating"]["ratingvalue"])),
        **{f"computer_{n}": computer[n] for n in ("vendor", "model", "serial", "firmware")},
        "gf_low": model["low"],
        "gf_high": model["high"],
        "deco_model": model["model"],
        "dive_mode": F.coalesce(*[F.when(mode == k, v) for k, v in MODES.items()], F.when(mode == "opencircuit", circuit), mode),
        "surface_interval": rounded(before["surfaceintervalbeforedive"]["passedtime"]),
        "air_temp": celsius(before["airtemperature"]),
        "suit": suit,
        "exit_lat": F.when(exits, number(exit_["latitude"])),
        "exit_lng": F.when(exits, number(exit_["longitude"])),
    }
    return record(rows.where(local.isNotNull()), values, *keep)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the UDDF files below a path, with ``file``."""
    dives = entities(spark, path, "dive", DIVE).withColumnRenamed("e", "o")
    C = F.col  # noqa: N806
    name = lambda p: F.coalesce(F.nullif(F.concat_ws(" ", text(p["firstname"]), text(p["lastname"])), F.lit("")), text(p["nickname"]), F.lit(""))
    share = lambda c, d: F.coalesce(F.nullif(number(c), F.lit(0.0)), F.lit(d)) * 100
    firm = lambda e: F.try_element_at(F.filter(F.transform(listed(e["notes"]["para"], "string"), text), lambda p: F.startswith(p, F.lit(FIRMWARE))), F.lit(1))
    letter = lambda e: F.nullif(F.upper(F.regexp_extract(e["_id"], r"(?i)zhl[-_]?16([a-c])", 1)), F.lit(""))
    kinds = {
        "site": (SITE, "sites", lambda e: F.struct(F.coalesce(text(e["name"]), F.lit("")).alias("name"), number(e["geography"]["latitude"]).alias("lat"), number(e["geography"]["longitude"]).alias("lng"))),
        "buddy": (BUDDY, "buddies", lambda e: name(e["personal"])),
        "mix": (MIX, "mixes", lambda e: F.struct(share(e["o2"], 0.21).alias("oxygen"), share(e["he"], 0.0).alias("helium"))),
        "divecomputer": (COMPUTER, "computers", lambda e: F.struct(text(e["manufacturer"]["name"]).alias("vendor"), F.coalesce(text(e["model"]), text(e["name"])).alias("model"), text(e["serialnumber"]).alias("serial"), F.substr(firm(e), F.lit(len(FIRMWARE) + 1)).alias("firmware"))),
        "suit": (SUIT, "suits", lambda e: text(e["name"])),
        "buehlmann": (MODEL, "models", lambda e: F.struct(F.concat(F.lit("ZHL-16"), letter(e)).alias("model"), rounded(e["gradientfactorlow"]).alias("low"), rounded(e["gradientfactorhigh"]).alias("high"))),
        "o2sensor": (SENSOR, "cells", lambda e: F.lit(True)),
        "generator": (GENERATOR, "program", lambda e: text(e["name"])),
    }
    tanked = lambda: dives.where(F.size(listed(C("o")["tankdata"], _TANKDATA)) > 0).select("file", "at", F.lit("tankdata").alias("tag"), F.lit(None).cast("string").alias("id"), F.lit("").alias("xml"))
    seen = every_entity(spark, path, {tag: schema for tag, (schema, _, _) in kinds.items()}, {("dive", "tankdata")}, tanked)
    # of a file's program the first counts, of the others the first of an id
    alone = C("tag").isin("generator", "tankdata")
    seen = seen.withColumn("id", F.when(~alone, C("id")).otherwise("")).where(alone | (C("id") != ""))
    first = seen.groupBy("file", "tag", "id").agg(F.min_by("xml", "at").alias("xml"), F.min("at").alias("at"))
    first = first.withColumns({f"_{tag}": F.when(C("tag") == tag, F.from_xml("xml", schema)) for tag, (schema, _, _) in kinds.items()})
    listed_by = [F.sort_array(F.collect_list(F.when(C("tag") == tag, F.struct("at", "id", value(C(f"_{tag}")).alias("v"))))).alias(to) for tag, (_, to, value) in kinds.items()]
    tables = first.groupBy("file").agg(*listed_by, F.bool_or(C("tag") == "tankdata").alias("any_tanks"))
    of = lambda to: F.map_from_entries(F.transform(to, lambda x: F.struct(x["id"], x["v"])))
    keys = lambda to: F.transform(to, lambda x: x["id"])
    tables = tables.select("file", *[of(n).alias(n) for n in MAPS], keys("mixes").alias("mixes_order"), keys("cells").alias("sensors"), F.get("program", F.lit(0))["v"].alias("program"), "any_tanks")
    # written, so that its size is known when it meets the dives
    rows = references(dives).join(written(tables, "uddf-tables"), "file", "left")
    rows = rows.withColumns({"mixes_order": listed(C("mixes_order"), "string"), "sensors": listed(C("sensors"), "string"), "any_tanks": F.coalesce("any_tanks", F.lit(False))})
    return records(looked_up(rows, "file", "o", "mixes", "mixes_order", "sensors", "program", "any_tanks"), "file")
