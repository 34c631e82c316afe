"""Records as UDDF files that :mod:`tallyweave.sources.uddf` reads back.

Sites, buddies, mixes, computers, suits, models and oxygen sensors stand once in a file and dives refer to them. Their ids
are made from what they say, so a dive knows its references without a look at the others, and a file that is written again
has the same ones. Dives and entities are rendered by Spark's own XML functions; the rows of a file, sorted by section,
then run through one task, which holds one at a time. A name with many dives gets several files.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.paths import bound
from tallyweave.functions.text import slug
from tallyweave.session import written
from tallyweave.sinks.files import OUTCOMES, put_pieces
from tallyweave.sources.contract import opened
from tallyweave.sources.uddf import FIRMWARE, OWN_PROGRAM
from tallyweave.sources.xmls import listed

#: Dives of a file, about.
DIVES = 5_000
# The format's words for modes, and what stands around the elements of each section.
MODES = {"ccr": "closedcircuit", "scr": "semiclosedcircuit", "apnea": "apnoe", "oc_single_gas": "opencircuit", "oc_multi_gas": "opencircuit"}
FRAME = [
    (f'<?xml version="1.0" encoding="UTF-8"?>\n<uddf xmlns="http://www.streit.cc/uddf/3.2/" version="3.2.0">\n<generator><name>{OWN_PROGRAM}</name><type>logbook</type></generator>\n<diver><owner id="owner"><equipment>\n', ""),
    ('<rebreather id="rebreather"><name>Rebreather</name>\n', "</rebreather>\n"),
    ("", ""),
    ("</equipment></owner>\n", "</diver>\n"),
    ("<divesite>\n", "</divesite>\n"),
    ("<gasdefinitions>\n", "</gasdefinitions>\n"),
    ("<decomodel>\n", "</decomodel>\n"),
    ('<profiledata><repetitiongroup id="rg-1">\n', "</repetitiongroup></profiledata>\n</uddf>\n"),
]
COMPUTER, SENSOR, SUIT, BUDDY, SITE, MIX, MODEL, DIVE = range(8)
#: What a record says and this format has no place for (see :func:`tallyweave.sinks.files.dropped`).
KEPT = (
    "local", "utc", "duration", "max_depth", "avg_depth", "temp_min", "external_ids", "tanks", "location", "notes", "number", "weight", "weight_unit", "visibility", "visibility_unit", "buddy", "lat", "lng", "samples",
    "events", "computer_vendor", "computer_model", "computer_serial", "computer_firmware", "gf_low", "gf_high", "deco_model", "dive_mode", "exit_lat", "exit_lng", "surface_interval", "air_temp", "suit",
)


def _plain(c: Column, digits: int) -> Column:
    """A number without an exponent or needless zeros; null for what isn't one."""
    rounded = F.round(c.cast("double"), digits) + 0.0
    return bound(rounded, lambda x: F.when(F.abs(x) < 10.0 ** (30 - digits), F.call_function("format_number", x, F.lit("0." + "#" * digits))))


def _kelvin(c: Column) -> Column:
    return _plain(c + 273.15, 4)


def _pascal(c: Column) -> Column:
    return _plain(c * 100_000, 3)


def _words(c: Column) -> Column:
    """Text without characters that XML can't hold; blank is null."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    return F.when(F.trim(clean) != "", clean)


def _said(name: str, *parts: Column) -> Column:
    """An id made of what an entity says: a readable start, and a digest that tells null from empty."""
    digest = F.substring(F.sha1(F.to_json(F.array(*[p.cast("string") for p in parts]))), 1, 12)
    readable = F.substring(slug(F.concat_ws(" ", *[p.cast("string") for p in parts])), 1, 24)
    return F.concat(F.lit(f"{name}-"), readable, F.lit("-"), digest)


def _struct(**fields: Column | None) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items() if v is not None])


def _none_if(c: Column, *parts: Column) -> Column:
    """The column where any of the parts is known."""
    return F.when(F.coalesce(*[p.cast("string") for p in parts]).isNotNull(), c)


def _mix(oxygen: Column, helium: Column) -> tuple[Column, Column, Column]:
    o2, he = F.round(F.coalesce(F.nullif(oxygen, F.lit(0.0)), F.lit(21.0)), 1), F.round(F.coalesce(helium, F.lit(0.0)), 1)
    return F.concat(F.lit("mix-"), _plain(o2, 1), F.lit("-"), _plain(he, 1)), o2, he


def _refs(ids: Column) -> Column:
    return F.transform(ids, lambda r: F.struct(r.alias("_ref")))


def _waypoints(tank_ids: Column) -> Column:
    """The samples as waypoints, each with the events from its time on to the next one's; those before the first are its own."""
    samples, events, mixes = F.col("samples"), F.col("_events"), F.col("_tank_mixes")
    modes = F.create_map(*[F.lit(x) for p in MODES.items() for x in p])

    def one(s: Column, i: Column) -> Column:
        return bound(F.filter(events, lambda e: e["at"] == i), lambda here: point(s, i, here))

    def point(s: Column, i: Column, here: Column) -> Column:
        ch = s["channels"]
        of = lambda kind: F.filter(here, lambda e: e["e"]["type"] == kind)
        named = lambda kind, word: F.transform(of(kind), lambda e: F.coalesce(_words(e["e"]["name"]), F.lit(word)))
        changed = F.filter(F.transform(of("mode_change"), lambda e: F.try_element_at(modes, e["e"]["name"])), lambda m: m.isNotNull())
        mode = F.coalesce(F.try_element_at(changed, F.lit(-1)), F.when(i == 0, F.try_element_at(modes, F.col("dive_mode"))))
        setpoints = F.filter(F.transform(of("setpoint_change"), lambda e: e["e"]["value"]), lambda v: v.isNotNull())
        switch = F.transform(of("gas_switch"), lambda e: F.coalesce(F.get(mixes, e["e"]["tank"]), F.when(e["e"]["oxygen"].isNotNull(), _mix(e["e"]["oxygen"], e["e"]["helium"])[0])))
        readings = F.when(ch.isNotNull(), F.array_sort(F.map_entries(ch["pressures"]))).when(s["pressure"].isNotNull(), F.array(F.struct(F.lit(0).alias("key"), s["pressure"].alias("value"))))
        pressures = F.filter(F.transform(readings, lambda p: F.struct(F.get(tank_ids, p["key"]).alias("_ref"), _pascal(p["value"]).alias("_VALUE"))), lambda p: p["_ref"].isNotNull())
        cells = F.transform(F.filter(F.array_sort(F.map_entries(ch["o2_cells"])), lambda p: p["key"] >= 0), lambda p: F.struct(F.concat(F.lit("o2sensor-"), (p["key"] + 1).cast("string")).alias("_ref"), _pascal(p["value"]).alias("_VALUE")))
        stop = F.when(ch["stop_depth"] > 0, _struct(_kind=F.lit("mandatory"), _decodepth=_plain(ch["stop_depth"], 3), _duration=ch["stop_time"].cast("string")))
        return _struct(
            depth=_plain(s["depth"], 3), divetime=s["t"].cast("string"), temperature=_kelvin(s["temp"]), alarm=named("alert", "alert"), calculatedpo2=_pascal(ch["ppo2"]), cns=_plain(ch["cns"], 2), decostop=stop, divemode=F.when(mode.isNotNull(), F.struct(mode.alias("_type"))),
            gradientfactor=_plain(ch["gf99"], 2), heartbeat=ch["heart_rate"].cast("string"), measuredpo2=cells, nodecotime=ch["ndl"].cast("string"), remainingbottomtime=ch["gas_time"].cast("string"), setmarker=named("bookmark", "bookmark"),
            setpo2=_pascal(F.coalesce(F.try_element_at(setpoints, F.lit(-1)), ch["setpoint"])), switchmix=_refs(F.filter(switch, lambda m: m.isNotNull())), tankpressure=pressures,
        )

    return F.transform(samples, one)


def _parts() -> dict[str, Column]:
    """What tells a record's entities from others, as arrays of text, null without one: ``site``, ``buddies`` (an array of them), ``computer``, ``suit``, ``deco``, ``mixes`` (an array) and ``cells``, their number."""
    C = F.col  # noqa: N806
    place, lat, lng, suit = _words(C("location")), C("lat"), C("lng"), _words(C("suit"))
    at = lat.isNotNull() & lng.isNotNull()
    texts = lambda *parts: F.array(*[p.cast("string") for p in parts])
    friends = F.filter(F.transform(F.split(F.coalesce(_words(C("buddy")), F.lit("")), ","), lambda b: F.trim(b)), lambda b: b != "")
    vendor, model, serial, firm = (_words(C(f"computer_{c}")) for c in ("vendor", "model", "serial", "firmware"))
    mix = lambda x: texts(*_mix(x["oxygen"], x["helium"]))
    top = F.array_max(F.flatten(F.transform("samples", lambda s: F.coalesce(F.map_keys(s["channels"]["o2_cells"]), F.array().cast("array<int>")))))
    return {
        "site": _none_if(texts(place, F.when(at, lat), F.when(at, lng)), place, F.when(at, lat)),
        "buddies": F.transform(friends, lambda b: F.array(b)),
        "computer": _none_if(texts(vendor, model, serial, firm), model, serial),
        "suit": F.when(suit.isNotNull(), F.array(suit)),
        "deco": _none_if(texts(C("deco_model"), C("gf_low"), C("gf_high")), C("gf_low"), C("gf_high")),
        "mixes": F.array_distinct(F.concat(listed(F.transform("tanks", mix), "array<string>"), listed(F.transform(F.filter("events", lambda e: (e["type"] == "gas_switch") & e["oxygen"].isNotNull()), mix), "array<string>"))),
        "cells": F.when(top >= 0, top + 1).otherwise(0),
    }


def _id_of(section: int, p: Column) -> Column:
    """The id of an entity by what tells it from others; null for null."""
    if section == SENSOR:
        made = F.concat(F.lit("o2sensor-"), p[0])
    elif section == MIX:
        made = p[0]
    elif section == MODEL:
        made = F.concat_ws("-", F.lit("buehlmann"), F.nullif(slug(F.coalesce(p[0], F.lit(""))), F.lit("")), F.concat(F.lit("gf"), F.coalesce(p[1], F.lit("x"))), F.coalesce(p[2], F.lit("x")))
    else:
        name, n = {COMPUTER: ("dc", 4), SUIT: ("suit", 1), BUDDY: ("buddy", 1), SITE: ("site", 3)}[section]
        made = _said(name, *[p[i] for i in range(n)])
    return F.when(p.isNotNull(), made)


def _entities(rows: DataFrame) -> DataFrame:
    """(_file, section, key, xml) of all entities, once a file: one pass tells them by their parts, and only different ones are rendered."""
    C, p = F.col, F.col("parts")  # noqa: N806
    told = lambda section, parts: F.transform(parts, lambda x: F.struct(F.lit(section).alias("section"), x.alias("parts")))
    one = lambda section, c: F.struct(F.lit(section).alias("section"), C(c).alias("parts"))
    cells = F.when(C("_cells") > 0, F.array(C("_cells").cast("string")))
    single = F.array(one(COMPUTER, "_computer"), one(SUIT, "_suit"), one(SITE, "_site"), one(MODEL, "_deco"), F.struct(F.lit(SENSOR).alias("section"), cells.alias("parts")))
    every = F.concat(single, told(BUDDY, C("_buddies")), told(MIX, C("_mixes")))
    known = rows.select("_file", F.inline(every)).where("parts is not null").distinct()
    # written, so that neither the sensors nor the rest look at the records again
    known = written(known, "uddf-known")
    # a file has as many sensors as the record with most cells
    count = known.where(C("section") == SENSOR).groupBy("_file").agg(F.max(p[0].cast("int")).alias("n"))
    sensors = count.select("_file", F.lit(SENSOR).alias("section"), F.explode(F.transform(F.sequence(F.lit(1), C("n")), lambda n: F.array(n.cast("string")))).alias("parts"))
    number = lambda c: c.cast("double")
    shapes = {
        COMPUTER: ("divecomputer", {"name": F.coalesce(F.nullif(F.concat_ws(" ", p[0], p[1]), F.lit("")), p[2]), "manufacturer": F.when(p[0].isNotNull(), _struct(_id=_said("man", p[0]), name=p[0])), "model": p[1], "serialnumber": p[2], "notes": F.when(p[3].isNotNull(), F.struct(F.concat(F.lit(FIRMWARE), p[3]).alias("para")))}),
        SENSOR: ("o2sensor", {"name": F.concat(F.lit("Cell "), p[0])}),
        SUIT: ("suit", {"name": p[0]}),
        BUDDY: ("buddy", {"personal": F.struct(p[0].alias("firstname"))}),
        SITE: ("site", {"name": F.coalesce(p[0], F.concat_ws(", ", _plain(number(p[1]), 6), _plain(number(p[2]), 6))), "geography": F.when(p[1].isNotNull(), _struct(latitude=p[1], longitude=p[2]))}),
        MIX: ("mix", {"name": p[0], "o2": _plain(number(p[1]) / 100, 4), "he": _plain(number(p[2]) / 100, 4)}),
        MODEL: ("buehlmann", {"gradientfactorhigh": p[2], "gradientfactorlow": p[1]}),
    }
    xml = F.coalesce(*[F.when(C("section") == s, F.to_xml(_struct(_id=_id_of(s, p), **fields), {"rowTag": tag})) for s, (tag, fields) in shapes.items()])
    key = F.coalesce(*[F.when(C("section") == s, _id_of(s, p)) for s in shapes])
    return known.where(C("section") != SENSOR).unionByName(sensors).select("_file", "section", key.alias("key"), xml.alias("xml"))


def rendered(records: DataFrame, name: Column, dives: int = DIVES) -> DataFrame:
    """(file, section, key, xml): the fragments of all files. Records without a start are left out, as the format can't hold them."""
    source = F.try_element_at(F.array_sort(F.filter(F.map_entries("external_ids"), lambda e: (e["key"] != "uddf") & (F.trim(e["value"]) != ""))), F.lit(1))
    own = F.coalesce(F.try_element_at("external_ids", F.lit("uddf")), F.concat(F.lit(f"{OWN_PROGRAM}-"), source["key"], F.lit("-"), source["value"]), F.concat(F.lit(f"{OWN_PROGRAM}-"), F.date_format("local", "yyyyMMdd'T'HHmmss")))
    rows = records.where(F.col("local").isNotNull()).withColumn("_name", F.coalesce(_words(name.cast("string")), F.lit("dives"))).withColumn("_own", _words(own))
    # only names with several files are told, a row for each `dives` dives at most
    many = written(rows.groupBy("_name").agg(F.count("*").alias("_size")).where(F.col("_size") > dives).select("_name", F.ceil(F.col("_size") / dives).alias("_files")), "uddf-sizes")
    rows = rows.join(F.broadcast(many), "_name", "left")
    # which of its name's files a dive goes to follows from the dive alone
    part = F.pmod(F.xxhash64("_own", "local", "duration", "max_depth", "number", "location", "notes"), F.col("_files"))
    rows = rows.withColumn("_file", F.when(F.col("_files") > 1, F.concat("_name", F.lit("-"), (part + 1).cast("string"))).otherwise(F.col("_name")))
    C = F.col  # noqa: N806
    rows = rows.withColumns({f"_{n}": c for n, c in _parts().items()})
    entities = _entities(rows)
    # ids that several dives of a name share, which are few, are numbered within their files
    shared = written(rows.groupBy("_name", "_own").agg(F.count("*").alias("_times")).where("_times > 1").drop("_times"), "uddf-shared")
    if shared.isEmpty():
        rows = rows.withColumn("_id", C("_own"))
    else:
        rows = rows.join(shared.withColumn("_shared", F.lit(True)), ["_name", "_own"], "left")
        one = rows.where("_shared is null").withColumn("_id", C("_own"))
        n = F.row_number().over(Window.partitionBy("_file", "_own").orderBy(F.sha1(F.to_json(F.struct(*records.columns)))))
        several = rows.where("_shared").withColumn("_n", n).withColumn("_id", F.when(C("_n") > 1, F.concat("_own", F.lit("-"), C("_n").cast("string"))).otherwise(C("_own"))).drop("_n")
        rows = one.unionByName(several)
    rows = rows.withColumn("_tank_mixes", F.transform("tanks", lambda t: _mix(t["oxygen"], t["helium"])[0])).withColumn("_tank_ids", F.transform("tanks", lambda t, i: F.concat("_id", F.lit("-tank"), i.cast("string"))))
    where = lambda e: F.greatest(F.size(F.filter("samples", lambda s: s["t"] <= e["t"])) - 1, F.lit(0))
    rows = rows.withColumn("_events", F.transform("events", lambda e: F.struct(where(e).alias("at"), e.alias("e"))))
    some = lambda c: F.filter(c, lambda x: x.isNotNull())
    rows = rows.withColumn("_used", some(F.array(_id_of(COMPUTER, C("_computer")), F.when(C("_cells") > 0, F.lit("rebreather")), _id_of(SUIT, C("_suit")))))
    used = C("_used")
    kilograms = F.when(F.lower("weight_unit").startswith("p") | F.lower("weight_unit").startswith("l"), C("weight") * 0.45359237).otherwise(C("weight"))
    metres = F.when(F.lower("visibility_unit").startswith("f"), C("visibility") / 3.28084).otherwise(C("visibility"))
    before = _struct(
        link=_refs(some(F.concat(F.array(_id_of(SITE, C("_site"))), F.transform("_buddies", lambda b: _id_of(BUDDY, b)), F.array(_id_of(MODEL, C("_deco")))))), divenumber=C("number").cast("string"), datetime=F.concat(F.date_format("local", "yyyy-MM-dd'T'HH:mm:ss"), _zone()), airtemperature=_kelvin(C("air_temp")),
        surfaceintervalbeforedive=F.when(C("surface_interval").isNotNull(), F.struct(C("surface_interval").cast("string").alias("passedtime"))), equipmentused=F.when((F.size(used) > 0) | C("weight").isNotNull(), _struct(link=_refs(used), leadquantity=_plain(kilograms, 3))),
    )
    exit_ = _struct(exitposition=_struct(latitude=_plain(C("exit_lat"), 6), longitude=_plain(C("exit_lng"), 6)))
    tanks = F.transform("tanks", lambda t, i: _struct(_id=F.get("_tank_ids", i), link=F.array(F.struct(F.get("_tank_mixes", i).alias("_ref"))), tankvolume=_plain(t["volume"] / 1000, 6), tankpressurebegin=_pascal(t["start"]), tankpressureend=_pascal(t["end"])))
    rating = F.try_element_at("service_fields", F.lit("rating")).try_cast("int")
    after = _struct(
        greatestdepth=_plain(C("max_depth"), 3), averagedepth=_plain(C("avg_depth"), 3), diveduration=C("duration").cast("string"), lowesttemperature=_kelvin(C("temp_min")), visibility=_plain(metres, 2), rating=F.when(rating.isNotNull(), F.struct(rating.cast("string").alias("ratingvalue"))),
        notes=F.when(_words(C("notes")).isNotNull(), F.struct(F.split(_words(C("notes")), "\n").alias("para"))),
    )
    dive = _struct(_id=C("_id"), informationbeforedive=before, applicationdata=F.when(C("exit_lat").isNotNull() & C("exit_lng").isNotNull(), F.struct(exit_.alias("tallyweave"))), tankdata=tanks, samples=F.when(F.size("samples") > 0, F.struct(_waypoints(C("_tank_ids")).alias("waypoint"))), informationafterdive=after)
    out = rows.select("_file", F.lit(DIVE).alias("section"), F.concat(F.date_format("local", "yyyyMMddHHmmss"), F.coalesce("_id", F.lit(""))).alias("key"), F.to_xml(dive, {"rowTag": "dive"}).alias("xml"))
    return out.unionByName(entities).withColumnRenamed("_file", "file")


def _zone() -> Column:
    """``+02:00`` where the record knows UTC and it differs from the local clock."""
    minutes = ((F.unix_timestamp(F.col("local").cast("timestamp")) - F.unix_timestamp(F.col("utc").cast("timestamp"))) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    text = F.concat(sign, F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.when((minutes != 0) & (F.abs(minutes) <= 14 * 60), text).otherwise("")


def document(fragments: Iterator[tuple[int, str]]) -> Iterator[str]:
    """The text of a file from (section, xml) in the order of sections. All sections stand but the sensors', which a file without any lacks."""
    now, begun = COMPUTER, True
    yield FRAME[COMPUTER][0]
    for section, xml in itertools.chain(fragments, [(len(FRAME), "")]):
        while now < section:
            yield FRAME[now][1] if begun else ""
            now += 1
            if now < len(FRAME):
                begun = now == section or now != SENSOR
                yield FRAME[now][0] if begun else ""
        yield f"{xml}\n" if xml else ""


def put_files(rows: Iterator[tuple[str, int, str]], store: fs.FileSystem, root: str) -> Iterator[tuple[str, int | None, str | None]]:
    """Write the files of (file, section, xml), sorted, and tell the outcome of each. A fault of the rows themselves is none of a file's: it is raised."""
    fault: Exception | None = None
    held: tuple[str, int, str] | None = None

    def step() -> None:
        nonlocal fault, held
        try:
            held = next(rows, None)
        except Exception as e:
            fault = e
            raise

    def own(file: str) -> Iterator[tuple[int, str]]:
        while held is not None and held[0] == file:
            yield held[1:]
            step()

    step()
    while held is not None:
        file, size, problem = held[0], None, None
        pieces = own(file)
        try:
            size = put_pieces(store, root, f"{file}.uddf", (p.encode() for p in document(pieces)))
        except Exception as e:
            if fault is not None:
                raise
            problem = f"{type(e).__name__}: {e}".split("\n")[0]
            # what the file would have held is passed over
            while held is not None and held[0] == file:
                step()
        yield f"{file}.uddf", size, problem


def write(records: DataFrame, folder: str, name: Column, dives: int = DIVES) -> DataFrame:
    """Write ``<name>.uddf``, or ``<name>-<n>.uddf`` where a name has more than ``dives`` dives, and return OUTCOMES, a row a file.

    A null or blank name is ``dives``. Records are those of :mod:`tallyweave.schema`; what the format can't hold is lost
    (KEPT). Dives whose ids are equal in a file get ``-2`` and so on. Without records there are no files. A task that is
    tried again writes the same files. A file that can't be written is a row with its problem: who needs all files asks
    :func:`tallyweave.sinks.files.whole`. A fault in making the records fails the job.
    """
    fragments = rendered(records, name, dives).repartition("file").sortWithinPartitions("file", "section", "key", "xml")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder.rstrip("/"))
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 1, 2)), strict=True))
        for outcome in put_files(rows, store, root):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(outcome, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["name", "bytes", "problem"])

    return written(fragments.select("file", "section", "xml").mapInArrow(work, OUTCOMES), "uddf-outcomes")
