"""Dives of online services as records, from their JSON: each a function of a column with the parsed object.

``garmin``, ``divelogs`` and ``ssi`` take rows with an object (see the schemas) and give records; :func:`read` takes
folders of JSON files. Null objects, and starts that can't be read, give a record with a null start. Ties and
repeated rows stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import paths
from tallyweave.functions.compare import first_truthy
from tallyweave.functions.text import is_true, number_and_unit, reference_ids
from tallyweave.functions.times import parsed
from tallyweave.functions.units import LB_KG, SERVICE_CUFT_L, SERVICE_FT_M, SERVICE_PSI_BAR
from tallyweave.schema import TANK, array_of, channels, ids, known_temperature, number, record, rounded, sample, tank, text, whole

# How the services spell what they give. Scalars are read as text, as types differ from file to file.
_SUM = "struct<startTimeLocal:string,startTimeGMT:string,duration:string,maxDepth:string,averageDepth:string,minTemperature:string,maxTemperature:string,averageTemperature:string,startLatitude:string,startLongitude:string,endLatitude:string,endLongitude:string>"
_META = "struct<diveNumber:string,manualActivity:boolean>"
_ZONE = "struct<unitKey:string,timeZone:string>"
_GAS = "struct<gasIndex:int,oxygenContent:string,heliumContent:string,tankStartingPressure:string,tankEndingPressure:string,tankSize:string>"
_INFO = f"struct<buddy:string,weight:string,weightUnit:struct<unitKey:string>,visibility:string,visibilityUnit:struct<unitKey:string>,diveGases:array<{_GAS}>>"
_TOP = "activityId:string,activityName:string,locationName:string,startTimeLocal:string,startTimeGMT:string,duration:string,maxDepth:string,averageDepth:string,startLatitude:string,startLongitude:string,endLatitude:string,endLongitude:string,description:string"
_ACTIVITY = f"struct<{_TOP},summaryDTO:{_SUM},metadataDTO:{_META},timeZoneUnitDTO:{_ZONE},diveInfo:{_INFO}>"
GARMIN = (
    f"summary {_ACTIVITY}, details {_ACTIVITY}, "
    "activityDetails struct<metricDescriptors:array<struct<metricsIndex:int,key:string>>,activityDetailMetrics:array<struct<metrics:array<double>>>>, "
    "tanksensor struct<tankSensors:array<struct<tankIndex:int,name:string,startingPressure:string,endingPressure:string,pressureUnit:string>>>, incomplete array<string>"
)
DIVELOGS = (
    "id string, divenumber string, date string, time string, duration string, maxdepth string, meandepth string, depthtemp string, airtemp string, location string, "
    "divesite string, notes string, buddy string, weights string, visibility string, lat string, lng string, samplerate string, sampledata array<string>, "
    "tanks array<struct<o2:string,he:string,start_pressure:string,end_pressure:string,vol:string,tankname:string,tank:string>>"
)
_LOG = "odin_user_log_"
_SSI_FIELDS = (
    "id nr date entry_time datetime divetime depth_m avg_depth_m watertemp_c watertemp_max_c airtemp_c divecomputer_dive_ref dive_sites_id deleted tank_vol_l pressure_start_bar "
    "pressure_end_bar ean ean_percent comment weight_kg vis_m pos_start_latitude pos_start_longitude divecomputer_imported divecomputer_manufacturer divecomputer_name "
    "divecomputer_serial_nr divecomputer_firmware gf_set_1 gf_set_2 si_before var_watertype_id diveSamples"
).split()
SSI = ", ".join(f"{_LOG}{n} string" for n in _SSI_FIELDS)
SSI_SITE = "odin_dive_sites_id string, odin_dive_sites_name string, odin_dive_sites_latitude string, odin_dive_sites_longitude string"
_SSI_POINT = "array<struct<d:string,t:string,te:string,pressure:string,ndl:string>>"
SSI_WATER = {"5": "salt", "4": "fresh"}
SSI_NDL_MOST = 99
REFERENCES = ["garmin", "divelogs", "subsurface", "shearwater", "uddf"]
WEIGHT_UNITS = {"kilogram": ["kg", "kilogram"], "pound": ["lb", "pound"]}
LENGTH_UNITS = {"meter": ["m", "meter"], "foot": ["ft", "foot", "feet"]}


def _object(a: Column, b: Column) -> Column:
    """``a`` unless it says nothing."""
    return F.when(F.coalesce(F.to_json(a), F.lit("{}")) != "{}", a).otherwise(b)


def sensor_tanks(gases: Column, sensors: Column) -> Column:
    """Tanks of gases, each with the readings of the first sensor whose index is the gas's own or its place; of sensors alone where there are no gases. PSI becomes bar."""

    def bar(value: Column, sensor: Column) -> Column:
        psi = F.contains(F.upper(F.coalesce(sensor["pressureUnit"], F.lit(""))), F.lit("PSI"))
        return F.when(psi, number(value) * SERVICE_PSI_BAR).otherwise(number(value))

    def of_gas(g: Column, i: Column) -> Column:
        s = F.try_element_at(F.filter(sensors, lambda s: (s["tankIndex"] == F.coalesce(g["gasIndex"], i)) | (s["tankIndex"] == i)), F.lit(1))
        start, end = (bar(F.coalesce(s[a], g[b]), s) for a, b in (("startingPressure", "tankStartingPressure"), ("endingPressure", "tankEndingPressure")))
        oxygen = F.coalesce(F.nullif(number(g["oxygenContent"]), F.lit(0.0)), F.lit(21.0))
        return tank(oxygen, F.coalesce(number(g["heliumContent"]), F.lit(0.0)), start, end, number(g["tankSize"]), F.nullif(s["name"], F.lit("")))

    def of_sensor(s: Column) -> Column:
        return tank(F.lit(21.0), None, bar(s["startingPressure"], s), bar(s["endingPressure"], s), None, s["name"])

    return F.when(F.size(gases) > 0, F.transform(gases, of_gas)).otherwise(F.transform(sensors, of_sensor))


def metric_samples(descriptors: Column, metrics: Column) -> Column:
    """Samples of rows of numbers, whose columns are told by their descriptors' keys; rows without a depth are left out."""
    low = lambda d: F.lower(d["key"])
    at = lambda found, place: F.try_element_at(found, F.lit(place))["metricsIndex"]
    timed = at(F.filter(descriptors, lambda d: d["key"] == "sumDuration"), -1)
    is_depth = lambda d: F.contains(low(d), F.lit("depth"))
    depth = F.coalesce(at(F.filter(descriptors, lambda d: d["key"] == "directDepth"), -1), at(F.filter(descriptors, is_depth), 1))
    is_temp = lambda d: F.contains(low(d), F.lit("temp")) & ~is_depth(d)
    temp = F.coalesce(at(F.filter(descriptors, lambda d: d["key"] == "directAirTemperature"), -1), at(F.filter(descriptors, is_temp), 1))
    value = lambda m, i: F.try_element_at(m["metrics"], i + 1)
    made = F.transform(metrics, lambda m: sample(F.rint(value(m, timed)), value(m, depth), value(m, temp)))
    return F.filter(made, lambda s: s["depth"].isNotNull())


def garmin(rows: DataFrame, o: Column, raw: Column | None = None, *keep: str, mapping: str | dict | None = None) -> DataFrame:
    """Records of cached activities (struct of GARMIN). With ``raw``, the same object as a variant, a user's ``mapping`` is laid over them (:func:`tallyweave.functions.paths.overlay`).

    Values of ``details`` come before those of ``summary``; 0 and blank count as missing where they did for the service.
    """
    d, s = o["details"], o["summary"]
    # columns of their own, as many values come from each
    parts = {f"_{n}": _object(d[n], s[n]) for n in ("summaryDTO", "diveInfo", "metadataDTO", "timeZoneUnitDTO")}
    dto, info, meta, zone = (F.col(n) for n in parts)
    name, place = (first_truthy(d[n], s[n]) for n in ("activityName", "locationName"))
    position = lambda a, b: F.coalesce(*[number(x) for x in (dto[a], dto[b], s[a], s[b])])
    out_lat, out_lng = (F.coalesce(number(dto[n]), number(s[n])) for n in ("endLatitude", "endLongitude"))
    both = out_lat.isNotNull() & out_lng.isNotNull()
    samples = metric_samples(F.coalesce(o["activityDetails"]["metricDescriptors"], array_of("struct<metricsIndex:int,key:string>")), F.coalesce(o["activityDetails"]["activityDetailMetrics"], array_of("struct<metrics:array<double>>")))
    sensors = F.coalesce(o["tanksensor"]["tankSensors"], array_of("struct<tankIndex:int,name:string,startingPressure:string,endingPressure:string,pressureUnit:string>"))
    parts["_samples"], samples = samples, F.col("_samples")
    number_text = meta["diveNumber"]
    values = {
        "local": parsed(first_truthy(dto["startTimeLocal"], s["startTimeLocal"])),
        "utc": parsed(first_truthy(dto["startTimeGMT"], s["startTimeGMT"])),
        "zone": first_truthy(zone["unitKey"], zone["timeZone"]),
        "duration": F.coalesce(whole(first_truthy(dto["duration"], s["duration"])), F.lit(0)),
        "max_depth": F.coalesce(number(first_truthy(dto["maxDepth"], s["maxDepth"])), F.lit(0.0)),
        "avg_depth": number(first_truthy(dto["averageDepth"], s["averageDepth"])),
        **{a: known_temperature(number(dto[b])) for a, b in (("temp_min", "minTemperature"), ("temp_max", "maxTemperature"), ("temp_avg", "averageTemperature"))},
        "external_ids": ids(garmin=first_truthy(d["activityId"], s["activityId"])),
        "tanks": sensor_tanks(F.coalesce(info["diveGases"], array_of(_GAS)), sensors),
        "location": first_truthy(name, place),
        "notes": first_truthy(d["description"], s["description"]),
        "number": F.when(F.regexp_like(number_text, F.lit("^[0-9]+$")), number_text.try_cast("int")),
        "weight": number(info["weight"]),
        "weight_unit": info["weightUnit"]["unitKey"],
        "visibility": number(info["visibility"]),
        "visibility_unit": info["visibilityUnit"]["unitKey"],
        "buddy": info["buddy"],
        "lat": position("startLatitude", "endLatitude"),
        "lng": position("startLongitude", "endLongitude"),
        "exit_lat": F.when(both, out_lat),
        "exit_lng": F.when(both, out_lng),
        "samples": samples,
        "device_logged": F.coalesce(~meta["manualActivity"], F.when(F.size(samples) > 0, True)),
        "service_fields": ids(activityName=name, locationName=place),
    }
    if raw is not None and mapping is not None:
        parts["_merged"] = paths.merged(*[F.try_variant_get(raw, f"$.{n}", "variant") for n in ("summary", "details", "activityDetails")])
        values = paths.overlay(mapping, F.col("_merged"), values)
    return record(rows.withColumns(parts), values, *keep)


def _measure(c: Column, units: dict[str, list[str]], default: str) -> tuple[Column, Column]:
    """(value, unit) of a number, or of a text with a unit; 0 alone is nothing."""
    plain = number(c)
    said = number_and_unit(c, units, default)
    value = F.when(plain.isNotNull(), F.nullif(plain, F.lit(0.0))).otherwise(said["value"])
    return value, F.when(value.isNotNull(), F.when(plain.isNotNull(), F.lit(default)).otherwise(said["unit"]))


def divelogs(rows: DataFrame, o: Column, imperial: bool = False, *keep: str) -> DataFrame:
    """Records of a log's dives (struct of DIVELOGS); ``imperial`` accounts give feet, PSI, cubic feet and Fahrenheit."""
    metre = lambda c: c * SERVICE_FT_M if imperial else c
    celsius = lambda c: (c - 32) * 5 / 9 if imperial else c
    bar = lambda c: c * SERVICE_PSI_BAR if imperial else c
    litre = lambda c: c * SERVICE_CUFT_L if imperial else c
    above = lambda c: F.when(number(c) > 0, number(c))

    def one(t: Column) -> Column:
        name = F.nullif(first_truthy(t["tankname"], t["tank"]), F.lit(""))
        return tank(F.coalesce(number(t["o2"]), F.lit(21.0)), F.coalesce(number(t["he"]), F.lit(0.0)), bar(number(t["start_pressure"])), bar(number(t["end_pressure"])), litre(number(t["vol"])), name)

    rate = F.coalesce(F.when(whole(o["samplerate"]) > 0, whole(o["samplerate"])), F.lit(1))
    point = lambda p: F.from_json(p, "d string, t string")
    depth = lambda p: F.when(p.startswith("{"), number(point(p)["d"])).otherwise(number(p))
    temp = lambda p: F.when(p.startswith("{"), number(point(p)["t"]))
    made = F.transform(o["sampledata"], lambda p, i: sample(i * rate, metre(depth(p)), celsius(temp(p))))
    weight, weight_unit = _measure(o["weights"], WEIGHT_UNITS, "pound" if imperial else "kilogram")
    seen, seen_unit = _measure(o["visibility"], LENGTH_UNITS, "foot" if imperial else "meter")
    lat, lng = number(o["lat"]), number(o["lng"])
    somewhere = ~((lat == 0) & (lng == 0)) | lat.isNull() | lng.isNull()
    where = F.nullif(F.concat_ws(", ", F.nullif(o["location"], F.lit("")), F.nullif(o["divesite"], F.lit(""))), F.lit(""))
    values = {
        "local": parsed(F.concat_ws(" ", o["date"], F.coalesce(o["time"], F.lit("00:00:00")))),
        "duration": F.coalesce(whole(o["duration"]), F.lit(0)),
        "max_depth": metre(F.coalesce(number(o["maxdepth"]), F.lit(0.0))),
        "avg_depth": metre(number(o["meandepth"])),
        "temp_min": celsius(above(o["depthtemp"])),
        "air_temp": celsius(known_temperature(number(o["airtemp"]))),
        "external_ids": ids(divelogs=o["id"]),
        "tanks": F.transform(o["tanks"], one),
        "location": where,
        "notes": o["notes"],
        "number": F.when(F.regexp_like(o["divenumber"], F.lit("^[0-9]+$")), o["divenumber"].try_cast("int")),
        "weight": weight,
        "weight_unit": weight_unit,
        "visibility": seen,
        "visibility_unit": seen_unit,
        "buddy": o["buddy"],
        "lat": F.when(somewhere, lat),
        "lng": F.when(somewhere, lng),
        "samples": F.filter(made, lambda s: s["depth"].isNotNull()),
        "service_fields": ids(location=o["location"], divesite=o["divesite"]),
    }
    return record(rows, values, *keep)


def ssi_start(o: Column) -> Column:
    clock = lambda c: parsed(F.regexp_replace(F.trim(c), r"[+T]", " "))
    day = F.concat(o[_LOG + "date"], F.lit(" "), F.coalesce(F.nullif(o[_LOG + "entry_time"], F.lit("")), F.lit("00:00")))
    return F.coalesce(clock(o[_LOG + "datetime"]), clock(day))


def ssi_samples(c: Column) -> Column:
    """Samples of a JSON text of points: milliseconds, metres, degrees (0 is none), bar, minutes of no-decompression limit (from 99 on unknown)."""
    points = F.coalesce(F.from_json(c, _SSI_POINT), array_of("struct<d:string,t:string,te:string,pressure:string,ndl:string>"))

    def one(p: Column) -> Column:
        bar, ndl = number(p["pressure"]), number(p["ndl"])
        limit = F.when((ndl >= 0) & (ndl < SSI_NDL_MOST), F.rint(ndl * 60))
        pressures = F.when(bar.isNotNull(), F.create_map(F.lit(0), bar))
        return sample(F.rint(number(p["t"]) / 1000), number(p["d"]), known_temperature(number(p["te"])), bar, channels(pressures=pressures, ndl=limit))

    return F.transform(F.filter(points, lambda p: number(p["d"]).isNotNull()), one)


def ssi_sites(rows: DataFrame, o: Column, *at: str) -> DataFrame:
    """(site_id, site, site_lat, site_lng) of site objects (struct of SSI_SITE); of one id the first counts, by the columns ``at`` where given, then by name."""
    n = "odin_dive_sites_"
    site = whole(o[n + "id"])
    out = rows.select(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(at)], site.alias("site_id"), F.coalesce(text(o[n + "name"]), F.concat(F.lit("SSI site "), site.cast("string"))).alias("site"), number(o[n + "latitude"]).alias("site_lat"), number(o[n + "longitude"]).alias("site_lng"))
    known = out.where("site_id is not null").groupBy("site_id").agg(F.min_by(F.struct("site", "site_lat", "site_lng"), F.struct(*[f"_at{i}" for i in range(len(at))], "site", "site_lat", "site_lng")).alias("s"))
    return known.select("site_id", "s.*")


def ssi(rows: DataFrame, o: Column, sites: DataFrame | None = None, *keep: str, deleted: bool = False) -> DataFrame:
    """Records of a logbook's dives (struct of SSI) that are not flagged as deleted, or of those that are. ``sites`` (see :func:`ssi_sites`) gives their names."""
    g = lambda n: o[_LOG + n]
    kept = rows.where(F.coalesce(is_true(g("deleted")), F.lit(False)) == deleted).withColumn("_site", whole(g("dive_sites_id")))
    if sites is not None:
        kept = kept.join(sites.select(F.col("site_id").alias("_site"), F.col("site").alias("_name")), "_site", "left")
    else:
        kept = kept.withColumn("_name", F.lit(None).cast("string"))
    percent = F.when(F.coalesce(whole(g("ean")), F.lit(0)) != 0, number(g("ean_percent")))
    start, end, volume = number(g("pressure_start_bar")), number(g("pressure_end_bar")), number(g("tank_vol_l"))
    one = F.array(tank(F.coalesce(percent, F.lit(21.0)), None, start, end, volume))
    any_ = F.coalesce(percent, start, end, volume).isNotNull()
    maker, name = text(g("divecomputer_manufacturer")), text(g("divecomputer_name"))
    model = F.when(F.startswith(F.lower(name), F.lower(maker)), text(F.substring(name, F.length(maker) + 1, F.length(name)))).otherwise(name)
    water = F.lit(None).cast("string")
    for code, kind in SSI_WATER.items():
        water = F.when(whole(g("var_watertype_id")).cast("string") == code, kind).otherwise(water)
    weight, seen = number(g("weight_kg")), number(g("vis_m"))
    imported = g("divecomputer_imported")
    own = F.map_filter(reference_ids(g("divecomputer_dive_ref"), REFERENCES), lambda k, v: k != "ssi")
    values = {
        "local": ssi_start(o),
        "duration": F.coalesce(whole(g("divetime")), F.lit(0)) * 60,
        "max_depth": F.coalesce(number(g("depth_m")), F.lit(0.0)),
        "avg_depth": number(g("avg_depth_m")),
        "temp_min": number(g("watertemp_c")),
        "temp_max": number(g("watertemp_max_c")),
        "air_temp": number(g("airtemp_c")),
        "external_ids": F.map_concat(own, ids(ssi=text(g("id")))),
        "tanks": F.when(any_, one).otherwise(array_of(TANK)),
        "location": F.col("_name"),
        "notes": text(g("comment")),
        "number": whole(g("nr")),
        "weight": weight,
        "weight_unit": F.when(weight.isNotNull(), "kilogram"),
        "visibility": seen,
        "visibility_unit": F.when(seen.isNotNull(), "meter"),
        "lat": number(g("pos_start_latitude")),
        "lng": number(g("pos_start_longitude")),
        "samples": ssi_samples(g("diveSamples")),
        "device_logged": F.when(F.lower(imported).isin("true", "1"), True).when(F.lower(imported).isin("false", "0"), False),
        "service_fields": ids(site_id=F.col("_site")),
        "computer_vendor": maker,
        "computer_model": model,
        "computer_serial": text(g("divecomputer_serial_nr")),
        "computer_firmware": text(g("divecomputer_firmware")),
        "gf_low": whole(g("gf_set_1")),
        "gf_high": whole(g("gf_set_2")),
        "surface_interval": whole(g("si_before")),
        "water_type": water,
    }
    return record(kept, values, *keep)


def device_reference(ids_: Column, serial: Column, local: Column, utc: Column, own: str = "ssi") -> Column:
    """What a dive is known by in another log: ``service:id``, the watch service first; else the computer's serial and the start."""
    from tallyweave.functions.text import reference

    start = F.date_format(F.coalesce(utc, local), "yyyyMMdd'T'HHmmss")
    return F.coalesce(reference(ids_, "garmin", own), F.when(serial != "", F.concat(serial, F.lit(":"), start)))


READERS: dict[str, tuple[str, Callable]] = {"garmin": (GARMIN, garmin), "divelogs": (DIVELOGS, divelogs), "ssi": (SSI, ssi)}


def read(spark: SparkSession, path: str, service: str, **options) -> DataFrame:
    """Records of a folder of JSON files of one object each, with ``file`` and ``problem``: a file that is no such object is a row with a problem and nulls.

    Options: ``mapping`` (a user's mapping file as text, for garmin), ``imperial`` (divelogs), ``sites`` (ssi).
    """
    schema, make = READERS[service]
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][sS][oO][nN]").load(path)
    rows = raw.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("_json"))
    fields = ", ".join([schema, "_bad string"])
    rows = rows.withColumn("o", F.from_json("_json", fields, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    rows = rows.withColumn("problem", F.when(F.col("o._bad").isNotNull() | F.col("o").isNull(), "not a JSON object of this service"))
    if service == "garmin":
        options.setdefault("raw", paths.variant(F.col("_json")))
        return make(rows, F.col("o"), options["raw"], "file", "problem", mapping=options.get("mapping"))
    if service == "divelogs":
        return make(rows, F.col("o"), options.get("imperial", False), "file", "problem")
    return make(rows, F.col("o"), options.get("sites"), "file", "problem")
