"""Readers of services' objects. Orders and events are spelled as the services would, and read back as records."""

from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.functions import paths
from tallyweave.schema import tank
from tallyweave.session import written
from tallyweave.sources import git_tree, services

C = F.col
AT = "yyyy-MM-dd HH:mm:ss"


def _object(schema: str, **fields):
    """A parsed object of a service, from the JSON text of its fields."""
    return F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])), schema)


@query("source_divelogs", """WITH o AS (SELECT *, o_orderkey % 4 AS r FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' AS at, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey AS INTEGER) END AS number, CAST(o_custkey AS INTEGER) AS duration,
CAST(o_orderkey % 40 AS DOUBLE) AS max_depth, CASE WHEN o_orderkey % 2 = 0 THEN 'Wall' ELSE o_orderpriority || ', Wall' END AS location,
CASE r WHEN 0 THEN 4.0 WHEN 1 THEN 10.0 WHEN 3 THEN 7.5 END AS weight, CASE r WHEN 0 THEN 'kilogram' WHEN 1 THEN 'pound' WHEN 3 THEN 'kilogram' END AS weight_unit,
CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 3 AS DOUBLE) END AS lat, CAST(CASE WHEN r > 0 THEN r ELSE 1 END AS INTEGER) AS last_t, 18.0 AS last_temp, 2 AS n_samples FROM o""")
def divelogs(t):
    k = C("o_orderkey")
    weights = F.element_at(F.array(*[F.lit(w) for w in ("4 kg", "10 lb", "0", "7.5")]), (k % 4 + 1).cast("int"))
    o = _object(
        services.DIVELOGS, id=k, divenumber=F.when(k % 3 > 0, k.cast("string")).otherwise(""), date=F.date_format("o_orderdate", "yyyy-MM-dd"), duration=C("o_custkey"), maxdepth=k % 40,
        location=F.when(k % 2 == 0, "").otherwise(C("o_orderpriority")), divesite=F.lit("Wall"), weights=weights, lat=k % 3, lng=F.lit(0), samplerate=k % 4,
        sampledata=F.array(F.lit("1.5"), F.lit('{"d":4.5,"t":18}')),
    )
    got = services.divelogs(t.orders.select(o.alias("o")), C("o"))
    end = F.element_at("samples", -1)
    return got.select(C("external_ids")["divelogs"].alias("id"), F.date_format("local", AT).alias("at"), "number", "duration", "max_depth", "location", "weight", "weight_unit", "lat", end["t"].alias("last_t"), end["temp"].alias("last_temp"), F.size("samples").alias("n_samples"))


@query("source_garmin", """SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(event_id % 100 AS INTEGER) AS duration, round(coalesce(value, 0.0), 6) AS max_depth,
CASE WHEN event_id % 2 = 1 THEN 20.0 END AS temp_min, CAST(event_id AS INTEGER) AS number, 1.5 AS lat, NULL::DOUBLE AS exit_lat, 21.0 AS first_oxygen, 50.0 AS second_oxygen, 199.9 AS second_start, 'S' AS second_name, 5.5 AS last_depth, 2 AS n_samples FROM events""")
def garmin(t):
    k = C("event_id")
    named = lambda **fields: F.struct(*[v.alias(n) for n, v in fields.items()])
    gas = lambda i, o2, start: named(gasIndex=F.lit(i), oxygenContent=F.lit(o2), tankStartingPressure=F.lit(start))
    o = _object(
        services.GARMIN,
        summary=named(activityId=k, startTimeLocal=F.date_format(C("ts").cast("timestamp_ntz"), AT), duration=F.lit(0), maxDepth=C("value")),
        details=named(summaryDTO=named(duration=k % 100, minTemperature=k % 2 * 20, endLatitude=F.lit(1.5)), metadataDTO=named(diveNumber=k.cast("string")), diveInfo=named(diveGases=F.array(gas(0, 0, None), gas(3, 50, 200)))),
        activityDetails=named(metricDescriptors=F.array(named(metricsIndex=F.lit(1), key=F.lit("directDepth")), named(metricsIndex=F.lit(0), key=F.lit("sumDuration"))), activityDetailMetrics=F.array(*[named(metrics=F.array(F.lit(a), F.lit(b))) for a, b in ((0.0, 1.0), (10.0, 5.5), (20.0, None))])),
        tanksensor=named(tankSensors=F.array(named(tankIndex=F.lit(3), name=F.lit("S"), startingPressure=F.lit(2900), pressureUnit=F.lit("PSI")))),
    )
    got = services.garmin(t.events.select(o.alias("o")), C("o"))
    one, two = C("tanks")[0], C("tanks")[1]
    return got.select(C("external_ids")["garmin"].alias("id"), F.date_format("local", AT).alias("at"), "duration", F.round("max_depth", 6).alias("max_depth"), "temp_min", "number", "lat", "exit_lat", one["oxygen"].alias("first_oxygen"), two["oxygen"].alias("second_oxygen"), F.round(two["start"], 1).alias("second_start"), two["name"].alias("second_name"), F.element_at("samples", -1)["depth"].alias("last_depth"), F.size("samples").alias("n_samples"))


@query("source_ssi", """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'g' || o_custkey END AS garmin, strftime(o_orderdate, '%Y-%m-%d') || ' 08:30:00' AS at, CAST(o_custkey % 90 * 60 AS INTEGER) AS duration, n_name AS location,
CASE WHEN o_orderkey % 2 = 1 THEN 32.0 ELSE 21.0 END AS oxygen, CASE o_orderkey % 3 WHEN 0 THEN 'salt' WHEN 1 THEN 'fresh' END AS water_type, CASE WHEN o_orderkey % 5 < 2 THEN 1 ELSE 0 END = 1 AS logged, CAST(o_custkey % 120 * 60 AS INTEGER) AS ndl
FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30 WHERE o_orderkey % 4 > 0""".replace("CAST(o_custkey % 120 * 60 AS INTEGER) AS ndl", "CASE WHEN o_custkey % 120 < 99 THEN CAST(o_custkey % 120 * 60 AS INTEGER) END AS ndl"))
def ssi(t):
    k, n = C("o_orderkey"), C("o_custkey")
    points = F.to_json(F.array(F.struct(F.lit(2.0).alias("d"), F.lit(1000).alias("t"), (n % 120).alias("ndl"), F.lit(180).alias("pressure"))))
    given = {
        "id": k, "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "entry_time": F.lit("08:30"), "divetime": n % 90, "dive_sites_id": n % 30, "deleted": F.when(k % 4 == 0, "1"), "ean": k % 2, "ean_percent": F.lit(32), "tank_vol_l": F.lit(12),
        "divecomputer_dive_ref": F.when(k % 3 == 0, F.concat(F.lit("garmin:g"), n.cast("string"))).otherwise("unknown"), "var_watertype_id": F.when(k % 3 == 0, 5).when(k % 3 == 1, 4), "divecomputer_imported": F.when(k % 5 < 2, "true").otherwise("0"), "diveSamples": points,
    }
    o = _object(services.SSI, **{f"odin_user_log_{name}": c for name, c in given.items()})
    site = _object(services.SSI_SITE, odin_dive_sites_id=C("n_nationkey"), odin_dive_sites_name=C("n_name"))
    sites = services.ssi_sites(t.nation.select(site.alias("o")), C("o"))
    got = services.ssi(t.orders.select(o.alias("o")), C("o"), sites)
    ids = C("external_ids")
    return got.select(F.try_element_at(ids, F.lit("ssi")).alias("id"), F.try_element_at(ids, F.lit("garmin")).alias("garmin"), F.date_format("local", AT).alias("at"), "duration", "location", C("tanks")[0]["oxygen"].alias("oxygen"), "water_type", C("device_logged").alias("logged"), C("samples")[0]["channels"]["ndl"].alias("ndl"))


#: A user's mapping: what an activity holds beside the usual, laid over its record.
MAPPING = {"mappings": [{"field": "divenumber", "path": "$.extra.no"}, {"field": "maxdepth", "path": "$.extra.deep[*].m"}, {"field": "buddy", "path": "$.who"}, {"field": "divesite", "path": "$.where"}, {"tanks": {"o2": "$.extra.gases[*].o2", "vol": "$.extra.gases[*].l"}}]}


@query("source_garmin_mapped", """SELECT CAST(event_id AS VARCHAR) AS id, CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 50 ELSE 7 END AS INTEGER) AS number, CASE WHEN event_id % 4 = 0 THEN event_id % 30 ELSE 12.5 END::DOUBLE AS max_depth, CASE WHEN event_id % 2 = 0 THEN 'Ann' ELSE 'Bob' END AS buddy,
'Wall' || CASE WHEN event_id % 5 = 0 THEN ', Reef' ELSE '' END AS location, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS n_tanks, CASE WHEN event_id % 4 = 0 THEN 32.0 ELSE 21.0 END AS oxygen, CASE WHEN event_id % 4 = 0 THEN 10.0 END::DOUBLE AS second_volume FROM events""")
def garmin_mapped(t):
    k = C("event_id")
    named = lambda **fields: F.struct(*[v.alias(n) for n, v in fields.items()])
    summary = named(activityId=k, startTimeLocal=F.date_format(C("ts").cast("timestamp_ntz"), AT), maxDepth=F.lit(12.5), activityName=F.lit("Wall"), who=F.when(k % 2 == 0, "Ann"), where=F.when(k % 5 == 0, "Reef"))
    extra = named(no=F.when(k % 3 > 0, k % 50), deep=F.when(k % 4 == 0, F.array(named(m=k % 30))), gases=F.when(k % 4 == 0, F.array(named(o2=F.lit(32), l=F.lit(12)), named(o2=F.lit(50), l=F.lit(10)))))
    gas = F.array(named(gasIndex=F.lit(0), oxygenContent=F.lit(21)))
    details = named(extra=extra, metadataDTO=named(diveNumber=F.lit("7")), diveInfo=named(diveGases=gas, buddy=F.lit("Bob")))
    rows = t.events.select(F.to_json(named(summary=summary, details=details)).alias("j"))
    rows = rows.select(F.from_json("j", services.GARMIN).alias("o"), paths.variant(C("j")).alias("raw"))
    got = services.garmin(rows, C("o"), C("raw"), mapping=MAPPING)
    return got.select(C("external_ids")["garmin"].alias("id"), "number", "max_depth", "buddy", "location", F.size("tanks").alias("n_tanks"), C("tanks")[0]["oxygen"].alias("oxygen"), F.get("tanks", 1)["volume"].alias("second_volume"))


@query("source_git_tree", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS n FROM orders WHERE o_orderkey % 13 > 0)
SELECT k, strftime(d, '%Y-%m-%d') || ' 10:20:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') AS at, CAST(CASE WHEN k % 5 > 0 THEN k END AS INTEGER) AS number, 'Site ' || c % 40 AS location, CAST(c % 40 AS DOUBLE) AS lat, CAST(k % 90 * 60 + 30 AS INTEGER) AS duration,
CAST(k % 40 AS DOUBLE) AS max_depth, 'it "is" \\ ' || k AS notes, 32.0 AS oxygen, CAST(200 - c % 30 AS DOUBLE) AS tank_start, 3 AS n_samples, 18.5 AS last_temp FROM o""")
def source_git_tree(t):
    """Orders as the files of a tree: dives in day folders, some in a trip's, others with the date in the folder's name, each with a computer's file, and a file for each site."""
    k, c = C("o_orderkey"), C("o_custkey")
    hexed = lambda n: F.lower(F.lpad(F.hex(n), 8, "0"))
    s = F.lpad((k % 60).cast("string"), 2, "0")
    clock = F.concat(F.date_format("o_orderdate", "-E-"), F.lit("10=20="), s)
    folder = F.concat(F.lit("/repo/"), F.date_format("o_orderdate", "yyyy/MM/"), F.when(k % 3 == 0, F.concat(F.date_format("o_orderdate", "dd-"), F.lit("Trip 1/"))).otherwise(""), F.when(k % 7 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd")), clock, F.lit("~"), F.lower(F.hex(k)))
    orders = t.orders.where(k % 13 > 0)
    text = lambda *lines: F.concat_ws("\n", *lines, F.lit(""))
    of = lambda word, value, end="": F.concat(F.lit(word + " "), value.cast("string"), F.lit(end))
    dive = text(
        F.concat(F.lit("duration "), (k % 90).cast("string"), F.lit(":30 min")), of("divesiteid", hexed(c % 40)), F.concat(F.lit('notes "it \\"is\\" \\\\ '), k.cast("string"), F.lit('"')),
        F.concat(F.lit("cylinder vol=12.0l o2=32.0% start="), (200 - c % 30).cast("string"), F.lit(".0bar end=50.0bar")),
    )
    computer = text(F.lit('model "One"'), of("maxdepth", k % 40, ".0m"), F.lit("  0:00 0.0m 20.0°C"), F.lit("  0:10 5.0m"), F.lit("  0:20 6.5m 18.5°C"))
    dives = orders.select(F.concat(folder, F.lit("/Dive"), F.when(k % 5 > 0, F.concat(F.lit("-"), k.cast("string"))).otherwise("")).alias("path"), dive.alias("text"))
    computers = orders.select(F.concat(folder, F.lit("/Divecomputer"), F.when(k % 4 == 0, "-001").otherwise("")).alias("path"), computer.alias("text"))
    sites = orders.select((c % 40).alias("n")).distinct().select(F.concat(F.lit("/repo/01-Divesites/Site-"), hexed(C("n"))).alias("path"), text(F.concat(F.lit('name "Site '), C("n").cast("string"), F.lit('"')), F.concat(F.lit("gps "), C("n").cast("string"), F.lit(".0 -3.5"))).alias("text"))
    other = orders.select(F.concat(folder, F.lit("/notes.txt")).alias("path"), F.lit("duration 99:00 min").alias("text"))
    # as a tree's files would lie in a folder: paths are read, not made again at each use
    files = written(dives.unionByName(computers).unionByName(sites).unionByName(other), "git-files")
    got = git_tree.records(files, "folder")
    last = F.element_at("samples", -1)
    return got.select(
        F.conv(F.substring_index("folder", "~", -1), 16, 10).cast("long").alias("k"), F.date_format("local", AT).alias("at"), "number", "location", "lat", "duration", "max_depth", "notes", C("tanks")[0]["oxygen"].alias("oxygen"),
        C("tanks")[0]["start"].alias("tank_start"), F.size("samples").alias("n_samples"), last["temp"].alias("last_temp"),
    )


#: Where a service keeps what a record has.
LAID = {"mappings": [{"field": "divenumber", "path": "$.meta.no"}, {"field": "maxdepth", "path": "$.sum.deep[*]"}, {"field": "buddy", "path": "$.who"}, {"field": "divesite", "path": "$.sum.where"}, {"tanks": {"o2": "$.gases[*].o2", "vol": "$.gases[*].size.l"}}]}


@query("payload_mapped", """SELECT event_id, CAST(event_id % 50 AS INTEGER) AS number, (event_id % 30)::DOUBLE AS max_depth, CASE WHEN event_id % 3 > 0 THEN 'Ann' ELSE 'old' END AS buddy, 'Wall ' || event_id % 9 AS location,
CASE WHEN event_id % 2 = 0 THEN '32:12,50:7' ELSE '21:10' END AS tanks, CASE WHEN event_id % 2 = 0 THEN 'a,' ELSE 'a' END || CASE WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN ',b' WHEN event_id % 2 = 0 AND event_id % 5 = 0 THEN 'b' ELSE '' END AS kept,
'stays' AS other, CASE WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN 2 WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS n_gases FROM events""")
def payload_mapped(t):
    """A record is laid into an object that has other names, and a list of gases of another length; the overlay reads it back."""
    k = C("event_id")
    named = lambda **fields: F.struct(*[v.alias(n) for n, v in fields.items()])
    gases = F.array(named(id=F.lit("a"), o2=F.lit(10)))
    base = named(who=F.lit("old"), sum=named(other=F.lit("stays"), where=F.lit("x")), gases=F.when(k % 5 == 0, F.concat(gases, F.array(named(id=F.lit("b"), o2=F.lit(None).cast("int"))))).otherwise(gases))
    one, two = tank(F.lit(32.0), volume=F.lit(12.0)), tank(F.lit(50.0), volume=F.lit(7.0))
    values = {"number": (k % 50).cast("int"), "max_depth": (k % 30).cast("double"), "buddy": F.when(k % 3 > 0, "Ann"), "location": F.concat(F.lit("Wall "), (k % 9).cast("string")), "tanks": F.when(k % 2 == 0, F.array(one, two)).otherwise(F.array(tank(F.lit(21.0), volume=F.lit(10.0))))}
    rows = t.events.select("event_id", paths.variant(F.to_json(base)).alias("raw"), *[v.alias(n) for n, v in values.items()])
    rows = rows.select("event_id", paths.laid(LAID, C("raw"), {n: C(n) for n in values}).alias("v"))
    got = paths.overlay(LAID, C("v"), {})
    brief = lambda t: F.concat(t["oxygen"].cast("int").cast("string"), F.lit(":"), t["volume"].cast("int").cast("string"))
    known = F.filter(got["tanks"], lambda t: t["volume"].isNotNull())
    return rows.select(
        "event_id", *[got[n].alias(n) for n in ("number", "max_depth", "buddy", "location")], F.array_join(F.transform(known, brief), ",").alias("tanks"), F.array_join(F.transform(F.try_variant_get("v", "$.gases", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.id", "string"), F.lit(""))), ",").alias("kept"),
        F.try_variant_get("v", "$.sum.other", "string").alias("other"), F.size(F.try_variant_get("v", "$.gases", "array<variant>")).alias("n_gases"),
    )
