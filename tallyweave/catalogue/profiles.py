"""Summaries of profiles and devices. Orders stand for records, their lines for samples and tanks."""

from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.functions import profiles as pf
from tallyweave.schema import TANK, channels, sample, tank

C = F.col
LINE = ("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
#: Lines of an order by place from 1.
LINES = f"WITH s AS (SELECT *, l_orderkey AS dive, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE)}) AS i FROM lineitem)"


def dives(t):
    """(dive, samples): sample i at 10 i seconds; every third has no temperature; line numbers pick the tank whose pressure is read; setpoints and no-stop times on some."""
    rows = t.lineitem.groupBy(C("l_orderkey").alias("dive")).agg(F.array_sort(F.collect_list(F.struct(*LINE))).alias("lines"))

    def one(x, i):
        read = F.when(x["l_linenumber"] < 6, F.create_map(x["l_linenumber"] % 3, x["l_quantity"]))
        return sample((i + 1) * 10, x["l_quantity"] - 1, F.when((i + 1) % 3 > 0, x["l_linenumber"] + 10), None, channels(pressures=read, setpoint=F.when(x["l_linenumber"] == 7, 1.2), ndl=F.when(x["l_linenumber"] == 1, 60)))

    return rows.select("dive", F.transform("lines", one).alias("samples"))


@query("profile_extremes", LINES + """
SELECT dive, CASE WHEN dive % 3 = 0 THEN 99.5 ELSE max(l_quantity) - 1 END AS deepest, coalesce(min(l_linenumber + 10) FILTER (i % 3 > 0), 4.5)::DOUBLE AS coldest,
coalesce(max(l_linenumber + 10) FILTER (i % 3 > 0), 4.5)::DOUBLE AS warmest, CASE WHEN dive % 2 = 0 THEN 777 ELSE CAST(max(i) * 10 AS INTEGER) END AS last FROM s GROUP BY dive""")
def extremes(t):
    head = (F.when(C("dive") % 3 == 0, 99.5), F.lit(4.5), F.lit(4.5), F.when(C("dive") % 2 == 0, 777))
    return dives(t).select("dive", pf.extremes(C("samples"), *head).alias("e")).select("dive", "e.*")


@query("profile_tank_readings", LINES + """
SELECT dive, l_linenumber % 3 AS tank, arg_min(l_quantity, i) AS first, arg_max(l_quantity, i) AS last FROM s WHERE l_linenumber < 6 GROUP BY ALL""")
def tank_readings(t):
    return dives(t).select("dive", F.explode(pf.tank_readings(C("samples"))).alias("tank", "r")).select("dive", "tank", "r.first", "r.last")


@query("profile_filled_pressures", LINES + """, r AS (SELECT dive, l_linenumber % 3 AS tank, arg_min(l_quantity, i) AS a, arg_max(l_quantity, i) AS b FROM s WHERE l_linenumber < 6 GROUP BY ALL)
SELECT d.dive, k.tank, CASE WHEN d.dive % 2 = 0 THEN 200 ELSE a END::DOUBLE AS first, b AS last FROM (SELECT DISTINCT dive FROM s) d CROSS JOIN (VALUES (0), (1)) k(tank) LEFT JOIN r ON r.dive = d.dive AND r.tank = k.tank""")
def filled_pressures(t):
    gas = tank(F.lit(21.0), start=F.when(C("dive") % 2 == 0, 200.0))
    rows = dives(t).select("dive", F.posexplode(pf.filled_pressures(F.array(gas, gas), C("samples"))).alias("tank", "x"))
    return rows.select("dive", "tank", C("x.start").alias("first"), C("x.end").alias("last"))


@query("profile_checks", LINES + """, a AS (SELECT dive, max(l_quantity) - 1 AS deep, coalesce(max(i * 10) FILTER (l_quantity > 1), 0) AS under, min(l_linenumber % 3) FILTER (l_linenumber < 6) AS transmitter,
bool_or(l_linenumber = 7) AS loop, bool_or(l_linenumber = 1) AS ndl FROM s GROUP BY dive)
SELECT dive, CASE WHEN abs(deep - 40) > 1 AND dive % 2 = 0 THEN 'depth' WHEN dive % 4 = 1 AND abs(under - 100) > 60 THEN 'time' END AS problem, transmitter,
concat_ws(',', CASE WHEN ndl THEN 'ndl' END, CASE WHEN loop THEN 'setpoint' END) AS names, loop OR dive % 5 = 0 AS on_loop FROM a""")
def checks(t):
    depth, time = F.when(C("dive") % 2 == 0, 40.0), F.when(C("dive") % 4 == 1, 100)
    none = F.array().cast(f"array<{TANK}>")
    s = C("samples")
    return dives(t).select("dive", pf.header_problem(s, depth, time, F.lit(10)).alias("problem"), pf.primary_transmitter(s).alias("transmitter"), F.array_join(pf.channel_names(s), ",").alias("names"), pf.on_loop(F.when(C("dive") % 5 == 0, "ccr"), none, s).alias("on_loop"))


@query("profile_loop_tanks", LINES + """, m AS (SELECT dive, CASE WHEN l_linenumber <= 3 THEN l_linenumber * 10 ELSE 0 END AS o2, min(i) AS seen FROM s WHERE l_linenumber <= 3 GROUP BY ALL),
k AS (SELECT dive, list(o2 ORDER BY seen) AS mix FROM m GROUP BY dive), n AS (SELECT s.dive, i, l_linenumber, l_linenumber IN (2, 3, 4) AS dil, coalesce(mix, []) || [50] AS mix,
sum(CASE WHEN l_linenumber IN (2, 3, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY s.dive ORDER BY i) AS nth FROM s LEFT JOIN k ON k.dive = s.dive)
SELECT dive, CAST(i AS INTEGER) AS place, CASE WHEN dive % 4 = 0 THEN NULL WHEN l_linenumber = 1 THEN 'oxygen' WHEN dil THEN 'diluent' END AS role,
CASE WHEN l_linenumber = 5 THEN 32 WHEN dive % 4 = 0 THEN 21 WHEN l_linenumber = 1 THEN 100 WHEN dil THEN mix[CAST(least(nth, len(mix)) AS BIGINT)] ELSE 21 END::DOUBLE AS oxygen FROM n""")
def loop_tanks(t):
    rows = t.lineitem.groupBy(C("l_orderkey").alias("dive")).agg(F.array_sort(F.collect_list(F.struct(*LINE))).alias("lines"))
    names = F.array(*[F.lit(n) for n in (" o2", "D1", "dil", "DIL2 ", "O2", "stage", "D12")])
    tanks = F.transform("lines", lambda x: tank(F.when(x["l_linenumber"] == 5, 32.0).otherwise(21.0), name=F.when(x["l_linenumber"] == 5, "left").otherwise(F.element_at(names, x["l_linenumber"]))))
    mix = lambda o: F.struct(o.cast("double").alias("oxygen"), F.lit(0.0).alias("helium"))
    breathed = F.transform("lines", lambda x: mix(F.when(x["l_linenumber"] <= 3, x["l_linenumber"] * 10).otherwise(0)))
    out = pf.loop_tanks(F.when(C("dive") % 4 == 0, "oc").otherwise("scr"), tanks, breathed, F.array(mix(F.lit(50)), mix(F.lit(0))))
    return rows.select("dive", F.posexplode(out).alias("place", "x")).select("dive", (C("place") + 1).alias("place"), "x.role", "x.oxygen")


@query("profile_logged_channels", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 4 THEN l_linenumber * 180 END AS stop_time, CASE WHEN l_linenumber >= 4 THEN l_linenumber * 180 END AS ndl,
CASE WHEN l_linenumber % 2 = 0 THEN 1.3 END AS setpoint, CASE WHEN l_linenumber = 1 THEN 90 ELSE l_quantity END::DOUBLE AS p0, CASE WHEN l_linenumber = 1 THEN NULL ELSE 90 END::DOUBLE AS p1,
CASE WHEN l_linenumber IN (1, 3) THEN round(l_linenumber * 0.021 * 10, 3) WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber >= 4 AND l_linenumber % 2 = 1 THEN round(l_linenumber * 0.02 * 10, 3) END AS cell FROM lineitem""")
def logged_channels(t):
    n = C("l_linenumber")
    stop = F.when(n < 4, 3.0)
    tank_of = F.when(n == 1, F.create_map(F.lit(0), F.lit(5), F.lit(1), F.lit(0))).otherwise(F.create_map(F.lit(9), F.lit(9)))
    got = pf.logged_channels(stop, n * 3, n % 2 == 0, F.lit(1), F.lit(1.3), F.lit(0.5), F.create_map(F.lit(0), C("l_quantity"), F.lit(1), F.lit(90.0)), tank_of)
    # cell 0 is on for odd lines; from the fourth on its word is its own, before it is a new device's, but cell 1 isn't
    factors = pf.cell_factors(F.when(n % 2 == 1, F.when(n < 4, 3).otherwise(1)).otherwise(0), F.when(n < 4, 2100).otherwise(2000), F.lit(2200))
    cells = pf.cell_readings(F.create_map(F.lit(0), n * 10), factors)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", got.alias("c"), cells[F.lit(0)].alias("cell")).select("l_orderkey", "l_linenumber", "l_partkey", "c.stop_time", "c.ndl", "c.setpoint", C("c.pressures")[0].alias("p0"), C("c.pressures")[1].alias("p1"), "cell")


@query("profile_devices", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Hand-logged' WHEN event_id % 3 = 0 THEN 'one' WHEN event_id % 2 = 0 THEN 'kind two' WHEN event_id % 3 = 1 THEN 'Garmin product 7' WHEN event_id % 7 = 0 THEN '' ELSE 'Garmin device type 9' END AS device FROM events""")
def devices(t):
    k = C("event_id")
    said = F.when(k % 10 == 0, '{"metadataDTO":{"isManualActivity":true}}').when(k % 5 == 0, '{"manualActivity":true}').otherwise('{"manualActivity":false,"metadataDTO":{}}')
    product = F.when(k % 3 == 0, 1).when(k % 3 == 1, 7)
    kind = F.when(k % 2 == 0, 2).when((k % 7 == 0), F.lit(None)).otherwise(9)
    name = pf.device_name(pf.by_hand(F.parse_json(said), F.parse_json(F.lit("null"))), product, kind, F.create_map(F.lit(1), F.lit("one")), F.create_map(F.lit(2), F.lit("kind two")))
    return t.events.select("event_id", name.alias("device"))
