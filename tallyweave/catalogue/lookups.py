"""Lookups, cells and names of files."""

from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.catalogue.linking import HAVERSINE, PLACES, places
from tallyweave.functions import cells
from tallyweave.operators import lookups
from tallyweave.sinks import files

C = F.col
K = "CAST(json_extract(props, '$.k') AS INTEGER)"
LOGS = f"""a AS (SELECT event_id AS i, {K} AS k, CASE WHEN {K} % 7 = 0 THEN 'r' || {K} END AS ref, epoch_us(ts) / 1e6 AS at, value AS depth FROM events WHERE event_type = 'click'),
b AS (SELECT event_id AS j, {K} AS k, CASE WHEN {K} % 7 = 0 AND {K} % 2 = 0 THEN 'r' || {K} END AS ref, epoch_us(ts) / 1e6 AS at, value AS depth, {K} + event_id % 3 AS minutes FROM events WHERE event_type = 'view'),
f AS (SELECT ref, min(j) AS fj FROM b WHERE ref IS NOT NULL GROUP BY ref), x AS (SELECT a.*, fj FROM a LEFT JOIN f USING (ref))"""


def _logs(t):
    k = F.get_json_object("props", "$.k").cast("int")
    at = F.unix_micros(C("ts").cast("timestamp")) / 1e6
    ref = F.concat(F.lit("r"), k.cast("string"))
    sent = t.events.where("event_type = 'click'").select(C("event_id").alias("i"), F.when(k % 7 == 0, ref).alias("ref"), k.alias("number"), at.alias("at"), C("value").alias("depth"), (k * 60).alias("duration"))
    log = t.events.where("event_type = 'view'").select(C("event_id").alias("j"), F.when(k % 14 == 0, ref).otherwise(" ").alias("ref"), k.alias("number"), at.alias("at"), C("value").alias("depth"), (k + C("event_id") % 3).alias("minutes"))
    return sent, log


FOUND = f"""{PLACES}, n AS (SELECT 'site ' || (s_suppkey * 3) AS name, min(s_suppkey) AS known FROM supplier GROUP BY 1), a AS (SELECT c.*, known FROM c LEFT JOIN n ON name = 'site ' || (cust % 400)),
p AS (SELECT cust, supp, {HAVERSINE} AS m FROM a, s WHERE known IS NULL),
q AS (SELECT cust, known AS supp, NULL::DOUBLE AS metres FROM a WHERE known IS NOT NULL UNION ALL SELECT cust, arg_min(supp, (m, supp)), round(min(m), 3) FROM p WHERE m <= 500000 GROUP BY cust)"""
NAMES = ("cust", "name", "lat", "lng"), ("supp", "name", "lat2", "lng2")


def _named(t):
    c, s = places(t)
    return c.withColumn("name", F.concat(F.lit("Site "), (C("cust") % 400).cast("string"))), s.withColumn("name", F.concat(F.lit(" SITE "), (C("supp") * 3).cast("string")))


@query("join_find_place", f"WITH {FOUND} SELECT * FROM q")
def find_place(t):
    return lookups.find_place(*_named(t), 500_000.0, *NAMES).withColumn("metres", F.round("metres", 3))


@query("join_place_keys", f"WITH {FOUND} SELECT cust, CAST(supp AS VARCHAR) AS site, supp IS NULL AS made FROM c LEFT JOIN q USING (cust)")
def place_keys(t):
    keys = lookups.place_keys(*_named(t), 500_000.0, *NAMES)
    return keys.withColumn("site", F.when(~C("made"), C("site")))


@query("join_duplicates", f"""WITH {LOGS} SELECT i, fj AS j, 'reference' AS how FROM x WHERE fj IS NOT NULL UNION ALL
SELECT i, arg_min(b.j, (abs(b.at - x.at), b.j)), 'start' FROM x JOIN b ON abs(b.at - x.at) <= 600 WHERE fj IS NULL GROUP BY i""")
def duplicates(t):
    return lookups.duplicates(*_logs(t), 600.0)


@query("join_verified", f"""WITH {LOGS}, n AS (SELECT i, min(b.j) AS nj FROM x JOIN b ON x.k = b.k AND abs(b.at - x.at) <= 86400 WHERE fj IS NULL GROUP BY i),
g AS (SELECT x.*, coalesce(fj, nj) AS j FROM x LEFT JOIN n USING (i))
SELECT i, g.j, list_filter([CASE WHEN g.j IS NULL THEN 'missing' END, CASE WHEN b.k <> g.k THEN 'number' END, CASE WHEN abs(b.at - g.at) > 86400 THEN 'start' END, CASE WHEN abs(b.depth - g.depth) > 0.5 THEN 'depth' END, CASE WHEN abs(b.minutes - g.k) > 1 THEN 'time' END], lambda y: y IS NOT NULL) AS wrong
FROM g LEFT JOIN b ON b.j = g.j""")
def verified(t):
    return lookups.verified(*_logs(t), 86_400.0)


@query("fn_mix_index", f"""WITH e AS (SELECT event_id, 20 + {K} % 26 * 0.5 AS o, CASE WHEN {K} % 2 = 1 THEN 45.0 END AS he FROM events)
SELECT event_id, CAST(CASE WHEN abs(o - 21) <= 0.5 AND he IS NULL THEN 0 WHEN abs(o - 32) <= 0.5 AND he IS NULL THEN 1 WHEN abs(o - 21.5) <= 0.5 AND he = 45 THEN 2 END AS INTEGER) AS gas FROM e""")
def mix_index(t):
    k = F.get_json_object("props", "$.k").cast("int")
    tank = lambda o, he: F.struct(F.lit(o).alias("oxygen"), F.lit(he).cast("double").alias("helium"))
    tanks = F.array(tank(21.0, None), tank(32.0, 0), tank(21.5, 45), tank(21.5, 45))
    return t.events.select("event_id", lookups.mix_index(tanks, 20 + k % 26 * 0.5, F.when(k % 2 == 1, 45.0)).alias("gas"))


@query("fn_filled_from", """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m FROM customer)
SELECT k, CASE WHEN k % 2 = 0 AND k % 5 > 0 THEN m WHEN k % 2 = 0 THEN '  ' ELSE 'own' END AS location, CASE WHEN k % 3 = 0 THEN 4.0 ELSE 6.0 END AS weight, CASE WHEN k % 3 = 0 THEN 'pound' ELSE 'kilogram' END AS unit,
CASE WHEN k % 4 = 0 AND k % 5 = 0 THEN NULL WHEN k % 4 = 0 THEN 12.0 ELSE 10.0 END AS volume, list_filter([CASE WHEN k % 2 = 0 AND k % 5 > 0 THEN 'site' END, CASE WHEN k % 3 = 0 THEN 'weight' END, CASE WHEN k % 4 = 0 AND k % 5 > 0 THEN 'tank volume' END], lambda y: y IS NOT NULL) AS filled FROM c""")
def filled_from(t):
    k, none = C("c_custkey"), F.lit(None)
    tanks = lambda v: F.array(F.struct(v.cast("double").alias("volume")))
    rec = lambda site, weight, unit, v: F.struct(site.alias("location"), none.cast("string").alias("buddy"), F.lit("n").alias("notes"), weight.cast("double").alias("weight"), F.lit(unit).alias("weight_unit"), none.cast("double").alias("visibility"), none.cast("string").alias("visibility_unit"), tanks(v).alias("tanks"))
    own = rec(F.when(k % 2 == 0, "  ").otherwise("own"), F.when(k % 3 > 0, 6), "kilogram", F.when(k % 4 > 0, 10))
    twin = rec(F.when(k % 5 > 0, C("c_mktsegment")), F.lit(4), "pound", F.when(k % 5 == 0, 0).otherwise(12))
    rows = t.customer.select(k.alias("k"), own.alias("own"), twin.alias("twin"))
    record, words = lookups.filled_from(C("own"), C("twin"))
    got = rows.select("k", record.alias("r"), words.alias("filled"))
    return got.select("k", "r.location", "r.weight", C("r.weight_unit").alias("unit"), C("r.tanks")[0]["volume"].alias("volume"), "filled")


@query("fn_cells", """WITH o AS (SELECT *, o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k, (c % 11 = 0 OR c % 10 = c % 7) AS same, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN o_orderpriority END AS option, CASE WHEN c % 3 > 0 THEN c % 3 WHEN c % 2 > 0 THEN c % 2 END AS known,
CASE WHEN c % 5 > 0 THEN CAST(c AS VARCHAR) ELSE 'nonum' END || '_' || strftime(o_orderdate, '%Y-%m-%d_%H%M%S') || '_' || k AS stem, CAST(k AS VARCHAR) AS of_stem, lpad(CAST(k AS VARCHAR), 9, '1') AS of_name, NULL::VARCHAR AS of_other, lpad(to_hex(k), 8, '0') AS serial FROM o""")
def fn_cells(t):
    k, c = C("o_orderkey"), C("o_custkey")
    number = lambda n, end: F.concat((c % n).cast("string"), F.lit(end))
    a, b = F.when(c % 11 == 0, "  ").otherwise(number(10, ".500")), F.when(c % 11 > 0, number(7, ",5"))
    stem = cells.file_stem(F.when(c % 5 > 0, c).otherwise(None), C("o_orderdate"), k)
    name = F.concat(F.lit("x_1/"), F.lpad(k.cast("string"), 9, "1"), F.lit("_activity.fit"))
    return t.orders.select(
        k.alias("k"), cells.same_cell(a, b).alias("same"), cells.option(F.lower("o_orderpriority"), ["1-URGENT", "5-LOW"]).alias("option"), cells.unless_zero(c % 3, c % 2).alias("known"), stem.alias("stem"),
        cells.id_of_file(F.concat(F.lit("/a.b/"), stem, F.lit(".json"))).alias("of_stem"), cells.id_of_file(name).alias("of_name"), cells.id_of_file(F.concat(F.lit("515"), F.lit(".fit"))).alias("of_other"), cells.serial_text(k).alias("serial"),
    )


@query("sink_file_names", """WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d %H%M') || CASE WHEN o_custkey % 3 > 0 THEN ' dive ' || (o_custkey % 3) ELSE '' END AS s FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k) AS n FROM o)
SELECT k, s || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.json' AS name FROM n""")
def file_names(t):
    return files.file_names(t.orders.select(C("o_orderkey").alias("k"), C("o_orderdate").alias("local"), F.when(C("o_custkey") % 3 > 0, C("o_custkey") % 3).alias("number")), "k", ".json")


@query("sink_dropped_counts", """SELECT 'buddy' AS name, count(*) AS n FROM customer WHERE c_custkey % 3 > 0 HAVING count(*) > 0 UNION ALL SELECT 'tanks', count(*) FROM customer WHERE c_custkey % 4 = 0 HAVING count(*) > 0""")
def dropped_counts(t):
    k = C("c_custkey")
    rows = t.customer.select(F.when(k % 3 > 0, C("c_name")).otherwise(" ").alias("buddy"), F.when(k % 4 == 0, F.array(k)).otherwise(F.array().cast("array<bigint>")).alias("tanks"), k.cast("double").alias("depth"), F.lit(None).cast("double").alias("sac"))
    return files.dropped_counts(rows, {"buddy": "buddy", "tanks": "tanks", "depth": "depth", "sac": "consumption"}, ["depth"])
