"""Series queries. A user's events are a dive's samples, with whole hours as time so that ties and gaps occur."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.operators import series as se

C = F.col
S = """s AS (SELECT user_id AS dive, epoch_us(ts) // 3600000000 AS t, event_id AS seq, event_type AS kind, value AS depth, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 5 > 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS temp FROM events)"""
GAPS = """g AS (SELECT *, lead(t) OVER w - t AS gap, row_number() OVER w AS n, lead(t) OVER w AS t2, lead(depth) OVER w AS d2, lead(temp) OVER w AS p2 FROM s WINDOW w AS (PARTITION BY dive ORDER BY t, seq)),
c AS (SELECT dive, gap, count(*) AS m, min(n) AS f FROM g WHERE gap > 0 GROUP BY dive, gap),
r AS (SELECT dive, arg_max(gap, (m, -f)) AS rate, count(*) AS kinds FROM c GROUP BY dive)"""


def samples(t):
    k = F.get_json_object("props", "$.k").cast("int")
    hour = F.floor(F.unix_micros(C("ts").cast("timestamp")) / 3600000000).cast("long")
    return t.events.select(C("user_id").alias("dive"), hour.alias("t"), C("event_id").alias("seq"), C("event_type").alias("kind"), C("value").alias("depth"), F.when(k % 5 > 0, k.cast("double")).alias("temp"))


@query("series_modal_spacing", f"WITH {S}, {GAPS} SELECT DISTINCT s.dive, coalesce(rate, 1) AS rate FROM s LEFT JOIN r USING (dive)")
def modal_spacing(t):
    return se.modal_spacing(samples(t))


@query("series_resample", f"""WITH {S}, {GAPS}, b AS (SELECT g.*, rate, coalesce(kinds, 1) AS kinds, min(t) OVER (PARTITION BY g.dive) AS t0 FROM g LEFT JOIN r USING (dive)),
e AS (SELECT *, unnest(range(t0 + CAST(ceil((t - t0) / rate) AS BIGINT) * rate, coalesce(t2, t + 1), rate)) AS x FROM b WHERE kinds > 1 AND (t2 IS NULL OR gap > 0))
SELECT dive, t, depth, temp FROM b WHERE kinds = 1 UNION ALL
SELECT dive, x, round(CASE WHEN t2 IS NULL OR x <= t THEN depth ELSE depth + (d2 - depth) * ((x - t) / gap) END, 9), round(CASE WHEN t2 IS NULL OR x <= t OR temp IS NULL OR p2 IS NULL THEN temp ELSE temp + (p2 - temp) * ((x - t) / gap) END, 9) FROM e""")
def resample(t):
    return se.resample(samples(t), (9, 9))


@query("series_mean_depth", f"WITH {S}, {GAPS} SELECT dive, round(CASE WHEN max(t) > min(t) THEN sum((depth + d2) / 2 * (t2 - t)) / (max(t) - min(t)) ELSE avg(depth) END, 3) AS mean FROM g GROUP BY dive")
def mean_depth(t):
    return se.mean_depth(samples(t))


@query("series_carry_forward", f"""WITH {S} SELECT dive, t, seq, last_value(temp IGNORE NULLS) OVER w AS temp, last_value(x IGNORE NULLS) OVER w AS ndl, last_value(CASE WHEN kind IN ('error', 'view') THEN y END IGNORE NULLS) OVER w AS level FROM
(SELECT *, CASE WHEN kind = 'error' THEN CAST(temp AS INTEGER) END AS x, depth AS y FROM s) q WINDOW w AS (PARTITION BY dive ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def carry_forward(t):
    rows = samples(t).withColumn("ndl", F.when(C("kind") == "error", C("temp").cast("int"))).withColumn("level", F.when(C("kind").isin("error", "view"), C("depth")))
    return se.held(rows, ["temp", "ndl", "level"]).select("dive", "t", "seq", "temp", "ndl", "level")


@query("series_carry_pair", f"""WITH {S}, q AS (SELECT *, CASE WHEN kind = 'error' THEN temp END AS ndl, CASE WHEN kind = 'view' THEN depth END AS stop FROM s),
h AS (SELECT *, max(CASE WHEN ndl IS NOT NULL OR stop IS NOT NULL THEN n END) OVER (PARTITION BY dive ORDER BY n) AS at FROM (SELECT *, row_number() OVER (PARTITION BY dive ORDER BY t, seq) AS n FROM q))
SELECT h.dive, h.t, h.seq, o.ndl, o.stop FROM h LEFT JOIN h o ON o.dive = h.dive AND o.n = h.at""")
def carry_pair(t):
    rows = samples(t).withColumn("ndl", F.when(C("kind") == "error", C("temp"))).withColumn("stop", F.when(C("kind") == "view", C("depth")))
    return se.held(rows, [], [["ndl", "stop"]]).select("dive", "t", "seq", "ndl", "stop")


@query("series_sticky_decode", f"""WITH {S}, n AS (SELECT *, row_number() OVER (PARTITION BY dive ORDER BY t, seq) AS n FROM s), h AS (SELECT *, max(CASE WHEN kind IN ('click', 'view') THEN n END) OVER (PARTITION BY dive ORDER BY n) AS at FROM n)
SELECT h.dive, h.t, h.seq, o.temp FROM h LEFT JOIN n o ON o.dive = h.dive AND o.n = h.at""")
def sticky_decode(t):
    return se.sticky(samples(t), "temp", C("kind").isin("click", "view")).select("dive", "t", "seq", "temp")


@query("series_sticky_encode", f"""WITH {S}, k AS (SELECT *, lag(temp) OVER (PARTITION BY dive ORDER BY t, seq) AS before FROM s WHERE temp IS NOT NULL) SELECT dive, t, seq, temp FROM k WHERE temp <> coalesce(before, 0)""")
def sticky_encode(t):
    return se.changes(samples(t), "temp", F.lit(0.0)).select("dive", "t", "seq", "temp")


@query("series_mode_changes", f"WITH {S}, k AS (SELECT *, lag(kind) OVER (PARTITION BY dive ORDER BY t, seq) AS before FROM s) SELECT dive, t, seq, kind FROM k WHERE kind IS DISTINCT FROM before")
def mode_changes(t):
    return se.changes(samples(t), "kind").select("dive", "t", "seq", "kind")


@query("series_speed", f"WITH {S} SELECT dive, t, seq, round(coalesce(CASE WHEN t > lag(t) OVER w THEN (depth - lag(depth) OVER w) / (t - lag(t) OVER w) END, 0), 6) AS speed FROM s WINDOW w AS (PARTITION BY dive ORDER BY t, seq)")
def speed(t):
    return se.rate_of_change(samples(t)).select("dive", "t", "seq", F.round("speed", 6).alias("speed"))


@query("series_hysteresis", f"""WITH {S} SELECT dive, t, seq, coalesce(last_value(CASE WHEN depth >= 80 THEN true WHEN depth < 30 THEN false END IGNORE NULLS) OVER (PARTITION BY dive ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS deep FROM s""")
def hysteresis(t):
    return se.hysteresis(samples(t), "depth", 80.0, 30.0).select("dive", "t", "seq", "deep")


@query("series_gas_timeline", f"""WITH {S}, st AS (SELECT dive, min(t) + 24 AS start FROM s GROUP BY dive), w AS (SELECT dive, greatest(t, start) AS t, seq, CAST(depth AS BIGINT) % 4 AS gas FROM s JOIN st USING (dive) WHERE kind = 'signup'
UNION ALL SELECT dive, start, -1, 0 FROM st) SELECT dive, t, arg_max(gas, seq) AS gas FROM w GROUP BY dive, t""".replace("CAST(depth AS BIGINT) % 4", "CAST(trunc(depth) AS BIGINT) % 4"))
def gas_timeline(t):
    s = samples(t)
    starts = s.groupBy("dive").agg((F.min("t") + 24).alias("start"))
    return se.timeline(s.where("kind = 'signup'").withColumn("gas", C("depth").cast("long") % 4), starts)


@query("series_setpoint", f"""WITH {S}, n AS (SELECT *, row_number() OVER (PARTITION BY dive ORDER BY t, seq) AS n, CASE WHEN kind = 'signup' THEN CASE WHEN depth > 50 THEN 1 ELSE 0 END END AS hi FROM s),
h AS (SELECT *, last_value(hi IGNORE NULLS) OVER (PARTITION BY dive ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bef, first_value(hi IGNORE NULLS) OVER (PARTITION BY dive ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS aft FROM n)
SELECT dive, t, seq, CASE coalesce(bef, 1 - aft) WHEN 1 THEN 1.3 WHEN 0 THEN 0.7 END::DOUBLE AS setpoint FROM h""")
def setpoint(t):
    s = samples(t)
    return se.setpoint_in_force(s, s.where("kind = 'signup'").withColumn("to_high", C("depth") > 50), 0.7, 1.3).select("dive", "t", C("seq").cast("long").alias("seq"), "setpoint")


@query("series_ceiling", f"WITH {S}, k AS (SELECT dive, t, CASE WHEN dive % 3 = 0 THEN 0 ELSE round(depth, 1) END AS stop FROM s WHERE kind = 'error'), m AS (SELECT *, max(stop) OVER (PARTITION BY dive) AS deepest FROM k) SELECT dive, t, stop AS depth FROM m WHERE deepest > 0")
def ceiling(t):
    rows = samples(t).withColumn("stop", F.when(C("kind") == "error", F.when(C("dive") % 3 == 0, 0.0).otherwise(F.round("depth", 1))))
    return se.ceiling(rows, "stop")


@query("series_trapezoid", """WITH d AS (SELECT o_orderkey AS dive, 600 + o_orderkey % 3000 AS duration, o_totalprice / 10000 AS deep, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (0.503::DOUBLE + (o_orderkey % 10) / 20.0::DOUBLE) END AS ratio FROM orders),
e AS (SELECT *, greatest(1, CAST(round(duration * CASE WHEN ratio > 0.5 AND ratio < 1 THEN greatest(1 - ratio, 0.01) ELSE 0.2 END) AS BIGINT)) AS edge FROM d)
SELECT dive, 0 AS t, 0.0::DOUBLE AS depth FROM e UNION ALL SELECT dive, edge, round(deep, 6) FROM e UNION ALL SELECT dive, duration - edge, round(deep, 6) FROM e UNION ALL SELECT dive, duration, 0 FROM e""")
def trapezoid(t):
    deep, k = C("o_totalprice") / 10000, C("o_orderkey")
    dives = t.orders.select(k.alias("dive"), (600 + k % 3000).alias("duration"), deep.alias("max_depth"), F.when(k % 4 != 0, (0.503 + (k % 10) / 20.0) * deep).alias("mean_depth"))
    return se.trapezoid(dives).withColumn("depth", F.round("depth", 6))


@query("series_chains", """WITH l AS (SELECT l_suppkey AS owner, l_orderkey * 10 + l_linenumber AS log, epoch(l_shipdate) AS s, epoch(l_shipdate) + l_quantity * 86400 * 0.05 AS e, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS serial FROM lineitem),
o AS (SELECT *, s - lag(e) OVER w AS gap, last_value(serial IGNORE NULLS) OVER (PARTITION BY owner ORDER BY s, log ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM l WINDOW w AS (PARTITION BY owner ORDER BY s, log))
SELECT owner, log, CAST(sum(CASE WHEN coalesce(gap BETWEEN 0 AND 86400, false) AND NOT coalesce(serial <> was, false) THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY s, log ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS chain FROM o""")
def chains(t):
    start = F.unix_timestamp(C("l_shipdate").cast("timestamp")).cast("double")
    logs = t.lineitem.select(C("l_suppkey").alias("owner"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("log"), start.alias("start"), (start + C("l_quantity") * 86400 * 0.05).alias("end"), F.when(C("l_linenumber") % 3 != 0, C("l_returnflag")).alias("serial"))
    return se.chains(logs, 86400).select("owner", "log", "chain")


DAYS = """s AS (SELECT user_id AS dive, CAST(epoch(ts) AS BIGINT) // 86400 // 10 AS log, epoch_us(ts) // 3600000000 AS t, event_id AS seq, value AS depth FROM events WHERE event_type = 'click')"""


def log_samples(t):
    seconds = F.unix_micros(C("ts").cast("timestamp"))
    return t.events.where("event_type = 'click'").select(C("user_id").alias("dive"), F.floor(seconds / 864000000000).cast("long").alias("log"), F.floor(seconds / 3600000000).cast("long").alias("t"), C("event_id").alias("seq"), C("value").alias("depth"))


RATE = """g AS (SELECT *, lead(t) OVER w - t AS gap, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY dive ORDER BY t, seq)),
c AS (SELECT dive, gap, count(*) AS m, min(n) AS f FROM g WHERE gap > 0 GROUP BY dive, gap), r AS (SELECT s.dive, coalesce(x.rate, 1) AS rate FROM (SELECT DISTINCT dive FROM s) s LEFT JOIN (SELECT dive, arg_max(gap, (m, -f)) AS rate FROM c GROUP BY dive) x USING (dive))"""


@query("series_merge_keep_clock", f"""WITH {DAYS.replace('epoch(ts) AS BIGINT', 'trunc(epoch(ts)) AS BIGINT')}, {RATE}, b AS (SELECT s.*, rate, lead(t) OVER w AS t2, lead(log) OVER w AS log2 FROM s JOIN r USING (dive) WINDOW w AS (PARTITION BY dive ORDER BY t, log, seq))
SELECT dive, log, t, depth FROM s UNION ALL SELECT dive, log, unnest(range(t + rate, t2, rate)), depth FROM b WHERE log2 <> log AND t2 - t > rate""")
def merge_keep_clock(t):
    return se.merged_keeping_clock(log_samples(t))


@query("series_merge_close_gap", f"""WITH {DAYS.replace('epoch(ts) AS BIGINT', 'trunc(epoch(ts)) AS BIGINT')}, {RATE}, l AS (SELECT dive, log, min(t) AS f, max(t) AS z FROM s GROUP BY dive, log),
m AS (SELECT l.*, coalesce(lag(z) OVER (PARTITION BY dive ORDER BY f, log) + rate - f, 0) AS d FROM l JOIN r USING (dive)), k AS (SELECT *, sum(d) OVER (PARTITION BY dive ORDER BY f, log ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS by_ FROM m)
SELECT dive, log, CAST(t + by_ AS BIGINT) AS t, depth FROM s JOIN k USING (dive, log)""")
def merge_close_gap(t):
    return se.merged_closing_gaps(log_samples(t))


@query("series_time_shift", "SELECT event_id, ts + INTERVAL 3 HOUR AS local, CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 3 HOUR - to_minutes(CAST(event_id % 3 * 60 AS BIGINT)) END AS utc FROM events")
def time_shift(t):
    rows = t.events.select("event_id", C("ts").cast("timestamp_ntz").alias("local"))
    return se.shifted(rows, C("local") + F.make_dt_interval(hours=F.lit(3)), F.when(C("event_id") % 3 > 0, (C("event_id") % 3 * 60).cast("int")))


@query("series_record_times", "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS t, CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) * 10 AS BIGINT) AS even FROM lineitem")
def record_times(t):
    order = se.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    running = F.sum(C("l_quantity").cast("long")).over(order.rowsBetween(se.Window.unboundedPreceding, 0))
    return t.lineitem.select("l_orderkey", "l_linenumber", running.alias("t"), ((F.row_number().over(order) - 1) * 10).cast("long").alias("even"))


def _between(a, b):
    return f"CASE WHEN t2 IS NULL OR x <= t OR {b} IS NULL THEN {a} ELSE {a} + ({b} - {a}) * ((x - t) / (t2 - t)) END"


@query("series_fixed_grid", f"""WITH {S}, v AS (SELECT *, CASE WHEN kind = 'view' THEN depth * 2 END AS pressure, CASE WHEN kind <> 'click' THEN temp END AS ndl FROM s),
o AS (SELECT *, lead(t) OVER w AS t2, lead(depth) OVER w AS d2, lead(temp) OVER w AS p2, lead(pressure) OVER w AS r2, lead(ndl) OVER w AS n2, min(t) OVER (PARTITION BY dive) AS t0, count(*) OVER (PARTITION BY dive) AS m FROM v WINDOW w AS (PARTITION BY dive ORDER BY t, seq)),
e AS (SELECT *, unnest(range(t0 + CAST(ceil((t - t0) / 5) AS BIGINT) * 5, coalesce(t2, t + 1), 5)) AS x FROM o WHERE m > 1 AND (t2 IS NULL OR t2 > t)),
g AS (SELECT dive, x AS t, round({_between('depth', 'd2')}, 9) AS depth, coalesce(round({_between('temp', 'p2')}, 9), 0.0) AS temp, round({_between('pressure', 'r2')}, 9) AS pressure, round_even({_between('ndl', 'n2')}, 0) AS ndl FROM e),
h AS (SELECT *, last_value(CASE WHEN depth >= 8.5 THEN 1 WHEN depth < 6 THEN 0 END IGNORE NULLS) OVER w AS deep, lag(depth) OVER w AS before, row_number() OVER w AS n FROM g WINDOW w AS (PARTITION BY dive ORDER BY t))
SELECT dive, CAST(n AS INTEGER) AS n, t, depth, temp, pressure, CAST(CASE WHEN ndl IS NULL OR ndl > 99 THEN 99 WHEN ndl < 0 THEN 0 ELSE ndl END AS INTEGER) AS ndl, round(coalesce((before - depth) / 5 * 60.0, 0.0), 6) AS speed,
134217728 + CASE WHEN deep = 1 THEN 65536 ELSE 0 END + CASE WHEN depth <= 1 THEN 67108864 ELSE 0 END AS phase FROM h""")
def fixed_grid(t):
    rows = samples(t).withColumn("pressure", F.when(C("kind") == "view", C("depth") * 2)).withColumn("ndl", F.when(C("kind") != "click", C("temp")))
    return se.fixed_grid(rows, 5, (9, 6))


@query("series_merged_gases", """WITH g AS (SELECT user_id AS dive, CASE event_type WHEN 'click' THEN 1 ELSE 2 END AS log, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type IN ('click', 'view')),
f AS (SELECT dive, log, pos, k % 9 AS o, CASE WHEN k % 3 > 0 THEN 0 END AS he FROM g),
p AS (SELECT dive, o, he, min(CASE log WHEN 1 THEN pos END) AS had, min(CASE log WHEN 2 THEN pos END) AS began FROM f GROUP BY dive, o, he),
e AS (SELECT dive, coalesce(max(CASE log WHEN 1 THEN pos END), -1) AS ended FROM f GROUP BY dive),
n AS (SELECT *, row_number() OVER (PARTITION BY dive ORDER BY began) AS n FROM p WHERE had IS NULL)
SELECT f.dive, f.log, f.pos AS "at", CASE f.log WHEN 1 THEN f.pos ELSE coalesce(p.had, ended + n) END AS place, (f.log = 2 AND p.had IS NULL AND f.pos = p.began) AS new
FROM f JOIN p ON f.dive = p.dive AND f.o = p.o AND f.he IS NOT DISTINCT FROM p.he JOIN e ON e.dive = f.dive LEFT JOIN n ON n.dive = f.dive AND n.o = f.o AND n.he IS NOT DISTINCT FROM f.he""")
def merged_gases(t):
    k = F.get_json_object("props", "$.k").cast("int")
    at = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")).cast("long") - 1
    rows = t.events.where(C("event_type").isin("click", "view")).select(C("user_id").alias("dive"), F.when(C("event_type") == "click", 1).otherwise(2).alias("log"), at.alias("at"), (k % 9).alias("oxygen"), F.when(k % 3 > 0, 0).alias("helium"), F.lit(None).cast("string").alias("mode"))
    return se.merged_gases(rows)


@query("series_switch_markers", f"""WITH {S}, l AS (SELECT dive, t, max(seq % 3) AS gas FROM s GROUP BY dive, t), n AS (SELECT *, row_number() OVER (PARTITION BY dive ORDER BY t) AS n FROM l)
SELECT dive, t, CASE WHEN gas < 2 THEN CASE WHEN dive % 2 = 0 OR dive % 3 = 0 THEN 'Tank ' || (gas + 1) ELSE 'mix ' || gas END END AS label FROM n WHERE n > 1""")
def switch_markers(t):
    line = samples(t).groupBy("dive", "t").agg(F.max(C("seq") % 3).alias("gas"))
    tanks = samples(t).select("dive").distinct().select("dive", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("gas"))
    mix = F.concat(F.lit("mix "), F.when((C("dive") % 2 == 0) | (C("dive") % 3 == 0), F.lit("0")).otherwise(C("gas").cast("string")))
    return se.switch_markers(line, tanks.select("dive", "gas", mix.alias("name"), F.concat(F.lit("Tank "), (C("gas") + 1).cast("string")).alias("label")))


@query("series_detail", f"""WITH {S}, a AS (SELECT dive, t + 1 AS t FROM s WHERE kind = 'error')
SELECT a.dive, a.t, (SELECT arg_max(s.temp, (s.t, s.seq)) FROM s WHERE s.dive = a.dive AND s.t <= a.t AND s.temp IS NOT NULL) AS temp, (SELECT arg_max(s.depth, (s.t, s.seq)) FROM s WHERE s.dive = a.dive AND s.t <= a.t AND s.depth IS NOT NULL AND s.kind = 'view') AS depth FROM a""")
def detail(t):
    rows = samples(t).withColumn("depth", F.when(C("kind") == "view", C("depth")))
    return se.detail(rows, samples(t).where("kind = 'error'").select("dive", (C("t") + 1).alias("t")), ["temp", "depth"])
