"""Linking queries. Clicks and views of events stand for the two sides' dives."""

import re

from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.functions.geo import distance_m
from tallyweave.operators import linkage as lk
from tallyweave.operators import ranges

C = F.col


def side(t, kind: str, name: str, shift=None, **more):
    rows = t.events.where(F.col("event_type") == kind)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    k = F.get_json_object("props", "$.k").cast("int")
    return lk.dive_side(rows, name, F.col("event_id"), at if shift is None else at + shift, F.col("value"), k * 60, **more)


ACCOUNT = {"account": "user_id"}

#: The two sides in SQL.
SIDES = """
a AS (SELECT event_id AS i, user_id AS account, epoch_us(ts) / 1e6 AS i_at, value AS i_depth, CAST(json_extract(props, '$.k') AS INTEGER) * 60.0 AS i_time FROM events WHERE event_type = 'click'),
b AS (SELECT event_id AS j, user_id AS account, epoch_us(ts) / 1e6 AS j_at, value AS j_depth, CAST(json_extract(props, '$.k') AS INTEGER) * 60.0 AS j_time FROM events WHERE event_type = 'view')"""
MISMATCH = """(CASE WHEN i_depth > 0 AND j_depth > 0 THEN abs(i_depth - j_depth) / greatest(0.5, 0.03 * greatest(i_depth, j_depth)) ELSE 1.0 END
 + CASE WHEN i_time > 0 AND j_time > 0 THEN abs(i_time - j_time) / greatest(90.0, 0.03 * greatest(i_time, j_time)) ELSE 1.0 END)"""
GREEDY = """
ranked AS (SELECT i, j, row_number() OVER (ORDER BY near, mismatch, apart, i, j) AS r FROM edges),
walk(r, ui, uj, i, j) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT e.r, CASE WHEN free THEN list_append(ui, e.i) ELSE ui END, CASE WHEN free THEN list_append(uj, e.j) ELSE uj END, CASE WHEN free THEN e.i END, CASE WHEN free THEN e.j END
  FROM (SELECT w.ui, w.uj, e.*, NOT list_contains(w.ui, e.i) AND NOT list_contains(w.uj, e.j) AS free FROM walk w JOIN ranked e ON e.r = w.r + 1) e),
pairs AS (SELECT i, j FROM walk WHERE i IS NOT NULL)"""
EDGES = f"""edges AS (SELECT i, j, floor(abs(j_at - i_at) / 60) AS near, {MISMATCH} AS mismatch, abs(j_at - i_at) AS apart FROM a JOIN b USING (account) WHERE abs(j_at - i_at) <= 21600)"""


def account_pairs(t):
    return lk.assign(lk.scored(lk.time_edges(side(t, "click", "i", blocks=ACCOUNT), side(t, "view", "j", blocks=ACCOUNT), 21600.0, ["account"])))


@query("link_time_window_match", f"WITH RECURSIVE {SIDES}, {EDGES}, {GREEDY} SELECT i, j FROM pairs")
def time_window_match(t):
    return account_pairs(t)


@query("link_candidates", f"WITH {SIDES}, {EDGES} SELECT i, j, CAST(near AS BIGINT) AS near, round(mismatch, 6) AS mismatch, round(apart, 3) AS apart FROM edges")
def candidates(t):
    e = lk.scored(lk.time_edges(side(t, "click", "i", blocks=ACCOUNT), side(t, "view", "j", blocks=ACCOUNT), 21600.0, ["account"]))
    return e.select("i", "j", "near", F.round("mismatch", 6).alias("mismatch"), F.round("apart", 3).alias("apart"))


@query("link_result_split", f"""WITH RECURSIVE {SIDES}, {EDGES}, {GREEDY}
SELECT 'matched' AS part, i, j FROM pairs UNION ALL SELECT 'only_source', i, NULL FROM a WHERE i NOT IN (SELECT i FROM pairs)
UNION ALL SELECT 'only_target', NULL, j FROM b WHERE j NOT IN (SELECT j FROM pairs)""")
def result_split(t):
    a, b = side(t, "click", "i", blocks=ACCOUNT), side(t, "view", "j", blocks=ACCOUNT)
    pairs = account_pairs(t)
    only_a, only_b = lk.unpaired(a, b, pairs)
    out = pairs.select(F.lit("matched").alias("part"), "i", "j")
    out = out.unionByName(only_a.select(F.lit("only_source").alias("part"), "i", F.lit(None).cast("long").alias("j")))
    return out.unionByName(only_b.select(F.lit("only_target").alias("part"), F.lit(None).cast("long").alias("i"), "j"))


@query("link_key_match", f"""WITH RECURSIVE {SIDES}, edges AS (SELECT i, j, floor(abs(j_at - i_at) / 60) AS near, {MISMATCH} AS mismatch, abs(j_at - i_at) AS apart
FROM a JOIN b USING (account) WHERE i % 7 = j % 7 AND i % 7 > 0 AND abs(j_at - i_at) <= 86400), {GREEDY} SELECT i, j FROM pairs""")
def key_match(t):
    number = (F.col("event_id") % 7).cast("string")
    return lk.assign(lk.key_edges(side(t, "click", "i", number=number, blocks=ACCOUNT), side(t, "view", "j", number=number, blocks=ACCOUNT), ["account"]))


@query("link_stored_ids", "SELECT min(o_orderkey) AS i, o_orderkey // 2 AS j FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey // 2 IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderkey // 2")
def stored_ids(t):
    none = F.lit(0.0)
    k = C("o_orderkey")
    a = lk.dive_side(t.orders, "i", k, none, none, none, own_id=k, other_id=F.when(k % 3 == 0, F.concat(F.lit("L"), F.expr("o_orderkey div 2").cast("string"))).otherwise(""))
    b = lk.dive_side(t.lineitem.select("l_orderkey").distinct(), "j", C("l_orderkey"), none, none, none, own_id=F.concat(F.lit("L"), C("l_orderkey").cast("string")))
    return lk.assign(lk.link_edges(a, b), ("i", "j"))


SHIFTS = """cand AS (SELECT i, j, j_at - i_at AS d FROM a JOIN b USING (account) WHERE i_depth > 0 AND j_depth > 0 AND i_time > 0 AND j_time > 0
  AND abs(i_depth - j_depth) <= greatest(0.5, 0.03 * greatest(i_depth, j_depth)) AND abs(i_time - j_time) <= greatest(90.0, 0.03 * greatest(i_time, j_time))),
e0 AS (SELECT i, j, CAST(round_even(d / 900, 0) * 15 AS INTEGER) AS shift FROM cand WHERE abs(d) > 900 AND abs(d - round_even(d / 900, 0) * 900) <= 180 AND abs(round_even(d / 900, 0) * 15) BETWEEN 30 AND 840)"""


def _round(k: int) -> str:
    return f"""n{k} AS (SELECT e.*, count(*) OVER (PARTITION BY shift) AS n FROM e{k} e),
x{k} AS (SELECT *, max(n) OVER (PARTITION BY i) AS mi, max(n) OVER (PARTITION BY j) AS mj FROM n{k}),
y{k} AS (SELECT *, sum(CASE WHEN n = mi THEN 1 ELSE 0 END) OVER (PARTITION BY i) AS ci, sum(CASE WHEN n = mj THEN 1 ELSE 0 END) OVER (PARTITION BY j) AS cj FROM x{k}),
w{k} AS (SELECT i, j, shift FROM y{k} WHERE n = mi AND n = mj AND ci = 1 AND cj = 1),
e{k + 1} AS (SELECT * FROM e{k} WHERE i NOT IN (SELECT i FROM w{k}) AND j NOT IN (SELECT j FROM w{k}))"""


@query("link_zone_shift_vote", f"WITH {SIDES}, {SHIFTS}, {', '.join(_round(k) for k in range(6))} " + " UNION ALL ".join(f"SELECT i, j, shift FROM w{k}" for k in range(6)))
def zone_shift_vote(t):
    return lk.vote(lk.shift_edges(side(t, "click", "i", blocks=ACCOUNT), side(t, "view", "j", blocks=ACCOUNT), 900.0, ["account"]))


@query("link_shift_support", f"WITH {SIDES}, {SHIFTS} SELECT shift, count(*) AS n FROM e0 GROUP BY shift")
def shift_support(t):
    e = lk.shift_edges(side(t, "click", "i", blocks=ACCOUNT), side(t, "view", "j", blocks=ACCOUNT), 900.0, ["account"])
    return e.groupBy("shift").agg(F.count("*").alias("n"))


def _renamed(sql: str, to: str) -> str:
    return re.sub(r"\b(ranked|walk|edges|pairs)\b", rf"\g<1>{to}", sql)


def _rest(to: int, *pairs: str) -> str:
    gone = " UNION ALL ".join(f"SELECT i, j FROM {p}" for p in pairs)
    return f"a{to} AS (SELECT * FROM a WHERE i NOT IN (SELECT i FROM ({gone}))), b{to} AS (SELECT * FROM b WHERE j NOT IN (SELECT j FROM ({gone})))"


TIERS = ", ".join([
    SIDES, EDGES.replace("21600", "3600"), GREEDY, _rest(2, "pairs"),
    f"edges2 AS (SELECT i, j, floor(abs(j_at - i_at) / 60) AS near, {MISMATCH} AS mismatch, abs(j_at - i_at) AS apart FROM a2 JOIN b2 USING (account) WHERE i % 7 = j % 7 AND i % 7 > 0 AND abs(j_at - i_at) <= 86400)",
    _renamed(GREEDY, "2"), _rest(3, "pairs", "pairs2"), SHIFTS.replace("FROM a JOIN b", "FROM a3 JOIN b3").replace("abs(d) > 900 ", "abs(d) > 3600 "), *[_round(k) for k in range(6)],
])


@query("link_tiers", f"WITH RECURSIVE {TIERS} SELECT i, j, 'time' AS tier FROM pairs UNION ALL SELECT i, j, 'key' FROM pairs2 " + " ".join(f"UNION ALL SELECT i, j, 'shift' FROM w{k}" for k in range(6)))
def tiers(t):
    number = (F.col("event_id") % 7).cast("string")
    return lk.match(side(t, "click", "i", number=number, blocks=ACCOUNT), side(t, "view", "j", number=number, blocks=ACCOUNT), 3600.0, blocks=["account"])


@query("link_removed", """SELECT o_orderkey AS source_id, o_custkey AS target_id, CASE WHEN o_orderkey % 5 > 0 AND o_custkey % 3 > 0 THEN 'kept' WHEN o_orderkey % 5 > 0 THEN 'target_gone'
WHEN o_custkey % 3 > 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN 'source_gone' ELSE 'both_gone' END AS state FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def removed(t):
    links = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id"))
    return lk.removed(links, t.orders.where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("source_id")), t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("target_id")))


@query("link_mirror_extras", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def mirror_extras(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join_as_of", """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, max(event_id) AS src FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT event_id, (SELECT arg_max(src, s.ts) FROM s WHERE s.user_id = e.user_id AND s.ts <= e.ts) AS last_signup FROM e""")
def as_of(t):
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("s"))
    return ranges.as_of(left, right, "ts", ["user_id"], F.col("s"), "last_signup").select("event_id", "last_signup")


@query("join_as_of_clamped", """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, max(event_id) AS src FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT event_id, coalesce((SELECT arg_max(src, s.ts) FROM s WHERE s.user_id = e.user_id AND s.ts <= e.ts), (SELECT arg_min(src, s.ts) FROM s WHERE s.user_id = e.user_id)) AS active FROM e""")
def as_of_clamped(t):
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("s"))
    return ranges.as_of(left, right, "ts", ["user_id"], F.col("s"), "active", clamp=True).select("event_id", "active")


@query("join_nearest_time", f"""WITH {SIDES}, p AS (SELECT i, j, abs(j_at - i_at) AS d FROM a JOIN b USING (account) WHERE abs(j_at - i_at) <= 7200)
SELECT i, arg_min(j, (d, j)) AS j, round(min(d), 3) AS distance FROM p GROUP BY i""")
def nearest_time(t):
    a, b = side(t, "click", "i", blocks=ACCOUNT), side(t, "view", "j", blocks=ACCOUNT)
    return ranges.nearest_in_time(a, b, "i", "j", "i_local", "j_local", 7200.0, ["account"]).select("i", "j", F.round("distance", 3).alias("distance"))


PLACE = "((k * 7919) % 14000) / 100.0 - 70.0"
PLACES = """c AS (SELECT c_custkey AS cust, ((c_custkey * 7919) % 14000) / 100.0 - 70.0 AS lat, ((c_custkey * 104729) % 36000) / 100.0 - 180.0 AS lng FROM customer),
s AS (SELECT s_suppkey AS supp, ((s_suppkey * 7907) % 14000) / 100.0 - 70.0 AS lat2, ((s_suppkey * 104723) % 36000) / 100.0 - 180.0 AS lng2 FROM supplier)"""
HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng) / 2), 2))))"


def places(t):
    c = t.customer.selectExpr("c_custkey as cust", "((c_custkey * 7919) % 14000) / 100.0D - 70.0D as lat", "((c_custkey * 104729) % 36000) / 100.0D - 180.0D as lng")
    s = t.supplier.selectExpr("s_suppkey as supp", "((s_suppkey * 7907) % 14000) / 100.0D - 70.0D as lat2", "((s_suppkey * 104723) % 36000) / 100.0D - 180.0D as lng2")
    return c, s


@query("join_nearest_place", f"WITH {PLACES}, p AS (SELECT cust, supp, {HAVERSINE} AS m FROM c, s) SELECT cust, arg_min(supp, (m, supp)) AS supp, round(min(m), 3) AS metres FROM p WHERE m <= 500000 GROUP BY cust")
def nearest_place(t):
    c, s = places(t)
    found = ranges.nearest_place(c, s, 500_000.0, ("cust", "lat", "lng"), ("supp", "lat2", "lng2"))
    return found.select("cust", "supp", F.round("metres", 3).alias("metres"))


@query("fn_distance", f"WITH {PLACES} SELECT cust, round({HAVERSINE}, 3) AS metres FROM c JOIN s ON cust % 100 = supp")
def distance(t):
    c, s = places(t)
    return c.join(s, F.col("cust") % 100 == F.col("supp")).select("cust", F.round(distance_m(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), 3).alias("metres"))


@query("fn_zone_shift", "WITH d AS (SELECT event_id, (event_id * 137 % 120000) - 60000.0 AS d FROM events) SELECT event_id, CASE WHEN abs(d) > 900 AND abs(d - round_even(d / 900, 0) * 900) <= 180 AND abs(round_even(d / 900, 0) * 15) BETWEEN 30 AND 840 THEN CAST(round_even(d / 900, 0) * 15 AS INTEGER) END AS shift FROM d")
def zone_shift(t):
    return t.events.select("event_id", lk.zone_shift((F.col("event_id") * 137 % 120000 - 60000).cast("double"), 900.0).alias("shift"))


@query("fn_shift_text", "WITH d AS (SELECT event_id, CAST(event_id % 1700 AS INTEGER) - 850 AS m FROM events) SELECT event_id, (CASE WHEN m < 0 THEN '-' ELSE '+' END) || (abs(m) // 60) || ':' || lpad(CAST(abs(m) % 60 AS VARCHAR), 2, '0') AS shift FROM d")
def shift_text(t):
    return t.events.select("event_id", lk.shift_text((F.col("event_id") % 1700 - 850).cast("int")).alias("shift"))


@query("join_nearest_place_pole", f"""WITH c AS (SELECT c_custkey AS cust, 90 - (c_custkey % 40) / 200.0 AS lat, ((c_custkey * 7919) % 36000) / 100.0 - 180.0 AS lng FROM customer),
s AS (SELECT s_suppkey AS supp, 90 - (s_suppkey % 50) / 250.0 AS lat2, ((s_suppkey * 104723) % 36000) / 100.0 - 180.0 AS lng2 FROM supplier),
p AS (SELECT cust, supp, {HAVERSINE} AS m FROM c, s) SELECT cust, round(min(m), 3) AS metres FROM p WHERE m <= 2000 GROUP BY cust""")
def nearest_place_pole(t):
    c = t.customer.selectExpr("c_custkey as cust", "90 - (c_custkey % 40) / 200.0D as lat", "((c_custkey * 7919) % 36000) / 100.0D - 180.0D as lng")
    s = t.supplier.selectExpr("s_suppkey as supp", "90 - (s_suppkey % 50) / 250.0D as lat2", "((s_suppkey * 104723) % 36000) / 100.0D - 180.0D as lng2")
    return ranges.nearest_place(c, s, 2000.0, ("cust", "lat", "lng"), ("supp", "lat2", "lng2")).select("cust", F.round("metres", 3).alias("metres"))
