"""Filters, comparisons and array functions."""

from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.functions import compare as cm
from tallyweave.functions.geo import same_position
from tallyweave.operators import tables as tb
from tallyweave.operators.linkage import profiles_agree

C = F.col


@query("scan_time_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10'")
def time_range(t):
    return t.events.where(C("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-10").cast("timestamp_ntz"))).select("event_id", C("ts").cast("timestamp_ntz").alias("ts"))


@query("scan_newest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10")
def newest(t):
    return t.events.orderBy(F.desc("ts"), "event_id").limit(10).select("event_id", C("ts").cast("timestamp_ntz").alias("ts"))


@query("scan_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
def point_lookup(t):
    return t.orders.where("o_orderkey = 77").withColumn("o_orderdate", C("o_orderdate").cast("timestamp_ntz"))


@query("scan_point_window", "SELECT e.event_id FROM events e, events p WHERE p.event_id = 77 AND e.ts BETWEEN p.ts - INTERVAL 1 DAY AND p.ts + INTERVAL 1 DAY")
def point_window(t):
    p = t.events.where("event_id = 77").select(C("ts").cast("timestamp_ntz").alias("at"))
    return t.events.join(F.broadcast(p), F.expr("cast(ts as timestamp_ntz) between at - interval 1 day and at + interval 1 day")).select("event_id")


@query("scan_high_water", "WITH m AS (SELECT max(ts) - INTERVAL 3 DAY AS mark FROM events WHERE event_type = 'error') SELECT event_id FROM events, m WHERE ts >= greatest(TIMESTAMP '2024-01-02', mark - INTERVAL 1 DAY)")
def high_water(t):
    mark = t.events.where("event_type = 'error'").agg((F.max(C("ts").cast("timestamp_ntz")) - F.expr("interval 3 days")).alias("mark"))
    return t.events.join(F.broadcast(mark), C("ts").cast("timestamp_ntz") >= F.greatest(F.lit("2024-01-02").cast("timestamp_ntz"), C("mark") - F.expr("interval 1 day"))).select("event_id")


@query("scan_kinds", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def kinds(t):
    return t.events.where(F.coalesce(C("event_type"), F.lit("")).isin("click", "view")).select("event_id")


@query("pred_first_truthy", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_discount WHEN l_tax <> 0 THEN l_tax ELSE l_quantity END AS v FROM lineitem")
def first_truthy(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", cm.first_truthy(C("l_discount"), C("l_tax"), C("l_quantity")).alias("v"))


@query("pred_empty", "SELECT o_orderkey, o_orderkey % 4 < 2 AS text_empty, o_orderkey % 4 = 3 AS number_empty, o_orderkey % 4 <> 2 AS gps_empty, o_orderkey % 4 IN (0, 1) AS list_empty FROM orders")
def empty(t):
    k = C("o_orderkey") % 4
    text = F.when(k == 0, "  ").when(k == 1, "None").otherwise(C("o_orderpriority"))
    number = F.when(k != 3, F.lit(0.0))
    gps = F.when(k != 0, F.struct(F.lit(1.0).alias("lat"), F.when(k == 2, F.lit(2.0)).alias("lng")))
    items = F.when(k == 1, F.array().cast("array<string>")).when(k > 1, F.array("o_orderpriority"))
    return t.orders.select("o_orderkey", cm.empty("text", text).alias("text_empty"), cm.empty("number", number).alias("number_empty"), cm.empty("gps", gps).alias("gps_empty"), cm.empty("list", items).alias("list_empty"))


@query("pred_same_text", "SELECT o_orderkey, o_orderkey % 3 < 2 AS same FROM orders")
def same_text(t):
    k = C("o_orderkey") % 3
    return t.orders.select("o_orderkey", cm.same("text", C("o_orderpriority"), F.when(k == 0, F.concat(F.lit(" "), "o_orderpriority")).when(k == 1, C("o_orderpriority")).otherwise("None")).alias("same"))


def tank():
    return F.struct(F.lit(21.0).alias("oxygen"), F.lit(0.0).alias("helium"), C("l_extendedprice").alias("start"), C("l_quantity").alias("end"), F.lit(12.0).alias("volume"), F.when(C("l_linenumber") % 2 == 0, F.concat(F.lit("T"), C("l_linenumber").cast("string"))).alias("name"))


def tank_lists(t, *extra):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", tank().alias("t")))).alias("x"))
    return rows.withColumn("a", F.transform("x", lambda x: x["t"]))


@query("pred_same_tanks", """SELECT l_orderkey, l_orderkey % 3 < 2 OR (l_orderkey % 3 = 2 AND sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) = 0) AS same, l_orderkey % 3 <> 1 OR sum(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END) = 0 AS back FROM lineitem GROUP BY l_orderkey""")
def same_tanks(t):
    k = C("l_orderkey") % 3
    moved = F.transform("a", lambda x: F.when(k == 0, x.withField("start", x["start"] + 0.4)).when(k == 1, x.withField("name", F.coalesce(x["name"], F.lit("given")))).otherwise(x.withField("name", F.lit(None).cast("string"))))
    rows = tank_lists(t).withColumn("b", moved)
    return rows.select("l_orderkey", cm.same("tanks", C("a"), C("b")).alias("same"), cm.same("tanks", C("b"), C("a")).alias("back"))


@query("fn_keep_tank_names", """SELECT l_orderkey, string_agg(CASE WHEN l_linenumber % 2 = 0 THEN 'T' || l_linenumber ELSE 'old' || pos END, ',' ORDER BY pos) AS names FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem) q GROUP BY l_orderkey""")
def keep_tank_names(t):
    rows = tank_lists(t).withColumn("old", F.transform("a", lambda x, i: x.withField("name", F.concat(F.lit("old"), (i + 1).cast("string")))))
    return rows.select("l_orderkey", F.array_join(F.transform(cm.keep_names(C("a"), C("old")), lambda x: x["name"]), ",").alias("names"))


@query("pred_same_profile", "SELECT l_orderkey, l_orderkey % 3 <> 1 AS same FROM lineitem GROUP BY l_orderkey")
def same_profile(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(C("l_linenumber").alias("t"), C("l_quantity").alias("depth"), C("l_tax").alias("temp")))).alias("a"))
    k = C("l_orderkey") % 3
    b = F.transform("a", lambda x: x.withField("depth", x["depth"] + F.when(k == 0, 0.005).when(k == 1, 0.07).otherwise(0.0)))
    return rows.select("l_orderkey", cm.same_profile(C("a"), b).alias("same"))


@query("pred_same_profile_off_grid", """WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k AS l_orderkey, CASE WHEN n < 3 THEN TRUE WHEN n < 5 THEN FALSE ELSE k % 3 <> 1 END AS same, CASE WHEN n < 3 THEN n WHEN n = 3 THEN 2 WHEN n = 4 THEN 2 ELSE n END AS points FROM n""")
def same_profile_off_grid(t):
    """The other log lacks the second of three or more samples, so it has another spacing; from five samples on the most frequent one is still the same."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    bend = lambda i: F.when((C("l_orderkey") % 3 == 1) & (i == 1), 0.5).otherwise(0.0)
    sample = lambda i: F.struct(((i + 1) * 10).alias("t"), (i * 1.5 + bend(i)).alias("depth"), F.when((i > 1) | ((i > 0) & (C("n") < 3)), 20 - i * 0.5).alias("temp"))
    rows = lines.withColumn("a", F.transform(F.sequence(F.lit(0), C("n") - 1), sample))
    rows = rows.withColumn("b", F.when(C("n") < 3, C("a")).otherwise(F.filter("a", lambda x: x["t"] != 20)))
    # each log goes on its grid once, for the comparison and for the count of points
    rows = rows.select("l_orderkey", cm.resampled(C("a")).alias("a"), cm.resampled(C("b")).alias("b"))
    return rows.select("l_orderkey", cm.same_profile(C("a"), C("b"), on_grid=True).alias("same"), F.size("b").cast("long").alias("points"))


@query("pred_same_position", """WITH p AS (SELECT c_custkey, c_custkey % 90 * 0.7::DOUBLE AS lat, c_custkey % 179 * 1.0::DOUBLE AS lng, CASE c_custkey % 3 WHEN 0 THEN 0.000004 WHEN 1 THEN 0.001 ELSE 0.004 END::DOUBLE AS d FROM customer)
SELECT c_custkey, d < 0.002 AS same FROM p""")
def same_positions(t):
    lat, lng = C("c_custkey") % 90 * 0.7, C("c_custkey") % 179 * 1.0
    d = F.when(C("c_custkey") % 3 == 0, 0.000004).when(C("c_custkey") % 3 == 1, 0.001).otherwise(0.004)
    return t.customer.select("c_custkey", same_position(lat, lng, lat + d, lng).alias("same"))


@query("pred_same_key", "SELECT o_orderkey, o_orderkey > 0 AND o_orderkey % 3 < 2 AS same FROM orders")
def same_key(t):
    k = C("o_orderkey").cast("string")
    other = F.when(C("o_orderkey") % 3 == 0, F.concat(F.lit(" "), k, F.lit(".0"))).when(C("o_orderkey") % 3 == 1, k).otherwise("x")
    return t.orders.select("o_orderkey", cm.same_key(k, other).alias("same"))


@query("pred_profiles_agree", """SELECT l_orderkey, l_linenumber, l_quantity > 0 AND l_tax > 0 AND abs(l_quantity * (l_discount / 2)) <= greatest(0.5, 0.03 * l_quantity * (1 + l_discount / 2)) AS agree FROM lineitem""")
def agree(t):
    q = C("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", profiles_agree(q, C("l_tax") * 10000, q + q * (C("l_discount") / 2), C("l_tax") * 10000).alias("agree"))


@query("pred_exists_in_array", "SELECT l_orderkey, bool_or(l_discount >= 0.09) AS any_deep FROM lineitem GROUP BY l_orderkey")
def exists_in_array(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("d"))
    return rows.select("l_orderkey", F.exists("d", lambda x: x >= 0.09).alias("any_deep"))


@query("pred_validation", """SELECT l_orderkey, l_linenumber, coalesce(list_aggregate(list_filter([CASE WHEN l_quantity > 45 THEN 'depth' END, CASE WHEN l_discount + l_tax > 0.15 THEN 'mix' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag' END], lambda x: x IS NOT NULL), 'string_agg', ','), '') AS errors FROM lineitem""")
def validation(t):
    checks = {"depth": C("l_quantity").between(0, 45), "mix": C("l_discount") + C("l_tax") <= 0.15, "flag": C("l_returnflag").isin("A", "N")}
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(cm.problems(checks), ",").alias("errors"))


@query("pred_column_diff", """SELECT o_orderkey, 'o_orderstatus' AS field, 'X' AS value FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'o_orderpriority', 'none' FROM orders WHERE o_orderkey % 3 = 0""")
def column_diff(t):
    want = {"o_orderstatus": (C("o_orderstatus"), F.when(C("o_orderkey") % 2 == 0, "X").otherwise(C("o_orderstatus"))), "o_orderpriority": (C("o_orderpriority"), F.when(C("o_orderkey") % 3 == 0, "none").otherwise(C("o_orderpriority")))}
    return t.orders.select("o_orderkey", F.explode(cm.changed(want)).alias("c")).select("o_orderkey", "c.field", "c.value")


@query("sort_blanks_last", "SELECT o_orderkey, nullif(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE lower(o_orderpriority) END, '') AS v FROM orders ORDER BY v DESC NULLS LAST, o_orderkey")
def blanks_last(t):
    rows = t.orders.select("o_orderkey", F.when(C("o_orderkey") % 5 != 0, F.lower("o_orderpriority")).alias("v"))
    return tb.in_users_order(rows, "text", "v", "o_orderkey", down=True)


@query("set_keep_first", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def keep_first(t):
    return tb.keep_first(t.events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("set_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def difference(t):
    return tb.absent(t.orders, t.customer.where("c_acctbal > 0").select(C("c_custkey").alias("o_custkey")), ["o_custkey"])


@query("set_intersection", "SELECT s_suppkey AS k FROM supplier INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def intersection(t):
    return tb.shared(t.supplier.select(C("s_suppkey").alias("k")), t.customer.where("c_custkey % 2 = 0").select("c_custkey"))


@query("set_concat_provenance", "SELECT s_name AS name, 'supplier' AS origin FROM supplier UNION ALL SELECT c_name, 'customer' FROM customer")
def concat(t):
    return tb.concatenated({"supplier": t.supplier.select(C("s_name").alias("name")), "customer": t.customer.select(C("c_name").alias("name"))})


@query("set_upsert", "SELECT o_orderkey, 'new' AS v FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0")
def upsert(t):
    new = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("v"))
    old = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", C("o_orderpriority").alias("v"))
    return tb.upserted(old, new, ["o_orderkey"])


@query("set_unjoined_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE NOT (a.n_regionkey = b.n_regionkey)")
def unjoined_pairs(t):
    a = t.nation.select(C("n_nationkey").alias("x"), "n_regionkey")
    links = a.join(a.withColumnRenamed("x", "y"), "n_regionkey").where("x > y")
    return tb.unjoined(t.nation, "n_nationkey", links, "x", "y")


@query("array_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract(props, '$.missing') IS NULL AS missing FROM events")
def json_path(t):
    v = F.parse_json("props")
    return t.events.select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.missing", "int").isNull().alias("missing"))


@query("array_zip_padded", """SELECT l_orderkey, string_agg(a || '/' || coalesce(CAST(b AS VARCHAR), '-'), ',' ORDER BY a) AS zipped FROM (SELECT l_orderkey, l_linenumber AS a, CASE WHEN l_linenumber <= 2 THEN l_linenumber * 10 END AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY l_orderkey""")
def zip_padded(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("a"))
    rows = rows.withColumn("b", F.transform(F.filter("a", lambda x: x <= 2), lambda x: x * 10)).withColumn("z", F.transform("a", lambda x: F.struct(x.alias("a"), F.try_element_at(F.map_from_arrays(F.filter("a", lambda y: y <= 2), "b"), x).alias("b"))))
    return rows.select("l_orderkey", F.array_join(F.transform("z", lambda x: F.concat(x["a"].cast("string"), F.lit("/"), F.coalesce(x["b"].cast("string"), F.lit("-")))), ",").alias("zipped"))


@query("array_reindex", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS INTEGER) AS slot FROM lineitem WHERE l_discount > 0.02")
def reindex(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_discount"))).alias("x"))
    return rows.select("l_orderkey", F.posexplode(F.filter("x", lambda x: x["l_discount"] > 0.02)).alias("slot", "x")).select("l_orderkey", "x.l_linenumber", "slot")


@query("array_pruned_json", """SELECT o_orderkey, '{"id":' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ',"status":"' || o_orderstatus || '"' ELSE '' END || '}' AS body FROM orders""")
def pruned_json(t):
    return t.orders.select("o_orderkey", F.to_json(F.struct(C("o_orderkey").alias("id"), F.when(C("o_orderkey") % 2 == 0, C("o_orderstatus")).alias("status"))).alias("body"))


@query("array_map_merge", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS a, 3 AS b FROM events")
def map_merge(t):
    old, new = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(3)), F.when(C("event_id") % 2 == 0, F.create_map(F.lit("a"), F.lit(2))).otherwise(F.create_map().cast("map<string,int>"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return t.events.select("event_id", merged["a"].alias("a"), merged["b"].alias("b"))
