"""Aggregates, run history and change detection. Orders stand for runs: priority the job, status the outcome."""

from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.operators import history as hs
from tallyweave.operators import tables as tb
from tallyweave.operators.series import Window

C = F.col
KIND = "CASE l_linenumber % 6 WHEN 0 THEN 'uploaded_to_a' WHEN 1 THEN 'updated_on_b' WHEN 2 THEN 'deleted_on_a' WHEN 3 THEN 'skipped_on_b' WHEN 4 THEN 'failed' ELSE 'conflicts' END"


def actions(t):
    kinds = F.array(*[F.lit(x) for x in ("uploaded_to_a", "updated_on_b", "deleted_on_a", "skipped_on_b", "failed", "conflicts")])
    return t.lineitem.select(C("l_orderkey").alias("run"), F.element_at(kinds, C("l_linenumber") % 6 + 1).alias("action"))


@query("agg_action_counts", f"SELECT l_orderkey AS run, {KIND} AS action, count(*) AS n FROM lineitem GROUP BY 1, 2 UNION ALL SELECT DISTINCT l_orderkey, 'matched', 0 FROM lineitem")
def action_counts(t):
    return hs.count_actions(actions(t), always=("matched",))


@query("agg_action_totals", f"WITH a AS (SELECT l_orderkey AS run, {KIND} AS k FROM lineitem) SELECT run, count(*) FILTER (k = 'uploaded_to_a') AS added, count(*) FILTER (k = 'updated_on_b') AS updated, count(*) FILTER (k = 'deleted_on_a') AS deleted, count(*) FILTER (k = 'skipped_on_b') AS skipped, count(*) FILTER (k = 'failed') AS failed, count(*) FILTER (k = 'conflicts') AS conflicts FROM a GROUP BY run")
def action_totals(t):
    return hs.totals(actions(t))


@query("agg_notify", f"WITH a AS (SELECT l_orderkey AS run, {KIND} AS k FROM lineitem) SELECT run, run % 3 = 0 OR (run % 3 = 1 AND run % 4 > 0 AND count(*) FILTER (k <> 'skipped_on_b') > 0) AS tell FROM a GROUP BY run")
def notify(t):
    on = F.when(C("run") % 3 == 0, "always").when(C("run") % 3 == 1, "changes").otherwise("failure")
    return hs.totals(actions(t)).select("run", hs.worth_telling(on, C("run") % 4 == 0).alias("tell"))


@query("agg_latest_run", "SELECT o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_run(t):
    return hs.latest(t.orders.select("o_orderpriority", "o_orderkey", "o_orderdate"), "o_orderpriority", "o_orderdate", "o_orderkey").select("o_orderpriority", "o_orderkey")


@query("hist_newest_runs", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def newest_runs(t):
    return hs.newest(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey", 3).select("o_orderkey", "o_custkey")


@query("hist_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def hist_filter(t):
    return tb.history(t.orders, "o_orderdate", "o_orderkey", 50, o_orderpriority="1-URGENT", o_orderstatus="F").select("o_orderkey")


@query("hist_by_id_prefix", "SELECT o_orderkey, sha1(CAST(o_orderkey AS VARCHAR)) AS id FROM orders WHERE starts_with(sha1(CAST(o_orderkey AS VARCHAR)), 'ab')")
def by_id_prefix(t):
    return tb.by_id(t.orders.select("o_orderkey", F.sha1(C("o_orderkey").cast("string").cast("binary")).alias("id")), "id", "ab")


@query("hist_replace_pairs", "SELECT l_orderkey, l_linenumber, 'old' AS v FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0")
def replace_pairs(t):
    seen = t.orders.where("o_orderstatus = 'P'").select(C("o_orderkey").alias("l_orderkey"))
    new = seen.where("l_orderkey % 2 = 0").select("l_orderkey", F.lit(0).alias("l_linenumber"), F.lit("new").alias("v"))
    return hs.replace_pairs(t.lineitem.select("l_orderkey", "l_linenumber", F.lit("old").alias("v")), seen, new, ["l_orderkey"])


@query("hist_prune_rules", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (SELECT o_orderstatus, 'F' FROM orders UNION ALL SELECT 'A', 'F')")
def prune_rules(t):
    rules = t.orders.select(C("o_orderstatus").alias("l_returnflag"), F.lit("F").alias("l_linestatus")).unionByName(t.spark.range(1).select(F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus")))
    return tb.pruned(t.lineitem, rules, ["l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber")


@query("sink_prune", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def prune(t):
    keep = t.orders.where("o_orderstatus = 'P'").select(C("o_custkey").alias("c_custkey")).distinct()
    return hs.prune_files(t.customer.select("c_custkey"), keep, "c_custkey")


@query("scan_changed_listing", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'new' WHEN o_orderkey % 5 = 0 THEN 'incomplete' ELSE 'changed' END AS reason FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0")
def changed_listing(t):
    before = t.orders.where("o_orderkey % 7 > 0").withColumn("o_orderstatus", F.when(C("o_orderkey") % 3 == 0, "Z").otherwise(C("o_orderstatus"))).withColumn("incomplete", C("o_orderkey") % 5 == 0)
    return hs.stale(t.orders, before, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("agg_profile_extremes", "SELECT user_id, round(max(value), 2) AS deepest, round(min(value), 2) AS shallowest, arg_max(event_id, (value, -event_id)) AS deepest_at FROM events GROUP BY user_id")
def profile_extremes(t):
    return t.events.groupBy("user_id").agg(F.round(F.max("value"), 2).alias("deepest"), F.round(F.min("value"), 2).alias("shallowest"), F.max_by("event_id", F.struct("value", -C("event_id"))).alias("deepest_at"))


@query("agg_first_last_reading", "SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1, 2")
def first_last(t):
    order = F.struct("ts", "event_id")
    return t.events.groupBy("user_id", "event_type").agg(F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"))


@query("agg_distinct_first_seen", "SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY f) AS flags FROM (SELECT l_orderkey, l_returnflag, min((l_linenumber, l_partkey, l_extendedprice)) AS f FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey")
def first_seen(t):
    rows = tb.first_seen(t.lineitem, ["l_orderkey"], "l_returnflag", "l_linenumber", "l_partkey", "l_extendedprice", to="flags")
    return rows.select("l_orderkey", F.array_join("flags", ",").alias("flags"))


@query("agg_next_number", "SELECT c_nationkey, max(c_custkey) + 1 AS next FROM customer GROUP BY 1")
def next_number(t):
    return tb.next_number(t.customer, ["c_nationkey"], "c_custkey")


@query("agg_consistency", "SELECT l_orderkey, abs(max(l_quantity) - 40) <= 1 AND max(CASE WHEN l_quantity > 0 THEN l_linenumber END) <= 7 AS consistent FROM lineitem GROUP BY 1")
def consistency(t):
    return t.lineitem.groupBy("l_orderkey").agg(((F.abs(F.max("l_quantity") - 40) <= 1) & (F.max(F.when(C("l_quantity") > 0, C("l_linenumber"))) <= 7)).alias("consistent"))


@query("agg_merge_summary", "SELECT user_id, round(avg(value), 6) AS mean, round(max(value), 2) AS deepest, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last FROM events GROUP BY user_id")
def merge_summary(t):
    return t.events.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 2).alias("deepest"), F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last"))


@query("agg_sum_weights", "SELECT l_orderkey, round(sum(l_tax), 4) AS weight FROM lineitem GROUP BY 1")
def sum_weights(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_tax"), 4).alias("weight"))


@query("agg_group_conflicts", "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS conflicts FROM orders GROUP BY 1")
def group_conflicts(t):
    rows = tb.in_groups(t.orders, ["o_custkey"], "o_orderkey")
    return rows.select("o_custkey", F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("conflicts"))


@query("agg_channel_names", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY 1")
def channel_names(t):
    return tb.union_of(t.events, ["user_id"], "event_type").select("user_id", F.array_join("values", ",").alias("names"))


@query("agg_primary_transmitter", "SELECT l_orderkey, min(l_linenumber) AS transmitter FROM lineitem WHERE l_discount > 0 GROUP BY 1")
def primary_transmitter(t):
    return t.lineitem.where("l_discount > 0").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("transmitter"))


@query("agg_date_span", "SELECT o_custkey, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders GROUP BY 1")
def date_span(t):
    return tb.span(t.orders, ["o_custkey"], C("o_orderdate").cast("timestamp_ntz"))


@query("agg_next_due", "SELECT user_id, min(ts + to_minutes(CAST(event_id % 60 AS BIGINT))) AS due FROM events GROUP BY 1")
def next_due(t):
    return t.events.groupBy("user_id").agg(F.min(C("ts").cast("timestamp_ntz") + F.make_dt_interval(mins=(C("event_id") % 60).cast("int"))).alias("due"))


@query("agg_newest_zone", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS zone FROM events GROUP BY 1")
def newest_zone(t):
    return tb.newest_value(t.events, ["user_id"], "event_type", "ts", "event_id", to="zone")


@query("agg_numbering", "SELECT e.event_id, n.top + row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS number FROM events e JOIN (SELECT user_id, max(event_id % 100) AS top FROM events GROUP BY 1) n USING (user_id) WHERE e.event_type = 'signup'")
def numbering(t):
    top = t.events.groupBy("user_id").agg(F.max(C("event_id") % 100).alias("top"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.where("event_type = 'signup'").join(top, "user_id").select("event_id", (C("top") + F.row_number().over(order)).alias("number"))


@query("agg_merged_dives", """WITH p AS (SELECT l_orderkey AS dive, l_linenumber * 1000 + l_partkey AS ord, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000 + l_partkey, l_extendedprice, l_quantity) AS i, * FROM lineitem)
SELECT dive, sum(l_quantity * 4) / (4 * count(*)) AS mean_depth, max(l_quantity) AS max_depth, CASE WHEN min(l_linenumber) > 1 THEN sum(l_linenumber) END::BIGINT AS bottom_time, sum(l_suppkey)::BIGINT AS oxygen_units, sum(l_quantity) AS used,
arg_max(l_discount, i) FILTER (l_linenumber % 2 = 0) AS cns, arg_max(l_tax, i) AS nitrogen, arg_max(l_quantity, i) FILTER (l_linenumber < 5) AS pressure, arg_max(l_discount, i) AS lat, arg_max(l_tax, i) AS lng,
round(arg_max(l_extendedprice + 60, i) - arg_min(l_extendedprice, i), 2) AS elapsed FROM p GROUP BY dive""")
def merged_dives(t):
    n, q = C("l_linenumber"), C("l_quantity")
    parts = t.lineitem.select(
        C("l_orderkey").alias("dive"), (n * 1000 + C("l_partkey")).alias("ord"), C("l_extendedprice").alias("start"), F.lit(60).alias("seconds"), F.lit(4).alias("depths"), (q * 4).alias("depth_sum"), q.alias("max_depth"), F.when(n > 1, n).alias("bottom_time"),
        C("l_suppkey").alias("oxygen_units"), q.alias("used"), F.when(n % 2 == 0, C("l_discount")).alias("cns"), C("l_tax").alias("nitrogen"), F.when(n < 5, q).alias("pressure"), C("l_discount").alias("lat"), C("l_tax").alias("lng"),
    )
    return tb.merged(parts, "dive", "ord").withColumn("elapsed", F.round("elapsed", 2))


@query("join_found_uploads", """SELECT s.event_id AS i, arg_min(l.event_id, (-epoch_us(l.ts), l.event_id)) AS j FROM events s JOIN events l ON l.event_type = 'view' AND abs(epoch_us(s.ts) - epoch_us(l.ts)) <= 120000000 WHERE s.event_type = 'click' GROUP BY s.event_id""")
def found_uploads(t):
    at = F.unix_micros(C("ts").cast("timestamp")) / 1e6
    of = lambda kind, key: t.events.where(C("event_type") == kind).select(C("event_id").alias(key), at.alias("at"))
    return tb.found_uploads(of("click", "i"), of("view", "j"))
