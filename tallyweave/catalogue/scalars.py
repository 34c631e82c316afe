"""Scalar functions over the driver's text, number and time columns."""

from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.functions import text as tx
from tallyweave.functions import times as tm
from tallyweave.functions import units as un

C = F.col


@query("text_normalize", r"""SELECT o_orderkey, CASE WHEN t IS NULL OR t = 'None' THEN '' ELSE regexp_replace(t, '^\s+|\s+$', '', 'g') END AS normal
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'None' ELSE chr(9) || '  ' || o_orderpriority || chr(10) END AS t FROM orders)""")
def normalize(t):
    raw = F.when(C("o_orderkey") % 4 == 0, None).when(C("o_orderkey") % 4 == 1, "None").otherwise(F.concat(F.lit("\t  "), "o_orderpriority", F.lit("\n")))
    return t.orders.select("o_orderkey", tx.normal(raw).alias("normal"))


@query("text_tidy", """SELECT c_custkey, list_aggregate(list_filter(list_transform(string_split(t, ','), lambda s: trim(s)), lambda s: s <> ''), 'string_agg', ', ') AS tidy
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END || ' , ' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END || ', x' AS t FROM customer)""")
def tidy(t):
    raw = F.concat(F.when(C("c_custkey") % 3 == 0, "").otherwise(C("c_name")), F.lit(" , "), F.when(C("c_custkey") % 2 == 0, "").otherwise(C("c_mktsegment")), F.lit(", x"))
    return t.customer.select("c_custkey", tx.tidy(raw).alias("tidy"))


@query("text_split_once", """SELECT n_nationkey, CASE WHEN contains(t, ',') THEN trim(substr(t, 1, instr(t, ',') - 1)) ELSE '' END AS location, CASE WHEN contains(t, ',') THEN trim(substr(t, instr(t, ',') + 1)) ELSE t END AS site
FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN r_name || ', ' || n_name || ', b' ELSE n_name END AS t FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def split_once(t):
    rows = t.nation.join(t.region, C("n_regionkey") == C("r_regionkey"))
    raw = F.when(C("n_nationkey") % 2 == 0, F.concat("r_name", F.lit(", "), "n_name", F.lit(", b"))).otherwise(C("n_name"))
    s = tx.split_once(raw)
    return rows.select("n_nationkey", s["first"].alias("location"), s["second"].alias("site"))


@query("text_numbers", r"""SELECT p_partkey, try_cast(nullif(regexp_extract(t, '^\s*(-?[0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS leading,
try_cast(nullif(replace(regexp_extract(t, '-?[0-9]+(?:[.,][0-9]+)?'), ',', '.'), '') AS DOUBLE) AS anywhere
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || ',5 kg' WHEN 1 THEN p_brand ELSE p_size || '.25 m' END AS t FROM part)""")
def numbers(t):
    size = C("p_size").cast("string")
    raw = F.when(C("p_partkey") % 3 == 0, F.concat(size, F.lit(",5 kg"))).when(C("p_partkey") % 3 == 1, C("p_brand")).otherwise(F.concat(size, F.lit(".25 m")))
    return t.part.select("p_partkey", tx.leading_number(raw).alias("leading"), tx.any_number(raw).alias("anywhere"))


@query("text_number_and_unit", r"""SELECT p_partkey, try_cast(nullif(regexp_extract(t, w, 1), '') AS DOUBLE) AS value,
CASE WHEN nullif(regexp_extract(t, w, 1), '') IS NULL THEN NULL WHEN contains(lower(regexp_extract(t, w, 2)), 'kg') THEN 'kilogram' WHEN contains(lower(regexp_extract(t, w, 2)), 'lb') THEN 'pound' ELSE 'kilogram' END AS unit
FROM (SELECT p_partkey, '^\s*([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z\s]+)?$' AS w, CASE p_partkey % 4 WHEN 0 THEN p_size || ' Kg' WHEN 1 THEN p_size || 'lbs' WHEN 2 THEN '' || p_size ELSE p_brand END AS t FROM part)""")
def number_and_unit(t):
    size = C("p_size").cast("string")
    raw = F.when(C("p_partkey") % 4 == 0, F.concat(size, F.lit(" Kg"))).when(C("p_partkey") % 4 == 1, F.concat(size, F.lit("lbs"))).when(C("p_partkey") % 4 == 2, size).otherwise(C("p_brand"))
    v = tx.number_and_unit(raw, {"kilogram": ["kg", "kilogram"], "pound": ["lb", "pound"]}, "kilogram")
    return t.part.select("p_partkey", v["value"].alias("value"), v["unit"].alias("unit"))


@query("text_general_number", "SELECT o_orderkey, format('{:g}', v) AS shown FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice / 1000.0 WHEN 2 THEN o_totalprice / 1e9 ELSE CAST(o_orderkey AS DOUBLE) END AS v FROM orders)")
def general_number(t):
    v = F.when(C("o_orderkey") % 4 == 0, C("o_totalprice")).when(C("o_orderkey") % 4 == 1, C("o_totalprice") / 1000.0).when(C("o_orderkey") % 4 == 2, C("o_totalprice") / 1e9).otherwise(C("o_orderkey").cast("double"))
    return t.orders.select("o_orderkey", tx.general(v).alias("shown"))


@query("text_thousandths_degrees", """SELECT s_suppkey, (CASE WHEN m < 0 THEN '-' ELSE '' END) || (abs(m) // 1000) || '.' || regexp_replace(lpad(CAST(abs(m) % 1000 AS VARCHAR), 3, '0'), '^(.)(00|(.)0|(..))$', '\\1\\3\\4') AS milli,
(CASE WHEN u < 0 THEN '-' ELSE '' END) || (abs(u) // 1000000) || '.' || lpad(CAST(abs(u) % 1000000 AS VARCHAR), 6, '0') AS degrees
FROM (SELECT s_suppkey, CAST(round_even(s_acctbal * 10, 0) AS BIGINT) AS m, CAST(round_even(s_acctbal / 100 * 1000000, 0) AS BIGINT) AS u FROM supplier)""".replace("\\\\", "\\"))
def thousandths(t):
    return t.supplier.select("s_suppkey", tx.thousandths(F.rint(C("s_acctbal") * 10) / 1000).alias("milli"), tx.degrees(C("s_acctbal") / 100).alias("degrees"))


@query("text_fixed", "SELECT l_orderkey, l_linenumber, printf('%.1f', l_quantity / 4) AS one, printf('%.0f', l_quantity / 2) AS whole FROM lineitem")
def fixed(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", tx.fixed(C("l_quantity") / 4, 1).alias("one"), tx.fixed(C("l_quantity") / 2, 0).alias("whole"))


@query("text_escapes", r"""SELECT page_id, '"' || replace(replace(url, '\', '\\'), '"', '\"') || '"' AS quoted, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM pages""")
def escapes(t):
    return t.pages.select("page_id", tx.quoted(C("url")).alias("quoted"), tx.xml(C("url")).alias("xml"))


@query("text_safe_names", r"""SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS stem, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages""")
def safe_names(t):
    return t.pages.select("page_id", tx.safe_stem(C("url")).alias("stem"), tx.slug(C("url")).alias("slug"))


@query("text_directory", r"""SELECT o_orderkey, regexp_replace(p, '/Dive-[0-9]*$', '') AS directory FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') || CASE WHEN o_orderkey % 2 = 0 THEN '/Dive-' || o_orderkey ELSE '' END AS p FROM orders)""")
def directory(t):
    p = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit("/Dive-"), C("o_orderkey").cast("string"))).otherwise(""))
    return t.orders.select("o_orderkey", tx.directory(p).alias("directory"))


@query("text_gas_name", """SELECT p_partkey, CASE WHEN he > 0 THEN o2 || '/' || he WHEN o2 >= 100 THEN 'O2' WHEN o2 = 21 THEN 'Air' ELSE 'EAN' || o2 END AS gas FROM (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 21 WHEN p_size = 49 THEN 100 ELSE p_size + 15 END AS o2, CASE WHEN p_size % 7 = 0 THEN p_size ELSE 0 END AS he FROM part)""")
def gas_name(t):
    o2 = F.when(C("p_size") % 10 == 0, F.lit(None)).when(C("p_size") == 49, 100).otherwise(C("p_size") + 15)
    return t.part.select("p_partkey", tx.gas_name(o2, F.when(C("p_size") % 7 == 0, C("p_size"))).alias("gas"))


@query("text_masked", r"""SELECT c_custkey, CASE WHEN contains(m, '@') THEN substr(m, 1, 1) || '***@' || substr(m, instr(m, '@') + 1) ELSE '***' END AS mail FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(replace(c_name, '#', '')) || '@example.com' ELSE c_name END AS m FROM customer)""")
def masked(t):
    m = F.when(C("c_custkey") % 2 == 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.com"))).otherwise(C("c_name"))
    return t.customer.select("c_custkey", tx.masked_mail(m).alias("mail"))


@query("text_scrubbed", r"""SELECT page_id, regexp_replace(replace(url, 'example', '***'), '\?[^\s''"<>)]*', '?...', 'g') AS safe FROM pages""")
def scrubbed(t):
    return t.pages.select("page_id", tx.scrubbed(C("url"), ["example"]).alias("safe"))


@query("text_credentials", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'login password=[redacted]' WHEN 1 THEN 'Authorization: [redacted]' || chr(10) || 'read ~/dives/' || c_custkey
WHEN 2 THEN 'API-Key : [redacted]' WHEN 3 THEN 'sent basic [redacted] to all' ELSE 'token_count=3, pwd: [redacted]' END AS safe FROM customer""")
def credentials(t):
    k = C("c_custkey").cast("string")
    line = [F.concat(F.lit("login password=my long "), k, F.lit(" phrase")), F.concat(F.lit("Authorization: Bearer abc"), k, F.lit("\nread /home/me/dives/"), k), F.concat(F.lit("API-Key : "), k), F.concat(F.lit("sent basic abcdefgh"), k, F.lit(" to all")), F.concat(F.lit("token_count=3, pwd: "), k)]
    return t.customer.select("c_custkey", tx.scrubbed(F.element_at(F.array(*line), (C("c_custkey") % 5 + 1).cast("int")), homes=["/home/me"]).alias("safe"))


@query("text_reference", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'garmin:' || o_orderkey WHEN 1 THEN 'divelogs:' || o_custkey END AS ref, CASE o_orderkey % 3 WHEN 0 THEN 'garmin' WHEN 1 THEN 'divelogs' END AS service FROM orders""")
def reference(t):
    k = C("o_orderkey") % 3
    ids = F.create_map(F.lit("garmin"), F.when(k == 0, C("o_orderkey").cast("string")).otherwise(" "), F.lit("divelogs"), F.when(k < 2, C("o_custkey").cast("string")), F.lit("ssi"), F.lit("7"))
    ref = tx.reference(ids, "garmin", "ssi")
    back = tx.reference_ids(F.coalesce(ref, F.lit("4711:20240101T000000")), ["garmin", "divelogs"])
    return t.orders.select("o_orderkey", ref.alias("ref"), F.try_element_at(F.map_keys(back), F.lit(1)).alias("service"))


@query("text_short_id", "SELECT o_orderkey, substr(sha1(concat_ws('|', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'None' ELSE o_orderpriority END, o_custkey)), 1, 10) AS id FROM orders")
def short_id(t):
    return t.orders.select("o_orderkey", tx.short_id(C("o_orderkey"), F.when(C("o_orderkey") % 2 == 0, None).otherwise(C("o_orderpriority")), C("o_custkey")).alias("id"))


@query("text_location_overlay", """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN r_name || ', ' || n_name WHEN 1 THEN n_name || ' reef' ELSE n_name END AS location FROM nation JOIN region ON n_regionkey = r_regionkey""")
def location_overlay(t):
    rows = t.nation.join(t.region, C("n_regionkey") == C("r_regionkey"))
    k = C("n_nationkey") % 3
    return rows.select("n_nationkey", tx.location_with_site(F.when(k == 0, C("r_name")).when(k == 1, C("n_name")).otherwise(""), F.when(k == 1, F.concat("n_name", F.lit(" reef"))).otherwise(C("n_name"))).alias("location"))


@query("text_flags", "SELECT event_id, event_id % 6 IN (0, 1, 2) AS deleted FROM events")
def flags(t):
    words = F.element_at(F.array(*[F.lit(x) for x in ("1", " True", "yes", "0", "false", None)]), (C("event_id") % 6 + 1).cast("int"))
    return t.events.select("event_id", tx.is_true(words).alias("deleted"))


@query("text_models", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Heinrichs Weikamp' WHEN 1 THEN p_type END AS maker, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand ELSE p_brand END AS model FROM part""")
def models(t):
    k = C("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("Heinrichs Weikamp "), "p_brand")).when(k == 1, F.concat("p_type", F.lit(" "), "p_brand")).otherwise(C("p_brand"))
    m = tx.maker_and_model(raw, ["Heinrichs Weikamp"])
    return t.part.select("p_partkey", m["maker"].alias("maker"), m["model"].alias("model"))


@query("text_deco_model", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'ZHL-16C' END AS model, p_size AS gf_low, p_size + 30 AS gf_high FROM part""")
def deco_models(t):
    gf = F.concat(C("p_size").cast("string"), F.lit("/"), (C("p_size") + 30).cast("string"))
    m = tx.deco_model(F.when(C("p_partkey") % 2 == 0, F.concat(F.lit("Buhlmann ZHL-16C "), gf)).otherwise(F.concat(F.lit("GF "), gf)))
    return t.part.select("p_partkey", m["model"].alias("model"), m["gf_low"].alias("gf_low"), m["gf_high"].alias("gf_high"))


@query("unit_conversions", """SELECT l_orderkey, l_linenumber, round(l_quantity * 3.280839895, 6) AS feet, round(l_quantity * 14.5037738, 6) AS psi, round(l_quantity * 1.8 + 32, 6) AS fahrenheit, round(l_quantity * 0.0353146667, 6) AS cuft, round(l_quantity * 2.2046226218, 6) AS lb, round((l_quantity - 32) / 1.8, 6) AS celsius FROM lineitem""")
def unit_conversions(t):
    q = C("l_quantity")
    kinds = {"feet": "depth", "psi": "pressure", "fahrenheit": "temperature", "cuft": "volume", "lb": "weight"}
    return t.lineitem.select("l_orderkey", "l_linenumber", *[F.round(un.convert(k, q, True), 6).alias(n) for n, k in kinds.items()], F.round(un.convert_back("temperature", q, True), 6).alias("celsius"))


@query("unit_shown", """SELECT l_orderkey, l_linenumber, printf('%.1f', l_quantity / 4) || ' m' AS metric, printf('%.0f', l_quantity * 3.280839895) || ' ft' AS imperial FROM lineitem""")
def unit_shown(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", un.shown("depth", C("l_quantity") / 4, False, True).alias("metric"), un.shown("depth", C("l_quantity"), True, True).alias("imperial"))


@query("unit_texts", """SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN p_size * 0.3048 WHEN 1 THEN p_size / 1000.0 ELSE p_size END::DOUBLE, 3) AS depth, round(CASE p_partkey % 2 WHEN 0 THEN (p_size - 32) * 5 / 9.0 ELSE p_size - 273.15 END::DOUBLE, 3) AS temp, round(p_size::DOUBLE * 28.3168::DOUBLE * 1.01325::DOUBLE / 200, 3) AS volume FROM part""")
def unit_texts(t):
    size = C("p_size").cast("string")
    k = C("p_partkey")
    depth = F.concat(size, F.when(k % 3 == 0, " ft").when(k % 3 == 1, " mm").otherwise(" m"))
    temp = F.concat(size, F.when(k % 2 == 0, "F").otherwise(" K"))
    return t.part.select("p_partkey", un.depth_m(depth).alias("depth"), un.temperature_c(temp).alias("temp"), un.volume_l(F.concat(size, F.lit(" cuft")), F.lit(200.0)).alias("volume"))


@query("unit_water", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'fresh' WHEN 1 THEN 'en13319' WHEN 2 THEN 'salt' END AS kind, CASE p_size % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1020 WHEN 2 THEN 1030 ELSE 1011 END AS density FROM part")
def water(t):
    k = C("p_size") % 4
    d = F.when(k == 0, 1000.2).when(k == 1, 1019.8).when(k == 2, 1025.0).otherwise(1011.0)
    kind = un.water_type(d)
    return t.part.select("p_partkey", kind.alias("kind"), un.density(kind, F.when(k == 3, d)).alias("density"))


@query("unit_transmitter", "SELECT event_id, CASE WHEN w < 65520 AND (w & 4095) > 0 THEN round((w & 4095) * 2 / 14.5037738, 2) END AS bar FROM (SELECT event_id, CAST(event_id * 7 % 65536 AS INTEGER) AS w FROM events)")
def transmitter(t):
    return t.events.select("event_id", F.round(un.transmitter_bar((C("event_id") * 7 % 65536).cast("int")), 6).alias("bar"))


@query("time_parsed", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate + to_hours(CAST(o_orderkey % 4 AS BIGINT)) END AS at FROM orders")
def parsed(t):
    k = C("o_orderkey") % 4
    at = C("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=k.cast("int"))
    raw = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.date_format(at, "yyyy-MM-dd HH:mm'+08:00'")).otherwise("soon")
    return t.orders.select("o_orderkey", tm.parsed(raw).alias("at"))


@query("time_utc_of", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_orderdate - INTERVAL 8 HOUR ELSE o_orderdate + INTERVAL 210 MINUTE END AS utc FROM orders")
def utc_of(t):
    zone = F.when(C("o_orderkey") % 3 == 0, "Z").when(C("o_orderkey") % 3 == 1, "+08:00").otherwise("-0330")
    return t.orders.select("o_orderkey", tm.utc_of(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone)).alias("utc"))


@query("time_offsets", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -m ELSE m END AS minutes, CASE WHEN event_id % 3 = 0 AND m > 0 THEN '-' ELSE '+' END || lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS shown, -(CAST(event_id % 12 AS INTEGER)) * 60 AS etc FROM (SELECT event_id, CAST(event_id % 57 AS INTEGER) * 15 AS m FROM events)""")
def offsets(t):
    m = (C("event_id") % 57 * 15).cast("int")
    raw = F.concat(F.when(C("event_id") % 3 == 0, "-").otherwise("+"), F.floor(m / 60).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))
    got = tm.offset_minutes(raw)
    return t.events.select("event_id", got.alias("minutes"), tm.offset_text(got).alias("shown"), tm.zone_minutes(F.concat(F.lit("Etc/GMT+"), (C("event_id") % 12).cast("string"))).alias("etc"))


@query("time_clock", """SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE '' || (s // 60) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS shown, CAST(s AS INTEGER) AS seconds, CAST(round_even(s / 60, 0) AS INTEGER) AS minutes FROM (SELECT event_id, event_id % 9000 AS s FROM events)""")
def clock(t):
    s = C("event_id") % 9000
    text = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return t.events.select("event_id", tm.clock(s).alias("shown"), tm.duration_s(text).alias("seconds"), tm.whole_minutes(s).alias("minutes"))


@query("time_device_epoch", "SELECT event_id, make_timestamp((631065600 + event_id * 86400) * 1000000) AS at, round(event_id * 100000 * 180.0 / 2147483648, 6) AS degrees FROM events")
def device_epoch(t):
    return t.events.select("event_id", tm.epoch_1989(C("event_id") * 86400).alias("at"), F.round(tm.semicircles(C("event_id") * 100000), 6).alias("degrees"))


@query("time_next_run", """SELECT event_id, CASE WHEN d + INTERVAL 9 HOUR + INTERVAL 30 MINUTE <= ts THEN d + INTERVAL 1 DAY + INTERVAL 9 HOUR + INTERVAL 30 MINUTE ELSE d + INTERVAL 9 HOUR + INTERVAL 30 MINUTE END AS daily,
CASE WHEN w <= ts THEN w + INTERVAL 7 DAY ELSE w END AS weekly FROM (SELECT event_id, ts, date_trunc('day', ts)::TIMESTAMP AS d, date_trunc('day', ts)::TIMESTAMP + to_days(CAST((2 - dayofweek(ts) + 7) % 7 AS INTEGER)) + INTERVAL 6 HOUR AS w FROM events)""")
def next_run(t):
    now = C("ts").cast("timestamp_ntz")
    return t.events.select("event_id", tm.next_daily(now, F.lit(9), F.lit(30)).alias("daily"), tm.next_weekly(now, F.lit(2), F.lit(6), F.lit(0)).alias("weekly"))


@query("time_candidate_dates", "SELECT event_id, CAST(d AS VARCHAR) AS day FROM (SELECT event_id, unnest(range(CAST(ts AS DATE) - 1, CAST(ts AS DATE) + 2, INTERVAL 1 DAY))::DATE AS d FROM events)")
def candidate_dates(t):
    now = C("ts").cast("timestamp_ntz")
    return t.events.select("event_id", F.explode(tm.candidate_dates(now, now)).alias("day")).withColumn("day", C("day").cast("string"))


@query("time_directory_start", "SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS at FROM orders")
def directory_start(t):
    at = C("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=(C("o_orderkey") % 86400))
    return t.orders.select("o_orderkey", tm.start_of_directory(F.concat(F.lit("root/"), F.date_format(at, "yyyy/MM/dd-EEE-HH=mm=ss"))).alias("at"))


@query("agg_sac", """SELECT l_orderkey, CASE WHEN d > 0 AND sum(CASE WHEN l_extendedprice > l_discount * 100000 THEN 1 ELSE 0 END) > 0 AND sum(greatest(0, l_extendedprice - l_discount * 100000) * l_quantity) > 0 THEN round(sum(greatest(0, l_extendedprice - l_discount * 100000) * l_quantity) / (d * 60 / 60.0 * (18.5 / 10 + 1)), 4) END AS sac
FROM (SELECT *, l_orderkey % 5 AS d FROM lineitem) GROUP BY l_orderkey, d""")
def sac(t):
    tank = F.struct(C("l_quantity").alias("volume"), C("l_extendedprice").alias("start"), (C("l_discount") * 100000).alias("end"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", tank.alias("t")))).alias("x"))
    tanks = F.transform("x", lambda x: x["t"])
    return rows.select("l_orderkey", F.round(un.sac(tanks, F.lit(18.5), C("l_orderkey") % 5 * 60), 4).alias("sac"))
