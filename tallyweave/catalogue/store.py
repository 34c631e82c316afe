"""The store of accounts, made of orders as records: ranges, newest, one id, and what a second publish changes."""

from datetime import datetime

from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.session import shared_path
from tallyweave.sinks import files
from tallyweave.sources import caches, services, store, zips
from tallyweave.sources.contract import between

C = F.col
KEYS = "'s' || (o_custkey % 2) AS service, CASE WHEN o_custkey % 3 = 0 THEN 'default' ELSE 'a' || (o_custkey % 3) END AS account, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS id"
SINCE, UNTIL = datetime(1994, 11, 20), datetime(1995, 2, 3)


def _records(t):
    k, c = C("o_orderkey"), C("o_custkey")
    local = F.when(k % 97 > 0, C("o_orderdate").cast("timestamp_ntz"))
    return t.orders.select(
        F.concat(F.lit("s"), (c % 2).cast("string")).alias("service"), F.when(c % 3 > 0, F.concat(F.lit("a"), (c % 3).cast("string"))).alias("account"), F.lpad(k.cast("string"), 10, "0").alias("id"),
        local.alias("local"), C("o_orderstatus").alias("kind"), F.create_map(F.lit("priority"), "o_orderpriority").alias("service_fields"), F.array(F.struct((k % 60).cast("int").alias("t"), (k % 7).cast("double").alias("depth"))).alias("samples"),
    )


def _published(t):
    path = shared_path(t.spark, "store")
    store.publish(_records(t), path)
    return path


@query("store_range", f"SELECT {KEYS}, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderkey % 7 AS DOUBLE) AS depth FROM orders WHERE o_orderkey % 97 > 0 AND o_orderstatus IN ('O', 'F') AND o_custkey % 2 = 1 AND o_orderdate BETWEEN '1994-11-20' AND '1995-02-03'")
def store_range(t):
    rows = store.read(t.spark, _published(t), ["service", "account", "id", "month", "local", "kind", "samples"])
    asked = between(rows, SINCE, UNTIL).where(C("kind").isin("O", "F") & (C("service") == "s1"))
    return asked.select("service", "account", "id", "month", C("samples")[0]["depth"].alias("depth"))


@query("store_newest", f"SELECT {KEYS}, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 97 > 0 ORDER BY o_orderdate DESC, service, account, id LIMIT 10")
def store_newest(t):
    return store.newest(t.spark, _published(t), 10, ["service", "account", "id", "local"]).select("service", "account", "id", F.date_format("local", "yyyy-MM-dd").alias("day"))


@query("store_one", f"SELECT {KEYS}, o_orderpriority AS priority FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def store_one(t):
    own = t.orders.agg(F.max("o_orderkey")).first()[0]
    rows = store.one(t.spark, _published(t), str(own).rjust(10, "0"), ["service", "account", "id", "service_fields"])
    return rows.select("service", "account", "id", C("service_fields")["priority"].alias("priority"))


@query("store_second_publish", f"""WITH o AS (SELECT {KEYS}, o_orderkey AS k, CASE WHEN o_orderkey % 97 > 0 THEN strftime(o_orderdate, '%Y-%m') ELSE 'undated' END AS month FROM orders),
m AS (SELECT *, k % 400 = 1 AND account = 'a1' AS moved FROM o),
n AS (SELECT service, account, CASE WHEN moved THEN '2005-07' ELSE month END AS month FROM m),
c AS (SELECT service, account, month, count(*) AS rows FROM n GROUP BY ALL), w AS (SELECT DISTINCT service, account, month FROM m WHERE moved UNION SELECT DISTINCT service, account, '2005-07' FROM m WHERE moved)
SELECT c.*, CASE WHEN w.month IS NULL THEN 1 ELSE 2 END AS generation FROM c LEFT JOIN w USING (service, account, month)""")
def store_second_publish(t):
    """Months of the second generation: those that records have left or come to are written anew, the others taken over."""
    path = _published(t)
    moved = _records(t).where((C("account") == "a1") & (C("id").cast("long") % 400 == 1)).withColumn("local", F.lit(datetime(2005, 7, 1)).cast("timestamp_ntz"))
    again = _records(t).where((C("id").cast("long") % 11 == 0) & ~F.coalesce((C("account") == "a1") & (C("id").cast("long") % 400 == 1), F.lit(False)))
    store.publish(moved.unionByName(again), path)
    found = store.files(t.spark, path, store.generation(path).number)
    return found.withColumn("generation", F.regexp_extract("file", "generation=0*([0-9]+)", 1).cast("int")).groupBy("service", "account", "month", "generation").agg(F.sum("rows").alias("rows"))


@query("cache_raw_objects", """SELECT 'divelogs' AS service, CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_nationkey % 3 END AS account, CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey % 50 AS DOUBLE) AS max_depth, CAST(NULL AS VARCHAR) AS problem FROM customer WHERE c_custkey % 10 = 3 AND c_custkey % 4 > 0
UNION ALL SELECT 'divelogs', CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_nationkey % 3 END, NULL, NULL, 'not a JSON object of this service' FROM customer WHERE c_custkey % 10 = 3 AND c_custkey % 4 = 0""")
def raw_objects(t):
    """A tenth of all customers by their number is the downloaded batch: a file each, every fourth damaged; all files are read."""
    root, k = shared_path(t.spark, "cache"), C("c_custkey")
    batch = t.customer.where(k % 10 == 3).select(
        F.when(k % 2 == 0, F.concat(F.lit("a"), (C("c_nationkey") % 3).cast("string"))).otherwise("default").alias("account"), F.concat(F.lit("nonum_2024-01-02_030405_"), k.cast("string")).alias("stem"),
        F.when(k % 4 == 0, "{broken").otherwise(F.to_json(F.struct(k.alias("id"), (k % 50).alias("maxdepth"), F.lit("2024-01-02").alias("date"), F.lit("03:04:05").alias("time")))).alias("content"),
    )
    files.whole(files.write_each(batch, root, F.concat(F.lit("divelogs/"), "account", F.lit("/data/"), "stem", F.lit(".JSON")), C("content")))
    got = caches.records(caches.raw(t.spark, root), "divelogs")
    return got.select("service", "account", F.try_element_at("external_ids", F.lit("divelogs")).alias("id"), "max_depth", "problem")


@query("source_site_zip", """WITH s AS (SELECT c_custkey AS id, 'site ' || c_custkey AS site, CAST(c_custkey % 90 AS DOUBLE) AS lat FROM customer)
SELECT CAST(id AS INTEGER) AS site_id, site, lat AS site_lat FROM s""")
def source_site_zip(t):
    """Customers as sites, in one archive of JSON and CSV entries; those divisible by 5 come again in the second entry under another name."""
    k, folder = C("c_custkey"), shared_path(t.spark, "zip")
    sites = t.customer.select(F.struct(k.alias("odin_dive_sites_id"), F.concat(F.lit("site "), k.cast("string")).alias("odin_dive_sites_name"), (k % 90).alias("odin_dive_sites_latitude")).alias("s"), k)
    again = sites.where(k % 5 == 0).select(C("s").withField("odin_dive_sites_name", F.lit("again")).alias("s"), k)
    parts = sites.select(F.when(k % 2 == 0, "a.json").otherwise("b.csv").alias("entry"), "s").unionByName(again.select(F.lit("c.JSON").alias("entry"), "s"))
    files.write_zip(parts.select("entry", F.to_json("s").alias("content")), f"{folder}/sites.zip")
    got = zips.read(t.spark, folder)
    rows = got.where("problem is null").select("archive", "entry_at", "record_at", F.from_json("content", services.SSI_SITE).alias("o"))
    return services.ssi_sites(rows, C("o"), "archive", "entry_at", "record_at").select("site_id", "site", "site_lat")
