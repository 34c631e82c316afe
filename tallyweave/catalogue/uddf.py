"""Orders as dives, written to UDDF files and read back."""

from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.schema import array_of, channels, event, ids, record, sample, tank
from tallyweave.session import shared_path
from tallyweave.sinks import files, payloads
from tallyweave.sinks import uddf as sink
from tallyweave.sources import services, uddf

C = F.col


def _dives(t):
    k, c = C("o_orderkey"), C("o_custkey")
    two = F.array(tank(F.lit(32.0), None, (200 - c % 50).cast("double"), F.lit(50.5), F.lit(12.0)), tank(F.lit(18.0), F.lit(45.0), F.lit(210.0)))
    profile = F.array(
        sample(F.lit(0), F.lit(1.5)),
        sample(F.lit(10), (k % 40 + 2) / 2, (c % 25).cast("double") + 1, None, channels(pressures=F.create_map(F.lit(0), (200 - c % 50).cast("double"), F.lit(1), F.lit(209.5)), ndl=(k % 99 * 10).cast("int"), o2_cells=F.when(k % 2 == 0, F.create_map(F.lit(1), F.lit(1.2))))),
        sample(F.lit(20), F.lit(3.25), None, F.when(k % 3 > 0, F.lit(90.5))),
    )
    values = {
        "local": C("o_orderdate").cast("timestamp_ntz"), "duration": c, "max_depth": k % 400 / 10, "temp_min": F.when(k % 4 > 0, (k % 20 + 1).cast("double")), "external_ids": ids(orders=k), "tanks": F.when(k % 3 > 0, two).otherwise(F.slice(two, 1, 1)),
        "location": F.concat("o_orderpriority", F.lit(" <&> "), (c % 40).cast("string")), "lat": F.when(c % 2 == 0, c % 40 + 0.25), "lng": F.when(c % 2 == 0, F.lit(-3.5)), "notes": F.when(k % 5 > 0, F.concat(F.lit("it's <b> "), "o_orderstatus")), "number": k, "buddy": F.when(k % 7 > 0, F.concat(F.lit("C"), (c % 9).cast("string"), F.lit(", Ann"))),
        "computer_model": F.when(k % 6 > 0, F.concat(F.lit("M"), (c % 4).cast("string"))), "computer_serial": F.when(k % 6 > 1, (c % 90).cast("string")), "gf_low": F.when(k % 2 == 0, F.lit(30)), "gf_high": F.when(k % 2 == 0, 70 + c % 20), "deco_model": F.when(k % 2 == 0, F.lit("ZHL-16B")),
        "samples": F.when(k % 9 > 0, profile), "events": F.when(k % 3 > 0, F.array(event(F.lit(10), "gas_switch", None, F.lit(1), F.lit(18.0), F.lit(45.0)), event(F.lit(20), "bookmark", F.lit("mark")))).otherwise(array_of("struct<t:int,type:string,name:string,tank:int,oxygen:double,helium:double,value:double>")),
        "dive_mode": F.when(k % 8 == 0, "ccr"), "service_fields": ids(rating=F.when(k % 5 > 2, k % 5)),
    }
    # a small table is one split, but its records are many times wider
    return record(t.orders.repartition(t.spark.sparkContext.defaultParallelism, "o_orderkey"), values, "o_custkey")


@query("source_uddf", """WITH o AS (SELECT *, o_orderkey AS k, o_custkey AS c FROM orders)
SELECT 'a' || c % 3 AS account, 'tallyweave-orders-' || k AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(k AS INTEGER) AS number, CAST(c AS INTEGER) AS duration, round(k % 400 / 10, 3) AS max_depth, CASE WHEN k % 4 > 0 THEN CAST(k % 20 + 1 AS DOUBLE) END AS temp_min,
o_orderpriority || ' <&> ' || c % 40 AS location, CASE WHEN c % 2 = 0 THEN c % 40 + 0.25 END::DOUBLE AS lat, CASE WHEN k % 5 > 0 THEN 'it''s <b> ' || o_orderstatus END AS notes, CASE WHEN k % 7 > 0 THEN 'C' || c % 9 || ', Ann' END AS buddy,
CASE WHEN k % 6 > 0 THEN 'M' || c % 4 END AS model, CASE WHEN k % 6 > 1 THEN CAST(c % 90 AS VARCHAR) END AS serial, CASE WHEN k % 2 = 0 THEN CAST(70 + c % 20 AS INTEGER) END AS gf_high, CASE WHEN k % 2 = 0 THEN 'ZHL-16B' END AS deco_model,
CAST(200 - c % 50 AS DOUBLE) AS first_start, CASE WHEN k % 3 > 0 THEN 45.0 END::DOUBLE AS second_helium, CASE WHEN k % 9 > 0 THEN CAST(c % 25 + 1 AS DOUBLE) END AS temp, CASE WHEN k % 9 > 0 AND k % 3 > 0 THEN 209.5 END::DOUBLE AS second_pressure,
CASE WHEN k % 9 > 0 THEN CAST(k % 99 * 10 AS INTEGER) END AS ndl, CASE WHEN k % 9 > 0 AND k % 2 = 0 THEN 1.2 END::DOUBLE AS cell, CASE WHEN k % 9 > 0 AND k % 3 > 0 THEN 90.5 END::DOUBLE AS last_pressure,
CASE WHEN k % 9 = 0 OR k % 3 = 0 THEN '' ELSE 'gas_switch@10:1,bookmark@20:' END AS events, CASE WHEN k % 9 > 0 AND k % 8 = 0 THEN 'ccr' END AS dive_mode, CASE WHEN k % 5 > 2 THEN CAST(k % 5 AS VARCHAR) END AS rating FROM o""")
def source_uddf(t):
    folder = shared_path(t.spark, "uddf")
    files.whole(sink.write(_dives(t), folder, F.concat(F.lit("a"), (C("o_custkey") % 3).cast("string"))))
    got = uddf.read(t.spark, folder)
    second = F.get("samples", 1)
    told = F.array_join(F.transform("events", lambda e: F.concat(e["type"], F.lit("@"), e["t"].cast("string"), F.lit(":"), F.coalesce(e["tank"].cast("string"), F.lit("")))), ",")
    return got.select(
        F.regexp_extract("file", r"([^/]*?)(-[0-9]+)?\.uddf$", 1).alias("account"), C("external_ids")["uddf"].alias("id"), F.date_format("local", "yyyy-MM-dd").alias("day"), "number", "duration", "max_depth", "temp_min", "location", "lat", "notes", "buddy", C("computer_model").alias("model"), C("computer_serial").alias("serial"), "gf_high", "deco_model",
        C("tanks")[0]["start"].alias("first_start"), F.get("tanks", 1)["helium"].alias("second_helium"), second["temp"].alias("temp"), F.try_element_at(second["channels"]["pressures"], F.lit(1)).alias("second_pressure"), second["channels"]["ndl"].alias("ndl"),
        F.try_element_at(second["channels"]["o2_cells"], F.lit(1)).alias("cell"), F.get("samples", 2)["pressure"].alias("last_pressure"), told.alias("events"), "dive_mode", F.try_element_at("service_fields", F.lit("rating")).alias("rating"),
    )


@query("payload_divelogs", """WITH o AS (SELECT *, o_orderkey AS k, o_custkey AS c, o_custkey % 2 = 1 AS feet FROM orders)
SELECT CAST(k AS INTEGER) AS number, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, CAST(c AS INTEGER) AS duration, round(k % 400 / 10, 3) AS max_depth, CASE WHEN k % 4 > 0 THEN CAST(k % 20 + 1 AS DOUBLE) END AS temp_min, o_orderpriority || ' <&> ' || c % 40 AS location,
CASE WHEN k % 5 > 0 THEN 'it''s <b> ' || o_orderstatus ELSE '' END AS notes, CASE WHEN c % 2 = 0 THEN c % 40 + 0.25 END::DOUBLE AS lat, CAST(200 - c % 50 AS DOUBLE) AS first_start, 12.0 AS first_volume, CASE WHEN k % 3 > 0 THEN 45.0 END::DOUBLE AS second_helium,
CASE WHEN k % 9 > 0 THEN '0,10,20' ELSE '' END AS times, CASE WHEN k % 9 > 0 THEN round((k % 40 + 2) / 2, 3) END AS second_depth, CASE WHEN k % 9 > 0 THEN CAST(c % 25 + 1 AS DOUBLE) END AS second_temp FROM o""")
def payload_divelogs(t):
    """Every second customer's account is imperial; either way the object reads back as the record."""
    rows = _dives(t)
    out = []
    for feet in (False, True):
        o = F.from_json(payloads.divelogs(feet), services.DIVELOGS).alias("o")
        got = services.divelogs(rows.where(C("o_custkey") % 2 == int(feet)).select(o), C("o"), feet)
        second = F.get("samples", 1)
        out.append(got.select(
            "number", F.date_format("local", "yyyy-MM-dd HH:mm:ss").alias("at"), "duration", F.round("max_depth", 3).alias("max_depth"), F.round("temp_min", 3).alias("temp_min"), "location", "notes", "lat", F.round(C("tanks")[0]["start"], 3).alias("first_start"), F.round(C("tanks")[0]["volume"], 3).alias("first_volume"),
            F.get("tanks", 1)["helium"].alias("second_helium"), F.array_join(F.transform("samples", lambda s: s["t"].cast("string")), ",").alias("times"), F.round(second["depth"], 3).alias("second_depth"), F.round(second["temp"], 3).alias("second_temp"),
        ))
    return out[0].unionByName(out[1])
