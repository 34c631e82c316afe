"""Expressions that are worked out once a row: how often they stand in a plan doesn't multiply with their uses."""

import json

from pyspark.sql import functions as F

from tallyweave.functions import paths
from tallyweave.plans import edits
from tallyweave.schema import record
from tallyweave.sources import services, xmls


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_laid_grows_with_its_entries(spark):
    entries = [{"field": f, "path": f"$.a.{f}"} for f in ("divenumber", "maxdepth", "buddy", "duration", "weights", "visibility")]
    values = {"number": 1, "max_depth": 2.0, "buddy": "Ann", "duration": 3, "weight": 4.0, "visibility": 5.0}
    rows = spark.range(1).select(F.col("id"), paths.variant(F.concat(F.lit('{"x":'), F.col("id"), F.lit("}"))).alias("raw"))
    v = paths.laid({"mappings": entries}, F.col("raw"), {k: F.when(F.col("id") == 0, F.lit(x)) for k, x in values.items()})
    out = rows.select(v.alias("v"))
    got = json.loads(out.select(F.to_json("v")).first()[0])
    assert got == {"a": {"buddy": "Ann", "divenumber": 1, "duration": 3, "maxdepth": 2, "visibility": 5, "weights": 4}, "x": 0}
    assert plan(out).count("to_variant_object") <= 4 * len(entries)


def test_garmin_looks_at_parts_once(spark):
    rows = spark.range(1).select(F.from_json(F.concat(F.lit('{"summary":{"activityId":'), F.col("id"), F.lit("}}")), services.GARMIN).alias("o"))
    assert plan(services.garmin(rows, F.col("o"))).count("to_json") <= 8


def test_checks_of_edits_are_compiled(spark):
    rows = record(spark.range(1), {"number": F.col("id")}).withColumn("asked", F.create_map(F.lit("number"), F.lit("x")))
    out = edits.edited(rows)
    assert out.select("problems", "number").collect()[0] == (["number: not a number: x"], 0)
    # the checks stand in a projection of their own, not within the filter, where they would be interpreted
    assert "AS _wrong#" in plan(out)


def test_by_key_works_its_pairs_out_once(spark):
    pairs = F.transform(F.split(F.col("x"), ","), lambda p: F.struct(F.substring(p, 1, 1).alias("k"), F.substring(p, 2, 9).alias("v")))
    out = spark.createDataFrame([("a1,b2,a3",), (None,)], "x string").select(xmls.by_key(pairs, "string", "int").alias("m"))
    assert [r["m"] for r in out.collect()] == [{"a": 3, "b": 2}, None]
    assert plan(out).count("split(") == 1
