from pyspark.sql import functions as F

from tallyweave.operators import hot_keys


def test_hot_keys_stay_in_place(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") < 20_000, F.lit("hot")).when(F.col("id") < 20_100, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    facts = rows.where("k is not null and id % 3 = 0").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    out = hot_keys.joined(rows, facts, "k", "n")
    expected = {r["k"]: r["top"] for r in facts.collect()}
    got = out.collect()
    assert len(got) == 60_000 and all(r["top"] == expected.get(r["k"]) for r in got)
