"""Rules: decisions of conflicts whose short ids are equal."""

from pyspark.sql import functions as F

from tallyweave.plans import rules as rl

#: Orders whose conflicts have the id 5f4dc7d85e.
SAME_ID = (4582022, 5552778)


def test_conflicts_of_one_id(spark):
    rows = spark.createDataFrame([(k, [("notes", "b", "conflict", f"s{k}", f"h{k}")]) for k in SAME_ID], f"k long, outcomes {rl.OUTCOMES}")
    found = rl.conflicts(rows, "a|b", F.col("k"), F.col("k"))
    assert [r["id"] for r in found.collect()] == ["5f4dc7d85e"] * 2
    decided = found.select(*rl.CONFLICT, F.when(F.col("source_id") == str(SAME_ID[0]), "source").otherwise("target").alias("side"))
    assert sorted(r["value"] for r in rl.resolve(found, decided).collect()) == ["h5552778", "s4582022"]
