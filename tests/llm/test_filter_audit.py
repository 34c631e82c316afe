import re
from itertools import permutations

import pytest
from comparing import DATA
from pyspark.sql import functions as F

from tallyweave.llm import filter_audit
from tallyweave.llm.queries import OP13_SQL, op13_filter_audit

LETTERS = "ABCDE"


def brute(docs, labels):
    """All orders by hand: rows of (doc_id, text, part), and a dictionary of (quality, toxic)."""
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)

    def fails(k, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {f for f, bad in zip("ABCD", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t)), strict=True) if bad}
        return out | ({"E"} if k is not None and k > least[t] else set())

    failed = [(p or "", fails(k, t or ""), *labels.get(k, (0, 0))) for k, t, p in docs]
    out = {}
    for part in {x[0] for x in failed}:
        own = [x for x in failed if x[0] == part]
        whole = dict.fromkeys(LETTERS, 0)
        for order in permutations(LETTERS):
            left = list(own)
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                before = len([x for x in own if f in x[1]])
                left = [x for x in left if f not in x[1]]
                whole[f] += len(gone)
                out[part, "".join(order), i + 1] = [len(left), len(gone), before - len(gone), sum(x[1] == {f} for x in own), sum(x[2] == 1 for x in gone), sum(x[3] == 1 for x in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = whole[key[1][key[2] - 1]] if isinstance(row[-1], str) else row[-1]
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def test_query_same_as_sql(same_as_sql):
    same_as_sql(op13_filter_audit, OP13_SQL, DATA / "sf0.01")


def test_query_against_brute_force(spark):
    sf = str(DATA / "sf0.001")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = found(op13_filter_audit(spark, sf))
    assert len(got) == 600 * len({p or "" for *_, p in docs}) and got == brute(docs, labels)


def test_odd_documents(spark, odd, nothing):
    marks = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (10, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    docs = odd.withColumn("source", F.when(F.col("doc_id") < 4, F.lit(None)).when(F.col("doc_id") < 8, F.lit("")).otherwise(F.col("source"))).withColumn("mask", F.lit("x")).withColumn("key", F.lit(0))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert found(filter_audit.audit(docs, marks)) == brute(rows, {1: (1, 1), 10: (0, 1)})
    assert filter_audit.audit(nothing, marks).count() == 0
    assert found(filter_audit.audit(docs, marks.limit(0))) == brute(rows, {})


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "bb"), (4, None)], "id long, body string").withColumn("origin", F.lit(1))
    labels = spark.createDataFrame([], "id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, {"x": F.col("body").contains("a"), "y": F.col("body").contains("b")}, None, "origin", "id", "body")
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in got.collect()} == {
        ("xy", 1): (2, 2, 0, 1, 3), ("xy", 2): (1, 1, 1, 1, 3), ("yx", 1): (2, 2, 0, 1, 3), ("yx", 2): (1, 1, 1, 1, 3)}
    with pytest.raises(ValueError):
        filter_audit.interactions(got, list("abcdefg"))
