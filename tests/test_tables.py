"""Operators on whole logs: nulls, ties, repeats, empty tables."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import tables as tb


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_first_seen(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, None, 0), (2, None, 1), (None, "x", 1), (None, "x", 1)], "k int, v string, at int")
    assert rows(tb.first_seen(df, ["k"], "v", "at")) == [(1, ["b", "a"]), (2, []), (None, ["x"])]
    assert rows(tb.first_seen(df.limit(0), ["k"], "v", "at")) == []
    assert rows(tb.union_of(df, ["k"], "v")) == [(1, ["a", "b"]), (2, []), (None, ["x"])]


def test_newest_and_next(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, "b", None)], "k int, v string, at int")
    assert rows(tb.newest_value(df, ["k"], "v", "at", to="v")) == [(1, None), (2, "b")]
    assert rows(tb.next_number(df, ["k"], "at")) == [(1, 3), (2, 1)]
    assert rows(tb.span(df, ["k"], F.col("at"))) == [(1, 1, 2), (2, None, None)]


def test_ids(spark):
    df = spark.createDataFrame([("abc",), ("abd",), (None,)], "id string")
    assert rows(tb.by_id(df, "id", "ab")) == [("abc",), ("abd",)]
    assert rows(tb.by_id(df, "id", "")) == []
    assert rows(tb.without_id(df, "id", "abc")) == [("abd",), (None,)]
    runs = spark.createDataFrame([(1, "j", "ok"), (2, "j", "bad"), (3, "k", "ok")], "at int, job string, status string")
    assert [r["at"] for r in tb.history(runs, "at", "job", job="j", status=None).collect()] == [2, 1]
    assert [r["at"] for r in tb.history(runs, "at", "job", 1, status="ok").collect()] == [3]


PART = "dive int, ord int, start double, seconds double, depths int, depth_sum double, max_depth double, bottom_time int, oxygen_units int, used double, cns double, nitrogen double, pressure double, lat double, lng double"


def test_merged_parts(spark):
    df = spark.createDataFrame(
        [
            (1, 2, 400.0, 100.0, 1, 30.0, 30.0, 5, None, 2.0, None, 0.5, None, None, 8.0),
            (1, 1, 100.0, 200.0, 3, 30.0, 12.0, 7, 3, 1.0, 0.2, 0.4, 50.0, 7.0, 7.0),
            (2, 1, 0.0, None, 0, 0.0, None, None, None, None, None, None, None, None, None),
        ],
        PART,
    )
    assert rows(tb.merged(df, "dive", "ord")) == [
        (1, 15.0, 30.0, 12, None, 3.0, 0.2, 0.5, 50.0, 7.0, 8.0, 400.0),
        (2, None, None, None, None, None, None, None, None, None, None, None),
    ]
    assert rows(tb.merged(df.limit(0), "dive", "ord")) == []


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "w"), (None, "n"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "new"), (3, "add")], "k int, v string")
    assert rows(tb.keep_first(a, ["k"], "v")) == [(1, "w"), (2, "y"), (None, "n")]
    assert rows(tb.absent(a, b, ["k"])) == [(2,), (None,)]
    assert rows(tb.upserted(a, b, ["k"])) == [(1, "new"), (2, "y"), (3, "add"), (None, "n")]
    assert rows(tb.pruned(a, a.where("k is null").select("k"), ["k"])) == [(None, "n")]
    assert rows(tb.shared(a.select("k"), b.select("k"))) == [(1,)]
    assert rows(tb.concatenated({"a": a.select("k").limit(0), "b": b}).select("k", "v", "origin")) == [(1, "new", "b"), (3, "add", "b")]
    links = spark.createDataFrame([("z", "x")], "f string, t string")
    members = spark.createDataFrame([("x",), ("y",), ("z",), ("x",)], "name string")
    assert rows(tb.unjoined(members, "name", links, "f", "t")) == [("x", "y"), ("y", "z")]


def test_users_order(spark):
    df = spark.createDataFrame([(1, "10 m"), (2, ""), (3, "9 m"), (4, None), (5, "deep"), (6, "9")], "i int, v string")
    order = lambda *a, **k: [r["i"] for r in tb.in_users_order(df, *a, "v", "i", **k).collect()]
    assert order("number") == [5, 3, 6, 1, 2, 4]
    assert order("number", down=True) == [1, 3, 6, 5, 2, 4]
    assert order("text", down=True) == [5, 3, 6, 1, 2, 4]
    with pytest.raises(ValueError):
        tb.sort_key("colour", F.col("v"))


def test_uploads_found_again(spark):
    sent = spark.createDataFrame([(1, 1000.0), (2, 5000.0), (3, None)], "i int, at double")
    listed = spark.createDataFrame([(9, 1120.0), (8, 1120.0), (7, 900.0), (6, 5121.0), (None, 5000.0)], "j int, at double")
    assert rows(tb.found_uploads(sent, listed)) == [(1, 8)]
    assert rows(tb.found_uploads(sent, listed.limit(0))) == []
