"""Lookups, cells, series, incremental runs and sinks on small rows: nulls, ties, repeats, empty tables, clashing columns."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tallyweave.functions import cells
from tallyweave.operators import lookups
from tallyweave.operators import series as se
from tallyweave.sinks import files
from tallyweave.streaming import incremental as inc

POINT = "id long, name string, lat double, lng double, metres string"
SENT = "i long, ref string, number int, at double, depth double, duration int, j string"
LOG = "j long, ref string, number int, at double, depth double, minutes int, i string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_places(spark):
    points = spark.createDataFrame([(1, " Reef ", None, None, "x"), (2, None, 10.0, 20.0, "x"), (3, "none", None, 20.0, "x"), (4, "", 10.0, 20.001, "x")], POINT)
    places = spark.createDataFrame([(7, "REEF", 0.0, 0.0, "y"), (6, "reef", 1.0, 1.0, "y"), (8, None, 10.0, 20.0, "y"), (9, " ", 10.0, 20.0, "y")], POINT).withColumnRenamed("id", "place")
    names = ("id", "name", "lat", "lng"), ("place", "name", "lat", "lng")
    found = rows(lookups.find_place(points, places, 200.0, *names).select("id", "place"))
    assert found == [(1, 6), (2, 8), (4, 8)]
    assert rows(lookups.find_place(points, places.limit(0), 200.0, *names)) == []
    keys = {r["id"]: r for r in lookups.place_keys(points, places, 200.0, *names).collect()}
    assert keys[1]["site"] == "6" and keys[3]["made"] and len(keys[3]["site"]) == 10


def test_logs(spark):
    sent = spark.createDataFrame([(1, "a", 5, 100.0, 10.0, 600, "x"), (2, " ", 6, 1000.0, 10.0, 610, "x"), (3, None, None, 5000.0, None, None, "x"), (4, None, 8, None, 1.0, 60, "x")], SENT)
    log = spark.createDataFrame([(9, "a", 4, 9999.0, 10.6, 12, "y"), (8, " ", 6, 1120.0, 10.5, 11, "y"), (7, None, 6, 880.0, None, None, "y"), (10, "a", 5, 100.0, 10.0, 10, "y")], LOG)
    assert rows(lookups.duplicates(sent, log)) == [(1, 9, "reference"), (2, 7, "start")]
    assert rows(lookups.verified(sent, log)) == [(1, 9, ["number", "start", "depth", "time"]), (2, 7, []), (3, None, ["missing"]), (4, None, ["missing"])]
    assert rows(lookups.duplicates(sent.limit(0), log)) == [] and [r[2] for r in rows(lookups.verified(sent, log.limit(0)))] == [["missing"]] * 4


def test_cells(spark):
    pairs = [(None, "  ", True), ("1.50", "1,5", True), ("1.5", "1.6", False), ("a", None, False), ("x ", "x", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where(cells.same_cell(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    names = spark.createDataFrame([("12345678.zip",), ("1234567.fit",), ("nonum_2024-01-01_000000_9.json",), (".99999999",), (None,)], "p string")
    assert [r[0] for r in names.select(cells.id_of_file(F.col("p"))).collect()] == ["12345678", None, "9", None, None]
    one = spark.range(1).select(cells.option(F.lit("NONE"), ["a", "b"]).alias("o"), cells.unless_zero(F.lit(0), F.lit(None).cast("int")).alias("z"), cells.serial_text(F.lit(1 << 36)).alias("s"), cells.file_stem(F.lit(" 7 "), F.lit(None).cast("timestamp"), F.lit(3)).alias("f")).first()
    assert tuple(one) == (None, None, "1000000000", "7_0000-00-00_000000_3")


def test_fixed_grid(spark):
    shape = "dive long, t long, seq long, depth double, temp double, pressure double, ndl double"
    data = [(1, 0, 0, 0.0, 20.0, None, None), (1, 10, 1, 10.0, None, 100.0, 120.0), (1, 10, 2, 9.0, 18.0, 90.0, None), (1, None, 3, 5.0, 1.0, 1.0, 1.0), (1, 20, 4, 1.0, 16.0, 80.0, 3.4), (2, 5, 0, 1.0, 1.0, 1.0, 1.0)]
    got = rows(se.fixed_grid(spark.createDataFrame(data, shape)))
    # the second sample at 10 s counts from there on, the first one is what the points before it are drawn towards
    assert [g[:7] for g in got] == [(1, 1, 0, 0.0, 20.0, None, 99), (1, 2, 5, 5.0, 20.0, None, 99), (1, 3, 10, 9.0, 18.0, 90.0, 99), (1, 4, 15, 5.0, 17.0, 85.0, 99), (1, 5, 20, 1.0, 16.0, 80.0, 3)]
    assert [g[7] for g in got] == [0.0, -60.0, -48.0, 48.0, 48.0]
    assert [g[8] - se.DIVING for g in got] == [se.SURFACED, 0, se.AT_DEPTH, 0, se.SURFACED]
    assert rows(se.fixed_grid(spark.createDataFrame([], shape))) == []


def test_gases_and_detail(spark):
    gases = [(1, 1, 0, 21, None, None), (1, 1, 1, 32, 0, None), (1, 2, 0, 32, 0, None), (1, 2, 1, 50, 0, None), (1, 2, 2, 50, 0, None), (1, 2, 3, 21, None, None), (2, 2, 4, 21, 0, "x"), (2, 2, None, 21, 0, "x")]
    got = rows(se.merged_gases(spark.createDataFrame(gases, "dive long, log int, at long, oxygen int, helium int, mode string")))
    assert got == [(1, 1, 0, 0, False), (1, 1, 1, 1, False), (1, 2, 0, 1, False), (1, 2, 1, 2, True), (1, 2, 2, 2, False), (1, 2, 3, 0, False), (2, 2, 4, 0, True)]
    samples = spark.createDataFrame([(1, 0, 0, 5), (1, 4, 1, None), (1, 4, 2, 7)], "dive long, t long, seq long, v int")
    asked = spark.createDataFrame([(1, -1), (1, 3), (1, 4), (1, 4), (2, 0)], "dive long, t long")
    assert rows(se.detail(samples, asked, ["v"])) == [(1, -1, None), (1, 3, 5), (1, 4, 7), (1, 4, 7), (2, 0, None)]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    source, sink, seen = (str(tmp_path / n) for n in ("in", "out", "seen"))
    shape = "k string, at int, v int"
    run = lambda: inc.land(inc.new_files(spark, source, spark.createDataFrame([], shape).schema), sink, seen)
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1), (None, 1, 9)], shape).write.parquet(source)
    run()
    spark.createDataFrame([("a", 2, 2), ("b", 0, 0)], shape).write.mode("append").parquet(source)
    run()
    run()
    landed = spark.read.parquet(sink)
    assert landed.count() == 5
    assert rows(inc.newest(landed, ["k"], "at")) == [("a", 2, 2), ("b", 1, 1), (None, 1, 9)]


def test_marks(spark):
    day = lambda d: datetime(2024, 1, d)
    state = spark.createDataFrame([("a", day(10), False), ("b", day(10), True), ("c", None, None)], "acc string, mark timestamp, full boolean")
    seen = spark.createDataFrame([("a", day(8), 1), ("a", day(9), 2), ("a", None, 3), ("b", day(1), 4), ("c", None, 5), ("d", day(1), 6)], "acc string, at timestamp, mark int")
    assert [r[2] for r in sorted(inc.fresh(seen, state, ["acc"], "at").collect(), key=lambda r: r[2])] == [2, 4, 5, 6]
    runs = spark.createDataFrame([("a", day(12), True), ("a", day(13), False), ("b", day(9), True), ("d", day(2), True), ("c", day(5), False)], "acc string, started timestamp, done boolean")
    assert rows(inc.finished(state, runs, ["acc"])) == [("a", day(12), False), ("b", day(10), False), ("c", None, False), ("d", day(2), False)]
    links = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "acc string, key int")
    assert rows(inc.gone(links, links.where("key = 2"), state, ["acc"], "key")) == [("b", 1)]


def test_files(spark, tmp_path):
    records = spark.createDataFrame([(1, datetime(2024, 1, 1, 9, 5), 3, " "), (2, datetime(2024, 1, 1, 9, 5, 30), 3, "x"), (3, None, None, None)], "k long, local timestamp, number int, buddy string")
    assert rows(files.file_names(records, "k", ".x")) == [(1, "2024-01-01 0905 dive 3.x"), (2, "2024-01-01 0905 dive 3 (2).x"), (3, "undated.x")]
    assert rows(files.dropped_counts(records, {"buddy": "buddy", "number": "no"}, ["k"])) == [("buddy", 1), ("no", 2)]
    out = str(tmp_path / "json")
    files.export_json(records, out)
    files.export_json(records.where("k = 3"), out, clear=True)
    assert [json.loads(r[0]) for r in spark.read.text(out).collect()] == [{"k": 3}]
