"""Archives read entry by entry, and profiles on grids of their own."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import compare
from tallyweave.operators import series
from tallyweave.sources import zips


def pieces(text, n):
    return iter([text[i : i + n] for i in range(0, len(text), n)])


@pytest.mark.parametrize("n", [1, 2, 5, 10_000])
def test_json_records_in_pieces(n):
    read = lambda text: [json.loads(r) for r in zips.json_records(pieces(text, n))]
    assert read(' [{"a": "x, ]}"}, 12, null, [1], {"b": {"c": [1, 2]}} ] ') == [{"a": "x, ]}"}, {"b": {"c": [1, 2]}}]
    assert read('{"v": 12.5, "n": {"x": []}, "rows": [{"a": 1}], "later": [{"a": 2}]}') == [{"a": 1}]
    assert read("[]") == read("{}") == read('{"a": 1}') == []
    assert read("﻿" + json.dumps([{"k": "ü" * 100}])) == [{"k": "ü" * 100}]
    for bad in ("", "x", "12", '[{"a": 1}', '[{"a": }]', '{"a" 1}', '{"a": [', '"text"'):
        with pytest.raises(ValueError):
            read(bad)


@pytest.mark.parametrize("n", [1, 3, 10_000])
def test_csv_records_in_pieces(n):
    text = 'id,name\r\n1,"a, ""b""\nc"\r\n2\r\n\r\n3,x,more\r\n4,last'
    assert [json.loads(r) for r in zips.csv_records(pieces(text, n))] == [{"id": "1", "name": 'a, "b"\nc'}, {"id": "2", "name": None}, {"id": "3", "name": "x"}, {"id": "4", "name": "last"}]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("z.json", json.dumps([{"id": 1, "n": "first"}, {"id": 2, "n": "two"}]))
        z.writestr("folder/", "")
        z.writestr("a.JSON", json.dumps({"meta": 1, "rows": {"x": 1}, "list": [{"id": 1, "n": "second"}, {"n": "no id"}]}))
        z.writestr("t.csv", "id,n\n3,three\n")
        z.writestr("cut.json", '[{"id": 9, "n": "before"}, {"id":')
        z.writestr("other.txt", "x")
        z.writestr("large.json", "[" + ",".join(json.dumps({"id": i, "n": "x" * 200}) for i in range(1_000, 31_000)) + "]")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    (tmp_path / "c.txt").write_text("x")
    rows = zips.read(spark, str(tmp_path))
    assert rows.where("problem is null and entry <> 'large.json'").count() == 6 and rows.where("entry = 'large.json'").count() == 30_000
    assert {(r["archive"][-5:], r["entry"]): r["problem"] for r in rows.where("problem is not null").collect()} == {("a.zip", "cut.json"): "ValueError: no JSON", ("b.zip", None): "no zip archive"}
    first = {r["id"]: json.loads(r["content"])["n"] for r in zips.keep_first(rows, F.get_json_object("content", "$.id")).where("entry <> 'large.json'").collect()}
    assert first == {"1": "first", "2": "two", "3": "three", "9": "before"}
    assert zips.read(spark, str(tmp_path / "a.zip")).where("entry = 't.csv'").count() == 1
    (tmp_path / "none").mkdir()
    assert zips.read(spark, str(tmp_path / "none")).count() == 0


def profile(*rows):
    return [{"t": t, "depth": d, "temp": c} for t, d, c in rows]


SHAPE = "array<struct<t:int,depth:double,temp:double>>"


def test_resampled_like_the_series(spark):
    rnd = random.Random(5)
    dives = []
    for i in range(60):
        t, rows = rnd.randint(-5, 5), []
        for _ in range(rnd.randint(0, 25)):
            rows.append((t, round(rnd.random() * 30, 2), rnd.choice([None, round(rnd.random() * 20, 1)])))
            t += rnd.choice([0, 2, 2, 2, 3, 7]) if i % 3 else 4
        dives.append((i, profile(*rows)))
    df = spark.createDataFrame(dives, f"dive long, samples {SHAPE}")
    got = {r["dive"]: [tuple(x) for x in r["s"]] for r in df.select("dive", compare.resampled(F.col("samples")).alias("s")).collect()}
    long = df.select("dive", F.posexplode("samples").alias("seq", "x")).select("dive", "seq", "x.*")
    want = {i: [] for i, _ in dives}
    for r in series.resample(long).orderBy("dive", "t").collect():
        want[r["dive"]].append((r["t"], r["depth"], r["temp"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_same_profile_on_other_grids(spark):
    even = profile((0, 0.0, 20.0), (10, 5.0, 19.0), (20, 10.0, 18.0), (30, 5.0, None), (40, 0.0, None))
    gap = profile((0, 0.0, 20.0), (20, 10.0, 18.0), (30, 5.0, None), (40, 0.0, None))
    cases = [(even, gap, True), (even, gap[:-1], False), (even, profile(*[(x["t"], x["depth"] + (0.02 if x["t"] == 20 else 0.005), x["temp"]) for x in gap]), False), (even, profile(*[(x["t"], x["depth"] + 0.005, x["temp"]) for x in gap]), True), ([], None, True), (None, even, False), (profile((None, 1.0, 1.0)), even, False), (even, even, True)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {SHAPE}, b {SHAPE}")
    got = df.select("i", compare.same("samples", F.col("a"), F.col("b")).alias("x"), compare.same_profile(F.col("b"), F.col("a")).alias("y")).orderBy("i").collect()
    assert [(r["x"], r["y"]) for r in got] == [(s, s) for *_, s in cases]
