"""UDDF files read back as the records that were written."""

import xml.etree.ElementTree as ET
from datetime import datetime

import pytest
from comparing import DATA
from pyarrow import fs
from pyspark.sql import functions as F

from tallyweave import catalogue
from tallyweave.catalogue import uddf as orders
from tallyweave.schema import KINDS
from tallyweave.sinks import files
from tallyweave.sinks import uddf as sink
from tallyweave.sources import uddf

CHANNELS = {"pressures": {0: 199.5, 1: 80.0}, "ndl": 300, "tts": None, "stop_depth": 3.0, "stop_time": 60, "cns": 4.5, "ppo2": 1.21, "setpoint": 1.3, "o2_cells": {0: 1.2, 2: 1.19}, "gf99": 55.0, "gas_time": 1200, "heart_rate": 88}
BARE = {"temp": None, "pressure": None, "channels": None}
TANK = {"oxygen": 32.0, "helium": 0.0, "start": 199.5, "end": 50.25, "volume": 12.0, "name": None, "role": None}


def event(t, kind, **more):
    return {"t": t, "type": kind, "name": None, "tank": None, "oxygen": None, "helium": None, "value": None} | more


RECORD_ROWS = [
    {
        "local": datetime(2024, 5, 1, 10, 23, 45), "utc": datetime(2024, 5, 1, 8, 23, 45), "duration": 1830, "max_depth": 30.25, "avg_depth": 15.125, "temp_min": 4.5, "external_ids": {"garmin": "77"}, "location": 'Reef & <Wall> "x"', "lat": 1.2345678, "lng": -2.5,
        "tanks": [TANK, TANK | {"oxygen": 50.0, "start": 200.0, "end": None, "volume": None}], "notes": "first\nsecond \x01 line", "number": 12, "weight": 4.0, "weight_unit": "kilogram", "visibility": 10.0, "visibility_unit": "meter", "buddy": "Ann, Bob B", "air_temp": 20.0, "suit": "Dry",
        "samples": [{"t": 0, "depth": 1.0, **BARE}, {"t": 10, "depth": 5.5, "temp": 4.5, "pressure": 199.5, "channels": CHANNELS}, {"t": 20, "depth": 30.25, "temp": None, "pressure": 150.0, "channels": None}],
        "events": [event(0, "bookmark", name="start"), event(10, "gas_switch", tank=1, oxygen=50.0, helium=0.0), event(10, "alert", name="deco"), event(20, "mode_change", name="oc_multi_gas")], "service_fields": {"rating": "4"}, "surface_interval": 3600,
        "computer_vendor": "Maker", "computer_model": "One", "computer_serial": "0001", "computer_firmware": "7", "gf_low": 30, "gf_high": 85, "deco_model": "ZHL-16C", "dive_mode": "ccr", "exit_lat": 1.5, "exit_lng": 2.25,
    },
    {"local": datetime(2024, 5, 2), "duration": 60, "max_depth": 10.0, "external_ids": {"uddf": "own"}, "tanks": [], "samples": [], "events": [], "service_fields": {}, "location": 'Reef & <Wall> "x"', "lat": 1.2345678, "lng": -2.5, "buddy": "Ann", "gf_low": 30, "gf_high": 85, "deco_model": "ZHL-16C"},
    {"local": datetime(2024, 5, 3), "duration": 0, "max_depth": 0.0, "external_ids": {"uddf": "own"}, "tanks": [], "samples": [], "events": [], "service_fields": {}},
    {"local": None, "external_ids": {"ssi": "undated"}, "tanks": [], "samples": [], "events": [], "service_fields": {}},
]


def made(spark):
    shape = ", ".join(f"{n} {k}" for n, k in KINDS.items())
    return spark.createDataFrame([tuple(r.get(n) for n in KINDS) for r in RECORD_ROWS], shape)


def test_records_come_back(spark, tmp_path):
    out = sink.write(made(spark), f"file://{tmp_path}", F.lit("log")).collect()
    assert [(r["name"], r["problem"], r["bytes"] == (tmp_path / "log.uddf").stat().st_size) for r in out] == [("log.uddf", None, True)]
    root = ET.parse(tmp_path / "log.uddf").getroot()
    count = lambda tag: len(root.findall(f".//{{*}}{tag}"))
    assert [count(t) for t in ("site", "buddy", "mix", "divecomputer", "suit", "buehlmann", "o2sensor", "dive")] == [1, 2, 2, 1, 1, 1, 3, 3]
    ids = [e.get("id") for e in root.iter() if e.get("id")]
    assert len(ids) == len(set(ids)) and {e.get("ref") for e in root.iter() if e.get("ref")} <= set(ids)
    got = {r["local"].day: r.asDict(recursive=True) for r in uddf.read(spark, f"file://{tmp_path}").collect()}
    assert sorted(got) == [1, 2, 3]
    given, back = RECORD_ROWS[0], got[1]
    assert back["external_ids"] == {"uddf": "tallyweave-garmin-77"} and got[2]["external_ids"] != got[3]["external_ids"]
    assert [t | {"name": None} for t in back["tanks"]] == given["tanks"] and back["notes"] == "first\nsecond  line"
    for name in given.keys() - {"external_ids", "tanks", "notes", "samples"}:
        assert back[name] == given[name], name
    assert [s["depth"] for s in back["samples"]] == [1.0, 5.5, 30.25] and back["samples"][2]["pressure"] == 150.0
    assert back["samples"][1] == given["samples"][1]
    for day in (2, 3):
        for name in RECORD_ROWS[day - 1].keys() - {"external_ids"}:
            assert got[day][name] == RECORD_ROWS[day - 1][name], name


def test_several_files_and_faults(spark, tmp_path):
    rows = made(spark).where("local is not null").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("number", F.col("n"))
    (tmp_path / "taken.uddf").mkdir()
    name = F.when(F.col("n") % 4 == 0, "taken").when(F.col("n") % 4 == 1, "../out").when(F.col("n") % 4 == 2, F.lit(None)).otherwise("big")
    out = sink.write(rows, f"file://{tmp_path}", name, dives=10).collect()
    problems = {r["name"]: r["problem"] for r in out if r["problem"]}
    assert {n.partition("-")[0].partition(".u")[0] for n in problems} == {"../out"} or all("taken" in n or "out" in n for n in problems)
    good = {r["name"] for r in out if not r["problem"]}
    assert {n for n in good if n.startswith("big")} == {f"big-{i}.uddf" for i in (1, 2, 3)}
    assert {p.name for p in tmp_path.iterdir() if p.is_file()} == good
    assert sink.write(rows.limit(0), f"file://{tmp_path}/none", F.lit("x")).count() == 0


def test_what_is_lost(spark):
    fields = {n: n for n in KINDS}
    (lost,) = {tuple(r[0]) for r in made(spark).where("number = 12").withColumn("water_type", F.lit("salt")).select(files.dropped(made(spark).withColumn("water_type", F.lit("salt")), fields, sink.KEPT)).collect()}
    assert lost == ("service_fields", "water_type")


def test_fragments_are_told_in_few_passes(spark):
    """One pass makes the dives, one tells all entities apart, and one more the sensors', however many kinds there are."""
    plan = sink.rendered(made(spark), F.lit("log"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 3


def test_a_lost_file_fails_the_query(spark, tmp_path, monkeypatch):
    catalogue.load()
    (tmp_path / "a1.uddf").mkdir()
    monkeypatch.setattr(orders, "shared_path", lambda *_: f"file://{tmp_path}")
    with pytest.raises(OSError, match=r"1 files were not written, such as a1\.uddf: IsADirectoryError"):
        catalogue.QUERIES["source_uddf"](spark, str(DATA / "sf0.001"))


def test_a_fault_of_the_rows_is_no_outcome_of_a_file(tmp_path):
    def rows():
        yield ("a", 0, "<divecomputer/>")
        yield ("b", 7, "<dive/>")
        raise EOFError("the rest is lost")

    put = sink.put_files(rows(), fs.LocalFileSystem(), str(tmp_path))
    assert next(put)[0::2] == ("a.uddf", None)
    with pytest.raises(EOFError):
        next(put)
    assert [p.name for p in tmp_path.iterdir()] == ["a.uddf"]


def test_numbers_stay_as_they_were_written(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, -0.0, 12.0, 12.5, 0.0005, 1e-9, -3.14159, 123456789.125, 1e20, float("nan"), float("inf"), None)], "x double")
    got = [r[0] for r in rows.select(sink._plain(F.col("x"), 3)).collect()]
    assert got == ["0", "0", "12", "12.5", "0.001", "0", "-3.142", "123456789.125", "100000000000000000000", None, None, None]


def test_dives_are_not_dealt_out_to_be_numbered(spark):
    """Only ids that several dives share need a window."""
    plan = sink.rendered(made(spark).where("number = 12"), F.lit("log"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "sha1(to_json(struct(local" not in plan
