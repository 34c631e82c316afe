"""Readers of log formats on small files: whole dives, damaged files, empty folders, odd values."""

import json
from datetime import datetime

import pytest

from tallyweave.schema import KINDS
from tallyweave.sources import git_tree, services, ssrf, uddf, xmls

GARMIN = {
    "summary": {"activityId": 77, "activityName": "Reef", "startTimeLocal": "2024-05-01T10:00:00.0", "startTimeGMT": "2024-05-01T08:00:00.0", "duration": 1800.7, "maxDepth": 20.5, "locationName": "Bay"},
    "details": {"summaryDTO": {"startLatitude": 1.5, "startLongitude": 2.5, "averageDepth": 11.0, "minTemperature": 0}, "metadataDTO": {"diveNumber": "12", "manualActivity": False}, "diveInfo": {"diveGases": [{"gasIndex": 0, "oxygenContent": 32}], "weight": 6, "weightUnit": {"unitKey": "kilogram"}}},
    "activityDetails": {"metricDescriptors": [{"metricsIndex": 1, "key": "directDepth"}, {"metricsIndex": 0, "key": "sumDuration"}], "activityDetailMetrics": [{"metrics": [0, 1.0]}, {"metrics": [10, 5.5]}, {"metrics": [20, None]}]},
    "tanksensor": {"tankSensors": [{"tankIndex": 0, "name": "A", "startingPressure": 3000, "endingPressure": 1000, "pressureUnit": "PSI"}]},
}
DIVELOGS = {"id": 5, "divenumber": "3", "date": "2024-05-02", "time": "09:30:00", "duration": 600, "maxdepth": 10, "depthtemp": 0, "location": "Bay", "divesite": "Wall", "samplerate": 20, "sampledata": [1.0, {"d": 4.5, "t": 18}], "weights": "4 kg", "lat": 0, "lng": 0, "tanks": [{"o2": 21, "start_pressure": 200, "end_pressure": 60, "vol": 12}]}
SSI = {"odin_user_log_id": 9, "odin_user_log_nr": 4, "odin_user_log_datetime": "2024-05-03 11:00:00", "odin_user_log_divetime": 40, "odin_user_log_depth_m": "18.2", "odin_user_log_divecomputer_dive_ref": "garmin:77", "odin_user_log_tank_vol_l": 12, "odin_user_log_var_watertype_id": 5, "odin_user_log_diveSamples": json.dumps([{"d": 2, "t": 1000, "te": 0, "ndl": 99}, {"d": 3, "t": 2000, "te": 20, "pressure": 190, "ndl": 40}])}


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def folder(tmp_path, **files):
    for name, content in files.items():
        (tmp_path / name.replace("__", ".")).write_text(content)
    return f"file://{tmp_path}"


def test_garmin(spark, tmp_path):
    (r,) = rows_of(services.read(spark, folder(tmp_path, a__json=json.dumps(GARMIN)), "garmin"))
    assert r["problem"] is None and r["local"] == datetime(2024, 5, 1, 10) and r["utc"] == datetime(2024, 5, 1, 8)
    assert (r["duration"], r["max_depth"], r["avg_depth"], r["temp_min"], r["number"]) == (1800, 20.5, 11.0, None, 12)
    assert [(s["t"], s["depth"]) for s in r["samples"]] == [(0, 1.0), (10, 5.5)]
    assert r["external_ids"] == {"garmin": "77"} and r["device_logged"] is True and (r["lat"], r["lng"]) == (1.5, 2.5)
    (t,) = r["tanks"]
    assert t["oxygen"] == 32 and t["name"] == "A" and abs(t["start"] - 206.84) < 0.01


def test_divelogs(spark, tmp_path):
    path = folder(tmp_path, a__json=json.dumps(DIVELOGS))
    (r,) = rows_of(services.read(spark, path, "divelogs"))
    assert r["local"] == datetime(2024, 5, 2, 9, 30) and r["location"] == "Bay, Wall" and (r["lat"], r["lng"]) == (None, None)
    assert [(s["t"], s["depth"], s["temp"]) for s in r["samples"]] == [(0, 1.0, None), (20, 4.5, 18.0)]
    assert (r["weight"], r["weight_unit"], r["temp_min"]) == (4.0, "kilogram", None)
    (r,) = rows_of(services.read(spark, path, "divelogs", imperial=True))
    assert abs(r["max_depth"] - 3.048) < 1e-3


def test_ssi(spark, tmp_path):
    gone = SSI | {"odin_user_log_deleted": "1"}
    (r,) = rows_of(services.read(spark, folder(tmp_path, a__json=json.dumps(SSI), b__json=json.dumps(gone)), "ssi"))
    assert r["external_ids"] == {"ssi": "9", "garmin": "77"} and r["water_type"] == "salt" and r["duration"] == 2400
    assert [(s["t"], s["temp"], s["pressure"]) for s in r["samples"]] == [(1, None, None), (2, 20.0, 190.0)]
    assert r["samples"][1]["channels"]["ndl"] == 2400


@pytest.mark.parametrize("service", sorted(services.READERS))
def test_bad_json_and_empty_folder(spark, tmp_path, service):
    empty = tmp_path / "empty"
    empty.mkdir()
    assert services.read(spark, f"file://{empty}", service).count() == 0
    (r,) = rows_of(services.read(spark, folder(tmp_path, a__json="{oops"), service))
    assert r["problem"] and r["local"] is None and r["samples"] == []


UDDF = """<uddf version="3.2.0"><generator><name>other</name></generator>
<gasdefinitions><mix id="ean"><o2>0.32</o2><he>0</he></mix></gasdefinitions>
<diver><owner id="o"><equipment><divecomputer id="dc"><name>Perdix</name><serialnumber>s1</serialnumber></divecomputer></equipment></owner>
<buddy id="b1"><personal><firstname>Ann</firstname><lastname>Lee</lastname></personal></buddy></diver>
<divesite><site id="s"><name>Wall</name><geography><latitude>10.5</latitude><longitude>20.5</longitude></geography></site></divesite>
<profiledata><repetitiongroup><dive id="d1"><informationbeforedive><link ref="s"/><link ref="b1"/><divenumber>7</divenumber><datetime>2024-05-04T10:00:00</datetime></informationbeforedive>
<tankdata id="T1"><link ref="ean"/><tankvolume>0.012</tankvolume><tankpressurebegin>20000000</tankpressurebegin></tankdata>
<samples><waypoint><depth>0</depth><divetime>0</divetime><switchmix ref="ean"/></waypoint>
<waypoint><depth>12.5</depth><divetime>60</divetime><temperature>293.15</temperature><tankpressure ref="T1">19000000</tankpressure><alarm>ascent</alarm></waypoint></samples>
<informationafterdive><greatestdepth>12.5</greatestdepth><diveduration>120</diveduration><notes><para>one</para><para>two</para></notes></informationafterdive></dive>
<dive id="d2"><informationbeforedive/></dive></repetitiongroup></profiledata></uddf>"""


def test_uddf(spark, tmp_path):
    (r,) = rows_of(uddf.read(spark, folder(tmp_path, a__uddf=UDDF)))
    assert (r["number"], r["location"], r["lat"], r["buddy"], r["notes"]) == (7, "Wall", 10.5, "Ann Lee", "one\ntwo")
    assert r["local"] == datetime(2024, 5, 4, 10) and r["external_ids"] == {"uddf": "d1"}
    (t,) = r["tanks"]
    assert (t["oxygen"], t["start"], t["volume"]) == (32.0, 200.0, 12.0)
    assert [(s["t"], s["depth"], s["temp"], s["pressure"]) for s in r["samples"]] == [(0, 0.0, None, None), (60, 12.5, 20.0, 190.0)]
    assert [(e["t"], e["type"], e["tank"]) for e in r["events"]] == [(0, "gas_switch", 0), (60, "alert", None)]


SSRF = """<divelog program='x' version='3'><settings><divecomputerid model='Perdix' deviceid='ab' serial='s1' firmware='7'/></settings>
<divesites><site uuid=' 1a' name='Wall' gps='10.5 20.5'/></divesites>
<dives><trip date='2024-05-05'><dive number='8' divesiteid='1a' date='2024-05-05' time='10:00:00' duration='2:00 min' tags='deep, wreck'>
<buddy>Ann</buddy><cylinder size='12.0 l' workpressure='232.0 bar' o2='32.0%'/><weightsystem weight='4.0 kg'/><weightsystem weight='2.0 kg'/>
<divecomputer model='Shearwater Perdix' deviceid='ab'><depth max='12.5 m' mean='8.0 m'/><temperature water='20.0 C'/>
<event time='0:10 min' type='25' flags='1' name='gaschange' cylinder='0'/>
<sample time='0:00 min' depth='0.0 m' temp='20.0 C' pressure='200.0 bar'/><sample time='1:00 min' depth='12.5 m' pressure='190.0 bar' ndl='40:00 min'/><sample time='2:00 min' depth='3.0 m'/></divecomputer></dive></trip>
<dive number='9'/></dives></divelog>"""


def test_ssrf(spark, tmp_path):
    (r,) = rows_of(ssrf.read(spark, folder(tmp_path, a__ssrf=SSRF)))
    assert (r["number"], r["location"], r["lat"], r["duration"], r["weight"], r["buddy"]) == (8, "Wall", 10.5, 120, 6.0, "Ann")
    assert (r["computer_vendor"], r["computer_model"], r["computer_serial"]) == ("Shearwater", "Perdix", "s1")
    (t,) = r["tanks"]
    assert (t["oxygen"], t["start"], t["end"], t["volume"]) == (32.0, 200.0, 190.0, 12.0)
    assert [(s["t"], s["depth"], s["temp"], s["pressure"]) for s in r["samples"]] == [(0, 0.0, 20.0, 200.0), (60, 12.5, 20.0, 190.0), (120, 3.0, 20.0, None)]
    assert [(s["channels"] or {}).get("ndl") for s in r["samples"]] == [None, 2400, 2400]
    assert [(e["t"], e["type"], e["tank"]) for e in r["events"]] == [(10, "gas_switch", 0)]


@pytest.mark.parametrize("read", [uddf.read, ssrf.read])
def test_files_that_are_no_xml(spark, tmp_path, read):
    df = read(spark, folder(tmp_path, a__xml="no xml at all", b__xml="<x><dive></x>"))
    assert df.count() == 0 and set(KINDS) <= set(df.columns)


def test_git_tree(spark, tmp_path):
    day = tmp_path / "2024" / "05" / "05-Sun-10=00=00"
    day.mkdir(parents=True)
    (tmp_path / "01-Divesites").mkdir()
    (tmp_path / "01-Divesites" / "Site-0000001a").write_text('name "Wall"\ngps 10.5 20.5\n')
    (day / "Dive-8").write_text('duration 2:00 min\nrating 4\ntags "deep", "wreck"\ndivesiteid 0000001a\nbuddy "Ann"\nnotes "one\n\ttwo"\ncylinder vol=12.0l o2=32.0% depth=33.0m\nweightsystem weight=4.0kg\n')
    (day / "Divecomputer").write_text('model "Perdix"\nmaxdepth 12.5m\nwatertemp 20.0°C\n  0:00 0.0m 20.0°C 200.0bar\n  1:00 12.5m 190.0bar\n')
    (tmp_path / "2024" / "05" / "notes.txt").write_text("not a dive")
    (r,) = rows_of(git_tree.read(spark, f"file://{tmp_path}"))
    assert (r["number"], r["location"], r["lat"], r["buddy"], r["notes"], r["weight"]) == (8, "Wall", 10.5, "Ann", "one\ntwo", 4.0)
    assert r["local"] == datetime(2024, 5, 5, 10) and r["duration"] == 120 and r["max_depth"] == 12.5
    assert r["external_ids"] == {"subsurface": "2024/05/05-Sun-10=00=00/Dive-8"} and r["service_fields"]["tags"] == "deep, wreck"
    (t,) = r["tanks"]
    assert (t["oxygen"], t["volume"], t["start"], t["end"]) == (32.0, 12.0, 200.0, 190.0)
    assert [(s["t"], s["depth"], s["temp"], s["pressure"]) for s in r["samples"]] == [(0, 0.0, 20.0, 200.0), (60, 12.5, None, 190.0)]


TREE_SAMPLES = {
    "plain": ("  0:00 0.0m 20.0°C 200.0bar\n  1:00 12.5m 190.0bar 180.5bar:1\n  2:00 ndl\n  3:00 3.0m 0.0bar\n", [(0, 0.0, 20.0, 200.0, None), (60, 12.5, None, 190.0, {0: 190.0, 1: 180.5}), (180, 3.0, None, None, None)], None),
    "more": ("  0:00 0.0m 20.0°C 200.0bar\n  1:00 12.5m 190.0bar 180.5bar:1 ndl=5:00\n  2:00 1.0m\n", [(0, 0.0, 20.0, 200.0, None), (60, 12.5, None, 190.0, {0: 190.0, 1: 180.5}), (120, 1.0, None, None, None)], [None, 300, 300]),
    "second": ("0:10 5.0m 100.5bar:2\n0:20 6.0m\n", [(10, 5.0, None, 100.5, {2: 100.5}), (20, 6.0, None, None, None)], None),
    "none": ("", [], None),
}


def test_git_tree_samples_with_and_without_standing_values(spark):
    """Dives whose samples write no more than plain ones go another way than the others; what they give is the same."""
    rows = []
    for i, (name, (lines, _, _)) in enumerate(TREE_SAMPLES.items()):
        folder = f"/log/2024/05/{'05-Trip 1/' if i % 2 else ''}0{i + 1}-Sun-10=00=00"
        rows += [(f"{folder}/Dive-{i}", f'notes "{name} \\\\ \\"q\\""\ncylinder vol="12.0l" o2=50.0% description="a b" use=bailout\n'), (f"{folder}/Divecomputer", f'model "One"\nkeyvalue "x" "a=b"\n{lines}'), (f"{folder}/notes.txt", "duration 9:00 min")]
    rows += [("/log/2024/05/09-Sun-10=00=00/Divecomputer", "maxdepth 3.0m"), ("/log/2024/13/01-Sun-10=00=00/Dive-7", ""), ("/log/2024/05/01-Sun-10=00=00/Dive-1-2", ""), ("/log/x/Dive-1", "")]
    out = git_tree.records(spark.createDataFrame(rows, "path string, text string"))
    got = {r["number"]: r for r in rows_of(out)}
    assert sorted(got) == [0, 1, 2, 3]
    for i, (name, (_, samples, ndl)) in enumerate(TREE_SAMPLES.items()):
        r = got[i]
        assert r["notes"] == f'{name} \\ "q"' and r["local"] == datetime(2024, 5, i + 1, 10)
        assert [(t["volume"], t["oxygen"], t["name"], t["role"]) for t in r["tanks"]] == [(12.0, 50.0, "a b", "bailout")]
        assert [(s["t"], s["depth"], s["temp"], s["pressure"]) for s in r["samples"]] == [x[:4] for x in samples], name
        if ndl:
            assert [(s["channels"] or {}).get("ndl") for s in r["samples"]] == ndl
        assert [((s["channels"] or {}).get("pressures") or None) for s in r["samples"]] == [x[4] if ndl is None else (s["channels"] or {}).get("pressures") or None for x, s in zip(samples, r["samples"], strict=True)], name


def test_git_tree_plain_dives_need_no_window(spark):
    """Folders are looked at once, not each file, and plain samples are made in place."""
    row = ("/log/2024/05/05-Sun-10=00=00/Dive-8", "duration 2:00 min\n")
    plan = git_tree.records(spark.createDataFrame([row], "path string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("try_make_timestamp_ntz") == 0


def test_uddf_files_are_scanned_once_for_dives_and_once_for_the_rest(spark, tmp_path):
    df = uddf.read(spark, folder(tmp_path, a__uddf=UDDF))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan xml") == 1


def test_uddf_lookups(spark, tmp_path):
    """The last site, the first computer and model count, buddies in the order of the links; an id's first element; elements wherever they stand, up to a file's damage."""
    text = UDDF.replace('<link ref="s"/><link ref="b1"/>', '<link ref="s"/><link ref="b2"/><link ref="s2"/><link ref="b1"/><link ref="s"/><link ref="nobody"/>')
    text = text.replace("</site></divesite>", '</site><site id="s2"><name>Reef</name></site><site id="s"><name>again</name></site><site><name>no id</name></site><!-- <site id="s"/> --></divesite>')
    text = text.replace("</personal></buddy>", '</personal><equipment><divecomputer id="of-buddy"><model>X</model></divecomputer></equipment></buddy><buddy id="b2"><personal><nickname>B &amp; "q"</nickname></personal></buddy>')
    text = text.replace("<informationafterdive>", '<informationafterdive><equipmentused><link ref="none"/><link ref="of-buddy"/><link ref="dc"/></equipmentused>', 1)
    damaged = text.replace('<dive id="d2">', "<dive id=")
    path = folder(tmp_path, **{"a b+c%20d__uddf": text, "e__uddf": damaged})
    rows = rows_of(uddf.read(spark, path))
    assert len(rows) == 2
    for r in rows:
        assert (r["location"], r["lat"], r["buddy"], r["computer_model"], r["external_ids"]["uddf"]) == ("Wall", 10.5, 'B & "q", Ann Lee', "X", "d1")
        assert [(t["oxygen"], t["name"]) for t in r["tanks"]] == [(32.0, "T1")]


def test_xml_elements_found():
    whole = b'<?xml version="1.0"?><a><s id=" 1 "><n>x &lt; y</n><s id="in"/><m id="2" q="&quot;"/></s><d><t/><t/></d><t/><d><t/></d><m/></a>'
    pieces = lambda text, n: iter([text[i : i + n] for i in range(0, len(text), n)])
    for n in (1, 7, 1_000):
        got = sorted(xmls.found(pieces(whole, n), {"s", "m"}, {("d", "t")}))
        assert [x[1:] for x in got] == [("s", "1", '<s id=" 1 "><n>x &lt; y</n><s id="in"></s><m id="2" q=\'"\'></m></s>'), ("m", "2", "<m id=\"2\" q='\"'></m>"), ("t", None, ""), ("m", None, "<m></m>")]
        assert [x[1] for x in sorted(xmls.found(pieces(whole[:-12] + b"</x>", n), {"s", "m"}, {("d", "t")}))] == ["s", "m", "t"]
