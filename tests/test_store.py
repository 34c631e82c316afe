"""The store of accounts, raw caches, the contract of sources, and files with outcomes."""

import re
import threading
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyweave.sinks import files
from tallyweave.sources import caches, contract, store

SHAPE = "service string, account string, id string, local timestamp_ntz, kind string, m map<string,int>, note string"


def rows(*given):
    return [(s, a, i, datetime(*d) if d else None, k, {"x": 1}, n) for s, a, i, d, k, n in given]


FIRST = rows(
    ("g", "ann", "1", (2024, 1, 5), "scuba", "one"), ("g", "ann", "2", (2024, 1, 9), "apnea", "two"), ("g", "ann", "3", (2024, 3, 1), "scuba", "three"), ("g", None, "1", (2024, 1, 7), None, "no account"),
    ("d", "b/c =%+ü", "9", None, "scuba", "undated"), ("d", " ", "9", (2023, 12, 31, 23, 59), "scuba", "blank account"), ("g", "ann", "3", (2024, 3, 1), "scuba", "thrice"), ("g", "ann", None, (2024, 3, 2), "scuba", "no id"),
)


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/store"


def notes(df):
    return sorted(r["note"] for r in df.collect())


def test_publish_and_read(spark, place):
    assert store.publish(spark.createDataFrame(FIRST, SHAPE), place) == 1
    got = store.read(spark, place)
    assert notes(got) == ["blank account", "no account", "no id", "one", "thrice", "two", "undated"]
    assert {(r["account"], r["month"]) for r in got.where("service = 'd'").collect()} == {("b/c =%+ü", "undated"), ("default", "2023-12")}
    assert got.where("note = 'one'").first()["m"] == {"x": 1}
    assert notes(contract.between(got, datetime(2023, 12, 31, 23, 59), datetime(2024, 1, 7))) == ["blank account", "no account", "one"]
    assert notes(store.one(spark, place, "1")) == ["no account", "one"]
    assert [r["note"] for r in store.newest(spark, place, 2).collect()] == ["no id", "thrice"]
    assert [r["note"] for r in store.newest(spark, place, 99).collect()] == ["no id", "thrice", "two", "no account", "one", "blank account"]


def test_filters_open_only_what_they_need(spark, place, tmp_path):
    """With every other file damaged, queries on time, account, kind or id still read theirs."""
    store.publish(spark.createDataFrame(FIRST, SHAPE), place)
    frame = lambda: store.read(spark, place, ["id", "local", "note", "account", "service", "kind"])
    cases = [
        (lambda d: contract.between(d, datetime(2024, 3, 1)), "2024-03", ["no id", "thrice"]), (lambda d: d.where("account = 'ann' and local < timestamp_ntz'2024-02-01'"), "account=ann/month=2024-01", ["one", "two"]),
        (lambda d: d.where("service = 'd' and account = 'default'"), "service=d/account=default", ["blank account"]), (lambda d: d.where("kind = 'apnea'"), "account=ann/month=2024-01", ["two"]), (lambda d: d.where("id = '9' and local is null"), "service=d|2024-03", ["undated"]),
    ]
    kept = {p: p.read_bytes() for p in (tmp_path / "store/data").rglob("*.parquet")}
    for narrow, needed, expected in cases:
        for p, content in kept.items():
            p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
            p.write_bytes(content if re.search(needed, str(p)) else b"no parquet")
        assert notes(narrow(frame())) == expected
    with pytest.raises(Exception):
        frame().collect()


def test_second_publish_replaces_what_changed(spark, place):
    store.publish(spark.createDataFrame(FIRST, SHAPE), place)
    assert store.publish(spark.createDataFrame(FIRST, SHAPE).where("account = 'ann'"), place) == 1
    old = store.read(spark, place)
    moved = rows(("g", "ann", "2", (2024, 5, 1), "apnea", "two moved"))
    assert store.publish(spark.createDataFrame(moved, SHAPE), place) == 2
    assert notes(store.read(spark, place)) == ["blank account", "no account", "no id", "one", "thrice", "two moved", "undated"]
    assert notes(old) == notes(store.read(spark, place, number=1)) == ["blank account", "no account", "no id", "one", "thrice", "two", "undated"]
    made = {(r["account"], r["month"]): int(r["file"].split("generation=")[1][:9]) for r in store.files(spark, place, 2).where("service = 'g'").collect()}
    assert made == {("ann", "2024-01"): 2, ("ann", "2024-05"): 2, ("ann", "2024-03"): 1, ("default", "2024-01"): 1}
    # all that an account has: the others of it go, other accounts stay
    assert store.publish(spark.createDataFrame(moved, SHAPE), place, everything=True) == 3
    assert notes(store.read(spark, place)) == ["blank account", "no account", "two moved", "undated"]
    assert store.publish(spark.createDataFrame([], SHAPE), place, everything=True) == 3
    assert store.vacuum(spark, place, keep=1) == 2 and notes(store.read(spark, place)) == ["blank account", "no account", "two moved", "undated"]
    with pytest.raises(ValueError):
        store.generation(place, 1)
    with pytest.raises(ValueError):
        store.publish(spark.createDataFrame(moved, SHAPE).withColumn("more", F.lit(1)), place)


def test_one_of_two_writers_wins(spark, place):
    store.publish(spark.createDataFrame(FIRST, SHAPE), place)
    done = []

    def run(i):
        try:
            done.append(store.publish(spark.createDataFrame(rows(("g", f"w{i}", "1", (2024, 1, 1), None, f"writer {i}")), SHAPE), place))
        except RuntimeError:
            done.append(None)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = [n for n in notes(store.read(spark, place)) if n.startswith("writer")]
    assert sorted(map(str, done)) in (["2", "None"], ["2", "3"]) and len(got) == len([d for d in done if d])


def test_nothing_published(spark, place):
    assert store.generation(place).number == 0
    with pytest.raises(Exception, match="nothing was published"):
        store.read(spark, place).collect()


def test_raw_caches(spark, tmp_path):
    def put(path, content):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)

    put("divelogs/ann/data/1_2024-05-01_102345_77.json", b'{"id": 77, "date": "2024-05-01", "time": "10:23:45", "maxdepth": 9}')
    put("divelogs/ann/data/nonum_2024-06-01_000000_78.JSON", b'\xef\xbb\xbf{"id": 78, "date": "2024-06-01", "time": "00:00:00"}')
    put("divelogs/default/data/odd.json", b"[1]")
    put("divelogs/default/data/bad.json", b"\xff\xfe")
    put("divelogs/ann/data/.hidden.json", b"{}")
    put("divelogs/ann/data/below/x.json", b"{}")
    put("divelogs/ann/data/x.txt", b"{}")
    put("garmin/ann/data/5_2024-05-01_102345_5.json", b'{"summary": {"activityId": 5, "startTimeLocal": "2024-05-01 10:23:45"}}')
    put("ssi/ann/tokens/x.json", b"{}")
    all_ = caches.raw(spark, str(tmp_path))
    assert sorted((r["service"], r["account"], r["id"]) for r in all_.collect() if r["id"]) == [("divelogs", "ann", "77"), ("divelogs", "ann", "78"), ("garmin", "ann", "5")]
    assert all_.count() == 5 and all_.where("account is null").count() == 2
    assert [r["problem"] for r in all_.where("problem is not null").collect()] == ["can't be read: UnicodeDecodeError"]
    assert [r["id"] for r in contract.between(all_, datetime(2024, 5, 15)).collect()] == ["78"]
    got = {r["file"].rpartition("/")[2]: r for r in caches.records(all_, "divelogs").collect()}
    assert got["1_2024-05-01_102345_77.json"]["max_depth"] == 9.0 and got["nonum_2024-06-01_000000_78.JSON"]["external_ids"] == {"divelogs": "78"}
    assert {n: r["problem"] for n, r in got.items() if r["problem"]} == {"bad.json": "can't be read: UnicodeDecodeError", "odd.json": "not a JSON object of this service"}
    assert caches.raw(spark, str(tmp_path / "none")).count() == 0


def test_wanted_only_narrows():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, LessThanOrEqual, Not

    w = contract.Wanted()
    for f in (EqualTo(("service",), "g"), In(("service",), ("g", "d")), IsNull(("id",)), EqualTo(("note",), "x"), Not(EqualTo(("service",), "g")), GreaterThan(("local",), datetime(2024, 1, 1)), GreaterThan(("local",), datetime(2023, 1, 1)), LessThanOrEqual(("local",), datetime(2024, 2, 1)), EqualTo(("a", "service"), "z")):
        w.add(f)
    assert w.values == {"service": {"g"}} and (w.since, w.until) == (datetime(2024, 1, 1), datetime(2024, 2, 1))
    assert not w.overlaps(None, None) and w.overlaps(datetime(2023, 1, 1), datetime(2024, 1, 1)) and not w.overlaps(datetime(2024, 2, 2), datetime(2024, 3, 1))


def test_files_and_their_outcomes(spark, tmp_path):
    (tmp_path / "out/taken").mkdir(parents=True)
    (tmp_path / "out/file").write_text("a file where a folder is needed")
    given = [("a.txt", "one"), ("deep/b ü.txt", None), ("taken", "x"), ("file/c.txt", "x"), ("twice", "1"), ("twice", "2"), (None, "x"), ("", "x"), ("../out.txt", "x"), ("/abs", "x"), ("n" * 300, "x")]
    out = files.write_each(spark.createDataFrame(given, "name string, body string").repartition(3).withColumn("content", F.lit(1)), str(tmp_path / "out"), F.col("name"), F.col("body"))
    got = [(r["name"], r["bytes"], r["problem"]) for r in out.collect()]
    assert len(got) == len(given)
    assert sorted(g[:2] for g in got if g[2] is None) == [("a.txt", 3), ("deep/b ü.txt", 0)]
    why = {g[0]: g[2] for g in got if g[2]}
    assert why["twice"] == "several records have this name" and why["../out.txt"] == why[""] == why[None] == why["/abs"] == "ValueError: no name for a file"
    assert all(why[n] for n in ("taken", "file/c.txt", "n" * 300))
    left = {str(p.relative_to(tmp_path / "out")) for p in Path(tmp_path / "out").rglob("*") if p.is_file()}
    assert left == {"a.txt", "deep/b ü.txt", "file"} and (tmp_path / "out/a.txt").read_text() == "one"
    assert files.write_each(spark.createDataFrame([], "name string, body string"), str(tmp_path / "out"), F.col("name"), F.col("body")).count() == 0
