"""Boards, edits, links of ids and uploads on small rows, with the odd cases."""

import pytest
from pyspark.sql import functions as F

from tallyweave.plans import boards, edits
from tallyweave.plans import rules as rl
from tallyweave.schema import record, sample

LINK = "board int, pos int, id string, source array<string>, target string, direction string, conflict string, template string, reverse string, separator string, take string, match_order int, own string"


def link(pos, id_, source, target, direction, conflict, template=None, reverse=None, take=None, order=None):
    return (1, pos, id_, source, target, direction, conflict, template, reverse, ", ", take, order, "kept out")


GIVEN = [
    link(1, "notes", ["a.notes"], "b.notes", "bidirectional", "manual", order=2),
    link(2, "temp", ["a.temp"], "b.temp", "bidirectional", "target_wins"),
    link(3, "title", ["a.site", "a.place"], "b.title", "bidirectional", "prefer_source", "{site}, {place}", "auto"),
    link(4, "words", ["a.x", "a.y"], "b.words", "to_source", "manual", "{x} {y}", "auto"),
    link(5, "no", ["a.no"], "b.no", "off", "target_wins"),
    link(6, "part", ["a.long"], "b.short", "to_target", "source_wins", take="^[a-z]+"),
    link(7, "back", ["a.back"], "b.back", "to_source", "prefer_non_empty"),
    link(8, "key", ["a.number"], "b.number", "off", "source_wins", order=1),
]


def told(rows, *names):
    return sorted(tuple(tuple(r[n]) if isinstance(r[n], list) else r[n] for n in names) for r in rows.collect())


def test_links_to_rules_and_back(spark):
    given = spark.createDataFrame(GIVEN, LINK)
    rules, keys = boards.rules(given), boards.match_keys(given, "a")
    assert told(rules, "receiver", "id", "target", "conflict") == [
        ("a", "back", "a.back", "prefer_non_empty"), ("a", "notes", "a.notes", "manual"), ("a", "temp", "a.temp", "source_wins"),
        ("b", "no", "b.no", "target_wins"), ("b", "notes", "b.notes", "manual"), ("b", "part", "b.short", "source_wins"), ("b", "temp", "b.temp", "target_wins"), ("b", "title", "b.title", "prefer_source"), ("b", "words", "b.words", "target_wins"),
    ]
    assert told(keys, "ord", "a", "b") == [(1, "a.number", "b.number"), (2, "a.notes", "b.notes")]
    again = boards.links(rules, keys, "a", "b")
    shape = ("id", "source", "target", "direction", "conflict", "match_order")
    # a plain link that goes to the source only is shown from its receiver's side, and a key without a rule gets its field's name
    changed = {"back": ("back", ("b.back",), "a.back", "to_target", "prefer_non_empty", None), "key": ("number", ("a.number",), "b.number", "off", "source_wins", 1)}
    want = [changed.get(g[2], (g[2], tuple(g[3]), g[4], g[5], g[6], g[11])) for g in GIVEN]
    assert sorted(told(again, *shape), key=str) == sorted(want, key=str)
    pos = again.withColumn("pos", F.col("place.pos"))
    names = [c for c in boards.RULES if c != "pos"]
    assert told(boards.rules(pos).select(*names).fillna(""), *names) == told(rules.select(*names).fillna(""), *names)
    assert told(boards.match_keys(pos, "a"), "ord", "a", "b") == told(keys, "ord", "a", "b")


def test_ids_that_both_sides_use_and_two_marks(spark):
    rules = spark.createDataFrame([(1, r, 1, "x", [s], t, "target_wins", ", ") for r, s, t in (("a", "b.f", "a.f"), ("b", "a.f", "b.f"))], "board int, receiver string, pos int, id string, source array<string>, target string, conflict string, separator string")
    rules = rules.withColumns({n: F.lit(None).cast("string") for n in ("template", "reverse", "reverse_conflict", "take")})
    keys = spark.createDataFrame([], "board int, ord int, a string, b string")
    assert told(boards.links(rules, keys, "a", "b"), "id", "target", "direction", "conflict") == [("x", "b.f", "off", "target_wins"), ("x@a", "a.f", "off", "target_wins")]
    assert boards.links(rules.limit(0), keys, "a", "b").collect() == []


def test_loops_through_other_links(spark):
    rows = [
        link(1, "title", ["a.site", "a.place"], "b.title", "to_target", "source_wins", "{site} {place}"), link(2, "one", ["b.title"], "a.mid", "to_target", "manual"), link(3, "two", ["b.deep"], "a.mid", "to_source", "manual"),
        link(4, "three", ["a.place"], "b.deep", "bidirectional", "manual"), link(5, "fine", ["a.x", "a.y"], "b.z", "bidirectional", "manual", "{x} {y}", "auto"), link(6, "off", ["b.z"], "a.x", "off", "manual"),
    ]
    assert told(boards.loops(spark.createDataFrame(rows, LINK)), "board", "id", "via") == [(1, "title", "three")]
    assert boards.loops(spark.createDataFrame([], LINK)).collect() == []


def one(spark, **asked):
    values = {"local": F.lit("2024-07-01 10:00:00").cast("timestamp_ntz"), "utc": F.lit("2024-07-01 08:00:00").cast("timestamp_ntz"), "zone": F.lit("Europe/Vienna"), "max_depth": F.lit(9.0), "temp_max": F.lit(20.0), "notes": F.lit("n")}
    rows = record(spark.range(1), values, "id").withColumn("asked", F.lit(None).cast("map<string,string>") if not asked else F.create_map(*[F.lit(x) for kv in asked.items() for x in kv]).cast("map<string,string>"))
    return edits.edited(rows.withColumn("weights", F.lit("clash"))).first()


def test_edits(spark):
    same = one(spark)
    assert (same.problems, same.max_depth, same.notes, same.weights) == ([], 9.0, "n", "clash")
    assert one(spark, max_depth="", colour="x").problems == ["not an editable field: colour", "max_depth: a value is needed"]
    assert one(spark, temp_min="21").problems == ["temp_min: above temp_max"]
    assert one(spark, lat="nan", number="99999999999", gf_low="101").problems == ["number: too large", "lat: not a number: nan", "gf_low: above 100"]
    winter = one(spark, date="2024-1-5")
    assert (str(winter.local), str(winter.utc), winter.zone) == ("2024-01-05 10:00:00", "2024-01-05 09:00:00", "Europe/Vienna")
    no_zone = one(spark, time="11:15", utc_offset="")
    assert (str(no_zone.local), str(no_zone.utc), no_zone.zone) == ("2024-07-01 11:15:00", "2024-07-01 09:15:00", None)
    assert one(spark, date="2024-02-30", utc_offset="+15").problems == ["date: use YYYY-MM-DD, not 2024-02-30", "utc_offset: not an offset: +15"]
    assert one(spark, notes="  ", water_type="beer", visibility="3").notes == "n"
    taken = one(spark, notes="  ", water_type=" salt ", visibility="3")
    assert (taken.notes, taken.water_type, taken.visibility, taken.visibility_unit) == (None, "salt", 3.0, "meter")


def test_edit_of_a_profile_and_an_empty_table(spark):
    rows = record(spark.range(1), {"samples": F.array(sample(F.lit(0), F.lit(1.0)))}).withColumn("asked", F.create_map(F.lit("duration"), F.lit("60")))
    assert edits.edited(rows).first().problems == ["duration: set by the profile"]
    assert edits.edited(rows.limit(0)).collect() == []


@pytest.mark.parametrize(("a_ids", "b_ids", "want"), [({"a": "1"}, {"b": "2"}, ({"a": "1", "b": "2"}, {"b": "2", "a": "1"}, 2)), ({"a": " "}, {"b": "2"}, ({"a": " "}, {"b": "2"}, 0)), (None, {"b": "2"}, ({}, {"b": "2"}, 0)), ({"a": "1", "b": "9"}, {"b": "2"}, ({"a": "1", "b": "9"}, {"b": "2", "a": "1"}, 1))])
def test_ids_across(spark, a_ids, b_ids, want):
    rows = spark.createDataFrame([((a_ids,), (b_ids,))], "a struct<external_ids:map<string,string>>, b struct<external_ids:map<string,string>>")
    got = rl.linked(rows, "a", "b").first()
    assert (got.a.external_ids, got.b.external_ids, len(got.outcomes)) == want


def test_problems_of_a_board():
    fields = {f.key: f for f in (rl.Field("a.site"), rl.Field("a.place"), rl.Field("b.title"), rl.Field("b.fixed", writable=False), rl.Field("a.tanks", "tanks"), rl.Field("b.number", "number"))}
    title = rl.Rule("title", ("a.site", "a.place"), "b.title", "{site} ({place})", reverse="auto")
    assert rl.problems([title, rl.Rule("mirror", ("a.site",), "b.title"), rl.Rule("mirror2", ("b.fixed",), "a.place")], fields) == []
    feeds = rl.Rule("feeds", ("b.title",), "a.site")
    assert [r for r, _ in rl.problems([title, feeds], fields)] == ["title"]
    wrong = [rl.Rule("a", ("a.none",), "b.title"), rl.Rule("b", ("a.site",), "b.fixed"), rl.Rule("c", ("a.tanks",), "b.title", "{tanks}"), rl.Rule("d", ("a.site", "a.place"), "b.title"), rl.Rule("e", ("a.site",), "b.number"), rl.Rule("f", ("a.site",), "b.title", take="(")]
    assert [r for r, _ in rl.problems(wrong, fields)] == ["a", "b", "c", "d", "e", "f"]
