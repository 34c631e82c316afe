"""Rules and templates. Orders are one side's records, and a changed copy of them the other's."""

from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.catalogue.linking import ACCOUNT, EDGES, GREEDY, SHIFTS, SIDES, _rest, _round, side
from tallyweave.plans import edits
from tallyweave.plans import rules as rl
from tallyweave.plans import sync
from tallyweave.plans import templates as tp
from tallyweave.schema import ids, record, sample, tank

C = F.col
FIELDS = {f.key: f for f in (rl.Field("a.notes"), rl.Field("a.site"), rl.Field("a.place"), rl.Field("a.tags", "list"), rl.Field("a.number", "number"), rl.Field("b.notes"), rl.Field("b.title", max_length=30), rl.Field("b.words"), rl.Field("b.number", "number"))}


def pairs(t):
    k = C("o_orderkey")
    a = F.struct(F.when(k % 4 == 0, "").otherwise(C("o_orderpriority")).alias("notes"), F.concat(F.lit("Site "), (k % 10).cast("string")).alias("site"), F.when(k % 3 == 0, F.lit(None)).otherwise(C("o_orderstatus")).alias("place"), F.array(F.lit("x"), C("o_orderstatus")).alias("tags"), k.cast("double").alias("number"))
    b = F.struct(F.when(k % 5 == 0, "").when(k % 5 == 1, C("o_orderpriority")).otherwise("other").alias("notes"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("words"), F.when(k % 2 == 0, k.cast("double")).alias("number"))
    return t.orders.select(k.alias("i"), k.alias("j"), a.alias("a"), b.alias("b"))


SENT = "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END"
HAD = "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN o_orderpriority ELSE 'other' END"
TAKE = {"source_wins": "true", "prefer_source": "s <> ''", "prefer_non_empty": "s <> '' AND h = ''", "manual": "s <> '' AND h = ''"}


def _policy(policy: str):
    clash = "WHEN s <> '' AND h <> '' THEN 'conflict'" if policy == "manual" else ""
    sql = f"SELECT o_orderkey AS i, CASE WHEN s = h THEN 'equal' WHEN {TAKE[policy]} THEN 'write:b.notes' {clash} ELSE 'kept' END AS outcome, CASE WHEN s <> h AND ({TAKE[policy]}) THEN s ELSE h END AS notes FROM (SELECT o_orderkey, {SENT} AS s, {HAD} AS h FROM orders)"

    @query(f"rule_{policy}", sql)
    def run(t):
        board = [rl.Rule("notes", ("a.notes",), "b.notes", policies={"b": policy})]
        out = rl.apply(pairs(t), rl.select(board, "b"), FIELDS)
        return out.select("i", C("outcomes")[0]["outcome"].alias("outcome"), C("b.notes").alias("notes"))


for _p in TAKE:
    _policy(_p)


@query("rule_template", """SELECT o_orderkey AS i, substr('Site ' || (o_orderkey % 10) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ', ' || o_orderstatus END || ', no ' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0'), 1, 30) AS title FROM orders""")
def template(t):
    board = [rl.Rule("title", ("a.site", "a.place", "a.number"), "b.title", "{site}, {place}, no {number:06d}", policies={"b": "source_wins"})]
    out = rl.apply(pairs(t), rl.select(board, "b"), FIELDS)
    return out.select("i", C("b.title").alias("title"))


@query("rule_reverse_split", "SELECT o_orderkey AS i, 'Reef ' || o_orderkey AS site, 'Bay' AS place FROM orders")
def reverse_split(t):
    rows = pairs(t).withColumn("b", C("b").withField("title", F.concat(F.lit("Reef "), C("i").cast("string"), F.lit(" (Bay)"))))
    board = [rl.Rule("title", ("a.site", "a.place"), "b.title", "{site} ({place})", reverse="auto", policies={"a": "source_wins"})]
    out = rl.apply(rows, rl.select(board, "a"), FIELDS)
    return out.select("i", C("a.site").alias("site"), C("a.place").alias("place"))


@query("rule_take_part", "SELECT o_orderkey AS i, CASE WHEN o_orderkey % 4 = 0 THEN 'equal_or_blank' WHEN regexp_matches(o_orderpriority, '^([0-9])-') THEN substr(o_orderpriority, 1, 1) END AS notes FROM orders")
def take_part(t):
    board = [rl.Rule("notes", ("a.notes",), "b.notes", take=r"^(?P<take>[0-9])-", policies={"b": "source_wins"})]
    out = rl.apply(pairs(t), rl.select(board, "b"), FIELDS)
    return out.select("i", F.when(C("i") % 4 == 0, "equal_or_blank").otherwise(C("b.notes")).alias("notes"))


@query("rule_list_to_text", "SELECT o_orderkey AS i, 'x; ' || o_orderstatus AS words FROM orders")
def list_to_text(t):
    board = [rl.Rule("words", ("a.tags",), "b.words", separator="; ", policies={"b": "prefer_source"})]
    return rl.apply(pairs(t), rl.select(board, "b"), FIELDS).select("i", C("b.words").alias("words"))


BOARD = [rl.Rule("notes", ("a.notes",), "b.notes", policies={"b": "manual"}), rl.Rule("number", ("a.number",), "b.number", policies={"b": "prefer_non_empty"}), rl.Rule("words", ("a.notes", "a.site"), "b.words", "{notes} | {site}", separator=" | ", policies={"b": "prefer_source"})]


@query("rule_conflicts", f"""SELECT substr(sha1('a|b|notes|' || o_orderkey || '|' || o_orderkey), 1, 10) AS id, s AS sent, h AS had FROM (SELECT o_orderkey, {SENT} AS s, {HAD} AS h FROM orders) WHERE s <> '' AND h <> '' AND s <> h""")
def conflicts(t):
    out = rl.apply(pairs(t), rl.select(BOARD, "b"), FIELDS)
    return rl.conflicts(out, "a|b", C("i"), C("j")).select("id", "sent", "had")


@query("rule_resolve_conflicts", f"""SELECT substr(sha1('a|b|notes|' || o_orderkey || '|' || o_orderkey), 1, 10) AS id, CASE WHEN o_orderkey % 2 = 0 THEN s ELSE h END AS value FROM (SELECT o_orderkey, {SENT} AS s, {HAD} AS h FROM orders) WHERE s <> '' AND h <> '' AND s <> h""")
def resolve_conflicts(t):
    rows = rl.conflicts(rl.apply(pairs(t), rl.select(BOARD, "b"), FIELDS), "a|b", C("i"), C("j"))
    decided = rows.select(*rl.CONFLICT, F.when(C("source_id").cast("long") % 2 == 0, "source").otherwise("target").alias("side"))
    return rl.resolve(rows, decided).select("id", "value")


@query("rule_rehearsal", f"""WITH p AS (SELECT o_orderkey AS i, {SENT} AS s, {HAD} AS h FROM orders) SELECT i, 'notes' AS rule, CASE WHEN s = h THEN 'equal' WHEN s <> '' AND h = '' THEN 'write:b.notes' WHEN s <> '' THEN 'conflict' ELSE 'kept' END AS outcome FROM p
UNION ALL SELECT i, 'number', CASE WHEN i % 2 = 0 THEN 'equal' ELSE 'write:b.number' END FROM p UNION ALL SELECT i, 'words', 'write:b.words' FROM p""")
def rehearsal(t):
    return sync.rehearse(pairs(t), BOARD, FIELDS, "b").select("i", "rule", "outcome")


@query("rule_outcome_counts", f"""WITH p AS (SELECT o_orderkey AS i, {SENT} AS s, {HAD} AS h FROM orders) SELECT CASE WHEN s = h THEN 'equal' WHEN s <> '' AND h = '' THEN 'write:b.notes' WHEN s <> '' THEN 'conflict' ELSE 'kept' END AS outcome, count(*) AS n FROM p GROUP BY 1""")
def outcome_counts(t):
    return sync.rehearse(pairs(t), BOARD[:1], FIELDS, "b").groupBy("outcome").agg(F.count("*").alias("n"))


@query("template_dates", "SELECT o_orderkey, 'no ' || o_orderkey || ' on ' || strftime(o_orderdate, '%d.%m.%Y') AS text FROM orders")
def dates(t):
    value = {"n": (C("o_orderkey"), "number"), "at": (C("o_orderdate").cast("timestamp_ntz"), "datetime")}
    return t.orders.select("o_orderkey", tp.render("no {n} on {at:%d.%m.%Y}", value.__getitem__).alias("text"))


@query("rule_as_stored", """WITH o AS (SELECT o_orderkey AS k, (o_custkey % 30) / 2.0 AS d0, (o_orderkey % 50) / 2.0 AS d1 FROM orders)
SELECT k AS i, CASE WHEN k % 2 = 0 OR abs(d0 - d1) * 5 / 7 < 0.004 THEN 'equal' ELSE 'write:b.samples' END AS profile, CASE WHEN k % 3 = 0 THEN 'write:b.tanks' ELSE 'equal' END AS tanks, CASE WHEN k % 2 = 0 OR abs(d0 - d1) * 5 / 7 < 0.004 THEN '0,5,10' ELSE '0,7,10' END AS times, 'S' AS tank FROM o""")
def as_stored(t):
    """The receiver has no names of tanks and keeps profiles each 5 seconds: every second one is what it would keep, the others keep the depth of the start too long."""
    k, d0, d1 = C("o_orderkey"), C("o_custkey") % 30 / 2, C("o_orderkey") % 50 / 2
    point = lambda at, d: F.struct(F.lit(at).cast("long").alias("t"), d.cast("double").alias("depth"), F.lit(None).cast("double").alias("temp"))
    gas = lambda end, name: F.array(F.struct(F.lit(32.0).alias("oxygen"), F.lit(0.0).alias("helium"), F.lit(200.0).alias("start"), end.cast("double").alias("end"), F.lit(12.0).alias("volume"), F.lit(name).cast("string").alias("name")))
    five = F.when(k % 2 == 0, F.round(d0 + (d1 - d0) * 5 / 7, 2)).otherwise(d0)
    rows = t.orders.select(
        k.alias("i"),
        F.struct(F.array(point(0, d0), point(7, d1), point(10, F.lit(3.0))).alias("samples"), gas(F.lit(60), "S").alias("tanks")).alias("a"),
        F.struct(F.array(point(0, d0), point(5, five), point(10, F.lit(3.0))).alias("samples"), gas(F.when(k % 3 == 0, 70).otherwise(60), None).alias("tanks")).alias("b"),
    )
    fields = {f.key: f for s in ("a", "b") for f in (rl.Field(f"{s}.samples", "samples"), rl.Field(f"{s}.tanks", "tanks"))}
    wins = {"b": "source_wins"}
    board = [rl.Rule("profile", ("a.samples",), "b.samples", policies=wins), rl.Rule("tanks", ("a.tanks",), "b.tanks", policies=wins)]
    out = rl.apply(rows, rl.select(board, "b"), fields, {"b": rl.unnamed_on_grid()})
    what = lambda n: C("outcomes")[n]["outcome"]
    times = F.array_join(F.transform("b.samples", lambda x: x["t"].cast("string")), ",")
    name = F.coalesce(C("b.tanks")[0]["name"], C("a.tanks")[0]["name"])
    return out.select("i", what(0).alias("profile"), what(1).alias("tanks"), times.alias("times"), name.alias("tank"))


@query("rule_cross_links", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 > 0 AS a_own, o_custkey % 4 > 0 AS b_own, o_orderkey % 3 = 0 AS a_other, o_custkey % 2 = 0 AS b_other FROM orders)
SELECT k AS i, CASE WHEN a_other THEN 'old' WHEN a_own AND b_own THEN 'B' || k END AS a_has, CASE WHEN b_other THEN 'old' WHEN a_own AND b_own THEN 'A' || k END AS b_has,
concat_ws(',', CASE WHEN a_own AND b_own AND NOT a_other THEN 'a:linked' END, CASE WHEN a_own AND b_own AND NOT b_other THEN 'b:write:b.external_ids' END) AS outcomes FROM o""")
def cross_links(t):
    """Side b keeps foreign ids, side a doesn't; some sides know the other already, some have no id of their own."""
    k, c = C("o_orderkey"), C("o_custkey")
    known = lambda own, has, other, knows: F.struct(ids(**{own: F.when(has, F.concat(F.lit(own.upper()), k.cast("string"))), other: F.when(knows, F.lit("old"))}).alias("external_ids"))
    rows = t.orders.select(k.alias("i"), known("a", k % 5 > 0, "b", k % 3 == 0).alias("a"), known("b", c % 4 > 0, "a", c % 2 == 0).alias("b"))
    out = rl.linked(rows, "a", "b", stores=("b",))
    told = F.array_join(F.transform("outcomes", lambda o: F.concat(o["receiver"], F.lit(":"), o["outcome"])), ",")
    return out.select("i", F.try_element_at("a.external_ids", F.lit("b")).alias("a_has"), F.try_element_at("b.external_ids", F.lit("a")).alias("b_has"), told.alias("outcomes"))


@query("rule_prepared_upload", """SELECT o_orderkey AS i, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderkey || ': ' || o_orderpriority END AS title,
CASE o_custkey % 3 WHEN 0 THEN 'mine' WHEN 1 THEN 'Reef' END AS words, CASE WHEN o_custkey % 3 < 2 THEN 'Bay ' || o_custkey END AS notes, o_orderkey::DOUBLE AS number FROM orders""")
def prepared_upload(t):
    """A title is composed, a number goes over, and a text of the origin is split into two fields, one of which has a value at times; a third of the texts can't be split."""
    k, c = C("o_orderkey"), C("o_custkey")
    rows = t.orders.select(
        k.alias("i"),
        F.struct(F.when(k % 4 == 0, "").otherwise(C("o_orderpriority")).alias("notes"), F.when(c % 3 < 2, F.concat(F.lit("Reef (Bay "), c.cast("string"), F.lit(")"))).otherwise("Reef").alias("site"), F.lit(None).cast("string").alias("place"), F.array(F.lit("x")).alias("tags"), k.cast("double").alias("number")).alias("a"),
        F.struct(F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("title"), F.when(c % 3 == 0, "mine").alias("words"), F.lit(None).cast("double").alias("number")).alias("b"),
    )
    board = [rl.Rule("site", ("b.words", "b.notes"), "a.site", "{words} ({notes})", reverse="auto"), rl.Rule("title", ("a.number", "a.notes"), "b.title", "{number:d}: {notes}", separator=": "), rl.Rule("number", ("a.number",), "b.number", policies={"b": "manual"})]
    out = rl.prepared(rows, rl.select(board, "b"), FIELDS, "a")
    return out.select("i", "b.title", "b.words", "b.notes", "b.number")


SYNC = ", ".join([SIDES, EDGES, GREEDY, _rest(3, "pairs"), SHIFTS.replace("FROM a JOIN b", "FROM a3 JOIN b3").replace("abs(d) > 900 ", "abs(d) > 21600 "), *[_round(n) for n in range(6)], "paired AS (SELECT i, j FROM pairs " + " ".join(f"UNION ALL SELECT i, j FROM w{n}" for n in range(6)) + ")"])


@query("sync_actions", f"""WITH RECURSIVE {SYNC} SELECT 'updated_on_b' AS action, j AS id, NULL::VARCHAR AS reason FROM paired JOIN events x ON x.event_id = i JOIN events y ON y.event_id = j WHERE x.props <> y.props
UNION ALL SELECT 'uploaded_to_b', i, NULL FROM a WHERE i NOT IN (SELECT i FROM paired) UNION ALL SELECT 'deleted_on_b', j, NULL FROM b WHERE j NOT IN (SELECT j FROM paired)""")
def sync_actions(t):
    a, b = side(t, "click", "i", blocks=ACCOUNT), side(t, "view", "j", blocks=ACCOUNT)
    record = lambda kind, n, s: t.events.where(C("event_type") == kind).select(C("event_id").alias(n), F.struct(C("props").alias("notes"), C("value").alias("number")).alias(s))
    board = [rl.Rule("notes", ("a.notes",), "b.notes", policies={"b": "source_wins"})]
    run = sync.plan(a, b, record("click", "i", "a"), record("view", "j", "b"), board, FIELDS, sync.Receiver("b", deletes=True), "a", 21600.0, blocks=("account",), mirror=True)
    return run.actions.select("action", "id", "reason")


@query("rule_field_edits", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, o_orderkey % 9 AS r FROM orders),
p AS (SELECT *, concat_ws('; ', CASE WHEN r = 1 THEN 'max_depth: set by the profile' END, CASE WHEN r = 2 THEN 'number: not a number: x' || c END, CASE WHEN r = 2 AND c % 2 = 0 THEN 'lat: above 90' END, CASE WHEN r = 3 THEN 'gf_low: above gf_high' END,
 CASE WHEN r = 4 AND c % 3 = 0 THEN 'time: use HH:MM or HH:MM:SS, not 25:00' END, CASE WHEN r = 5 AND c % 4 = 0 THEN 'tank: O2 and He add up to more than 100 %' END) AS w FROM o)
SELECT k, w AS problems, CAST(CASE WHEN r = 6 THEN NULL WHEN r = 0 THEN c ELSE k END AS INTEGER) AS number, CASE WHEN r = 0 THEN 'Reef ' || c WHEN r = 6 THEN NULL ELSE 'old' END AS location,
CASE WHEN r = 4 AND c % 3 > 0 THEN strftime(d, '%Y-%m-%d') || ' 09:30:00' ELSE strftime(d, '%Y-%m-%d') || ' 00:00:00' END AS local,
CASE WHEN r = 4 AND c % 3 > 0 THEN strftime(CAST(d AS TIMESTAMP) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE - INTERVAL 210 MINUTE * (CASE c % 3 WHEN 1 THEN -1 ELSE 1 END), '%Y-%m-%d %H:%M:%S') ELSE strftime(CAST(d AS TIMESTAMP) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS utc,
CASE WHEN r = 5 AND c % 4 > 0 THEN 18.0 ELSE 32.0 END AS oxygen, CASE WHEN r = 5 AND c % 4 > 0 THEN 'S' || c ELSE 'S' END AS tank, CASE WHEN r = 7 THEN 'kilogram' END AS weight_unit FROM p""")
def field_edits(t):
    """Every ninth order asks for another kind of edit, some of which can't be taken."""
    k, c, r = C("o_orderkey"), C("o_custkey"), C("o_orderkey") % 9
    values = {"local": C("o_orderdate").cast("timestamp_ntz"), "utc": C("o_orderdate").cast("timestamp_ntz") - F.expr("interval 2 hours"), "zone": F.lit("UTC+02:00"), "number": k, "location": F.lit("old"), "max_depth": F.lit(12.0), "gf_high": F.lit(70), "tanks": F.array(tank(F.lit(32.0), None, F.lit(200.0), name=F.lit("S"))), "samples": F.array(sample(F.lit(0), F.lit(1.0)))}
    say = lambda **asks: F.create_map(*[x for n, v in asks.items() for x in (F.lit(n), v)])
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    asked = (
        F.when(r == 0, say(number=c.cast("string"), location=text("  Reef ", c)))
        .when(r == 1, say(max_depth=F.lit("3"), number=F.lit("1")))
        .when(r == 2, say(number=text("x", c), lat=F.when(c % 2 == 0, "91").otherwise("45.5")))
        .when(r == 3, say(gf_low=F.lit("80")))
        .when(r == 4, say(time=F.when(c % 3 == 0, "25:00").otherwise("9:30"), utc_offset=F.when(c % 3 == 1, "-03:30").otherwise("UTC+3:30")))
        .when(r == 6, say(number=F.lit(" "), location=F.lit("")))
        .when(r == 7, say(weight=F.lit("6.5")))
    )
    table = F.when(r == 5, F.array(say(oxygen=F.lit("18"), helium=F.when(c % 4 == 0, "90").otherwise("45"), name=text("S", c))))
    rows = record(t.orders, values, "o_orderkey", "o_custkey").withColumn("asked", asked).withColumn("gases", table)
    out = edits.edited(rows, tanks="gases")
    at = lambda n: F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n)
    return out.select(k.alias("k"), F.array_join("problems", "; ").alias("problems"), "number", "location", at("local"), at("utc"), C("tanks")[0]["oxygen"].alias("oxygen"), C("tanks")[0]["name"].alias("tank"), "weight_unit")
