"""Boards made of orders: each customer has one, each order is a link of it."""

from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.plans import boards

C = F.col

#: The same links in both languages: an order's fields are told by its key, its line of thought by the remainder of 7.
SQL_LINKS = """o AS (SELECT o_custkey AS board, CAST(o_orderkey AS INTEGER) AS k FROM orders),
links AS (SELECT board, k, 'L' || k AS id, 'a.f' || k % 5 AS s, 'a.f' || (k % 5 + 1) % 5 AS s2, 'b.f' || k // 5 % 5 AS target, k % 7 IN (2, 5) AS composed,
 ['bidirectional', 'to_target', 'to_source', 'off'][k // 7 % 4 + 1] AS d, ['source_wins', 'manual', 'target_wins'][k // 3 % 3 + 1] AS p, CASE WHEN k % 11 = 0 THEN k END AS match_order FROM o)"""


def link_rows(t):
    k = C("o_orderkey").cast("int")
    f = lambda side, n: F.concat(F.lit(f"{side}.f"), n.cast("string"))
    pick = lambda n, *words: F.element_at(F.array(*[F.lit(w) for w in words]), n + 1)
    by = lambda n: F.expr(f"o_orderkey div {n}").cast("int")
    composed = (k % 7).isin(2, 5)
    return t.orders.select(
        C("o_custkey").alias("board"), k.alias("pos"), F.concat(F.lit("L"), k.cast("string")).alias("id"), F.when(composed, F.array(f("a", k % 5), f("a", (k % 5 + 1) % 5))).otherwise(F.array(f("a", k % 5))).alias("source"), f("b", by(5) % 5).alias("target"),
        pick(by(7) % 4, "bidirectional", "to_target", "to_source", "off").alias("direction"), pick(by(3) % 3, "source_wins", "manual", "target_wins").alias("conflict"), F.when(composed, "{x} - {y}").alias("template"), F.when(composed, "auto").alias("reverse"), F.lit(", ").alias("separator"), F.lit(None).cast("string").alias("take"),
        F.when(k % 11 == 0, k).alias("match_order"),
    )


RULE_SQL = """r AS (SELECT board, id, 'b' AS receiver, target AS field, CASE WHEN d = 'off' OR (composed AND d = 'to_source') THEN 'target_wins' WHEN d = 'bidirectional' OR p <> 'target_wins' THEN p ELSE 'source_wins' END AS policy,
 CASE WHEN composed AND d = 'to_source' THEN p WHEN composed AND d = 'bidirectional' AND p = 'target_wins' THEN 'source_wins' END AS back, composed AND d IN ('bidirectional', 'to_source') AS splits
 FROM links WHERE d IN ('bidirectional', 'to_target') OR (composed AND d = 'to_source') OR (d = 'off' AND p = 'target_wins')
UNION ALL SELECT board, id, 'a', s, CASE WHEN p = 'target_wins' THEN 'source_wins' ELSE p END, NULL, false FROM links WHERE NOT composed AND d IN ('bidirectional', 'to_source'))"""


@query("board_rules", f"WITH {SQL_LINKS}, {RULE_SQL} SELECT board, id, receiver, field, policy, back, splits FROM r")
def rules(t):
    got = boards.rules(link_rows(t))
    return got.select("board", "id", "receiver", C("target").alias("field"), C("conflict").alias("policy"), C("reverse_conflict").alias("back"), C("reverse").isNotNull().alias("splits"))


@query("board_round_trip", f"WITH {SQL_LINKS}, {RULE_SQL} SELECT board, id, receiver, field, policy, back, splits FROM r UNION ALL SELECT board, 'key ' || match_order, 'a', s, target, NULL, false FROM links WHERE match_order IS NOT NULL")
def round_trip(t):
    """Rules and keys of the links that rules and keys turn back to: the same."""
    given = link_rows(t)
    again = boards.links(boards.rules(given), boards.match_keys(given, "a"), "a", "b").withColumn("pos", C("place.pos"))
    got = boards.rules(again).select("board", "id", "receiver", C("target").alias("field"), C("conflict").alias("policy"), C("reverse_conflict").alias("back"), C("reverse").isNotNull().alias("splits"))
    keys = boards.match_keys(again, "a")
    return got.unionByName(keys.select("board", F.concat(F.lit("key "), C("ord").cast("string")).alias("id"), F.lit("a").alias("receiver"), C("a").alias("field"), C("b").alias("policy"), F.lit(None).cast("string").alias("back"), F.lit(False).alias("splits")))


@query("board_loops", f"""WITH RECURSIVE {SQL_LINKS}, e AS (SELECT board, id AS link, s AS node, target AS nxt FROM links WHERE d IN ('bidirectional', 'to_target') UNION SELECT board, id, s2, target FROM links WHERE composed AND d IN ('bidirectional', 'to_target')
UNION SELECT board, id, target, s FROM links WHERE d IN ('bidirectional', 'to_source')), c AS (SELECT * FROM links WHERE composed AND d <> 'off'),
reach AS (SELECT board, id, target AS node FROM c UNION SELECT r.board, r.id, e.nxt FROM reach r JOIN e ON e.board = r.board AND e.node = r.node AND e.link <> r.id)
SELECT r.board, r.id, min(e.link) AS via FROM reach r JOIN e ON e.board = r.board AND e.node = r.node AND e.link <> r.id JOIN c ON c.board = r.board AND c.id = r.id AND e.nxt IN (c.s, c.s2) GROUP BY 1, 2""")
def loops(t):
    return boards.loops(link_rows(t))
