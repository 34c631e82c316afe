"""Boards of links between two services' fields, as tables: compiled to what each service takes, turned back, and checked for loops.

A link (``board, pos, id, source, target, direction, conflict, template, reverse, separator, take, match_order``) joins the
fields ``source`` (an array, of several with a template) with ``target``; ``direction`` is to_target, to_source,
bidirectional or off. A rule (``board, receiver, pos, id, source, target, conflict, template, reverse, reverse_conflict,
separator, take``) says what a service takes for one of its fields. Ids are unique in a board's links, and in the
rules of a board and receiver. Everything is keyed by board and id or field, so one board can hold most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import written

C = F.col
LINKS = ("board", "pos", "id", "source", "target", "direction", "conflict", "template", "reverse", "separator", "take", "match_order")
RULES = ("board", "receiver", "pos", "id", "source", "target", "conflict", "template", "reverse", "reverse_conflict", "separator", "take")


def service(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def _no(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def rules(links: DataFrame) -> DataFrame:
    """What each service takes by its links.

    The target takes what links send its way, and a mark that nothing may overwrite it (off and target_wins). The
    source takes plain links that go its way; a composed text goes back by its rule's ``reverse`` instead. Who loses
    under target_wins takes the other's value whatever it is. A pattern that no direction uses is dropped.
    """
    d, policy = C("direction"), C("conflict")
    loser = F.when(policy == "target_wins", "source_wins").otherwise(policy)
    composed = C("template").isNotNull()
    both, back, marks = d == "bidirectional", d == "to_source", (d == "off") & (policy == "target_wins")
    own = lambda receiver: F.when(F.endswith("id", F.concat(F.lit("@"), receiver)), F.left("id", F.length("id") - F.length(receiver) - 1)).otherwise(C("id"))

    def rule(receiver: Column, source: Column, target: Column, conflict: Column, *rest: Column) -> Column:
        values = (receiver, C("pos"), own(receiver), source, target, conflict, *rest)
        return F.struct(*[v.alias(n) for n, v in zip(RULES[1:], values, strict=True)])

    splits = composed & (both | back)
    to_target = rule(
        service(C("target")), C("source"), C("target"),
        F.when(marks | back, "target_wins").when(both, policy).otherwise(loser),
        C("template"), F.when(splits, C("reverse")),
        F.when(composed & back, policy).when(composed & both & (policy == "target_wins"), "source_wins"),
        C("separator"), F.when(~composed, C("take")),
    )
    first = F.get("source", 0)
    to_source = rule(service(first), F.array("target"), first, loser, _no(), _no(), _no(), C("separator"), _no())
    takes = F.array_compact(F.array(F.when(marks | both | (d == "to_target") | (composed & back), to_target), F.when(~composed & (both | back), to_source)))
    return links.select("board", F.explode(takes).alias("r")).select("board", "r.*")


def match_keys(links: DataFrame, source: str) -> DataFrame:
    """(board, ord, a, b): the fields that find partners, in order of ``ord``; ``a`` is the side of the service ``source``."""
    first = F.get("source", 0)
    straight = (service(first) == source) | (service(C("target")) != source)
    return links.where("match_order is not null").select("board", C("match_order").alias("ord"), F.when(straight, first).otherwise(C("target")).alias("a"), F.when(straight, C("target")).otherwise(first).alias("b"))


def _fields(a: Column, b: Column) -> Column:
    return F.array_sort(F.array(a, b))


def links(rules_: DataFrame, keys: DataFrame, source: str, target: str) -> DataFrame:
    """The links that :func:`rules` and :func:`match_keys` make of them again.

    Two plain rules of one id that mirror each other are one link both ways, if their policies and separators agree or
    one never takes what the other always does. Two sides that are both never overwritten stay two marks, as no link
    says that. A second link of an id carries its receiver in it. A key without a link, and a later key of the same
    fields, becomes a link that is off. ``place`` is the order in a board. Not to be said by a link, and lost: a split's
    policy beside another of its composed text (unless that is target_wins).
    """
    rank = F.when(C("receiver") == target, 0).when(C("receiver") == source, 1).otherwise(2)
    mirrors = C("template").isNull() & (F.size("source") == 1) & C("take").isNull()
    at = rules_.withColumn("_at", F.struct(rank.alias("rank"), C("pos"))).withColumn("_fields", F.when(mirrors, _fields(F.get("source", 0), C("target"))))
    # a rule that can't be mirrored stands alone
    pair = Window.partitionBy("board", "id", F.coalesce(F.array_join("_fields", "\n"), F.concat(F.lit("\n"), C("receiver"))))
    wins, never = C("conflict") == "source_wins", C("conflict") == "target_wins"
    seen = at.withColumns({
        "_n": F.count("*").over(pair), "_sides": F.size(F.collect_set("target").over(pair)), "_policies": F.array_sort(F.collect_set("conflict").over(pair)), "_separators": F.size(F.collect_set("separator").over(pair)), "_first": F.min("_at").over(pair),
    })
    owned = F.array_join("_policies", " ") == "source_wins target_wins"
    agree = (F.size("_policies") == 1) & ~never
    merged = C("_fields").isNotNull() & (C("_n") == 2) & (C("_sides") == 2) & (C("_separators") <= 1) & (agree | owned)
    keep = seen.withColumn("_merged", merged).where(~C("_merged") | F.when(owned, ~wins).otherwise(C("_at") == C("_first")))
    splits = C("template").isNotNull() & C("reverse").isNotNull()
    direction = F.when(C("_merged"), "bidirectional").when(splits & never, "to_source").when(splits, "bidirectional").when(never, "off").otherwise("to_target")
    conflict = F.when(~C("_merged") & splits & never, F.coalesce("reverse_conflict", F.lit("source_wins"))).otherwise(C("conflict"))
    place = F.when(C("_merged"), C("_first")).otherwise(C("_at"))
    turn = F.row_number().over(Window.partitionBy("board", "id").orderBy("_place", "receiver"))
    out = keep.withColumn("_place", place).withColumn("_turn", turn)
    name = F.when(C("_turn") > 1, F.concat("id", F.lit("@"), "receiver")).otherwise(C("id"))
    out = out.select("board", C("_place"), name.alias("id"), "source", "target", direction.alias("direction"), conflict.alias("conflict"), "template", "reverse", "separator", "take")
    # keys go to the first plain link of their fields
    plain = C("template").isNull()
    by = Window.partitionBy("board", "_pair").orderBy("_place", "id")
    out = out.withColumn("_pair", F.when(plain, F.array_join(_fields(F.get("source", 0), C("target")), "\n")))
    out = out.withColumn("_first", plain & (F.row_number().over(by) == 1))
    asked = keys.select("board", "ord", "a", "b", F.array_join(_fields(C("a"), C("b")), "\n").alias("_pair"))
    earliest = asked.groupBy("board", "_pair").agg(F.min("ord").alias("match_order")).withColumn("_first", F.lit(True))
    out = out.join(earliest, ["board", "_pair", "_first"], "left")
    lone = asked.join(out.where("match_order is not null").select("board", "_pair", C("match_order").alias("ord")), ["board", "_pair", "ord"], "left_anti")
    base = F.substring_index("a", ".", -1)
    used = out.select("board", C("id").alias("_base"), F.lit(1).alias("_used"))
    n = F.row_number().over(Window.partitionBy("board", "_base").orderBy("ord")) + F.coalesce("_used", F.lit(0))
    lone = lone.withColumn("_base", base).join(used, ["board", "_base"], "left").withColumn("_k", n)
    off = {"direction": F.lit("off"), "conflict": F.lit("source_wins"), "separator": F.lit(", ")}
    tail = lone.select(
        "board", F.struct(F.lit(3).alias("rank"), C("ord").cast("int").alias("pos")).alias("_place"), F.when(C("_k") > 1, F.concat("_base", F.lit("_"), C("_k").cast("string"))).otherwise(C("_base")).alias("id"), F.array("a").alias("source"), C("b").alias("target"),
        *[off.get(c, _no()).alias(c) for c in ("direction", "conflict", "template", "reverse", "separator", "take")], C("ord").alias("match_order"),
    )
    names = [c for c in LINKS if c != "pos"]
    place = lambda df: df.select(F.struct(C("_place.rank").cast("int").alias("rank"), C("_place.pos").cast("int").alias("pos")).alias("place"), *[C(c).cast("int") if c == "match_order" else C(c) for c in names])
    return place(out).unionByName(place(tail))


def loops(links_: DataFrame) -> DataFrame:
    """(board, id, via): each composed link whose target feeds back, through other links, into one of its own fields; ``via`` is the least id of the links that do.

    Reached fields are followed link by link; each round looks only at what the last one found, and the rounds end when it
    found nothing new, at the longest path's length at most. Links that are off carry nothing.
    """
    on = links_.where("direction <> 'off'")
    forth = on.where("direction <> 'to_source'").select("board", C("id").alias("link"), F.explode("source").alias("node"), C("target").alias("next"))
    back = on.where("direction <> 'to_target'").select("board", C("id").alias("link"), C("target").alias("node"), F.get("source", 0).alias("next"))
    edges = written(forth.unionByName(back).distinct(), "edges")
    composed = on.where(F.size("source") > 1)
    # only what can be reached from composed targets is ever looked at
    new = written(composed.select("board", "id", C("target").alias("node")).distinct(), "reached")
    reached = new
    while not new.isEmpty():
        step = new.join(edges, ["board", "node"]).where("link <> id").select("board", "id", C("next").alias("node")).distinct()
        new = written(step.join(reached, ["board", "id", "node"], "left_anti"), "reached")
        reached = reached.unionByName(new)
    into = composed.select("board", "id", F.explode("source").alias("next")).distinct()
    hits = reached.join(edges, ["board", "node"]).where("link <> id").join(into, ["board", "id", "next"], "left_semi")
    return hits.groupBy("board", "id").agg(F.min("link").alias("via"))
