"""A whole reconciliation run as one plan that ends in tables: matched, only on one side, actions, conflicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import linkage as lk
from tallyweave.plans import rules as rl


@dataclass(frozen=True)
class Receiver:
    """What a service lets be done to it."""

    name: str
    adds: bool = True
    updates: bool = True
    deletes: bool = False


@dataclass(frozen=True)
class Run:
    """The tables that a run ends in; nothing is written to a service. Matching runs at once and keeps its pairs in the shared folder."""

    pairs: DataFrame
    only_source: DataFrame
    only_target: DataFrame
    actions: DataFrame
    conflicts: DataFrame


def _blank(target_records: DataFrame, source_records: DataFrame, receiver: str, origin: str) -> Column:
    """A receiver's struct for a new record: the origin's fields of the same name and type, others null."""
    have = {f.name: f.dataType for f in source_records.schema[origin].dataType.fields}
    return F.struct(*[(F.col(f"`{origin}`.`{f.name}`") if have.get(f.name) == f.dataType else F.lit(None).cast(f.dataType)).alias(f.name) for f in target_records.schema[receiver].dataType.fields])


def plan(source: DataFrame, target: DataFrame, source_records: DataFrame, target_records: DataFrame, board: list[rl.Rule], catalogue: dict[str, rl.Field], receiver: Receiver, origin: str, grace_s: float = 900.0, links: DataFrame | None = None, blocks: tuple[str, ...] = (), mirror: bool = False, keys: bool = True, tanks: bool = True, ids: str | None = None, stores: tuple[str, ...] = (), stored: dict[str, rl.Stored] | None = None) -> Run:
    """Match both sides, fold the board over the pairs and list what would be done to ``receiver``.

    ``source`` and ``target`` are sides of :func:`tallyweave.operators.linkage.dive_side`; the records have the
    ordinals ``i`` and ``j`` and one struct each, named after the service. A mirror deletes what has no partner. New
    records go as :func:`tallyweave.plans.rules.prepared` makes them. With ``ids``, the name of a map in both structs,
    matched sides learn each other's id first, and the origin gets an update too if it ``stores`` such ids; ``keys`` and
    ``tanks`` say whether keys match and rules on tanks run; ``stored`` is as in :func:`tallyweave.plans.rules.apply`.
    A board with problems is refused.
    """
    if wrong := rl.problems(board, catalogue):
        raise ValueError("; ".join(f"{rule}: {what}" for rule, what in wrong))
    pairs = lk.match(source, target, grace_s, links, keys=keys, blocks=blocks)
    only_a, only_b = lk.unpaired(source.select("i"), target.select("j"), pairs)
    both = pairs.join(source_records, "i").join(target_records, "j")
    active = rl.select(board, receiver.name, mirror, tanks, catalogue)
    applied = rl.apply(rl.linked(both, origin, receiver.name, stores, ids) if ids else both, active, catalogue, stored)
    wrote = lambda side: F.exists("outcomes", lambda o: (o["receiver"] == side) & F.startswith(o["outcome"], F.lit("write:")))
    action = lambda rows, what, id_, payload, reason: rows.select(F.lit(what).alias("action"), F.col(id_).alias("id"), payload.alias("payload"), F.lit(reason).cast("string").alias("reason"))
    name = receiver.name
    actions = action(applied.where(wrote(name)), f"{'updated' if receiver.updates else 'skipped'}_on_{name}", "j", F.to_json(name), None if receiver.updates else "no updates")
    if ids and origin in stores:
        actions = actions.unionByName(action(applied.where(wrote(origin)), f"updated_on_{origin}", "i", F.to_json(origin), None))
    new = only_a.join(source_records, "i").withColumn(name, _blank(target_records, source_records, name, origin))
    ready = rl.prepared(new, active, catalogue, origin)
    actions = actions.unionByName(action(ready, f"{'uploaded_to' if receiver.adds else 'skipped_on'}_{name}", "i", F.to_json(name), None if receiver.adds else "no new records"))
    if mirror:
        actions = actions.unionByName(action(only_b, f"{'deleted_on' if receiver.deletes else 'skipped_on'}_{name}", "j", F.lit(None).cast("string"), None if receiver.deletes else "no deletes"))
    return Run(pairs, only_a, only_b, actions, rl.conflicts(applied, f"{origin}|{name}", F.col("i"), F.col("j")))


def rehearse(pairs_with_records: DataFrame, board: list[rl.Rule], catalogue: dict[str, rl.Field], receiver: str) -> DataFrame:
    """(i, j, rule, outcome, sent, had) of every pair and rule, writing nothing."""
    applied = rl.apply(pairs_with_records, rl.select(board, receiver, catalogue=catalogue), catalogue)
    return applied.select("i", "j", F.explode("outcomes").alias("o")).select("i", "j", "o.rule", "o.outcome", "o.sent", "o.had")
