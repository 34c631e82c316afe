"""Reconciliation rules: checked, selected for a receiver, and folded over matched pairs.

A pair is a row with two structs, one per side, named after the services. Rules run in board order and see what earlier
ones wrote, so each becomes one step over the structs. Outcomes are collected in an array column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.compare import empty, keep_names, on_even_grid, same
from tallyweave.functions.text import short_id, strip
from tallyweave.plans import templates as tp

POLICIES = ("source_wins", "prefer_source", "prefer_non_empty", "manual", "target_wins")
#: Types that only travel one way and take no template.
STRUCTURAL = ("tanks", "samples")


@dataclass(frozen=True)
class Field:
    """A field that a service has: ``service.name``, its type, and what can be done with it."""

    key: str
    kind: str = "text"
    writable: bool = True
    max_length: int | None = None

    @property
    def service(self) -> str:
        return self.key.split(".", 1)[0]

    @property
    def name(self) -> str:
        return self.key.split(".", 1)[1]


@dataclass(frozen=True)
class Rule:
    """``source`` fields fill ``target``; ``policies`` says for each receiving service how it takes part."""

    id: str
    source: tuple[str, ...]
    target: str
    template: str | None = None
    reverse: str | None = None
    take: str | None = None
    separator: str = ", "
    policies: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Active:
    """A rule as it applies to one receiver."""

    rule: Rule
    receiver: str
    policy: str
    split: bool = False


def problems(rules: list[Rule], catalogue: dict[str, Field]) -> list[tuple[str, str]]:
    """(rule, what is wrong) for all rules, loops included."""
    out = []
    for r in rules:
        known = [k for k in (*r.source, r.target) if k not in catalogue]
        out += [(r.id, f"unknown field {k}") for k in known]
        out += [(r.id, f"unknown policy {p}") for p in r.policies.values() if p not in POLICIES]
        if known:
            continue
        target, sources = catalogue[r.target], [catalogue[s] for s in r.source]
        if not target.writable:
            out.append((r.id, f"{r.target} can't be written"))
        if r.template:
            try:
                names = tp.fields(r.template)
                out += [(r.id, f"unknown field {{{k}}} in the template") for k in names if _resolve(k, r, catalogue) is None]
                if r.reverse:
                    re.compile(_reverse(r))
            except (tp.TemplateError, re.error) as e:
                out.append((r.id, str(e)))
            if target.kind in STRUCTURAL or any(s.kind in STRUCTURAL for s in sources):
                out.append((r.id, "tanks and samples take no template"))
        elif len(sources) != 1:
            out.append((r.id, "several sources need a template"))
        elif sources[0].kind != target.kind and {sources[0].kind, target.kind} != {"list", "text"}:
            out.append((r.id, f"a {sources[0].kind} doesn't fit a {target.kind}"))
        if r.take:
            try:
                re.compile(r.take)
            except re.error as e:
                out.append((r.id, f"bad pattern: {e}"))
    return out + [(r, "writes a field that it is filled from, through other rules") for r in loops(rules)]


def loops(rules: list[Rule]) -> list[str]:
    """Ids of rules that compose a field which other rules feed back into one they are filled from. For boards as tables see :func:`tallyweave.plans.boards.loops`."""
    after: dict[str, set[tuple[str, str]]] = {}
    for r in rules:
        for s in r.source:
            after.setdefault(s, set()).add((r.target, r.id))
        if r.reverse:
            for s in r.source:
                after.setdefault(r.target, set()).add((s, r.id))

    def feeds_back(r: Rule) -> bool:
        seen, todo = {r.target}, [r.target]
        while todo:
            new = {n for n, by in after.get(todo.pop(), ()) if by != r.id} - seen
            if new & set(r.source):
                return True
            seen |= new
            todo += new
        return False

    return [r.id for r in rules if len(r.source) > 1 and feeds_back(r)]


def select(rules: list[Rule], receiver: str, mirror: bool = False, tanks: bool = True, catalogue: dict[str, Field] | None = None) -> list[Active]:
    """Rules that a receiver takes part in: first those that write it, then splits of texts composed from its fields.

    A split without a policy of its own has that of the rule for the service it writes. A mirror takes all as they
    come. Without ``tanks`` rules with a field of that type are left out, known by ``catalogue``, or by name without one.
    """
    gas = lambda k: catalogue[k].kind == "tanks" if catalogue and k in catalogue else k.endswith(".tanks")
    out = []
    for r in rules:
        service = r.target.split(".", 1)[0]
        own = service == receiver
        split = not own and bool(r.reverse) and all(s.split(".", 1)[0] == receiver for s in r.source)
        policy = r.policies.get(receiver) or r.policies.get(service, "prefer_non_empty")
        if policy == "target_wins" or not (own or split) or (not tanks and any(gas(k) for k in (r.target, *r.source))):
            continue
        out.append(Active(r, receiver, "source_wins" if mirror else policy, split))
    return sorted(out, key=lambda a: a.split)


def _resolve(key: str, rule: Rule, catalogue: dict[str, Field]) -> Field | None:
    if key in catalogue:
        return catalogue[key]
    return catalogue.get(f"{rule.source[0].split('.', 1)[0]}.{key}")


def _reverse(rule: Rule) -> str:
    return tp.auto_pattern(rule.template) if rule.reverse.strip().lower() == "auto" else rule.reverse


def convert(c: Column, from_kind: str, to_kind: str, separator: str) -> Column:
    """List to text and back; other types as they are."""
    if from_kind == "list" and to_kind == "text":
        return F.array_join(F.filter(c, lambda x: x != ""), separator)
    if from_kind == "text" and to_kind == "list":
        token = re.escape(separator.strip() or separator)
        return F.filter(F.transform(F.split(c, token), strip), lambda x: x != "")
    return c


def takes(policy: str, sender_empty: Column, receiver_empty: Column) -> Column:
    """Whether the receiver takes a sender's value that differs from its own."""
    if policy == "source_wins":
        return F.lit(True)
    if policy == "prefer_source":
        return ~sender_empty
    return receiver_empty & ~sender_empty


#: What a service would keep of a value of a type, and read back.
Stored = Callable[[str, Column], Column]


def _reader(rule: Rule, catalogue: dict[str, Field]) -> Callable[[str], tuple[Column, str]]:
    return lambda key: (F.col(f"`{(f := _resolve(key, rule, catalogue)).service}`.`{f.name}`"), f.kind)


def step(pairs: DataFrame, active: Active, catalogue: dict[str, Field], keep: str = "outcomes", stored: Stored | None = None) -> DataFrame:
    """Apply one rule to every pair. A sender's value is compared as the receiver would have ``stored`` it, so what that can't hold is no difference; what is written is the whole value."""
    rule = active.rule
    value = _reader(rule, catalogue)
    target = catalogue[rule.target]
    unmatched = F.lit(False)
    if active.split:
        sender, sender_kind = value(rule.target)
        receiver_kind = "text"
        receiver = tp.render(rule.template, value, rule.separator)
        incoming = sender
    elif rule.template:
        sender, sender_kind = tp.render(rule.template, value, rule.separator, target.max_length), "text"
        receiver, receiver_kind = value(rule.target)
        incoming = convert(sender, "text", receiver_kind, rule.separator)
    else:
        sender, sender_kind = value(rule.source[0])
        receiver, receiver_kind = value(rule.target)
        if rule.take:
            picked = tp.part(sender, rule.take)
            unmatched = ~empty(sender_kind, sender) & picked.isNull()
            sender = F.when(empty(sender_kind, sender), sender).otherwise(picked)
        incoming = convert(sender, sender_kind, receiver_kind, rule.separator)
    equal = same(receiver_kind, stored(receiver_kind, incoming) if stored else incoming, receiver)
    no_sender, no_receiver = empty(sender_kind, sender), empty(receiver_kind, receiver)
    take = takes(active.policy, no_sender, no_receiver)
    clash = ~no_sender & ~no_receiver if active.policy == "manual" else F.lit(False)
    pieces = tp.split(sender, _reverse(rule)) if active.split else {}
    unread = F.greatest(*[p.isNull() for p in pieces.values()], F.lit(False)) if pieces else F.lit(False)
    written = [_resolve(n, rule, catalogue).key for n in pieces] if active.split else [rule.target]
    outcome = F.when(unmatched, "take_unmatched").when(equal, "equal").when(~take & clash, "conflict").when(~take, "kept").when(unread, "reverse_unparsed").otherwise("write:" + ",".join(written))
    text = lambda c, kind: F.to_json(F.struct(c.alias("v"))) if kind not in ("text", "number") else c.cast("string")
    entry = F.struct(F.lit(rule.id).alias("rule"), F.lit(active.receiver).alias("receiver"), outcome.alias("outcome"), text(sender, sender_kind).alias("sent"), text(receiver, receiver_kind).alias("had"))
    out = pairs.withColumn("_entry", entry).withColumn("_write", F.startswith("_entry.outcome", F.lit("write:")))
    if active.split:
        side = F.col(active.receiver)
        for n, p in pieces.items():
            f = _resolve(n, rule, catalogue)
            side = side.withField(f.name, F.when(F.col("_write"), p).otherwise(F.col(f"`{f.service}`.`{f.name}`")))
    else:
        new = keep_names(incoming, receiver) if receiver_kind == "tanks" else incoming
        side = F.col(active.receiver).withField(target.name, F.when(F.col("_write"), new).otherwise(receiver))
    return out.withColumn("_side", side).withColumn(active.receiver, F.col("_side")).withColumn(keep, F.concat(keep, F.array("_entry"))).drop("_entry", "_write", "_side")


OUTCOMES = "array<struct<rule:string,receiver:string,outcome:string,sent:string,had:string>>"


def apply(pairs: DataFrame, actives: list[Active], catalogue: dict[str, Field], stored: dict[str, Stored] | None = None) -> DataFrame:
    """Fold rules over pairs. Adds ``outcomes`` (to those that are there); the sides' structs hold what they would be afterwards.

    ``stored`` says for a service what it would keep of a value, see :func:`step`.
    """
    out = pairs if "outcomes" in pairs.columns else pairs.withColumn("outcomes", F.array().cast(OUTCOMES))
    for a in actives:
        out = step(out, a, catalogue, stored=(stored or {}).get(a.receiver))
    return out


def unnamed_on_grid(every: int = 5, decimals: tuple[int, int] = (2, 1)) -> Stored:
    """What a log keeps that has no names of tanks, and profiles on a grid of ``every`` seconds only. A profile with fewer than two times is kept as none; empty lists and nulls stay."""

    def stored(kind: str, c: Column) -> Column:
        if kind == "tanks":
            return F.transform(c, lambda t: t.withField("name", F.lit(None).cast("string")))
        if kind == "samples":
            return F.when(F.size(c) > 0, on_even_grid(c, every, decimals)).otherwise(c)
        return c

    return stored


def linked(pairs: DataFrame, a: str, b: str, stores: tuple[str, ...] = (), ids: str = "external_ids") -> DataFrame:
    """Pairs whose sides know each other's id: ``ids``, a map by service in either struct, gets the other service's where it has none under that name.

    A side that has no id of its own doesn't take one, and an unknown or blank id is no id. ``outcomes`` tells of each
    side that learned an id: a write for a service that ``stores`` them, else ``linked``, which only a table of links keeps.
    """
    out = pairs if "outcomes" in pairs.columns else pairs.withColumn("outcomes", F.array().cast(OUTCOMES))
    own = {s: F.nullif(F.trim(F.try_element_at(F.col(f"`{s}`.`{ids}`"), F.lit(s))), F.lit("")) for s in (a, b)}
    news, sides = [], {}
    for side, other in ((a, b), (b, a)):
        known = F.coalesce(F.col(f"`{side}`.`{ids}`"), F.create_map().cast("map<string,string>"))
        learns = own[side].isNotNull() & own[other].isNotNull() & ~F.map_contains_key(known, F.lit(other))
        sides[side] = F.col(f"`{side}`").withField(ids, F.when(learns, F.map_concat(known, F.create_map(F.lit(other), own[other]))).otherwise(known))
        entry = F.struct(F.lit("ids").alias("rule"), F.lit(side).alias("receiver"), F.lit(f"write:{side}.{ids}" if side in stores else "linked").alias("outcome"), own[other].alias("sent"), F.lit(None).cast("string").alias("had"))
        news.append(F.when(learns, entry))
    return out.withColumns({**sides, "outcomes": F.concat("outcomes", F.array_compact(F.array(*news)))})


def prepared(rows: DataFrame, actives: list[Active], catalogue: dict[str, Field], origin: str) -> DataFrame:
    """Records that are new to a receiver, made ready for it: ``rows`` has the struct of ``origin``, and the receiver's as far as it is known.

    Rules that are filled from the origin alone write their value, whatever was there; ``take`` isn't used on new
    records, the whole value goes. A split of a composed text fills its fields, but one that has a value keeps it
    unless the policy is ``source_wins`` or ``prefer_source``. A text that is empty or can't be split leaves them all.
    """
    out = rows
    for active in actives:
        rule, value = active.rule, _reader(active.rule, catalogue)
        side = F.col(active.receiver)
        if active.split:
            text, kind = value(rule.target)
            for n, p in tp.split(text, _reverse(rule)).items():
                f = _resolve(n, rule, catalogue)
                had = F.col(f"`{f.service}`.`{f.name}`")
                free = F.lit(True) if active.policy in ("source_wins", "prefer_source") else empty(f.kind, had)
                side = side.withField(f.name, F.when(free & ~empty(kind, text) & p.isNotNull(), p).otherwise(had))
        elif all(k.split(".", 1)[0] == origin for k in rule.source):
            target = catalogue[rule.target]
            if rule.template:
                new = convert(tp.render(rule.template, value, rule.separator, target.max_length), "text", target.kind, rule.separator)
            else:
                sent, kind = value(rule.source[0])
                new = convert(sent, kind, target.kind, rule.separator)
            side = side.withField(target.name, new)
        out = out.withColumn("_side", side).withColumn(active.receiver, F.col("_side")).drop("_side")
    return out


def conflicts(applied: DataFrame, link: str, source_id: Column, target_id: Column) -> DataFrame:
    """One row for each conflict, with an id that stays the same from run to run."""
    rows = applied.select(source_id.cast("string").alias("source_id"), target_id.cast("string").alias("target_id"), F.explode("outcomes").alias("o")).where("o.outcome = 'conflict'")
    return rows.select(short_id(F.lit(link), F.col("o.rule"), F.col("source_id"), F.col("target_id")).alias("id"), "source_id", "target_id", F.col("o.rule").alias("rule"), F.col("o.sent").alias("sent"), F.col("o.had").alias("had"))


#: What tells conflicts apart. The id alone has 40 bits, so among millions a few conflicts share one.
CONFLICT = ["id", "rule", "source_id", "target_id"]


def resolve(conflict_rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """What each decision (CONFLICT and ``side``) writes: the value sent, or the one that was there. A decision is for its own conflict, not for another that happens to have the same id."""
    return conflict_rows.join(decisions.select(*CONFLICT, "side"), CONFLICT).select(*CONFLICT, "side", F.when(F.col("side") == "source", F.col("sent")).otherwise(F.col("had")).alias("value"))
