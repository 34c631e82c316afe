"""JSON paths such as ``$.a.b[*].c`` over variant columns, and mappings of fields that are given as such paths."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.text import location_with_site
from tallyweave.schema import tank


def steps(path: str) -> list[tuple[str, bool]]:
    """(key, whether all items of a list are meant) of each step of a path."""
    if not path.startswith("$."):
        raise ValueError(f"a path starts with $. : {path}")
    return [(p.removesuffix("[*]"), p.endswith("[*]")) for p in path[2:].split(".")]


def _get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, "$['" + key.replace("'", "\\'") + "']", kind)


def found(v: Column, path: str) -> Column:
    """All that a path finds in a variant, as an array of variants in order; lists on the way are looked through item by item."""
    out = F.array(v)
    for key, every in steps(path):
        items = F.flatten(F.transform(out, lambda x: F.coalesce(_items(x), F.array(x))))
        hits = F.filter(F.transform(items, lambda x: _get(x, key)), lambda x: x.isNotNull())
        out = F.flatten(F.transform(hits, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>")))) if every else hits
    return out


def first(v: Column, path: str, kind: str = "string") -> Column:
    """The first hit as ``kind``; null without one, or if it is no such value. JSON null counts as missing."""
    plain = all(not every for _, every in steps(path))
    hit = F.try_variant_get(v, "$" + "".join(f"['{k}']" for k, _ in steps(path)), kind) if plain else None
    one = F.try_variant_get(F.try_element_at(found(v, path), F.lit(1)), "$", kind)
    return one if hit is None else F.coalesce(hit, one)


def every(v: Column, path: str, kind: str = "string") -> Column:
    """All hits as an array of ``kind``, null where an item is JSON null or no such value; null without any hit."""
    hits = F.transform(found(v, path), lambda x: F.try_variant_get(x, "$", kind))
    return bound(hits, lambda h: F.when(F.size(h) > 0, h))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def put(v: Column, path: str, value: Column) -> Column:
    """``v``, a variant, with ``value`` (a variant, or what can be cast to one) at a path; all that is not on the path stays.

    Objects on the way are made where there is none, or something else. ``$.a[*]`` makes a list, of one item if the
    value is none. ``$.a[*].b`` goes on within a list's items: the value is a list then, whose items go to those at the
    same place; items that the list lacks are made, and those beyond the value stay. A null value is JSON null.
    """
    return bound(v, lambda x: _put(x, steps(path), value.cast("variant")))


def _put(v: Column, parts: list[tuple[str, bool]], value: Column) -> Column:
    (key, every_), rest = parts[0], parts[1:]
    kind = "map<string,variant>"
    names = F.coalesce(F.try_variant_get(v, "$", kind), F.create_map().cast(kind))
    if every_ and rest:
        none = F.array().cast("array<variant>")
        there, new = F.coalesce(_items(_get(v, key)), none), F.coalesce(_items(value), none)
        child = F.transform(F.arrays_zip(there.alias("old"), new.alias("new"), F.transform(new, lambda x: F.lit(True)).alias("is")), lambda x: F.when(x["is"], _put(x["old"], rest, x["new"])).otherwise(x["old"])).cast("variant")
    elif rest:
        child = bound(_get(v, key), lambda x: _put(x, rest, value))
    else:
        child = F.coalesce(_items(value), F.array(value)).cast("variant") if every_ else value
    return F.to_variant_object(F.map_concat(F.map_filter(names, lambda k, x: k != key), F.create_map(F.lit(key), child)))


def merged(*objects: Column) -> Column:
    """One object (a variant) of several; a later one's names win, whatever their values. What is null or no object is left out."""
    kind = "map<string,variant>"
    maps = [F.coalesce(F.try_variant_get(o, "$", kind), F.create_map().cast(kind)) for o in objects]
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(F.map_filter(out, lambda k, v: ~F.map_contains_key(m, k)), m)
    return F.to_variant_object(out)


def zipped(*columns: Column) -> Column:
    """Arrays side by side, as long as the longest, missing places null; a column that is no array stands at each place."""
    return F.arrays_zip(*columns)


#: What a mapping's field names mean in a record: column and type.
FIELDS = {
    "divenumber": ("number", "int"), "dive_number": ("number", "int"), "maxdepth": ("max_depth", "double"), "max_depth": ("max_depth", "double"), "meandepth": ("avg_depth", "double"),
    "depthtemp": ("temp_min", "double"), "water_temperature": ("temp_min", "double"), "location": ("location", "string"), "duration": ("duration", "int"), "weights": ("weight", "double"),
    "weight_unit": ("weight_unit", "string"), "visibility": ("visibility", "double"), "visibility_unit": ("visibility_unit", "string"), "buddy": ("buddy", "string"), "lat": ("lat", "double"), "lng": ("lng", "double"),
}
TANK_COLUMNS = {"vol": "volume", "start_pressure": "start", "end_pressure": "end", "o2": "oxygen"}
TANK_FIELDS = tuple(TANK_COLUMNS)


def overlay(mapping: str | dict, raw: Column, base: dict[str, Column]) -> dict[str, Column]:
    """``base`` (columns of a record) with what a mapping (a JSON text or its object) finds in ``raw``, a variant, laid over it.

    Entries are read in order: ``field`` and ``path``; or ``tanks`` with the paths of TANK_FIELDS, whose lists become
    the record's tanks. A path without a hit, or with one of another type, leaves the base. A ``divesite`` is joined
    to the location unless one holds the other. Unknown fields are an error.
    """
    entries = json.loads(mapping)["mappings"] if isinstance(mapping, str) else mapping["mappings"]
    out = dict(base)
    for e in entries:
        if "tanks" in e:
            out["tanks"] = _tanks(e["tanks"], raw, out.get("tanks"))
            continue
        name, path = e["field"], e["path"]
        if name == "divesite":
            site = first(raw, path)
            where = out.get("location", F.lit(None).cast("string"))
            out["location"] = F.when(site.isNull(), where).otherwise(location_with_site(where, site))
            continue
        if name not in FIELDS:
            raise ValueError(f"unknown field {name} in a mapping")
        column, kind = FIELDS[name]
        value = first(raw, path) if kind == "string" else first(raw, path).try_cast("double").cast(kind)
        out[column] = F.coalesce(value, out[column]) if column in out else value
    return out


def laid(mapping: str | dict, raw: Column, values: dict[str, Column]) -> Column:
    """The way back of :func:`overlay`: ``raw``, a variant, with a record's values at a mapping's paths, so that the overlay finds them there.

    ``values`` are columns of a record; what is null, and a column that isn't among them, leaves ``raw``. A ``divesite``
    takes the whole location. Tanks go to the places of their lists, however many items those have.
    """
    out = raw
    for e in (json.loads(mapping) if isinstance(mapping, str) else mapping)["mappings"]:
        if "tanks" in e:
            for n, path in e["tanks"].items() if "tanks" in values else ():
                column = TANK_COLUMNS[n]
                kept = F.transform(values["tanks"], lambda t: t[column])  # noqa: B023
                out = bound(out, lambda v: F.when(F.size(kept) > 0, put(v, path, kept)).otherwise(v))  # noqa: B023
            continue
        if e["field"] != "divesite" and e["field"] not in FIELDS:
            raise ValueError(f"unknown field {e['field']} in a mapping")
        column = "location" if e["field"] == "divesite" else FIELDS[e["field"]][0]
        if column in values:
            out = bound(out, lambda v: F.when(values[column].isNotNull(), put(v, e["path"], values[column])).otherwise(v))  # noqa: B023
    return out


def _tanks(paths: dict[str, str], raw: Column, base: Column | None) -> Column:
    unknown = set(paths) - set(TANK_FIELDS)
    if unknown:
        raise ValueError(f"unknown tank fields {sorted(unknown)}")
    lists = [(every(raw, paths[n], "string") if n in paths else F.lit(None).cast("array<string>")).alias(n) for n in TANK_FIELDS]
    rows = zipped(*[F.coalesce(c, F.array().cast("array<string>")).alias(n) for c, n in zip(lists, TANK_FIELDS, strict=True)])
    num = lambda c: c.try_cast("double")
    made = F.transform(rows, lambda t: tank(F.coalesce(num(t["o2"]), F.lit(21.0)), None, num(t["start_pressure"]), num(t["end_pressure"]), num(t["vol"])))
    return made if base is None else F.when(F.size(made) > 0, made).otherwise(base)


def variant(c: Column) -> Column:
    """JSON text as a variant; null for text that is none."""
    return F.try_parse_json(c)


