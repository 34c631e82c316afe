"""The one record that all sources give and all sinks take: a dive as a row with nested lists, in SI units.

Fields that a source doesn't know are null, lists empty. Clocks have no zone (TIMESTAMP_NTZ).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TANK = "struct<oxygen:double,helium:double,start:double,end:double,volume:double,name:string,role:string>"
MIX = "struct<oxygen:double,helium:double>"
CHANNELS = (
    "struct<pressures:map<int,double>,ndl:int,tts:int,stop_depth:double,stop_time:int,cns:double,ppo2:double,"
    "setpoint:double,o2_cells:map<int,double>,gf99:double,gas_time:int,heart_rate:int>"
)
SAMPLE = f"struct<t:int,depth:double,temp:double,pressure:double,channels:{CHANNELS}>"
EVENT = "struct<t:int,type:string,name:string,tank:int,oxygen:double,helium:double,value:double>"
#: Columns of a record, in order.
RECORD = (
    "local timestamp_ntz, utc timestamp_ntz, zone string, duration int, max_depth double, avg_depth double, temp_min double, temp_max double, temp_avg double, "
    f"external_ids map<string,string>, tanks array<{TANK}>, location string, notes string, number int, weight double, weight_unit string, visibility double, "
    f"visibility_unit string, buddy string, lat double, lng double, samples array<{SAMPLE}>, device_logged boolean, service_fields map<string,string>, "
    f"events array<{EVENT}>, computer_vendor string, computer_model string, computer_serial string, computer_firmware string, gf_low int, gf_high int, "
    "deco_model string, water_type string, water_density double, dive_mode string, exit_lat double, exit_lng double, surface_interval int, bottom_time int, "
    "cns_start double, cns_end double, sac double, air_temp double, suit string"
)
#: The type of each column; no session is needed to know them.
KINDS = dict(re.split(r"\s+", c.strip(), maxsplit=1) for c in re.split(r",(?![^<]*>)\s*(?=[a-z_]+ [a-z])", RECORD))


def record(rows: DataFrame, values: dict[str, Column], *keep: str) -> DataFrame:
    """``rows`` as records: each column of RECORD from ``values``, cast to its type; lists without a value are empty, others null. ``keep`` names columns that come along."""
    unknown = set(values) - set(KINDS)
    if unknown:
        raise ValueError(f"no columns of a record: {sorted(unknown)}")
    out = []
    for name, kind in KINDS.items():
        c = values.get(name, F.lit(None)).cast(kind)
        if kind.startswith("array"):
            c = F.coalesce(c, F.array().cast(kind))
        elif kind.startswith("map"):
            c = F.coalesce(c, F.create_map().cast(kind))
        out.append(c.alias(name))
    return rows.select(*keep, *out)


def number(c: Column) -> Column:
    """A number that may be written as text; blank or unreadable is null."""
    return F.trim(c.cast("string")).try_cast("double")


def whole(c: Column) -> Column:
    """A whole number, cut towards zero."""
    return number(c).try_cast("long").try_cast("int")


def rounded(c: Column) -> Column:
    """The nearest whole number, ties to the even one."""
    return F.rint(number(c)).try_cast("int")


def text(c: Column) -> Column:
    """Text without outer white space; nothing of it is null."""
    stripped = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when(stripped != "", stripped)


def known_temperature(c: Column) -> Column:
    """A water temperature; 0 stands for none."""
    return F.when(c != 0, c)


def ids(**services: Column) -> Column:
    """A map of the ids that are known."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in services.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))


def events_of(c: Column) -> Column:
    """Events as EVENT, in the order of time, ties as they came."""
    return F.transform(F.array_sort(F.transform(c, lambda e, i: F.struct(e["t"].alias("t"), i.alias("i"), e.alias("e")))), lambda x: x["e"])


def event(t: Column, type_: Column | str, name: Column | None = None, tank: Column | None = None, oxygen: Column | None = None, helium: Column | None = None, value: Column | None = None) -> Column:
    none = F.lit(None)
    parts = {"t": t, "type": F.lit(type_) if isinstance(type_, str) else type_, "name": name, "tank": tank, "oxygen": oxygen, "helium": helium, "value": value}
    kinds = {"t": "int", "type": "string", "name": "string", "tank": "int"}
    return F.struct(*[(none if v is None else v).cast(kinds.get(k, "double")).alias(k) for k, v in parts.items()])


def sample(t: Column, depth: Column, temp: Column | None = None, pressure: Column | None = None, channels: Column | None = None) -> Column:
    parts = {"t": (t, "int"), "depth": (depth, "double"), "temp": (temp, "double"), "pressure": (pressure, "double"), "channels": (channels, CHANNELS)}
    return F.struct(*[(F.lit(None) if v is None else v).cast(kind).alias(k) for k, (v, kind) in parts.items()])


def channels(**known: Column) -> Column:
    """The channels of a sample; null when none of them says anything."""
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL("c " + CHANNELS)[0].dataType}
    values = {}
    for name, kind in kinds.items():
        c = known.get(name, F.lit(None)).cast(kind)
        values[name] = F.coalesce(c, F.create_map().cast(kind)) if kind.startswith("map") else c
    says = [F.size(c) > 0 if kinds[n].startswith("map") else c.isNotNull() for n, c in values.items()]
    any_ = says[0]
    for s in says[1:]:
        any_ = any_ | s
    return F.when(any_, F.struct(*[c.alias(n) for n, c in values.items()]))


def tank(oxygen: Column, helium: Column | None = None, start: Column | None = None, end: Column | None = None, volume: Column | None = None, name: Column | None = None, role: Column | None = None) -> Column:
    parts = {"oxygen": oxygen, "helium": F.lit(0.0) if helium is None else helium, "start": start, "end": end, "volume": volume, "name": name, "role": role}
    return F.struct(*[(F.lit(None) if v is None else v).cast("string" if k in ("name", "role") else "double").alias(k) for k, v in parts.items()])


def array_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")
