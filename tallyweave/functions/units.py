"""Unit conversions. Different services' factors differ, and stay apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.text import fixed, leading_number, unit

# Factors from SI to the imperial system, decimals shown, and labels.
FACTORS = {"depth": 3.280839895, "pressure": 14.5037738, "volume": 0.0353146667, "weight": 2.2046226218, "sac": 0.0353146667}
DECIMALS = {"depth": (1, 0), "pressure": (0, 0), "temperature": (1, 0), "volume": (1, 1), "weight": (1, 1), "sac": (1, 1)}
LABELS = {"depth": ("m", "ft"), "pressure": ("bar", "psi"), "temperature": ("°C", "°F"), "volume": ("L", "cuft"), "weight": ("kg", "lb"), "sac": ("L/min", "cuft/min")}
# Fixed values of one XML format's texts.
XML_FT, XML_PSI, XML_LB, XML_CUFT, XML_ATM = 0.3048, 0.0689476, 0.45359237, 28.3168, 1.01325
# Factors that the online services' numbers are meant with.
SERVICE_FT_M, SERVICE_PSI_BAR, SERVICE_CUFT_L, LB_KG = 1 / 3.28084, 1 / 14.5038, 28.3168, 0.45359237
WATER = {"fresh": 1000, "salt": 1030, "en13319": 1020}
WATER_OF = {1000: "fresh", 1020: "en13319", 1030: "salt", 1025: "salt"}


def convert(kind: str, c: Column, imperial: bool) -> Column:
    """SI to the units shown."""
    if not imperial:
        return c
    return c * 1.8 + 32.0 if kind == "temperature" else c * FACTORS[kind]


def convert_back(kind: str, c: Column, imperial: bool) -> Column:
    if not imperial:
        return c
    return (c - 32.0) / 1.8 if kind == "temperature" else c / FACTORS[kind]


def shown(kind: str, c: Column, imperial: bool, label: bool = False) -> Column:
    """Converted and rounded as each kind is shown; null gives an empty text."""
    text = fixed(convert(kind, c, imperial), DECIMALS[kind][imperial])
    if label:
        text = F.concat(text, F.lit(" " + LABELS[kind][imperial]))
    return F.coalesce(text, F.lit(""))


def depth_m(c: Column) -> Column:
    u, v = unit(c), leading_number(c)
    return F.when(u.startswith("ft") | (u == "feet"), F.round(v * XML_FT, 3)).when(u == "mm", F.round(v / 1000, 3)).otherwise(v)


def temperature_c(c: Column) -> Column:
    u, v = unit(c), leading_number(c)
    return F.when(u.startswith("f"), F.round((v - 32.0) * 5.0 / 9.0, 3)).when(u.startswith("k"), F.round(v - 273.15, 3)).otherwise(v)


def pressure_bar(c: Column) -> Column:
    u, v = unit(c), leading_number(c)
    return F.when(u.startswith("psi"), F.round(v * XML_PSI, 3)).when(u == "mbar", F.round(v / 1000, 3)).when(u == "pa", F.round(v / 100000, 3)).otherwise(v)


def weight_kg(c: Column) -> Column:
    u, v = unit(c), leading_number(c)
    return F.when(u.startswith("lb"), F.round(v * XML_LB, 3)).when(u == "g", F.round(v / 1000, 3)).otherwise(v)


def volume_l(c: Column, work_bar: Column) -> Column:
    """Litres; cubic feet are the gas at working pressure, and unknown without that."""
    u, v = unit(c), leading_number(c)
    gas = F.when(work_bar != 0, F.round(v * XML_CUFT * XML_ATM / work_bar, 3))
    return F.when(u.startswith("cuft") | u.startswith("cu ft"), gas).when(u == "ml", F.round(v / 1000, 3)).otherwise(v)


def kelvin(c: Column) -> Column:
    return c - 273.15


def pascal_bar(c: Column) -> Column:
    """Pascal to bar; from about 562.6 bar a status code, not a reading."""
    bar = c / 100000.0
    return F.when(bar < 562.6, bar)


def cubic_metre_l(c: Column) -> Column:
    return c * 1000.0


def water_type(density: Column) -> Column:
    pairs = [F.lit(x) for k, v in WATER_OF.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), F.rint(density).cast("int"))


def density(kind: Column, measured: Column) -> Column:
    pairs = [F.lit(x) for k, v in WATER.items() for x in (k, v)]
    return F.when(F.coalesce(measured, F.lit(0.0)) != 0, F.rint(measured).cast("int")).otherwise(F.try_element_at(F.create_map(*pairs), F.coalesce(kind, F.lit(""))))


def transmitter_bar(word: Column, psi_per_bar: float = 14.5037738) -> Column:
    """A 16-bit word of 2-psi steps under four battery bits, in bar with two decimals; 0 steps, and words from 0xFFF0 on, are no reading."""
    steps = word.bitwiseAND(F.lit(0x0FFF))
    return F.when((word < 0xFFF0) & (steps > 0), F.round(steps * 2 / psi_per_bar, 2))


def sac(tanks: Column, avg_depth: Column, duration_s: Column, logged: Column | None = None) -> Column:
    """Surface air consumption in litres a minute of tanks (volume, start, end); null if anything is missing."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))

    def used(total: Column, t: Column) -> Column:
        drop = zero(t["start"]) - zero(t["end"])
        return total + F.when((zero(t["volume"]) > 0) & (drop > 0), drop * t["volume"]).otherwise(0.0)

    litres = F.aggregate(F.coalesce(tanks, F.array().cast("array<struct<volume:double,start:double,end:double>>")), F.lit(0.0), used)
    value = F.when((duration_s > 0) & (avg_depth > 0) & (litres > 0), litres / (duration_s / 60.0 * (avg_depth / 10.0 + 1.0)))
    return value if logged is None else F.coalesce(logged, value)
