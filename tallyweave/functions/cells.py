"""Values of single cells: text columns compared and normalised, names of files, numbers of devices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers written as text are the same within this.
SAME_NUMBER = 0.005


def same_cell(a: Column, b: Column) -> Column:
    """Whether two text cells say the same: blank is null, and plain numbers count as numbers (``2857.24`` and ``2857.240``). Never null."""
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    number = lambda c: F.when(c.rlike(r"^-?[\d.,]+$"), F.regexp_replace(c, ",", ".").try_cast("double"))
    x, y = said(a), said(b)
    return x.eqNullSafe(y) | F.coalesce(F.abs(number(x) - number(y)) < SAME_NUMBER, F.lit(False))


def option(c: Column, options: Sequence[str]) -> Column:
    """The known option that the text is, whatever its case; of several the one spelled alike, else the first. Null for an unknown one."""
    known = F.array(*[F.lit(o) for o in options])
    text = F.trim(c)
    alike = F.filter(known, lambda o: F.lower(o) == F.lower(text))
    return F.when(F.array_contains(known, text), text).otherwise(F.get(alike, 0))


def unless_zero(*columns: Column) -> Column:
    """The first that is known and not 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in columns])


def file_stem(number: Column, local: Column, own_id: Column) -> Column:
    """``12_2024-05-01_102345_17283746``; ``nonum`` without a whole number, zeros without a start, null without an id."""
    digits = F.trim(number.cast("string"))
    first = F.when(digits.rlike(r"^\d+$"), digits).otherwise("nonum")
    at = F.coalesce(F.date_format(local, "yyyy-MM-dd_HHmmss"), F.lit("0000-00-00_000000"))
    return F.concat(first, F.lit("_"), at, F.lit("_"), own_id.cast("string"))


def id_of_file(path: Column) -> Column:
    """The id that a file's name holds: last of four parts, or eight digits and more with or without ``_ACTIVITY``; else null."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    parts = F.split(stem, "_")
    last = F.element_at(parts, -1)
    alone = F.regexp_extract(stem, r"(?i)^(\d{8,})(_ACTIVITY)?$", 1)
    return F.when((F.size(parts) == 4) & last.rlike(r"^\d+$"), last).when(alone != "", alone)


def serial_text(c: Column) -> Column:
    """A device's number as at least eight hexadecimal digits."""
    return F.when(F.length(F.hex(c)) < 8, F.lpad(F.hex(c), 8, "0")).otherwise(F.hex(c))


def pressure_rate(sac: Column, tanks: Column) -> Column:
    """Surface consumption as bar a minute of the first tank; null without its volume."""
    volume = F.get(tanks, 0)["volume"]
    return F.when(volume > 0, sac / volume)
