"""Templates such as ``{site} ({location})`` and patterns, compiled to columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.text import fixed, strip, tidy
from tallyweave.functions.compare import empty

#: strftime codes and what Spark calls them.
CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD"}


class TemplateError(ValueError):
    """A template or pattern that can't be compiled."""


def parsed(template: str) -> list[tuple[str, str | None, str]]:
    """(literal, field or None, format) in order."""
    try:
        return [(a, k, s or "") for a, k, s, _ in Formatter().parse(template)]
    except ValueError as e:
        raise TemplateError(f"malformed template: {e}") from e


def fields(template: str) -> list[str]:
    return [k for _, k, _ in parsed(template) if k]


def formatted(c: Column, kind: str, spec: str, separator: str = ", ") -> Column:
    """One value as text; an empty one as an empty text."""
    if kind == "list":
        text = F.array_join(c, separator)
    elif kind == "measure":
        return formatted(c["value"], "number", spec, separator)
    elif kind == "datetime":
        pattern = spec or "%Y-%m-%d %H:%M:%S"
        out = ""
        for part in re.split(r"(%[A-Za-z])", pattern):
            if part.startswith("%"):
                if part not in CODES:
                    raise TemplateError(f"unknown date code {part}")
                out += CODES[part]
            elif part:
                out += "'" + part.replace("'", "''") + "'"
        text = F.date_format(c, out)
    elif kind == "number" and spec:
        m = re.fullmatch(r"(0?)(\d*)(?:\.(\d+))?([df])", spec)
        if not m:
            raise TemplateError(f"unknown number format {spec}")
        text = c.cast("double").cast("long").cast("string") if m[4] == "d" else fixed(c.cast("double"), int(m[3] or 6))
        if m[2]:
            text = F.when(F.length(text) < int(m[2]), F.lpad(text, int(m[2]), "0" if m[1] else " ")).otherwise(text)
    else:
        text = c.cast("string")
    return F.when(empty(kind, c), "").otherwise(F.coalesce(text, F.lit("")))


def render(template: str, value: Callable[[str], tuple[Column, str]], separator: str = ", ", most: int | None = None) -> Column:
    """The text of a template. Of several fields empty segments between separators go; longer texts are cut at ``most``."""
    parts = []
    for literal, key, spec in parsed(template):
        if literal:
            parts.append(F.lit(literal))
        if key:
            c, kind = value(key)
            parts.append(formatted(c, kind, spec, separator))
    text = F.concat(*parts) if parts else F.lit("")
    if len(fields(template)) > 1:
        token = separator.strip() or separator
        text = F.when(F.contains(text, F.lit(token)), tidy(text, separator)).otherwise(strip(text))
    return F.left(text, F.lit(most)) if most else text


def _literal(text: str) -> str:
    words = [re.escape(w) for w in text.split()]
    return r"\s*" + r"\s*".join(words) + r"\s*" if words else r"\s+" if text else ""


def auto_pattern(template: str) -> str:
    """The pattern that takes a template's text apart: each field as few characters as will do, blanks around literals optional."""
    out, open_ = "", False
    for literal, key, _ in parsed(template):
        out += _literal(literal)
        if key:
            if open_ and not literal:
                raise TemplateError("fields need text between them to be split")
            out += f"(?P<{key.rpartition('.')[2]}>.+?)"
            open_ = True
    return out


def _java(pattern: str) -> str:
    return re.sub(r"\(\?P<([A-Za-z_]\w*)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)


def split(c: Column, pattern: str) -> dict[str, Column]:
    """Each named group of a pattern that the whole stripped text has to match; null where it doesn't."""
    names = re.compile(pattern).groupindex
    if not names:
        raise TemplateError("a split needs named groups")
    whole = r"\A(?:" + _java(pattern) + r")\z"
    ok = F.regexp_like(strip(c), F.lit(whole))
    return {n: F.when(ok, strip(F.regexp_extract(strip(c), whole, i))) for n, i in names.items()}


def part(c: Column, pattern: str) -> Column:
    """What a pattern finds in a text: its group ``take``, else its first group, else all of it; null where it finds nothing."""
    compiled = re.compile(pattern)
    i = compiled.groupindex.get("take", 1 if compiled.groups else 0)
    return F.when(F.regexp_like(c, F.lit(_java(pattern))), F.regexp_extract(c, _java(pattern), i))
