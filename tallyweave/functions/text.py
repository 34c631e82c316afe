"""Text functions over columns. Null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that a file must not have, and makers of two words.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
STEM = 120
SECRET = "***"


def strip(c: Column) -> Column:
    """Without white space of any kind around (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal(c: Column) -> Column:
    """Text as compared: null and the word None are empty, outer white space doesn't count."""
    return F.when(c.isNull() | (c == "None"), "").otherwise(strip(c))


def is_blank(c: Column) -> Column:
    return normal(c) == ""


def tidy(c: Column, separator: str = ", ") -> Column:
    """Segments between separators, stripped, without empty ones."""
    token = separator.strip() or separator
    pattern = "".join("\\" + x if not x.isalnum() else x for x in token)
    return F.array_join(F.filter(F.transform(F.split(c, pattern), strip), lambda s: s != ""), separator)


def split_once(c: Column, separator: str = ",") -> Column:
    """(first, second) around the first separator, stripped; without one the first is empty and all is second."""
    at = F.locate(separator, c)
    first = F.when(at > 0, strip(F.substring(c, 1, at - 1))).otherwise("")
    second = F.when(at > 0, strip(F.substring(c, at + len(separator), F.length(c)))).otherwise(c)
    return F.struct(first.alias("first"), second.alias("second"))


def leading_number(c: Column) -> Column:
    """The number that a text starts with, else null."""
    return F.regexp_extract(c, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def any_number(c: Column) -> Column:
    """The first number anywhere, a decimal comma read as a point, else null."""
    return F.replace(F.regexp_extract(c, r"-?[0-9]+(?:[.,][0-9]+)?", 0), F.lit(","), F.lit(".")).try_cast("double")


def unit(c: Column) -> Column:
    """What follows the leading number, lower case."""
    return F.lower(strip(F.regexp_replace(c, r"^\s*-?[0-9]+(?:\.[0-9]+)?\s*", "")))


def number_and_unit(c: Column, units: dict[str, list[str]], default: str) -> Column:
    """(value, unit) of a whole text such as ``12 kg``. ``units`` maps a name to parts that mark it, the first name wins."""
    said = unit(c)
    # a unit is letters, and nothing else follows the number
    fits = (F.translate(F.lower(said), "abcdefghijklmnopqrstuvwxyz \t", "") == "") & ~F.startswith(strip(c), F.lit("-"))
    value = F.when(fits, leading_number(c))
    name = F.lit(default)
    for key, marks in reversed(units.items()):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(said, F.lit(m))
        name = F.when(hit, key).otherwise(name)
    return F.struct(value.alias("value"), F.when(value.isNotNull(), name).alias("unit"))


def general(c: Column) -> Column:
    """A number with up to six significant digits, without a tail of zeros (the ``%g`` form)."""
    power = F.floor(F.log10(F.abs(c))).cast("int")
    plain = F.call_function("format_number", c, F.concat(F.lit("0."), F.repeat(F.lit("#"), F.greatest(F.lit(5) - power, F.lit(0)))))
    science = F.call_function("format_number", c, F.lit("0.#####E0"))
    exponent = F.regexp_extract(science, r"E(-?[0-9]+)$", 1).try_cast("int")
    long = F.concat(F.substring_index(science, "E", 1), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when(c.isNull(), None).when(c == 0, "0").when((exponent < -4) | (exponent >= 6), long).otherwise(F.regexp_replace(plain, r"\.$", ""))


def thousandths(c: Column) -> Column:
    """One to three decimals: ``30.0``, ``1.2``, ``11.094``."""
    milli = F.rint(c * 1000).cast("long")
    digits = F.lpad((F.abs(milli) % 1000).cast("string"), 3, "0")
    return F.concat(F.when(milli < 0, "-").otherwise(""), F.floor(F.abs(milli) / 1000).cast("string"), F.lit("."), F.regexp_replace(digits, "^(.)(?:00$|(.)0$|(..)$)", "$1$2$3"))


def degrees(c: Column) -> Column:
    """A signed number of micro-degrees with six decimals."""
    micro = F.rint(c * 1_000_000).cast("long")
    return F.concat(F.when(micro < 0, "-").otherwise(""), F.floor(F.abs(micro) / 1_000_000).cast("string"), F.lit("."), F.lpad((F.abs(micro) % 1_000_000).cast("string"), 6, "0"))


def fixed(c: Column, decimals: int) -> Column:
    """Fixed decimals, ties to even, no thousands separator."""
    return F.call_function("format_number", c, F.lit("0" if decimals == 0 else "0." + "0" * decimals))


def quoted(c: Column) -> Column:
    """In double quotes, with quotes and backslashes escaped by a backslash."""
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))


def xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def safe_stem(c: Column, fallback: str = "dive") -> Column:
    """Letters, digits, dot, dash and underscore only."""
    safe = F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")
    return F.when(safe == "", fallback).otherwise(safe)


def slug(c: Column) -> Column:
    """The body of an XML id."""
    safe = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(safe == "", "x").otherwise(safe)


def safe_file(c: Column, fallback: str = "dive") -> Column:
    """A file stem without what common systems refuse."""
    stem = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", " ")
    stem = F.regexp_replace(stem, r"^[ .]+|[ .]+$", "")
    stem = F.when(stem == "", fallback).otherwise(stem)
    stem = F.when(F.upper(stem).isin(RESERVED), F.concat(stem, F.lit("_"))).otherwise(stem)
    return F.regexp_replace(F.substring(stem, 1, STEM), r"[ .]+$", "")


def directory(c: Column) -> Column:
    """A record's path without its last part ``Dive-<n>``."""
    return F.regexp_replace(c, r"/Dive-[0-9]*$", "")


def maker_and_model(c: Column, two_words: list[str], manual: str = "manually added dive") -> Column:
    """(maker, model): the first word, or two for the makers listed, and the rest; one word is a model."""
    text = strip(F.coalesce(c, F.lit("")))
    usual = F.regexp_extract(text, r"^(\S+)\s+(.*)$", 1)
    maker, model = F.when(usual != "", usual), F.when(usual != "", F.regexp_extract(text, r"^(\S+)\s+(.*)$", 2)).otherwise(text)
    for m in two_words:
        here = F.startswith(F.lower(text), F.lit(m.lower() + " "))
        maker = F.when(here, F.substring(text, 1, len(m))).otherwise(maker)
        model = F.when(here, strip(F.substring(text, len(m) + 1, 10_000))).otherwise(model)
    none = (text == "") | (text == manual)
    return F.struct(F.when(~none, maker).alias("maker"), F.when(~none, model).alias("model"))


def deco_model(c: Column) -> Column:
    """(model, gf_low, gf_high) of texts such as ``ZHL-16C GF 40/85``."""
    text = strip(F.coalesce(c, F.lit("")))
    factor = r"(?:GF\s*)?([0-9]{1,3})\s*/\s*([0-9]{1,3})"
    low, high = F.regexp_extract(text, factor, 1).try_cast("int"), F.regexp_extract(text, factor, 2).try_cast("int")
    rest = strip(F.regexp_replace(text, factor, ""))
    letter = F.upper(F.regexp_extract(rest, r"(?i)ZH-?L-?16\s*([ABC])", 1))
    return F.struct(F.when(letter != "", F.concat(F.lit("ZHL-16"), letter)).when(rest != "", rest).alias("model"), low.alias("gf_low"), high.alias("gf_high"))


def gas_name(oxygen: Column, helium: Column) -> Column:
    """Air, EAN32, O2 or 21/35. A missing oxygen means air."""
    o2, he = F.coalesce(oxygen.cast("double"), F.lit(21.0)), F.coalesce(helium.cast("double"), F.lit(0.0))
    return F.when(he > 0, F.concat(general(o2), F.lit("/"), general(he))).when(o2 >= 99.5, "O2").when(F.abs(o2 - 21.0) <= 0.5, "Air").otherwise(F.concat(F.lit("EAN"), general(o2)))


def tank_label(name: Column, index: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.concat(F.lit("Tank "), (index + 1).cast("string")))


def masked_mail(c: Column) -> Column:
    """``m***@example.com``; without an at sign ``***``, of nothing nothing."""
    mail = strip(F.coalesce(c, F.lit("")))
    return F.when(mail == "", "").when(~F.contains(mail, F.lit("@")), SECRET).otherwise(F.concat(F.regexp_extract(mail, "^([^@]?)", 1), F.lit("***@"), F.regexp_extract(mail, "^[^@]*@(.*)$", 1)))


# What credentials are called, and the schemes that a bare one follows.
CREDENTIALS = ("password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey", "authorization")
SCHEMES = ("bearer", "basic")


def scrubbed(c: Column, secrets: list[str] = (), homes: list[str] = ()) -> Column:
    """Home folders as ``~``, query strings cut, secrets replaced, credentials cut to the end of their line; null stays null."""
    out = c
    for h in sorted(filter(None, homes), key=len, reverse=True):
        out = F.replace(out, F.lit(h), F.lit("~"))
    out = F.regexp_replace(out, r"\?[^\s'\"<>)]*", "?...")
    for s in secrets:
        if s:
            out = F.replace(out, F.lit(s), F.lit(SECRET))
    return F.array_join(F.transform(F.split(out, "\n"), _without_credentials), "\n")


def _without_credentials(line: Column) -> Column:
    """A line cut behind the first credential that is given a value; without one, the words that follow a scheme are replaced."""
    tail = F.when(F.endswith(line, F.lit("\r")), "\r").otherwise("")
    low = F.lower(line)
    given = [F.regexp_substr(low, F.lit(rf"{name}\s*[:=]\s*")) for name in CREDENTIALS]
    ends = F.array_compact(F.array(*[F.when(g.isNotNull(), F.struct(F.instr(low, g).alias("at"), F.length(g).alias("n"))) for g in given]))
    first = F.array_min(ends)
    words = F.split(line, " ")

    def word(w: Column, i: Column) -> Column:
        before = F.lower(F.ltrim(F.get(words, i - 1), F.lit("([{'\"")))
        return F.when(before.isin(list(SCHEMES)) & (F.length(w) >= 8) & F.regexp_like(w, F.lit("^[A-Za-z0-9._~+/=-]*$")), "[redacted]").otherwise(w)

    return F.when(first.isNotNull(), F.concat(F.substring(line, F.lit(1), first["at"] + first["n"] - 1), F.lit("[redacted]"), tail)).otherwise(F.array_join(F.transform(words, word), " "))


def reference(ids: Column, first: str, own: str) -> Column:
    """``service:id`` of a map of ids: that of ``first``, else the first of the others by name, ``own`` excluded."""
    order = F.array_sort(F.filter(F.map_keys(ids), lambda k: ~k.isin(first, own)))
    tried = F.transform(F.concat(F.array(F.lit(first)), order), lambda k: F.struct(k.alias("k"), F.trim(F.coalesce(F.try_element_at(ids, k), F.lit(""))).alias("v")))
    hit = F.try_element_at(F.filter(tried, lambda x: x["v"] != ""), F.lit(1))
    return F.when(hit.isNotNull(), F.concat(hit["k"], F.lit(":"), hit["v"]))


def reference_ids(c: Column, services: list[str]) -> Column:
    """The map that a reference ``service:id`` names; empty for another form."""
    service, value = F.lower(F.trim(F.substring_index(c, ":", 1))), F.trim(F.regexp_extract(c, "^[^:]*:(.*)$", 1))
    known = F.coalesce(service.isin(services) & (value != ""), F.lit(False))
    return F.when(known, F.map_from_arrays(F.array(service), F.array(value))).otherwise(F.create_map().cast("map<string,string>"))


def short_id(*parts: Column, length: int = 10) -> Column:
    """The first hex digits of the SHA-1 of parts joined by a bar; a null part reads None."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]).cast("binary")), 1, length)


def location_with_site(location: Column, site: Column) -> Column:
    """Both joined, unless one holds the other; then the longer."""
    where, what = F.coalesce(location, F.lit("")), F.coalesce(site, F.lit(""))
    held = F.contains(what, F.trim(where)) | F.contains(where, F.trim(what))
    return F.when(where == "", what).when(held, F.when(F.length(what) >= F.length(where), what).otherwise(where)).otherwise(F.concat(where, F.lit(", "), what))


def shown(c: Column) -> Column:
    """A value for people: blank as (empty)."""
    return F.when(c.isNull() | (c == ""), "(empty)").otherwise(c)


def is_true(c: Column) -> Column:
    """Whether a flag written as a number or a word is set."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes"), F.lit(False))
