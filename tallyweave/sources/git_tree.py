"""Dives of a checked-out log tree as records: text files in year/month/dive folders, sites beside them.

Files are read as whole texts; each is small, and no file is a task of its own. A physical line that begins with a tab
goes on the line before, within quotes. Folders of other shapes and files of other names are left out, and so is a
dive without its ``Dive`` file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.paths import bound
from tallyweave.functions.text import leading_number
from tallyweave.functions.units import water_type
from tallyweave.schema import SAMPLE, channels, ids, known_temperature, record, sample, tank
from tallyweave.session import written
from tallyweave.sources import ssrf
from tallyweave.sources.xmls import by_key, get, listed

# Names of folders and files, and the key of a position.
SITES, SITE_PREFIX = "01-Divesites", "Site-"
DIVE, COMPUTER = "Dive", "Divecomputer"
_QUOTED = r'"([^"\\]*(?:\\.[^"\\]*)*)"'
EXIT_KEY = "GPS2"


def logical_lines(c: Column) -> Column:
    """Lines of a text, those that begin with a tab joined to the one before; the last may be empty and isn't kept."""
    return F.filter(F.split(c, r"\n(?!\t)"), lambda x: x != "")


def strings(line: Column) -> Column:
    """The quoted strings of a line, unescaped: a backslash takes the next character as it is, a tab after a line's end is dropped."""
    found = F.regexp_extract_all(line, F.lit("(?s)" + _QUOTED), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(F.replace(s, F.lit("\n\t"), F.lit("\n")), r"(?s)\\(.)", "$1"))


def bare(line: Column) -> Column:
    """The line with its strings emptied."""
    return F.regexp_replace(line, "(?s)" + _QUOTED, '""')


def words(lines: Column, key: str) -> Column:
    """The lines of a key."""
    return F.filter(lines, lambda x: F.startswith(x, F.lit(key + " ")) | (x == key))


def last(lines: Column, key: str) -> Column:
    """What stands behind the key on the last line that has it."""
    return F.substr(F.try_element_at(words(lines, key), F.lit(-1)), F.lit(len(key) + 2))


def said(lines: Column, key: str) -> Column:
    """The first string of the last line of a key; nothing of it is null."""
    return F.nullif(F.try_element_at(strings(F.try_element_at(words(lines, key), F.lit(-1))), F.lit(1)), F.lit(""))


def value(line: Column, key: str, bare_line: Column | None = None) -> Column:
    """The value of ``key=value`` on a line; of a quoted one its string. ``bare_line``: the line with its strings emptied, where that is known."""
    if bare_line is None:
        return bound(bare(line), lambda b: value(line, key, b))

    def quoted(before: Column) -> Column:
        # the strings stand in the order of the empty ones
        place = F.regexp_count(before, F.lit('""')) + 1
        return F.when(before != "", F.try_element_at(strings(line), place.cast("int")))

    plain = bound(F.regexp_extract(bare_line, rf'(?:^| ){key}=([^ "]+)', 1), lambda p: F.when(p != "", p))
    string = bound(F.regexp_extract(bare_line, rf'^(.*?(?:^| ){key}=)""', 1), quoted)
    return F.when(F.contains(bare_line, F.lit(key + "=")), F.coalesce(plain, string))


def cylinder(line: Column) -> Column:
    def of(b: Column) -> Column:
        number = lambda k: leading_number(value(line, k, b))
        role = bound(value(line, "use", b), lambda u: F.coalesce(*[F.when(u == k, v) for k, v in ssrf.ROLES.items()]))
        oxygen = bound(number("o2"), lambda x: F.when(x != 0, x).otherwise(F.lit(21.0)))
        text = bound(value(line, "description", b), lambda x: F.when(x != "", x))
        return tank(oxygen, F.coalesce(number("he"), F.lit(0.0)), number("start"), number("end"), number("vol"), text, role)

    return bound(bare(line), of)


_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def is_sample(line: Column) -> Column:
    return F.startswith(line, F.lit(" ")) | F.regexp_like(line, F.lit("^[0-9]+:[0-9]+"))


def writes_more(line: Column) -> Column:
    """Whether a sample's line has values besides time, depth, temperature and pressures; each is a ``key=value``."""
    return F.contains(line, F.lit("="))


def sample_line(line: Column) -> Column:
    """A line such as ``  0:10 5.2m 21.0°C 180.5bar:1 ndl=12:00`` with the names that the XML form gives them."""
    token = lambda form: F.nullif(F.regexp_extract(line, rf"(?: )({form})(?= |$)", 1), F.lit(""))
    own = {"time": F.regexp_extract(line, r"^\s*(\S+)", 1), "depth": token(_NUMBER + "m"), "temp": token(_NUMBER + "°C"), "pressure": token(_NUMBER + "bar")}
    own |= {f"pressure{i}": token(rf"{_NUMBER}bar:{i}") for i in ssrf.SLOTS}
    tail = lambda n: F.when(writes_more(line), F.nullif(F.regexp_extract(line, rf"(?: ){n}=(\S+)", 1), F.lit("")))
    fields = [(own[n] if n in own else tail(n)).alias(f"_{n}") for n in ssrf._SAMPLE_FIELDS]
    return F.struct(*fields)


def plain_samples(lines: Column) -> Column:
    """(t, depth, temp, pressures) of the lines of samples that write nothing more; those without a depth are left out."""
    number = lambda line, end: F.regexp_extract(line, rf" ({_NUMBER}){end}(?= |$)", 1).try_cast("double")
    whole = lambda line, n: F.coalesce(F.regexp_extract(line, r"^\s*([0-9]+)(?::([0-9]+))?", n).try_cast("int"), F.lit(0))
    reads = lambda line, i, end: F.struct(F.lit(i).alias("k"), bound(number(line, end), lambda v: F.when(v != 0, v)).alias("v"))
    pressures = lambda line: by_key(F.array(reads(line, 0, "bar"), *[reads(line, i, f"bar:{i}") for i in ssrf.SLOTS]), "int", "double")
    none = F.create_map().cast("map<int,double>")
    one = lambda x: F.struct((whole(x, 1) * 60 + whole(x, 2)).alias("t"), number(x, "m").alias("depth"), F.when(F.contains(x, F.lit("°C")), number(x, "°C")).alias("temp"), F.when(F.contains(x, F.lit("bar")), pressures(x)).otherwise(none).alias("pressures"))
    return F.filter(F.transform(lines, one), lambda s: s["depth"].isNotNull())


def plain_settled(raw: Column) -> Column:
    """Samples of :func:`plain_samples` as :func:`tallyweave.sources.ssrf.settled` gives them: nothing stands from one to the next."""
    def of(main: Column) -> Column:
        def one(s: Column) -> Column:
            bar = get(s["pressures"], main)
            alone = (main == 0) & bar.isNotNull() & (F.size(s["pressures"]) == 1)
            return sample(s["t"], s["depth"], s["temp"], bar, F.when(~F.coalesce(alone, F.lit(False)) & (F.size(s["pressures"]) > 0), channels(pressures=s["pressures"])))

        return F.transform(raw, one)

    return bound(F.array_min(F.transform(raw, lambda s: F.array_min(F.map_keys(s["pressures"])))), of)


def sites(files: DataFrame) -> DataFrame:
    """(site, name, lat, lng) of site files (path, text)."""
    lines = logical_lines(F.col("text"))
    place = ssrf.position(last(lines, "gps"))
    folder, name = (F.try_element_at(F.split("path", "/"), F.lit(i)) for i in (-2, -1))
    own = F.substr(name, F.lit(len(SITE_PREFIX) + 1))
    # looked for as a whole first, so that most paths aren't split
    rows = files.where(F.contains("path", F.lit(f"{SITES}/{SITE_PREFIX}"))).where((folder == SITES) & F.startswith(name, F.lit(SITE_PREFIX)) & (F.length(own) == 8) & (F.translate(F.lower(own), "0123456789abcdef", "") == ""))
    return rows.select(F.lower(own).alias("site"), said(lines, "name").alias("site_name"), place["lat"].alias("lat"), place["lng"].alias("lng"))


def _digits(c: Column, n: int | None = None) -> Column:
    """A whole number of (just ``n``) digits, else null."""
    fits = (F.translate(c, "0123456789", "") == "") & (F.length(c) == n if n else F.length(c) > 0)
    return F.when(fits, c.try_cast("int"))


def clock_of(rows: DataFrame) -> DataFrame:
    """Rows with ``folder``, and its dive's ``local``; null for folders of another shape.

    The folder of a dive is named by day, weekday and clock, before these maybe month and year, and behind a tilde
    maybe a hash. It lies in the folder of a month, or of a trip in that (its day and a name), and this in a year's.
    """
    C = F.col  # noqa: N806
    at = lambda parts, i: F.try_element_at(parts, F.lit(i))
    # steps of their own, so that each is worked out once a folder
    rows = rows.withColumn("_parts", F.split("folder", "/"))
    rows = rows.withColumns({"_day": F.split(F.split_part(at(C("_parts"), -1), F.lit("~"), F.lit(1)), "-"), "_trip": F.split(at(C("_parts"), -2), "-")})
    day, trip, parts = C("_day"), C("_trip"), C("_parts")
    in_trip = _digits(at(trip, 1), 2).isNotNull() & (F.size(trip) > 1) & _digits(F.substring(at(trip, 2), 1, 1)).isNull()
    month, year = (F.when(C("_in_trip"), at(parts, i - 1)).otherwise(at(parts, i)) for i in (-2, -3))
    rows = rows.withColumns({"_in_trip": in_trip, "_clock": F.split(F.translate(at(day, -1), ":", "="), "=")})
    numbers = {"_month": _digits(month, 2), "_year": _digits(year, 4), "_d": _digits(at(day, -3), 2), **{f"_{n}": _digits(F.get("_clock", i), 2) for i, n in enumerate("hms")}, "_own_month": _digits(at(day, -4), 2), "_own_year": _digits(at(day, -5), 4)}
    rows = rows.withColumns(numbers)
    weekday = (F.length(at(day, -2)) == 3) & (F.translate(F.lower(at(day, -2)), "abcdefghijklmnopqrstuvwxyz", "") == "")
    shaped = weekday & (F.size("_clock") == 3) & F.size(day).between(3, 5)
    for n in ("_month", "_year", "_d", "_h", "_m", "_s"):
        shaped = shaped & C(n).isNotNull()
    shaped = shaped & ((F.size(day) < 4) | C("_own_month").isNotNull()) & ((F.size(day) < 5) | C("_own_year").isNotNull())
    local = F.try_make_timestamp_ntz(F.coalesce("_own_year", "_year"), F.coalesce("_own_month", "_month"), "_d", "_h", "_m", C("_s").cast("decimal(8,6)"))
    return rows.withColumn("local", F.when(F.coalesce(shaped, F.lit(False)), local)).drop("_parts", "_day", "_trip", "_in_trip", "_clock", *numbers)


def folders(files: DataFrame) -> DataFrame:
    """(folder, local, id, name, number, text, computer, others, more): a row for each folder with a dive's file.

    ``name`` and ``text`` are the last dive file's, ``computer`` is the text of the first computer's file and ``others``
    those of the rest, and ``more`` says whether its samples write more than plain ones.
    """
    C = F.col  # noqa: N806
    name = F.substring_index("path", "/", -1)
    folder = F.substr(C("path"), F.lit(1), F.length("path") - F.length(name) - 1)
    parts = F.split(name, "-")
    known = F.get(parts, F.lit(0)).isin(DIVE, COMPUTER) & ((F.size(parts) == 1) | (F.size(parts) == 2) & _digits(F.get(parts, F.lit(1))).isNotNull())
    # a few characters tell most other files apart
    rows = files.where(F.startswith(name, F.lit(DIVE))).where(known)
    own = F.struct(name.alias("name"), F.col("text").alias("text"))
    is_dive = ~F.startswith(name, F.lit(COMPUTER))
    rows = rows.select(folder.alias("folder"), F.when(is_dive, own).alias("d"), F.when(~is_dive, own).alias("c"))
    rows = rows.groupBy("folder").agg(F.max("d").alias("d"), F.sort_array(F.collect_list("c")).alias("c"))
    rows = clock_of(rows).withColumn("computer", F.get("c", F.lit(0))["text"])
    return written(rows.select(
        "folder", "local", F.regexp_extract("folder", r"([0-9]{4}/[0-9]{2}/.*)$", 1).alias("id"), C("d.name").alias("name"), _digits(F.get(F.split("d.name", "-"), F.lit(1))).alias("number"), C("d.text").alias("text"), "computer",
        F.transform(F.slice("c", F.lit(2), F.greatest(F.size("c"), F.lit(1))), lambda x: x["text"]).alias("others"), F.coalesce(F.exists(logical_lines(C("computer")), lambda x: is_sample(x) & writes_more(x)), F.lit(False)).alias("more"),
    ), "git-rows").where("local is not null and text is not null")


def records(files: DataFrame, *keep: str) -> DataFrame:
    """Records of a tree's files (path, text). The first computer by file name counts.

    Samples whose values stand until the next is written take a window over all of a dive's; dives without such ones don't need it.
    """
    rows = folders(files)
    places = written(sites(files).withColumnRenamed("site", "_site"), "git-sites")
    out = _records(rows.where(~F.col("more")), places, False, *keep)
    if not rows.where("more").isEmpty():
        out = out.unionByName(_records(rows.where("more"), places, True, *keep))
    return out


def _records(rows: DataFrame, places: DataFrame, more: bool, *keep: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    others = F.flatten(F.transform("others", logical_lines))
    both = rows.withColumns({"lines": logical_lines(F.col("text")), "c": F.coalesce(logical_lines(F.col("computer")), empty)}).withColumn("every", F.concat("c", others))
    d, c = F.col("lines"), F.col("c")
    told = F.filter(c, lambda x: ~is_sample(x))
    tanks = F.transform(words(d, "cylinder"), cylinder)
    both = both.withColumn("_c", told).withColumn("_tanks0", tanks).withColumn("_oc", ssrf.open_circuit(F.col("_tanks0")))
    c = F.col("_c")
    keyed = lambda lines: F.transform(words(lines, "keyvalue"), lambda x: F.struct(F.try_element_at(strings(x), F.lit(1)).alias("k"), F.try_element_at(strings(x), F.lit(2)).alias("v")))
    both = both.withColumn("_extra", by_key(F.reverse(keyed(c)), "string", "string"))
    # positions and ids may stand with any computer
    both = both.withColumn("_any", by_key(F.reverse(keyed(F.col("every"))), "string", "string"))
    kind = F.trim(last(c, "dctype"))
    mode = F.coalesce(*[F.when(kind == k, v) for k, v in ssrf.MODES.items()], F.nullif(get(F.col("_extra"), F.lit("Dive mode")), F.lit("")), F.col("_oc"))
    seconds = lambda x: ssrf.seconds(F.substring(x, 7, 40))
    changed = F.filter(words(c, "event"), lambda x: F.coalesce(value(x, "name") == "modechange", F.lit(False)))
    changes = F.transform(changed, lambda x: F.struct(seconds(x).alias("t"), ssrf.mode_word(value(x, "divemode"), F.col("_oc")).alias("name")))
    both = both.withColumn("_mode", mode).withColumn("_changes", changes)
    own = F.filter("c", is_sample)
    if more:
        both = both.withColumn("_raw", ssrf.raw_samples(F.transform(own, sample_line), F.col("_tanks0")))
        # read twice, and its plan is large
        both = written(both, "git-tree")
        both = both.join(ssrf.settled(both, "folder", sticky_temp=False), "folder", "left").withColumn("samples", listed(F.col("samples"), SAMPLE))
    else:
        both = both.withColumn("_raw", plain_samples(own)).withColumn("samples", plain_settled(F.col("_raw")))
    both = both.withColumn("_site", F.lower(F.trim(last(d, "divesiteid")))).join(places, "_site", "left")

    def with_readings(t: Column, i: Column) -> Column:
        start, end = ssrf.first_and_last(F.col("_raw"), i)
        return t.withField("start", F.coalesce(t["start"], start)).withField("end", F.coalesce(t["end"], end))

    number = lambda lines, key: leading_number(last(lines, key))
    weights = F.transform(words(d, "weightsystem"), lambda x: F.coalesce(leading_number(value(x, "weight")), F.lit(0.0)))
    weight = F.when(F.size(weights) > 0, F.aggregate(weights, F.lit(0.0), lambda a, w: a + w))
    salinity = F.coalesce(F.nullif(number(d, "watersalinity"), F.lit(0.0)), F.nullif(number(c, "salinity"), F.lit(0.0)))
    water = water_type(salinity)
    out = ssrf.position(get(F.col("_any"), F.lit(EXIT_KEY)))
    other = F.map_filter("_any", lambda k, v: F.startswith(k, F.lit(ssrf.ID_PREFIX)) & (v != ""))
    other = F.transform_keys(other, lambda k, v: F.substr(k, F.lit(len(ssrf.ID_PREFIX) + 1)))
    tags = F.filter(F.flatten(F.transform(words(d, "tags"), strings)), lambda t: t != "")
    values = {
        "local": F.col("local"),
        "duration": F.coalesce(bound(last(d, "duration"), ssrf.seconds), bound(last(c, "duration"), ssrf.seconds), F.lit(0)),
        "max_depth": F.coalesce(number(c, "maxdepth"), F.array_max(F.transform("samples", lambda s: s["depth"])), F.lit(0.0)),
        "avg_depth": number(c, "meandepth"),
        "temp_min": F.coalesce(known_temperature(number(d, "watertemp")), known_temperature(number(c, "watertemp"))),
        "air_temp": F.coalesce(number(d, "airtemp"), number(c, "airtemp")),
        "external_ids": F.map_concat(F.map_filter(other, lambda k, v: k != "subsurface"), ids(subsurface=F.concat_ws("/", "id", "name"))),
        "tanks": F.transform("_tanks0", with_readings),
        "location": F.col("site_name"),
        "lat": F.col("lat"),
        "lng": F.col("lng"),
        "notes": said(d, "notes"),
        "buddy": said(d, "buddy"),
        "suit": said(d, "suit"),
        "number": F.col("number"),
        "weight": weight,
        "weight_unit": F.when(weight.isNotNull(), "kilogram"),
        "samples": F.col("samples"),
        "service_fields": ids(divemaster=said(d, "divemaster"), rating=number(d, "rating").cast("int"), visibility_stars=number(d, "visibility").cast("int"), tags=F.nullif(F.array_join(tags, ", "), F.lit(""))),
        "water_type": water,
        "water_density": F.when(water.isNull(), salinity),
        "exit_lat": out["lat"],
        "exit_lng": out["lng"],
    }
    return record(both, values, *keep)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the tree below a path, with ``folder``."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    return records(files.select(F.url_decode("_metadata.file_path").alias("path"), F.col("value").alias("text")), "folder")
