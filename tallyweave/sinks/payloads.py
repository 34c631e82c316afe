"""Records as the objects that services take, as JSON text made by Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.compare import resampled
from tallyweave.functions.units import SERVICE_CUFT_L, SERVICE_FT_M, SERVICE_PSI_BAR


def _in(c: Column, unit: Column, other: tuple[str, ...], factor: float, turn: bool) -> Column:
    """A quantity in the account's unit: ``other`` are the beginnings of the unit that is ``factor`` of the metric one; ``turn`` tells that the account wants that."""
    is_other = F.lower(F.trim(F.coalesce(unit, F.lit("")))).startswith(other[0])
    for o in other[1:]:
        is_other = is_other | F.lower(F.trim(F.coalesce(unit, F.lit("")))).startswith(o)
    return F.when(is_other, c if turn else c * factor).otherwise(c / factor if turn else c)


def divelogs(imperial: bool = False) -> Column:
    """The JSON text that a log takes for a record (columns of :mod:`tallyweave.schema`), which ``services.divelogs`` reads back.

    A place goes to location and site, split at its first comma, unless ``service_fields`` has both already; samples go
    on an even grid of their modal spacing, as the log keeps no times, and begin at 0. ``imperial`` accounts get feet,
    Fahrenheit, PSI and cubic feet. Unknown temperatures are 0, unknown texts empty and unknown numbers left out.
    """
    C = F.col  # noqa: N806
    length = lambda c: c / SERVICE_FT_M if imperial else c
    degrees = lambda c: c * 9 / 5 + 32 if imperial else c
    pressure = lambda c: c / SERVICE_PSI_BAR if imperial else c
    volume = lambda c: c / SERVICE_CUFT_L if imperial else c
    known = lambda c: F.coalesce(c, F.lit(0.0))
    words = lambda c: F.coalesce(c, F.lit(""))
    own, kept = C("service_fields"), lambda n: words(F.try_element_at("service_fields", F.lit(n)))
    place = words(C("location"))
    comma = F.instr(place, F.lit(","))
    before, after = F.trim(F.substring(place, F.lit(1), comma - 1)), F.trim(F.substr(place, comma + 1))
    native = F.coalesce(F.map_contains_key(own, F.lit("location")) & F.map_contains_key(own, F.lit("divesite")), F.lit(False)) & ((kept("location") != "") | (kept("divesite") != ""))
    location = F.when(native, kept("location")).when(comma > 0, before).otherwise("")
    site = F.when(native, kept("divesite")).when(comma > 0, after).otherwise(place)
    tanks = F.transform("tanks", lambda t: F.struct(t["oxygen"].alias("o2"), t["helium"].alias("he"), pressure(t["start"]).alias("start_pressure"), pressure(t["end"]).alias("end_pressure"), volume(t["volume"]).alias("vol"), words(t["name"]).alias("tankname")))
    weight = F.round(_in(C("weight"), C("weight_unit"), ("p", "l"), 0.45359237, imperial), 2)
    seen = F.round(_in(C("visibility"), C("visibility_unit"), ("f",), 0.3048, imperial), 1)
    fields = F.struct(
        F.date_format("local", "yyyy-MM-dd").alias("date"), F.date_format("local", "HH:mm:ss").alias("time"), C("duration"), length(C("max_depth")).alias("maxdepth"), length(C("avg_depth")).alias("meandepth"), known(degrees(C("temp_min"))).alias("depthtemp"), known(degrees(C("air_temp"))).alias("airtemp"),
        location.alias("location"), site.alias("divesite"), words(C("notes")).alias("notes"), C("number").alias("divenumber"), weight.alias("weights"), F.when(seen.isNotNull(), F.concat(seen.cast("string"), F.lit(" ft" if imperial else " m"))).alias("visibility"), words(C("buddy")).alias("buddy"), C("lat"), C("lng"), tanks.alias("tanks"),
    )
    object_ = F.to_json(fields)

    def profile(grid: Column) -> Column:
        point = lambda x: F.when(x["temp"].isNull(), length(x["depth"]).cast("string")).otherwise(F.to_json(F.struct(length(x["depth"]).alias("d"), degrees(x["temp"]).alias("t"))))
        rate = F.coalesce(F.get(grid, 1)["t"] - F.get(grid, 0)["t"], F.lit(1))
        data = F.array_join(F.transform(F.filter(grid, lambda x: x["depth"].isNotNull()), point), ",")
        return F.concat(F.lit(',"samplerate":'), rate.cast("string"), F.lit(',"sampledata":['), data, F.lit("]"))

    # the profile is spliced in, as its points are numbers or objects
    told = F.transform(F.array(resampled(C("samples"))), profile)[0]
    return F.concat(F.substring(object_, F.lit(1), F.length(object_) - 1), F.when(F.size("samples") > 0, told).otherwise(""), F.lit("}"))
