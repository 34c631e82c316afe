"""What the two XML readers share: entities of files by row tag, and lookups within a file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.paths import bound
from tallyweave.sources.contract import opened

#: Bytes of a file read at a time.
STEP = 1 << 20
FOUND = "file string, at long, tag string, id string, xml string"


def entities(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Every element of a tag in the files below a path: ``file``, ``at`` (rises in the order of a file) and ``e``, a struct.

    Files that are no XML, and damaged elements, give rows of nulls, which are left out.
    """
    fields = ", ".join([schema, "_bad string"])
    rows = spark.read.format("xml").option("rowTag", tag).option("columnNameOfCorruptRecord", "_bad").schema(fields).load(path)
    names = [c for c in rows.columns if c != "_bad"]
    out = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.struct(*names).alias("e"), F.col("_bad"))
    return out.where(F.col("_bad").isNull()).drop("_bad")


def found(pieces: Iterator[bytes], tags: set[str], flags: set[tuple[str, str]]) -> Iterator[tuple[int, str, str | None, str]]:
    """(at, tag, id, xml) of every element of ``tags`` in a file, wherever it stands, and (at, child, None, "") for the first child of each (parent, child) of ``flags``.

    Elements up to a file's damage count. One element is held at a time, besides those that it lies in.
    """
    out: list[tuple[int, str, str | None, str]] = []
    open_: list[tuple[str, int, str | None, list[str], int]] = []
    parents, children = {p for p, _ in flags}, {c for _, c in flags}
    watched = tags | parents | children
    depth, within, seen = 0, {}, set()

    def text(x: str) -> None:
        held = escape(x)
        for o in open_:
            o[3].append(held)

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal depth
        depth += 1
        if name in watched:
            watch(name, attributes)
        if open_:
            held = f"<{name}{''.join(f' {k}={quoteattr(v)}' for k, v in attributes.items())}>"
            for o in open_:
                o[3].append(held)

    def watch(name: str, attributes: dict[str, str]) -> None:
        if name in parents:
            within[depth] = name
        if name in children and within.get(depth - 1) and (within[depth - 1], name) in flags - seen:
            seen.add((within[depth - 1], name))
            out.append((parser.CurrentByteIndex, name, None, ""))
        # an element of a tag within one of the same tag is part of that
        if name in tags and all(o[0] != name for o in open_):
            open_.append((name, parser.CurrentByteIndex, attributes.get("id"), [], depth))
            parser.CharacterDataHandler = text

    def end(name: str) -> None:
        nonlocal depth
        if open_:
            for o in open_:
                o[3].append(f"</{name}>")
            if open_[-1][4] == depth:
                tag, place, own, held, _ = open_.pop()
                out.append((place, tag, own and own.strip(), "".join(held)))
                if not open_:
                    parser.CharacterDataHandler = None
        if name in parents:
            within.pop(depth, None)
        depth -= 1

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        for piece in pieces:
            parser.Parse(piece, False)
            yield from out
            out.clear()
        parser.Parse(b"", True)
    except expat.ExpatError:
        pass
    yield from out


def every_entity(spark: SparkSession, path: str, schemas: dict[str, str], flags: set[tuple[str, str]], without: Callable[[], DataFrame]) -> DataFrame:
    """FOUND: the elements of all tags of ``schemas`` in the files below a path, and what ``flags`` asks for, in one pass (see :func:`found`).

    A store that Arrow doesn't know is read by Spark's XML source, once for each tag, and ``without`` gives the rows of ``flags``.
    """
    try:
        opened(path)
    except (pa.ArrowException, OSError):
        rows = [entities(spark, path, tag, s).select("file", "at", F.lit(tag).alias("tag"), (F.col("e._id") if "_id" in s else F.lit(None)).alias("id"), F.to_xml("e", {"rowTag": tag}).alias("xml")) for tag, s in schemas.items()]
        out = without()
        for r in rows:
            out = out.unionByName(r)
        return out
    tags = set(schemas)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, place = opened(file)
                with store.open_input_stream(place, compression=None) as f:
                    rows = []
                    for row in found(iter(lambda: f.read(STEP), b""), tags, flags):  # noqa: B023
                        rows.append((file, *row))
                        if len(rows) >= 1_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    # contents aren't read by this source, as only names are asked for; a partition is as many bytes as Spark would give it
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file")).mapInArrow(work, FOUND)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "at", "tag", "id", "xml"])


def table_of(rows: DataFrame, key: Column, value: Column, to: str) -> DataFrame:
    """(file, ``to``): a map of an entity's key to its value for each file, the first of a key counting; ``<to>_order`` lists the keys in the order of the file."""
    known = rows.select("file", "at", key.alias("k"), value.alias("v")).where("k is not null and k <> ''")
    first = known.groupBy("file", "k").agg(F.min_by("v", "at").alias("v"), F.min("at").alias("at"))
    one = first.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "k", "v"))).alias("x"))
    return one.select("file", F.map_from_entries(F.transform("x", lambda x: F.struct(x["k"], x["v"]))).alias(to), F.transform("x", lambda x: x["k"]).alias(f"{to}_order"))


def get(map_: Column, key: Column) -> Column:
    """The value of a key in a map, null for a null map or key, or one that it lacks."""
    return F.try_element_at(map_, key)


def by_key(pairs: Column, key_kind: str, value_kind: str) -> Column:
    """A map of an array of (k, v), the last of a key counting; pairs without a key or value are left out."""
    known = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())

    def made(known: Column) -> Column:
        keys = F.array_distinct(F.transform(known, lambda p: p["k"]))
        return bound(keys, lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(known, lambda p: p["k"] == k), -1)["v"])))

    return bound(known, made).cast(f"map<{key_kind},{value_kind}>")


def item(array: Column, i: Column) -> Column:
    """The element at a place counted from 0; null beyond the ends."""
    return F.when(i >= 0, F.try_element_at(array, (i + 1).cast("int")))


def listed(c: Column, kind: str) -> Column:
    """An array, empty for null."""
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def standing(values: Column) -> Column:
    """(i, v) of the values of an array that are known and differ from the known one before: a short list, as few values change often."""
    known = F.filter(F.transform(values, lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda x: x["v"].isNotNull())
    return bound(known, lambda known: F.filter(known, lambda x, j: (j == 0) | ~x["v"].eqNullSafe(F.get(known, j - 1)["v"])))


def in_force(changes: Column, i: Column) -> Column:
    """What stands at a place, of a list of :func:`standing`; null before the first."""
    return F.try_element_at(F.filter(changes, lambda x: x["i"] <= i), F.lit(-1))["v"]
