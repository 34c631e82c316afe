"""Document fingerprints by a randomised edit embedding.

A walk goes over a text's characters; at each step it writes the character it stands on, and a random bit,
shared by all texts and drawn from step and character, tells whether it moves on. Walks over similar texts fall
into step again after an edit, so the written strings differ in few places: edit distance becomes Hamming
distance. A fingerprint samples ``SLOTS`` places of the written string, each the place of least random priority
within the walk's length, so that texts of about equal length sample the same places. It is written as hex, one
byte of character hash per slot. Bands of the slots give candidates, verified by their likeness.

All texts of a batch walk at once: one numpy step moves every text that has not ended.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.bloom import bloom_filter, maybe_in
from tallyweave.llm.components import connected_components
from tallyweave.llm.ngram_join import _roots
from tallyweave.llm.textscan import bounded_batches
from tallyweave.operators.hot_keys import joined
from tallyweave.session import written

SLOTS = 128
#: The random bits repeat after so many steps, and are drawn for so many classes of characters.
PERIOD, CLASSES = 1 << 12, 256
#: Code points that walk at once, about; a longer text walks alone.
PART = 3_000_000
#: With no more texts left than this, each walks on by itself.
ALONE = 24
#: Members of a block of a group of classes.
BLOCK = 4096
#: What opened blocks give.
_LINKS = pa.schema([("kind", pa.int32()), ("grp", pa.int64()), ("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_rng = np.random.default_rng(97)
#: Steps that a walk stands on a character of a class, when it comes there at a step (modulo PERIOD).
_bits = _rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
_bits[:, -1] = 1
_ends = np.where(_bits == 1, np.arange(PERIOD), PERIOD * 2)
STAY = (np.minimum.accumulate(_ends[:, ::-1], axis=1)[:, ::-1] - np.arange(PERIOD) + 1).astype(np.int32).ravel()
_stay = STAY.tolist()
_LETTER = _rng.integers(0, 256, 1 << 16, dtype=np.uint8)


def _places(limit: int) -> list[np.ndarray]:
    """For each slot the steps, rising, that are of least priority up to themselves: a walk of n steps samples the last below n.

    Priorities of step j + 1 beat all before with odds 1 / (j + 1), so the records can be drawn directly.
    """
    out = []
    rng = np.random.default_rng(20_240_608)
    for _ in range(SLOTS):
        at, steps = 0, [0]
        while True:
            # next record after step at: P(none up to n) = (at + 1) / (n + 1)
            at = int(np.ceil((at + 1) / max(rng.random(), 1e-12))) - 1
            at = max(at, steps[-1] + 1)
            if at >= limit:
                break
            steps.append(at)
        out.append(np.array(steps))
    return out


PLACES = _places(1 << 40)


def fingerprints(texts: list[str]) -> list[str]:
    """Hex fingerprints of 2 * SLOTS digits; that of an empty text is all zeros. Equal texts have equal ones."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    size = np.array([len(c) for c in codes])
    out = np.zeros((len(texts), SLOTS), np.uint8)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if len(order):
        flat = np.concatenate([codes[i] for i in order])
        flat = ((flat ^ (flat >> 8) * 31) & 0xFFFF).astype(np.uint16)
        n = size[order]
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        step, now, at = np.empty(len(flat), np.int32), np.zeros(len(n), np.int64), start.copy()
        kind = (flat % CLASSES).astype(np.int32) * np.int32(PERIOD)
        ends = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # texts longer than i
        for i in range(int(n[0])):
            alive = ends[i]
            if alive <= ALONE:
                for k in range(alive):
                    step[at[k] : start[k] + n[k]], now[k] = _alone(kind[at[k] : start[k] + n[k]].tolist(), int(now[k]))
                break
            p, w = at[:alive], now[:alive]
            step[p] = w
            w += STAY[kind[p] + (w & (PERIOD - 1))]
            p += 1
        # which character stands at each sampled step
        wanted = np.stack([s[np.searchsorted(s, now, side="left") - 1] for s in PLACES], axis=1)
        for k in range(len(n)):
            own = step[start[k] : start[k] + n[k]]
            out[order[k]] = 1 + _LETTER[flat[start[k] + np.searchsorted(own, wanted[k], side="right") - 1]] % 255
    return [r.tobytes().hex() for r in out]


def _alone(kinds: list[int], w: int) -> tuple[list[int], int]:
    stay, seen = _stay, []
    for c in kinds:
        seen.append(w)
        w += stay[c + (w & (PERIOD - 1))]
    return seen, w


def likeness(a: str, b: str) -> float:
    """Share of slots that agree, from 0 to 1."""
    return float((np.frombuffer(bytes.fromhex(a), np.uint8) == np.frombuffer(bytes.fromhex(b), np.uint8)).mean())


def in_parts(texts: list[str]) -> list[str]:
    """Fingerprints, with about PART code points walking at once."""
    out, part, size = [], [], 0
    for t in texts:
        if part and size + len(t) > PART:
            out += fingerprints(part)
            part, size = [], 0
        part.append(t)
        size += len(t)
    return out + (fingerprints(part) if part else [])


def fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """Add the column ``to``. Null text counts as empty."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(in_parts(["" if t is None else t for t in texts]), dtype=object)

    return docs.withColumn(to, made(F.col(text)))


def _band_keys(need: int) -> tuple[int, list[tuple[int, ...]]]:
    """Slots in a band, and the choices of bands that serve as keys: fingerprints that agree in ``need`` slots share one for sure.

    As many bands stay intact as there are bands more than slots that differ. Where these are enough, bands are
    put in fewer sections than stay intact, so that two intact ones fall in one section: a key is two bands.
    """
    differ = SLOTS - need
    bands = next((n for n in (32, 64, 128) if n > differ), None)
    if bands is None:
        raise ValueError("least must be above 0")
    sections = min(bands - differ - 1, bands // 2)
    if sections < 4:
        return SLOTS // bands, [(i,) for i in range(bands)]
    return SLOTS // bands, [pair for part in np.array_split(np.arange(bands), sections) for pair in combinations(part.tolist(), 2)]


def _forest(prints: np.ndarray, need: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that agree in ``need`` slots: walks each component, looking only at what isn't reached yet."""
    left, out = np.arange(len(prints)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            hit = (prints[left] == prints[u]).sum(1) >= need
            out += [(u, int(v)) for v in left[hit]]
            queue += left[hit].tolist()
            left = left[~hit]
    return out


def _open_blocks(need: int):
    """Rows sorted by block. Role 0: a member; 1: a visitor; 2: the pivot of a group of several blocks (also a visitor).

    Links have kind 0; members of such a group that the pivot doesn't reach have kind 1.
    """

    def opened(grp: int, block: int, role: np.ndarray, node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        own, names = prints[role == 0], node[role == 0]
        inner = _forest(own, need) if not (role == 1).any() else []  # visitors come to blocks that have been opened before
        out = [(0, grp, block, int(names[a]), int(names[b])) for a, b in inner]
        root, reached = _roots(len(own), inner), np.zeros(len(own), bool)
        for v in np.flatnonzero(role > 0):
            hit = np.flatnonzero((own == prints[v]).sum(1) >= need)
            _, first = np.unique(root[hit], return_index=True)
            out += [(0, grp, block, int(node[v]), int(names[i])) for i in hit[first]]
            reached |= np.isin(root, root[hit])
        if (role == 2).any():
            out += [(1, grp, block, int(n), None) for n in names[~reached]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, _LINKS.types, strict=True)], schema=_LINKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for grp, block, source, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and now != (grp, block, source):
                    yield ended(now, held)
                    held = []
                now = grp, block, source
                held.append(row)
        if held:
            yield ended(now, held)

    def ended(now: tuple, held: list) -> pa.RecordBatch:
        role, node, prints = zip(*held, strict=True)
        return opened(*now[:2], np.array(role), np.array(node), np.frombuffer(b"".join(prints), np.uint8).reshape(-1, SLOTS))

    return work


def similar(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, likeness): links between classes of the texts' fingerprints; see :func:`links`."""
    return links(classes(docs, key, text), least, key)


def links(prints_of: DataFrame, least: float = 0.8, key: str = "doc_id") -> DataFrame:
    """(a, b, likeness): links of fingerprint classes that are alike enough, a < b, from the columns ``key`` and ``fingerprint``.

    A class holds the documents of one fingerprint and is named by its least key.
    Rows with a null key or fingerprint take no part; without rows there are no links. Classes are connected by links just as by all pairs that are alike
    enough, but pairs that only confirm a connection are not all looked for, so near copies cost about as many
    links as there are classes and not their square.

    Classes that share bands (see :func:`_band_keys`) form a group. Large groups are cut into blocks that are
    compared with a common pivot first; what the pivot doesn't reach visits the other blocks.
    """
    return _links(_known(prints_of, key), least)


def _known(prints_of: DataFrame, key: str) -> DataFrame:
    """(print, class, n, fingerprint, node), written: each fingerprint, in half the bytes too, with its least key and how many rows have it."""
    rows = prints_of.where(F.col(key).isNotNull() & F.col("fingerprint").isNotNull())
    found = rows.groupBy(F.unhex("fingerprint").alias("print")).agg(F.min(key).alias("class"), F.count("*").alias("n"))
    known = written(found, "fingerprints")
    hexed = F.lower(F.hex("print"))
    return known.withColumn("fingerprint", hexed).withColumn("node", F.xxhash64(hexed))


def _links(known: DataFrame, least: float) -> DataFrame:
    need = math.ceil(least * SLOTS)
    width, keys = _band_keys(need)
    bits = [F.xxhash64(F.lit(i), *(F.substring("fingerprint", 1 + 2 * width * b, 2 * width) for b in chosen)) for i, chosen in enumerate(keys)]
    cells = _repeated(known.select("node", F.explode(F.array(*bits)).alias("grp")))
    sized = cells.groupBy("grp").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1")
    cut = F.expr(f"(size + {BLOCK} - 1) div {BLOCK}")
    members = written(cells.join(sized, "grp").withColumn("blocks", cut).withColumn("block", F.expr("pmod(hash(node), blocks)")), "fingerprint-groups")
    prints = known.select("node", "print")

    def opened(parts: DataFrame) -> DataFrame:
        order = ["grp", "block", "source"]
        full = parts.join(prints, "node").select(*order, "role", "node", "print")
        return written(full.repartition(*order).sortWithinPartitions(*order, "role", "node").mapInArrow(_open_blocks(need), "kind int, grp long, block long, a long, b long"), "fingerprint-links")

    own = members.select("grp", "block", F.lit(0).cast("long").alias("source"), F.lit(0).alias("role"), "node")
    many = members.where("blocks > 1").select("grp", "block", "pivot").distinct()
    first = opened(own.unionByName(many.select("grp", "block", F.lit(0).cast("long").alias("source"), F.lit(2).alias("role"), F.col("pivot").alias("node"))))
    joined = first.where("kind = 0").select("a", "b")
    left = first.where("kind = 1").select("grp", F.col("block").alias("source"), F.col("a").alias("node"))
    if not left.isEmpty():
        # a block's stragglers visit each other block; no task holds more than two blocks at once
        visits = left.join(many.select("grp", "block"), "grp").where("block <> source").select("grp", "block", "source", F.lit(1).alias("role"), "node")
        homes = own.drop("source").join(visits.select("grp", "block", "source").distinct(), ["grp", "block"])
        joined = joined.unionByName(opened(visits.unionByName(homes)).where("kind = 0").select("a", "b"))
    a, b = (known.select(F.col("node").alias(x), F.col("class").alias(f"class_{x}"), F.col("fingerprint").alias(f"f{x}")) for x in "ab")
    pairs = joined.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(a, "a").join(b, "b")
    same = F.aggregate(F.sequence(F.lit(0), F.lit(SLOTS - 1)), F.lit(0), lambda n, i: n + (F.substring("fa", 2 * i + 1, F.lit(2)) == F.substring("fb", 2 * i + 1, F.lit(2))).cast("int"))
    return pairs.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"), (same / F.lit(float(SLOTS))).alias("likeness"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of each row."""
    return fingerprint(docs.select(F.col(key), F.col(text)), text).select(key, "fingerprint")


def _repeated(cells: DataFrame) -> DataFrame:
    """``cells`` (node, grp) without most of those whose group holds one node only, as nearly all do: one shuffle of bare groups, then a filter of those that come twice."""
    spark = cells.sparkSession
    twice = written(cells.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp"), "fingerprint-twice")
    passing = spark.sparkContext.broadcast(bloom_filter(twice, twice.count()))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(passing.value, batch.column("grp").to_numpy())))

    return cells.mapInArrow(kept, cells.schema)


def components(prints_of: DataFrame, least: float = 0.8, key: str = "doc_id") -> DataFrame:
    """Add ``class_id``, the least key of the same fingerprint, and ``component_id``, the least key reachable by links (itself included).

    ``prints_of`` has ``key`` and ``fingerprint`` and is read twice. Rows with a null key stay, with both null; other
    columns come along.
    """
    known = _known(prints_of, key)
    reached = connected_components(_links(known, least), "a", "b").select(F.col("node").alias("class_id"), "root")
    named = known.select("print", F.col("class").alias("class_id"), "n").join(reached, "class_id", "left")
    # a fingerprint of one row that reaches no other names itself
    named = written(named.where("n > 1 or root <> class_id").select(F.col("print").alias("_print"), "class_id", F.coalesce("root", "class_id").alias("component_id"), "n"), "fingerprint-names")
    return _beside(prints_of, named, key)


def _beside(prints_of: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """The ids of its fingerprint beside each row with a key, its own key for a fingerprint that isn't ``named``.

    Only rows that a filter of the named ones lets pass are shuffled; rows of one text may be a third of all, so they stay where they are and meet a table of the hot ones.
    """
    passing = prints_of.sparkSession.sparkContext.broadcast(bloom_filter(named.select(F.xxhash64("_print")), named.count()))

    @F.pandas_udf("boolean")
    def maybe(x: pd.Series) -> pd.Series:
        return pd.Series(maybe_in(passing.value, x.to_numpy(np.int64)))

    rows = prints_of.withColumn("_print", F.unhex("fingerprint"))
    rows = rows.withColumn("_some", maybe(F.xxhash64("_print")) & F.col(key).isNotNull())
    plain = rows.where(~F.col("_some")).withColumns({"class_id": F.col(key), "component_id": F.col(key)})
    met = joined(rows.where("_some"), named, "_print", "n")
    ids = [F.coalesce(c, key).alias(c) for c in ("class_id", "component_id")]
    return plain.select(*prints_of.columns, "class_id", "component_id").unionByName(met.select(*prints_of.columns, *ids))


def _digest(ids: list, texts: list[str]) -> list[tuple]:
    """A row for each text but the last, which only serves as the next one."""
    edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(texts[:-1], texts[1:], strict=True)]
    own, changed = in_parts(texts), in_parts(edited)
    return [(0, i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f, g, likeness(f, g), likeness(f, h)) for i, t, e, f, g, h in zip(ids, texts[:-1], edited, own, changed, own[1:], strict=False)]


def _frame(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("text", pa.string())]))


def edit_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last third is the start of the next document.

    Documents are ordered by descending key, null keys last, ties by text; after the last comes the first.
    All of the last floor(n / 3) code points go; as many come from the start of the next text, or all of a shorter one. Texts are shuffled
    once, by ranges of the key; each range hands its first text on to the range before it.
    """
    bounded_batches(docs.sparkSession)
    names = ["kind", "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "text"]
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.desc_nulls_last("id")
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order, "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, ids, texts = TaskContext.get().partitionId(), True, [], []
        for batch in batches:
            for i in range(0, len(batch), 1000):
                piece = batch.slice(i, 1000)
                ids += piece.column(0).to_pylist()
                texts += piece.column(1).to_pylist()
                if first and ids:
                    yield _frame([(1, None, None, None, None, None, None, None, part, texts[0])], names)
                    first = False
                if len(ids) > 1:
                    yield _frame([(*r, None, None) for r in _digest(ids[:-1], texts)], names)
                    ids, texts = ids[-1:], texts[-1:]
        if ids:
            yield _frame([(2, ids[0], None, None, None, None, None, None, part, texts[0])], names)

    shape = "kind int, id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, text string"
    done = written(ranged.mapInArrow(walk, shape), "edit-digests")
    # the last text of each range meets the first of the range that follows; one row a range
    heads = done.where("kind = 1").select(F.col("part").alias("to_part"), F.col("text").alias("next"))
    parts = sorted(r[0] for r in heads.select("to_part").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, to_part int")
    ends = done.where("kind = 2").select("id", "text", "part").join(F.broadcast(follows), "part").join(heads, "to_part").select("id", "text", "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                yield _frame([(*r, None, None) for r in _digest([i], [t, n])], names)

    out = done.where("kind = 0").unionByName(ends.mapInArrow(finish, shape))
    return out.select(F.col("id").alias(key), *names[2:8])
