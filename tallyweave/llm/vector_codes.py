"""Vector code compression: product codes whose codebooks come from exact Lloyd rounds kept in heaps.

Components become whole numbers, vectors are cut into equal parts, and each part position has a codebook. Vectors
are packed in blocks, and a block keeps a heap for each entry: the parts that the entry holds, keyed by how much
nearer it is than the second nearest entry (lower minus upper bound) plus the drift that the entry had when this was
found. An entry's drift grows by its own movement and the largest of the others'. As long as a key is above the
drift, no other entry can have become as near, so a round pops only the parts at or below it and rescans these
exactly; the rest isn't touched. Only changes of sums and counts leave a block. Blocks with their heaps are tables
in the shared folder, so that lost executors cost their tasks only; the driver holds codebooks and drifts.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.hot_keys import joined
from tallyweave.session import removed, shared_path, written

#: Vectors of a block, at most; parts whose distances to all entries are worked out at once.
BLOCK, STRETCH = 32_768, 2_048
#: Bounds are taken this much wider than computed, so that no rounding of a root or a sum can hide a violation.
SLACK = 1e-12
#: Sums leave a block in pieces of so many bits, so that no sum of them overflows.
PIECE = 40
ENTRIES = 256
_STATE = "ids array<long>, labels array<string>, x binary, keys binary, rows binary, sizes binary, changes array<struct<slot:int,at:int,piece:int,v:long>>"
_CHANGE = pa.struct([("slot", pa.int32()), ("at", pa.int32()), ("piece", pa.int32()), ("v", pa.int64())])
_STATE_TYPES = [pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 4, pa.list_(_CHANGE)]
_STATE_NAMES = ["ids", "labels", "x", "keys", "rows", "sizes", "changes"]


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of finite doubles: int64 if all are below 2^62, else Python's whole numbers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * 1024.0)
    if not x.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) * 1024 if abs(v) > 2.0**53 else math.floor(v * 1024.0) for v in x.ravel().tolist()]
    return out


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry, without rounding: as doubles where these hold all sums, else as whole numbers."""
    bound = 4 * x.shape[1] * max(_largest(x), _largest(entries)) ** 2
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object
    x, entries = x.astype(kind), entries.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)


def _roots(d: np.ndarray) -> np.ndarray:
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64))
    return np.array([math.sqrt(v) if v < 2**1000 else math.inf for v in d.tolist()], np.float64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and by how much the second nearest is farther away, at least."""
    best, gap = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for i in range(0, len(x), STRETCH):
        d = squared(x[i : i + STRETCH], entries)
        near = d.argmin(1)
        best[i : i + len(d)] = near
        if d.shape[1] > 1:
            second = np.partition(d, 1, axis=1)[:, 1] if d.dtype != object else np.sort(d, axis=1)[:, 1]
            upper, lower = _roots(d[np.arange(len(d)), near]), _roots(second)
            with np.errstate(invalid="ignore"):
                gap[i : i + len(d)] = np.nan_to_num(lower * (1 - SLACK) - upper * (1 + SLACK), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    return best, gap


def _packed(x: np.ndarray) -> bytes:
    """A letter for the kind of numbers, and the numbers."""
    top = _largest(x)
    for letter, kind, bits in ((b"2", "<i2", 15), (b"4", "<i4", 31), (b"8", "<i8", 63)):
        if top < 1 << bits:
            return letter + x.astype(kind).tobytes()
    return b"t" + ",".join(map(str, x.ravel().tolist())).encode()


def _unpacked(content: bytes, n: int) -> np.ndarray:
    kind, rest = content[:1], memoryview(content)[1:]
    if kind == b"t":
        flat = np.array([int(v) for v in bytes(rest).split(b",")], object)
    else:
        flat = np.frombuffer(rest, f"<i{kind.decode()}").astype(np.int64)
    return flat.reshape(n, -1)


def _changes(x: np.ndarray, position: int, old: np.ndarray | None, new: np.ndarray, k: int) -> list[dict]:
    """What the entries of one position win and lose, as pieces of sums, with the count at -1."""
    sums, counts = np.zeros((k, x.shape[1]), x.dtype), np.zeros(k, np.int64)
    for held, sign in ((old, -1), (new, 1)):
        if held is not None:
            np.add.at(sums, held, x * sign)
            counts += sign * np.bincount(held, minlength=k)
    out = []
    touched = np.flatnonzero((sums != 0).any(1) | (counts != 0))
    for slot, row, count in zip(touched.tolist(), sums[touched].tolist(), counts[touched].tolist(), strict=True):
        for at, value in enumerate([count, *row], -1):
            left, piece, sign = abs(value), 0, -1 if value < 0 else 1
            while left:
                out.append({"slot": position * ENTRIES + slot, "at": at, "piece": piece, "v": sign * (left & ((1 << PIECE) - 1))})
                left, piece = left >> PIECE, piece + 1
    return out


class Heaps:
    """The heaps of a block for one position: of each entry, (key, row of the block), least key first."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    @classmethod
    def scanned(cls, x: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray]:
        """All parts are scanned; also the entry of each."""
        out = cls([[] for _ in entries])
        best = out.push(x, np.arange(len(x)), entries, drift)
        return out, best

    def push(self, x: np.ndarray, rows: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Scan these rows and give each to the heap of its nearest entry."""
        best, gap = nearest(x[rows], entries)
        with np.errstate(invalid="ignore"):
            key = gap + drift[best]
            key -= SLACK * (np.abs(gap) + drift[best])
        key = np.nan_to_num(key, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        for slot, k, row in zip(best.tolist(), key.tolist(), rows.tolist(), strict=True):
            heapq.heappush(self.heaps[slot], (k, row))
        return best

    def violated(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pop the parts whose key is not above their entry's drift: (rows, the entries that held them)."""
        rows, held = [], []
        for slot, (heap, limit) in enumerate(zip(self.heaps, drift.tolist(), strict=True)):
            while heap and heap[0][0] <= limit:
                rows.append(heapq.heappop(heap)[1])
                held.append(slot)
        return np.array(rows, np.int64), np.array(held, np.int64)

    def entries(self, n: int) -> np.ndarray:
        """The entry that holds each row."""
        out = np.zeros(n, np.int64)
        for slot, heap in enumerate(self.heaps):
            out[[row for _, row in heap]] = slot
        return out


def _stored(heaps: list[Heaps]) -> tuple[bytes, bytes, bytes]:
    every = [h for position in heaps for h in position.heaps]
    keys = np.array([k for h in every for k, _ in h], "<f8")
    return keys.tobytes(), np.array([r for h in every for _, r in h], "<i4").tobytes(), np.array([len(h) for h in every], "<i4").tobytes()


def _loaded(keys: bytes, rows: bytes, sizes: bytes, parts: int) -> list[Heaps]:
    keys, rows = np.frombuffer(keys, "<f8").tolist(), np.frombuffer(rows, "<i4").tolist()
    ends = np.cumsum(np.frombuffer(sizes, "<i4")).tolist()
    every = [list(zip(keys[a:b], rows[a:b], strict=True)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    k = len(every) // parts
    return [Heaps(every[p * k : (p + 1) * k]) for p in range(parts)]


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    width = x.shape[1] // parts
    return [x[:, p * width : (p + 1) * width] for p in range(parts)]


def _state(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STATE_TYPES, strict=True)], names=_STATE_NAMES)


def _first(told, parts: int, dim: int, most: int):
    """Blocks of the vectors, with every part scanned."""

    def block(ids: list, labels: list, x: np.ndarray) -> pa.RecordBatch:
        books, drifts = told.value
        x, heaps, changes = whole_numbers(x), [], []
        for p, part in enumerate(_cut(x, parts)):
            own, best = Heaps.scanned(part, books[p], drifts[p])
            heaps.append(own)
            changes += _changes(part, p, None, best, len(books[p]))
        return _state([(ids, labels, _packed(x), *_stored(heaps), changes)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held = [], [], []
        for batch in batches:
            for i in range(0, len(batch), most):
                piece = batch.slice(i, min(most, len(batch) - i))
                if len(ids) + len(piece) > most:
                    yield block(ids, labels, np.concatenate(held))
                    ids, labels, held = [], [], []
                ids += piece.column(0).to_pylist()
                labels += piece.column(1).to_pylist()
                held.append(np.asarray(piece.column(2).flatten(), np.float64).reshape(-1, dim))
        if ids:
            yield block(ids, labels, np.concatenate(held))

    return work


def _moved(x: np.ndarray, heaps: list[Heaps], books: list[np.ndarray], drifts: list[np.ndarray]) -> list[dict]:
    """Pop and rescan what the drifts have violated; the changes of the sums."""
    changes = []
    for p, part in enumerate(_cut(x, len(heaps))):
        rows, old = heaps[p].violated(drifts[p])
        if len(rows):
            new = heaps[p].push(part, rows, books[p], drifts[p])
            other = new != old
            if other.any():
                changes += _changes(part[rows[other]], p, old[other], new[other], len(books[p]))
    return changes


def _next(told, parts: int):
    """Each block after one more assignment."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, drifts = told.value
        for batch in batches:
            for ids, labels, packed, keys, rows, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heaps = _loaded(keys, rows, sizes, parts)
                changes = _moved(_unpacked(packed, len(ids)), heaps, books, drifts)
                yield _state([(ids, labels, packed, *_stored(heaps), changes)])

    return work


def _coded(told, parts: int):
    """The last assignment: codes and errors of the vectors."""
    names = ["id", "label", "code", "error"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, drifts = told.value
        for batch in batches:
            for ids, labels, packed, keys, rows, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, heaps = _unpacked(packed, len(ids)), _loaded(keys, rows, sizes, parts)
                _moved(x, heaps, books, drifts)
                held, error = [h.entries(len(ids)) for h in heaps], np.zeros(len(ids), object)
                for part, slots, book in zip(_cut(x, parts), held, books, strict=True):
                    exact = 4 * part.shape[1] * max(_largest(part), _largest(book)) ** 2 < 2**62
                    off = part.astype(np.int64 if exact else object) - book[slots].astype(np.int64 if exact else object)
                    error = error + (off * off).sum(1)
                hexed = [bytes(c).hex() for c in np.stack(held, axis=1).astype(np.uint8)]
                errors = [int(e) if e < 1 << 63 else None for e in error.tolist()]
                for i in range(0, len(ids), STRETCH):
                    cut = slice(i, i + STRETCH)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[cut], pa.int64()), pa.array(labels[cut], pa.string()), pa.array(hexed[cut]), pa.array(errors[cut], pa.int64())], names=names)

    return work


def _drifted(old: np.ndarray, new: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Drifts after the entries have moved: each grows by its own movement and the largest of the others'."""
    off = new.astype(object) - old.astype(object)
    moved = _roots((off * off).sum(1).astype(object)) * (1 + SLACK)
    if len(moved) < 2:
        return drift
    first, second = np.sort(moved)[[-1, -2]]
    others = np.full(len(moved), first)
    others[moved.argmax()] = second
    return (drift + moved + others) * (1 + SLACK)


@dataclass
class Codes:
    """``rows`` has id, label (as text), code and error; ``books`` the final entries of each position."""

    rows: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all final components by position, entry and place, with commas between."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def _usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def compress(vectors: DataFrame, parts: int = 4, rounds: int = 4, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, block: int = BLOCK) -> Codes:
    """Codes of all vectors after ``rounds`` of Lloyd's method from the vectors of the ``entries`` (at most ENTRIES) smallest keys.

    Components are read as doubles x and become floor(1024 * x). Rows whose vector is null or holds null or
    non-finite components are dropped. Vectors of another length than most have (the longer of two as frequent) and
    empty ones have a null code and error and take no further part; a length that ``parts`` doesn't divide is refused.
    A part goes to its nearest entry, ties to the lower index; then each entry becomes floor(sum / count) of its
    parts, and an unused one stays. Keys that are null come last among the smallest, ties are ordered by their
    vectors; repeated rows count each. An error beyond 63 bits is null. Other columns are not read. All results are
    exact, whatever the blocks.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")).where(_usable(v))
    lengths = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = lengths["d"] if lengths else 0
    none = F.lit(None)
    if not dim:
        return Codes(rows.select("id", "label", none.cast("string").alias("code"), none.cast("long").alias("error")), [])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    even = rows.where(F.size(v) == dim)
    seeds = even.orderBy(F.col("id").asc_nulls_last(), "v").limit(min(entries, ENTRIES)).select("v").toPandas()["v"]
    books = [b.copy() for b in _cut(whole_numbers(np.array([np.asarray(s, np.float64) for s in seeds])), parts)]
    drifts = [np.zeros(len(b)) for b in books]
    sums = [np.zeros((len(b), dim // parts + 1), object) for b in books]  # counts come first
    state, path = None, None
    for _ in range(rounds):
        told = spark.sparkContext.broadcast((books, drifts))
        if state is None:
            made = even.select("id", "label", "v").mapInArrow(_first(told, parts, dim, block), _STATE)
        else:
            made = state.drop("changes").mapInArrow(_next(told, parts), _STATE)
        before, path = path, shared_path(spark, "codes-state")
        state = written(made, "codes-state", path=path)
        if before:
            removed(spark, before)
        # at most ENTRIES times the components of a vector
        changed = state.select(F.explode("changes").alias("c")).groupBy("c.slot", "c.at", "c.piece").agg(F.sum("c.v").alias("v")).collect()
        if not any(r["v"] for r in changed):
            break
        for r in changed:
            sums[r["slot"] // ENTRIES][r["slot"] % ENTRIES, r["at"] + 1] += r["v"] << PIECE * r["piece"]
        moved = [_updated(b, s) for b, s in zip(books, sums, strict=True)]
        drifts = [_drifted(b, m, d) for b, m, d in zip(books, moved, drifts, strict=True)]
        books = moved
    told = spark.sparkContext.broadcast((books, drifts))
    if state is None:  # no rounds: the entries are the seeds
        state = even.select("id", "label", "v").mapInArrow(_first(told, parts, dim, block), _STATE)
    coded = state.drop("changes").mapInArrow(_coded(told, parts), "id long, label string, code string, error long")
    odd = rows.where(F.size(v) != dim).select("id", "label", none.cast("string").alias("code"), none.cast("long").alias("error"))
    return Codes(coded.unionByName(odd), books)


def _updated(book: np.ndarray, sums: np.ndarray) -> np.ndarray:
    out = book.astype(object)
    for i, (count, *total) in enumerate(sums.tolist()):
        if count:
            out[i] = [t // count for t in total]
    return out.astype(np.int64) if _largest(out) < 1 << 62 else out


def restore(codes: Codes, to: str = "approximate") -> DataFrame:
    """The rows of ``codes`` with the vector that each code stands for, as doubles; null where there is no code."""
    told = codes.rows.sparkSession.sparkContext.broadcast(codes.books)

    @F.udf("array<double>", useArrow=True)
    def vector(code):
        return None if code is None else [float(v) / 1024.0 for p, b in enumerate(told.value) for v in b[int(code[2 * p : 2 * p + 2], 16)].tolist()]

    return codes.rows.withColumn(to, vector("code"))


def code_errors(vectors: DataFrame, parts: int = 4, rounds: int = 4, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, block: int = BLOCK) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each row that :func:`compress` keeps.

    ``label_error`` is the error summed over the rows with an equal label, those without a label together; null
    errors count nothing, and a sum beyond 63 bits is null.
    """
    codes = compress(vectors, parts, rounds, key, vector, label, entries, block)
    # null is a label of its own; a hot label's rows stay where they are
    rows = written(codes.rows.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("~"))), "codes")
    sums = written(rows.groupBy("_label").agg(F.count("*").alias("_n"), F.try_sum("error").alias("label_error")), "codes-labels")
    out = joined(rows, sums, "_label", "_n")
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
