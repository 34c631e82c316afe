"""Vectorised scanning of Arrow string columns: runs of bytes, and 64-bit hashes of the runs.

Works on the UTF-8 buffer of a whole batch at once, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text handled at once; a longer single document is handled alone.
CHUNK = 1 << 19
#: Bytes of an Arrow batch, about; a longer single row is a batch of its own.
BATCH = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let texts go to Python in batches of BATCH bytes, unless the session asks for less.

    Spark counts rows by default, and 10,000 long texts would be held by the executor and its workers at once.
    """
    if int(spark.conf.get(_BATCH_SETTING, None) or 1 << 62) > BATCH:
        spark.conf.set(_BATCH_SETTING, str(BATCH))

_B = np.uint64(0x9E3779B97F4A7C15)
_RND = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("pow", ())) <= n:
        size = max(n + 1, CHUNK + 1)
        base = np.full(size, _B, np.uint64)
        base[0] = 1
        inverse = np.full(size, pow(int(_B), -1, 2**64), np.uint64)
        inverse[0] = 1
        _tables["pow"], _tables["inv"] = np.cumprod(base), np.cumprod(inverse)
    return _tables["pow"], _tables["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash, so that its low and high bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for stretches of rows of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    _, where, content = column.buffers()
    offsets = np.frombuffer(where, kind, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def runs(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest stretches of one non-zero class that stay within a row: starts, ends, row of each."""
    n = len(classes)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(classes[1:], classes[:-1], out=change[1:n])
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = classes[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run, equal for equal bytes wherever they stand."""
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RND[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def lower_ascii() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


LOWER = lower_ascii()
#: 1 for the bytes of words, 0 for ASCII white space.
WORD = np.ones(256, np.uint8)
WORD[[0x20, *range(0x09, 0x0E)]] = 0
#: 0 white space and control, 1 letters and all non-ASCII bytes, 2 digits, 3 other ASCII.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = 3
KIND[0x30:0x3A] = 2
KIND[0x41:0x5B] = KIND[0x61:0x7B] = 1
KIND[0x80:] = 1


def grams(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row that stay within a row, and the row of each."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, rows.dtype)
    m = len(words) - k + 1
    out = np.full(m, k, np.uint64)
    for i in range(k):
        out = out * _B + words[i : i + m]
    same = rows[:m] == rows[k - 1 :]
    return mix(out[same]), rows[:m][same]
