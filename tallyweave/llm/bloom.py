"""A Bloom filter of a column's values, made by Spark and told to all tasks: what it turns away is certainly not among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyweave.llm.textscan import mix

#: Bits for a value, about, and how many of them it sets; bits in all, at most (64 MB): with more values the filter lets more of the others pass.
BITS, HASHES, MOST = 10, 4, 1 << 29
_CHUNK = 19


def _positions(x: np.ndarray, size: int) -> np.ndarray:
    first, step = mix(x), mix(x ^ np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
    return np.concatenate([(first + np.uint64(i) * step) & np.uint64(size - 1) for i in range(HASHES)])


def bloom_filter(values: DataFrame, n: int) -> np.ndarray:
    """The filter's bytes for ``n`` rows, about, of one column of longs; null values are left out."""
    size = 1 << min(MOST.bit_length() - 1, max(_CHUNK, int(n * BITS).bit_length()))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_positions(batch.column(0).drop_null().to_numpy().view(np.uint64), size))
            cut = np.flatnonzero(np.diff(at >> np.uint64(_CHUNK), prepend=np.uint64(2**63)))
            ends = [*cut[1:], len(at)]
            parts = [(at[a:b] & np.uint64((1 << _CHUNK) - 1)).astype(np.uint32) for a, b in zip(cut, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array((at[cut] >> np.uint64(_CHUNK)).astype(np.int64)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "at"])

    def together(frame: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _CHUNK, bool)
        for part in frame.column("at").to_pylist():
            bits[np.frombuffer(part, np.uint32)] = True
        return pa.table({"chunk": frame.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    for r in values.mapInArrow(set_bits, "chunk long, at binary").groupBy("chunk").applyInArrow(together, "chunk long, bits binary").toLocalIterator():
        at = r["chunk"] << (_CHUNK - 3)
        out[at : at + (1 << (_CHUNK - 3))] = np.frombuffer(r["bits"], np.uint8)
    return out


def maybe_in(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which values may be among those of the filter."""
    at = _positions(x.view(np.uint64), len(bits) * 8)
    hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return hit.reshape(HASHES, len(x)).all(0)
