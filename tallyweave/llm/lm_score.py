"""LM scoring by cross-entropy difference.

Two bigram models, of the target documents and of all documents (the background), are counted over the whole
corpus: every token and every pair of neighbours has its own counts, named by 64-bit hashes. Both have the same
smoothing: bigrams interpolated with unigrams. A document's score is the mean over its tokens of the target's
loss less the background's: the lower, the closer to the target.

Texts are read once. Stretches of documents become *groups*, written as numbered tokens. Each group asks for
every pair, token and history that it holds, once, with its own counts; the questions are dealt by slices of the
hash, summed, and the sums go back to the groups, which score their documents. So nothing is told to all tasks
but three sums, and a pair that every document holds costs one question a group.

Tokens are runs of letters, of digits or of other signs, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textscan as ts
from tallyweave.session import written

#: Token types are not limited.
VOCABULARY = None
#: Bytes of text in a group, about; a longer document is a group of its own.
GROUP = 16 << 20
#: Tokens of the corpus for each slice of the hash, about, and the fewest slices.
SLICE, SLICES = 1 << 18, 16
#: Weight of the bigram model, and what each token is counted more than it was seen.
BIGRAM, ADD = 0.7, 0.5
_ASKED = "slice long, group long, keys binary, n binary, m binary"
_TOLD = "slice long, group long, n binary, m binary, types long, total long, target_total long"
_UNIGRAM, _HISTORY = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each token."""
    starts, ends, rows = ts.runs(ts.KIND[data], offsets)
    return ts.hashes(ts.LOWER[data], starts, ends), rows


def bucket(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair."""
    return ts.mix(before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + token.astype(np.uint64))


def with_history(t: np.ndarray, rows: np.ndarray, start: int) -> np.ndarray:
    """The token before each, ``start`` at the start of a row."""
    before = np.concatenate([[start], t[:-1]])
    before[np.concatenate([[True], rows[1:] != rows[:-1]])] = start
    return before[: len(t)]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in seven bits a byte, the last byte of each below 128."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for i in range(1, 10):
        more = x >= np.uint64(1 << (7 * i))
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        pick = size > i
        out[at[pick] + i] = ((x[pick] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8) | ((size[pick] > i + 1).astype(np.uint8) << 7)
    return out.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    d = np.frombuffer(b, np.uint8)
    ends = np.flatnonzero(d < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    size, out = ends - starts + 1, np.zeros(len(ends), np.uint64)
    for i in range(int(size.max(initial=0))):
        pick = size > i
        out[pick] |= (d[starts[pick] + i] & 127).astype(np.uint64) << np.uint64(7 * i)
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group: keys, numbers of tokens and whether wanted, of each document; tokens by falling count; numbered tokens."""
    held, size, made = [], 0, TaskContext.get().partitionId() << 32

    def ended() -> pa.RecordBatch:
        keys, wanted, h, lengths = zip(*held, strict=True)
        token, code, n = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys = pa.concat_arrays(keys)
        blobs = [pa.array([x], pa.binary()) for x in (packed(np.concatenate(lengths)), np.concatenate(wanted).tobytes(), token[order].tobytes(), packed(place[code]))]
        return pa.RecordBatch.from_arrays([pa.array([made]), pa.array([len(code)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *blobs], names=["group", "n_tokens", "keys", "lengths", "wanted", "tokens", "codes"])

    for batch in batches:
        wanted = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for first, end, data, offsets in ts.chunks(batch.column(1)):
            if held and size + len(data) > GROUP:
                yield ended()
                held, size, made = [], 0, made + 1
            h, rows = tokens(data, offsets)
            held.append((batch.column(0).slice(first, end - first), wanted[first:end], h, np.bincount(rows, minlength=end - first)))
            size += len(data)
    if held:
        yield ended()


class _Group:
    """What a group holds: its distinct pairs, tokens and histories, and their sorted hashes."""

    def __init__(self, lengths: bytes, token: bytes, codes: bytes):
        self.lengths = unpacked(lengths).astype(np.int64)
        token, code = np.frombuffer(token, np.uint64), unpacked(codes).astype(np.int64)
        self.rows, self.size = np.repeat(np.arange(len(self.lengths)), self.lengths), len(token)
        start = len(token)
        before = with_history(code, self.rows, start) if len(code) else code
        pair, self.of = np.unique(before * (start + 1) + code, return_inverse=True)
        self.before, self.token = pair // (start + 1), pair % (start + 1)
        known = np.append(token, np.uint64(0))  # what a row starts with
        # hashes of tokens alone are odd, the others even, so that token types can be counted
        one = np.uint64(1)
        self.hashes = np.concatenate([bucket(known[self.before], known[self.token]) & ~one, ts.mix(token * _UNIGRAM) | one, ts.mix(known * _HISTORY + one) & ~one])
        self.order = np.argsort(self.hashes)

    def counts(self, wanted: np.ndarray | None = None) -> np.ndarray:
        """How often the group has what stands at each of the hashes, in wanted documents or in all."""
        of = self.of if wanted is None else self.of[wanted[self.rows]]
        n = np.bincount(of, minlength=len(self.before))
        sums = [np.bincount(x, n, size).astype(np.int64) for x, size in ((self.token, self.size), (self.before, self.size + 1))]
        return np.concatenate([n, *sums])

    def losses(self, sums: np.ndarray, total: int, types: int) -> np.ndarray:
        """Negative log probability (nats) of each document's tokens, summed, under a model's sums in the order of the sorted hashes."""
        n = np.empty(len(sums))
        n[self.order] = sums
        pair, unigram, history = np.split(n, [len(self.before), len(self.before) + self.size])
        plain = (unigram[self.token] + ADD) / (total + ADD * (types + 1))
        seen = history[self.before]
        weight = np.where(seen > 0, BIGRAM, 0.0)
        loss = -np.log(weight * pair / np.maximum(seen, 1) + (1 - weight) * plain)
        return np.bincount(self.rows, loss[self.of], len(self.lengths))


def _ask(slices: int):
    width = (1 << 64) // slices + 1
    schema = pa.schema([("slice", pa.int64()), ("group", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("m", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, lengths, wanted, token, codes, also in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g = _Group(lengths, token, codes)
                if not len(g.of):
                    continue
                wanted = np.frombuffer(wanted, bool).copy()
                wanted[also or []] = True
                keys, n, m = g.hashes[g.order], g.counts()[g.order], g.counts(wanted)[g.order]
                cut = [*np.searchsorted(keys, np.array([i * width for i in range(slices)], np.uint64)), len(keys)]
                out = []
                for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                    if b > a:
                        steps = np.diff(keys[a:b], prepend=np.uint64(i * width))
                        out.append((i, group, packed(steps), packed(n[a:b]), packed(m[a:b])))
                yield _batch(out, schema)

    return work


def _answer(slices: int):
    width = (1 << 64) // slices + 1
    schema = pa.schema([("slice", pa.int64()), ("group", pa.int64()), ("n", pa.binary()), ("m", pa.binary()), ("types", pa.int64()), ("total", pa.int64()), ("target_total", pa.int64())])

    def ended(now: int, held: list) -> Iterator[pa.RecordBatch]:
        keys = [np.cumsum(unpacked(k)) + np.uint64(now * width) for _, k, _, _ in held]
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        n, m = (np.bincount(of, np.concatenate([unpacked(r[i]) for r in held]), len(key)).astype(np.int64) for i in (2, 3))
        odd = (key & np.uint64(1)).astype(bool)
        yield _batch([(now, None, None, None, int(odd.sum()), int(n[odd].sum()), int(m[odd].sum()))], schema)
        at = 0
        for (group, *_), k in zip(held, keys, strict=True):
            mine = of[at : at + len(k)]
            at += len(k)
            yield _batch([(now, group, packed(n[mine]), packed(m[mine]), None, None, None)], schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums for each group of each slice, of rows sorted by slice; holds one slice at a time."""
        now, held = None, []
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and part != now:
                    yield from ended(now, held)
                    held = []
                now = part
                held.append(row)
        if held:
            yield from ended(now, held)

    return work


def _scored(types: int, totals: tuple[int, int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group and slice: a group's own, then its sums."""
        own, sums = None, []

        def ended() -> pa.RecordBatch:
            keys, lengths, token, codes = own
            g = _Group(lengths.as_py(), token.as_py(), codes.as_py())
            means = []
            for i in range(2):
                told = np.concatenate([unpacked(s[i]) for s in sums]) if sums else np.zeros(len(g.hashes))
                means.append(pa.array(g.losses(told, totals[i], types) / np.maximum(g.lengths, 1), mask=g.lengths == 0))
            return pa.RecordBatch.from_arrays([keys.values, pa.array(g.lengths), means[1], means[0]], names=["key", "n_tokens", "target_loss", "background_loss"])

        for batch in batches:
            for i in range(len(batch)):
                if batch.column(1)[i].as_py() < 0:
                    if own:
                        yield ended()
                    own, sums = [batch.column(c)[i] for c in range(2, 6)], []
                else:
                    sums.append((batch.column(6)[i].as_py(), batch.column(7)[i].as_py()))
        if own:
            yield ended()

    return work


def score(docs: DataFrame, target: Column | DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the key, n_tokens, target_loss, background_loss, score.

    ``target`` is a condition over ``docs``, null counting as false, or a DataFrame with the keys of the target. Losses are means over tokens in nats, and
    score their difference; all three are null for a null or empty text, or one without tokens. Without any
    target document the target's model is the smoothing alone. Repeated rows repeat. The models grow with the
    corpus and are never held in one place: a task holds one group of documents, or one slice of the questions.
    """
    ts.bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    by_key = isinstance(target, DataFrame)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.lit(False) if by_key else F.coalesce(target, F.lit(False)))
    groups = written(rows.mapInArrow(_grouped, f"group long, n_tokens long, keys array<{kind}>, lengths binary, wanted binary, tokens binary, codes binary"), "lm-groups")
    asking = groups.select("group", "lengths", "wanted", "tokens", "codes")
    if by_key:
        wanted = target.select(F.col(key).alias("key")).distinct()
        places = groups.select("group", F.posexplode("keys").alias("place", "key")).join(wanted, "key", "left_semi").groupBy("group").agg(F.collect_list("place").alias("also"))
        asking = asking.join(places.hint("merge"), "group", "left")
    else:
        asking = asking.withColumn("also", F.lit(None).cast("array<int>"))
    slices = max(SLICES, (groups.agg(F.sum("n_tokens")).first()[0] or 0) // SLICE)
    asked = asking.mapInArrow(_ask(slices), _ASKED)
    told = written(asked.repartition("slice").sortWithinPartitions("slice").mapInArrow(_answer(slices), _TOLD), "lm-sums")
    types, *totals = (x or 0 for x in told.agg(F.sum("types"), F.sum("total"), F.sum("target_total")).first())
    own = groups.select("group", F.lit(-1).cast("long").alias("slice"), "keys", "lengths", "tokens", "codes")
    parts = own.unionByName(told.where("group is not null").select("group", "slice", "n", "m"), allowMissingColumns=True)
    out = parts.repartition("group").sortWithinPartitions("group", "slice").mapInArrow(_scored(types, tuple(totals)), f"key {kind}, n_tokens long, target_loss double, background_loss double")
    return out.withColumnRenamed("key", key).withColumn("score", F.col("target_loss") - F.col("background_loss"))
