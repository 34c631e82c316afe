"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Tokens are runs of letters, digits or punctuation, besides marks for words in capitals and words that
repeat the one before. Each token owns a sparse random index vector, drawn from its hash; a token's word vector
is the sum of the index vectors around it over *all* documents. The tokens of the training sample that more than
one of its documents has are words of their own; others, of which the fit knows nothing, share SHARED vectors. A
document is the mean and the spread of its word vectors. A network with one hidden layer is fitted in numpy
to a bounded sample of labelled rows, and a temperature fitted to rows set aside calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textscan as ts
from tallyweave.llm.labelled import MAX_TRAIN, free_name, held_out, training_rows

#: Words with vectors of their own, at most, those of most sampled documents; vectors that all others share; length of a vector.
WORDS, SHARED, DIM = 1 << 16, 1 << 13, 32
WINDOW = 2
#: Bytes of text whose word vectors are pooled at once, and whose neighbours are counted at once.
POOL, COUNT = 1 << 18, 1 << 20
#: Steps of the fit, whatever the number of rows, and rows of a step.
HIDDEN, STEPS, ROWS, SEED = 32, 6_000, 128, 11
CAPS, SAME = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def index(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the two entries of each token's index vector are, and their signs."""
    bits = ts.mix(h ^ np.uint64(0x2545F4914F6CDD1D)).astype(np.int64)
    first = bits & (DIM - 1)
    second = (first + 1 + ((bits >> 8) & 0xFFFF) % (DIM - 1)) % DIM
    return np.stack([first, second]), np.stack([1.0 - 2 * ((bits >> 30) & 1), 1.0 - 2 * ((bits >> 31) & 1)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each token in order."""
    kinds = ts.KIND[data]
    starts, ends, rows = ts.runs(kinds, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    h = ts.hashes(ts.LOWER[data], starts, ends)
    word = kinds[starts] == 1
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    plain = np.concatenate([[0], np.cumsum(data < 128)])
    many = upper[ends] - upper[starts]
    caps = word & (many >= 2) & (2 * many > plain[ends] - plain[starts])
    mark = np.zeros(len(h), np.uint64)
    mark[caps] = CAPS
    at = np.flatnonzero(word)
    same = at[1:][(h[at[1:]] == h[at[:-1]]) & (rows[at[1:]] == rows[at[:-1]])]
    mark[same] = SAME
    marked = np.flatnonzero(mark)
    order = np.argsort(np.concatenate([np.arange(len(h)) * 2, marked * 2 + 1]), kind="stable")
    h = np.concatenate([h, ts.mix(mark[marked])])[order]
    return h, np.concatenate([rows, rows[marked]])[order]


def place(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The row of each token: that of its word in a sorted array, else one that it shares."""
    other = (len(words) + (h % np.uint64(SHARED)).astype(np.int64)).astype(np.int64)
    if not len(words):
        return other
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at, other)


def vocabulary(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the tokens that more than one row of the sample has; of more than WORDS those of most rows."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in ts.chunks(batch.column(0)):
                h, of = tokens(data, offsets)
                for i in range(len(offsets) - 1):
                    own = np.unique(h[np.searchsorted(of, i) : np.searchsorted(of, i, "right")])
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["h"])

    counted = rows.select("text").mapInArrow(distinct, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "h").limit(WORDS).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def contexts(docs: DataFrame, words: np.ndarray, text: str = "text") -> np.ndarray:
    """Word vectors over all documents. What tasks have counted is summed by Spark; the driver gets WORDS + SHARED rows at most."""
    names, size = [f"v{i}" for i in range(DIM)], len(words) + SHARED
    told = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size * DIM), np.zeros(size, np.int64)
        for batch in batches:
            for _, _, data, offsets in ts.chunks(batch.column(0), COUNT):
                h, rows = tokens(data, offsets)
                at = place(h, told.value)
                seen += np.bincount(at, minlength=size)
                where, sign = index(h)
                keys, weights = [], []
                for step in range(1, WINDOW + 1):
                    a = np.flatnonzero(rows[step:] == rows[:-step])
                    for one, other in ((a, a + step), (a + step, a)):
                        keys += [at[one] * DIM + where[k, other] for k in range(2)]
                        weights += [sign[k, other] for k in range(2)]
                total += np.bincount(np.concatenate(keys), np.concatenate(weights), size * DIM)
        used = np.flatnonzero(seen)
        for i in range(0, len(used), 10_000):
            part = used[i : i + 10_000]
            vectors = total.reshape(size, DIM)[part].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[part]), *(pa.array(vectors[:, i].copy()) for i in range(DIM))], names=["row", "n", *names])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "row int, n long, " + ", ".join(f"{n} int" for n in names))
    summed = counted.groupBy("row").agg(*(F.sum(n).alias(n) for n in ["n", *names])).toPandas()
    out = np.zeros((size, DIM), np.float32)
    if len(summed):
        v = summed[names].to_numpy(np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)
        out[summed["row"]] = v - np.average(v, axis=0, weights=summed["n"])
    return out


def pooled(column: pa.Array, words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each row, and the log of its number of tokens; zeros for empty rows."""
    out = np.zeros((len(column), 2 * DIM + 1), np.float32)
    for first, end, data, offsets in ts.chunks(column, POOL):
        h, rows = tokens(data, offsets)
        if not len(h):
            continue
        v = vectors[place(h, words)]
        at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        n = np.diff(np.concatenate([at, [len(h)]]))[:, None]
        mean = np.add.reduceat(v, at, axis=0) / n
        spread = np.sqrt(np.maximum(np.add.reduceat(v * v, at, axis=0) / n - mean * mean, 0))
        out[first + rows[at]] = np.hstack([mean, spread, np.log1p(n)])
    return out


@dataclass
class Network:
    """Two layers over standardised inputs, and a temperature; ``flat`` answers where no fit was possible."""

    words: np.ndarray
    vectors: np.ndarray
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0
    flat: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.margin(x.astype(np.float64)) / self.temperature, -30, 30)))


def _fit_network(net: Network, x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> Network:
    """Adam on the log loss; then the temperature that suits the calibration rows best."""
    if len(y) == 0 or y.min() == y.max():
        net.flat = float(y[0]) if len(y) else 1.0
        return net
    train = ~calibration if len(set(y[~calibration])) == 2 else np.ones(len(y), bool)
    xt, yt = x[train].astype(np.float64), y[train].astype(np.float64)
    net.centre, net.scale = xt.mean(0), xt.std(0) + 1e-6
    rng = np.random.default_rng(SEED)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    z = (xt - net.centre) / net.scale
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    while step < STEPS:
        order = rng.permutation(len(z))
        for s in range(0, len(z), ROWS):
            i = order[s : s + ROWS]
            h = z[i] @ p[0] + p[1]
            a = np.maximum(h, 0)
            g = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3][0], -30, 30))) - yt[i]) / len(i)
            gh = np.outer(g, p[2]) * (h > 0)
            grads = [z[i].T @ gh + 1e-4 * p[0], gh.sum(0), a.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            step += 1
            for j, d in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * d
                v[j] = 0.999 * v[j] + 0.001 * d * d
                p[j] = p[j] - 0.003 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if calibration.sum() >= 20:
        margin, yc = net.margin(x[calibration].astype(np.float64)), y[calibration]
        tried = np.geomspace(0.25, 8, 61)
        losses = [np.logaddexp(0, -(2 * yc - 1) * margin / t).mean() for t in tried]
        net.temperature = float(tried[int(np.argmin(losses))])
    return net


def fit(docs: DataFrame, labels: DataFrame, parts: int = 3, rest: int = 1, most: int = MAX_TRAIN, key: str = "doc_id", text: str = "text") -> Network:
    """Fit on at most ``most`` labelled rows outside the fold ``rest`` of ``parts``.

    Word vectors come from all of ``docs``. Without labelled rows every score will be 1; with one class
    only, that class.
    """
    ts.bounded_batches(docs.sparkSession)
    sample = training_rows(docs, labels, "quality", parts, rest, most, key, text)
    words = vocabulary(sample)
    net = Network(words, contexts(docs, words, text))
    told = docs.sparkSession.sparkContext.broadcast((words, net.vectors))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(0), *told.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "part", "x"])

    rows = sample.mapInArrow(features, "y int, part int, x binary").toPandas()
    rows = rows.sort_values(["part", "x"])  # the same fit whatever order tasks end in
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), 2 * DIM + 1)
    return _fit_network(net, x, rows["y"].to_numpy(), rows["part"].to_numpy() >= 8)


def score(docs: DataFrame, net: Network, text: str = "text", to: str = "score") -> DataFrame:
    """Add the column ``to``: how likely quality is 1, between 0 and 1. Null text counts as empty."""
    ts.bounded_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def scored(part: pa.Array) -> pa.Array:
        return pa.array(told.value.score(pooled(part, told.value.words, told.value.vectors)))

    return docs.withColumn(to, scored(F.col(text).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 3, rest: int = 1, most: int = MAX_TRAIN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the key, held_out, score, predicted (1 from a score of 0.5).

    Null texts are scored as empty ones; null keys count as not held out; repeated rows repeat.
    """
    scored = score(docs.select(F.col(key), F.col(text)), fit(docs, labels, parts, rest, most, key, text), text)
    return scored.select(key, held_out(F.col(key), parts, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **fitted) -> DataFrame:
    """The rows of ``docs`` that score at least 0.5, with their columns."""
    name = free_name("_quality_score", docs.columns)
    return score(docs, fit(docs, labels, **fitted), to=name).where(F.col(name) >= 0.5).drop(name)
