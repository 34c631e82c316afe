"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon has fixed words of four languages, and words and word beginnings that a share of the training
rows shows to be tied to label 1. Features are densities of the lexicon, how near its words stand to the
second person, capitals, punctuation, and obfuscated words. Trees are grown on a second share of the training
rows and calibrated on a third. Scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textscan as ts
from tallyweave.llm.labelled import MAX_TRAIN, free_name, held_out, training_rows

# Abusive words, and words of the second person, in English, German, French and Spanish.
ABUSE = (
    "idiot moron stupid loser pathetic worthless scum trash disgusting clown fool dumb jerk "
    "dumm dummkopf trottel abschaum wertlos widerlich versager "
    "imbécile stupide crétin nul minable ordure dégoûtant "
    "estúpido imbécil inútil basura asqueroso payaso"
).split()
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton tes ta vous votre vos tú ti usted ustedes tuyo".split()

#: Learned terms, at most; each needs so many documents of label 1 and so large a log odds ratio.
TERMS, TERM_DOCS, TERM_ODDS = 4096, 3, 2.0
#: Bytes of the word beginnings that may become terms.
BEGINNINGS = (4, 5, 6)
NEAR = 3
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"0134578@$!", b"oieastbasi", strict=True):
    LEET[_a] = _b


def _hash_words(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data])
    return np.unique(ts.hashes(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], ends[:-1]]), ends))


_ABUSE, _SECOND = _hash_words(ABUSE), _hash_words(SECOND_PERSON)


def _within(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _words(low: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, rows = ts.runs((kinds == 1).view(np.uint8), offsets)
    return starts, ends, rows


def terms(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, which words, hash): kind 0 whole words, else the length of a beginning."""
    yield 0, np.arange(len(starts)), ts.hashes(low, starts, ends)
    for n in BEGINNINGS:
        which = np.flatnonzero(ends - starts > n)
        yield n, which, ts.hashes(low, starts[which], starts[which] + n) ^ np.uint64(n)


FEATURES = 19


def features(column: pa.Array, lexicon: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of FEATURES numbers for each text; an empty text has zeros."""
    out = np.zeros((len(column), FEATURES))
    for first, end, data, offsets in ts.chunks(column):
        n = end - first
        kinds, low = ts.KIND[data], ts.LOWER[data]
        starts, ends, rows = _words(low, offsets, kinds)
        per = lambda w=None, r=rows, n=n: np.bincount(r, w, n)[:n].astype(float)
        count = per()
        words = np.maximum(count, 1)
        size = np.maximum(np.diff(offsets), 1).astype(float)
        x, hit = [], np.zeros(len(starts), bool)
        for kind, which, h in terms(low, starts, ends):
            known, weight = lexicon.get(kind, (np.zeros(0, np.uint64), np.zeros(0)))
            found = _within(h, known)
            if kind == 0:
                abuse, second = _within(h, _ABUSE), _within(h, _SECOND)
                hit |= abuse
            at = which[found]
            value = weight[np.searchsorted(known, h[found])] if len(known) else np.zeros(0)
            got = np.bincount(rows[at], minlength=n)[:n]
            x += [got / words, np.bincount(rows[at], value, n)[:n] / words]
            hit[at] = True
        hits = per(hit.astype(float))
        x += [per(abuse.astype(float)) / words, hits / words, np.log1p(hits)]
        # lexicon words with a second person among the words within NEAR
        so_far = np.concatenate([[0], np.cumsum(second)])
        i = np.flatnonzero(hit)
        lo = np.maximum(i - NEAR, np.searchsorted(rows, rows[i]))
        hi = np.minimum(i + NEAR + 1, np.searchsorted(rows, rows[i], "right"))
        close = i[so_far[hi] > so_far[lo]]
        x.append(np.bincount(rows[close], minlength=n)[:n] / words)
        of = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        letters = np.maximum(of(kinds == 1), 1)
        upper = (data >= 65) & (data <= 90)
        x += [of(upper) / letters, of(kinds == 3) / size, of((data == 33) | (data == 63)) / size]
        # a digit or sign between two letters; and lexicon words that only show once such are read as letters
        inner = np.zeros(len(data), bool)
        if len(data) > 2:
            inner[1:-1] = (LEET[data[1:-1]] != data[1:-1]) & (kinds[:-2] == 1) & (kinds[2:] == 1)
        x.append(of(inner) / words)
        hidden = np.zeros(n)
        if inner.any():
            read = ts.LOWER[np.where(inner, LEET[data], data)]
            s, e, r = ts.runs(((kinds == 1) | inner).view(np.uint8), offsets)
            odd = np.concatenate([[0], np.cumsum(inner)])
            odd = np.flatnonzero(odd[e] > odd[s])
            h = ts.hashes(read, s[odd], e[odd])
            seen = _within(h, _ABUSE) | _within(h, lexicon.get(0, (np.zeros(0, np.uint64),))[0])
            hidden = np.bincount(r[odd][seen], minlength=n)[:n] / words
        x += [hidden, np.log1p(count), per(second.astype(float)) / words]
        out[first:end] = np.stack(x, axis=1) * (count > 0)[:, None]
    return out


@dataclass
class Boosted:
    """Trees of one depth, each a row of split features, cut values and leaf values; steps of the calibration."""

    lexicon: dict = field(default_factory=dict)
    start: float = 0.0
    split: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    leaf: list = field(default_factory=list)
    at: np.ndarray | None = None
    level: np.ndarray | None = None
    flat: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        every = np.arange(len(x))
        for split, cut, leaf in zip(self.split, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[every, split[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        m = self.margin(x)
        return 1 / (1 + np.exp(-m)) if self.at is None else np.interp(m, self.at, self.level)


def _grow(model: Boosted, x: np.ndarray, y: np.ndarray) -> None:
    """Boosting of the log loss, with splits between quantile bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    # beside quantiles of all values those of the non-zero ones, as most texts have none of a feature
    cuts = [np.unique(np.concatenate([k, np.quantile(c[c > 0], np.linspace(0, 1, BINS)[:-1]) * 0.999 if (c > 0).any() else []])) for k, c in zip(cuts, x.T, strict=True)]
    binned = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)], axis=1)
    width = max(len(k) for k in cuts) + 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.start = float(np.log(share / (1 - share)))
    m = np.full(len(y), model.start)
    offset = np.arange(x.shape[1]) * width
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-m))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        split, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for depth in range(DEPTH):
            for k in range(2**depth - 1, 2 ** (depth + 1) - 1):
                i = np.flatnonzero(node == k)
                if len(i) < 8:
                    continue
                flat = (binned[i] + offset).ravel()
                gs = np.bincount(flat, np.repeat(g[i], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                hs = np.bincount(flat, np.repeat(h[i], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                f, b = divmod(int(np.argmax(gain)), width)
                if gain[f, b] > 1e-6 and b < len(cuts[f]):
                    split[k], cut[k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), split[node]] > cut[node])
        node -= 2**DEPTH - 1
        leaf = -RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
        m += leaf[node]
        model.split.append(split)
        model.cut.append(cut)
        model.leaf.append(leaf)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing steps through (x, y): the ends of each step and its level."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        steps.append([b, 1.0, a, a])
        while len(steps) > 1 and (steps[-2][0] >= steps[-1][0] or steps[-2][3] == steps[-1][2]):
            v, w, _, hi = steps.pop()
            u, n, lo, _ = steps.pop()
            steps.append([(u * n + v * w) / (n + w), n + w, lo, hi])
    return np.array([z for s in steps for z in (s[2], s[3])]), np.array([s[0] for s in steps for _ in (0, 1)])


def _learn_terms(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Terms by how much likelier documents of label 1 have them. Of near copies one counts."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            out = []
            for first, _, data, offsets in ts.chunks(batch.column(0)):
                kinds, low = ts.KIND[data], ts.LOWER[data]
                starts, ends, of = _words(low, offsets, kinds)
                if not len(starts):
                    continue
                grams, gram_of = ts.grams(ts.hashes(low, starts, ends), of, 3)
                least = np.full(len(offsets) - 1, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(least, gram_of, grams)
                for kind, which, h in terms(low, starts, ends):
                    row = of[which]
                    order = np.lexsort((h, row))
                    h, row = h[order], row[order]
                    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)]
                    h, row = h[keep], row[keep]
                    out.append((np.full(len(h), kind), h, least[row], y[first + row]))
            if out:
                kind, h, least, label = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(least.view(np.int64)), pa.array(label.astype(np.int32))], names=["kind", "h", "least", "y"])

    one = rows.mapInArrow(distinct, "kind int, h long, least long, y int")
    one = one.groupBy("kind", "h", "y").agg(F.countDistinct("least").alias("n"))
    pos, neg = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0))
    counted = one.groupBy("kind", "h").agg(pos.alias("pos"), neg.alias("neg")).where(F.col("pos") >= TERM_DOCS)
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    odds = F.log((F.col("pos") + 0.5) / (total.get(1, 0) + 1)) - F.log((F.col("neg") + 0.5) / (total.get(0, 0) + 1))
    best = counted.withColumn("odds", odds).where(F.col("odds") >= TERM_ODDS).orderBy(F.desc(F.col("odds") * F.col("pos")), "kind", "h").limit(TERMS).toPandas()
    out = {}
    for kind, part in best.groupby("kind"):
        h = part["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        out[int(kind)] = (h[order], part["odds"].to_numpy()[order])
    return out


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, rest: int = 0, most: int = MAX_TRAIN, key: str = "doc_id", text: str = "text") -> Boosted:
    """Fit on at most ``most`` labelled rows outside the fold ``rest`` of ``parts``.

    By the hash of the id four tenths of them give the lexicon, four grow trees, two calibrate. Without
    labelled rows every score is 0; with one class only, that class.
    """
    ts.bounded_batches(docs.sparkSession)
    model = Boosted()
    rows = training_rows(docs, labels, "toxic", parts, rest, most, key, text)
    model.lexicon = _learn_terms(rows.where("part < 4").select("text", "y"))
    told = docs.sparkSession.sparkContext.broadcast(model.lexicon)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0), told.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "part", "x"])

    found = rows.where("part >= 4").mapInArrow(dense, "y int, part int, x binary").toPandas().sort_values(["part", "x"])
    x = np.frombuffer(b"".join(found["x"]), np.float64).reshape(len(found), FEATURES)
    y, last = found["y"].to_numpy(), found["part"].to_numpy() >= 8
    if len(y) == 0 or y.min() == y.max():
        model.flat = float(y[0]) if len(y) else 0.0
        return model
    if len(set(y[~last])) < 2:
        last[:] = False
    _grow(model, x[~last], y[~last].astype(float))
    if last.sum() >= 20 and len(set(y[last])) == 2:
        model.at, model.level = isotonic(model.margin(x[last]), y[last].astype(float))
    return model


def score(docs: DataFrame, model: Boosted, text: str = "text", to: str = "score") -> DataFrame:
    """Add the column ``to``: how likely toxic is 1, between 0 and 1. Null text counts as empty."""
    ts.bounded_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(part: pa.Array) -> pa.Array:
        return pa.array(told.value.score(features(part, told.value.lexicon)))

    return docs.withColumn(to, scored(F.col(text).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, rest: int = 0, most: int = MAX_TRAIN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the key, held_out, score, predicted (1 from a score of 0.5).

    Null texts are scored as empty ones; null keys count as not held out; repeated rows repeat.
    """
    scored = score(docs.select(F.col(key), F.col(text)), fit(docs, labels, parts, rest, most, key, text), text)
    return scored.select(key, held_out(F.col(key), parts, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **fitted) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their columns."""
    name = free_name("_toxic_score", docs.columns)
    return score(docs, fit(docs, labels, **fitted), to=name).where(F.col(name) < 0.5).drop(name)
