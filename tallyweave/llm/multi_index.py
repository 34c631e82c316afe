"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in halves, each quantised on its own by k-means fitted to a bounded sample; a cell is a pair
of centroids, and there are more of them the more vectors there are. For a query, pairs are popped from a heap
in order of summed distance until the cells popped hold the asked share of all vectors; the entries of those
cells are ranked by their exact distance. The share is fitted too: the least that would find RECALL of the
neighbours within the sample, so vectors in clusters open few cells, and those without structure many.

A query is sent to the lists of the first halves that it pops, with the second halves to open there. A list that
holds many entries or that many queries visit is dealt out in blocks. Equal vectors are one entry with their
least ids, so copies cost nothing more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import written

#: Vectors that the index is fitted to, at most; so many of them stand for queries when the share is fitted.
SAMPLE, PROBES = 16_384, 256
#: Entries for each cell, about; centroids of a half, at least and at most (16 sampled vectors for each).
CELL, FEWEST, MOST = 8, 8, SAMPLE // 16
#: Share of the true neighbours within the sample that cells have to hold.
RECALL = 0.97
#: Entries and queries of one block of a list, about.
ENTRY_BLOCK, QUERY_BLOCK = 8_192, 8_192
#: Rows whose distances to all centroids are worked out at once.
STRETCH = 2_048
ROUNDS, SEED = 12, 5


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centroids)
        count = np.bincount(near, minlength=len(centroids))
        total = np.stack([np.bincount(near, c, len(centroids)) for c in x.T], axis=1)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    norms = (centroids**2).sum(1)
    parts = [(norms - 2 * x[i : i + STRETCH] @ centroids.T).argmin(1) for i in range(0, len(x), STRETCH)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _halves(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    cut = max(1, x.shape[1] // 2)
    return _kmeans(x[:, :cut], k), _kmeans(x[:, cut:], k) if x.shape[1] > 1 else np.zeros((1, 0))


def _cells(x: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cut = halves[0].shape[1]
    return _nearest(x[:, :cut], halves[0]), _nearest(x[:, cut:], halves[1]) if halves[1].shape[1] else np.zeros(len(x), np.int64)


def _summed(query: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of a query's halves to the centroids."""
    cut = halves[0].shape[1]
    return ((halves[0] - query[:cut]) ** 2).sum(1), ((halves[1] - query[cut:]) ** 2).sum(1)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def popped(query: np.ndarray, halves: tuple[np.ndarray, np.ndarray], held: np.ndarray, wanted: int) -> dict[int, list[int]]:
    """Cells that hold entries, by first half, in the order in which a heap pops pairs of centroids until ``wanted`` entries are held."""
    a, b = _summed(query, halves)
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[oa].tolist(), b[ob].tolist()
    held = held[np.ix_(oa, ob)].tolist()
    oa, ob = oa.tolist(), ob.tolist()
    heap, got, out = [(sa[0] + sb[0], 0, 0)], 0, {}
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        if held[i][j]:
            got += held[i][j]
            out.setdefault(oa[i], []).append(ob[j])
        if j + 1 < len(sb):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(sa):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


def fitted_share(x: np.ndarray, halves: tuple[np.ndarray, np.ndarray], k: int, recall: float = RECALL) -> float:
    """Share of all vectors in the cells that have to be opened, so that they hold ``recall`` of the true neighbours within a sample."""
    if len(x) <= 2 * k:
        return 1.0
    c1, c2 = _cells(x, halves)
    squares = (x**2).sum(1)
    needed = []
    for i in np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int):
        d = squares - 2 * (x @ x[i])
        d[i] = np.inf
        near = np.argpartition(d, k)[:k]
        a, b = _summed(x[i], halves)
        at = a[c1] + b[c2]
        # what is held by all cells that are popped no later than the neighbour's
        needed.append(np.searchsorted(np.sort(at), at[near], side="right") / len(x))
    return float(min(1.0, np.quantile(np.concatenate(needed), recall)))


def _rerank(k: int, dim: int):
    """Rows sorted by list and block: its entries, sorted by second half, and then the queries that visit it."""
    shape = ["query", "id", "score"]

    def best(query: int, q: np.ndarray, cells: np.ndarray, e: np.ndarray, squares: np.ndarray, starts: np.ndarray, ids: list) -> list[tuple]:
        ranges = [np.arange(starts[c], starts[c + 1]) for c in cells if c + 1 < len(starts) and starts[c + 1] > starts[c]]
        if not ranges:
            return []
        open_ = np.concatenate(ranges)
        rough = squares[open_] - 2 * (e[open_] @ q) + q @ q
        if len(open_) > k + 1:
            edge = np.partition(rough, k)[k]
            open_ = open_[rough <= edge + 1e-9 * (1 + abs(edge) + squares[open_] + q @ q)]
        exact = np.sqrt(((e[open_] - q) ** 2).sum(1))
        found = sorted((float(d), int(x)) for i, d in zip(open_, exact, strict=True) for x in ids[i])
        return [(query, x, d) for d, x in found[: k + 1]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            lists, eb, qb, role, cells, name, ids = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, 6))
            v = _matrix(batch.column(7), dim)
            out = []
            for i, key in enumerate(zip(lists, eb, qb, strict=True)):
                if key != now:
                    now, held, index = key, [], None
                if role[i] == 0:
                    held.append((cells[i][0], v[i], ids[i]))
                    continue
                if index is None and held:
                    c2 = np.array([h[0] for h in held])
                    e = np.stack([h[1] for h in held])
                    index = e, (e**2).sum(1), np.searchsorted(c2, np.arange(c2[-1] + 2)), [h[2] for h in held]
                if index:
                    out += best(name[i], v[i], np.array(cells[i]), *index)
            if out:
                query, x, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(x, pa.int64()), pa.array(d, pa.float64())], names=shape)

    return work


def nearest(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", share: float | None = None) -> DataFrame:
    """(query_id, rank, key, score) of the ``k`` nearest found to each row that ``is_query`` selects.

    ``is_query`` is a Column over ``vectors``; ``share`` the part of all vectors that the cells opened for a query
    hold, 1 giving exact results, None the one that :func:`fitted_share` finds. Distances are Euclidean in double
    precision; ties go to the smaller key. A query is no candidate of its own; with fewer candidates all are
    returned. Rows with a null key, or a vector that is null, empty, zero, or holds null or non-finite components
    take no part, nor do vectors of another length than most have (the longer of two that are as frequent).
    Repeated rows count once. Without usable rows the result is empty. Other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    dim = common["d"]
    rows = written(rows.where(F.size("v") == dim).withColumn("h", F.xxhash64("v")), "ann-rows")

    # equal vectors: one entry, with the least k + 1 ids, which is all that any query can need of them
    ranked = rows.select("v", "h", "id").withColumn("_r", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("_r") <= k + 1)
    entries = ranked.groupBy("h", "v").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("entry", F.col("ids")[0])
    entries = written(entries, "ann-entries")
    total = entries.count()
    sample = entries.select("v", "entry").orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).toPandas()
    x = np.stack(sample.sort_values("entry")["v"].tolist())
    halves = _halves(x, min(MOST, max(FEWEST, int((total / CELL) ** 0.5))))
    share = fitted_share(x, halves, k) if share is None else share
    told = spark.sparkContext.broadcast(halves)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _cells(_matrix(batch.column(0), dim), told.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["v", "ids", "entry", "c1", "c2"])

    index = written(entries.select("v", "ids", "entry").mapInArrow(assign, "v array<double>, ids array<long>, entry long, c1 int, c2 int"), "ann-index")
    held = np.zeros((len(halves[0]), len(halves[1])), np.int64)
    for r in index.groupBy("c1", "c2").count().collect():  # at most MOST squared rows
        held[r["c1"], r["c2"]] = r["count"]
    wanted = min(total, max(k + 1, int(np.ceil(share * total))))
    cells = spark.sparkContext.broadcast(held)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            for i in range(len(x)):
                lists = popped(x[i], told.value, cells.value, wanted)
                n = len(lists)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int32()), pa.array([sorted(c) for c in lists.values()], pa.list_(pa.int32())), batch.column(0).take(pa.array([i] * n)), batch.column(1).take(pa.array([i] * n))],
                    names=["c1", "cells", "query", "v"],
                )

    asked = rows.where("q").groupBy("h", "v").agg(F.min("id").alias("query"))
    visit = written(asked.select("query", "v").repartition("query").mapInArrow(visits, "c1 int, cells array<int>, query long, v array<double>"), "ann-visits")
    # blocks of each list: of its entries, and of the queries that visit it
    size = held.sum(1)
    visitors = {r["c1"]: r["count"] for r in visit.groupBy("c1").count().collect()}  # at most MOST rows
    plan = [(c, max(1, -(-int(size[c]) // ENTRY_BLOCK)), max(1, -(-n // QUERY_BLOCK))) for c, n in visitors.items()]
    blocks = F.broadcast(spark.createDataFrame(plan, "c1 int, e long, n long"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    stored = index.join(blocks, "c1").withColumn("eb", F.expr("pmod(xxhash64(entry), e)")).withColumn("qb", upto("n"))
    stored = stored.select("c1", "eb", "qb", F.lit(0).alias("role"), F.array("c2").alias("cells"), F.lit(None).cast("long").alias("query"), "ids", "v")
    asking = visit.join(blocks, "c1").withColumn("qb", F.expr("pmod(xxhash64(query), n)")).withColumn("eb", upto("e"))
    asking = asking.select("c1", "eb", "qb", F.lit(1).alias("role"), "cells", "query", F.lit(None).cast("array<long>").alias("ids"), "v")
    both = stored.unionByName(asking).repartition("c1", "eb", "qb").sortWithinPartitions("c1", "eb", "qb", "role", F.col("cells")[0])
    found = both.mapInArrow(_rerank(k, dim), "query long, id long, score double")
    best = Window.partitionBy("query").orderBy("score", "id")
    found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    # each row that asks, by the entry of its vector
    askers = rows.where("q").select("id", "h", "v").distinct().join(asked, ["h", "v"]).select(F.col("id").alias("query_id"), "query")
    own = found.join(askers, "query").where("id <> query_id")
    last = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return own.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
