"""N-gram Jaccard join by a token-group matrix, exact, with the components of its links.

Documents become sets of word shingles. The method, as Spark runs it:

1. Equal sets collapse into one *node* (a 64-bit digest of the sorted set; two different sets share
   one with odds of about n^2 / 2^65).
2. Every node publishes a *prefix* of its set under one order of all shingles: those seldom seen
   first. Two sets that link share a shingle of their prefixes, so nothing else is compared. Shingles
   that many documents share are found beforehand and go to the end of the order; that only changes
   the order, never the result.
3. Nodes are partitioned into *groups*: each joins that of its most frequent shared prefix shingle.
   A shingle of many nodes counts as one of its own for each class of sizes, as sets whose sizes differ
   by more than a link allows needn't meet. The matrix of shingles and groups then tells which node has
   to visit which other group. Large groups are cut into blocks.
4. Each block is looked through once: its members are compared, and the union of their shingles is
   stored. Visitors meet the stored unions first, and only those whose overlap with a union is large
   enough for a link go on to the members of that block; blocks without any aren't opened again.
   In groups of several blocks all members are compared with a common pivot first; what the pivot
   doesn't reach visits the other blocks of its group in the same way, a visit for each.

Links that only confirm a component that is known already aren't looked for, so a group of copies
costs about as many comparisons as it has members, not their square. No pair table is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textscan as ts
from tallyweave.llm.bloom import bloom_filter, maybe_in
from tallyweave.llm.components import connected_components
from tallyweave.session import written

#: At most so many frequent shingles are told to all tasks (8 bytes each).
FREQUENT = 1 << 17
#: Seen in so many rows of one stretch, and in all; counted in prefixes only.
FREQUENT_BATCH, FREQUENT_ALL = 2, 8
#: Prefix shingles of one stretch of rows, about.
STRETCH = 1 << 20
#: Shingles in one bucket of the matrix, about.
BUCKET = 300_000
#: Shingles that so many nodes or fewer publish give pairs; others cells of the matrix.
FEW = 16
#: Rows of one stretch from which a shingle's cells are spread over all buckets.
HOT = 1 << 14
#: Members of a block of a group, and their shingles, about.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Nodes that a task remembers to have published.
DONE = 1 << 18


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of a string column.

    Words are runs of other than ASCII white space, with A-Z lower-cased. With fewer than ``k`` words the
    whole sequence is one shingle; without words the set is empty.
    """
    none = np.zeros(0, np.uint64)
    for first, end, data, offsets in ts.chunks(column):
        data = ts.LOWER[data]
        starts, stops, rows = ts.runs(ts.WORD[data], offsets)
        words = ts.hashes(data, starts, stops)
        found, of = ts.grams(words, rows, k)
        at = np.searchsorted(of, np.arange(end - first + 1))
        word_at = np.searchsorted(rows, np.arange(end - first + 1))
        for i in range(end - first):
            if at[i + 1] > at[i]:
                yield first + i, np.unique(found[at[i] : at[i + 1]])
            elif m := word_at[i + 1] - word_at[i]:
                few = words[word_at[i] : word_at[i + 1]]
                yield first + i, ts.grams(few, np.zeros(m, np.int64), int(m))[0]
            else:
                yield first + i, none


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _least(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n with any that it links with: the ceiling of n * num / den."""
    return -(-n * num // den)


def _prefix(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of a sorted set under the common order, as many as a link can't miss."""
    p = len(s) - _least(len(s), num, den) + 1
    if len(frequent):
        at = np.searchsorted(frequent, s)
        often = frequent[np.minimum(at, len(frequent) - 1)] == s
        if often[:p].any():
            s = np.concatenate([s[~often], s[often]])
    return s[:p]


def _links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: walks each component, looking only at sets not reached yet."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(ids.max() + 1, bool)
    left = np.arange(len(sets))
    out = []

    def flat(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = sizes[of]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return ids[np.repeat(bounds[of] - starts, lengths) + np.arange(lengths.sum())], starts

    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        tokens, starts = flat(left)
        while queue and len(left):
            u = queue.pop()
            own = ids[bounds[u] : bounds[u + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[tokens].astype(np.int64), starts)
            mark[own] = False
            hit = den * both >= num * (sizes[left] + sizes[u] - both)
            if hit.any():
                out += [(u, int(v)) for v in left[hit]]
                queue += left[hit].tolist()
                left = left[~hit]
                if len(left):
                    tokens, starts = flat(left)
    return out


def _roots(n: int, links: list[tuple[int, int]]) -> np.ndarray:
    """Component number of each of n, from the spanning forest that ``_links`` gives."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[top(a)] = top(b)
    return np.array([top(x) for x in range(n)])


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` a sorted array has."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _size_class(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sets of classes more than one apart can't link."""
    if num >= den:
        return n.astype(np.int64)
    return np.floor(np.log(n) / np.log(den / num * (1 + 1e-9))).astype(np.int64)


def _each(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of batches that are sorted by (grp, block, role): (grp, block), role, the named columns, and the set of shingles."""
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        lists = [cols[n].to_pylist() for n in ("grp", "block", "role", *names)]
        for i, (grp, block, role, *more) in enumerate(zip(*lists, strict=True)):
            yield (grp, block), role, more, np.asarray(cols["shingles"][i].values).view(np.uint64)


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("shingles", pa.list_(pa.int64()))])
_FOUND_SHAPE = "kind int, a long, b long, c long, shingles array<long>"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    """Kind 0: a link of nodes; 1: a member that the pivot didn't reach, its group and block; 2: a group's block and the
    union of its shingles; 3: a member, its block's component by one of its nodes, and the group."""
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND.types, strict=True)], schema=_FOUND)


def _look_through(num: int, den: int):
    """Rows of blocks: members have role 0, the pivot of a group of several blocks role 2. ``kept`` says whether the union is needed."""

    def ended(key: tuple, members: list, pivots: list) -> pa.RecordBatch:
        nodes, sets = [m[0] for m in members], [m[2] for m in members]
        inner = _links(sets, num, den)
        out = [(0, nodes[a], nodes[b], None, None) for a, b in inner]
        root = _roots(len(sets), inner)
        for me, s in pivots:
            hit = _hits(s, sets, num, den)
            _, first = np.unique(root[hit], return_index=True)
            out += [(0, me, nodes[i], None, None) for i in hit[first]]
            away = ~np.isin(root, root[hit])
            out += [(1, nodes[i], *key, None) for i in np.flatnonzero(away)]
        if members[0][1]:
            out.append((2, *key, None, np.unique(np.concatenate(sets)).view(np.int64)))
            out += [(3, n, nodes[r], key[0], None) for n, r in zip(nodes, root, strict=True)]
        return _found(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, pivots = None, [], []
        for key, role, (node, kept), s in _each(batches, ("node", "kept")):
            if key != now:
                if members:
                    yield ended(now, members, pivots)
                now, members, pivots = key, [], []
            if role == 0:
                members.append((node, kept, s))
            else:
                pivots.append((node, s))
        if members:
            yield ended(now, members, pivots)

    return work


def _hits(s: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of ``sets`` link with ``s``."""
    sizes = np.array([len(x) for x in sets])
    both = np.add.reduceat(_within(np.concatenate(sets), s).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return np.flatnonzero(den * both >= num * (sizes + len(s) - both))


def _bounded(num: int, den: int):
    """Rows of blocks: the union has role 0, visitors role 1. Gives the visitors whose overlap with the union allows a link; holds one union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, union, out = None, None, []
        for key, role, (node,), s in _each(batches, ("node",)):
            if role == 0:
                now, union = key, s
            elif key == now and int(_within(s, union).sum()) >= _least(len(s), num, den):
                out.append((*key, node))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["grp", "block", "node"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["grp", "block", "node"])

    return work


def _opened(num: int, den: int):
    """Rows of blocks: members have role 0 and their component in ``root``, visitors role 1. A visitor links once with each component that it reaches; holds one block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, roots, sets, index, out = None, [], [], None, []
        for key, role, (node, root), s in _each(batches, ("node", "root")):
            if key != now:
                now, roots, sets, index = key, [], [], None
            if role == 0:
                roots.append((root, node))
                sets.append(s)
                continue
            if not sets:
                continue
            if index is None:
                sizes = np.array([len(x) for x in sets])
                union, ids = np.unique(np.concatenate(sets), return_inverse=True)
                index = sizes, union, ids, np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array([r for r, _ in roots]), np.zeros(len(union) + 1, bool)
            sizes, union, ids, starts, root_of, mark = index
            at = np.minimum(np.searchsorted(union, s), len(union) - 1)
            known = at[union[at] == s]
            mark[known] = True
            both = np.add.reduceat(mark[ids].astype(np.int64), starts)
            mark[known] = False
            hit = np.flatnonzero(den * both >= num * (sizes + len(s) - both))
            _, first = np.unique(root_of[hit], return_index=True)
            out += [(0, node, roots[i][1], None, None) for i in hit[first]]
            if len(out) >= 10_000:
                yield _found(out)
                out = []
        if out:
            yield _found(out)

    return work


def similar_components(docs: DataFrame, k: int, num: int, den: int, key: str = "doc_id", text: str = "text", also_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: the key, n_shingles, component_id.

    Two documents link when ``den`` * intersection >= ``num`` * union of their sets of ``k``-word shingles
    (see :func:`shingle_sets`); component_id is the least key reachable by links, the own one included.
    Null or empty texts have an empty set, link with nothing and keep their own key. Rows with a null key
    take part (their text can connect others) and get the least non-null key of their component, else null.
    Rows that repeat a key are handled one by one. No rows give no rows. Other columns aren't read.
    With ``also_text`` a hash of the text comes along as ``_text``.
    """
    spark = docs.sparkSession
    ts.bounded_batches(spark)
    # the key of a text to fetch later: null keys fall back on the text itself
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(key).cast("long"), F.xxhash64(F.col(text))).alias("pick"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("said", F.xxhash64(F.coalesce("text", F.lit(""))) if also_text else F.lit(None).cast("long"))

    def first_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def often_here() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n >= FREQUENT_BATCH].view(np.int64), n[n >= FREQUENT_BATCH]
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([1] * len(token), pa.int32()), none, none, pa.array(n, pa.int64()), pa.array(token), none], names=["kind", "doc", "pick", "n", "node", "said"])

        for batch in batches:
            sizes, nodes = [], []
            for _, s in shingle_sets(batch.column(2), k):
                sizes.append(len(s))
                nodes.append(_node(s) if len(s) else None)
                if len(s):
                    held.append(s[: len(s) - _least(len(s), num, den) + 1].copy())
                    count += len(held[-1])
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), batch.column(3)], names=["kind", "doc", "pick", "n", "node", "said"])
            if count >= STRETCH:
                yield often_here()
                held, count = [], 0
        if held:
            yield often_here()

    seen = written(rows.mapInArrow(first_scan, "kind int, doc long, pick long, n long, node long, said long"), "ngram-rows")
    own = seen.where("kind = 0").select("doc", "pick", "n", "node", "said")
    often = seen.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_ALL)
    often = often.orderBy(F.desc("n"), "node").limit(FREQUENT).collect()
    frequent, hot = (np.sort(np.array([r["node"] for r in often if r["n"] >= least], np.int64).view(np.uint64)) for least in (0, HOT))
    told, hot = spark.sparkContext.broadcast(frequent), spark.sparkContext.broadcast(hot)
    total = own.agg(F.sum("n")).first()[0] or 0
    buckets = max(12, int(total * (den - num) / den / BUCKET) + 1)

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefix shingles and their nodes, packed for each bucket; of equal sets one counts. A hot shingle's nodes go to all buckets."""
        tokens, nodes, sizes, count, done = [], [], [], 0, set()

        def packed() -> pa.RecordBatch:
            token, node, size = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes)
            spread = np.where(_within(token, hot.value), ts.mix(token + node.view(np.uint64)), token)
            where = (spread >> np.uint64(20)) % np.uint64(buckets)
            order = np.lexsort((node, where))
            at = np.searchsorted(where[order], np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(at))
            columns = [pa.array([x[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()) for x in (token[order], node[order], size[order])]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *columns], names=["bucket", "tokens", "nodes", "sizes"])

        for batch in batches:
            for _, s in shingle_sets(batch.column(2), k):
                if len(s) and (node := _node(s)) not in done:
                    if len(done) >= DONE:
                        done.clear()
                    done.add(node)
                    p = _prefix(s, told.value, num, den)
                    tokens.append(p.copy())
                    nodes.append(np.full(len(p), node, np.int64))
                    sizes.append(np.full(len(p), len(s), np.int32))
                    count += len(p)
            if count >= STRETCH:
                yield packed()
                tokens, nodes, sizes, count = [], [], [], 0
        if tokens:
            yield packed()

    def shared(frame: pa.Table) -> pa.Table:
        """What nodes of fitting sizes share in a bucket: pairs (kind 0) for shingles of few nodes, else cells: kind 1 under
        the shingle and the set's own class of sizes, kind 2 under the next."""
        token = np.frombuffer(b"".join(frame.column("tokens").to_pylist()), np.uint64).view(np.int64)
        node = np.frombuffer(b"".join(frame.column("nodes").to_pylist()), np.int64)
        n = np.frombuffer(b"".join(frame.column("sizes").to_pylist()), np.int32).astype(np.int64)
        order = np.lexsort((node, n, token))
        token, node, n = token[order], node[order], n[order]
        keep = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, node, n = token[keep], node[keep], n[keep]
        near = (token[1:] == token[:-1]) & (num * n[1:] <= den * n[:-1])
        keep = np.concatenate([[False], near]) | np.concatenate([near, [False]])
        often = _within(token.view(np.uint64), hot.value)  # whose other nodes are in other buckets
        keep |= often
        token, node, n, often = token[keep], node[keep], n[keep], often[keep]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))[: len(token)]
        count = np.diff(np.concatenate([start, [len(token)]]))
        wide = np.repeat(count > FEW, count) | often
        size = _size_class(n[wide], num, den).view(np.uint64)
        none = np.zeros(wide.sum(), np.int64)
        out = []
        for kind in (1, 2):
            name = ts.mix(token[wide].view(np.uint64) + (size + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
            out.append((np.full(len(none), kind, np.int32), name, node[wide], none, n[wide]))
        token, node, n = token[~wide], node[~wide], n[~wide]
        for step in range(1, FEW):
            i = np.flatnonzero((token[step:] == token[:-step]) & (num * n[step:] <= den * n[:-step]))
            if not len(i):
                break
            j = i + step
            first = np.where(node[i] < node[j], i, j)
            last = i + j - first
            out.append((np.zeros(len(i), np.int32), node[first], node[last], n[first], n[last]))
        return pa.table(dict(zip(["kind", "a", "b", "na", "nb"], (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    shape = "kind int, a long, b long, na long, nb long"
    raw = written(rows.mapInArrow(publish, "bucket long, tokens binary, nodes binary, sizes binary").groupBy("bucket").applyInArrow(shared, shape), "ngram-shared")
    cells = raw.where("kind in (1, 2)").select("kind", F.col("a").alias("token"), F.col("b").alias("node"), F.col("nb").alias("n"))
    # whichever of two prefixes ends first has all that it shares with the other set in both, so a pair that links has
    # at least so many shingles of the prefixes in common: overlap needed - least overlap of the larger set + 1
    loose = cells.where("kind = 1").groupBy("node").agg(F.count("*").alias("more"))
    pairs = raw.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("common"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    pairs = pairs.join(loose.select(F.col("node").alias("a"), F.col("more").alias("ma")), "a", "left").join(loose.select(F.col("node").alias("b"), F.col("more").alias("mb")), "b", "left")
    overlap, large = f"({num} * (na + nb) + {num + den - 1}) div {num + den}", f"({num} * greatest(na, nb) + {den - 1}) div {den}"
    pairs = pairs.where(f"common + least(coalesce(ma, 0), coalesce(mb, 0)) >= {overlap} - {large} + 1")
    ends = pairs.select(F.xxhash64("a", "b").alias("token"), F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("na").alias("n")), F.struct(F.col("b").alias("node"), F.col("nb").alias("n")))).alias("e"))
    counted = written(cells.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "ngram-frequencies")
    ends = ends.select("token", "e.node", "e.n", F.lit(2).cast("long").alias("df"))
    matrix = written(ends.unionByName(cells.drop("kind").join(counted, "token")), "ngram-matrix")
    chosen = matrix.groupBy("node").agg(F.max(F.struct("df", "token")).alias("g"), F.max("n").alias("n")).select("node", "n", F.col("g.token").alias("grp"))
    sized = chosen.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("node").alias("pivot"))
    blocks = F.greatest(F.expr(f"(size + {BLOCK} - 1) div {BLOCK}"), F.expr(f"(shingles + {BLOCK_SHINGLES} - 1) div {BLOCK_SHINGLES}"))
    grouped = written(chosen.join(sized, "grp").withColumn("blocks", blocks).withColumn("block", F.expr("pmod(xxhash64(node, 3), blocks)")), "ngram-groups")

    # which node visits which other group: a shared shingle, the other group the larger one, and sizes that can link
    cells = matrix.select("token", "node").join(grouped.select("node", "grp", "size", "n"), "node")
    by_group = cells.groupBy("token", "grp", "size").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    crossing = by_group.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1").select("token")
    others = by_group.join(crossing, "token").select("token", F.col("grp").alias("to_grp"), F.col("size").alias("to_size"), "low", "high")
    others = written(others, "ngram-crossing")  # so that Spark can split a shingle's cells among tasks
    fits = f"struct(to_size, to_grp) > struct(size, grp) and {num} * n <= {den} * high and {num} * low <= {den} * n"
    visits = written(cells.join(others, "token").where(fits).select("node", F.col("to_grp").alias("grp")).distinct(), "ngram-visits")

    # members of the groups that have several or are visited
    visited = visits.select("grp").distinct().withColumn("_visited", F.lit(True))
    members = grouped.join(visited, "grp", "left").withColumn("kept", F.col("_visited").isNotNull() | (F.col("blocks") > 1))
    members = written(members.where("size > 1 or kept").select("grp", "block", "blocks", "pivot", "node", "kept"), "ngram-members")
    # their whole sets, made anew from one text each: a filter tells tasks which rows to read, so no text is shuffled
    taking = members.select("node").unionByName(visits.select("node")).distinct()
    rep = own.where("node is not null").groupBy("node").agg(F.min("pick").alias("pick"))
    wanted = written(rep.join(taking, "node", "left_semi"), "ngram-wanted")
    passing = spark.sparkContext.broadcast(bloom_filter(wanted.select("pick"), wanted.count()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe_in(passing.value, batch.column(1).to_numpy())))
            sets = [s for _, s in shingle_sets(batch.column(2), k) if len(s)]
            if sets:
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])

    sets = rows.select("doc", "pick", "text").mapInArrow(whole, "node long, shingles array<long>")
    home = taking.join(members, "node", "left")
    sets = written(sets.join(home, "node").dropDuplicates(["node"]), "ngram-sets")

    def dealt(parts: DataFrame) -> DataFrame:
        return parts.repartition("grp", "block").sortWithinPartitions("grp", "block", "role", "node")

    # each block for itself: links inside, and the unions that visitors will meet
    many = members.where("blocks > 1").select("grp", "block", "pivot").distinct()
    shape = ["grp", "block", "role", "node", "kept", "shingles"]
    parts = sets.where("grp is not null").withColumn("role", F.lit(0)).select(shape)
    pivots = many.join(sets.select(F.col("node").alias("pivot"), "shingles"), "pivot").select("grp", "block", F.lit(2).alias("role"), F.col("pivot").alias("node"), F.lit(True).alias("kept"), "shingles")
    inside = written(dealt(parts.unionByName(pivots)).mapInArrow(_look_through(num, den), _FOUND_SHAPE), "ngram-inside")
    links = inside.where("kind = 0").select("a", "b")
    unions = inside.where("kind = 2").select(F.col("a").alias("grp"), F.col("b").alias("block"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("node"), "shingles")
    known = inside.where("kind = 3").select(F.col("a").alias("node"), F.col("b").alias("root"))
    # visits of other groups, and of the other blocks of the own one where the pivot didn't reach
    homes = members.where("kept").select("grp", "block").distinct()
    away = inside.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("grp"), F.col("c").alias("_own"))
    coming = visits.join(homes, "grp").select("grp", "block", "node").unionByName(away.join(homes, "grp").where("block <> _own").select("grp", "block", "node"))
    visitors = coming.join(sets.select("node", "shingles"), "node").select("grp", "block", F.lit(1).alias("role"), "node", "shingles")
    allowed = written(dealt(unions.unionByName(visitors)).mapInArrow(_bounded(num, den), "grp long, block long, node long"), "ngram-allowed")
    # blocks that have a visitor left are opened
    shape = ["grp", "block", "role", "node", "root", "shingles"]
    opened = sets.where("grp is not null").join(allowed.select("grp", "block").distinct(), ["grp", "block"], "left_semi")
    opened = opened.join(known, "node").withColumn("role", F.lit(0)).select(shape)
    asking = allowed.join(sets.select("node", "shingles"), "node").withColumns({"role": F.lit(1), "root": F.lit(None).cast("long")}).select(shape)
    between = dealt(opened.unionByName(asking)).mapInArrow(_opened(num, den), _FOUND_SHAPE)
    links = links.unionByName(written(between, "ngram-links").where("kind = 0").select("a", "b"))

    roots = connected_components(links)
    placed = own.join(roots, "node", "left").select("doc", "n", "said", F.coalesce("root", "node").alias("root"))
    # written, so that Spark can split the rows of a large component among tasks
    least = written(placed.where("root is not null").groupBy("root").agg(F.min("doc").alias("least")), "ngram-least")
    return placed.join(least, "root", "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"), *([F.col("said").alias("_text")] if also_text else []))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with one document left of each component: that with the least key.

    Rows that repeat the kept key within the component stay. What goes is told by key and text, so a row that shares its
    key with a copy of another document stays if its own text is nobody's copy. A row with a null key goes if its
    component has a key; else it stays. Null and empty texts are copies of nothing. No rows give no rows.
    """
    own, said = F.col(key).cast("long").alias("_k"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_t")
    found = similar_components(docs, k, num, den, key, text, also_text=True)
    gone = found.where(F.col("component_id").isNotNull() & ~F.col(key).eqNullSafe(F.col("component_id"))).select(own, F.col("_text").alias("_t")).distinct()
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), own, said)
    same = marked["_k"].eqNullSafe(gone["_k"]) & (marked["_t"] == gone["_t"])
    return marked.join(gone, same, "left_anti").select("_row.*")
