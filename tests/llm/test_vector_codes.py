import hashlib
import math

import numpy as np
import pytest
from comparing import DATA

from tallyweave.llm import vector_codes
from tallyweave.llm.queries import op12_vector_codes, oracle_sql

SHAPE = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=4, rounds=4, most=256):
    """Lloyd's method in Python's own numbers: rows of (vec_id, vector, label), all of one length and in the order of their ids."""
    whole = [[math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in whole] for p in range(parts)]
    books = [c[:most] for c in cut]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book)) for x in own] for own, book in zip(cut, books, strict=True)]

    for _ in range(rounds):
        for p, near in enumerate(assigned()):
            new = []
            for i, e in enumerate(books[p]):
                held = [x for x, (_, at) in zip(cut[p], near, strict=True) if at == i]
                new.append([sum(c) // len(held) for c in zip(*held, strict=True)] if held else e)
            books[p] = new
    last = assigned()
    out = [(rows[i][0], "".join(f"{near[i][1]:02x}" for near in last), sum(near[i][0] for near in last), rows[i][2]) for i in range(len(rows))]
    sums = {}
    for *_, error, label in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(i, code, error, sums[label], digest) for i, code, error, label in out]


def test_query_same_as_sql(same_as_sql):
    same_as_sql(op12_vector_codes, oracle_sql()["op12_vector_codes"], DATA / "sf0.01")


@pytest.mark.parametrize(("n", "scale", "block"), [(300, 0.01, 32_768), (700, 0.2, 64), (120, 0.001, 7), (90, 3e40, 50), (90, 3e6, 50)])
def test_against_plain_rounds(spark, n, scale, block):
    """Ties, repeats, entries without parts, numbers beyond 64 bits, and small blocks."""
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 8)).round(2) * scale
    v[n // 3 : n // 3 + 20] = v[0]
    v[-3:] = np.array([scale, -scale] * 4)
    rows = [(i, x.tolist(), None if i % 4 == 0 else i % 3) for i, x in enumerate(v)]
    found = vector_codes.code_errors(spark.createDataFrame(rows, SHAPE).repartition(5), entries=64, block=block).collect()
    wanted = [(*r[:2], *(x if x is None or x < 1 << 63 else None for x in r[2:4]), r[4]) for r in brute(rows, most=64)]
    if scale < 1e30:
        assert sorted(map(tuple, found)) == wanted
    else:  # errors are beyond 63 bits; where all are null a label's sum is null too
        assert sorted(tuple(r)[:2] for r in found) == [r[:2] for r in wanted] and {r["codebooks_sha256"] for r in found} == {wanted[0][4]}


def test_few_parts_are_popped(spark):
    """Where entries settle, a round leaves most heaps alone."""
    rng = np.random.default_rng(3)
    x = vector_codes.whole_numbers((rng.integers(0, 20, 4000)[:, None] * 1.0 + rng.normal(size=(4000, 4)) * 0.01))
    book = x[:64]
    heaps, held = vector_codes.Heaps.scanned(x, book, np.zeros(64))
    sums = np.zeros((64, 5), object)
    for c in vector_codes._changes(x, 0, None, held, 64):
        sums[c["slot"], c["at"] + 1] += c["v"] << vector_codes.PIECE * c["piece"]
    moved = vector_codes._updated(book, sums)
    drift = vector_codes._drifted(book, moved, np.zeros(64))
    rows, old = heaps.violated(drift)
    assert 0 < len(rows) < 4000
    heaps.push(x, rows, moved, drift)
    assert heaps.entries(4000).tolist() == vector_codes.nearest(x, moved)[0].tolist()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0, 3.0, 4.0], 1), (3, [1.0, 2.0, 3.0, 4.0], None), (None, [0.0, 0.0, 0.0, 0.0], 1), (1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (4, [nan, 1.0, 1.0, 1.0], 1), (5, [inf, 0.0, 0.0, 0.0], 1), (6, [], 1), (7, [1.0, 2.0], None)]
    out = vector_codes.code_errors(spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS id", "'x' AS code", "2 AS _n")).collect()
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out), key=str)
    assert got == sorted([(3, "00000000", 0, 0), (3, "00000000", 0, 0), (None, "02020202", 0, 0), (6, None, None, 0), (7, None, None, 0)], key=str)
    assert vector_codes.code_errors(spark.createDataFrame([], SHAPE)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], SHAPE))


def test_restored_vectors(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist(), 0) for i in range(200)], SHAPE)
    made = vector_codes.compress(df)
    near = {r["id"]: (r["approximate"], r["error"]) for r in vector_codes.restore(made).collect()}
    for r in df.collect():
        approximate, error = near[r["vec_id"]]
        assert sum((math.floor(1024 * a) - round(1024 * b)) ** 2 for a, b in zip(r["embedding"], approximate, strict=True)) == error
