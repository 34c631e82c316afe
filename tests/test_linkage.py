"""Greedy assignment on chains of ties, against the plain walk."""

import random

from tallyweave.operators import linkage as lk

SHAPE = "i long, j long, near long, mismatch double, apart double"


def plain(rows):
    i_used, j_used, out = set(), set(), set()
    for i, j, *_ in sorted(rows, key=lambda r: (*r[2:], r[0], r[1])):
        if i not in i_used and j not in j_used:
            i_used.add(i)
            j_used.add(j)
            out.add((i, j))
    return out


def found(spark, rows, **how):
    return sorted(tuple(r) for r in lk.assign(spark.createDataFrame(rows, SHAPE), **how).collect())


def test_chain_and_random_edges(spark):
    chain = [(n, n + d, 0, float(2 * n + d), 0.0) for n in range(60) for d in (0, 1)]
    turned = [(i, j, near, 200.0 - m, a) for i, j, near, m, a in chain]
    rng = random.Random(5)
    mixed = sorted({(rng.randrange(40) + 1000, rng.randrange(40) + 1000) for _ in range(160)})
    mixed = [(i, j, rng.randrange(3), float(rng.randrange(3)), 0.0) for i, j in mixed]
    ties = [(i, j, 0, 0.0, 0.0) for i in range(2000, 2012) for j in range(2000, 2012)]
    rows = turned + mixed + ties
    assert found(spark, rows) == sorted(plain(rows))
    assert found(spark, ties, rounds=1, few=0) == sorted(plain(ties))


def test_empty_and_null_ends(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, 0, 0.0, 0.0), (1, None, 0, 0.0, 0.0), (2, 2, None, None, None)]) == [(2, 2)]


def test_nulls_in_the_order_come_first(spark):
    rows = [(3, 3, 0, 0.0, 0.0), (3, 1, 0, 1.0, 0.0), (1, 1, 1, None, 0.0), (1, 2, 1, 1.0, 0.0)]
    assert found(spark, rows, rounds=1) == found(spark, rows, rounds=1, few=0) == [(1, 1), (3, 3)]
