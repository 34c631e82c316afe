import random
import re
from itertools import combinations

import numpy as np
import pytest
from comparing import DATA

from tallyweave.llm import ngram_join
from tallyweave.llm.bloom import bloom_filter, maybe_in
from tallyweave.llm.queries import op7_ngram_jaccard_join


def shingles(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(rows, k, num, den):
    sets = [(key, shingles(text, k)) for key, text in rows]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and den * len(a & b) >= num * len(a | b):
            up[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        t = top(i)
        least[t] = min((x for x in (least.get(t), key) if x is not None), default=None)
    return sorted((str(key), len(s), str(least[top(i)])) for i, (key, s) in enumerate(sets))


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def test_query_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).collect()]
    assert got(op7_ngram_jaccard_join(spark, str(DATA / "sf0.01"))) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize(("num", "block", "hot"), [(85, 4096, 1 << 14), (50, 4096, 20), (70, 3, 1 << 14), (30, 2, 8), (100, 3, 8)])
def test_chains_and_groups(spark, monkeypatch, num, block, hot):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[i // 2 : i // 2 + 24])) for i in range(40)]
    rows += [(100 + i, " ".join([*base[:40], *[f"v{i}_{j}" for j in range(i % 8)]])) for i in range(40)]
    rows += [(200 + i, "same words again and again in each of these rows") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(ngram_join.similar_components(df, 4, num, 100)) == brute(rows, 4, num, 100)


@pytest.mark.parametrize("shingles", [1 << 21, 300])
def test_common_passage_in_texts_of_all_sizes(spark, monkeypatch, shingles):
    """A passage that every text holds, near copies of the passage alone among them, so one shingle has many nodes in many classes of sizes."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(ngram_join, "HOT", 30)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([*passage, *[f"x{i}_{j}" for j in range(rng.randrange(60))]])) for i in range(120)]
    rows += [(200 + i, " ".join([*passage[:i], f"y{i}", *passage[i:]])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for num in (85, 60):
        assert got(ngram_join.similar_components(df, 4, num, 100)) == brute(rows, 4, num, 100)


def test_sizes_that_can_link_are_at_most_one_class_apart():
    n = np.arange(1, 3000)
    for num in (30, 50, 80, 85, 99):
        c = ngram_join._size_class(n, num, 100)
        most = np.minimum(n * 100 // num, n[-1])
        assert (c[most - 1] - c <= 1).all() and (np.diff(c) >= 0).all()


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(ngram_join.similar_components(odd, 4, 85, 100)) == brute(rows, 4, 85, 100)
    assert ngram_join.similar_components(nothing, 4, 85, 100).count() == 0


def test_one_stays_of_each_group(odd):
    kept = ngram_join.keep_one(odd, 5, 80, 100)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, 1, 3, 4, 5, 6, 7, 8, 9}


def test_repeated_and_null_keys(spark):
    """A text that is nobody's copy stays, though its key also names a copy; a copy without a key goes."""
    copy, other = "one two three four five six seven", "this text is like no other text in here"
    rows = [(1, copy), (2, copy), (2, other), (None, copy), (None, "alone without a key and without copies"), (3, None), (3, "")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([rows[0], *rows[2:3], *rows[4:]], "doc_id long, text string").collect()))


def test_bloom_filter_lets_all_its_values_pass(spark):
    inside, outside = np.arange(0, 40_000, 2), np.arange(1, 40_000, 2)
    bits = bloom_filter(spark.createDataFrame([(int(x),) for x in inside] + [(None,)], "x long").repartition(5), len(inside))
    assert maybe_in(bits, inside).all()
    assert maybe_in(bits, outside).mean() < 0.05
    assert not maybe_in(bloom_filter(spark.createDataFrame([], "x long"), 0), outside).any()
