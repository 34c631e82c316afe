import hashlib

import numpy as np
import pytest
from comparing import DATA
from pyspark.sql import functions as F

from tallyweave.llm import edit_fingerprint as ef
from tallyweave.llm import multi_index
from tallyweave.llm.ngram_join import _roots
from tallyweave.llm.queries import op3_multi_index, op4_edit_fingerprint


def test_recall_and_scores(spark):
    sf = str(DATA / "sf0.1")
    data = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in data]), np.array([r[1] for r in data], float)
    found = {}
    for r in op3_multi_index(spark, sf).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {int(i) for i in ids if i % 100 == 0}
    hit = 0
    for q, rows in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in rows)
        hit += len(set(best) & {v for _, v, _ in rows})
    print("recall", hit / (10 * len(found)))
    assert hit / (10 * len(found)) >= 0.9


@pytest.mark.parametrize("block", [8192, 50])
def test_all_cells_opened_give_exact_results(spark, monkeypatch, block):
    """With every cell opened, whatever blocks the lists are dealt in, all pairs decide; a third of the rows is one vector."""
    monkeypatch.setattr(multi_index, "ENTRY_BLOCK", block)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", block // 10)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(400, 6)), np.repeat(rng.normal(size=(1, 6)), 200, axis=0), rng.integers(0, 2, (100, 6)) + 1.0])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in multi_index.nearest(df, F.col("vec_id") % 7 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    ids = np.arange(len(x))
    for q in ids[ids % 7 == 0]:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [int(i) for i in np.lexsort((ids, d)) if i != q][:10]
        assert got[q] == order
    assert set(got) == set(ids[ids % 7 == 0].tolist())


def test_clusters_open_few_cells():
    """The share that is fitted follows the structure of the data."""
    rng = np.random.default_rng(6)
    loose = rng.normal(size=(4000, 16))
    tight = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.01 * rng.normal(size=(4000, 16))
    shares = [multi_index.fitted_share(x, multi_index._halves(x, 16), 10) for x in (loose, tight)]
    assert shares[1] < 0.15 < shares[0] <= 1


def test_pairs_are_popped_in_order_of_distance():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 8))
    halves = multi_index._halves(x, 8)
    c1, c2 = multi_index._cells(x, halves)
    held = np.zeros((8, 8), int)
    np.add.at(held, (c1, c2), 1)
    for q in x[:20]:
        a, b = multi_index._summed(q, halves)
        opened = {(i, j) for i, js in multi_index.popped(q, halves, held, 100).items() for j in js}
        order = sorted(((a[i] + b[j], i, j) for i in range(8) for j in range(8) if held[i, j]))
        least = next(n for n in range(1, 65) if sum(held[i, j] for _, i, j in order[:n]) >= 100)
        assert opened == {(i, j) for _, i, j in order[:least]}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [nan, 1.0, 1.0]), (5, [1.0, None, 2.0]), (6, [inf, 0.0, 0.0]), (7, [1.0, 1.0, 1.0]), (8, [5.0]), (None, [1.0, 1.0, 1.0]), (9, []), (100, [1.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("x"), "h": F.lit(1), "entry": F.lit(2)})
    got = [tuple(r) for r in multi_index.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    far = 2**0.5
    assert [(a, b, c, round(d, 9)) for a, b, c, d in got] == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 7, round(far, 9)), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 7, round(far, 9))]
    assert multi_index.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_edited_texts(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).select("doc_id", "text").collect()
    docs = sorted(docs, key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in op4_edit_fingerprint(spark, str(DATA / "sf0.01")).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for i, r in enumerate(docs):
        t, n = r["text"] or "", docs[(i + 1) % len(docs)]["text"] or ""
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        row = got[r["doc_id"]]
        assert row["n_chars"] == len(t)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["near_edited"] == ef.likeness(row["fingerprint"], row["edited_fingerprint"])
        assert by_text.setdefault(t, row["fingerprint"]) == row["fingerprint"]
    near = np.array([r["near_edited"] for r in got.values()])
    other = np.array([r["near_next"] for r in got.values()])
    print("near edited", near.mean(), "next", other.mean(), "ordered", (near > other).mean())
    assert near.mean() > 0.5 and other.mean() < 0.2 and (near > other).mean() > 0.95
    # classes and components against all pairs
    prints = sorted({r["fingerprint"] for r in got.values()})
    codes = np.array([np.frombuffer(bytes.fromhex(p), np.uint8) for p in prints])
    pairs = [(i, int(j)) for i, x in enumerate(codes) for j in np.flatnonzero((codes[i + 1 :] == x).sum(1) >= 103) + i + 1]
    root = dict(zip(prints, _roots(len(prints), pairs), strict=True))
    own, reached = {}, {}
    for k, r in sorted(got.items()):
        own.setdefault(r["fingerprint"], k)
        reached.setdefault(root[r["fingerprint"]], k)
    assert all(r["class_id"] == own[r["fingerprint"]] and r["component_id"] == reached[root[r["fingerprint"]]] for r in got.values())
    assert len(reached) < len(own) < len(got)


def test_small_edits_keep_most_slots():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefghij klmnop"), 4000))
    changed = text[:1000] + "XYZ" + text[1000:2500] + text[2503:]
    a, b, c = ef.fingerprints([text, changed, "".join(rng.permutation(list(text)))])
    assert ef.likeness(a, b) > 0.7 > 0.3 > ef.likeness(a, c)
    assert ef.fingerprints([text]) == [a]
    assert ef.fingerprints(["", "x"])[0] == "0" * 2 * ef.SLOTS


def test_odd_documents(odd, nothing):
    rows = ef.edit_digests(odd).collect()
    assert len(rows) == odd.count()
    assert ef.edit_digests(nothing).count() == 0
    pairs = ef.similar(odd.where("doc_id is not null")).collect()
    assert all(r["a"] < r["b"] and r["likeness"] >= 0.8 for r in pairs)
    named = ef.components(ef.edit_digests(odd)).collect()
    assert len(named) == len(rows)
    assert all((r["doc_id"] is None) == (r["class_id"] is None) == (r["component_id"] is None) for r in named)
    assert all(r["component_id"] <= r["class_id"] <= r["doc_id"] for r in named if r["doc_id"] is not None)
    assert ef.components(ef.edit_digests(nothing)).count() == 0


@pytest.mark.parametrize("block", [4096, 40])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, block):
    rng = np.random.default_rng(11)

    def other(x, slots):
        y = x.copy()
        y[slots] ^= 1
        return y

    bases = rng.integers(0, 256, (150, ef.SLOTS), dtype=np.uint8)
    prints = [*bases]
    prints += [other(x, np.arange(25) * 5) for x in bases]  # at the threshold, no band of 8 slots intact
    prints += [other(x, rng.choice(ef.SLOTS, 25 + i % 3, replace=False)) for i, x in enumerate(bases)]
    prints += [other(bases[0], rng.choice(ef.SLOTS, 3, replace=False)) for _ in range(300)]
    chain = rng.integers(0, 256, ef.SLOTS, dtype=np.uint8)
    for i in range(60):  # neighbours are alike enough, the ends are not; the first slots are common
        chain = other(chain, 8 + rng.choice(ef.SLOTS - 8, 25, replace=False))
        prints.append(chain)
    prints += [np.concatenate([bases[1][:8], x[8:]]) for x in rng.integers(0, 256, (100, ef.SLOTS), dtype=np.uint8)]
    prints = np.unique(np.array(prints), axis=0)
    rows = [(i, x.tobytes().hex()) for i, x in enumerate(prints)]
    agree = np.array([(prints == x).sum(1) for x in prints])

    def roots(pairs):
        return [frozenset(np.flatnonzero(r == r[i]).tolist()) for r in [_roots(len(prints), pairs)] for i in range(len(prints))]

    monkeypatch.setattr(ef, "classes", lambda docs, key, text: docs)
    monkeypatch.setattr(ef, "BLOCK", block, raising=False)
    got = ef.similar(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()
    assert all(r["a"] < r["b"] and r["likeness"] == agree[r["a"], r["b"]] / ef.SLOTS >= 0.8 for r in got)
    assert len({(r["a"], r["b"]) for r in got}) == len(got)
    every = [(int(a), int(b)) for a, b in np.argwhere(agree >= 103) if a < b]
    print("links", len(got), "of", len(every), "pairs")
    assert roots([(r["a"], r["b"]) for r in got]) == roots(every)
    assert len(got) < len(every) / 4


def test_keys_are_shared_at_every_threshold():
    rng = np.random.default_rng(12)
    for need in (1, 40, 64, 97, 100, 103, 110, 127, 128):
        width, keys = ef._band_keys(need)
        for _ in range(200):
            intact = np.ones(ef.SLOTS, bool)
            intact[rng.choice(ef.SLOTS, ef.SLOTS - need, replace=False)] = False
            whole = intact.reshape(-1, width).all(1)
            assert any(all(whole[b] for b in k) for k in keys)


def test_pairs_at_the_threshold_are_found(spark, monkeypatch):
    rows = []
    for i, x in enumerate(np.random.default_rng(13).integers(0, 256, (20, ef.SLOTS), dtype=np.uint8)):
        y = x.copy()
        y[np.arange(25) * 5] ^= 1  # no eight slots in a row are intact
        rows += [(2 * i, x.tobytes().hex()), (2 * i + 1, y.tobytes().hex())]
    monkeypatch.setattr(ef, "classes", lambda docs, key, text: docs)
    got = ef.similar(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()
    assert sorted(tuple(r) for r in got) == [(2 * i, 2 * i + 1, 103 / ef.SLOTS) for i in range(20)]


def test_components_shuffle_no_copies_of_the_classes(spark):
    """Rows meet the few named fingerprints; nothing is multiplied for the join, and rows of no key, of one text, alone and linked get their ids."""
    one, far = "01" * 128, "fe" * 128
    near = "02" + one[2:]
    rows = [(5, one), (3, one), (None, one), (2, near), (9, far), (7, "7f" * 128)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    out = ef.components(df)
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(tuple, out.select("doc_id", "class_id", "component_id").collect()), key=str) == sorted([(5, 3, 2), (3, 3, 2), (None, None, None), (2, 2, 2), (9, 9, 9), (7, 7, 7)], key=str)
