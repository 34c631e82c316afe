import re
from collections import Counter

import numpy as np
from comparing import DATA
from pyspark.sql import functions as F

from tallyweave.llm import lm_score as lm
from tallyweave.llm import textscan as ts
from tallyweave.llm.queries import op10_cross_entropy_difference
from tallyweave.session import table


def hashed(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return lm.tokens(data, np.array([0, len(data)]))[0]


def test_tokens():
    text = "It's 42 Über-cool, isn't it?!"
    found = re.findall(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[!-/:-@\[-`{-~]+", text)
    assert len(hashed(text)) == len(found)
    assert hashed("ABC abc")[0] == hashed("ABC abc")[1] == ts.hashes(np.frombuffer(b"abc", np.uint8), np.array([0]), np.array([3]))[0]


def test_query_against_plain_counts(spark):
    sf = str(DATA / "sf0.001")
    good = {r[0] for r in table(spark, sf, "labels").where("quality = 1").select("doc_id").collect()}
    docs = [(r["doc_id"], hashed(r["text"] or "").tolist()) for r in table(spark, sf, "documents").collect()]
    seen = Counter(h for _, t in docs for h in t)
    known = {h: i + 1 for i, h in enumerate(sorted(sorted(seen, key=lambda h: (-seen[h], np.uint64(h).view(np.int64)))[: lm.VOCABULARY]))}
    start = len(known) + 1
    models = []
    for chosen in (docs, [d for d in docs if d[0] in good]):
        uni, hist, pair = Counter(), Counter(), Counter()
        for _, t in chosen:
            t = [known.get(h, 0) for h in t]
            for a, b in zip([start, *t], t, strict=False):
                uni[b] += 1
                hist[a] += 1
                pair[int(lm.bucket(np.array([a]), np.array([b]))[0])] += 1
        models.append((uni, hist, pair))

    def loss(model, a, b):
        uni, hist, pair = model
        plain = (uni[b] + lm.ADD) / (sum(uni.values()) + lm.ADD * (len(known) + 1))
        both = min(pair[int(lm.bucket(np.array([a]), np.array([b]))[0])], hist[a], uni[b])
        w = lm.BIGRAM if hist[a] else 0.0
        return -np.log(w * both / max(hist[a], 1) + (1 - w) * plain)

    got = {r["doc_id"]: r for r in op10_cross_entropy_difference(spark, sf).collect()}
    assert got.keys() == {k for k, _ in docs}
    for key, t in docs[:12]:
        t = [known.get(h, 0) for h in t][:4000]
        if len(t) == got[key]["n_tokens"]:
            mean = [np.mean([loss(m, a, b) for a, b in zip([start, *t], t, strict=False)]) for m in models]
            assert abs(got[key]["background_loss"] - mean[0]) < 1e-9 and abs(got[key]["target_loss"] - mean[1]) < 1e-9
            assert abs(got[key]["score"] - (mean[1] - mean[0])) < 1e-9


def test_target_like_documents_score_lower(spark):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "zebra quartz flux vortex ") * 5) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(df, (F.col("doc_id") % 2 == 1) & (F.col("doc_id") < 20)).collect()}
    assert max(v for k, v in got.items() if k % 2) < min(v for k, v in got.items() if not k % 2)


def test_odd_rows(odd, nothing):
    rows = lm.score(odd, F.col("doc_id") == 1).collect()
    assert len(rows) == odd.count()
    assert all((r["score"] is None) == (r["n_tokens"] == 0) for r in rows)
    assert lm.score(odd, F.lit(None).cast("boolean")).count() == len(rows)
    assert lm.score(nothing, F.lit(True)).count() == 0


def test_every_type_and_pair_is_counted(spark):
    """More token types than 2^15 and more pairs than 2^20 have counts of their own, over several groups and slices."""
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(60_000)]
    docs = [(i, " ".join(words[j] for j in rng.permutation(60_000)[:30_000])) for i in range(50)]
    found = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), F.col("doc_id") < 10).collect()}
    split = {i: t.split(" ") for i, t in docs}
    for name, chosen in (("background_loss", range(50)), ("target_loss", range(10))):
        uni, hist, pair = Counter(), Counter(), Counter()
        for i in chosen:
            uni.update(split[i])
            hist.update(["", *split[i][:-1]])
            pair.update(zip(["", *split[i][:-1]], split[i], strict=True))
        total, types = sum(uni.values()), len({w for t in split.values() for w in t})
        for i in (0, 7, 33):
            losses = []
            for a, b in zip(["", *split[i][:-1]], split[i], strict=True):
                w = lm.BIGRAM if hist[a] else 0.0
                losses.append(-np.log(w * pair[a, b] / max(hist[a], 1) + (1 - w) * (uni[b] + lm.ADD) / (total + lm.ADD * (types + 1))))
            assert abs(found[i][name] - np.mean(losses)) < 1e-9
