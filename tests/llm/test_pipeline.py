"""Each stage of the pipeline against a plain form of itself, on what the stage before kept."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from comparing import DATA
from test_bpe import reference
from test_ngram_join import brute

from tallyweave.llm import quality, toxicity
from tallyweave.session import table, written

SF = str(DATA / "sf0.01")


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = written(stage(spark, docs, SF), name)
    return [*out, docs]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[:5])
    assert kept[5].columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"]


def test_classifiers_decide(spark, kept):
    labels = table(spark, SF, "labels")
    good = quality.classify(kept[0], labels, 3, 1)
    assert ids(kept[1]) == ids(good.where("predicted = 1")) and 0 < kept[1].count() < kept[0].count()
    clean = toxicity.classify(kept[1], labels, 5, 0)
    assert ids(kept[2]) == ids(clean.where("predicted = 0")) and 0 < kept[2].count() < kept[1].count()


def test_one_of_each_group(kept):
    rows = [(r["doc_id"], r["text"]) for r in kept[2].collect()]
    assert ids(kept[3]) == sorted(int(c) for k, _, c in brute(rows, 5, 80, 100) if k == c)


def test_mixed_within_epochs(kept):
    before, after = ids(kept[3]), ids(kept[4])
    assert set(after) <= set(before) and max(after.count(i) for i in set(after)) <= 3


def test_token_ids(kept):
    texts = {r["doc_id"]: r["text"] or "" for r in kept[4].collect()}
    coder = reference()
    rows = kept[5].collect()
    assert ids(kept[5]) == ids(kept[4])
    for r in rows:
        expected = np.array(coder.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert hashlib.sha256(bytes(r["token_ids"])).digest() == hashlib.sha256(expected).digest() and r["n_tokens"] == len(expected) // 4


def test_run_is_the_stages(spark, kept):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(kept[5])
