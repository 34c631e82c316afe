import base64
import hashlib

import numpy as np
import public_tokenizers as public
import tiktoken
from comparing import DATA
from pyspark.sql import functions as F

from tallyweave.llm import bpe
from tallyweave.llm.queries import op1_byte_bpe

RANKS = public.path("byte_bpe_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(text):
    ids = reference().encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_matches_the_library(spark):
    found = {r["doc_id"]: tuple(r)[1:4] for r in op1_byte_bpe(spark, str(DATA / "sf0.01")).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).collect()}
    coder = reference()
    assert found.keys() == texts.keys()
    for key, text in texts.items():
        ids = coder.encode_ordinary(text or "")
        assert found[key] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_odd_texts(odd, nothing):
    rows = [tuple(r)[:4] for r in bpe.round_trip(odd, RANKS, public.PATTERN).collect()]
    assert sorted(rows, key=str) == sorted(((r["doc_id"], *expected(r["text"])) for r in odd.select("doc_id", "text").collect()), key=str)
    assert bpe.round_trip(nothing, RANKS, public.PATTERN).count() == 0


def test_hard_pieces():
    coder = bpe.ByteBpe(bpe.read_ranks(open(RANKS, "rb").read()), public.PATTERN)
    texts = ["   leading", "a\x1c\x1db", "it's we'LL", " wide　space", "x" * 5000, "\n\n\n \n", "<|endoftext|>", "é́", "\x85next", "12345 67", "!!!???", "​﻿", "ſ'ſ"]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == reference().encode_ordinary(text)
        assert coder.decode(got).decode() == text


def test_encode_keeps_columns_and_decodes(odd):
    back = bpe.decode(bpe.encode(odd, RANKS, public.PATTERN), RANKS)
    assert back.columns == [*odd.columns, "token_ids", "decoded"]
    assert back.where(F.coalesce("text", F.lit("")).cast("binary") != F.col("decoded")).count() == 0
