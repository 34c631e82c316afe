import os
import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from comparing import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import textscan, token_files
from tallyweave.llm.queries import op11_token_files

FILE = public.path("byte_bpe_50k.json")
HARD = ["   leading", "a\x1c\x1d b", "it's we'LL", " wide　 space", "x" * 5000, "\n\n\n \n", "<|endoftext|> a<|endoftext|>", "é́ é à la", "\x85 next\x85", "nbsp\xa0 \xa0x", "12345 67", "! ?\t!", "​ ﻿", "tail  ", "", " ", None, "\x7f a", "÷ × ÿ\n", "日本 語   x"]


@pytest.fixture(scope="module")
def model():
    out = Tokenizer.from_file(FILE)
    out.encode_special_tokens = True
    return out


def whole(model, text):
    return model.encode(text or "", add_special_tokens=False).ids


def expected(model, rows):
    """Rows of (doc_id, text) in the order of the files."""
    out, start = [], 0
    for key, text in rows:
        ids = [*whole(model, text), 0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, model):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).select("doc_id", "text").orderBy("doc_id").collect()
    found = sorted(tuple(r) for r in op11_token_files(spark, str(DATA / "sf0.01")).collect())
    assert found == expected(model, docs)


def test_pieces_are_whole_texts(model):
    coder = token_files.PieceEncoder(open(FILE, encoding="utf-8").read())
    texts = [*HARD, "".join(t or "" for t in HARD) * 3, " ".join(HARD[:4])]
    for _ in range(2):
        for text, ids in zip(texts, coder.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == whole(model, text), text


def test_long_texts_and_colliding_hashes(model, monkeypatch):
    """Stretches, a store that starts anew, and hashes that tell nothing: pieces are still compared byte by byte."""
    monkeypatch.setattr(token_files, "KEPT", 2_000)
    rng = np.random.default_rng(2)
    words = [f"w{i}" * (1 + i % 3) for i in range(400)]
    texts = [" ".join(rng.choice(words, 3_000)) for _ in range(3)]
    coder = token_files.PieceEncoder(open(FILE, encoding="utf-8").read())
    monkeypatch.setattr(token_files, "CHUNK", 1_000)
    assert [i.tolist() for i in coder.encode(pa.array(texts))] == [whole(model, t) for t in texts]
    real = textscan.hashes
    monkeypatch.setattr(token_files, "hashes", lambda *a: real(*a) % np.uint64(50))
    coder.forget()
    assert [i.tolist() for i in coder.encode(pa.array(texts))] == [whole(model, t) for t in texts]


def test_odd_documents(spark, odd, nothing, model):
    docs = odd.withColumn("ids", F.lit("x")).withColumn("_hash", F.lit(1)).withColumn("key", F.lit(2))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()]
    got = token_files.write_and_read(docs, FILE, length=16).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(model, rows)
    assert token_files.write_and_read(nothing, FILE).count() == 0


def test_files_hold_equal_sequences(spark, model, tmp_path):
    """Sequences and masks are views into the mapped file, shards end between documents, and what isn't in the manifest isn't read."""
    rows = [(i, f"document {i} " + "word " * (i % 50)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = token_files.write_ids(token_files.encode(token_files.in_order(docs), FILE), f"file://{tmp_path}/out", length=32, vocabulary=50_257, batch=4)
    told = token_files.manifest(path)
    wanted = [x for _, t in rows for x in [*whole(model, t), 0]]
    assert told["tokens"] == len(wanted)
    stream = []
    for shard in told["shards"]:
        assert len(stream) == shard["start"]
        s = token_files.Sequences(f"{tmp_path}/out/ids-{shard['name']}.arrow")
        assert len(s) == shard["sequences"] == -(-shard["tokens"] // 32)
        for i in range(len(s)):
            ids, mask = s[i]
            assert len(ids) == len(mask) == 32 and ids.dtype == np.uint16 and not ids.flags.owndata
            assert mask.all() or i == len(s) - 1
            stream += ids[mask == 1].tolist()
        assert s[0][0].__array_interface__["data"][0] != s[len(s) - 1][0].__array_interface__["data"][0] or len(s) == 1
    assert stream == wanted
    (tmp_path / "out/ids-000000-0000-999.arrow").write_bytes(b"left by an attempt that failed")
    assert token_files.read_ids(spark, path).count() == 300
    assert sorted(os.listdir(tmp_path / "out"))[0] == token_files.MANIFEST
    with pytest.raises(Exception, match="vocabulary"):
        token_files.write_ids(docs.select("doc_id", F.lit(b"\x00\x00\x01\x00").alias("ids")), f"file://{tmp_path}/bad", vocabulary=100)


def test_refuses_other_tokenizers(spark, nothing):
    with pytest.raises(ValueError):
        token_files.encode(nothing, public.path("word_bpe_49k.json"))
