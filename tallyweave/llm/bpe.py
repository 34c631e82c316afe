"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

The model is serialised directly as a protocol buffer: one piece for each rank, its bytes mapped
one by one to printable characters, scored by the negative rank, with identity normalisation. As
every merge takes the best-scored neighbouring pair, the leftmost first, this gives the merges of
the rank file. Pre-tokens are encoded one by one; decoding is the inverse mapping of ids to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.textscan import bounded_batches

#: Beyond so many kept pre-tokens a worker starts its store anew.
CACHE = 1 << 16
#: Pre-tokens longer than this many bytes are encoded but not kept.
CACHE_BYTES = 256


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def read_ranks(content: bytes) -> list[bytes]:
    """The token of each rank. Ranks have to run from 0 without gaps."""
    pairs = [line.split() for line in content.splitlines() if line]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append((n & 127) | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _bytes_field(number: int, content: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(content)) + content


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose id ``i + 1`` is the token of rank ``i``; id 0 is the unknown piece."""
    chars = byte_characters()
    out = [_bytes_field(1, _bytes_field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _int_field(3, 2))]
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out.append(_bytes_field(1, _bytes_field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _int_field(3, 1)))
    # trainer: model_type BPE, vocab_size, unk/bos/eos/pad ids (bos, eos and pad absent)
    absent = 2**64 - 1
    trainer = _int_field(3, 2) + _int_field(4, len(tokens) + 1) + _int_field(40, 0) + _int_field(41, absent) + _int_field(42, absent) + _int_field(43, absent)
    # normaliser: identity, without a dummy prefix, with white space left as it is
    normal = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return b"".join(out) + _bytes_field(2, trainer) + _bytes_field(3, normal)


class ByteBpe:
    """Encodes and decodes with a rank file; made once in each worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        # \s of the rank files' libraries is the White_Space property
        self.find = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.map = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        found = self.model.encode([p.encode("utf-8", "replace").decode("latin-1").translate(self.map) for p in pieces], num_threads=1)
        return {p: (np.array(ids, np.uint32) - np.uint32(1)).astype("<u4").tobytes() for p, ids in zip(pieces, found, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            pieces = self.find(text)
            known = self.known
            missing = [p for p in set(pieces) if p not in known]
            if missing:
                if len(known) > CACHE:
                    known.clear()
                    missing = list(set(pieces))
                known.update(self._learn(missing))
            out.append(b"".join(map(known.__getitem__, pieces)))
            for p in missing:
                if len(p) > CACHE_BYTES:
                    del known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coder(ranks, pattern: str) -> ByteBpe:
    key = (ranks.value[0], pattern)
    if _coders.get("key") != key:
        _coders.update(key=key, coder=ByteBpe(read_ranks(ranks.value[1]), pattern))
    return _coders["coder"]


_coders: dict = {}


def _shared_ranks(spark: SparkSession, rank_file: str):
    bounded_batches(spark)
    content = Path(rank_file).read_bytes()
    return spark.sparkContext.broadcast((hashlib.sha256(content).hexdigest(), content))


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """Add the column ``to``: ids of the text, packed as little-endian unsigned 32-bit integers.

    A null text counts as empty and gives no ids. Column ``to`` is replaced where it is there already.
    The rank file is read on the driver (its size is that of one vocabulary) and broadcast.
    """
    ranks = _shared_ranks(docs.sparkSession, rank_file)

    @F.pandas_udf("binary")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(ranks, pattern)
        for part in texts:
            yield pd.Series(coder.encode(["" if t is None else t for t in part]), dtype=object)

    return docs.withColumn(to, ids(F.col(text)))


def decode(encoded: DataFrame, rank_file: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Add the column ``to``: the bytes of packed ids. Null gives null; an id outside the vocabulary is an error."""
    ranks = _shared_ranks(encoded.sparkSession, rank_file)

    @F.pandas_udf("binary")
    def back(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(ranks, _ANY)
        for part in parts:
            yield pd.Series([None if x is None else coder.decode(bytes(x)) for x in part], dtype=object)

    return encoded.withColumn(to, back(F.col(ids)))


_ANY = r"\s+|\S+"


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: the key, n_tokens, ids_sha256, decoded_sha256 (lowercase hex).

    Encodes each whole text, decodes its ids and digests both in one pass, so the ids never leave the worker.
    Null text counts as empty. Repeated rows give repeated results. Other columns are not read.
    """
    ranks = _shared_ranks(docs.sparkSession, rank_file)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(ranks, pattern)
        for part in texts:
            rows = []
            for ids in coder.encode(["" if t is None else t for t in part]):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key), digest(F.col(text)).alias("d")).select(key, "d.*")
