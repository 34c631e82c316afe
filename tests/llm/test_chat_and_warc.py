import gzip
import hashlib
import io
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from comparing import DATA
from pyspark.sql import functions as F

from tallyweave.llm import chat, warc
from tallyweave.llm.queries import OP6_SQL, op6_chat_format, op8_warc

HARD = ["</s>[INST] ok [/INST]", "<\\s><\\\\s>", "[\\/INST]", "<s>[INST]\n[/INST]</s>", "<image> <\\audio>", "a\\b\nc", "", None, "$1 \\$2 <", "<<s>>[[INST]]", "<\\", "s>"]


def test_query_same_as_sql(same_as_sql):
    same_as_sql(op6_chat_format, OP6_SQL, DATA / "sf0.01")


def test_texts_come_back(spark):
    rows = [(c, i, role, text) for c, role in enumerate(["user", "assistant", "sys\ntem\\", "[/INST]", None]) for i, text in enumerate(HARD)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df.withColumn("content", chat.text_parts(F.col("text"))))
    for r in made.withColumn("turns", chat.read_turns(F.col("formatted"))).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role or "", text or "") for c, _, role, text in rows if c == r["conv_id"]]
    mine = chat.digests(made.where("conv_id = 1")).first()
    assert mine["loss_sha256"] == hashlib.sha256("".join(t or "" for t in HARD).encode()).hexdigest()


def test_parts_and_attachments(spark):
    parts = [("text", "see <image>", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 12), None, ("other", "odd", None, None), ("document", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "yes", None, None)]), (1, 2, "user", None)], f"conv_id long, turn int, role string, content {chat.CONTENT}")
    r = chat.format_chats(df).first()
    assert r["formatted"] == "[INST]user\nsee <\\image><image><audio>odd<document>[/INST]<s>yes</s>[INST]user\n[/INST]"
    assert [(a["turn"], a["part"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 1, "image", "a.png", 576), (0, 2, "audio", "b.wav", 12), (0, 4, "document", None, 1024)]
    assert r["attachment_tokens"] == 576 + 12 + 1024
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == ["yes"]


def test_no_conversations(spark):
    df = spark.createDataFrame([], f"conv_id long, turn int, role string, content {chat.CONTENT}")
    assert chat.format_chats(df).count() == 0


def test_records_against_plain_python(spark):
    pages = spark.read.parquet(str(DATA / "sf0.01/pages.parquet")).collect()
    top = {}
    for r in pages:
        top[r["html"] or ""] = max(top.get(r["html"] or "", -1), r["page_id"])
    got = {r["page_id"]: r for r in op8_warc(spark, str(DATA / "sf0.01")).collect()}
    assert len(got) == len(pages)
    for p in pages:
        body, r = (p["html"] or "").encode(), got[p["page_id"]]
        first = top[p["html"] or ""]
        assert (r["payload_bytes"], r["payload_digest"], r["valid"]) == (len(body), warc.base32_sha1(body), True)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == p["page_id"] else ("revisit", first))


def test_odd_pages(spark):
    rows = [(1, "http://a/ b", "x\r\n\r\ny"), (2, None, None), (3, "u", ""), (None, "u", "x\r\n\r\ny"), (4, "u", "é" * 200_000), (5, "u", "same"), (5, "u", "same"), (6, "u", "b"), (7, "u", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("x"))
    path = warc.write_archives(df)
    read = warc.read_files(spark, path, payloads=True)
    assert read.count() == len(rows) and read.where("not valid").count() == 0
    texts = {r["record_id"]: r["payload"] for r in read.where("record_type = 'response'").collect()}
    assert bytes(texts["urn:x-page:1"]).decode() == "x\r\n\r\ny" and bytes(texts["urn:x-page:4"]).decode() == "é" * 200_000
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.write_and_read(df, least=2).where("page_id is not null").collect())
    assert kinds == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)]
    assert warc.write_and_read(df.limit(0)).count() == 0


def test_files_are_plain_warc(spark, tmp_path):
    """What was written are files of gzip members; Spark's own binary source reads the same, and other folders are left alone."""
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 7} " * 50) for i in range(40)], "page_id long, url string, html string").repartition(3)
    (tmp_path / "_other").write_text("x")
    path = warc.write_archives(df, f"file://{tmp_path}")
    names = sorted(p.name for p in tmp_path.iterdir())
    assert sum(n.startswith(warc.MANIFEST) for n in names) == 1
    files = sorted(tmp_path.glob("*.warc.gz"))
    plain = b"".join(gzip.decompress(p.read_bytes()) for p in files)
    assert plain.count(b"WARC/1.1\r\n") == 40 and plain.count(b"WARC-Type: response") == 7
    key = lambda r: (r["record_id"], r["record_type"], r["target_uri"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["valid"])
    ours = sorted(key(r) for r in warc.read_files(spark, path).collect())
    by_content = warc.read_records(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(str(tmp_path)))
    assert ours == sorted(key(r) for r in by_content.collect()) and all(r[-1] for r in ours)
    # a file of an attempt that failed is in no manifest; a second write adds one
    (tmp_path / "part-x.warc.gz").write_bytes(warc.record(99, "u", b"x", None, False))
    assert warc.read_files(spark, path).count() == 40
    warc.write_archives(df, path)
    assert warc.read_files(spark, path).count() == 80


def test_damage_is_seen(spark, tmp_path):
    good = [warc.record(i, "u", b"payload" * 40_000, None, False) for i in range(4)]
    bad = warc.record(9, "u", b"payload", None, False, digest=warc.base32_sha1(b"other"))
    no_length = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:8>\r\n\r\nabc\r\n\r\n")
    broken = bytearray(good[2])
    broken[len(broken) // 2] ^= 0xFF
    content = good[0] + bad + no_length + bytes(broken) + good[1] + b"noise between" + good[3] + good[2][:-20]
    (tmp_path / "a.warc.gz").write_bytes(content)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    df = spark.createDataFrame(pa.table({"content": pa.array([content, None, b""], pa.binary())}).to_pandas())
    for read in (warc.read_records(df), warc.read_files(spark, str(tmp_path))):
        rows = read.collect()
        assert sorted(r["record_id"] for r in rows if r["valid"]) == ["urn:x-page:0", "urn:x-page:1", "urn:x-page:3"]
        why = {r["record_id"]: r["reason"] for r in rows if not r["valid"]}
        assert why["urn:x-page:9"] == "payload digest" and why["urn:x-page:8"] == "no content length"
        assert all(r["reason"] for r in rows if not r["valid"])
        assert any("cut" in r["reason"] for r in rows if not r["valid"]) and any("no gzip member" in r["reason"] for r in rows if not r["valid"])
        # the wrong digest, the missing length, the damaged record, the noise, the cut record: a row each
        assert sum(not r["valid"] for r in rows) == 5


class Pieces:
    """A stream whose first piece ends ``cut`` bytes into the second member."""

    def __init__(self, content, first):
        self.content, self.at, self.first = content, 0, first

    def read(self, n):
        n = self.first if self.at == 0 else n
        out, self.at = self.content[self.at : self.at + n], self.at + n
        return out


@pytest.mark.parametrize("noise", [b"", b"noise", b"\x1f", b"\x1f\x8b"])
def test_members_cut_by_pieces(noise):
    """Wherever a piece ends, records are rows, and passed-over bytes one row."""
    one, two = warc.record(1, "u", b"first", None, False), warc.record(2, "u", b"second", None, False)
    for cut in range(-3, 21):
        for step in (1, 2, 3, 7, 1 << 16):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(warc, "STEP", step)
                rows = list(warc.records(Pieces(one + noise + two, len(one) + cut)))
            assert [r[0] for r in rows] == ["urn:x-page:1", *([None] if noise else []), "urn:x-page:2"], (cut, step)
            assert [r[7] for r in rows if r[0] is None] == ["no gzip member, no WARC version, no type, no content length"] * bool(noise)


def test_large_archives_hold_every_page(spark):
    """More than 100 MB of small and large members, so that pieces end at all places of many members."""
    pages = spark.range(110_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.when(F.col("id") % 50 == 0, F.repeat(F.sha2(F.col("id").cast("string"), 512), 1_000)).otherwise(F.concat_ws("", *[F.sha2(F.concat_ws("-", "id", F.lit(i)), 512) for i in range(16)])).alias("html"))
    path = warc.write_archives(pages.repartition(4))
    assert sum(p.stat().st_size for p in Path(path.removeprefix("file://")).glob("*.warc.gz")) > 100 << 20
    read = warc.read_files(spark, path)
    got = read.agg(F.count("*"), F.count_distinct("record_id"), F.sum(F.col("valid").cast("int")), F.sum("payload_bytes")).first()
    assert tuple(got) == (110_000, 110_000, 110_000, 2_200 * 128_000 + 107_800 * 2_048)


def test_memory_follows_pieces_not_records():
    """A member that inflates to far more than its bytes is digested as it comes; a head without an end is a fault."""
    big = warc.record(1, "u", b"\0" * (64 << 20), None, False)
    tracemalloc.start()
    (row,) = warc.records(io.BytesIO(big))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row[4] == 64 << 20 and row[6] and peak < 4 << 20
    (row,) = warc.records(io.BytesIO(gzip.compress(b"WARC/1.1\r\n" + b"x" * (3 << 20))))
    assert "long head" in row[7]
