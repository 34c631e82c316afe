"""What was sent stays known: runs that break off, refused records, later batches."""

import os
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyweave.streaming import incremental, progress

SHAPE = "id long, note string"


def service(folder, kill=None):
    """A service that notes each call in a file, refuses notes ``bad``, and kills the process once, after the note ``kill`` came."""

    def send(row):
        if row["note"] == "bad":
            raise ValueError("refused\nreally")
        with open(f"{folder}/calls", "a") as f:
            f.write(f"{row['id']}\n")
        return f"link-{row['id']}"

    def deadly(row):
        if row["note"] == kill and not os.path.exists(f"{folder}/killed"):
            Path(f"{folder}/killed").touch()
            os._exit(1)
        return send(row)

    return deadly if kill else send


def calls(folder):
    return Counter(Path(f"{folder}/calls").read_text().split())


def test_batch_and_its_outcomes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "bad"), (None, "c")], SHAPE).withColumn("key", F.lit("x")).repartition(3)
    out = {r["key"]: (r["link"], r["outcome"], r["problem"]) for r in progress.deliver(rows, "id", service(tmp_path), str(tmp_path / "j")).collect()}
    assert out == {"1": ("link-1", "added", None), "2": ("link-2", "added", None), "3": (None, "failed", "ValueError: refused"), None: (None, "failed", "a record without a key")}
    again = {r["key"]: r["outcome"] for r in progress.deliver(rows, "id", service(tmp_path), str(tmp_path / "j")).collect()}
    assert again == {"1": "known", "2": "known", "3": "failed", None: "failed"} and calls(tmp_path) == {"1": 1, "2": 1}
    assert {(r["key"], r["link"]) for r in progress.links(spark, str(tmp_path / "j")).collect()} == {("1", "link-1"), ("2", "link-2")}
    assert progress.links(spark, str(tmp_path / "none")).count() == 0
    assert progress.deliver(rows.limit(0), "id", service(tmp_path), str(tmp_path / "j")).count() == 0


def test_killed_run_repeats_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(40)], SHAPE).coalesce(1)
    with pytest.raises(Exception):
        progress.deliver(rows, "id", service(tmp_path, kill="n20"), str(tmp_path / "j")).collect()
    assert (tmp_path / "killed").exists()
    out = progress.deliver(rows, "id", service(tmp_path, kill="n20"), str(tmp_path / "j")).collect()
    assert len(out) == 40 and all(r["link"] == f"link-{r['key']}" for r in out)
    assert calls(tmp_path) == {str(i): 1 for i in range(40)}


def test_killed_stream_goes_on(spark, tmp_path):
    """The batch that was killed runs again; later files find their records known by state."""
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(i, f"n{i}") for i in range(30)], SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda send: progress.deliver_stream(incremental.new_files(spark, str(tmp_path / "in"), spark.createDataFrame([], SHAPE).schema), "id", send, str(tmp_path / "j"), str(tmp_path / "seen"), str(tmp_path / "out"))
    with pytest.raises(Exception):
        run(service(tmp_path, kill="n13"))
    run(service(tmp_path, kill="n13"))
    assert calls(tmp_path) == {str(i): 1 for i in range(30)}
    spark.createDataFrame([(5, "later"), (77, "bad"), (78, "new"), (None, "x")], SHAPE).write.mode("append").parquet(str(tmp_path / "in"))
    for p in (tmp_path / "j").rglob("*.json"):
        p.unlink()  # state alone knows
    run(service(tmp_path))
    last = spark.read.parquet(str(tmp_path / "out"))
    last = {r["key"]: (r["link"], r["outcome"]) for r in last.where(F.col("_batch") == last.agg(F.max("_batch")).first()[0]).collect()}
    assert last == {"5": ("link-5", "known"), "77": (None, "failed"), "78": ("link-78", "added")}
