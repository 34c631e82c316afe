"""The store of accounts: records by service, account and month, in generations that are published in one step.

Data files are written once, below ``data/generation=<n>/service=/account=/month=``, and never changed. A generation is a
table of the files that belong to it (FILES) in ``_files/<n>``, and comes into being when ``_generations/<n>`` is created,
which only one writer can do. A reader follows one generation, so it sees a publish whole or not at all. A publish
writes the months whose content has changed and takes over the files of the others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyweave.session import written
from tallyweave.sources.contract import RecordSource, Wanted, between, by_id, opened, scan

PLACE = ["service", "account", "month"]
UNDATED, DEFAULT_ACCOUNT = "undated", "default"
FILES = "service string, account string, month string, file string, bytes long, rows long, digest decimal(38,0), first timestamp_ntz, last timestamp_ntz, least_id string, greatest_id string, kinds array<string>"
#: Bytes of small files that a task reads one after the other, about; and kinds that a file names, at most (with more it may hold any).
PART, KINDS = 64 << 20, 16


def month_of(local: Column) -> Column:
    return F.coalesce(F.date_format(local, "yyyy-MM"), F.lit(UNDATED))


def _named(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(DEFAULT_ACCOUNT))


def _digest(columns: Sequence[str]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))).cast("decimal(38,0)")


def placed(records: DataFrame) -> DataFrame:
    """Records with their place, each id of an account once.

    A service or account that is null or blank is ``default``; a null id becomes a digest of the record, so equal records
    are one. Of rows with one id that with the last text form stands.
    """
    columns = [c for c in records.columns if c not in (*PLACE, "id")]
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))
    rows = records.select(_named(F.col("service")).alias("service"), _named(F.col("account")).alias("account"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("sha1:"), F.sha1(text))).alias("id"), F.struct(*columns).alias("_r"), text.alias("_t"))
    one = rows.groupBy("service", "account", "id").agg(F.max_by("_r", "_t").alias("_r"))
    return one.select("service", "account", month_of(F.col("_r.local")).alias("month"), "id", "_r.*")


@dataclass
class Generation:
    """A published state: its number (0: none yet) and the columns of its records."""

    number: int
    columns: StructType | None


def _numbers(path: str) -> list[int]:
    store, root = opened(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/_generations", allow_not_found=True))
    return sorted(int(f.base_name) for f in found if f.base_name.isdigit())


def generation(path: str, number: int | None = None) -> Generation:
    """A generation, the newest unless given."""
    numbers = _numbers(path)
    if number is None:
        if not numbers:
            return Generation(0, None)
        number = numbers[-1]
    elif number not in numbers:
        raise ValueError(f"no generation {number} at {path}")
    store, root = opened(path)
    with store.open_input_stream(f"{root}/_generations/{number:09d}", compression=None) as f:
        return Generation(number, StructType.fromJson(json.loads(f.read())))


def files(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The FILES of a generation."""
    return spark.read.schema(FILES).parquet(f"{path}/_files/{number:09d}")


def _stored(spark: SparkSession, path: str, found: DataFrame, columns: StructType, names: Sequence[str]) -> DataFrame:
    """Columns of the records in some files, read by Spark itself; the list of files is on the driver, as Spark's own is."""
    paths = [f"{path}/{r['file']}" for r in found.select("file").collect()]
    if not paths:
        return spark.createDataFrame([], columns).select(*names)
    every = StructType([*columns.fields])
    return spark.read.schema(every).option("basePath", f"{path}/data").parquet(*paths).select(*names)


def _summary(rows: DataFrame, *by: str) -> DataFrame:
    kind = F.col("kind").cast("string") if "kind" in rows.columns else F.lit(None).cast("string")
    content = [c for c in rows.columns if c not in (*PLACE, "_file", "_bytes")]
    kinds = F.slice(F.sort_array(F.collect_set(F.coalesce(kind, F.lit("")))), 1, KINDS + 1)
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(_digest(content)).alias("digest"), F.min("local").alias("first"), F.max("local").alias("last"), F.min("id").alias("least_id"), F.max("id").alias("greatest_id"), kinds.alias("kinds"))


def publish(records: DataFrame, path: str, everything: bool = False) -> int:
    """Store records (service, account, id, local, maybe kind, and any others) as a new generation; returns its number.

    Records replace those of the same service, account and id, in whatever month these stand. With ``everything`` the
    records are all that their accounts have, so others of these accounts go; accounts without a record are never
    touched. Months whose content stays the same are not written, and if all do, no generation is made and the newest
    one's number is returned. Another writer that publishes first makes this one fail without a trace to readers.
    """
    spark, path = records.sparkSession, path.rstrip("/")
    now = generation(path)
    new = written(placed(records), "store-new")
    columns = now.columns or new.schema
    names = [f.name for f in columns.fields]
    if now.columns is not None and {f.name: f.dataType for f in new.schema} != {f.name: f.dataType for f in columns}:
        raise ValueError("the records have other columns than the store")
    new = new.select(*names)
    accounts = new.select("service", "account").distinct()
    known = files(spark, path, now.number) if now.number else spark.createDataFrame([], FILES)
    of_accounts = known.join(accounts, ["service", "account"], "left_semi")
    if everything or not now.number:
        merged = new
    else:
        keys = new.select("service", "account", "id")
        before = _stored(spark, path, of_accounts, columns, names)
        touched = new.select(*PLACE).unionByName(before.select(*PLACE, "id").join(keys, ["service", "account", "id"], "left_semi").select(*PLACE)).distinct()
        touched = written(touched, "store-touched")
        rest = before.join(touched, PLACE, "left_semi").join(keys, ["service", "account", "id"], "left_anti")
        of_accounts = of_accounts.join(touched, PLACE, "left_semi")
        merged = written(new.unionByName(rest.select(*names)), "store-merged")
    old = of_accounts.groupBy(*PLACE).agg(F.sum("rows").alias("_rows"), F.sum("digest").alias("_digest"))
    both = _summary(merged, *PLACE).select(*PLACE, "rows", "digest").join(old, PLACE, "full")
    changed = written(both.where(~F.col("rows").eqNullSafe(F.col("_rows")) | ~F.col("digest").eqNullSafe(F.col("_digest"))).select(*PLACE, F.col("rows").isNull().alias("_gone")), "store-changed")
    if changed.isEmpty():
        return now.number
    number = now.number + 1
    folder = f"data/generation={number:09d}-{_token()}"
    # a large month is dealt out to several tasks, small ones share files' tasks
    rows = merged.join(changed.where("not _gone").select(*PLACE), PLACE, "left_semi").hint("rebalance", *PLACE)
    rows.sortWithinPartitions(*PLACE, "local", "id").write.partitionBy(*PLACE).option("compression", "zstd").parquet(f"{path}/{folder}")
    made = spark.read.schema(columns).parquet(f"{path}/{folder}").withColumn("_file", F.col("_metadata.file_path")).withColumn("_bytes", F.col("_metadata.file_size"))
    made = _summary(made, *PLACE, "_file", "_bytes").withColumn("file", F.substring_index(F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))), f"/{folder}/", -1))
    made = made.withColumn("file", F.concat(F.lit(f"{folder}/"), "file")).withColumnRenamed("_bytes", "bytes")
    names = [c.split()[0] for c in FILES.split(", ")]
    told = known.join(changed.select(*PLACE), PLACE, "left_anti").select(*names).unionByName(made.select(*names))
    told.repartitionByRange(*PLACE, "file").sortWithinPartitions(*PLACE, "file").write.parquet(f"{path}/_files/{number:09d}-{folder[-8:]}")
    _create(spark, path, number, folder[-8:], columns)
    return number


def _token() -> str:
    import uuid

    return uuid.uuid4().hex[:8]


def _create(spark: SparkSession, path: str, number: int, token: str, columns: StructType) -> None:
    """Bring a generation into being: its table of files takes its name, which one writer only can do, and then the mark is written."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = lambda *p: hadoop.Path("/".join((path, *p)))
    system = place("_files").getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.mkdirs(place("_claims")):
        raise OSError(f"{path} can't be written")
    try:
        system.create(place("_claims", f"{number:09d}"), False).close()
    except Exception as e:
        raise RuntimeError(f"generation {number} at {path} was published by another writer") from e
    if not system.rename(place("_files", f"{number:09d}-{token}"), place("_files", f"{number:09d}")):
        raise OSError(f"generation {number} at {path} can't be named")
    # a mark that is being written has another name, so readers never see half of one
    out = system.create(place("_generations", f".{number:09d}"), True)
    out.write(bytearray(columns.json().encode()))
    out.close()
    system.rename(place("_generations", f".{number:09d}"), place("_generations", f"{number:09d}"))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` generations and the data that none of these reads; returns how many generations went."""
    path, numbers = path.rstrip("/"), _numbers(path)
    kept, gone = numbers[-max(1, keep) :], numbers[: -max(1, keep)]
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    used = {r[0] for n in kept for r in files(spark, path, n).select(F.regexp_extract("file", "^data/([^/]+)/", 1)).distinct().collect()}
    for n in gone:
        system.delete(hadoop.Path(f"{path}/_generations/{n:09d}"), False)
        system.delete(hadoop.Path(f"{path}/_files/{n:09d}"), True)
    for f in system.listStatus(hadoop.Path(f"{path}/data")):
        name = f.getPath().getName()
        made = int(name.removeprefix("generation=").split("-")[0])
        if name not in used and kept and made <= kept[-1]:
            system.delete(f.getPath(), True)
    return len(gone)


@dataclass
class _Files(InputPartition):
    #: (file, service, account, month) of each.
    files: tuple[tuple[str, str, str, str], ...]


class StoreSource(RecordSource):
    """``spark.read.format("account_store")`` of one generation (option ``generation``; the newest when the frame is made)."""

    @classmethod
    def name(cls) -> str:
        return "account_store"

    def _generation(self) -> Generation:
        asked = self.options.get("generation")
        return generation(self.options["path"].rstrip("/"), int(asked) if asked else None)

    def schema(self) -> StructType:
        found = self._generation()
        if found.columns is None:
            raise ValueError(f"nothing was published at {self.options['path']}")
        return found.columns

    def parts(self, wanted: Wanted) -> list[_Files]:
        store, root = opened(self.options["path"].rstrip("/"))
        found = ds.dataset(f"{root}/_files/{self._generation().number:09d}", filesystem=store, format="parquet", exclude_invalid_files=False, ignore_prefixes=["_", "."])
        picked = None
        for name in PLACE:
            if name in wanted.values:
                one = ds.field(name).isin([v for v in wanted.values[name] if v is not None])
                picked = one if picked is None else picked & one
        if wanted.since is not None:
            one = ds.field("last") >= pa.scalar(wanted.since, pa.timestamp("us"))
            picked = one if picked is None else picked & one
        if wanted.until is not None:
            one = ds.field("first") <= pa.scalar(wanted.until, pa.timestamp("us"))
            picked = one if picked is None else picked & one
        told = found.to_table(columns=[*PLACE, "file", "bytes", "least_id", "greatest_id", "kinds"], filter=picked).to_pylist()
        out, held, size = [], [], 0
        for r in told:
            if "id" in wanted.values and not any(v is not None and r["least_id"] <= v <= r["greatest_id"] for v in wanted.values["id"]):
                continue
            if "kind" in wanted.values and len(r["kinds"]) <= KINDS and not wanted.values["kind"] & set(r["kinds"]):
                continue
            if held and size + r["bytes"] > PART:
                out.append(_Files(tuple(held)))
                held, size = [], 0
            held.append((r["file"], r["service"], r["account"], r["month"]))
            size += r["bytes"]
        return [*out, _Files(tuple(held))]

    def rows(self, part: _Files, wanted: Wanted, columns: StructType) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.options["path"].rstrip("/"))
        target = to_arrow_schema(columns)
        for file, *place in part.files:
            at = dict(zip(PLACE, place, strict=True))
            with store.open_input_file(f"{root}/{file}") as f:
                inside = pq.ParquetFile(f)
                for batch in inside.iter_batches(columns=[c for c in columns.names if c not in at], batch_size=4_096):
                    own = {n: batch.column(n) for n in batch.schema.names} | {n: pa.array([v] * len(batch), pa.string()) for n, v in at.items()}
                    yield pa.RecordBatch.from_arrays([own[c.name].cast(c.type) for c in target], schema=target)


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None, number: int | None = None) -> DataFrame:
    """The records of a generation, with filters on service, account, month, kind, id and local picking the files."""
    asked = number or generation(path).number
    if not asked:
        raise ValueError(f"nothing was published at {path}")
    return scan(spark, StoreSource, path, columns, generation=str(asked))


def newest(spark: SparkSession, path: str, n: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """The ``n`` newest dated records, ties by service, account and id; only months that can hold one are opened.

    The months' counts tell how far back that is.
    """
    number = generation(path).number
    months = files(spark, path, number).where("first is not null").groupBy("month").agg(F.sum("rows").alias("rows")).orderBy(F.desc("month"))
    held, since = 0, None
    for r in months.toLocalIterator():
        held, since = held + r["rows"], datetime.strptime(r["month"], "%Y-%m")
        if held >= n:
            break
    rows = read(spark, path, columns, number).where(F.col("local").isNotNull())
    return between(rows, since).orderBy(F.desc("local"), "service", "account", "id").limit(n)


def one(spark: SparkSession, path: str, id_: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The records with this id, one for each account that has it."""
    return by_id(read(spark, path, columns), id_)
