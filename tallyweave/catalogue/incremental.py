"""Incremental runs: events as files that a stream takes, and users as accounts with marks."""

from pyspark.sql import functions as F

from tallyweave.catalogue import query
from tallyweave.session import shared_path
from tallyweave.streaming import incremental as inc
from tallyweave.streaming import progress

C = F.col
K = "CAST(json_extract(props, '$.k') AS INTEGER)"
STATE = "m AS (SELECT user_id, max(ts) AS mark FROM events WHERE event_type = 'view' GROUP BY user_id)"


def _stream(t):
    # a pattern, as a stream takes folders and patterns but no single file
    return inc.new_files(t.spark, f"{t.sf_dir}/events.parque[t]", t.events.schema)


def _landed(t, stream, mode="append"):
    sink = shared_path(t.spark, "landed")
    inc.land(stream, sink, shared_path(t.spark, "seen"), mode=mode)
    return t.spark.read.parquet(sink)


def _state(t):
    return t.events.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("mark")).withColumn("full", C("user_id") % 7 == 0)


@query("stream_newest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def newest(t):
    landed = _landed(t, _stream(t)).select("user_id", "ts", "event_id", "event_type", "_batch")
    return inc.newest(landed, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("stream_window_totals", "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def window_totals(t):
    totals = inc.window_totals(_stream(t).withColumn("ts", C("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 hour", "1 hour")
    found = inc.newest(_landed(t, totals, "update"), ["event_type", "start"], "n")
    return found.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("total", 6).alias("total"))


@query("state_fresh", f"WITH {STATE} SELECT event_id FROM events LEFT JOIN m USING (user_id) WHERE mark IS NULL OR user_id % 7 = 0 OR ts >= mark - INTERVAL 1 DAY")
def fresh(t):
    return inc.fresh(t.events, _state(t), ["user_id"], "ts").select("event_id")


@query("state_finished", f"""WITH {STATE}, r AS (SELECT user_id, max(ts) AS started FROM events WHERE event_type = 'error' AND {K} % 2 = 0 GROUP BY user_id)
SELECT user_id, strftime(greatest(coalesce(mark, started), coalesce(started, mark)), '%Y-%m-%d %H:%M:%S') AS mark, (mark IS NOT NULL AND user_id % 7 = 0 AND started IS NULL) AS "full" FROM m FULL JOIN r USING (user_id)""")
def finished(t):
    k = F.get_json_object("props", "$.k").cast("int")
    runs = t.events.where("event_type = 'error'").select("user_id", C("ts").alias("started"), (k % 2 == 0).alias("done"))
    return inc.finished(_state(t), runs, ["user_id"]).withColumn("mark", F.date_format("mark", "yyyy-MM-dd HH:mm:ss"))


@query("state_gone", f"""WITH {STATE}, l AS (SELECT DISTINCT user_id, {K} AS k, event_type FROM events)
SELECT DISTINCT user_id, k FROM l JOIN m USING (user_id) WHERE user_id % 7 = 0 AND event_type <> 'click' AND NOT EXISTS (SELECT 1 FROM l c WHERE c.event_type = 'click' AND c.user_id = l.user_id AND c.k = l.k)""")
def gone(t):
    keys = t.events.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type").distinct()
    return inc.gone(keys.select("user_id", "k").distinct(), keys.where("event_type = 'click'"), _state(t), ["user_id"], "k")


@query("progress_links", """SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 10 = 7 THEN NULL ELSE c_mktsegment || '-' || c_custkey END AS link, CASE WHEN c_custkey % 10 = 7 THEN 'failed' ELSE 'added' END AS outcome, CASE WHEN c_custkey % 10 <> 7 THEN 'known' ELSE 'failed' END AS again FROM customer""")
def progress_links(t):
    """Customers are sent by a stream; the batch after it finds all known but those that the service refuses."""
    journal, sink = shared_path(t.spark, "journal"), shared_path(t.spark, "outcomes")

    def send(row):
        if row["c_custkey"] % 10 == 7:
            raise ValueError("refused")
        return f"{row['c_mktsegment']}-{row['c_custkey']}"

    stream = inc.new_files(t.spark, f"{t.sf_dir}/customer.parque[t]", t.customer.schema).select("c_custkey", "c_mktsegment")
    progress.deliver_stream(stream, "c_custkey", send, journal, shared_path(t.spark, "seen"), sink)
    again = progress.deliver(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", send, journal)
    return t.spark.read.parquet(sink).select("key", "link", "outcome").join(again.select("key", C("outcome").alias("again")), "key")
