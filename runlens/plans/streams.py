"""Queries: streams over the events and documents tables, run until all that is there has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch
from ..streaming import jobs as R
from .base import Tables, query
from .texts import TOK, J, items


def stream_of(t: Tables, name: str, *cols) -> DataFrame:
    df = t.spark.readStream.schema(t(name).schema).parquet(f"{t.path(name)[:-1]}[t]")  # a pattern: a stream takes no plain file
    return df.select(*cols) if cols else df


def events(t: Tables) -> DataFrame:
    return stream_of(t, "events", "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


def finished(t: Tables, stream: DataFrame, *keys: str) -> DataFrame:
    """The stream's result: appended rows, or with ``keys`` the last version of each."""
    path = scratch(t.spark, "stream")
    run = R.updated(stream, path) if keys else R.appended(stream, path)
    run.awaitTermination()
    return R.newest(t.spark, path, stream.schema, *keys) if keys else t.spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("R1_message_ingest", "SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 'final_answer' ELSE 'message' END AS kind FROM events WHERE event_type <> 'error'")
def r1(t):
    kind = F.when(F.col("event_type") == "purchase", "final_answer").otherwise("message")
    return finished(t, R.message_ingest(events(t), F.col("event_type") == "error", kind).select("event_id", "user_id", "kind"))


@query("R2_status_tracker", "SELECT user_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def r2(t):
    return finished(t, R.status_tracker(events(t), "user_id", F.col("event_type"), "ts", "event_id"), "user_id")


MONITOR_SQL = """
WITH e AS (SELECT user_id AS run, event_id AS "at", row_number() OVER w AS check_number, sum(CAST(event_type = 'error' AS INTEGER)) OVER w AS errors, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CASE WHEN event_type = 'error' THEN CASE WHEN errors >= 3 THEN 'aborted' ELSE 'error' END WHEN event_type = 'purchase' OR check_number >= 20 THEN 'complete' ELSE 'sleeping' END AS status FROM e),
f AS (SELECT run, min(check_number) AS last FROM s WHERE status IN ('aborted', 'complete') GROUP BY run)
SELECT run, "at", check_number, CAST(errors AS BIGINT) AS errors, status, CAST(CASE status WHEN 'error' THEN 30 WHEN 'sleeping' THEN 60 ELSE 0 END AS BIGINT) AS next_check
FROM s LEFT JOIN f USING (run) WHERE last IS NULL OR check_number <= last
"""


@query("R3_monitor", MONITOR_SQL)
def r3(t):
    return finished(t, R.monitor(events(t), "user_id", "ts", F.col("event_type") == "purchase", F.col("event_type") == "error", 20, 60, "event_id"))


@query("R4_tumbling_condition", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 5")
def r4(t):
    out = finished(t, R.windowed_condition(events(t), "ts", "1 day", None, ["event_type"], 5), "start", "event_type")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("R4_sliding_condition", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY 1, 2 HAVING count(*) >= 5")
def r4_sliding(t):
    out = finished(t, R.windowed_condition(events(t), "ts", "1 day", "12 hours", ["event_type"], 5), "start", "event_type")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("R5_input_timeout", 'WITH e AS (SELECT user_id AS run, event_id AS "at", ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT run, "at", ts + INTERVAL 1 HOUR AS stopped_at FROM e WHERE event_type = \'view\' AND (nxt - ts > INTERVAL 1 HOUR OR nxt IS NULL AND ts + INTERVAL 70 MINUTE < (SELECT max(ts) FROM events))')
def r5(t):
    out = finished(t, R.input_timeout(events(t), "user_id", "ts", "event_id", F.col("event_type") == "view"))
    return out.withColumn("stopped_at", F.col("stopped_at").cast("timestamp_ntz"))


@query("R5_input_timeout_batch", "WITH e AS (SELECT user_id, event_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT user_id, event_id FROM e WHERE event_type = 'view' AND nxt - ts > INTERVAL 1 HOUR")
def r5_batch(t):
    return R.input_timeout_batch(t("events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id", F.col("event_type") == "view").select("user_id", "event_id")


@query("R6_event_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def r6(t):
    return finished(t, R.event_dedupe(events(t), "ts", ["user_id", "event_type"]).select("user_id", "event_type"))


@query("R8_score_on_arrival", f"SELECT doc_id, round(CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END, 6) AS score FROM (SELECT doc_id, {TOK.format('gold')} AS a, {TOK.format('pred')} AS b FROM {J})")
def r8(t):
    answers = stream_of(t, "documents", "doc_id", F.col("text").alias("pred"), (F.col("doc_id") % items(t)).alias("item_id"))
    tasks = t("benchmark").select("item_id", F.col("text").alias("gold"))
    return finished(t, R.score_on_arrival(answers, tasks, "item_id", "gold", "pred").select("doc_id", F.round("score", 6).alias("score")))


@query("R7_file_arrivals", "SELECT concat('part-', n_nationkey) AS file FROM nation WHERE n_regionkey <> 1")
def r7(t):
    """Files written a row a folder arrive as a stream; those of one region were uploaded before. At the end the last of each name stays."""
    root = scratch(t.spark, "arrivals")
    rows = t("nation").select(F.concat(F.lit("part-"), "n_nationkey").alias("file"), F.col("n_name").alias("value"), "n_regionkey")
    rows.drop("n_regionkey").write.partitionBy("file").text(root)
    stream = t.spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/*")
    folder = F.regexp_extract("path", "file=([^/]+)/", 1)
    named = stream.select(F.concat("path", F.lit("/"), folder).alias("path"), "modificationTime")
    new = finished(t, R.file_arrivals(named, rows.where("n_regionkey = 1").select(F.col("file").alias("name"))))
    return R.final_files(new).select(F.col("name").alias("file"))
