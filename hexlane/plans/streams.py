"""Streaming queries, run to completion over what there is."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..cluster import shared_dir
from ..sources.tables import parquet
from ..streaming import completion, logs, upsert
from .base import RUNNERS, query, rd, rounded, runners


def folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def events_stream(spark, d):
    table = parquet(spark, d, "events")
    stream = spark.readStream.schema(table.schema).parquet(f"{d}/events.parquet*")
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


@query("stream_vs_batch_results", "SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last_ts FROM events GROUP BY user_id, event_type")
def stream_vs_batch_results(spark, d):
    """An append log aggregated as a stream; the SQL is the batch result."""
    return logs.drain(logs.running_totals(events_stream(spark, d), ["user_id", "event_type"]), "complete", folder(spark))


@query("stream_log_join", """WITH e AS (SELECT user_id, event_id, event_type, value, CAST(ts AS TIMESTAMP) AS at FROM events)
SELECT p.user_id, p.at AS logged_at, p.event_id, r.at AS r_logged_at, CAST(r.event_id AS VARCHAR) AS actual_combo, r.value AS payout
FROM (SELECT * FROM e WHERE event_type = 'view') p LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') r ON r.user_id = p.user_id AND r.at >= p.at AND r.at <= p.at + INTERVAL 1 HOUR""")
def stream_log_join(spark, d):
    """Predictions (views) with the purchases that follow within an hour: a stream-stream left join, then what still waits."""
    def log(events, kind: str, *cols):
        return events.where(F.col("event_type") == kind).select("user_id", F.col("at").alias("logged_at"), *cols)

    def sides(events):
        return log(events, "view", "event_id"), log(events, "purchase", F.col("event_id").cast("string").alias("actual_combo"), F.col("value").alias("payout"))

    joined = logs.drain(logs.join_logs(*sides(events_stream(spark, d)), ["user_id"]), "append", folder(spark))
    batch = parquet(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return logs.with_pending(joined, *sides(batch), ["user_id"], "event_id")


@query("stream_dedupe")
def stream_dedupe(spark, d):
    """Repeated log rows of a user and kind within ten minutes dropped."""
    events = events_stream(spark, d).select("user_id", "event_type", F.col("at").alias("logged_at"))
    return logs.drain(logs.without_refreshes(events, ["user_id", "event_type"]), "append", folder(spark))


def dealt_runners(spark, d):
    """Runner rows dealt over six files by row, so that every race is cut, with some rows lost and some logged twice."""
    rows = runners(spark, d).select("race", "lane", "motor", "win_rate", "finish", "date").where((F.col("race") * 7 + F.col("lane")) % 23 != 0)
    rows = rows.withColumn("_copy", F.explode(F.expr("if(motor % 10 = 3, array(1, 2), array(1))"))).drop("_copy")
    path = f"{folder(spark)}/dealt"
    rows.repartition(6, F.xxhash64("race", "lane")).write.option("maxRecordsPerFile", 0).parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_complete_races", RUNNERS + """ , kept AS (SELECT race, lane, motor, win_rate, finish, date FROM runners WHERE (race * 7 + lane) % 23 <> 0)
SELECT race, lane, motor, CAST(win_rate AS DOUBLE) AS win_rate, finish, date FROM kept WHERE race IN (SELECT race FROM kept GROUP BY race HAVING count(*) = 6)""")
def stream_complete_races(spark, d):
    """Races whose rows come in six batches, whole and once; the SQL is the batch filter."""
    rows = dealt_runners(spark, d).withColumn("at", F.to_timestamp("date", "yyyyMMdd")).withWatermark("at", "3650 days")
    stream = completion.complete_groups(rows, "race", "lane", 6, hold_ms=86_400_000, event_time="at")
    return rounded(logs.drain(stream, "append", folder(spark)).drop("is_complete", "at"))


@query("stream_upsert_results", RUNNERS + f""" , log AS (SELECT race, date, lane AS logged_at, motor, win_rate FROM runners WHERE (race * 7 + lane) % 23 <> 0)
SELECT race, date, arg_max(motor, logged_at) AS motor, {rd('arg_max(win_rate, logged_at)', 'win_rate')} FROM log GROUP BY race, date""")
def stream_upsert_results(spark, d):
    """The last log row of each race, merged batch by batch into a versioned table by date; the SQL is the batch result."""
    log = dealt_runners(spark, d).select("race", "date", F.col("lane").alias("logged_at"), "motor", "win_rate")
    target = upsert.VersionedTable(spark, f"{folder(spark)}/results", log.schema, ["race", "date"], "logged_at", "date")
    upsert.run(log, target, f"{folder(spark)}/checkpoint")
    return rounded(target.read().drop("logged_at"))


@query("stream_cache")
def stream_cache(spark, d):
    """Events that a cache of thirty minutes and at most 640 users would have had to fetch; tested against a plain cache."""
    events = events_stream(spark, d).select("user_id", "at").withWatermark("at", "10 minutes")
    return logs.drain(logs.bounded_cache(events, "user_id", "at", 1_800_000, 640), "append", folder(spark)).select(F.col("key").alias("user_id"), "at")
