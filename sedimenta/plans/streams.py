"""Streaming twins over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.plans.registry import query
from sedimenta.session import table
from sedimenta.streaming import events


def _stream(spark, d):
    return events.stream(spark, d, "events.parquet", table(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    """Events per day and type, by a stream that keeps the whole result up to date."""
    rows = events.drain(events.windowed(_stream(spark, d), "ts", ["event_type"], "1 day", "3650 days", "value"), "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark, d):
    """Runs of a user's events, by a stream with session windows."""
    rows = events.drain(events.sessions(_stream(spark, d), "ts", "user_id", "12 hours", "3650 days"), "complete")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_intake_once(spark, d):
    """Each event once, from a stream that delivers it twice."""
    twice = _stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return events.drain(events.once(twice, "ts", ["event_id"], "3650 days")).select("event_id", "user_id")
