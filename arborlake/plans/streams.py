"""Batch forms of the continuous queries; tests run the same functions on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.plans.registry import register
from arborlake.session import table
from arborlake.streaming import views as V


@register("b11_tumbling_window", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    return V.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n")], "2 hours").drop("window_end")


@register("b11_hopping_window", "SELECT time_bucket(INTERVAL '15 minutes', ts) - INTERVAL (15 * i) MINUTE AS window_start, count(*) AS n FROM events, range(4) t(i) GROUP BY 1")
def _(spark, sf_dir):
    return V.hopping(table(spark, sf_dir, "events"), "ts", "1 hour", "15 minutes", [], [F.count("*").alias("n")])


@register("b11_session_window", "WITH o AS (SELECT user_id, ts, ts - lag(ts) OVER w >= INTERVAL '30 minutes' AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM g GROUP BY user_id, s")
def _(spark, sf_dir):
    return V.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])


@register("b11_deduplicate", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf_dir):
    return V.deduplicated(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "1 hour").select("user_id", "event_type")


@register("b11_interval_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL '2 hours' WHERE a.event_type = 'purchase' AND b.event_type = 'click'")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("ats"))
    b = e.where("event_type = 'click'").select(F.col("user_id"), F.col("event_id").alias("b"), F.col("ts").alias("bts"))
    return V.interval_join(a, b, ["user_id"], "ats", "bts", "2 hours", "1 hour").select("a", "b")


@register("b11_ttl", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL '1 day'")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts")).first()[0]
    return V.alive(e, "ts", "1 day", F.lit(last).cast("timestamp_ntz")).select("event_id")
