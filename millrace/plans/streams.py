"""Queries over streams, and the batch forms of stateful statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.registry import query, r6
from millrace.streaming import streams as S


def _stream(t):
    return S.file_stream(t.spark, t.dir, "events")


def _micros(t):
    return t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def _day():
    return F.date_format("start", "yyyy-MM-dd HH:mm").alias("start")


@query("T01_tumbling_window", "SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t01(t):
    made = S.drain(S.tumbling(_stream(t), "ts", "1 day", ["event_type"], F.count("*").alias("n")), "complete")
    return made.select(_day(), "event_type", "n")


@query("T02_window_counters", "SELECT strftime(time_bucket(INTERVAL 6 hour, ts), '%Y-%m-%d %H:%M') AS start, round(sum(value), 4) AS total, count(value) AS n FROM events GROUP BY 1")
def t02(t):
    made = S.drain(S.tumbling(_stream(t), "ts", "6 hours", [], F.sum("value").alias("total"), F.count("value").alias("n")), "complete")
    return made.select(_day(), r6(F.col("total"), 4).alias("total"), "n")


@query("T18_sliding_window", "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 hour, ts), time_bucket(INTERVAL 6 hour, ts) - INTERVAL 6 hour]) AS s FROM events) GROUP BY 1")
def t18(t):
    made = S.drain(S.tumbling(_stream(t), "ts", "12 hours", [], F.count("*").alias("n"), slide="6 hours"), "complete")
    return made.select(_day(), "n")


@query("T08_without_repeats", "SELECT count(DISTINCT event_id) AS n FROM events")
def t08(t):
    made = S.drain(S.without_repeats(_stream(t), "ts", ["event_id"], "1 hour").select("event_id"))
    return made.agg(F.count_distinct("event_id").alias("n"))


@query("T15_channel", "SELECT user_id, event_id FROM events WHERE event_type = 'purchase'")
def t15(t):
    return S.drain(_stream(t).where("event_type = 'purchase'").select("user_id", "event_id"))


@query("K04_interval_append", "SELECT user_id, event_type, value FROM events WHERE value > 50")
def k04(t):
    return S.drain(_stream(t).where("value > 50").select("user_id", "event_type", "value"))


@query(
    "T03_up_down",
    "SELECT user_id, \"at\", CAST(sum(d) OVER (PARTITION BY user_id ORDER BY \"at\", d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open FROM (SELECT user_id, epoch_us(ts) AS \"at\", CASE WHEN event_type = 'view' THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('view', 'purchase'))",
)
def t03(t):
    e = _micros(t)
    return S.up_down(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "at").select("user_id", "at", F.col("open").cast("bigint").alias("open"))


_OPEN = "SELECT s.user_id, s.at AS opened, min(e.at) AS closed FROM (SELECT user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'view') s LEFT JOIN (SELECT user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase') e ON s.user_id = e.user_id AND e.at >= s.at GROUP BY 1, 2"


def _open(t):
    e = _micros(t)
    return S.in_flight(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "at")


@query("T05_in_flight", _OPEN)
def t05(t):
    return _open(t)


@query("T06_idle_attribution", f"SELECT o.user_id AS key, round(sum(i.value), 4) AS total FROM (SELECT epoch_us(ts) AS at, value FROM events WHERE event_type = 'error') i JOIN ({_OPEN}) o ON i.at >= o.opened AND i.at < o.closed GROUP BY 1")
def t06(t):
    idle = _micros(t).where("event_type = 'error'").select("at", F.col("value").alias("amount"))
    open_ = _open(t).where("closed IS NOT NULL").select(F.col("user_id").alias("key"), "opened", "closed")
    return S.idle_attribution(idle, open_, 3_600_000_000 * 6).select("key", r6(F.col("total"), 4).alias("total"))


@query(
    "T07_row_locality",
    """WITH x AS (SELECT user_id, ts, event_id, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       r AS (SELECT user_id, epoch_us(ts) AS us, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x), g AS (SELECT user_id, run, count(*) AS n, max(us) - min(us) AS t FROM r GROUP BY 1, 2)
       SELECT user_id, max(n) AS accesses, max(t) AS service FROM g GROUP BY 1""",
)
def t07(t):
    return S.locality_runs(_micros(t), "user_id", ["ts", "event_id"], "event_type", "at")


@query(
    "T07_sessions",
    """WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 hour THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM r GROUP BY user_id, s""",
)
def t07b(t):
    return S.sessions(t.events, "ts", "user_id", "2 hours").select("user_id", F.unix_micros("start").alias("start"), "n")


@query("T09_completed", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)")
def t09(t):
    return S.completed(t.events, "user_id", F.expr("event_type = 'purchase' AND value > 95")).select("event_id")


@query("T10_fixed_delay", "SELECT event_id, epoch_us(ts + INTERVAL 90 second) AS leaves FROM events")
def t10(t):
    return S.delayed(t.events, "ts", "90 SECONDS").select("event_id", F.unix_micros("leaves").alias("leaves"))


@query(
    "T11_hysteresis",
    "SELECT event_id, coalesce(last_value(CASE WHEN value >= 70 THEN 'write' WHEN value < 20 THEN 'read' END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'read') AS mode FROM events",
)
def t11(t):
    return S.hysteresis(t.events, "event_type", ["ts", "event_id"], "value", 70, 20).select("event_id", "mode")


@query("T12_row_first_scheduling")
def t12(t):
    r = t.events.select("event_type", F.col("event_id").alias("at"), "event_id", (F.col("user_id") % 8).alias("row"))
    return S.first_ready_first_come(r, "event_type", "at", "event_id", "row", 2, 9)


@query("T13_polling_monitor", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def t13(t):
    jobs = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return S.polled(t.spark, lambda: jobs)


@query("T14_repeated_samples", "SELECT n_nationkey, trial FROM nation, LATERAL (SELECT unnest(range(3)) AS trial)")
def t14(t):
    return t.nation.select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("trial"))


@query("T16_sampling_switch", "SELECT count(*) AS reported, (SELECT count(*) FROM events) AS seen FROM (SELECT * FROM events ORDER BY event_id LIMIT 100)")
def t16(t):
    first, n = S.sampled(t.events, ["event_id"], 100)
    return first.agg(F.count("*").alias("reported")).crossJoin(n.withColumnRenamed("n", "seen"))


@query("T17_stream_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def t17(t):
    from pyspark.sql import Window

    return t.events.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("seq"))
