"""Logs and states over the event table: ledgers, feedback, last writes, windows, session checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.sources.tables import table

GAP = 1800


def ledger(e: DataFrame) -> DataFrame:
    """Events a day and type with how many users, and the total value."""
    return e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


def latest_rows(e: DataFrame) -> DataFrame:
    """The last row (ts, event_id, value) of each user and type."""
    return e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("x")).select("user_id", "event_type", "x.*")


def last_writes(e: DataFrame) -> DataFrame:
    """The last event of each user and type."""
    return e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "event_type", "x.event_id", "x.value")


def feedback(e: DataFrame) -> DataFrame:
    """Events as feedback: item, category, outcome, updated."""
    item = F.get_json_object("props", "$.k").cast("long")
    return e.select(item.alias("item"), (item % 7).alias("category"), F.get(F.array(F.lit("accepted"), F.lit("rejected"), F.lit("snoozed")), (F.col("event_id") % 3).cast("int")).alias("outcome"), "ts", "event_id")


def feedback_summary(f: DataFrame) -> DataFrame:
    return f.groupBy("category").pivot("outcome", ["accepted", "rejected", "snoozed"]).agg(F.count(F.lit(1))).fillna(0)


def feedback_learning(f: DataFrame) -> DataFrame:
    """usefulness = accepted / (accepted + rejected), 1 without any; strict from two rejections that outweigh, blocked
    from three without acceptance. An item's last outcome counts."""
    last = f.groupBy("item", "category").agg(F.max_by("outcome", F.struct("ts", "event_id")).alias("outcome"))
    g = last.groupBy("category").agg(F.count_if(F.col("outcome") == "accepted").alias("acc"), F.count_if(F.col("outcome") == "rejected").alias("rej"))
    use = F.coalesce(F.try_divide(F.col("acc"), F.col("acc") + F.col("rej")), F.lit(1.0))
    return g.select("category", F.round(use, 6).alias("usefulness"), ((F.col("rej") >= 2) & (F.col("rej") > F.col("acc"))).alias("strict"), ((F.col("rej") >= 3) & (F.col("acc") == 0)).alias("blocked"))


def tumbling(e: DataFrame, size: str = "1 hour") -> DataFrame:
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(e: DataFrame, size: str = "6 hours", step: str = "2 hours") -> DataFrame:
    return e.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(e: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events less than the gap apart."""
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).select("user_id", "first", "last", "n")


def session_ranks(e: DataFrame) -> DataFrame:
    """Gaps, running totals, quartiles and ranks within a user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp"))).alias("gap"), F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6).alias("last3"), F.round(F.percent_rank().over(Window.partitionBy("user_id").orderBy("value", "event_id")), 6).alias("standing"))


def review_order(e: DataFrame) -> DataFrame:
    """A blind order within each day: by a hash of the id."""
    w = Window.partitionBy(F.to_date("ts")).orderBy(F.sha2(F.concat(F.lit("review\0"), F.col("event_id").cast("string")), 256))
    return e.select("event_id", F.row_number().over(w).cast("long").alias("place"))


def overlay(e: DataFrame) -> DataFrame:
    """Items with the state that was last set, open where a snooze has ended or nothing was set."""
    f = feedback(e)
    state = f.groupBy("item").agg(F.max_by(F.struct("outcome", "ts"), F.struct("ts", "event_id")).alias("s"))
    items = e.sparkSession.range(0, 120).select(F.col("id").alias("item"))
    snoozed = F.col("s.outcome") == "snoozed"
    status = F.when(F.col("s").isNull(), "open").when(snoozed & (F.unix_timestamp(F.col("s.ts").cast("timestamp")) < F.unix_timestamp(F.lit("2024-01-30").cast("timestamp"))), "open").otherwise(F.col("s.outcome"))
    return items.join(state, "item", "left").select("item", status.alias("status"))


E_ = lambda s, d: table(s, d, "events")
QUERIES = {
    "action_ledger": lambda s, d: ledger(E_(s, d)), "last_write_wins": lambda s, d: last_writes(E_(s, d)), "feedback_summary": lambda s, d: feedback_summary(feedback(E_(s, d))), "feedback_learning": lambda s, d: feedback_learning(feedback(E_(s, d))),
    "events_tumbling": lambda s, d: tumbling(E_(s, d)), "events_sliding": lambda s, d: sliding(E_(s, d)), "events_session": lambda s, d: sessions(E_(s, d)), "event_ranks": lambda s, d: session_ranks(E_(s, d)), "review_order": lambda s, d: review_order(E_(s, d)), "state_overlay": lambda s, d: overlay(E_(s, d)),
}
FB = "WITH f AS (SELECT CAST(props->>'$.k' AS BIGINT) AS item, CAST(props->>'$.k' AS BIGINT) % 7 AS category, ['accepted', 'rejected', 'snoozed'][event_id % 3 + 1] AS outcome, ts, event_id FROM events)"
SQL = {
    "action_ledger": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "last_write_wins": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "feedback_summary": FB + " SELECT category, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'snoozed') AS snoozed FROM f GROUP BY 1",
    "feedback_learning": FB + ", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, category ORDER BY ts DESC, event_id DESC) AS r FROM f) WHERE r = 1), g AS (SELECT category, count(*) FILTER (outcome = 'accepted') AS acc, count(*) FILTER (outcome = 'rejected') AS rej FROM l GROUP BY 1) SELECT category, round(CASE WHEN acc + rej = 0 THEN 1 ELSE acc / (acc + rej) END, 6) AS usefulness, rej >= 2 AND rej > acc AS strict, rej >= 3 AND acc = 0 AS blocked FROM g",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT time_bucket(INTERVAL 2 HOUR, ts) - to_hours(2 * CAST(i AS INT)) AS start, event_type, count(*) AS n FROM events, range(3) t(i) GROUP BY 1, 2",
    "events_session": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k",
    "event_ranks": "SELECT event_id, date_diff('second', date_trunc('second', lag(ts) OVER w), date_trunc('second', ts)) AS gap, ntile(4) OVER w AS quarter, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS last3, round(percent_rank() OVER (PARTITION BY user_id ORDER BY value, event_id), 6) AS standing FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "review_order": "SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY sha256('review' || chr(0) || event_id)) AS place FROM events",
    "state_overlay": FB + ", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts DESC, event_id DESC) AS r FROM f) WHERE r = 1) SELECT i AS item, CASE WHEN outcome IS NULL THEN 'open' WHEN outcome = 'snoozed' AND ts < TIMESTAMP '2024-01-30' THEN 'open' ELSE outcome END AS status FROM range(120) t(i) LEFT JOIN l ON l.item = i",
}
