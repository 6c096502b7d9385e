"""Queries that run a stream to its end over rows derived from the driver's tables, and the DuckDB SQL for what it must have put out."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import speech
from quillspark.streaming import capture, live
from quillspark.streaming.drained import drained

from . import adapters as ad
from .oracles import SQL as BATCH

LATER = "interval 400 days"


def _with_heartbeats(rows, **nothing):
    """``rows`` and after each one a heartbeat of stream -1, long after, whose columns of ``nothing`` have those values."""
    beat = {"stream": F.lit(-1).cast("long"), "ts": F.expr(f"ts + {LATER}"), **{k: F.lit(v).cast(dict(rows.dtypes)[k]) for k, v in nothing.items()}}
    both = F.array(F.struct(*rows.columns), F.struct(*[beat.get(c, F.col(c)).alias(c) for c in rows.columns]))
    return rows.select(F.inline(both))


def live_stalls(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.lit(True).alias("seen"))
    found = drained(rows, lambda d: live.stall_events(d, 36000.0))
    return found.select("stream", "event", F.unix_millis("since").alias("since_ms"), "gap_seconds")


def live_speech_chunks(spark, sf_dir):
    rows = ad.levels(spark, sf_dir).select("stream", (F.col("seq") - 1).alias("frame"), (F.col("db") - 20).alias("db"), F.timestamp_millis(F.col("seq") * speech.FRAME_MS).alias("ts"))
    pauses = speech.Pauses(pre_roll=2, flush=3, carried=6, least=3, target=8, most=16, overlap=2)
    chunks = lambda d: live.idle_chunks(_with_heartbeats(d, frame=None).select(F.col("stream").alias("meeting_id"), F.lit("Microphone").alias("source"), "frame", "db", "ts"), pauses)
    return drained(rows, chunks)


def live_timeline(spark, sf_dir):
    day = 86_400_000
    rows = ad.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), (F.least(F.col("value") / 250.0, F.lit(2.0)) - 1.0).alias("value"))
    rows = rows.select("stream", F.floor(F.unix_millis("ts") / day).alias("tick"), "value", "ts")
    found = drained(rows, lambda d: live.live_timeline(_with_heartbeats(d, tick=None), day))
    return found.withColumn("value", F.round("value", 6))


def live_drift(spark, sf_dir):
    backlog = 300 + F.col("stream") % 5 * 150 + F.col("seq") % 7 * 10
    rows = ad.levels(spark, sf_dir).select("stream", "seq", backlog.alias("backlog"), F.lit(0).cast("long").alias("inserted"), F.array_repeat(F.col("value").cast("float"), 3).alias("samples"))
    return drained(rows, lambda d: live.without_drift(d, 1000, 1.0)).select("stream", "seq", "dropped", F.size("samples").cast("long").alias("kept"))


def live_window_levels(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), "value")
    found = drained(rows, lambda d: capture.window_levels(_with_heartbeats(d, value=None), "1 day")).where("stream >= 0")
    return found.select("stream", F.unix_seconds("frame.start").alias("begin"), "n", F.round("energy", 4).alias("energy"), "peak")


def live_sessions(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("stream"), F.col("ts").cast("timestamp").alias("ts"))
    found = drained(rows, lambda d: capture.sessions(_with_heartbeats(d), "12 hours")).where("stream >= 0")
    return found.select("stream", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n")


QUERIES = {f.__name__: f for f in (live_stalls, live_speech_chunks, live_timeline, live_drift, live_window_levels, live_sessions)}
SQL = {
    "live_stalls": """WITH w AS (SELECT user_id AS stream, ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS back, max(ms) OVER () - 250 AS horizon FROM (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events)),
g AS (SELECT *, CAST(coalesce(back, horizon) - ms AS DOUBLE) / 1000 AS gap FROM w)
SELECT stream, 'stalled' AS event, ms AS since_ms, CAST(36000 AS DOUBLE) AS gap_seconds FROM g WHERE gap > 36000
UNION ALL SELECT stream, 'resumed', ms, gap FROM g WHERE gap > 36000 AND back IS NOT NULL""",
    "live_speech_chunks": BATCH["speech_chunks"],
    "live_timeline": BATCH["level_gap_filled"],
    "live_window_levels": "SELECT user_id AS stream, epoch_us(ts) // 86400000000 * 86400 AS begin, count(*) AS n, round(sum(value * value), 4) AS energy, max(abs(value)) AS peak FROM events GROUP BY ALL",
    "live_sessions": """WITH w AS (SELECT user_id AS stream, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 43200000000 AS gap FROM events),
s AS (SELECT stream, us, count(*) FILTER (gap) OVER (PARTITION BY stream ORDER BY us) AS k FROM w)
SELECT stream, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY stream, k""",
    "live_drift": f"SELECT *, 3 - least(dropped, 3) AS kept FROM ({BATCH['drift_drops']})",
}
