"""Streaming jobs run over the events file to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.plans.ingest import RAW_FEED, REFERENCE_TIME, SCORE_TEXT, TEAM_1, FEED_SQL, K, TEAM_2, with_narrative
from wicketlake.plans.registry import register
from wicketlake.session import run_folder
from wicketlake.sources import feed as fd
from wicketlake.sources.star import table
from wicketlake.streaming import context as cx
from wicketlake.streaming import live as lv

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def event_stream(spark, sf_dir):
    """The events file as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def feed_stream(spark, sf_dir):
    score = F.array(
        F.struct(
            F.expr(K).alias("r"),
            F.expr(f"CASE WHEN {K} % 2 = 0 THEN {K} % 11 END").alias("w"),
            F.expr(f"CAST({K} % 20 AS DOUBLE)").alias("o"),
            F.expr(TEAM_1).alias("inning"),
        )
    )
    body = F.struct(
        *[F.expr(sql).alias(name) for name, sql in FEED_SQL.items()],
        F.array(F.expr(TEAM_1), F.expr(TEAM_2)).alias("teams"),
        F.when(F.col("event_type") != "view", score).alias("score"),
    )
    return fd.normalize_feed(fd.parse_feed(event_stream(spark, sf_dir).select(F.to_json(body).alias("payload"))))


@register(
    "stream_ingest",
    f"WITH {RAW_FEED} SELECT concat('match:', id) AS id, concat('Cricket match ', id, ' on ', dateTimeGMT, ' ', matchType, ' at ', venue, "
    "'. Teams: ', team_1, ' vs ', team_2, '. Winner: ', CASE WHEN event_type = 'purchase' THEN team_1 ELSE 'unknown' END, '. Narrative: ', "
    "name, ' finished with status: ', status, '.', CASE WHEN event_type = 'purchase' THEN concat(' ', team_1, ' won the match.') ELSE '' END, "
    f"' Venue: ', venue, '. Score summary: ', {SCORE_TEXT}, '..') AS document FROM feed WHERE matchEnded AND "
    f"try_cast(dateTimeGMT AS TIMESTAMP) >= TIMESTAMP '{REFERENCE_TIME}' - INTERVAL 48 HOURS AND NOT EXISTS ("
    "SELECT 1 FROM orders o WHERE CAST(o.o_orderkey AS VARCHAR) = feed.id AND o.o_orderstatus = 'F')",
)
def stream_ingest(spark, sf_dir):
    root = run_folder(spark, "ingest")
    archived = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("match_id"))
    reference = F.lit(REFERENCE_TIME).cast("timestamp")
    lv.start_ingest(feed_stream(spark, sf_dir), root, with_narrative, archived, reference, 48).awaitTermination()
    return lv.ingested_docs(spark, root).select("id", "document")


@register(
    "stream_ingest_runs",
    f"WITH {RAW_FEED}, done AS (SELECT DISTINCT id, EXISTS (SELECT 1 FROM orders o WHERE CAST(o.o_orderkey AS VARCHAR) = feed.id AND o.o_orderstatus = 'F') AS known "
    f"FROM feed WHERE matchEnded AND try_cast(dateTimeGMT AS TIMESTAMP) >= TIMESTAMP '{REFERENCE_TIME}' - INTERVAL 48 HOURS) "
    "SELECT count(*) AS completed, count(*) FILTER (NOT known AND CAST(id AS BIGINT) % 3 <> 0) AS ingested, count(*) FILTER (known) AS skipped, "
    "count(*) FILTER (NOT known AND CAST(id AS BIGINT) % 3 = 0) AS failed FROM done",
)
def stream_ingest_runs(spark, sf_dir):
    """Counts of an ingest in which every third item has no account."""
    root = run_folder(spark, "ingest")
    archived = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("match_id"))
    reference = F.lit(REFERENCE_TIME).cast("timestamp")
    told = lambda done: with_narrative(done).withColumn("narrative", F.expr("CASE WHEN CAST(id AS BIGINT) % 3 <> 0 THEN narrative END"))
    lv.start_ingest(feed_stream(spark, sf_dir), root, told, archived, reference, 48).awaitTermination()
    runs = lv.ingest_runs(spark, root)
    return runs.agg(*[F.sum(c).alias(c) for c in ("completed", "ingested", "skipped", "failed")])


@register(
    "stream_dedup",
    "SELECT DISTINCT concat(CAST(user_id AS VARCHAR), '-', event_type) AS id FROM events",
)
def stream_dedup(spark, sf_dir):
    root = run_folder(spark, "dedup")
    keyed = event_stream(spark, sf_dir).select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("id"), F.col("ts").cast("timestamp").alias("at")
    )
    query = (
        lv.first_per_match(keyed, "at", "24 hours")
        .select("id")
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("id string").parquet(f"{root}/out")


_SESSIONS = (
    "SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 60 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n "
    "FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) e"
)


@register(
    "context_sessions",
    "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts) + INTERVAL 60 MINUTES, '%Y-%m-%d %H:%M:%S.%f') AS expires, count(*) AS turns "
    f"FROM ({_SESSIONS}) s GROUP BY user_id, n",
)
def context_sessions(spark, sf_dir):
    turns = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    out = cx.sessions(turns, "user_id", "at")
    shown = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.select(
        "user_id", F.date_format("started", shown).alias("started"), F.date_format("expires", shown).alias("expires"), "turns"
    )


# What a turn of the events names: a condition and a value, for each field.
_NAMED = {
    "player": ("event_type = 'click'", "concat('PLAYER_', CAST(event_id % 40 AS STRING))"),
    "team": ("event_type = 'purchase'", "concat('NATION_', CAST(event_id % 25 AS STRING))"),
    "season": ("event_id % 5 = 0", "CAST(2000 + event_id % 20 AS STRING)"),
    "format": ("event_id % 7 = 0", "CASE WHEN event_id % 2 = 0 THEN 'odi' ELSE 't20' END"),
    "action": ("event_type <> 'error'", "event_type"),
}
_SAID = {field: f"CASE WHEN {test} THEN {value} END" for field, (test, value) in _NAMED.items()}


@register(
    "stream_context",
    "SELECT CAST(user_id AS VARCHAR) AS session_key, event_id AS turn_id"
    + "".join(f", last_value({f} IGNORE NULLS) OVER before AS known_{f}" for f in _SAID)
    + " FROM (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n "
    + "FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev"
    + "".join(f", {sql} AS {f}" for f, sql in _SAID.items())
    + " FROM events) e) s WINDOW before AS (PARTITION BY user_id, n ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def stream_context(spark, sf_dir):
    root = run_folder(spark, "context")
    turns = event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("session_key"),
        F.col("event_id").alias("turn_id"),
        F.col("ts").cast("timestamp").alias("at"),
        *[F.expr(sql).alias(f) for f, sql in _SAID.items()],
    )
    query = (
        cx.known_subjects(turns)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(cx.known_ddl(cx.FIELDS)).parquet(f"{root}/out")


@register(
    "stream_alerts",
    f"WITH {RAW_FEED} SELECT venue AS poll_id, id AS match_id, name AS title, status FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY "
    "CASE WHEN matchStarted AND NOT matchEnded THEN 0 ELSE 1 END, event_id) AS n FROM feed) f WHERE n = 1",
)
def stream_alerts(spark, sf_dir):
    root = run_folder(spark, "alerts")
    polled = feed_stream(spark, sf_dir).withColumns({"poll_id": F.col("venue"), "position": F.col("id").cast("bigint")})
    lv.start_alerts(polled, root).awaitTermination()
    return spark.read.parquet(f"{root}/alerts").select("poll_id", "match_id", "title", "status")
