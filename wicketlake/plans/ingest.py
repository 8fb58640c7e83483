"""Feed, revision, provider and page queries over events, customers, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.functions.text import first_non_empty
from wicketlake.operators import aggregates as ag
from wicketlake.plans import sqltext as sq
from wicketlake.plans.registry import over_deliveries, register
from wicketlake.sources import feed as fd
from wicketlake.sources import matches as mt
from wicketlake.sources import pages as pg
from wicketlake.sources.star import deliveries, spread, table

K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
TEAM_1 = "concat('NATION_', CAST(user_id % 25 AS STRING))"
TEAM_2 = "concat('NATION_', CAST((user_id + 1 + user_id % 24) % 25 AS STRING))"
AT = "CAST(date_trunc('second', ts) AS STRING)"

# Fields of a feed item made from an event; text accepted by Spark and other engines.
FEED_SQL = {
    "id": "CAST(event_id AS STRING)",
    "name": f"concat({TEAM_1}, ' vs ', {TEAM_2})",
    "matchType": "CASE WHEN event_type = 'click' THEN 'T20' WHEN event_type = 'error' THEN 'odi' ELSE 'Test' END",
    "status": "CASE WHEN event_type = 'view' THEN 'Match not started' ELSE concat('Event ', event_type) END",
    "venue": "concat('Ground ', CAST(user_id % 12 AS STRING))",
    "date": "CAST(CAST(ts AS DATE) AS STRING)",
    "dateTimeGMT": f"CASE WHEN event_type = 'error' THEN 'to be decided' ELSE {AT} END",
    "series_id": "concat('series-', CAST(user_id % 7 AS STRING))",
    "matchStarted": "event_type <> 'view'",
    "matchEnded": "event_type IN ('purchase', 'signup')",
}


def feed_items(spark, sf_dir):
    """Events as raw feed payloads, parsed and normalised."""
    e = spread(table(spark, sf_dir, "events"))
    score = F.when(
        F.col("event_type") != "view",
        F.array(
            F.struct(
                F.expr(K).alias("r"),
                F.expr(f"CASE WHEN {K} % 2 = 0 THEN {K} % 11 END").alias("w"),
                F.expr(f"CAST({K} % 20 AS DOUBLE)").alias("o"),
                F.expr(TEAM_1).alias("inning"),
            )
        ),
    )
    body = F.struct(
        *[F.expr(sql).alias(name) for name, sql in FEED_SQL.items()],
        F.array(F.expr(TEAM_1), F.expr(TEAM_2)).alias("teams"),
        score.alias("score"),
    )
    payloads = e.select(F.to_json(body).alias("payload"))
    return fd.normalize_feed(fd.parse_feed(payloads))


RAW_FEED = f"feed AS (SELECT event_id, ts, user_id, event_type, {K.replace(', 0)', ')')} AS k, " + ", ".join(
    f"{sql} AS {name}" for name, sql in FEED_SQL.items()
) + f", {TEAM_1} AS team_1, {TEAM_2} AS team_2 FROM events)"
SCORE_TEXT = (
    "CASE WHEN event_type = 'view' THEN '' ELSE concat(team_1, ' ', k, '/', CASE WHEN k % 2 = 0 THEN CAST(k % 11 AS VARCHAR) ELSE '-' END, "
    "' (', k % 20, ')') END"
)


@register(
    "feed_normalize",
    f"WITH {RAW_FEED} SELECT id, name, matchType AS match_type, status, venue, date, dateTimeGMT AS date_time_gmt, "
    "concat(team_1, '|', team_2) AS teams, series_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS innings, "
    f"{SCORE_TEXT} AS score_text, matchStarted AND NOT matchEnded AS live, matchStarted AS match_started, matchEnded AS match_ended, "
    "false AS has_squad FROM feed",
)
def feed_normalize(spark, sf_dir):
    return feed_items(spark, sf_dir).select(
        "id", "name", "match_type", "status", "venue", "date", "date_time_gmt",
        F.array_join("teams", "|").alias("teams"), "series_id", F.size("score").alias("innings"),
        fd.score_line().alias("score_text"), "live", "match_started", "match_ended", "has_squad",
    )


@register(
    "feed_filter",
    f"WITH {RAW_FEED} SELECT id, name, matchType AS match_type, series_id FROM feed WHERE "
    "(contains(team_1, 'NATION_2') OR contains(team_2, 'NATION_2')) AND matchType = 'T20' AND series_id = 'series-3'",
)
def feed_filter(spark, sf_dir):
    return fd.filter_feed(feed_items(spark, sf_dir), "nation 2", "t20", "Series 3").select("id", "name", "match_type", "series_id")


@register("feed_upcoming", f"WITH {RAW_FEED} SELECT id, name, date FROM feed WHERE NOT matchStarted")
def feed_upcoming(spark, sf_dir):
    return fd.upcoming(feed_items(spark, sf_dir)).select("id", "name", "date")


@register("feed_live", f"WITH {RAW_FEED} SELECT id, name, date FROM feed WHERE matchStarted AND NOT matchEnded")
def feed_live(spark, sf_dir):
    return fd.live(feed_items(spark, sf_dir)).select("id", "name", "date")


REFERENCE_TIME = "2024-01-12 00:00:00"


@register(
    "recent_completed",
    f"WITH {RAW_FEED} SELECT id, dateTimeGMT AS date_time_gmt FROM feed WHERE matchEnded AND "
    f"try_cast(dateTimeGMT AS TIMESTAMP) >= TIMESTAMP '{REFERENCE_TIME}' - INTERVAL 48 HOURS",
)
def recent_completed(spark, sf_dir):
    reference = F.lit(REFERENCE_TIME).cast("timestamp")
    return fd.recent_completed(feed_items(spark, sf_dir), reference, 48).select("id", "date_time_gmt")


@register(
    "unindexed_matches",
    f"WITH {RAW_FEED} SELECT id, name FROM feed WHERE matchEnded AND NOT EXISTS ("
    "SELECT 1 FROM orders o WHERE CAST(o.o_orderkey AS VARCHAR) = feed.id AND o.o_orderstatus = 'F')",
)
def unindexed_matches(spark, sf_dir):
    from wicketlake.streaming.live import not_archived

    archived = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("match_id"))
    done = feed_items(spark, sf_dir).filter("match_ended")
    return not_archived(done, archived).select("id", "name")


@register(
    "feed_sorted",
    f"WITH {RAW_FEED} SELECT id, try_cast(dateTimeGMT AS TIMESTAMP) IS NULL AS unreadable, date, "
    "row_number() OVER (ORDER BY try_cast(dateTimeGMT AS TIMESTAMP) DESC NULLS LAST, id) AS position FROM feed",
)
def feed_sorted(spark, sf_dir):
    rows = fd.sorted_feed(feed_items(spark, sf_dir), ascending=False)
    return rows.select("id", fd.at().isNull().alias("unreadable"), "date", "position")


@register(
    "feed_relevance",
    f"WITH {RAW_FEED} SELECT id, name, relevance, row_number() OVER (ORDER BY relevance DESC, coalesce(try_cast(dateTimeGMT AS TIMESTAMP), TIMESTAMP '1970-01-01') DESC, name, id) AS position FROM ("
    "SELECT *, CASE WHEN team_1 = 'NATION_2' OR team_2 = 'NATION_2' THEN 300 "
    "WHEN team_1 LIKE 'NATION\\_2_' ESCAPE '\\' OR team_2 LIKE 'NATION\\_2_' ESCAPE '\\' THEN 90 ELSE 0 END "
    "+ CASE WHEN contains(name, 'NATION_2') THEN 25 ELSE 0 END + CASE WHEN contains(name, 'NATION_2 vs') THEN 15 ELSE 0 END "
    "+ CASE WHEN matchStarted AND NOT matchEnded THEN 40 ELSE 0 END AS relevance FROM feed) r",
)
def feed_relevance(spark, sf_dir):
    return fd.by_relevance(feed_items(spark, sf_dir), "Nation 2", "nation_2 vs").select("id", "name", "relevance", "position")


@register(
    "live_alerts",
    f"WITH {RAW_FEED} SELECT poll_id, id AS match_id, name AS title, concat_ws(' | ', status, nullif({SCORE_TEXT}, '')) AS summary, status FROM ("
    "SELECT *, user_id AS poll_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN matchStarted AND NOT matchEnded THEN 0 ELSE 1 END, "
    "event_id) AS n FROM feed) f WHERE n = 1",
)
def live_alerts(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("poll_id"))
    polled = feed_items(spark, sf_dir).join(keys, "id").withColumn("position", F.col("id").cast("bigint"))
    return fd.live_alerts(polled).drop("teams")


@register(
    "live_docs",
    f"WITH {RAW_FEED} SELECT concat('match:', id) AS id, concat('Cricket match ', id, ' on ', dateTimeGMT, ' ', matchType, ' at ', venue, "
    "'. Teams: ', team_1, ' vs ', team_2, '. Winner: ', CASE WHEN event_type = 'purchase' THEN team_1 ELSE 'unknown' END, '. Narrative: ', "
    "name, ' finished with status: ', status, '.', CASE WHEN event_type = 'purchase' THEN concat(' ', team_1, ' won the match.') ELSE '' END, "
    f"' Venue: ', venue, '. Score summary: ', {SCORE_TEXT}, '..') AS document FROM feed WHERE matchEnded",
)
def live_docs(spark, sf_dir):
    done = feed_items(spark, sf_dir).filter("match_ended")
    return fd.live_docs(with_narrative(done)).select("id", "document")


def with_narrative(done):
    """Completed feed items with a winner and their account."""
    told = done.withColumn("winner", F.when(F.col("status") == "Event purchase", F.get("teams", F.lit(0))).otherwise(""))
    told = told.withColumns({"top_batters": F.lit(""), "top_bowlers": F.lit("")})
    return told.withColumn("narrative", fd.narrative())


@register(
    "latest_revision",
    f"SELECT user_id, event_id, revision FROM (SELECT user_id, event_id, {K.replace(', 0)', ')')} AS revision, row_number() OVER ("
    f"PARTITION BY user_id ORDER BY {K.replace(', 0)', ')')} DESC, ts DESC, event_id) AS n FROM events) e WHERE n = 1",
)
def latest_revision(spark, sf_dir):
    files = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("match_id"), F.expr(K).alias("revision"), F.col("ts").alias("modified"), F.col("event_id").alias("path")
    )
    return mt.latest_revisions(files).select(F.col("match_id").alias("user_id"), F.col("path").alias("event_id"), "revision")


@register(
    "source_counters",
    "WITH picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events "
    "WHERE value >= 5) z WHERE n = 1) SELECT e.event_type AS source_folder, count(*) AS json_files_found, "
    "coalesce(any_value(p.n), 0) AS selected_match_files, coalesce(any_value(p.w), 0) AS rows_written, "
    "count(*) FILTER (WHERE value < 5) AS skipped_files, count(*) - count(*) FILTER (WHERE value < 5) - coalesce(any_value(p.n), 0) AS duplicate_files "
    "FROM events e LEFT JOIN (SELECT event_type, count(*) AS n, 2 * count(*) AS w FROM picked GROUP BY 1) p USING (event_type) GROUP BY e.event_type",
)
def source_counters(spark, sf_dir):
    files = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_folder"), F.col("event_id").alias("path"), F.col("user_id").alias("match_id"),
        F.lit(1).alias("revision"), F.col("ts").alias("modified"),
        F.when(F.col("value") < 5, F.col("props")).alias(mt.CORRUPT),
    )
    selected = mt.latest_revisions(mt.readable(files))
    rows = selected.select("source_folder", F.explode(F.array(F.lit(1), F.lit(2))).alias("ball"))
    return mt.source_counters(files, selected, rows)


@register(
    "payload_coalesce",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN CAST(70000 + c_custkey AS VARCHAR) "
    "ELSE CAST(10000 + c_custkey AS VARCHAR) END AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS name, "
    "concat('slug-', c_nationkey) AS team_slug, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS team FROM customer",
)
def payload_coalesce(spark, sf_dir):
    key = F.col("c_custkey")
    items = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(key % 3 == 0, key.cast("string")).otherwise(" ").alias("id"),
        F.lit(None).cast("string").alias("objectId"),
        F.lit("").alias("playerId"),
        F.when(key % 3 == 1, F.concat(F.lit("https://example.org/player/some-name/"), (key + 70000).cast("string"))).alias("url"),
        F.lit("").alias("link"),
        F.when(key % 3 == 2, F.concat(F.lit("/cricketers/"), (key + 10000).cast("string"), F.lit("-x"))).alias("href"),
        F.lit("").alias("mobileUrl"),
        F.when(key % 2 == 0, F.col("c_name")).alias("displayName"),
        F.lit("").alias("name"),
        F.col("c_mktsegment").alias("title"),
        F.lit(None).cast("string").alias("teamSlug"),
        F.concat(F.lit("slug-"), F.col("c_nationkey").cast("string")).alias("team_slug"),
        F.lit(" ").alias("subtitle"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("team"),
        F.lit("").alias("description"),
    )
    ids = fd.search_item_id("id", "objectId", "playerId", links=("url", "link", "href", "mobileUrl"))
    return items.select(
        "c_custkey", ids.alias("id"),
        first_non_empty("displayName", "name", "title").alias("name"),
        first_non_empty("teamSlug", "team_slug").alias("team_slug"),
        first_non_empty("subtitle", "team", "description").alias("team"),
    )


_LABEL = (
    "CASE event_type WHEN 'view' THEN 'Mat' WHEN 'click' THEN 'Runs scored' WHEN 'purchase' THEN 'Batting Avg.' "
    "WHEN 'signup' THEN 'SR' ELSE 'Best bowling' END"
)


@register(
    "stat_pivot",
    "WITH e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'matches' WHEN 'click' THEN 'runs' WHEN 'purchase' THEN 'average' "
    "WHEN 'signup' THEN 'strike_rate' ELSE 'best_bowling' END AS metric, "
    f"CAST({K.replace(', 0)', ')')} AS VARCHAR) AS value, event_id FROM events) SELECT user_id, "
    + ", ".join(
        f"arg_max(value, event_id) FILTER (WHERE metric = '{m}') AS {m}" for m, _ in fd.STAT_LABELS
    )
    + " FROM e GROUP BY user_id",
)
def stat_pivot(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(
        "user_id", F.expr(_LABEL).alias("label"), F.expr(K).cast("string").alias("value"), F.col("event_id").alias("seq")
    )
    return fd.stats_from_entries(entries, "user_id", "seq")


@register(
    "career_rollup",
    over_deliveries(
        "SELECT player, coalesce(bm, 0) AS matches, coalesce(br, 0) AS runs, "
        "CASE WHEN bi - bn > 0 THEN round(CAST(br AS DOUBLE) / (bi - bn), 2) ELSE 0.0 END AS average, "
        "CASE WHEN bb > 0 THEN round(CAST(br AS DOUBLE) / bb * 100, 2) ELSE 0.0 END AS strike_rate, coalesce(w, 0) AS wickets, "
        "CASE WHEN ob > 0 THEN round(CAST(oc AS DOUBLE) / (CAST(ob AS DOUBLE) / 6), 2) ELSE 0.0 END AS economy, "
        "coalesce(f, 0) AS fours, coalesce(s, 0) AS sixes FROM ("
        "SELECT player, sum(m) AS bm, sum(i) AS bi, sum(i - d) AS bn, sum(r) AS br, sum(b) AS bb, sum(f) AS f, sum(s) AS s FROM ("
        "SELECT batter AS player, match_type, count(DISTINCT match_id) AS m, count(DISTINCT concat(match_id, '|', inning)) AS i, "
        "count(*) FILTER (WHERE wicket_player_out = batter) AS d, sum(runs_batter) AS r, "
        f"count(*) FILTER (WHERE {sq.LEGAL}) AS b, count(*) FILTER (WHERE runs_batter = 4) AS f, count(*) FILTER (WHERE runs_batter = 6) AS s "
        "FROM deliveries GROUP BY 1, 2) x GROUP BY 1) bat FULL JOIN (SELECT bowler AS player, "
        f"count(*) FILTER (WHERE {sq.LEGAL}) AS ob, sum(runs_batter + extras_wides + extras_noballs) AS oc, "
        f"count(*) FILTER (WHERE {sq.CREDITED}) AS w FROM deliveries GROUP BY 1) bowl USING (player)"
    ),
)
def career_rollup(spark, sf_dir):
    """Per-format rows of every player, then the career."""
    balls = deliveries(spark, sf_dir)
    legal = "CASE WHEN extras_wides = 0 AND extras_noballs = 0 THEN 1 ELSE 0 END"
    innings = balls.groupBy(F.col("batter").alias("player"), "match_type", "match_id", "inning").agg(
        F.sum("runs_batter").alias("runs"),
        F.sum(F.expr(legal)).alias("balls"),
        F.sum(F.expr("CASE WHEN runs_batter = 4 THEN 1 ELSE 0 END")).alias("fours"),
        F.sum(F.expr("CASE WHEN runs_batter = 6 THEN 1 ELSE 0 END")).alias("sixes"),
        F.sum(F.expr("CASE WHEN wicket_player_out = batter THEN 1 ELSE 0 END")).alias("outs"),
    )
    per_match = innings.groupBy("player", "match_type", "match_id").agg(
        F.count(F.lit(1)).alias("innings"), *[F.sum(c).alias(c) for c in ("runs", "balls", "fours", "sixes", "outs")]
    )
    bat = per_match.groupBy("player", "match_type").agg(
        F.lit("bat").alias("side"),
        F.count(F.lit(1)).alias("matches"),
        F.sum("innings").alias("innings"),
        (F.sum("innings") - F.sum("outs")).alias("notouts"),
        *[F.sum(c).alias(c) for c in ("runs", "balls", "fours", "sixes")],
        F.lit(0).cast("bigint").alias("wickets"),
    )
    from wicketlake.functions.rates import credited_wicket

    zero = F.lit(0).cast("bigint")
    bowl = balls.groupBy(F.col("bowler").alias("player"), "match_type").agg(
        F.lit("bowl").alias("side"),
        F.sum(F.expr(legal)).alias("balls"),
        F.sum(F.expr("runs_batter + extras_wides + extras_noballs")).alias("runs"),
        F.sum(F.when(credited_wicket(), 1).otherwise(0)).alias("wickets"),
    ).withColumns({c: zero for c in ("matches", "innings", "notouts", "fours", "sixes")})
    return fd.career_rollup(bat.unionByName(bowl))


@register(
    "profile_merge",
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN concat('label ', l.doc_id) ELSE d.source END AS source, d.lang, "
    "CASE WHEN coalesce(l.quality, 0) > 0 OR coalesce(l.toxic, 0) > 0 THEN l.quality ELSE d.n_chars % 5 END AS quality, "
    "CASE WHEN coalesce(l.quality, 0) > 0 OR coalesce(l.toxic, 0) > 0 THEN l.toxic ELSE d.n_chars % 2 END AS toxic, "
    "CASE WHEN coalesce(l.quality, 0) > 0 OR coalesce(l.toxic, 0) > 0 THEN 'archive' ELSE 'provider' END AS stats_source "
    "FROM documents d FULL JOIN labels l USING (doc_id)",
)
def profile_merge(spark, sf_dir):
    archive = table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("label "), F.col("doc_id").cast("string")).alias("source"), F.lit("").alias("lang"), "quality", "toxic"
    )
    provider = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.col("n_chars") % 5).alias("quality"), (F.col("n_chars") % 2).alias("toxic")
    )
    return fd.merge_profiles(archive, provider, "doc_id", ["source", "lang"], ["quality", "toxic"])


@register(
    "log_report",
    "SELECT event_type AS category, count(*) AS total, count(*) FILTER (WHERE value < 50) AS passed, "
    "round(CAST(sum(CAST(value AS DECIMAL(20, 4))) AS DOUBLE) / count(*), 2) AS mean_latency, "
    "round(CAST(count(*) FILTER (WHERE value < 50) AS DOUBLE) / count(*) * 100, 2) AS pass_rate FROM events GROUP BY 1",
)
def log_report(spark, sf_dir):
    return ag.log_report(table(spark, sf_dir, "events"), "event_type", F.col("value") < 50, "value")


@register("log_slowest", "SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 5")
def log_slowest(spark, sf_dir):
    return ag.slowest(table(spark, sf_dir, "events"), "value", "event_id").select("event_id", "event_type", "value")


def _title_sql() -> str:
    title = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        title = f"replace({title}, {sq.quoted(entity)}, {sq.quoted(char)})"
    return f"trim(regexp_replace({title}, '\\s+', ' ', 'g'))"


@register(
    "pages_extract",
    "SELECT page_id, CASE WHEN u <> '' THEN u ELSE substr(regexp_replace(lower(name), '[^\\p{L}\\p{N}_]+', '-', 'g'), 1, 48) || '-' || substr(sha256(name), 1, 12) END AS match_id, "
    f"name, 0 AS innings FROM (SELECT page_id, {_title_sql()} AS name, regexp_extract(url, '/([0-9]{{5,}})(?:[/?#]|$)', 1) AS u FROM pages) p",
)
def pages_extract(spark, sf_dir):
    out = pg.extract_scorecards(spread(table(spark, sf_dir, "pages")))
    return out.select(
        "page_id", "match_id", "name", F.coalesce(F.size("scorecard"), F.lit(0)).alias("innings"),
    )
