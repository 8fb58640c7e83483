"""Documents of players, teams and matches over the delivery table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.operators import aggregates as ag
from wicketlake.operators import documents as dc
from wicketlake.plans import sqltext as sq
from wicketlake.plans.registry import over_deliveries, register
from wicketlake.plans.text import _hyphen
from wicketlake.session import written
from wicketlake.sources import documents as store
from wicketlake.sources.star import deliveries, table

ft = sq.float_text

PLAYER_DOC = (
    "concat('Cricket player profile ', player, '. Team ', CASE WHEN team = '' THEN 'Unknown' ELSE team END, '. Role ', role, "
    "'. Indexed matches ', matches, '. Runs ', runs, ', wickets ', wickets, ', batting average ', "
    f"{ft('average')}, ', strike rate ', {ft('strike_rate')}, ', bowling economy ', {ft('economy')}, "
    "'. Fours ', fours, ', sixes ', sixes, '.')"
)
TEAM_DOC = (
    "concat('Cricket team summary for ', team, '. Indexed matches ', matches, ', wins ', wins, ', losses ', losses, "
    f"', no result ', no_result, ', win rate ', {ft('win_rate')}, ' percent. Total batting runs ', runs, "
    f"', average score ', {ft('average_score')}, ', team strike rate ', {ft('strike_rate')}, '.')"
)
MATCH_DOC = (
    "concat('Cricket match ', match_id, ' on ', CASE WHEN match_date = '' THEN 'date unavailable' ELSE match_date END, ' ', "
    "match_type, '. Teams: ', CASE WHEN teams_text = '' THEN 'Unknown' ELSE teams_text END, '. Venue: ', "
    "CASE WHEN venue = '' THEN 'venue unavailable' ELSE venue END, '. Winner: ', CASE WHEN winner = '' THEN 'unknown' ELSE winner END, "
    "'. Innings summary: ', innings_text, '.')"
)


def _id(prefix: str, name: str) -> str:
    return f"concat('{prefix}:', substr({_hyphen(name)}, 1, 48), '-', substr(sha1({name}), 1, 10))"


ALL_SQL = f"""
docs AS (
  SELECT {_id('player', 'player')} AS id, 'player_profile' AS doc_type, {PLAYER_DOC} AS document, '' AS day FROM profiles
  UNION ALL SELECT {_id('team', 'team')}, 'team_summary', {TEAM_DOC}, '' FROM teams
  UNION ALL SELECT concat('match:', match_id), 'match_summary', {MATCH_DOC}, match_date FROM matches)"""
# The header expression appears in both; keep it once.
ALL_MORE = ",".join([sq.PROFILES, sq.TEAMS, sq.MATCHES.replace(sq.HEADERS + ",", ""), ALL_SQL])


def all_docs(spark, sf_dir):
    balls = deliveries(spark, sf_dir)
    return dc.all_docs(ag.player_profiles(balls), ag.team_summaries(balls), ag.match_summaries(balls))


@register("player_docs", over_deliveries(f"SELECT {_id('player', 'player')} AS id, {PLAYER_DOC} AS document FROM profiles", sq.PROFILES))
def player_docs(spark, sf_dir):
    return dc.player_docs(ag.player_profiles(deliveries(spark, sf_dir))).select("id", "document")


@register("team_docs", over_deliveries(f"SELECT {_id('team', 'team')} AS id, {TEAM_DOC} AS document FROM teams", sq.TEAMS))
def team_docs(spark, sf_dir):
    return dc.team_docs(ag.team_summaries(deliveries(spark, sf_dir))).select("id", "document")


@register("match_docs", over_deliveries(f"SELECT concat('match:', match_id) AS id, {MATCH_DOC} AS document FROM matches", sq.MATCHES))
def match_docs(spark, sf_dir):
    return dc.match_docs(ag.match_summaries(deliveries(spark, sf_dir))).select("id", "document")


@register("all_docs", over_deliveries("SELECT id, doc_type, document FROM docs", ALL_MORE))
def all_documents(spark, sf_dir):
    """Matches are summed up once, for their own documents and those of their teams."""
    balls = deliveries(spark, sf_dir)
    records = written(ag.match_records(balls), "matches")
    teams = ag.summarize_teams(ag.teams_of_matches(records))
    return dc.all_docs(ag.player_profiles(balls), teams, ag.summaries_of_matches(records)).select("id", "doc_type", "document")


@register(
    "archive_status",
    over_deliveries(
        "SELECT doc_type, count(*) AS documents, coalesce(min(nullif(day, '')), '') AS min_date, "
        "coalesce(max(nullif(day, '')), '') AS max_date FROM docs GROUP BY doc_type",
        ALL_MORE,
    ),
)
def archive_status(spark, sf_dir):
    return dc.archive_status(all_docs(spark, sf_dir)).drop("built_at")


@register(
    "archive_manifest",
    over_deliveries(
        "SELECT count(*) AS document_count, count(*) FILTER (WHERE doc_type = 'player_profile') AS player_docs, "
        "count(*) FILTER (WHERE doc_type = 'team_summary') AS team_docs, count(*) FILTER (WHERE doc_type = 'match_summary') AS match_docs, "
        "min(nullif(day, '')) AS min_date, max(nullif(day, '')) AS max_date FROM docs",
        ALL_MORE,
    ),
)
def archive_manifest(spark, sf_dir):
    made = store.archive_manifest(all_docs(spark, sf_dir), ag.archive_summary(deliveries(spark, sf_dir)))
    return made.select(
        "document_count", "player_docs", "team_docs", "match_docs",
        F.col("dataset_summary.min_date").alias("min_date"), F.col("dataset_summary.max_date").alias("max_date"),
    )


_PARSED = ["matches", "runs", "wickets", "average", "strike_rate", "economy", "fours", "sixes"]


@register(
    "doc_parse",
    over_deliveries(
        f"SELECT player, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _PARSED)} FROM profiles", sq.PROFILES
    ),
)
def doc_parse(spark, sf_dir):
    """Half of the documents lose their metadata and are read from their text."""
    docs = dc.player_docs(ag.player_profiles(deliveries(spark, sf_dir)))
    stripped = docs.withColumn(
        "metadata",
        F.when(F.substring("id", -1, 1) < "8", F.create_map().cast("map<string,string>")).otherwise(F.col("metadata")),
    )
    return dc.parse_player_docs(stripped).select("player", *_PARSED)


@register(
    "doc_parse_teams",
    over_deliveries(
        "SELECT team, CAST(matches AS DOUBLE) AS matches, CAST(wins AS DOUBLE) AS wins, CAST(losses AS DOUBLE) AS losses, "
        "CAST(no_result AS DOUBLE) AS no_result, win_rate, CAST(runs AS DOUBLE) AS runs, average_score, strike_rate FROM teams",
        sq.TEAMS,
    ),
)
def doc_parse_teams(spark, sf_dir):
    docs = dc.team_docs(ag.team_summaries(deliveries(spark, sf_dir)))
    bare = docs.withColumn("metadata", F.create_map().cast("map<string,string>"))
    return dc.parse_team_docs(bare).drop("id")


@register(
    "docs_where_page",
    "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS doc_type, sha1(text) AS digest FROM documents WHERE lang = 'en' AND source = "
    "(SELECT min(source) FROM documents WHERE lang = 'en') ORDER BY CAST(doc_id AS VARCHAR) LIMIT 25 OFFSET 10",
)
def docs_where_page(spark, sf_dir):
    first_source = (
        table(spark, sf_dir, "documents").filter("lang = 'en'").agg(F.min("source").alias("s")).first().s
    )
    page = store.get_docs(corpus(spark, sf_dir), {"doc_type": "en", "source": first_source}, 25, 10)
    return page.select("id", "doc_type", F.sha1(F.col("document").cast("binary")).alias("digest"))


def corpus(spark, sf_dir):
    """The documents table in the shape of the document store."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("doc_type"),
        F.col("text").alias("document"),
        F.create_map(F.lit("source"), "source").alias("metadata"),
    )


@register(
    "docs_upsert",
    "SELECT id, sha1(document) AS digest FROM (SELECT CAST(d.doc_id AS VARCHAR) AS id, coalesce(u.text, d.text) AS document "
    "FROM documents d LEFT JOIN (SELECT item_id, max(trim(text)) AS text FROM benchmark GROUP BY 1) u ON d.doc_id = u.item_id * 3 "
    "UNION ALL SELECT concat('new-', item_id), trim(text) FROM benchmark WHERE trim(text) <> '') z",
)
def docs_upsert(spark, sf_dir):
    benchmark = table(spark, sf_dir, "benchmark")
    shape = lambda key: benchmark.select(
        key.alias("id"), F.lit("en").alias("doc_type"), F.col("text").alias("document"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    updates = (
        shape((F.col("item_id") * 3).cast("string"))
        .unionByName(shape(F.concat(F.lit("new-"), F.col("item_id").cast("string"))))
        .unionByName(shape(F.lit("")))
    )
    merged = store.upsert_docs(corpus(spark, sf_dir), updates, [F.desc("document")])
    return merged.select("id", F.sha1(F.col("document").cast("binary")).alias("digest"))
