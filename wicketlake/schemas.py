"""Schemas of the stored tables and of the raw inputs."""

from __future__ import annotations

# Delivery table: one row per ball. Column order is part of the format.
DELIVERY_COLUMNS = [
    ("match_id", "string"),
    ("source_folder", "string"),
    ("data_version", "string"),
    ("match_date", "string"),
    ("season", "string"),
    ("match_type", "string"),
    ("gender", "string"),
    ("team_type", "string"),
    ("venue", "string"),
    ("city", "string"),
    ("inning", "int"),
    ("batting_team", "string"),
    ("over", "int"),
    ("ball_in_over", "int"),
    ("ball_id", "string"),
    ("batter", "string"),
    ("bowler", "string"),
    ("non_striker", "string"),
    ("runs_batter", "int"),
    ("runs_extras", "int"),
    ("runs_total", "int"),
    ("non_boundary", "int"),
    ("extras_wides", "int"),
    ("extras_noballs", "int"),
    ("extras_byes", "int"),
    ("extras_legbyes", "int"),
    ("extras_penalty", "int"),
    ("wicket_count", "int"),
    ("wicket_player_out", "string"),
    ("wicket_kind", "string"),
    ("wicket_fielders", "string"),
    ("has_review", "int"),
    ("has_replacements", "int"),
    ("match_winner", "string"),
    ("toss_winner", "string"),
    ("toss_decision", "string"),
]
DELIVERY_DDL = ", ".join(f"`{name}` {kind}" for name, kind in DELIVERY_COLUMNS)

# Raw match file. Fields whose type varies between files are kept as their raw JSON text.
RAW_MATCH_DDL = """
meta struct<match_id: string, revision: string, data_version: string>,
info struct<
  match_id: string, dates: array<string>, season: string, match_type: string, gender: string,
  team_type: string, venue: string, city: string, teams: array<string>,
  players: map<string, array<string>>,
  outcome: struct<winner: string>, toss: struct<winner: string, decision: string>>,
innings array<struct<team: string, overs: array<struct<over: string, deliveries: array<struct<
  batter: string, bowler: string, non_striker: string,
  runs: struct<batter: string, extras: string, total: string, non_boundary: string>,
  non_boundary: string,
  extras: struct<wides: string, noballs: string, byes: string, legbyes: string, penalty: string>,
  wickets: array<struct<player_out: string, kind: string, fielders: array<string>>>,
  review: string, reviews: string, replacements: string>>>>>>,
_corrupt_record string
"""

KNOWLEDGE_DDL = """
id string, category string, sub_intent string, title string, aliases array<string>,
keywords array<string>, answer string, examples array<string>, related_topics array<string>
"""

FEED_ITEM_DDL = """
id string, name string, matchType string, status string, venue string, date string,
dateTimeGMT string, teams array<string>, series_id string,
score array<struct<r: int, w: int, o: double, inning: string>>,
matchStarted boolean, matchEnded boolean, hasSquad boolean, fantasyEnabled boolean, bbbEnabled boolean
"""

SCORECARD_DDL = """
array<struct<inning: string,
 batting: array<struct<batsman: struct<id: string, name: string>, dismissal: string,
   `dismissal-text`: string, dismissal_text: string, bowler: struct<id: string, name: string>,
   catcher: struct<id: string, name: string>, r: int, b: int, `4s`: int, `6s`: int, sr: double>>,
 bowling: array<struct<bowler: struct<id: string, name: string>, o: double, m: int, r: int, w: int,
   nb: int, wd: int, eco: double>>>>
"""

# Documents: the text form of every player, team and match.
DOCUMENT_DDL = "id string, doc_type string, document string, metadata map<string,string>"

QUESTION_CACHE_DDL = (
    "id string, question_text string, document_text string, answer_text string, "
    "response_json string, ui_payload_json string, cached_at bigint"
)

SCORECARD_PAGE_DDL = """
page_id bigint, match_id string, name string, teams array<string>, match_type string,
status string, venue string, start_date string, winner string, source_url string,
score array<struct<inning: string, runs: bigint, wickets: bigint, overs: string>>,
scorecard array<struct<inning: string,
  batting: array<struct<name: string, dismissal: string, runs: bigint, balls: bigint, fours: bigint,
    sixes: bigint, strike_rate: double>>,
  bowling: array<struct<name: string, overs: string, maidens: bigint, runs_conceded: bigint,
    wickets: bigint, noballs: bigint, wides: bigint, economy: double>>,
  total_runs: bigint, total_wickets: bigint, total_overs: string>>
"""
