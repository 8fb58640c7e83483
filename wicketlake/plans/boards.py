"""Aggregates, leaderboards and listings over the delivery table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.functions import rates
from wicketlake.functions.text import pair_key
from wicketlake.operators import aggregates as ag
from wicketlake.operators import boards as bd
from wicketlake.operators.ordered import numbered
from wicketlake.plans import sqltext as sq
from wicketlake.plans.registry import over_deliveries, register
from wicketlake.sources.star import deliveries, table

TEAM_A, TEAM_B = "NATION_3", "NATION_7"
PROFILE_COLUMNS = [
    "player", "team", "role", "matches", "runs", "balls", "fours", "sixes", "dismissals", "bowling_balls",
    "runs_conceded", "wickets", "average", "strike_rate", "economy",
]
BOARD_COLUMNS = ["rank", "player", "team", "value", "matches", "runs", "wickets", "average", "strike_rate", "economy", "fours", "sixes"]


def profiles(spark, sf_dir):
    return ag.player_profiles(deliveries(spark, sf_dir))


def teams_of_matches(spark, sf_dir):
    return ag.match_teams(deliveries(spark, sf_dir))


@register(
    "scan_deliveries",
    over_deliveries(
        "SELECT match_id, match_date, season, match_type, venue, inning, batting_team, batter, bowler, "
        "runs_batter, runs_total, extras_wides, extras_noballs, extras_byes, non_boundary, wicket_count, "
        "wicket_kind, wicket_player_out, match_winner, row_seq FROM deliveries WHERE trim(match_id) <> ''"
    ),
)
def scan_deliveries(spark, sf_dir):
    return ag.valid(deliveries(spark, sf_dir)).select(
        "match_id", "match_date", "season", "match_type", "venue", "inning", "batting_team", "batter", "bowler",
        "runs_batter", "runs_total", "extras_wides", "extras_noballs", "extras_byes", "non_boundary",
        "wicket_count", "wicket_kind", "wicket_player_out", "match_winner", "row_seq",
    )


@register(
    "team_batting",
    over_deliveries(
        f"SELECT batting_team AS team, count(DISTINCT match_id) AS matches, sum(runs_total) AS runs, "
        f"count(*) FILTER (WHERE {sq.LEGAL}) AS balls FROM deliveries GROUP BY 1"
    ),
)
def team_batting(spark, sf_dir):
    return ag.team_batting(deliveries(spark, sf_dir))


@register(
    "player_batting",
    over_deliveries(
        f"SELECT batter AS player, count(DISTINCT match_id) AS matches, sum(runs_batter) AS runs, "
        f"count(*) FILTER (WHERE {sq.LEGAL}) AS balls, "
        "count(*) FILTER (WHERE runs_batter = 4 AND non_boundary = 0) AS fours, "
        "count(*) FILTER (WHERE runs_batter = 6 AND non_boundary = 0) AS sixes FROM deliveries GROUP BY 1"
    ),
)
def player_batting(spark, sf_dir):
    return ag.player_batting(deliveries(spark, sf_dir))


@register(
    "player_bowling",
    over_deliveries(
        f"SELECT bowler AS player, count(DISTINCT match_id) AS matches, count(*) FILTER (WHERE {sq.LEGAL}) AS balls, "
        "sum(runs_batter + extras_wides + extras_noballs) AS runs_conceded, "
        f"count(*) FILTER (WHERE {sq.CREDITED}) AS wickets FROM deliveries GROUP BY 1"
    ),
)
def player_bowling(spark, sf_dir):
    return ag.player_bowling(deliveries(spark, sf_dir))


@register(
    "player_dismissals",
    over_deliveries(
        "SELECT wicket_player_out AS player, count(*) AS dismissals FROM deliveries "
        "WHERE wicket_player_out <> '' GROUP BY 1"
    ),
)
def player_dismissals(spark, sf_dir):
    return ag.player_dismissals(deliveries(spark, sf_dir))


@register("player_profiles", over_deliveries(f"SELECT {', '.join(PROFILE_COLUMNS)} FROM profiles", sq.PROFILES))
def player_profiles(spark, sf_dir):
    return profiles(spark, sf_dir).select(*PROFILE_COLUMNS)


@register("player_roles", over_deliveries("SELECT player, runs, wickets, role FROM profiles", sq.PROFILES))
def player_roles(spark, sf_dir):
    return profiles(spark, sf_dir).select("player", "runs", "wickets", "role")


@register(
    "modal_team",
    over_deliveries("SELECT player, team, team_balls AS balls FROM sides", sq.PROFILES),
)
def modal_team(spark, sf_dir):
    return ag.modal_team(deliveries(spark, sf_dir))


@register(
    "innings_totals",
    over_deliveries("SELECT match_id, inning_key, team, runs, wickets, balls FROM innings", sq.MATCHES),
)
def innings_totals(spark, sf_dir):
    return ag.innings_totals(deliveries(spark, sf_dir))


@register(
    "match_summaries",
    over_deliveries(
        "SELECT match_id, match_date, season, match_type, venue, city, winner, teams_text, innings_text FROM matches",
        sq.MATCHES,
    ),
)
def match_summaries(spark, sf_dir):
    from wicketlake.operators.documents import innings_text

    return ag.match_summaries(deliveries(spark, sf_dir)).select(
        "match_id", "match_date", "season", "match_type", "venue", "city", "winner",
        F.array_join("teams", " vs ").alias("teams_text"),
        innings_text().alias("innings_text"),
    )


@register(
    "team_results",
    over_deliveries("SELECT match_id, team, match_date, winner, outcome FROM match_teams", sq.MATCH_TEAMS),
)
def team_results(spark, sf_dir):
    return teams_of_matches(spark, sf_dir).select("match_id", "team", "match_date", "winner", "outcome")


TEAM_COLUMNS = ["team", "matches", "wins", "losses", "no_result", "runs", "balls", "win_rate", "average_score", "strike_rate"]


@register("team_summaries", over_deliveries(f"SELECT {', '.join(TEAM_COLUMNS)} FROM teams", sq.TEAMS))
def team_summaries(spark, sf_dir):
    return ag.team_summaries(deliveries(spark, sf_dir)).select(*TEAM_COLUMNS)


_PAIRS = """
meetings AS (
  SELECT x.match_id, x.winner, x.team AS team_a, y.team AS team_b
  FROM match_teams x JOIN match_teams y USING (match_id) WHERE x.team < y.team)"""


@register(
    "head_to_head_all",
    over_deliveries(
        "SELECT team_a, team_b, count(*) AS matches, count(*) FILTER (WHERE winner = team_a) AS wins_a, "
        "count(*) FILTER (WHERE winner = team_b) AS wins_b, "
        "count(*) FILTER (WHERE winner <> team_a AND winner <> team_b) AS no_result, "
        "concat(team_a, '__', team_b) AS pair FROM meetings GROUP BY team_a, team_b",
        sq.MATCH_TEAMS + "," + _PAIRS,
    ),
)
def head_to_head_all(spark, sf_dir):
    return ag.head_to_head_all(teams_of_matches(spark, sf_dir))


@register(
    "head_to_head",
    over_deliveries(
        f"SELECT '{TEAM_A}' AS team_a, '{TEAM_B}' AS team_b, count(*) AS matches, "
        f"count(*) FILTER (WHERE winner = '{TEAM_A}') AS wins_a, count(*) FILTER (WHERE winner = '{TEAM_B}') AS wins_b, "
        f"count(*) FILTER (WHERE winner NOT IN ('{TEAM_A}', '{TEAM_B}')) AS no_result "
        f"FROM meetings WHERE team_a = least('{TEAM_A}', '{TEAM_B}') AND team_b = greatest('{TEAM_A}', '{TEAM_B}')",
        sq.MATCH_TEAMS + "," + _PAIRS,
    ),
)
def head_to_head(spark, sf_dir):
    return ag.head_to_head(teams_of_matches(spark, sf_dir), TEAM_A, TEAM_B)


@register(
    "filter_options",
    over_deliveries(
        "SELECT 'team' AS kind, batting_team AS value FROM deliveries WHERE batting_team <> '' GROUP BY 2 "
        "UNION ALL SELECT 'season', season FROM deliveries WHERE season <> '' GROUP BY 2"
    ),
)
def filter_options(spark, sf_dir):
    return ag.filter_options(deliveries(spark, sf_dir))


@register(
    "archive_summary",
    over_deliveries(
        "SELECT (SELECT count(DISTINCT match_id) FROM deliveries) AS matches, (SELECT count(*) FROM profiles) AS players, "
        "(SELECT count(DISTINCT batting_team) FROM deliveries) AS teams, "
        "(SELECT min(match_date) FROM deliveries) AS min_date, (SELECT max(match_date) FROM deliveries) AS max_date",
        sq.PROFILES,
    ),
)
def archive_summary(spark, sf_dir):
    return ag.archive_summary(deliveries(spark, sf_dir))


@register(
    "dataset_manifest",
    over_deliveries(
        "SELECT count(*) AS rows_written, count(DISTINCT match_id) AS matches_with_rows, "
        "count(*) FILTER (WHERE wicket_count > 0) AS deliveries_with_wickets, 0 AS deliveries_with_reviews, "
        "0 AS deliveries_with_replacements, min(match_date) AS min_date, max(match_date) AS max_date, "
        "count(DISTINCT season) AS distinct_seasons, count(DISTINCT venue) AS distinct_venues, "
        "string_agg(DISTINCT match_type, ',' ORDER BY match_type) AS match_types FROM deliveries"
    ),
)
def dataset_manifest(spark, sf_dir):
    flat = deliveries(spark, sf_dir).withColumn("has_review", F.lit(0)).withColumn("has_replacements", F.lit(0))
    return ag.dataset_profile(flat).withColumn("match_types", F.array_join("match_types", ","))


@register(
    "ball_numbering",
    over_deliveries(
        "SELECT match_id, inning, row_seq, row_number() OVER (PARTITION BY match_id ORDER BY inning, row_seq) AS ball_no "
        "FROM deliveries"
    ),
)
def ball_numbering(spark, sf_dir):
    balls = deliveries(spark, sf_dir).select("match_id", "inning", "row_seq")
    return numbered(balls, ["match_id"], "inning", ["row_seq"], "ball_no").select(
        "match_id", "inning", "row_seq", "ball_no"
    )


def _board_sql(metric: str, where: str = "true", limit: int = 10) -> str:
    others = [c for c in BOARD_COLUMNS if c not in ("rank", "value")]
    return over_deliveries(
        f"SELECT row_number() OVER (ORDER BY {metric} DESC, matches DESC, player) AS rank, {metric} AS value, "
        f"{', '.join(others)} FROM profiles WHERE {where} ORDER BY rank LIMIT {limit}",
        sq.PROFILES,
    )


@register("leaderboard_runs", _board_sql("runs"))
def leaderboard_runs(spark, sf_dir):
    return bd.leaderboard(profiles(spark, sf_dir), "runs").select(*BOARD_COLUMNS)


@register("leaderboard_wickets", _board_sql("wickets"))
def leaderboard_wickets(spark, sf_dir):
    return bd.leaderboard(profiles(spark, sf_dir), "wickets").select(*BOARD_COLUMNS)


@register("leaderboard_economy", _board_sql("economy", "matches >= 20 AND wickets >= 25"))
def leaderboard_economy(spark, sf_dir):
    return bd.leaderboard(profiles(spark, sf_dir), "economy").select(*BOARD_COLUMNS)


@register("leaderboard_qualified", _board_sql("strike_rate", "matches >= 20 AND runs >= 500"))
def leaderboard_qualified(spark, sf_dir):
    return bd.leaderboard(profiles(spark, sf_dir), "strike_rate").select(*BOARD_COLUMNS)


@register(
    "team_leaders",
    over_deliveries(
        "SELECT * FROM (SELECT team, player, runs, matches, row_number() OVER (PARTITION BY team ORDER BY runs DESC, "
        "matches DESC, player) AS rank FROM profiles WHERE team <> '') r WHERE rank <= 3",
        sq.PROFILES,
    ),
)
def team_leaders(spark, sf_dir):
    return bd.top_players_per_team(profiles(spark, sf_dir), "runs", 3).select("team", "player", "runs", "matches", "rank")


@register(
    "teams_by_win_rate",
    over_deliveries("SELECT team, matches, wins, win_rate FROM teams ORDER BY win_rate DESC, team LIMIT 5", sq.TEAMS),
)
def teams_by_win_rate(spark, sf_dir):
    return bd.teams_by_win_rate(ag.team_summaries(deliveries(spark, sf_dir))).select("team", "matches", "wins", "win_rate")


@register(
    "recent_matches",
    over_deliveries(
        "SELECT match_id, match_date, match_type, venue, winner FROM headers ORDER BY match_date DESC, match_id LIMIT 5",
        sq.HEADERS,
    ),
)
def recent_matches(spark, sf_dir):
    return bd.recent_matches(ag.match_summaries(deliveries(spark, sf_dir))).select(
        "match_id", "match_date", "match_type", "venue", "winner"
    )


_SQUAD = """
squad AS (
  SELECT team, player, matches, runs, wickets,
    CASE role WHEN 'Batter' THEN 'Batsman' ELSE role END AS squad_role,
    row_number() OVER (PARTITION BY team ORDER BY matches DESC, runs DESC, wickets DESC, player) AS position,
    count(*) OVER (PARTITION BY team) AS total_players
  FROM profiles WHERE team <> '')"""
_SQUAD_COLUMNS = ["team", "player", "matches", "runs", "wickets", "squad_role", "position", "total_players"]


@register("team_squad", over_deliveries("SELECT * FROM squad", sq.PROFILES + "," + _SQUAD))
def team_squad(spark, sf_dir):
    return bd.squads(profiles(spark, sf_dir)).select(*_SQUAD_COLUMNS)


@register("playing_xi", over_deliveries("SELECT * FROM squad WHERE position <= 11", sq.PROFILES + "," + _SQUAD))
def playing_xi(spark, sf_dir):
    return bd.squads(profiles(spark, sf_dir), 11).select(*_SQUAD_COLUMNS)


@register(
    "team_matches_page",
    over_deliveries(
        f"SELECT match_id, team, match_date, match_type, venue, winner, outcome FROM match_teams WHERE team = '{TEAM_A}' "
        "AND match_date LIKE '1998%' AND match_type = 'T20' ORDER BY match_date DESC, match_id LIMIT 10 OFFSET 5",
        sq.MATCH_TEAMS,
    ),
)
def team_matches_page(spark, sf_dir):
    page = bd.matches_for_team(teams_of_matches(spark, sf_dir), "nation_3", 10, 5, "1998", "t20")
    return page.select("match_id", "team", "match_date", "match_type", "venue", "winner", "outcome")


@register(
    "matches_between",
    over_deliveries(
        "SELECT x.match_id, x.match_date, x.match_type, x.venue, x.winner FROM match_teams x JOIN match_teams y "
        f"USING (match_id) WHERE x.team = '{TEAM_A}' AND y.team = '{TEAM_B}'",
        sq.MATCH_TEAMS,
    ),
)
def matches_between(spark, sf_dir):
    return bd.matches_between(teams_of_matches(spark, sf_dir), [TEAM_A, TEAM_B])


@register(
    "latest_meeting",
    over_deliveries(
        "SELECT team_a, team_b, match_id, match_date, match_type, venue, winner FROM ("
        "SELECT r.team_a, r.team_b, m.match_id, m.match_date, m.match_type, m.venue, m.winner, "
        "row_number() OVER (PARTITION BY r.team_a, r.team_b ORDER BY m.match_date DESC, m.match_id DESC) AS n "
        "FROM (SELECT a.n_name AS team_a, b.n_name AS team_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey "
        "AND a.n_name <> b.n_name UNION ALL SELECT n_name, '' FROM nation) r "
        "JOIN match_teams m ON m.team = r.team_a LEFT JOIN match_teams o ON o.match_id = m.match_id AND o.team = r.team_b "
        "WHERE r.team_b = '' OR o.team IS NOT NULL) z WHERE n = 1",
        sq.MATCH_TEAMS,
    ),
)
def latest_meeting(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    pairs = (
        nation.select(F.col("n_name").alias("team_a"), "n_regionkey")
        .join(nation.select(F.col("n_name").alias("team_b"), "n_regionkey"), "n_regionkey")
        .filter("team_a != team_b")
        .select("team_a", "team_b")
    )
    requests = pairs.unionByName(nation.select(F.col("n_name").alias("team_a"), F.lit("").alias("team_b")))
    return bd.latest_meetings(teams_of_matches(spark, sf_dir), requests)


_COMPARED = ["runs", "average", "strike_rate", "wickets"]


@register(
    "compare_entities",
    over_deliveries(
        "SELECT l.player AS left_name, r.player AS right_name, m.metric, m.lv AS left_value, m.rv AS right_value, "
        "CASE WHEN m.lv = m.rv THEN 'level' WHEN m.lv > m.rv THEN l.player ELSE r.player END AS leader, "
        f"CASE WHEN m.lv = m.rv THEN concat(m.title, ': ', l.player, ' and ', r.player, ' are level at ', {sq.grouped('m.lv')}, '.') "
        f"ELSE concat(m.title, ': ', CASE WHEN m.lv > m.rv THEN l.player ELSE r.player END, ' leads ', "
        f"{sq.grouped('greatest(m.lv, m.rv)')}, ' to ', {sq.grouped('least(m.lv, m.rv)')}, '.') END AS line "
        "FROM profiles l JOIN profiles r ON r.player = concat('Player ', CAST((CAST(substr(l.player, 8) AS INT) + 1) % 97 AS VARCHAR)), "
        "LATERAL (VALUES ('runs', 'Runs', CAST(l.runs AS DOUBLE), CAST(r.runs AS DOUBLE)), ('average', 'Average', l.average, r.average), "
        "('strike_rate', 'Strike Rate', l.strike_rate, r.strike_rate), "
        "('wickets', 'Wickets', CAST(l.wickets AS DOUBLE), CAST(r.wickets AS DOUBLE))) m(metric, title, lv, rv)",
        sq.PROFILES,
    ),
)
def compare_entities(spark, sf_dir):
    rows = profiles(spark, sf_dir)
    following = F.concat(F.lit("Player "), ((F.substring("player", 8, 9).cast("int") + 1) % 97).cast("string"))
    pairs = rows.select(F.col("player").alias("left_name"), following.alias("right_name"))
    return bd.comparison_line(bd.compare_entities(rows, pairs, _COMPARED))


@register(
    "match_top_performers",
    over_deliveries(
        "SELECT match_id, top_batters, top_bowlers FROM "
        "(SELECT match_id, string_agg(concat(player, ' (', runs, ')'), ', ' ORDER BY n) AS top_batters FROM ("
        "SELECT match_id, batter AS player, sum(runs_batter) AS runs, row_number() OVER (PARTITION BY match_id "
        "ORDER BY sum(runs_batter) DESC, batter) AS n FROM deliveries GROUP BY 1, 2) a WHERE n <= 3 GROUP BY 1) x "
        "JOIN (SELECT match_id, string_agg(concat(player, ' (', w, '/', c, ')'), ', ' ORDER BY n) AS top_bowlers FROM ("
        f"SELECT match_id, bowler AS player, count(*) FILTER (WHERE {sq.CREDITED}) AS w, "
        "sum(runs_batter + extras_wides + extras_noballs) AS c, row_number() OVER (PARTITION BY match_id ORDER BY "
        f"count(*) FILTER (WHERE {sq.CREDITED}) DESC, bowler) AS n FROM deliveries GROUP BY 1, 2) b WHERE n <= 3 "
        "GROUP BY 1) y USING (match_id)"
    ),
)
def match_top_performers(spark, sf_dir):
    return bd.match_top_performers(deliveries(spark, sf_dir))


@register(
    "lookup_by_id",
    over_deliveries(
        "SELECT match_id, match_date, match_type, venue, winner FROM headers WHERE match_id IN ('7', '100', '1024')",
        sq.HEADERS,
    ),
)
def lookup_by_id(spark, sf_dir):
    # The id filter sits on a grouping key, so it reaches the scan of the balls.
    found = bd.lookup(ag.match_summaries(deliveries(spark, sf_dir)), "match_id", ["7", "100", "1024"])
    return found.select("match_id", "match_date", "match_type", "venue", "winner")


@register(
    "team_overview",
    over_deliveries(
        "SELECT t.team, t.matches, t.wins, t.win_rate, t.average_score, r.recent_matches FROM teams t JOIN ("
        "SELECT team, string_agg(concat_ws(' ', match_date, match_id, outcome), '; ' ORDER BY n) AS recent_matches FROM ("
        "SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id) AS n FROM match_teams) x "
        "WHERE n <= 5 GROUP BY team) r USING (team)",
        sq.TEAMS,
    ),
)
def team_overview(spark, sf_dir):
    met = teams_of_matches(spark, sf_dir)
    return bd.team_overview(ag.summarize_teams(met), met).select(
        "team", "matches", "wins", "win_rate", "average_score", "recent_matches"
    )


@register(
    "player_overview",
    over_deliveries(
        "SELECT player, team, concat_ws(' ', CASE WHEN matches > 0 OR runs > 0 OR wickets > 0 THEN "
        f"concat(player, ' has ', {sq.grouped('runs')}, ' runs from ', {sq.grouped('matches')}, ' archived matches, "
        f"with an average of ', {sq.grouped('average')}, ' and strike rate ', {sq.grouped('strike_rate')}, '.') "
        "ELSE concat(player, ' was found, but archive totals are limited.') END, "
        f"CASE WHEN wickets > 0 THEN concat(player, ' has also taken ', {sq.grouped('wickets')}, ' wickets.') END) AS answer "
        "FROM profiles",
        sq.PROFILES,
    ),
)
def player_overview(spark, sf_dir):
    return bd.player_overview(profiles(spark, sf_dir))


@register(
    "home_summary",
    over_deliveries(
        "SELECT 'runs' AS section, n AS rank, player AS name, CAST(runs AS VARCHAR) AS value FROM (SELECT *, row_number() "
        "OVER (ORDER BY runs DESC, matches DESC, player) AS n FROM profiles) a WHERE n <= 5 UNION ALL "
        "SELECT 'wickets', n, player, CAST(wickets AS VARCHAR) FROM (SELECT *, row_number() "
        "OVER (ORDER BY wickets DESC, matches DESC, player) AS n FROM profiles) b WHERE n <= 5 UNION ALL "
        f"SELECT 'teams', n, team, {sq.float_text('win_rate')} FROM (SELECT *, row_number() OVER (ORDER BY win_rate DESC, team) AS n "
        "FROM teams) c WHERE n <= 5 UNION ALL SELECT 'matches', n, match_id, match_date FROM (SELECT *, row_number() "
        "OVER (ORDER BY match_date DESC, match_id) AS n FROM headers) d WHERE n <= 5",
        sq.PROFILES + "," + sq.TEAMS,
    ),
)
def home_summary(spark, sf_dir):
    balls = deliveries(spark, sf_dir)
    return bd.home_summary(ag.player_profiles(balls), ag.team_summaries(balls), ag.match_summaries(balls))


@register(
    "player_form",
    over_deliveries(
        "SELECT * FROM (SELECT batter AS player, match_id, sum(runs_batter) AS runs, max(match_date) AS match_date, "
        "max(match_type) AS match_type, max(venue) AS venue, row_number() OVER (PARTITION BY batter ORDER BY "
        "max(match_date) DESC, match_id DESC) AS position FROM deliveries GROUP BY 1, 2) f WHERE position <= 3"
    ),
)
def player_form(spark, sf_dir):
    return bd.player_form(deliveries(spark, sf_dir))


@register(
    "safe_math",
    over_deliveries(
        "SELECT player, round(CAST(runs AS DOUBLE) / 7, 2) AS rounded, CASE WHEN wickets = 0 THEN 0.0 ELSE "
        "round(CAST(runs AS DOUBLE) / wickets, 4) END AS runs_per_wicket, least(5000, greatest(100, runs)) AS clamped FROM profiles",
        sq.PROFILES,
    ),
)
def safe_math(spark, sf_dir):
    return profiles(spark, sf_dir).select(
        "player",
        rates.round2(F.col("runs") / 7).alias("rounded"),
        F.round(rates.safe_divide("runs", "wickets"), 4).alias("runs_per_wicket"),
        rates.clamp("runs", 100, 5000).alias("clamped"),
    )


@register(
    "overs_format",
    over_deliveries(
        "SELECT match_id, inning_key, balls, concat(balls // 6, '.', balls % 6) AS overs_text, "
        "round(CAST(balls AS DOUBLE) / 6, 2) AS overs FROM innings",
        sq.MATCHES,
    ),
)
def overs_format(spark, sf_dir):
    return ag.innings_totals(deliveries(spark, sf_dir)).select(
        "match_id", "inning_key", "balls",
        rates.overs_string("balls").alias("overs_text"),
        rates.overs_decimal("balls").alias("overs"),
    )


@register(
    "pair_key",
    over_deliveries(
        "SELECT match_id, concat(min(batting_team), '__', max(batting_team)) AS pair FROM deliveries GROUP BY match_id "
        "HAVING count(DISTINCT batting_team) = 2"
    ),
)
def pair_keys(spark, sf_dir):
    met = ag.match_summaries(deliveries(spark, sf_dir)).filter(F.size("teams") == 2)
    return met.select("match_id", pair_key(F.col("teams")[1], F.col("teams")[0]).alias("pair"))
