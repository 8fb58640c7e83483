"""Common table expressions of the check queries."""

from __future__ import annotations

LEGAL = "extras_wides = 0 AND extras_noballs = 0"
CREDITED = "wicket_kind IN ('bowled', 'caught', 'caught and bowled', 'lbw', 'stumped', 'hit wicket')"

PROFILES = f"""
bat AS (
  SELECT batter AS player, sum(runs_batter) AS runs, count(*) FILTER (WHERE {LEGAL}) AS balls,
    count(*) FILTER (WHERE runs_batter = 4 AND non_boundary = 0) AS fours,
    count(*) FILTER (WHERE runs_batter = 6 AND non_boundary = 0) AS sixes
  FROM deliveries GROUP BY batter),
bowl AS (
  SELECT bowler AS player, count(*) FILTER (WHERE {LEGAL}) AS bowling_balls,
    sum(runs_batter + extras_wides + extras_noballs) AS runs_conceded,
    count(*) FILTER (WHERE {CREDITED}) AS wickets
  FROM deliveries GROUP BY bowler),
outs AS (SELECT wicket_player_out AS player, count(*) AS dismissals FROM deliveries
  WHERE wicket_player_out <> '' GROUP BY 1),
played AS (
  SELECT player, count(*) AS matches FROM (
    SELECT batter AS player, match_id FROM deliveries UNION SELECT bowler, match_id FROM deliveries) u
  GROUP BY player),
sides AS (
  SELECT player, team, balls AS team_balls FROM (
    SELECT batter AS player, batting_team AS team, count(*) AS balls,
      row_number() OVER (PARTITION BY batter ORDER BY count(*) DESC,
        min(concat(match_date, lpad(CAST(row_seq AS VARCHAR), 20, '0')))) AS n
    FROM deliveries GROUP BY batter, batting_team) s WHERE n = 1),
counted AS (
  SELECT player, coalesce(sides.team, '') AS team, coalesce(matches, 0) AS matches,
    coalesce(runs, 0) AS runs, coalesce(balls, 0) AS balls, coalesce(fours, 0) AS fours,
    coalesce(sixes, 0) AS sixes, coalesce(dismissals, 0) AS dismissals,
    coalesce(bowling_balls, 0) AS bowling_balls, coalesce(runs_conceded, 0) AS runs_conceded,
    coalesce(wickets, 0) AS wickets
  FROM played FULL JOIN bat USING (player) FULL JOIN bowl USING (player) FULL JOIN outs USING (player)
    LEFT JOIN sides USING (player)),
profiles AS (
  SELECT *,
    CASE WHEN runs >= 200 AND wickets >= 20 THEN 'All-rounder'
      WHEN wickets > 0 AND wickets * 25 > runs THEN 'Bowler' ELSE 'Batter' END AS role,
    CASE WHEN dismissals <= 0 THEN CAST(runs AS DOUBLE)
      ELSE round(CAST(runs AS DOUBLE) / dismissals, 2) END AS average,
    CASE WHEN balls <= 0 THEN 0.0 ELSE round(CAST(runs AS DOUBLE) / balls * 100, 2) END AS strike_rate,
    CASE WHEN bowling_balls <= 0 THEN 0.0
      ELSE round(CAST(runs_conceded AS DOUBLE) / (CAST(bowling_balls AS DOUBLE) / 6), 2) END AS economy
  FROM counted)"""


def _first(column: str, alias: str) -> str:
    return f"coalesce(arg_min({column}, row_seq) FILTER (WHERE {column} <> ''), '') AS {alias}"


HEADERS = f"""
headers AS (
  SELECT match_id, {_first('match_date', 'match_date')}, {_first('season', 'season')},
    {_first('match_type', 'match_type')}, {_first('venue', 'venue')}, {_first('city', 'city')},
    {_first('match_winner', 'winner')}
  FROM deliveries GROUP BY match_id)"""

MATCH_TEAMS = f"""{HEADERS},
team_runs AS (
  SELECT match_id, batting_team AS team, sum(runs_total) AS runs, count(*) FILTER (WHERE {LEGAL}) AS balls
  FROM deliveries WHERE batting_team <> '' GROUP BY 1, 2),
match_teams AS (
  SELECT t.*, h.* EXCLUDE (match_id),
    CASE WHEN winner = '' THEN 'no_result' WHEN winner = team THEN 'won' ELSE 'lost' END AS outcome
  FROM team_runs t JOIN headers h USING (match_id))"""

TEAMS = f"""{MATCH_TEAMS},
team_totals AS (
  SELECT team, count(*) AS matches, count(*) FILTER (WHERE outcome = 'won') AS wins,
    count(*) FILTER (WHERE outcome = 'lost') AS losses,
    count(*) FILTER (WHERE outcome = 'no_result') AS no_result, sum(runs) AS runs, sum(balls) AS balls
  FROM match_teams GROUP BY team),
teams AS (
  SELECT *, round(CAST(wins AS DOUBLE) / matches * 100, 2) AS win_rate,
    round(CAST(runs AS DOUBLE) / matches, 2) AS average_score,
    CASE WHEN balls <= 0 THEN 0.0 ELSE round(CAST(runs AS DOUBLE) / balls * 100, 2) END AS strike_rate
  FROM team_totals)"""


def float_text(expr: str) -> str:
    return f"regexp_replace(CAST(CAST({expr} AS DECIMAL(20, 2)) AS VARCHAR), '0$', '')"


def grouped(expr: str) -> str:
    return f"regexp_replace(regexp_replace(format('{{:,.2f}}', CAST({expr} AS DOUBLE)), '0+$', ''), '[.]$', '')"


MATCHES = f"""{HEADERS},
innings AS (
  SELECT match_id, CAST(inning AS VARCHAR) AS inning_key,
    coalesce(arg_min(batting_team, row_seq) FILTER (WHERE batting_team <> ''), '') AS team,
    min(row_seq) AS first_at, sum(runs_total) AS runs, sum(wicket_count) AS wickets,
    count(*) FILTER (WHERE {LEGAL}) AS balls
  FROM deliveries GROUP BY 1, 2),
matches AS (
  SELECT h.*, t.teams_text, i.innings_text FROM headers h
  JOIN (SELECT match_id, string_agg(batting_team, ' vs ' ORDER BY batting_team) AS teams_text
        FROM (SELECT DISTINCT match_id, batting_team FROM deliveries) d GROUP BY match_id) t USING (match_id)
  JOIN (SELECT match_id, string_agg(concat(team, ': ', runs, '/', wickets, ' in ',
          {float_text("round(CAST(balls AS DOUBLE) / 6, 2)")}, ' overs'), '; ' ORDER BY first_at, inning_key)
          AS innings_text
        FROM innings GROUP BY match_id) i USING (match_id))"""


def norm(expr: str) -> str:
    """Lower case, dots dropped, anything but a-z, 0-9 as one space."""
    return (
        f"trim(regexp_replace(replace(lower(coalesce({expr}, '')), '.', ''), '[^a-z0-9]+', ' ', 'g'))"
    )


def toks(expr: str) -> str:
    return f"list_filter(string_split({norm(expr)}, ' '), lambda t: t <> '')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {quoted(pattern)})"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"
