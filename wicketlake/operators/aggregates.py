"""Player, team, innings and match aggregates over the delivery table.

Every aggregate first reduces to (entity, match) with map-side combine, so a player, team or
match that owns a large share of the balls shrinks before rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketlake.functions import rates
from wicketlake.functions.text import bound_once, pair_key


def valid(deliveries: DataFrame) -> DataFrame:
    """Rows that belong to a match."""
    return deliveries.filter(F.trim("match_id") != "")


def _day() -> Column:
    """Match day as a number; unreadable dates come first."""
    return F.coalesce(F.unix_date(F.col("match_date").try_cast("date")), F.lit(-1000000))


def _ones(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def team_batting(deliveries: DataFrame) -> DataFrame:
    per_match = (
        valid(deliveries)
        .filter("batting_team != ''")
        .groupBy("batting_team", "match_id")
        .agg(F.sum("runs_total").alias("runs"), _ones(rates.legal_ball()).alias("balls"))
    )
    return per_match.groupBy(F.col("batting_team").alias("team")).agg(
        F.count(F.lit(1)).alias("matches"), F.sum("runs").alias("runs"), F.sum("balls").alias("balls")
    )


def player_batting(deliveries: DataFrame) -> DataFrame:
    in_play = F.col("non_boundary") == 0
    per_match = (
        valid(deliveries)
        .filter("batter != ''")
        .groupBy("batter", "match_id")
        .agg(
            F.sum("runs_batter").alias("runs"),
            _ones(rates.legal_ball()).alias("balls"),
            _ones((F.col("runs_batter") == 4) & in_play).alias("fours"),
            _ones((F.col("runs_batter") == 6) & in_play).alias("sixes"),
        )
    )
    return per_match.groupBy(F.col("batter").alias("player")).agg(
        F.count(F.lit(1)).alias("matches"),
        *[F.sum(c).alias(c) for c in ("runs", "balls", "fours", "sixes")],
    )


def player_bowling(deliveries: DataFrame) -> DataFrame:
    conceded = F.col("runs_batter") + F.col("extras_wides") + F.col("extras_noballs")
    per_match = (
        valid(deliveries)
        .filter("bowler != ''")
        .groupBy("bowler", "match_id")
        .agg(
            _ones(rates.legal_ball()).alias("balls"),
            F.sum(conceded).alias("runs_conceded"),
            _ones(rates.credited_wicket()).alias("wickets"),
        )
    )
    return per_match.groupBy(F.col("bowler").alias("player")).agg(
        F.count(F.lit(1)).alias("matches"),
        *[F.sum(c).alias(c) for c in ("balls", "runs_conceded", "wickets")],
    )


def player_dismissals(deliveries: DataFrame) -> DataFrame:
    out = valid(deliveries).filter("wicket_player_out != ''")
    return out.groupBy(F.col("wicket_player_out").alias("player")).agg(F.count(F.lit(1)).alias("dismissals"))


_MEASURES = ["runs", "balls", "fours", "sixes", "dismissals", "bowling_balls", "runs_conceded", "wickets"]


def _place(day: Column) -> Column:
    """Place of a ball in time as one number: the day, then the place in its match."""
    return day.cast("decimal(10,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col("row_seq").cast("decimal(19,0)")


def _first_ball() -> Column:
    return _place(_day())


# What a ball adds to: its batter, bowler and dismissed player in the match, and its batter's side.
_BATTER, _BOWLER, _OUT, _SIDE = range(4)


def _player_parts(deliveries: DataFrame) -> DataFrame:
    """A row for each ball and player it adds to. The match stays a column of its own, so that a table dealt out by
    match is not shuffled by what follows; the day stands with sides only."""
    role = F.col("role")
    legal = F.when(rates.legal_ball(), 1).otherwise(0)
    in_play = F.col("non_boundary") == 0
    measures = {
        "runs": (_BATTER, F.col("runs_batter")),
        "balls": (_BATTER, legal),
        "fours": (_BATTER, F.when((F.col("runs_batter") == 4) & in_play, 1)),
        "sixes": (_BATTER, F.when((F.col("runs_batter") == 6) & in_play, 1)),
        "dismissals": (_OUT, F.lit(1)),
        "bowling_balls": (_BOWLER, legal),
        "runs_conceded": (_BOWLER, F.col("runs_batter") + F.col("extras_wides") + F.col("extras_noballs")),
        "wickets": (_BOWLER, F.when(rates.credited_wicket(), 1)),
    }
    parts = valid(deliveries).withColumn("role", F.explode(F.array(*[F.lit(r) for r in (_BATTER, _BOWLER, _OUT, _SIDE)])))
    return parts.select(
        "match_id",
        F.when(role == _BOWLER, F.col("bowler")).when(role == _OUT, F.col("wicket_player_out")).otherwise(F.col("batter")).alias("player"),
        F.when(role == _SIDE, F.col("batting_team")).otherwise("").alias("team"),
        F.when(role == _SIDE, _day()).alias("day"),
        "row_seq",
        F.when(role.isin(_BATTER, _BOWLER), 1).otherwise(0).alias("seen"),
        F.when(role == _SIDE, 1).otherwise(0).alias("team_balls"),
        *[F.coalesce(F.when(role == r, value), F.lit(0)).cast("int").alias(m) for m, (r, value) in measures.items()],
        "role",
    ).filter((F.col("player") != "") & ((role != _SIDE) | (F.col("team") != "")))


def player_profiles(deliveries: DataFrame) -> DataFrame:
    """One row per player who batted, bowled or was dismissed.

    One pass with hash aggregation by match: totals per (player, match) and balls per (player, side, match), folded to
    (player, side) so that a match counts once, then to the player.
    """
    per_key = _player_parts(deliveries).groupBy("match_id", "player", "team", "day").agg(
        F.max("seen").alias("seen"),
        F.sum("team_balls").alias("team_balls"),
        F.min("row_seq").alias("row_seq"),
        *[F.sum(m).alias(m) for m in _MEASURES],
    )
    per_side = per_key.groupBy("player", "team").agg(
        F.sum("seen").alias("matches"),
        F.sum("team_balls").alias("team_balls"),
        F.min(F.when(F.col("team") != "", _place(F.col("day")))).alias("first_at"),
        *[F.sum(m).alias(m) for m in _MEASURES],
    )
    # Most balls first, then the earliest ball: the smallest struct wins.
    side_rank = F.struct((-F.col("team_balls")).alias("fewer"), "first_at", "team")
    totals = per_side.groupBy("player").agg(
        F.sum("matches").alias("matches"),
        *[F.sum(m).alias(m) for m in _MEASURES],
        F.min(F.when(F.col("team") != "", side_rank)).alias("main_side"),
    )
    return totals.select(
        "player",
        F.coalesce("main_side.team", F.lit("")).alias("team"),
        rates.player_role("runs", "wickets").alias("role"),
        "matches",
        *_MEASURES,
        rates.batting_average("runs", "dismissals").alias("average"),
        rates.strike_rate("runs", "balls").alias("strike_rate"),
        rates.economy_rate("runs_conceded", "bowling_balls").alias("economy"),
    )


def modal_team(deliveries: DataFrame) -> DataFrame:
    """Team a player bats for most often; ties go to the team met first."""
    per_team = (
        valid(deliveries)
        .filter("batter != '' AND batting_team != ''")
        .groupBy(F.col("batter").alias("player"), F.col("batting_team").alias("team"))
        .agg(F.count(F.lit(1)).alias("balls"), F.min(_first_ball()).alias("first_at"))
    )
    best = F.min(F.struct((-F.col("balls")).alias("fewer"), "first_at", "team", "balls")).alias("best")
    return per_team.groupBy("player").agg(best).select("player", "best.team", "best.balls")


def _inning_key() -> Column:
    return F.coalesce(
        F.nullif(F.trim(F.col("inning").cast("string")), F.lit("")),
        F.nullif(F.col("batting_team"), F.lit("")),
        F.lit("innings"),
    )


def innings_totals(deliveries: DataFrame) -> DataFrame:
    per_side = (
        valid(deliveries)
        .groupBy("match_id", "inning", "batting_team")
        .agg(
            F.min("row_seq").alias("first_at"),
            F.sum("runs_total").alias("runs"),
            F.sum("wicket_count").alias("wickets"),
            _ones(rates.legal_ball()).alias("balls"),
        )
    )
    return per_side.groupBy("match_id", _inning_key().alias("inning_key")).agg(
        F.coalesce(
            F.min_by("batting_team", F.when(F.col("batting_team") != "", F.col("first_at"))), F.lit("")
        ).alias("team"),
        *[F.sum(c).alias(c) for c in ("runs", "wickets", "balls")],
    )


# Header fields of a match and the delivery columns they come from.
HEADER = {
    "match_date": "match_date",
    "season": "season",
    "match_type": "match_type",
    "venue": "venue",
    "city": "city",
    "winner": "match_winner",
}


def _by_header(deliveries: DataFrame, *keys) -> DataFrame:
    """Ball totals per ``keys`` and header. The header is part of the grouping key, constant in
    nearly every match, so the balls are reduced by hash aggregation on plain columns."""
    return (
        valid(deliveries)
        .groupBy("match_id", *keys, *[F.col(src).alias(dst) for dst, src in HEADER.items()])
        .agg(
            F.min("row_seq").alias("first_at"),
            F.sum("runs_total").alias("runs"),
            F.sum("wicket_count").alias("wickets"),
            _ones(rates.legal_ball()).alias("balls"),
        )
    )


def _first_field(name: str) -> Column:
    """Aggregate: the first non-empty value as a (position, value) struct."""
    return F.min(F.when(F.col(name) != "", F.struct(F.col("first_at").alias("at"), F.col(name).alias("value"))))


def match_teams(deliveries: DataFrame) -> DataFrame:
    """One row per match and team that batted, with the match header and the outcome for the team."""
    per_team = (
        _by_header(deliveries, "batting_team")
        .groupBy("match_id", F.col("batting_team").alias("team"))
        .agg(
            *[_first_field(name).alias(name) for name in HEADER],
            F.sum("runs").alias("runs"),
            F.sum("balls").alias("balls"),
        )
    )
    whole = Window.partitionBy("match_id")
    headed = per_team.select(
        "match_id",
        "team",
        "runs",
        "balls",
        *[F.coalesce(F.min(name).over(whole)["value"], F.lit("")).alias(name) for name in HEADER],
    ).filter("team != ''")
    return _with_outcome(headed)


def _with_outcome(teams: DataFrame) -> DataFrame:
    return teams.withColumn(
        "outcome",
        F.when(F.col("winner") == "", "no_result").when(F.col("winner") == F.col("team"), "won").otherwise("lost"),
    )


def _folded(rows: Column, key: str, fold, alone) -> Column:
    """``fold`` of each run of ``rows`` with the same ``key``, by which they are sorted; ``alone`` of each row where no
    two share a key, as in nearly every match."""
    new = lambda i: (i == 1) | (F.get(rows, i - 1)[key] != F.get(rows, i - 2)[key])
    end = lambda starts, j: F.coalesce(F.get(starts, j + 1), F.size(rows) + 1)
    starts = F.filter(F.sequence(F.lit(1), F.size(rows)), new)
    runs = bound_once(starts, lambda s: F.transform(s, lambda at, j: F.slice(rows, at, end(s, j) - at)))
    differ = F.size(F.array_distinct(rows[key])) == F.size(rows)
    return F.when(differ, F.transform(rows, alone)).otherwise(F.transform(runs, fold))


def _total(rows: Column, name: str) -> Column:
    """Sum over ``rows`` as of an aggregate: null only if all are."""
    return F.aggregate(rows, F.lit(None).cast("bigint"), lambda n, r: F.coalesce(n + r[name], n, r[name]))


def match_records(deliveries: DataFrame) -> DataFrame:
    """One row per match: header, ordered innings, and the ``sides`` that batted in order of their names.

    A match's balls are summed by hash aggregation; what is gathered is a row for each innings, side and header in it.
    """
    row = F.struct(
        _inning_key().alias("inning_key"), "first_at", F.col("batting_team").alias("team"), "runs", "wickets", "balls",
        F.struct(*HEADER).alias("header"),
    )
    per_key = _by_header(deliveries, "inning", "batting_team")
    gathered = per_key.groupBy("match_id").agg(F.collect_list(row).alias("rows"))
    rows = F.col("rows")

    one_header = F.size(F.array_distinct(rows["header"])) == 1

    def first(name: str) -> Column:
        named = F.filter(rows, lambda r: r.header[name] != "")
        places = F.transform(named, lambda r: F.struct(r.first_at.alias("at"), r.header[name].alias("value")))
        found = F.when(one_header, F.get(rows, F.lit(0)).header[name]).otherwise(F.array_min(places)["value"])
        return F.coalesce(found, F.lit(""))

    def innings(first_row: Column, team: Column, total) -> Column:
        return F.struct(
            first_row.first_at.alias("first_at"), first_row.inning_key.alias("inning_key"), F.coalesce(team, F.lit("")).alias("team"),
            *[total(c).alias(c) for c in ("runs", "wickets", "balls")],
        )

    def side(team: Column, total) -> Column:
        return F.struct(team.alias("team"), *[total(c).alias(c) for c in ("runs", "balls")])

    by_innings = bound_once(
        F.sort_array(rows),
        lambda sorted_rows: _folded(
            sorted_rows,
            "inning_key",
            lambda run: innings(F.get(run, F.lit(0)), F.get(F.filter(run, lambda r: r.team != ""), F.lit(0)).team, lambda c: _total(run, c)),
            lambda r: innings(r, r.team, lambda c: r[c]),
        ),
    )
    by_side = bound_once(
        F.sort_array(F.transform(F.filter(rows, lambda r: r.team != ""), lambda r: side(r.team, lambda c: r[c]))),
        lambda sides: _folded(sides, "team", lambda run: side(F.get(run, F.lit(0)).team, lambda c: _total(run, c)), lambda r: r),
    )
    return gathered.select(
        "match_id",
        *[first(name).alias(name) for name in HEADER],
        F.transform(F.sort_array(by_innings), lambda i: i.dropFields("first_at")).alias("innings"),
        by_side.alias("sides"),
    )


def summaries_of_matches(records: DataFrame) -> DataFrame:
    return records.select("match_id", *HEADER, F.col("sides.team").alias("teams"), "innings")


def teams_of_matches(records: DataFrame) -> DataFrame:
    """The rows of ``match_teams`` from match records."""
    return _with_outcome(records.select("match_id", F.inline("sides"), *HEADER).select("match_id", "team", "runs", "balls", *HEADER))


def match_summaries(deliveries: DataFrame) -> DataFrame:
    """One row per match: header, sorted teams and ordered innings. Columns that nobody reads cost nothing here;
    ``match_records`` gathers all of them at once for those who read them all."""
    per_key = (
        _by_header(deliveries, "inning", "batting_team")
        .groupBy("match_id", _inning_key().alias("inning_key"))
        .agg(
            *[_first_field(name).alias(name) for name in HEADER],
            _first_field("batting_team").alias("side"),
            F.collect_set(F.nullif("batting_team", F.lit(""))).alias("sides"),
            F.min("first_at").alias("first_at"),
            *[F.sum(c).alias(c) for c in ("runs", "wickets", "balls")],
        )
    )
    innings = F.struct(
        "first_at",
        "inning_key",
        F.coalesce(F.col("side.value"), F.lit("")).alias("team"),
        "runs",
        "wickets",
        "balls",
    )
    per_match = per_key.groupBy("match_id").agg(
        *[F.min(name).alias(name) for name in HEADER],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sides")))).alias("teams"),
        F.array_sort(F.collect_list(innings)).alias("innings"),
    )
    return per_match.select(
        "match_id",
        *[F.coalesce(F.col(name)["value"], F.lit("")).alias(name) for name in HEADER],
        "teams",
        F.transform("innings", lambda i: i.dropFields("first_at")).alias("innings"),
    )


def team_summaries(deliveries: DataFrame) -> DataFrame:
    return summarize_teams(match_teams(deliveries))


def summarize_teams(teams: DataFrame) -> DataFrame:
    return (
        teams.groupBy("team")
        .agg(
            F.count(F.lit(1)).alias("matches"),
            _ones(F.col("outcome") == "won").alias("wins"),
            _ones(F.col("outcome") == "lost").alias("losses"),
            _ones(F.col("outcome") == "no_result").alias("no_result"),
            F.sum("runs").alias("runs"),
            F.sum("balls").alias("balls"),
        )
        .withColumn("win_rate", rates.percentage("wins", "matches"))
        .withColumn("average_score", rates.per_unit("runs", "matches"))
        .withColumn("strike_rate", rates.strike_rate("runs", "balls"))
    )


def team_sets(teams: DataFrame, *columns: str) -> DataFrame:
    """One row per match: its teams in order of their names, and its ``columns``."""
    return teams.groupBy("match_id").agg(
        F.array_sort(F.collect_set("team")).alias("teams"), *[F.first(c).alias(c) for c in columns]
    )


def _meetings(teams: DataFrame) -> DataFrame:
    """One row per pair of teams that batted in the same match, names in order; pairs are formed inside the row."""
    pairs = F.flatten(
        F.transform("teams", lambda a, i: F.transform(F.slice("teams", i + 2, F.size("teams")), lambda b: F.struct(a.alias("team_a"), b.alias("team_b"))))
    )
    return team_sets(teams, "winner").select("match_id", "winner", F.inline(pairs))


def head_to_head_all(teams: DataFrame) -> DataFrame:
    """Tally for every pair of teams; a win of any other team counts as no result."""
    return (
        _meetings(teams)
        .groupBy("team_a", "team_b")
        .agg(
            F.count(F.lit(1)).alias("matches"),
            _ones(F.col("winner") == F.col("team_a")).alias("wins_a"),
            _ones(F.col("winner") == F.col("team_b")).alias("wins_b"),
            _ones((F.col("winner") != F.col("team_a")) & (F.col("winner") != F.col("team_b"))).alias("no_result"),
        )
        .withColumn("pair", pair_key("team_a", "team_b"))
    )


def head_to_head(teams: DataFrame, team_a: str, team_b: str) -> DataFrame:
    """Tally of two teams, with the first name given on the left."""
    both = teams.filter(F.col("team").isin(team_a, team_b))
    met = both.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.first("winner").alias("winner")).filter("n = 2")
    return met.agg(
        F.count(F.lit(1)).alias("matches"),
        F.coalesce(_ones(F.col("winner") == team_a), F.lit(0)).alias("wins_a"),
        F.coalesce(_ones(F.col("winner") == team_b), F.lit(0)).alias("wins_b"),
        F.coalesce(_ones(~F.col("winner").isin(team_a, team_b)), F.lit(0)).alias("no_result"),
    ).select(F.lit(team_a).alias("team_a"), F.lit(team_b).alias("team_b"), "*")


def dataset_profile(deliveries: DataFrame) -> DataFrame:
    """One row of counts, ranges and distinct values of a delivery table."""
    per_match = (
        valid(deliveries)
        .groupBy("match_id", "season", "venue", "match_type", F.nullif("match_date", F.lit("")).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            _ones(F.col("wicket_count") > 0).alias("wicket_balls"),
            _ones(F.col("has_review") == 1).alias("review_balls"),
            _ones(F.col("has_replacements") == 1).alias("replacement_balls"),
        )
    )
    return per_match.agg(
        F.sum("rows").alias("rows_written"),
        F.count_distinct("match_id").alias("matches_with_rows"),
        F.sum("wicket_balls").alias("deliveries_with_wickets"),
        F.sum("review_balls").alias("deliveries_with_reviews"),
        F.sum("replacement_balls").alias("deliveries_with_replacements"),
        F.coalesce(F.min("day"), F.lit("")).alias("min_date"),
        F.coalesce(F.max("day"), F.lit("")).alias("max_date"),
        F.count_distinct(F.nullif("season", F.lit(""))).alias("distinct_seasons"),
        F.count_distinct(F.nullif("venue", F.lit(""))).alias("distinct_venues"),
        F.array_sort(F.collect_set(F.nullif("match_type", F.lit("")))).alias("match_types"),
    )


def archive_summary(deliveries: DataFrame) -> DataFrame:
    """Counts of matches, players and teams with the date range.

    Matches are counted by match, where a table dealt out by match is not shuffled again; all other groups are as
    few as players and days.
    """
    d = valid(deliveries).withColumn("day", F.nullif("match_date", F.lit("")))
    by_match = d.groupBy("match_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    matches = by_match.agg(F.count(F.lit(1)).alias("matches"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    names = d.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name"))
                    for kind, c in (
                        ("player", "batter"),
                        ("player", "bowler"),
                        ("player", "wicket_player_out"),
                        ("team", "batting_team"),
                    )
                ]
            )
        ).alias("e")
    )
    named = names.filter("e.name != ''").groupBy("e.kind", "e.name").agg(F.count(F.lit(1)).alias("n"))
    entities = named.agg(_ones(F.col("kind") == "player").alias("players"), _ones(F.col("kind") == "team").alias("teams"))
    # Both sides are one row by construction.
    return matches.crossJoin(entities).select(
        "matches",
        F.coalesce("players", F.lit(0).cast("bigint")).alias("players"),
        F.coalesce("teams", F.lit(0).cast("bigint")).alias("teams"),
        F.coalesce("lo", F.lit("")).alias("min_date"),
        F.coalesce("hi", F.lit("")).alias("max_date"),
    )


def filter_options(deliveries: DataFrame) -> DataFrame:
    """Distinct teams and seasons to choose from."""
    pairs = valid(deliveries).select(
        F.explode(
            F.array(
                F.struct(F.lit("team").alias("kind"), F.col("batting_team").alias("value")),
                F.struct(F.lit("season").alias("kind"), F.col("season").alias("value")),
            )
        ).alias("o")
    )
    return pairs.select("o.*").filter("value != ''").distinct()


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first by ``order``. Each task keeps its own best row before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def log_report(log: DataFrame, category: str, passed: Column, latency: str) -> DataFrame:
    """Total, passes, pass rate and mean latency per category of a query log."""
    return (
        log.groupBy(F.col(category).alias("category"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            _ones(passed).alias("passed"),
            F.round(F.sum(F.col(latency).cast("decimal(20,4)")).cast("double") / F.count(F.lit(1)), 2).alias("mean_latency"),
        )
        .withColumn("pass_rate", rates.percentage("passed", "total"))
    )


def slowest(log: DataFrame, latency: str, key: str, n: int = 5) -> DataFrame:
    return log.orderBy(F.desc(latency), key).limit(n)
