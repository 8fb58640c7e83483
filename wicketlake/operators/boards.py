"""Leaderboards, squads, match listings and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketlake.functions import rates
from wicketlake.functions.text import normalize_text
from wicketlake.operators import aggregates as ag
from wicketlake.operators.ordered import numbered
from wicketlake.session import written

METRICS = ["runs", "wickets", "average", "strike_rate", "economy", "fours", "sixes", "matches"]

# Least experience for a rate or boundary leaderboard.
QUALIFICATION = {
    "strike_rate": {"matches": 20, "runs": 500},
    "economy": {"matches": 20, "wickets": 25},
    "sixes": {"matches": 20, "runs": 1000},
    "fours": {"matches": 20, "runs": 1000},
}


def qualified(metric: str, minimums: dict | None = None) -> Column:
    need = QUALIFICATION.get(metric, {}) if minimums is None else minimums
    test = F.lit(True)
    for column, least in need.items():
        test = test & (F.col(column) >= least)
    return test


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    """Rank of an already limited list."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def leaderboard(
    profiles: DataFrame,
    metric: str,
    limit: int = 10,
    ascending: bool = False,
    minimums: dict | None = None,
    name: str = "player",
) -> DataFrame:
    """Top ``limit`` by ``metric``, ties by matches, then by name.

    Qualification applies before the cut. ``minimums={}`` switches it off.
    """
    order = [F.asc(metric) if ascending else F.desc(metric), F.desc("matches"), F.asc(name)]
    top = profiles.filter(qualified(metric, minimums)).orderBy(*order).limit(limit)
    return _ranked(top, order).withColumn("value", F.col(metric))


def top_players_per_team(profiles: DataFrame, metric: str = "runs", n: int = 10) -> DataFrame:
    w = Window.partitionBy("team").orderBy(F.desc(metric), F.desc("matches"), "player")
    return (
        profiles.filter("team != ''").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    )


def teams_by_win_rate(teams: DataFrame, limit: int = 5) -> DataFrame:
    return teams.orderBy(F.desc("win_rate"), "team").limit(limit)


def recent_matches(matches: DataFrame, limit: int = 5) -> DataFrame:
    return matches.orderBy(F.desc("match_date"), "match_id").limit(limit)


def squads(profiles: DataFrame, size: int | None = None) -> DataFrame:
    """Squad order of every team, with its total; ``size`` keeps the first players (11 for an XI)."""
    order = [F.desc("matches"), F.desc("runs"), F.desc("wickets"), "player"]
    # Profiles come from a scan of all balls and are used more than once here: written once.
    rows = written(profiles.filter("team != ''").withColumn("team_norm", normalize_text("team")), "squads")
    totals = rows.groupBy("team_norm").agg(F.count(F.lit(1)).alias("total_players"))
    if size is not None:
        w = Window.partitionBy("team_norm").orderBy(*order)
        placed = rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= size)
    else:
        stepped = rows.withColumn("_step", -F.col("matches"))
        placed = numbered(stepped, ["team_norm"], "_step", order, "position").drop("_step")
    return placed.withColumn("squad_role", rates.squad_role("role")).join(totals, "team_norm")


def matches_for_team(
    match_teams: DataFrame,
    team: str,
    limit: int = 10,
    offset: int = 0,
    year: str = "",
    match_type: str = "",
) -> DataFrame:
    """Newest first page of the matches of a team; empty filters are off."""
    rows = match_teams.filter(normalize_text("team") == normalize_text(F.lit(team)))
    if year:
        rows = rows.filter(F.col("match_date").startswith(year))
    if match_type:
        rows = rows.filter(normalize_text("match_type") == normalize_text(F.lit(match_type)))
    return rows.orderBy(F.desc("match_date"), "match_id").offset(offset).limit(limit)


def matches_between(match_teams: DataFrame, teams: list[str]) -> DataFrame:
    """Matches in which every one of ``teams`` batted."""
    rows = match_teams.filter(F.col("team").isin(teams))
    return (
        rows.groupBy("match_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.first(c).alias(c) for c in ("match_date", "match_type", "venue", "winner")],
        )
        .filter(F.col("_n") == len(set(teams)))
        .drop("_n")
    )


def latest_meetings(match_teams: DataFrame, requests: DataFrame) -> DataFrame:
    """Latest match of each requested pair (``team_a``, ``team_b``; ``team_b`` may be empty).

    Every match offers itself to the pairs of its own few teams; those are reduced to the latest before they meet
    the requests, so that a team in many matches or requests is one row a pair.
    """
    fields = ["match_date", "match_type", "venue", "winner"]
    others = F.concat(F.array(F.lit("")), F.col("teams"))
    pairs = F.flatten(
        F.transform("teams", lambda a: F.transform(F.filter(others, lambda b: b != a), lambda b: F.struct(a.alias("team_a"), b.alias("team_b"))))
    )
    met = ag.team_sets(match_teams, *fields).select("match_id", *fields, F.inline(pairs))
    latest = F.max_by(F.struct("match_id", *fields), F.struct("match_date", "match_id")).alias("m")
    return met.groupBy("team_a", "team_b").agg(latest).join(requests.distinct(), ["team_a", "team_b"]).select("team_a", "team_b", "m.*")


def compare_entities(profiles: DataFrame, pairs: DataFrame, metrics: list[str], name: str = "player") -> DataFrame:
    """One row per requested pair (``left_name``, ``right_name``) and metric."""
    wide = profiles.select(F.col(name).alias("_name"), *[F.col(m).cast("double").alias(m) for m in metrics])
    left = wide.select(F.col("_name").alias("left_name"), *[F.col(m).alias(f"l_{m}") for m in metrics])
    right = wide.select(F.col("_name").alias("right_name"), *[F.col(m).alias(f"r_{m}") for m in metrics])
    joined = pairs.join(left, "left_name").join(right, "right_name")
    rows = joined.select(
        "left_name",
        "right_name",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(f"l_{m}").alias("lv"), F.col(f"r_{m}").alias("rv"))
                    for m in metrics
                ]
            )
        ).alias("v"),
    )
    leader = (
        F.when(F.col("v.lv") == F.col("v.rv"), "level")
        .when(F.col("v.lv") > F.col("v.rv"), F.col("left_name"))
        .otherwise(F.col("right_name"))
    )
    return rows.select(
        "left_name",
        "right_name",
        "v.metric",
        F.col("v.lv").alias("left_value"),
        F.col("v.rv").alias("right_value"),
        leader.alias("leader"),
    )


def comparison_line(df: DataFrame) -> DataFrame:
    """The rows of ``compare_entities`` with a sentence each."""
    from wicketlake.functions.text import title_metric

    g = rates.grouped_number_text
    text = F.when(
        F.col("leader") == "level",
        F.concat(
            title_metric("metric"), F.lit(": "), F.col("left_name"), F.lit(" and "), F.col("right_name"),
            F.lit(" are level at "), g("left_value"), F.lit("."),
        ),
    ).otherwise(
        F.concat(
            title_metric("metric"), F.lit(": "), F.col("leader"), F.lit(" leads "),
            g(F.greatest("left_value", "right_value")), F.lit(" to "),
            g(F.least("left_value", "right_value")), F.lit("."),
        )
    )
    return df.withColumn("line", text)


def match_top_performers(deliveries: DataFrame, n: int = 3) -> DataFrame:
    """Top batters by runs and bowlers by wickets of every match, as text.

    One pass: a ball adds to its batter and its bowler, and all steps are by match, so a table dealt out by match
    is not shuffled again.
    """

    def part(kind: str, player: str, score, conceded) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(player).alias("player"), score.cast("bigint").alias("score"), conceded.cast("bigint").alias("conceded"))

    wicket = F.when(rates.credited_wicket(), 1).otherwise(0)
    both = F.array(
        part("bat", "batter", F.col("runs_batter"), F.lit(0)),
        part("bowl", "bowler", wicket, F.expr("runs_batter + extras_wides + extras_noballs")),
    )
    scores = (
        ag.valid(deliveries).select("match_id", F.inline(both)).filter("player != ''")
        .groupBy("match_id", "kind", "player").agg(F.sum("score").alias("score"), F.sum("conceded").alias("conceded"))
    )
    shown = F.when(F.col("kind") == "bat", F.concat("player", F.lit(" ("), F.col("score").cast("string"), F.lit(")"))).otherwise(
        F.concat("player", F.lit(" ("), F.col("score").cast("string"), F.lit("/"), F.col("conceded").cast("string"), F.lit(")"))
    )
    w = Window.partitionBy("match_id", "kind").orderBy(F.desc("score"), "player")
    top = scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).withColumn("line", shown)

    def lines(kind: str) -> Column:
        picked = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "line"))))
        return F.array_join(F.transform(picked, lambda r: r.line), ", ")

    return top.groupBy("match_id").agg(lines("bat").alias("top_batters"), lines("bowl").alias("top_bowlers"))


def lookup(df: DataFrame, column: str, ids: list[str]) -> DataFrame:
    return df.filter(F.col(column).isin(ids))


def team_overview(teams: DataFrame, match_teams: DataFrame, n: int = 5) -> DataFrame:
    """Team summary with its latest matches as text."""
    w = Window.partitionBy("team").orderBy(F.desc("match_date"), "match_id")
    latest = match_teams.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    text = F.concat_ws(" ", "match_date", "match_id", "outcome")
    rows = latest.groupBy("team").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), text.alias("t")))).alias("r")
    )
    recent = F.array_join(F.transform("r", lambda x: x.t), "; ").alias("recent_matches")
    return teams.join(rows.select("team", recent), "team", "left")


def player_overview(profiles: DataFrame, season: str = "") -> DataFrame:
    """One sentence per player; a season adds the note that splits are not kept."""
    g = rates.grouped_number_text
    stats = ["matches", "runs", "average", "strike_rate", "wickets", "economy", "fours", "sixes"]
    main = F.concat(
        F.col("player"), F.lit(" has "), g("runs"), F.lit(" runs from "), g("matches"),
        F.lit(" archived matches, with an average of "), g("average"), F.lit(" and strike rate "),
        g("strike_rate"), F.lit("."),
    )
    thin = F.concat(F.col("player"), F.lit(" was found, but archive totals are limited."))
    wickets = F.when(
        F.col("wickets") > 0,
        F.concat(F.col("player"), F.lit(" has also taken "), g("wickets"), F.lit(" wickets.")),
    )
    note = F.lit("Season splits are not indexed; this is the overall profile." if season else None)
    parts = [F.when(rates.has_meaningful_stats(*stats), main).otherwise(thin), wickets, note.cast("string")]
    return profiles.select("player", "team", F.concat_ws(" ", *parts).alias("answer"))


def home_summary(profiles: DataFrame, teams: DataFrame, matches: DataFrame, n: int = 5) -> DataFrame:
    """Leaders in runs and wickets, best teams and latest matches as tagged rows."""

    def tagged(df: DataFrame, section: str, order: list, name: str, value: Column) -> DataFrame:
        return _ranked(df, order).select(
            F.lit(section).alias("section"), "rank", F.col(name).alias("name"), value.cast("string").alias("value")
        )

    runs_order = [F.desc("runs"), F.desc("matches"), "player"]
    wickets_order = [F.desc("wickets"), F.desc("matches"), "player"]
    teams_order = [F.desc("win_rate"), "team"]
    match_order = [F.desc("match_date"), "match_id"]
    parts = [
        tagged(profiles.orderBy(*runs_order).limit(n), "runs", runs_order, "player", F.col("runs")),
        tagged(profiles.orderBy(*wickets_order).limit(n), "wickets", wickets_order, "player", F.col("wickets")),
        tagged(teams.orderBy(*teams_order).limit(n), "teams", teams_order, "team", rates.float_text("win_rate")),
        tagged(matches.orderBy(*match_order).limit(n), "matches", match_order, "match_id", F.col("match_date")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def player_form(deliveries: DataFrame, n: int = 3) -> DataFrame:
    """Runs of the last ``n`` matches of every batter."""
    per_match = (
        ag.valid(deliveries).filter("batter != ''")
        .groupBy(F.col("batter").alias("player"), "match_id")
        .agg(
            F.sum("runs_batter").alias("runs"),
            F.max("match_date").alias("match_date"),
            F.max("match_type").alias("match_type"),
            F.max("venue").alias("venue"),
        )
    )
    w = Window.partitionBy("player").orderBy(F.desc("match_date"), F.desc("match_id"))
    return per_match.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
