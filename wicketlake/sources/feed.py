"""Provider payloads: match feed, scorecards, search results and player statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.functions import rates
from wicketlake.functions.text import bound_once, find, first_non_empty, normalize_text
from wicketlake.operators.ordered import positions
from wicketlake.schemas import FEED_ITEM_DDL, SCORECARD_DDL


def parse_feed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Feed items from JSON text."""
    return payloads.select(F.from_json(column, FEED_ITEM_DDL).alias("m")).select("m.*")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _flag(c: str) -> Column:
    return F.coalesce(c, F.lit(False))


def normalize_feed(items: DataFrame) -> DataFrame:
    """Feed items in the stored names: defaults filled in, ``live`` while started and not ended."""
    score = F.transform(
        F.coalesce("score", F.array().cast("array<struct<r:int,w:int,o:double,inning:string>>")),
        lambda s: F.struct(
            F.coalesce(s.r, F.lit(0)).alias("runs"),
            s.w.alias("wickets"),
            s.o.alias("overs"),
            F.coalesce(s.inning, F.lit("")).alias("inning"),
        ),
    )
    started, ended = _flag("matchStarted"), _flag("matchEnded")
    return items.select(
        _text("id").alias("id"),
        _text("name").alias("name"),
        _text("matchType").alias("match_type"),
        _text("status").alias("status"),
        _text("venue").alias("venue"),
        _text("date").alias("date"),
        _text("dateTimeGMT").alias("date_time_gmt"),
        F.coalesce("teams", F.array().cast("array<string>")).alias("teams"),
        _text("series_id").alias("series_id"),
        score.alias("score"),
        (started & ~ended).alias("live"),
        started.alias("match_started"),
        ended.alias("match_ended"),
        _flag("hasSquad").alias("has_squad"),
        _flag("fantasyEnabled").alias("fantasy_enabled"),
        _flag("bbbEnabled").alias("ball_by_ball_enabled"),
    )


def at(date_time="date_time_gmt", date="date") -> Column:
    """Start of a feed item; null when unreadable."""
    return F.try_to_timestamp(F.coalesce(F.nullif(F.col(date_time), F.lit("")), F.col(date)))


def filter_feed(feed: DataFrame, team: str = "", match_type: str = "", series_id: str = "") -> DataFrame:
    """Team as part of any team name, match type and series exactly; empty filters are off."""
    rows = feed
    if team:
        wanted = normalize_text(F.lit(team))
        rows = rows.filter(F.exists("teams", lambda t: F.contains(normalize_text(t), wanted)))
    if match_type:
        rows = rows.filter(normalize_text("match_type") == normalize_text(F.lit(match_type)))
    if series_id:
        rows = rows.filter(normalize_text("series_id") == normalize_text(F.lit(series_id)))
    return rows


def recent_completed(feed: DataFrame, reference: Column, lookback_hours: int = 24) -> DataFrame:
    cutoff = reference - F.make_interval(hours=F.lit(max(1, lookback_hours)))
    return feed.filter(F.col("match_ended") & (at() >= cutoff))


def upcoming(feed: DataFrame) -> DataFrame:
    return feed.filter(~F.col("match_started"))


def live(feed: DataFrame) -> DataFrame:
    return feed.filter("live")


def sorted_feed(feed: DataFrame, ascending: bool = True) -> DataFrame:
    """With ``position`` by start, then id; unreadable dates come last either way."""
    return positions(feed, [F.asc_nulls_last(at()) if ascending else F.desc_nulls_last(at()), F.asc("id")])


# How well a team name meets a hint, and what else counts.
HINT_EQUAL, HINT_EDGE, HINT_INSIDE = 300, 180, 90
HINT_IN_NAME, QUESTION_IN_NAME, LIVE_NOW = 25, 15, 40


def relevance(hint: str, question: str) -> Column:
    h, q = normalize_text(F.lit(hint)), normalize_text(F.lit(question))

    def team_score(t: Column) -> Column:
        n = normalize_text(t)
        return (
            F.when((n == "") | (h == ""), 0)
            .when(n == h, HINT_EQUAL)
            .when(F.startswith(n, F.concat(h, F.lit(" "))) | F.endswith(n, F.concat(F.lit(" "), h)), HINT_EDGE)
            .when(F.contains(n, h), HINT_INSIDE)
            .otherwise(0)
        )

    name = normalize_text("name")
    best = F.coalesce(F.array_max(F.transform("teams", team_score)), F.lit(0))
    return (
        best
        + F.when((h != "") & F.contains(name, h), HINT_IN_NAME).otherwise(0)
        + F.when((q != "") & F.contains(name, q), QUESTION_IN_NAME).otherwise(0)
        + F.when(F.col("live"), LIVE_NOW).otherwise(0)
    )


def by_relevance(feed: DataFrame, hint: str, question: str, ascending: bool = False) -> DataFrame:
    """With ``relevance``, and ``position`` by it, then by start (unreadable ones count as the oldest), name and id."""
    start = F.coalesce(at(), F.lit(0).cast("timestamp"))
    scored = feed.withColumn("relevance", relevance(hint, question))
    return positions(scored, [F.desc("relevance"), start.asc() if ascending else start.desc(), F.asc("name"), F.asc("id")])


def score_line(score="score") -> Column:
    """``Team A 120/3 (14.2), ...`` of the innings of a feed item."""

    def one(s: Column) -> Column:
        return F.concat(
            F.when(F.coalesce(s.inning, F.lit("")) == "", F.lit("Innings")).otherwise(s.inning),
            F.lit(" "), F.coalesce(s.runs, F.lit(0)).cast("string"), F.lit("/"),
            F.coalesce(s.wickets.cast("string"), F.lit("-")), F.lit(" ("),
            F.coalesce(F.regexp_replace(s.overs.cast("string"), r"[.]0$", ""), F.lit("-")), F.lit(")"),
        )

    return F.array_join(F.transform(score, one), ", ")


def live_alerts(feed: DataFrame) -> DataFrame:
    """The first live item, else the first item, of each poll (``poll_id``) by ``position``."""
    rank = F.struct(F.when(F.col("live"), 0).otherwise(1).alias("k"), "position")
    payload = F.struct("id", "name", "status", "teams", "score")
    first = feed.groupBy("poll_id").agg(F.min_by(payload, rank).alias("m"))
    return first.select(
        "poll_id",
        F.trim("m.id").alias("match_id"),
        F.coalesce(F.nullif(F.trim("m.name"), F.lit("")), F.lit("Live Match Alert")).alias("title"),
        F.concat_ws(" | ", F.nullif(F.trim("m.status"), F.lit("")), F.nullif(score_line("m.score"), F.lit(""))).alias("summary"),
        F.trim("m.status").alias("status"),
        F.col("m.teams").alias("teams"),
    )


def live_docs(matches: DataFrame) -> DataFrame:
    """Documents of ingested matches: (``id``, ``doc_type``, ``document``, ``metadata``).

    ``matches``: normalised feed columns with ``winner`` and ``narrative``.
    """
    teams = F.array_join(F.filter("teams", lambda t: F.trim(t) != ""), " vs ")
    date = first_non_empty("date_time_gmt", "date")
    meta = F.create_map(
        *[
            x
            for k, v in {
                "doc_type": F.lit("match_summary"),
                "match_id": F.trim("id"),
                "date": date,
                "match_type": F.trim("match_type"),
                "venue": F.trim("venue"),
                "winner": F.trim("winner"),
                "source": F.lit("live_sync"),
            }.items()
            for x in (F.lit(k), v)
        ]
    )
    document = F.concat(
        F.lit("Cricket match "), F.trim("id"), F.lit(" on "), first_non_empty(date, F.lit("date unavailable")),
        F.lit(" "), F.trim("match_type"), F.lit(" at "), first_non_empty("venue", F.lit("venue unavailable")),
        F.lit(". Teams: "), first_non_empty(teams, "name", F.lit("Unknown")),
        F.lit(". Winner: "), first_non_empty("winner", F.lit("unknown")),
        F.lit(". Narrative: "), first_non_empty("narrative", "status", F.lit("n/a")), F.lit("."),
    )
    return matches.select(
        F.concat(F.lit("match:"), F.trim("id")).alias("id"),
        F.lit("match_summary").alias("doc_type"),
        document.alias("document"),
        meta.alias("metadata"),
    )


def narrative(top_batters="top_batters", top_bowlers="top_bowlers") -> Column:
    """Short account of a completed feed item from its own fields and its best performers."""

    def sentence(test: Column, *parts) -> Column:
        return F.when(test, F.concat(*parts))

    def filled(c) -> Column:
        return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != ""

    return F.concat_ws(
        " ",
        F.concat(
            first_non_empty("name", F.lit("Completed match")), F.lit(" finished with status: "),
            first_non_empty("status", F.lit("result unavailable")), F.lit("."),
        ),
        sentence(filled("winner"), F.col("winner"), F.lit(" won the match.")),
        sentence(filled("venue"), F.lit("Venue: "), F.col("venue"), F.lit(".")),
        sentence(F.size("score") > 0, F.lit("Score summary: "), score_line(), F.lit(".")),
        sentence(filled(top_batters), F.lit("Top batting performances: "), F.col(top_batters), F.lit(".")),
        sentence(filled(top_bowlers), F.lit("Top bowling figures: "), F.col(top_bowlers), F.lit(".")),
    )


def parse_scorecards(payloads: DataFrame, column: str = "scorecard") -> DataFrame:
    return payloads.withColumn("innings", F.from_json(column, SCORECARD_DDL)).drop(column)


def batting_lines(scorecards: DataFrame, key: str) -> DataFrame:
    """One row per batter and innings of parsed scorecards."""
    rows = scorecards.select(key, F.posexplode("innings").alias("n", "i")).select(
        key, (F.col("n") + 1).alias("inning_no"), _nz("i.inning").alias("inning"), F.explode("i.batting").alias("b")
    )
    return rows.select(
        key, "inning_no", "inning",
        _nz("b.batsman.id").alias("batsman_id"),
        _nz("b.batsman.name").alias("batsman"),
        _nz("b.dismissal").alias("dismissal"),
        first_non_empty(F.col("b")["dismissal-text"], F.col("b.dismissal_text")).alias("dismissal_text"),
        _nz("b.bowler.name").alias("bowler"),
        _nz("b.catcher.name").alias("catcher"),
        *[F.coalesce(F.col("b")[src], F.lit(0)).alias(dst) for src, dst in (("r", "runs"), ("b", "balls"), ("4s", "fours"), ("6s", "sixes"))],
        F.col("b.sr").alias("strike_rate"),
    )


def bowling_lines(scorecards: DataFrame, key: str) -> DataFrame:
    rows = scorecards.select(key, F.posexplode("innings").alias("n", "i")).select(
        key, (F.col("n") + 1).alias("inning_no"), _nz("i.inning").alias("inning"), F.explode("i.bowling").alias("b")
    )
    numbers = (("m", "maidens"), ("r", "runs_conceded"), ("w", "wickets"), ("nb", "noballs"), ("wd", "wides"))
    return rows.select(
        key, "inning_no", "inning",
        _nz("b.bowler.id").alias("bowler_id"),
        _nz("b.bowler.name").alias("bowler"),
        F.coalesce("b.o", F.lit(0.0)).alias("overs"),
        *[F.coalesce(F.col("b")[src], F.lit(0)).alias(dst) for src, dst in numbers],
        F.col("b.eco").alias("economy"),
    )


def _nz(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


# Player id in a profile link: after /player/, else any long number (fixed formats).
PLAYER_LINK = r"(?i)/player/(?:[^/]+/)?(\d+)\b"
LONG_NUMBER = r"\b(\d{4,})\b"


def search_item_id(*direct, links=()) -> Column:
    """First given id, else the id inside the first link that holds one."""
    from_links = []
    for link in links:
        from_links += [find(link, PLAYER_LINK), find(link, LONG_NUMBER)]
    return first_non_empty(*direct, *from_links)


def normalize_search_items(items: DataFrame) -> DataFrame:
    """Search results to (``id``, ``name``, ``team_slug``, ``team``) from their alternative fields."""
    return items.select(
        search_item_id("id", "objectId", "playerId", links=("url", "link", "href", "mobileUrl")).alias("id"),
        first_non_empty("displayName", "name", "title").alias("name"),
        first_non_empty("teamSlug", "team_slug").alias("team_slug"),
        first_non_empty("subtitle", "team", "description").alias("team"),
    )


# Statistic labels and their aliases, in the order they are tried.
STAT_LABELS = [
    ("matches", ["matches", "mat"]),
    ("innings", ["innings", "inns", "inn"]),
    ("runs", ["runs"]),
    ("average", ["average", "avg"]),
    ("strike_rate", ["strike rate", "strike_rate", "sr"]),
    ("high_score", ["high score", "highest score", "hs"]),
    ("wickets", ["wickets", "wkts"]),
    ("economy", ["economy", "econ", "eco"]),
    ("best_bowling", ["best bowling", "best bowling innings", "bbi"]),
]


def stat_metric(label) -> Column:
    """The statistic a label names: the first whose alias the label contains."""

    def named(n: Column) -> Column:
        out = F.when(n == "", F.lit(None).cast("string"))
        for metric, aliases in STAT_LABELS:
            test = F.lit(False)
            for alias in aliases:
                test = test | F.contains(n, F.lit(alias))
            out = out.when(test, metric)
        return out

    return bound_once(normalize_text(label), named)


def stats_from_entries(entries: DataFrame, key: str = "player", seq: str = "seq") -> DataFrame:
    """Label and value rows to one column per statistic; a later row overwrites an earlier one."""
    named = entries.withColumn("metric", stat_metric("label")).filter("metric IS NOT NULL AND trim(value) != ''")
    last = F.max_by(F.trim("value"), seq)
    return named.groupBy(key).pivot("metric", [m for m, _ in STAT_LABELS]).agg(last)


def career_rollup(formats: DataFrame, key: str = "player") -> DataFrame:
    """Career totals over the rows of each format: (``side`` bat or bowl, counts)."""

    def total(side: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col(column))), F.lit(0))

    sums = formats.groupBy(key).agg(
        *[
            total(side, c).alias(f"{side}_{c}")
            for side, columns in (
                ("bat", ["matches", "innings", "notouts", "runs", "balls", "fours", "sixes"]),
                ("bowl", ["matches", "balls", "runs", "wickets"]),
            )
            for c in columns
        ]
    )
    dismissals = F.greatest(F.col("bat_innings") - F.col("bat_notouts"), F.lit(0))
    return sums.select(
        key,
        F.when(F.col("bat_matches") != 0, F.col("bat_matches")).otherwise(F.col("bowl_matches")).alias("matches"),
        F.col("bat_runs").alias("runs"),
        rates.per_unit("bat_runs", dismissals).alias("average"),
        rates.percentage("bat_runs", "bat_balls").alias("strike_rate"),
        F.col("bowl_wickets").alias("wickets"),
        rates.economy_rate("bowl_runs", "bowl_balls").alias("economy"),
        F.col("bat_fours").alias("fours"),
        F.col("bat_sixes").alias("sixes"),
    )


def merge_profiles(archive: DataFrame, provider: DataFrame, key: str, texts: list[str], stats: list[str]) -> DataFrame:
    """Archive values first, provider values where the archive has none; statistics as one block."""
    a = archive.select(key, *[F.col(c).alias(f"a_{c}") for c in texts + stats])
    p = provider.select(key, *[F.col(c).alias(f"p_{c}") for c in texts + stats])
    known = rates.has_meaningful_stats(*[f"a_{s}" for s in stats])
    return a.join(p, key, "full_outer").select(
        key,
        *[first_non_empty(f"a_{c}", f"p_{c}").alias(c) for c in texts],
        *[F.coalesce(F.when(known, F.col(f"a_{c}")).otherwise(F.col(f"p_{c}")), F.lit(0)).alias(c) for c in stats],
        F.when(known, "archive").otherwise("provider").alias("stats_source"),
    )
