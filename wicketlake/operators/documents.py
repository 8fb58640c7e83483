"""Text documents with metadata for players, teams and matches, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.functions import rates
from wicketlake.functions.text import sanitized_metadata, stable_id

SOURCE_LABEL = "delivery_table"


def _or(c, fallback: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(fallback)).otherwise(c)


def _number(c: str) -> Column:
    return F.col(c).cast("string")


def player_docs(profiles: DataFrame) -> DataFrame:
    ft = rates.float_text
    document = F.concat(
        F.lit("Cricket player profile "), F.col("player"),
        F.lit(". Team "), _or("team", "Unknown"), F.lit(". Role "), F.col("role"),
        F.lit(". Indexed matches "), _number("matches"),
        F.lit(". Runs "), _number("runs"), F.lit(", wickets "), _number("wickets"),
        F.lit(", batting average "), ft("average"), F.lit(", strike rate "), ft("strike_rate"),
        F.lit(", bowling economy "), ft("economy"),
        F.lit(". Fours "), _number("fours"), F.lit(", sixes "), _number("sixes"), F.lit("."),
    )
    meta = sanitized_metadata(
        {
            "doc_type": (F.lit("player_profile"), False),
            "player": ("player", False),
            "team": ("team", False),
            "role": ("role", False),
            "matches": ("matches", False),
            "runs": ("runs", False),
            "wickets": ("wickets", False),
            "average": (ft("average"), False),
            "strike_rate": (ft("strike_rate"), False),
            "economy": (ft("economy"), False),
            "fours": ("fours", False),
            "sixes": ("sixes", False),
            "is_active": (F.lit(False), False),
            "source": (F.lit(SOURCE_LABEL), False),
        }
    )
    return profiles.select(
        stable_id("player", "player").alias("id"),
        F.lit("player_profile").alias("doc_type"),
        document.alias("document"),
        meta.alias("metadata"),
    )


def team_docs(teams: DataFrame) -> DataFrame:
    ft = rates.float_text
    document = F.concat(
        F.lit("Cricket team summary for "), F.col("team"),
        F.lit(". Indexed matches "), _number("matches"), F.lit(", wins "), _number("wins"),
        F.lit(", losses "), _number("losses"), F.lit(", no result "), _number("no_result"),
        F.lit(", win rate "), ft("win_rate"), F.lit(" percent. Total batting runs "), _number("runs"),
        F.lit(", average score "), ft("average_score"),
        F.lit(", team strike rate "), ft("strike_rate"), F.lit("."),
    )
    meta = sanitized_metadata(
        {
            "doc_type": (F.lit("team_summary"), False),
            "team": ("team", False),
            "matches": ("matches", False),
            "wins": ("wins", False),
            "losses": ("losses", False),
            "no_result": ("no_result", False),
            "win_rate": (ft("win_rate"), False),
            "runs": ("runs", False),
            "average_score": (ft("average_score"), False),
            "strike_rate": (ft("strike_rate"), False),
            "source": (F.lit(SOURCE_LABEL), False),
        }
    )
    return teams.select(
        stable_id("team", "team").alias("id"),
        F.lit("team_summary").alias("doc_type"),
        document.alias("document"),
        meta.alias("metadata"),
    )


def innings_text(innings="innings") -> Column:
    return F.array_join(
        F.transform(
            innings,
            lambda i: F.concat(
                F.when(i.team == "", i.inning_key).otherwise(i.team),
                F.lit(": "), i.runs.cast("string"), F.lit("/"), i.wickets.cast("string"),
                F.lit(" in "), rates.float_text(rates.overs_decimal(i.balls)), F.lit(" overs"),
            ),
        ),
        "; ",
    )


def match_docs(matches: DataFrame) -> DataFrame:
    document = F.concat(
        F.lit("Cricket match "), F.col("match_id"), F.lit(" on "), _or("match_date", "date unavailable"),
        F.lit(" "), F.col("match_type"), F.lit(". Teams: "), _or(F.array_join("teams", " vs "), "Unknown"),
        F.lit(". Venue: "), _or("venue", "venue unavailable"), F.lit(". Winner: "), _or("winner", "unknown"),
        F.lit(". Innings summary: "), innings_text(), F.lit("."),
    )
    meta = sanitized_metadata(
        {
            "doc_type": (F.lit("match_summary"), False),
            "match_id": ("match_id", False),
            "date": ("match_date", False),
            "season": ("season", False),
            "match_type": ("match_type", False),
            "venue": ("venue", False),
            "city": ("city", False),
            "winner": ("winner", False),
            "source": (F.lit(SOURCE_LABEL), False),
        }
    )
    return matches.select(
        F.concat(F.lit("match:"), "match_id").alias("id"),
        F.lit("match_summary").alias("doc_type"),
        document.alias("document"),
        meta.alias("metadata"),
    )


def all_docs(profiles: DataFrame, teams: DataFrame, matches: DataFrame) -> DataFrame:
    return player_docs(profiles).unionByName(team_docs(teams)).unionByName(match_docs(matches))


# Where a typed column is found in the text of a document: (kind, pattern). Fixed formats.
_PLAYER_FIELDS = {
    "player": ("text", r"(?i)Cricket player profile\s+(.+?)\."),
    "matches": ("number", r"(?i)Indexed matches\s+([0-9,]+)"),
    "runs": ("number", r"(?i)\bRuns\s+([0-9,]+)"),
    "wickets": ("number", r"(?i)\bwickets\s+([0-9,]+)"),
    "average": ("number", r"(?i)batting average\s+([0-9.]+)"),
    "strike_rate": ("number", r"(?i)strike rate\s+([0-9.]+)"),
    "economy": ("number", r"(?i)bowling economy\s+([0-9.]+)"),
    "fours": ("number", r"(?i)Fours\s+([0-9,]+)"),
    "sixes": ("number", r"(?i)sixes\s+([0-9,]+)"),
}
_TEAM_FIELDS = {
    "team": ("text", r"(?i)Cricket team summary for\s+(.+?)\."),
    "matches": ("number", r"(?i)Indexed matches\s+([0-9,]+)"),
    "wins": ("number", r"(?i)\bwins\s+([0-9,]+)"),
    "losses": ("number", r"(?i)losses\s+([0-9,]+)"),
    "no_result": ("number", r"(?i)no result\s+([0-9,]+)"),
    "win_rate": ("number", r"(?i)win rate\s+([0-9.]+)"),
    "runs": ("number", r"(?i)Total batting runs\s+([0-9,]+)"),
    "average_score": ("number", r"(?i)average score\s+([0-9.]+)"),
    "strike_rate": ("number", r"(?i)team strike rate\s+([0-9.]+)"),
}


def _field(name: str, kind: str, pattern: str) -> Column:
    stored = F.nullif(F.trim(F.try_element_at("metadata", F.lit(name))), F.lit(""))
    found = F.regexp_extract("document", pattern, 1)
    if kind == "text":
        return F.coalesce(stored, F.trim(found)).alias(name)

    def number(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, ",", ""), "[.]$", "").try_cast("double")

    return F.coalesce(F.nullif(number(stored), F.lit(0.0)), number(found), F.lit(0.0)).alias(name)


def parse_player_docs(docs: DataFrame) -> DataFrame:
    """Typed columns from the metadata, or from the text where metadata is missing."""
    return docs.filter("doc_type = 'player_profile'").select("id", *[_field(n, *f) for n, f in _PLAYER_FIELDS.items()])


def parse_team_docs(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_type = 'team_summary'").select("id", *[_field(n, *f) for n, f in _TEAM_FIELDS.items()])


def archive_status(docs: DataFrame, built_at: str = "") -> DataFrame:
    return docs.groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.min(F.nullif(F.try_element_at("metadata", F.lit("date")), F.lit(""))), F.lit("")).alias("min_date"),
        F.coalesce(F.max(F.nullif(F.try_element_at("metadata", F.lit("date")), F.lit(""))), F.lit("")).alias("max_date"),
        F.lit(built_at).alias("built_at"),
    )
