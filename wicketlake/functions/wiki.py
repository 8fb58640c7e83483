"""Infobox fields and title counts from wikitext columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.functions.text import find, normalize_text

# Start of the box, number words and the competition counted separately.
BOX_START = "{{Infobox cricket team"
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
LEAGUE_TITLE = r"(?i)\bipl\b|indian premier league"


def strip_markup(c) -> Column:
    """Wikitext to plain text: comments, references, templates (nested too), links, quotes and tags removed."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<ref[^>]*/>", " ")
    t = F.regexp_replace(t, r"(?is)<ref.*?</ref>", " ")
    t = F.regexp_replace(t, r"(?i)&nbsp;", " ")
    # Each pass removes the innermost templates; no text needs more passes than it has openings.
    passes = F.sequence(F.lit(0), F.size(F.split(t, r"\{\{")) - 1)
    t = F.aggregate(passes, t, lambda acc, _: F.regexp_replace(acc, r"\{\{[^{}]*\}\}", " "))
    t = F.regexp_replace(t, r"\[\[(?:[^|\]]+\|)?([^\]]+)\]\]", "$1")
    t = F.regexp_replace(t, r"\[https?://[^\s\]]+\s*([^\]]*)\]", "$1")
    t = F.regexp_replace(t, r"'''|''", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def infobox_fields(pages: DataFrame, key: str = "title", text: str = "wikitext") -> DataFrame:
    """(``key``, ``field``, ``value``): the last value of each non-empty field of the box."""
    start = F.locate(BOX_START, F.col(text))
    tail = F.expr(f"substring({text}, locate('{BOX_START}', {text}))")
    end = F.locate("\n}}", tail)
    block = F.when(start == 0, F.lit("")).when(end > 1, F.substring(tail, F.lit(1), end - 1)).otherwise(tail)
    lines = pages.select(key, F.posexplode(F.split(block, "\n")).alias("at", "line")).filter(
        F.col("line").rlike(r"^\|\s*([^=]+?)\s*=\s*(.*)$")
    )
    rows = lines.select(
        key, "at",
        F.translate(normalize_text(F.regexp_extract("line", r"^\|\s*([^=]+?)\s*=\s*(.*)$", 1)), " ", "_").alias("field"),
        strip_markup(F.regexp_extract("line", r"^\|\s*([^=]+?)\s*=\s*(.*)$", 2)).alias("value"),
    ).filter("field != '' AND value != ''")
    return rows.groupBy(key, "field").agg(F.max_by("value", "at").alias("value"))


def count_in_text(c) -> Column:
    """First number of a text, in digits or as a word up to ten; null without one."""
    digits = find(c, r"\b(\d+)\b")
    word = F.lower(find(c, r"(?i)\b(" + "|".join(NUMBER_WORDS) + r")\b"))
    place = F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), word)
    return F.when(digits != "", digits.try_cast("int")).when(place > 0, place.cast("int"))


def title_totals(fields: DataFrame, key: str = "title") -> DataFrame:
    """Titles won per team: all of them, and those of the league."""
    slot = F.regexp_extract("field", r"^title(\d+)(wins)?$", 1)
    numbered = fields.withColumn("slot", slot).filter("slot != ''")
    per_slot = numbered.groupBy(key, "slot").agg(
        F.max(F.when(~F.col("field").endswith("wins"), F.col("value"))).alias("name"),
        F.max(F.when(F.col("field").endswith("wins"), count_in_text("value"))).alias("wins"),
    ).filter("name IS NOT NULL AND wins IS NOT NULL")
    league = F.col("name").rlike(LEAGUE_TITLE)
    return per_slot.groupBy(key).agg(
        F.sum("wins").alias("major_titles"),
        F.coalesce(F.min_by("wins", F.when(league, F.col("slot").cast("decimal(38,0)"))), F.lit(0)).alias("league_titles"),
    )


PROFILE_FIELDS = {"captain": "captain", "coach": "coach", "owner": "owner", "home_ground": "ground", "founded": "founded"}


def team_profile(overview: DataFrame, wiki_pages: DataFrame) -> DataFrame:
    """Team overview with infobox fields and title totals; ``wiki_pages`` is (``title``, ``wikitext``)."""
    fields = infobox_fields(wiki_pages)
    wide = fields.groupBy("title").agg(
        *[F.coalesce(F.max(F.when(F.col("field") == src, F.col("value"))), F.lit("")).alias(dst) for dst, src in PROFILE_FIELDS.items()]
    )
    out = overview.join(wide.withColumnRenamed("title", "team"), "team", "left").join(
        title_totals(fields).withColumnRenamed("title", "team"), "team", "left"
    )
    return out.fillna("", list(PROFILE_FIELDS)).fillna(0, ["major_titles", "league_titles"])
