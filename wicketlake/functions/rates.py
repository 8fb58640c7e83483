"""Numeric helpers and the scoring rules of the game."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of wicket that are credited to the bowler.
CREDITED_KINDS = [
    "bowled",
    "caught",
    "caught and bowled",
    "lbw",
    "stumped",
    "hit wicket",
]

# Thresholds of the role rule.
ALL_ROUNDER_RUNS = 200
ALL_ROUNDER_WICKETS = 20
RUNS_PER_WICKET_OF_A_BOWLER = 25


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(c) -> Column:
    return F.round(_col(c).cast("double"), 2)


def safe_divide(a, b) -> Column:
    a, b = _col(a).cast("double"), _col(b).cast("double")
    return F.when(F.coalesce(b, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.coalesce(a, F.lit(0.0)) / b)


def clamp(c, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(c)))


def overs_string(balls) -> Column:
    whole = F.greatest(F.floor(_col(balls)), F.lit(0)).cast("long")
    return F.concat((whole / 6).cast("long").cast("string"), F.lit("."), F.pmod(whole, F.lit(6)).cast("string"))


def overs_decimal(balls) -> Column:
    return F.round(F.greatest(_col(balls), F.lit(0)).cast("double") / 6, 2)


def legal_ball(wides="extras_wides", noballs="extras_noballs") -> Column:
    return (_col(wides) == 0) & (_col(noballs) == 0)


def credited_wicket(kind="wicket_kind") -> Column:
    return F.lower(_col(kind)).isin(CREDITED_KINDS)


def batting_average(runs, dismissals) -> Column:
    r, d = _col(runs).cast("double"), _col(dismissals)
    return F.when(d <= 0, r).otherwise(F.round(r / d, 2))


def strike_rate(runs, balls) -> Column:
    r, b = _col(runs).cast("double"), _col(balls)
    return F.when(b <= 0, F.lit(0.0)).otherwise(F.round(r / b * 100, 2))


def economy_rate(conceded, balls) -> Column:
    r, b = _col(conceded).cast("double"), _col(balls)
    return F.when(b <= 0, F.lit(0.0)).otherwise(F.round(r / (b / 6), 2))


def percentage(part, whole) -> Column:
    p, w = _col(part).cast("double"), _col(whole)
    return F.when(w <= 0, F.lit(0.0)).otherwise(F.round(p / w * 100, 2))


def per_unit(total, count) -> Column:
    t, n = _col(total).cast("double"), _col(count)
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.round(t / n, 2))


def player_role(runs, wickets) -> Column:
    r, w = _col(runs), _col(wickets)
    return (
        F.when((r >= ALL_ROUNDER_RUNS) & (w >= ALL_ROUNDER_WICKETS), "All-rounder")
        .when((w > 0) & (w * RUNS_PER_WICKET_OF_A_BOWLER > r), "Bowler")
        .otherwise("Batter")
    )


def squad_role(role) -> Column:
    """Display role of a squad member: fixed names by word."""
    from wicketlake.functions.text import normalize_text

    n = normalize_text(role)
    raw = F.trim(F.coalesce(_col(role), F.lit("")))
    return (
        F.when(n == "", "Player")
        .when(n.rlike(r"\bkeeper\b|\bwicket"), "Wicketkeeper")
        .when(n.rlike(r"\ball\b"), "All-rounder")
        .when(n.rlike(r"\bbowl"), "Bowler")
        .when(n.rlike(r"\bbat"), "Batsman")
        .otherwise(F.when(raw == "", "Player").otherwise(raw))
    )


def has_meaningful_stats(*stats) -> Column:
    return F.greatest(*[F.coalesce(_col(s).cast("double"), F.lit(0.0)) for s in stats], F.lit(0.0)) > 0


def float_text(c) -> Column:
    """A two-decimal number as text with at least one decimal: 45.0, 12.5, 12.25."""
    d = F.coalesce(_col(c).cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)")).cast("string")
    return F.regexp_replace(d, "0$", "")


def grouped_number_text(c) -> Column:
    """A number with thousands separators and at most two decimals: 1,234 or 12.5."""
    d = F.format_number(F.coalesce(_col(c).cast("double"), F.lit(0.0)), 2)
    return F.regexp_replace(F.regexp_replace(d, "0+$", ""), "[.]$", "")
