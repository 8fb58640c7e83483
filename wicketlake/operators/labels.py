"""Labels for a table of questions (``question_id``, ``text``).

Each step adds columns to the same rows; nothing is shuffled. Rules are ordered and the first
that holds decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.functions import question_rules as qr
from wicketlake.functions.text import (
    ascii_words,
    bound_once,
    find,
    matches,
    normalize_text,
    proper_names,
    replace,
    stat_key,
    strip,
)
from wicketlake.operators.ordered import carried


def _q(pattern: str) -> Column:
    """Whether the normalised question has the pattern."""
    return F.col("q").rlike(pattern)


def _first(rules, default: str) -> Column:
    """Label of the first rule that holds; a rule is (label, condition)."""
    out = None
    for label, condition in rules:
        label = F.lit(label) if isinstance(label, str) else label
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(F.lit(default))


def _pattern_label(rules, default: str) -> Column:
    return _first([(label, _q(pattern)) for label, pattern in rules], default)


def prepared(questions: DataFrame) -> DataFrame:
    """Adds the trimmed text ``raw`` and its normalised form ``q``."""
    return questions.withColumn("raw", strip("text")).withColumn("q", normalize_text("raw"))


def scope(df: DataFrame) -> DataFrame:
    """Season, match number and format."""
    return df.withColumns(
        {
            "season": find("raw", qr.YEAR),
            "match_number": find("raw", qr.MATCH_NUMBER),
            "format": _pattern_label(qr.FORMATS, ""),
            "format_wide": _pattern_label(qr.FORMATS_WIDE, ""),
        }
    )


def metric(df: DataFrame) -> DataFrame:
    """Metric of a leaderboard, the guessed metric, and whether a rate stands in for fastest scoring."""
    return df.withColumns(
        {
            "metric": _pattern_label(qr.METRICS, qr.DEFAULT_METRIC),
            "guessed_metric": _pattern_label(qr.GUESSED_METRICS, qr.DEFAULT_METRIC),
            "is_proxy": _q(qr.FASTEST),
        }
    )


def clean_side(c: Column) -> Column:
    """One side of a two-sided question without leading words, edges, context and noise.

    A pattern runs only on text that holds the words it needs.
    """

    def edges(x: Column) -> Column:
        return strip(F.regexp_replace(x, qr.SIDE_EDGES, ""))

    for lead in qr.SIDE_LEAD:
        c = replace(c, lead)
    steps = [
        (lambda x, w=word: F.contains(F.lower(x), F.lit(w)), pattern) for word, pattern in qr.SIDE_CONTEXT
    ]
    ends = [F.lit(w) for w in qr.SIDE_NOISE_WORDS]
    steps.append((lambda x: F.exists(F.array(*ends), lambda w: F.endswith(F.lower(x), w)), qr.SIDE_NOISE))
    c = edges(c)
    for needed, pattern in steps:
        c = bound_once(c, lambda x, n=needed, p=pattern: F.when(n(x), edges(replace(x, p))).otherwise(x))
    return c


def sides(df: DataFrame) -> DataFrame:
    """``side_left`` and ``side_right``: the first pattern with both sides left after cleaning."""
    # The sides of every pattern that matches, in order; only those are cleaned.
    out = df.withColumn("_stripped", clean_side(F.col("raw")))
    split = F.array(
        *[
            F.when(
                F.contains(F.lower("_stripped"), F.lit(word)) & matches("_stripped", p),
                F.struct(find("_stripped", p, 1).alias("l"), find("_stripped", p, 2).alias("r")),
            )
            for word, p in qr.SIDE_PATTERNS
        ]
    )
    clean = F.transform(
        F.filter(split, lambda o: o.isNotNull()),
        lambda o: F.struct(clean_side(o["l"]).alias("l"), clean_side(o["r"]).alias("r")),
    )
    first = F.try_element_at(F.filter(clean, lambda o: (o["l"] != "") & (o["r"] != "")), F.lit(1))
    return (
        out.withColumn("_sides", first)
        .withColumns(
            {
                "side_left": F.coalesce("_sides.l", F.lit("")),
                "side_right": F.coalesce("_sides.r", F.lit("")),
            }
        )
        .drop("_stripped", "_sides")
    )


def signals(df: DataFrame) -> DataFrame:
    """Greeting, domain, rough statistics, off topic and forced live."""
    some = F.col("q") != ""
    out = df.withColumns(
        {
            "greeting": matches("raw", qr.CHAT_WORDS) | matches("raw", qr.CHAT_START),
            "in_domain": some & (_q(qr.DOMAIN) | _q(qr.DOMAIN_ALIASES) | _q(qr.DOMAIN_VERSUS)),
            "_words": F.size(F.filter(F.split("raw", r"\s+"), lambda w: w != "")),
        }
    )
    out = out.withColumn(
        "rough_stats", some & ~F.col("greeting") & _q(qr.ROUGH_STATS) & (F.col("_words") <= qr.ROUGH_STATS_WORDS)
    ).drop("_words")
    out = out.withColumn(
        "off_topic",
        some
        & ~F.col("in_domain")
        & ~F.col("rough_stats")
        & (F.col("greeting") | _q(qr.OFF_TOPIC_WORDS) | _q(qr.OFF_TOPIC_START)),
    )
    return out.withColumn(
        "forced_live",
        some
        & ~F.col("off_topic")
        & ~_q(qr.PREDICTION)
        & ~_q(qr.TEAM_COMPARISON)
        & _q(qr.STRICT_LIVE)
        & F.col("in_domain"),
    )


def intent(df: DataFrame) -> DataFrame:
    """``rule``, ``action`` and the sub-intent the rule gives (empty when it gives none)."""
    two = (F.col("side_left") != "") & (F.col("side_right") != "")
    fantasy, forecast = _q(qr.FANTASY), _q(qr.MATCH_PREDICTION)
    teams = _q(qr.TEAM_COMPARISON)
    know = "general_knowledge"
    equipment = _first([("coaching_drill", _q(qr.DRILLS))], "equipment_info")
    history = _first([("worldcup_history", _q(qr.WORLD_CUP))], "history_trivia")
    analysis = [("fantasy_tip", fantasy), ("match_prediction", forecast)]
    top = (_q(qr.TOP_WORDS) & _q(qr.TOP_SUBJECTS)) | _q(qr.TOP_AGGRESSIVE)
    none = F.lit("")
    # (rule, condition, action, sub-intent)
    rules = [
        ("empty", F.col("raw") == "", "not_supported", none),
        ("greeting", F.col("greeting"), "chit_chat", none),
        ("off_topic", F.col("off_topic"), "chit_chat", none),
        ("forced_live", F.col("forced_live"), "live_update", none),
        ("points_table", _q(qr.POINTS_TABLE), know, F.lit("points_table")),
        ("ranking", _q(qr.RANKING), know, F.lit("team_ranking")),
        ("pitch", _q(qr.PITCH), know, F.lit("pitch_report")),
        ("injury", _q(qr.INJURY), know, F.lit("injury_update")),
        ("record", _q(qr.RECORD), "record_lookup", none),
        (
            "squad",
            ~_q(qr.SQUAD_PLAYER_STATS) & _q(qr.SQUAD),
            _first([("playing_xi", _q(qr.PLAYING_XI))], "team_squad"),
            none,
        ),
        ("team_info", ~_q(qr.PREDICTION) & ~fantasy & _q(qr.TEAM_INFO), "team_info", none),
        ("format_comparison", _q(qr.FORMAT_COMPARISON), know, F.lit("format_comparison")),
        (
            "rules",
            _q(qr.RULES) | _q(qr.TERMS),
            know,
            _first([("rules_explainer", _q(qr.RULES))], "terminology_explainer"),
        ),
        (
            "history",
            _q(qr.HISTORY) | _q(qr.EQUIPMENT),
            know,
            F.when(_q(qr.EQUIPMENT), equipment).otherwise(history),
        ),
        (
            "glossary",
            _q(qr.GLOSSARY_ASK),
            _first([("glossary", _q(qr.GLOSSARY_TERM))], "subjective_analysis"),
            none,
        ),
        ("top", top, "top_players", none),
        ("head_to_head", _q(qr.HEAD_TO_HEAD), "head_to_head", none),
        (
            "compare",
            _q(qr.COMPARE),
            _first([("subjective_analysis", _q(qr.COMPARE_TEAMS))], "compare_players"),
            _first([("team_comparison", _q(qr.COMPARE_TEAMS))], "player_comparison"),
        ),
        (
            "predict",
            _q(qr.PREDICTION) | teams | (two & _q(qr.BETTER)),
            _first([("compare_players", two & ~teams)], "subjective_analysis"),
            _first([*analysis, ("team_comparison", two & teams), ("player_comparison", two)], "strategy_analysis"),
        ),
        ("live", _q(qr.LIVE_LATE), "live_update", none),
        ("team_summary", _q(qr.TEAM_SUMMARY), "team_stats", none),
        ("match", _q(qr.MATCH_WORDS), "match_summary", none),
        ("team", _q(qr.TEAM_WORD), "team_stats", none),
        ("reasoning", _q(qr.REASONING), "subjective_analysis", _first(analysis, "strategy_analysis")),
        ("rough_stats", F.col("rough_stats"), "player_stats", none),
        ("season", F.col("season") != "", "player_season_stats", none),
    ]
    out = df.withColumn("rule", _first([(name, test) for name, test, _, _ in rules], "player"))
    by_rule = F.col("rule")
    return out.withColumns(
        {
            "action": _first([(act, by_rule == name) for name, _, act, _ in rules], "player_stats"),
            "given_sub_intent": _first([(sub, by_rule == name) for name, _, _, sub in rules], ""),
        }
    )


def _default_sub_intent() -> Column:
    action = F.col("action")
    live = _first(
        [
            ("points_table", _q(qr.POINTS_TABLE)),
            ("fixture_schedule", _q(qr.SCHEDULE_WORDS)),
            ("recent_result", _q(qr.RESULT_WORDS)),
            ("venue_info", _q(qr.VENUE)),
            ("pitch_report", _q(qr.PITCH)),
        ],
        "live_update",
    )
    analysis = _first(
        [
            ("fantasy_tip", _q(qr.FANTASY)),
            ("match_prediction", _q(qr.MATCH_PREDICTION)),
            ("team_comparison", _q(qr.TEAM_COMPARISON)),
        ],
        "strategy_analysis",
    )
    info = _first([("venue_info", _q(qr.VENUE)), ("injury_update", _q(qr.INJURY))], "team_stats")
    return (
        F.when(action == "live_update", live)
        .when(action.isin("player_stats", "player_season_stats"), "player_stats")
        .when(action == "team_stats", _first([("team_ranking", _q(qr.RANKING))], "team_stats"))
        .when(action == "team_squad", "squad_info")
        .when(action == "compare_players", "player_comparison")
        .when(action == "head_to_head", "team_comparison")
        .when(action == "subjective_analysis", analysis)
        .when(action == "team_info", info)
        .when(action == "glossary", "terminology_explainer")
        .when(action == "chit_chat", "general_cricket_fallback")
        .otherwise(action)
    )


def context(df: DataFrame) -> DataFrame:
    """Sub-intent, time context and answer mode."""
    sub = F.when(F.col("given_sub_intent") != "", F.col("given_sub_intent")).otherwise(_default_sub_intent())
    out = df.withColumn("sub_intent", sub)
    seasonal = F.when(matches("raw", qr.YEAR), "seasonal").otherwise("general")
    when = None
    for label, pattern in qr.TIME_CONTEXTS:
        when = F.when(_q(pattern), label) if when is None else when.when(_q(pattern), label)
    action = F.col("action")
    mode = (
        F.when(action == "live_update", "live")
        .when(action == "subjective_analysis", "analysis")
        .when(action.isin(qr.KNOWLEDGE_ACTIONS), "knowledge")
        .when(F.col("sub_intent") == "match_prediction", "analysis")
        .otherwise("fact")
    )
    return out.withColumns({"time_context": when.otherwise(seasonal), "answer_mode": mode})


# Rules whose route names its subject: the whole text, or the two sides.
_WHOLE_TEXT = ["squad", "team_info", "team_summary", "team", "rough_stats", "season", "player"]
_SIDES = ["head_to_head", "compare", "predict", "match", "reasoning"]
_PLAYER_TEXT = ["rough_stats", "season", "player"]


def confidence(df: DataFrame) -> DataFrame:
    rule = F.col("rule")
    named = rule.isin(_WHOLE_TEXT) | (rule.isin(_SIDES) & (F.col("side_left") != ""))
    score = (
        F.lit(62)
        + F.when(F.col("action") != "not_supported", 8).otherwise(0)
        + F.when(named, 8).otherwise(0)
        + F.when(_q(qr.RULES) | _q(qr.TERMS), 12).otherwise(0)
        + F.when(_q(qr.LIVE_DATA) | _q(qr.PREDICTION), 10).otherwise(0)
        - F.when(F.col("rough_stats"), 5).otherwise(0)
    )
    score = F.when(F.col("off_topic"), 95).otherwise(score)
    return df.withColumn("confidence", F.least(F.lit(99), F.greatest(F.lit(45), score)) / 100)


def sources(df: DataFrame) -> DataFrame:
    """Data sources a question needs, in order."""
    action, rule = F.col("action"), F.col("rule")
    has_sides = F.col("side_left") != ""
    compared = (rule.isin("predict", "reasoning") | ((rule == "compare") & (action == "compare_players"))) & has_sides
    player_named = rule.isin(_PLAYER_TEXT) | compared | matches("raw", qr.CAPITALISED)
    out = df.withColumns(
        {
            "_live": _q(qr.LIVE_DATA) | ((action == "match_summary") & _q(qr.MATCH_LIVE)),
            "_player": (_q(qr.PLAYER_DATA) & player_named) | action.isin(qr.PLAYER_ACTIONS),
            "_know": _q(qr.KNOWLEDGE) | action.isin(qr.KNOWLEDGE_ACTIONS) | F.col("given_sub_intent").isin(qr.KNOWLEDGE_TOPICS),
            "_archive": _q(qr.ARCHIVE_DATA) | action.isin(qr.ARCHIVE_ACTIONS),
            "_free": F.col("greeting") | F.col("off_topic") | _q(qr.REASONING) | action.isin(qr.FREE_ACTIONS),
        }
    )
    nothing = ~(F.col("_live") | F.col("_player") | F.col("_know") | F.col("_archive"))
    free = (F.col("_free") & (action == "subjective_analysis")) | nothing
    name = qr.SOURCES
    listed = F.filter(
        F.array(
            F.when(F.col("_live"), name["live"]),
            F.when(F.col("_player"), name["player"]),
            F.when(F.col("_know"), name["knowledge"]),
            F.when(F.col("_archive"), name["archive"]),
            F.when(free, name["free"]),
        ),
        lambda s: s.isNotNull(),
    )
    only_free = (F.col("q") == "") | (F.col("off_topic") & ~F.col("in_domain"))
    out = out.withColumn("data_sources", F.when(only_free, F.array(F.lit(name["free"]))).otherwise(listed))
    return out.drop("_live", "_player", "_know", "_archive", "_free")


def normalize_sources(values) -> Column:
    """Known source names of a list of written ones, distinct, in order."""
    lookup = F.create_map(
        *[F.lit(x) for known, names in qr.SOURCE_SYNONYMS.items() for n in names for x in (n, known)]
    )
    # Underscores separate words in a written name; the normal form drops them.
    keyed = F.transform(values, lambda v: stat_key(F.translate(v, ".", "")))
    return F.array_distinct(
        F.filter(F.transform(keyed, lambda k: F.try_element_at(lookup, k)), lambda s: s.isNotNull())
    )


def normalize_action(c) -> Column:
    """Known action of a written label: itself, by synonym, else not supported."""
    c = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    out = F.when(c.isin(qr.ACTIONS), c)
    for action, names in qr.ACTION_SYNONYMS.items():
        out = out.when(c.isin(names), action)
    return out.otherwise("not_supported")


def explicit_team(df: DataFrame) -> DataFrame:
    """Team named outright: by phrase, else by the first word that is a team's short name."""
    phrase = None
    for name, pattern in qr.TEAM_PHRASES:
        test = matches("raw", pattern)
        phrase = F.when(test, name) if phrase is None else phrase.when(test, name)
    lookup = F.create_map(*[F.lit(x) for pair in qr.TEAM_WORDS.items() for x in pair])
    words = F.filter(F.split("q", " "), lambda w: F.map_contains_key(lookup, w))
    word = F.try_element_at(lookup, F.try_element_at(words, F.lit(1)))
    return df.withColumn("explicit_team", F.coalesce(phrase, word, F.lit("")))


def flags(df: DataFrame) -> DataFrame:
    """Yes-or-no signals; needs ``explicit_team``."""
    affiliation = F.lit(False)
    for ask, verb in qr.FLAG_AFFILIATION:
        affiliation = affiliation | ((_q(ask) & _q(verb)) if verb else _q(ask))
    some = F.col("q") != ""
    batter = ~(_q(qr.FLAG_BOWL_WORDS) & ~_q(qr.FLAG_BAT_WORDS)) & _q(qr.FLAG_BATTER_RANKING)
    formats = sum((F.when(_q(p), 1).otherwise(0) for p in qr.FLAG_FORMATS), F.lit(0))
    return df.withColumns(
        {
            "is_prediction": some & (matches("raw", qr.FLAG_PREDICTION_TEXT) | _q(qr.FLAG_PREDICTION)),
            "is_live": some & _q(qr.FLAG_LIVE),
            "is_rules": _q(qr.FLAG_RULES),
            "is_batter_ranking": some & batter,
            "is_bowler_ranking": some & _q(qr.FLAG_BOWLER_RANKING),
            "is_team_batter": some
            & _q(qr.FLAG_TEAM_BATTER)
            & _q(qr.FLAG_IN_OR_FOR)
            & (F.col("explicit_team") != ""),
            "is_affiliation": some & affiliation,
            "is_identity": some & ~affiliation & ~_q(qr.FLAG_THE_BEST) & matches("raw", qr.FLAG_IDENTITY_START),
            "is_format_comparison": F.contains("q", F.lit("difference between")) & (formats >= 2),
        }
    )


def hints(df: DataFrame, limit: int | None = None, max_chars: int | None = None, max_words: int | None = None) -> DataFrame:
    """Text without generic words, capitalised phrases, and player and team hints from them: all of them, or the
    first ``limit``, and of the sides those within ``max_chars`` and ``max_words``."""
    year = qr.YEAR
    kept = F.filter(
        F.split("q", " "), lambda w: (w != "") & ~w.isin(qr.GENERIC_WORDS) & ~w.rlike(year)
    )
    found = F.regexp_extract_all("raw", F.lit(ascii_words(qr.CAPITALISED_PHRASE)), F.lit(0))
    phrases = F.array_distinct(F.filter(found, lambda p: ~p.isin(qr.COMMON_CAPITALISED)))
    out = df.withColumns({"reduced": F.array_join(kept, " "), "capitalised": phrases})
    given = F.filter(
        F.array("side_left", "side_right"),
        lambda s: (s != "")
        & (normalize_text(s) != F.col("q"))
        & (F.lit(True) if max_chars is None else F.length(s) <= max_chars)
        & (F.lit(True) if max_words is None else F.size(F.split(s, r"\s+")) <= max_words),
    )
    several = F.filter("capitalised", lambda p: p.rlike(r"\s"))
    single = F.filter("capitalised", lambda p: ~p.rlike(r"\s"))
    by_players = F.col("rule").isin("compare", "predict", "reasoning")
    none = F.array().cast("array<string>")
    cut = lambda found: found if limit is None else F.slice(found, 1, limit)
    return out.withColumns(
        {
            "player_hints": cut(F.array_distinct(F.concat(F.when(by_players, given).otherwise(none), several))),
            "team_hints": cut(F.array_distinct(F.concat(F.when(by_players, none).otherwise(given), single))),
        }
    )


def cacheable(df: DataFrame, in_session=False) -> DataFrame:
    in_session = F.lit(in_session) if isinstance(in_session, bool) else in_session
    return df.withColumn(
        "cacheable",
        (F.col("raw") != "")
        & ~matches("raw", qr.CACHE_CHAT)
        & ~matches("raw", qr.CACHE_BYPASS)
        & ~(in_session & matches("raw", qr.ANY_PRONOUN)),
    )


RECORD_FIELDS = ["record_metric", "record_title", "record_patterns", "record_holder", "record_value"]


def curated_record(df: DataFrame, records: list = qr.CURATED_RECORDS) -> DataFrame:
    """The first of ``records`` whose patterns all hold: its metric, title, holder and value; empty without one."""
    tests = []
    for record in records:
        test = F.lit(True)
        for p in record[2]:
            test = test & _q(p)
        tests.append(test)
    made = {}
    for n, name in enumerate(RECORD_FIELDS):
        if name != "record_patterns":
            made[name] = _first([(record[n], test) for record, test in zip(records, tests)], "")
    return df.withColumns(made)


def record_answers(df: DataFrame, leaders: DataFrame, records: list = qr.CURATED_RECORDS) -> DataFrame:
    """Answers of record questions: a curated record, else the leaders by the metric asked for.

    ``leaders`` is (``metric``, ``rank``, ``player``, ``value``), a few rows for each metric of a leaderboard, so it
    goes to all tasks. ``record_title`` and ``record_holders`` (best first, in text) say what was found.
    """
    out = metric(curated_record(df, records))
    listed = F.array_sort(F.collect_list(F.struct("rank", "player", "value")))
    best = leaders.groupBy("metric").agg(F.transform(listed, lambda r: F.concat(r.player, F.lit(" "), r.value.cast("string"))).alias("_leaders"))
    out = out.join(F.broadcast(best), "metric", "left")
    curated = F.col("record_title") != ""
    return out.withColumns(
        {
            "record_holders": F.when(curated, F.array(F.concat("record_holder", F.lit(" "), "record_value"))).otherwise(
                F.coalesce("_leaders", F.array().cast("array<string>"))
            ),
            "record_title": F.when(curated, F.col("record_title")).otherwise(qr.OTHER_RECORD),
        }
    ).drop("_leaders")


def glossary_term(df: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    """The first glossary term the question contains, empty without one, and if there are ``explanations`` (``term``,
    ``explanation``, one row for each of the few terms) its text, or what the glossary covers."""
    rules = [(term, F.contains("q", F.lit(term.replace("_", " ")))) for term in qr.GLOSSARY_TERMS]
    out = df.withColumn("glossary_term", _first(rules, ""))
    if explanations is None:
        return out
    known = explanations.filter(F.col("term").isin(qr.GLOSSARY_TERMS)).dropDuplicates(["term"])
    known = known.select(F.col("term").alias("glossary_term"), "explanation")
    return out.join(F.broadcast(known), "glossary_term", "left").withColumn("explanation", F.coalesce("explanation", F.lit(qr.GLOSSARY_OTHER)))


def entity_type(name, kind=None, role=None) -> Column:
    """PLAYER, TEAM, TOURNAMENT or UNKNOWN from a given kind, a role or the name itself."""
    name = F.trim(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    given = F.upper(F.trim(F.coalesce(kind if kind is not None else F.lit(""), F.lit(""))))
    held = F.coalesce(role if role is not None else F.lit(""), F.lit(""))
    return (
        F.when(given.isin("PLAYER", "TEAM", "TOURNAMENT"), given)
        .when((held != "") & ~F.contains(held, F.lit("unknown")) & (held != "team"), "PLAYER")
        .when(F.lower(name).isin(qr.KNOWN_TEAMS), "TEAM")
        .when(F.size(F.split(name, r"\s+")) >= 2, "PLAYER")
        .otherwise("UNKNOWN")
    )


def routed(questions: DataFrame) -> DataFrame:
    """All columns of the route of each question."""
    return sources(confidence(context(intent(signals(sides(metric(scope(prepared(questions)))))))))


def carry_context(turns: DataFrame, step_rows: int = 1000) -> DataFrame:
    """Last known subjects before each turn, and the text with pronouns filled in.

    ``turns``: (``conv_id``, ``at`` integer order, ``text``, ``player_name``, ``team_name`` and, if there,
    ``season_name``, ``format_name``, ``action_name``); names are null where a turn names none.
    """
    names = [c for c in ("player", "team", "season", "format", "action") if f"{c}_name" in turns.columns]
    known = carried(turns, ["conv_id"], "at", step_rows, {f"{c}_name": f"known_{c}" for c in names})
    player, team = F.coalesce("known_player", F.lit("")), F.coalesce("known_team", F.lit(""))
    use_player = matches("text", qr.PLAYER_PRONOUN) & (player != "")
    use_team = matches("text", qr.TEAM_PRONOUN) & (team != "")

    def fill(c: Column, name: Column, words: list) -> Column:
        for word, owner in words:
            by = F.concat(name, F.lit("'s")) if owner else name
            c = F.regexp_replace(c, F.lit(ascii_words(rf"(?i)\b{word}\b")), by)
        return c

    text = strip("text")
    by_player = F.when(
        use_player, fill(text, player, [("his", True), ("he", False), ("him", False), ("she", False), ("her", True)])
    ).otherwise(text)
    out = known.withColumn("_filled", by_player)
    filled = F.when(use_team, fill(F.col("_filled"), team, [("their", True), ("they", False), ("them", False)])).otherwise(
        F.col("_filled")
    )
    note = F.concat(
        F.lit("\n\nResolved conversation context: player="), F.when(player == "", "n/a").otherwise(player),
        F.lit("; team="), F.when(team == "", "n/a").otherwise(team), F.lit("."),
    )
    used = use_player | use_team
    return out.withColumns(
        {
            "uses_context": used,
            "in_context": F.when(used, F.concat(filled, note)).otherwise(text),
        }
    ).drop("_filled")


def action_in_context(action="action", text="raw", normalized="q", player="known_player", team="known_team") -> Column:
    """Statistics action for a pronoun question that had no action of its own."""
    weak = F.col(action).isin("glossary", "not_supported", "") & F.col(normalized).rlike(qr.FACT_LOOKUP)
    return (
        F.when(weak & matches(text, qr.PLAYER_PRONOUN) & (F.coalesce(player, F.lit("")) != ""), "player_stats")
        .when(weak & matches(text, qr.TEAM_PRONOUN) & (F.coalesce(team, F.lit("")) != ""), "team_stats")
        .otherwise(F.col(action))
    )


def named_subjects(df: DataFrame, teams_of: DataFrame | None = None) -> DataFrame:
    """What a routed turn leaves behind for later ones: ``player_name``, ``team_name``, ``season_name``,
    ``format_name`` and ``action_name``, null where it leaves none.

    A player is named by a player's statistics only and a team by a team's or a live question; a run of
    capitalised words that is a team is no player. ``teams_of`` (``player``, ``team``) adds the player's own team.
    """
    out = explicit_team(df)
    teams = [n.lower() for n in sorted({*qr.KNOWN_TEAMS, *[name for name, _ in qr.TEAM_PHRASES], *qr.TEAM_WORDS.values()})]
    people = F.filter(proper_names("raw"), lambda v: ~F.lower(v).isin(teams))
    person = F.when(F.col("action").isin("player_stats", "player_season_stats"), F.try_element_at(people, F.lit(1)))
    team = F.when(F.col("action").isin("team_stats", "live_update"), F.nullif("explicit_team", F.lit("")))
    out = out.withColumns({"player_name": person, "team_name": team})
    if teams_of is not None:
        own = teams_of.select(normalize_text("player").alias("_player"), F.nullif("team", F.lit("")).alias("_team")).dropDuplicates(["_player"])
        out = out.withColumn("_player", normalize_text("player_name")).join(own, "_player", "left")
        out = out.withColumn("team_name", F.coalesce("team_name", "_team")).drop("_player", "_team")
    names = {"season_name": "season", "format_name": "format", "action_name": "action"}
    return out.withColumns({new: F.nullif(old, F.lit("")) for new, old in names.items()})
