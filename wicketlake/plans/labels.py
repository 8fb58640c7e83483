"""Labels of the question table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.functions import question_rules as qr
from wicketlake.functions.text import BLOCKED_PHRASES, PROPER_NAME
from wicketlake.operators import aggregates as ag
from wicketlake.operators import boards
from wicketlake.operators import labels as lb
from wicketlake.plans.registry import over_deliveries, over_questions, register
from wicketlake.plans.sqltext import PROFILES, has, norm, quoted, sql_list
from wicketlake.plans.text import _first_seen
from wicketlake.session import written
from wicketlake.sources.star import deliveries, question_source_sql, questions, table

RAW = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
BASE = f"base AS (SELECT question_id, conv_id, turn, {RAW} AS raw, {norm(RAW)} AS q FROM questions)"


def q(pattern: str) -> str:
    return has("q", pattern)


def raw(pattern: str) -> str:
    return has("raw", pattern)


def case(rules, default: str) -> str:
    """CASE text of (condition, value) pairs; values are SQL text."""
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in rules) + f" ELSE {default} END"


def by_pattern(rules, default: str) -> str:
    return case([(q(p), quoted(label)) for label, p in rules], quoted(default))


def got(e: str, pattern: str, group: int = 1) -> str:
    return f"coalesce(regexp_extract({e}, {quoted(pattern)}, {group}), '')"


def cleaned(e: str) -> str:
    ends = "'^\\s+|\\s+$', '', 'g'"
    for lead in qr.SIDE_LEAD:
        e = f"regexp_replace({e}, {quoted(lead)}, '')"
    e = f"regexp_replace(regexp_replace({e}, {quoted(qr.SIDE_EDGES)}, '', 'g'), {ends})"
    for _, c in qr.SIDE_CONTEXT:
        e = f"regexp_replace(regexp_replace(regexp_replace({e}, {quoted(c)}, ''), {quoted(qr.SIDE_EDGES)}, '', 'g'), {ends})"
    return f"regexp_replace(regexp_replace(regexp_replace({e}, {quoted(qr.SIDE_NOISE)}, ''), {quoted(qr.SIDE_EDGES)}, '', 'g'), {ends})"


# Sides are worked out one pattern at a time, so that the text of the check stays readable.
_OPTIONS = " UNION ALL ".join(
    f"SELECT question_id, {i} AS n, {cleaned(got('stripped', p, 1))} AS l, {cleaned(got('stripped', p, 2))} AS r "
    f"FROM stripped WHERE {has('stripped', p)}"
    for i, (_, p) in enumerate(qr.SIDE_PATTERNS)
)
SIDES = (
    f"stripped AS (SELECT *, {cleaned('raw')} AS stripped FROM base), options AS ({_OPTIONS}), "
    "sided AS (SELECT b.*, coalesce(o.l, '') AS side_left, coalesce(o.r, '') AS side_right FROM base b LEFT JOIN "
    "(SELECT question_id, arg_min(l, n) AS l, arg_min(r, n) AS r FROM options WHERE l <> '' AND r <> '' GROUP BY 1) o USING (question_id))"
)

SIGNALS = (
    f"s1 AS (SELECT *, {got('raw', qr.YEAR)} AS season, ({raw(qr.CHAT_WORDS)} OR {raw(qr.CHAT_START)}) AS greeting, "
    f"(q <> '' AND ({q(qr.DOMAIN)} OR {q(qr.DOMAIN_ALIASES)} OR {q(qr.DOMAIN_VERSUS)})) AS in_domain, "
    "len(list_filter(regexp_split_to_array(raw, '\\s+'), lambda w: w <> '')) AS words FROM sided), "
    f"s2 AS (SELECT *, (q <> '' AND NOT greeting AND {q(qr.ROUGH_STATS)} AND words <= 10) AS rough_stats FROM s1), "
    f"s3 AS (SELECT *, (q <> '' AND NOT in_domain AND NOT rough_stats AND (greeting OR {q(qr.OFF_TOPIC_WORDS)} OR {q(qr.OFF_TOPIC_START)})) AS off_topic FROM s2), "
    f"signals AS (SELECT *, (q <> '' AND NOT off_topic AND NOT {q(qr.PREDICTION)} AND NOT {q(qr.TEAM_COMPARISON)} AND {q(qr.STRICT_LIVE)} AND in_domain) AS forced_live FROM s3)"
)

_TWO = "(side_left <> '' AND side_right <> '')"
_RULE = case(
    [
        ("raw = ''", "'empty'"),
        ("greeting", "'greeting'"),
        ("off_topic", "'off_topic'"),
        ("forced_live", "'forced_live'"),
        (q(qr.POINTS_TABLE), "'points_table'"),
        (q(qr.RANKING), "'ranking'"),
        (q(qr.PITCH), "'pitch'"),
        (q(qr.INJURY), "'injury'"),
        (q(qr.RECORD), "'record'"),
        (f"NOT {q(qr.SQUAD_PLAYER_STATS)} AND {q(qr.SQUAD)}", "'squad'"),
        (f"NOT {q(qr.PREDICTION)} AND NOT {q(qr.FANTASY)} AND {q(qr.TEAM_INFO)}", "'team_info'"),
        (q(qr.FORMAT_COMPARISON), "'format_comparison'"),
        (f"{q(qr.RULES)} OR {q(qr.TERMS)}", "'rules'"),
        (f"{q(qr.HISTORY)} OR {q(qr.EQUIPMENT)}", "'history'"),
        (q(qr.GLOSSARY_ASK), "'glossary'"),
        (f"({q(qr.TOP_WORDS)} AND {q(qr.TOP_SUBJECTS)}) OR {q(qr.TOP_AGGRESSIVE)}", "'top'"),
        (q(qr.HEAD_TO_HEAD), "'head_to_head'"),
        (q(qr.COMPARE), "'compare'"),
        (f"{q(qr.PREDICTION)} OR {q(qr.TEAM_COMPARISON)} OR ({_TWO} AND {q(qr.BETTER)})", "'predict'"),
        (q(qr.LIVE_LATE), "'live'"),
        (q(qr.TEAM_SUMMARY), "'team_summary'"),
        (q(qr.MATCH_WORDS), "'match'"),
        (q(qr.TEAM_WORD), "'team'"),
        (q(qr.REASONING), "'reasoning'"),
        ("rough_stats", "'rough_stats'"),
        ("season <> ''", "'season'"),
    ],
    "'player'",
)
_ACTION = case(
    [
        ("rule = 'empty'", "'not_supported'"),
        ("rule IN ('greeting', 'off_topic')", "'chit_chat'"),
        ("rule IN ('forced_live', 'live')", "'live_update'"),
        ("rule IN ('points_table', 'ranking', 'pitch', 'injury', 'format_comparison', 'rules', 'history')", "'general_knowledge'"),
        ("rule = 'record'", "'record_lookup'"),
        ("rule = 'squad'", f"CASE WHEN {q(qr.PLAYING_XI)} THEN 'playing_xi' ELSE 'team_squad' END"),
        ("rule = 'team_info'", "'team_info'"),
        ("rule = 'glossary'", f"CASE WHEN {q(qr.GLOSSARY_TERM)} THEN 'glossary' ELSE 'subjective_analysis' END"),
        ("rule = 'top'", "'top_players'"),
        ("rule = 'head_to_head'", "'head_to_head'"),
        ("rule = 'compare'", f"CASE WHEN {q(qr.COMPARE_TEAMS)} THEN 'subjective_analysis' ELSE 'compare_players' END"),
        ("rule = 'predict'", f"CASE WHEN {_TWO} AND NOT {q(qr.TEAM_COMPARISON)} THEN 'compare_players' ELSE 'subjective_analysis' END"),
        ("rule IN ('team_summary', 'team')", "'team_stats'"),
        ("rule = 'match'", "'match_summary'"),
        ("rule = 'reasoning'", "'subjective_analysis'"),
        ("rule = 'season'", "'player_season_stats'"),
    ],
    "'player_stats'",
)
_GIVEN = case(
    [
        ("rule = 'points_table'", "'points_table'"),
        ("rule = 'ranking'", "'team_ranking'"),
        ("rule = 'pitch'", "'pitch_report'"),
        ("rule = 'injury'", "'injury_update'"),
        ("rule = 'format_comparison'", "'format_comparison'"),
        (f"rule = 'rules' AND {q(qr.RULES)}", "'rules_explainer'"),
        ("rule = 'rules'", "'terminology_explainer'"),
        (f"rule = 'history' AND {q(qr.EQUIPMENT)} AND {q(qr.DRILLS)}", "'coaching_drill'"),
        (f"rule = 'history' AND {q(qr.EQUIPMENT)}", "'equipment_info'"),
        (f"rule = 'history' AND {q(qr.WORLD_CUP)}", "'worldcup_history'"),
        ("rule = 'history'", "'history_trivia'"),
        (f"rule = 'compare' AND {q(qr.COMPARE_TEAMS)}", "'team_comparison'"),
        ("rule = 'compare'", "'player_comparison'"),
        (f"rule IN ('predict', 'reasoning') AND {q(qr.FANTASY)}", "'fantasy_tip'"),
        (f"rule IN ('predict', 'reasoning') AND {q(qr.MATCH_PREDICTION)}", "'match_prediction'"),
        (f"rule = 'predict' AND {_TWO} AND {q(qr.TEAM_COMPARISON)}", "'team_comparison'"),
        (f"rule = 'predict' AND {_TWO}", "'player_comparison'"),
        ("rule IN ('predict', 'reasoning')", "'strategy_analysis'"),
    ],
    "''",
)
INTENT = (
    f"i1 AS (SELECT *, {_RULE} AS rule FROM signals), "
    f"intent AS (SELECT *, {_ACTION} AS action, {_GIVEN} AS given FROM i1)"
)
_SUB = case(
    [
        ("given <> ''", "given"),
        (f"action = 'live_update' AND {q(qr.POINTS_TABLE)}", "'points_table'"),
        (f"action = 'live_update' AND {q(qr.SCHEDULE_WORDS)}", "'fixture_schedule'"),
        (f"action = 'live_update' AND {q(qr.RESULT_WORDS)}", "'recent_result'"),
        (f"action = 'live_update' AND {q(qr.VENUE)}", "'venue_info'"),
        (f"action = 'live_update' AND {q(qr.PITCH)}", "'pitch_report'"),
        ("action IN ('player_stats', 'player_season_stats')", "'player_stats'"),
        (f"action = 'team_stats' AND {q(qr.RANKING)}", "'team_ranking'"),
        ("action = 'team_squad'", "'squad_info'"),
        ("action = 'compare_players'", "'player_comparison'"),
        ("action = 'head_to_head'", "'team_comparison'"),
        (f"action = 'subjective_analysis' AND {q(qr.FANTASY)}", "'fantasy_tip'"),
        (f"action = 'subjective_analysis' AND {q(qr.MATCH_PREDICTION)}", "'match_prediction'"),
        (f"action = 'subjective_analysis' AND {q(qr.TEAM_COMPARISON)}", "'team_comparison'"),
        ("action = 'subjective_analysis'", "'strategy_analysis'"),
        (f"action = 'team_info' AND {q(qr.VENUE)}", "'venue_info'"),
        (f"action = 'team_info' AND {q(qr.INJURY)}", "'injury_update'"),
        ("action = 'team_info'", "'team_stats'"),
        ("action = 'glossary'", "'terminology_explainer'"),
        ("action = 'chit_chat'", "'general_cricket_fallback'"),
    ],
    "action",
)
_TIME = case([(q(p), quoted(label)) for label, p in qr.TIME_CONTEXTS] + [(raw(qr.YEAR), "'seasonal'")], "'general'")
_MODE = case(
    [
        ("action = 'live_update'", "'live'"),
        ("action = 'subjective_analysis'", "'analysis'"),
        ("action IN ('general_knowledge', 'glossary')", "'knowledge'"),
        ("sub_intent = 'match_prediction'", "'analysis'"),
    ],
    "'fact'",
)
CONTEXT = f"c1 AS (SELECT *, {_SUB} AS sub_intent, {_TIME} AS time_context FROM intent), context AS (SELECT *, {_MODE} AS answer_mode FROM c1)"
ROUTE = ", ".join([BASE, SIDES, SIGNALS, INTENT, CONTEXT])


def prepared(spark, sf_dir):
    return lb.prepared(questions(spark, sf_dir))


def routed(spark, sf_dir):
    return lb.context(lb.intent(lb.signals(lb.sides(lb.scope(prepared(spark, sf_dir))))))


@register(
    "label_scope",
    over_questions(
        f"SELECT question_id, {got('raw', qr.YEAR)} AS season, {got('raw', qr.MATCH_NUMBER)} AS match_number, "
        f"{by_pattern(qr.FORMATS, '')} AS format, {by_pattern(qr.FORMATS_WIDE, '')} AS format_wide FROM base",
        BASE,
    ),
)
def label_scope(spark, sf_dir):
    return lb.scope(prepared(spark, sf_dir)).select("question_id", "season", "match_number", "format", "format_wide")


@register(
    "label_metric",
    over_questions(
        f"SELECT question_id, {by_pattern(qr.METRICS, 'runs')} AS metric, {by_pattern(qr.GUESSED_METRICS, 'runs')} AS guessed_metric, "
        f"{q(qr.FASTEST)} AS is_proxy FROM base",
        BASE,
    ),
)
def label_metric(spark, sf_dir):
    return lb.metric(prepared(spark, sf_dir)).select("question_id", "metric", "guessed_metric", "is_proxy")


@register(
    "label_sides",
    over_questions("SELECT question_id, side_left, side_right FROM sided", f"{BASE}, {SIDES}"),
)
def label_sides(spark, sf_dir):
    return lb.sides(prepared(spark, sf_dir)).select("question_id", "side_left", "side_right")


@register("label_intent", over_questions("SELECT question_id, rule, action FROM intent", ", ".join([BASE, SIDES, SIGNALS, INTENT])))
def label_intent(spark, sf_dir):
    return lb.intent(lb.signals(lb.sides(lb.scope(prepared(spark, sf_dir))))).select("question_id", "rule", "action")


@register("label_context", over_questions("SELECT question_id, sub_intent, time_context, answer_mode FROM context", ROUTE))
def label_context(spark, sf_dir):
    return routed(spark, sf_dir).select("question_id", "sub_intent", "time_context", "answer_mode")


_NAMED = (
    "(rule IN ('squad', 'team_info', 'team_summary', 'team', 'rough_stats', 'season', 'player') OR "
    "(rule IN ('head_to_head', 'compare', 'predict', 'match', 'reasoning') AND side_left <> ''))"
)


@register(
    "label_confidence",
    over_questions(
        "SELECT question_id, least(99, greatest(45, CASE WHEN off_topic THEN 95 ELSE 62 + CASE WHEN action <> 'not_supported' THEN 8 ELSE 0 END "
        f"+ CASE WHEN {_NAMED} THEN 8 ELSE 0 END + CASE WHEN {q(qr.RULES)} OR {q(qr.TERMS)} THEN 12 ELSE 0 END "
        f"+ CASE WHEN {q(qr.LIVE_DATA)} OR {q(qr.PREDICTION)} THEN 10 ELSE 0 END - CASE WHEN rough_stats THEN 5 ELSE 0 END END)) / 100.0 AS confidence FROM context",
        ROUTE,
    ),
)
def label_confidence(spark, sf_dir):
    return lb.confidence(routed(spark, sf_dir)).select("question_id", "confidence")


def _in(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


_PLAYER_NAMED = (
    "(rule IN ('rough_stats', 'season', 'player') OR ((rule IN ('predict', 'reasoning') OR (rule = 'compare' AND action = 'compare_players')) "
    f"AND side_left <> '') OR {raw(qr.CAPITALISED)})"
)
_SOURCES = (
    "w AS (SELECT *, "
    f"({q(qr.LIVE_DATA)} OR (action = 'match_summary' AND {q(qr.MATCH_LIVE)})) AS w_live, "
    f"(({q(qr.PLAYER_DATA)} AND {_PLAYER_NAMED}) OR action IN {_in(qr.PLAYER_ACTIONS)}) AS w_player, "
    f"({q(qr.KNOWLEDGE)} OR action IN {_in(qr.KNOWLEDGE_ACTIONS)} OR given IN {_in(qr.KNOWLEDGE_TOPICS)}) AS w_know, "
    f"({q(qr.ARCHIVE_DATA)} OR action IN {_in(qr.ARCHIVE_ACTIONS)}) AS w_archive, "
    f"(greeting OR off_topic OR {q(qr.REASONING)} OR action IN {_in(qr.FREE_ACTIONS)}) AS w_free FROM context)"
)


_SOURCE_LIST = (
    "CASE WHEN q = '' OR (off_topic AND NOT in_domain) THEN 'OPENAI_FALLBACK' ELSE array_to_string(list_filter(["
    "CASE WHEN w_live THEN 'CRICAPI_LIVE' END, CASE WHEN w_player THEN 'CRICBUZZ_STATS' END, CASE WHEN w_know THEN 'LOCAL_KNOWLEDGE' END, "
    "CASE WHEN w_archive THEN 'VECTOR_DB' END, CASE WHEN (w_free AND action = 'subjective_analysis') OR NOT (w_live OR w_player OR w_know OR w_archive) "
    "THEN 'OPENAI_FALLBACK' END], lambda s: s IS NOT NULL), ',') END"
)


@register(
    "label_sources",
    over_questions(
        f"SELECT question_id, {_SOURCE_LIST} AS data_sources FROM w",
        f"{ROUTE}, {_SOURCES}",
    ),
)
def label_sources(spark, sf_dir):
    return lb.sources(routed(spark, sf_dir)).select("question_id", F.array_join("data_sources", ",").alias("data_sources"))


@register(
    "label_synonyms",
    over_questions(
        f"SELECT question_id, {_SOURCE_LIST} AS data_sources, action, CASE WHEN given IN {_in(n for names in qr.ACTION_SYNONYMS.values() for n in names)} "
        f"OR given IN {_in(qr.ACTIONS)} THEN "
        + case([(f"given IN {_in(names)}", quoted(a)) for a, names in qr.ACTION_SYNONYMS.items()], "given")
        + " ELSE 'not_supported' END AS other FROM w",
        f"{ROUTE}, {_SOURCES}",
    ),
)
def label_synonyms(spark, sf_dir):
    """Source names and sub-intents written in other ways, back to the known sources and actions."""
    labelled = lb.sources(routed(spark, sf_dir))
    written = F.transform("data_sources", lambda s: F.initcap(F.translate(s, "_", "-")))
    return labelled.select(
        "question_id",
        F.array_join(lb.normalize_sources(written), ",").alias("data_sources"),
        lb.normalize_action("action").alias("action"),
        lb.normalize_action("given_sub_intent").alias("other"),
    )


_WORD_TEAM = "list_filter(string_split(q, ' '), lambda w: list_contains(" + sql_list(qr.TEAM_WORDS) + ", w))[1]"
_TEAM = case(
    [(raw(p), quoted(name)) for name, p in qr.TEAM_PHRASES]
    + [(f"{_WORD_TEAM} = {quoted(w)}", quoted(name)) for w, name in qr.TEAM_WORDS.items()],
    "''",
)
TEAM = f"teamed AS (SELECT *, {_TEAM} AS explicit_team FROM base)"


@register("label_team", over_questions("SELECT question_id, explicit_team FROM teamed", f"{BASE}, {TEAM}"))
def label_team(spark, sf_dir):
    return lb.explicit_team(prepared(spark, sf_dir)).select("question_id", "explicit_team")


_AFFILIATED = "(" + " OR ".join(f"({q(a)} AND {q(b)})" if b else q(a) for a, b in qr.FLAG_AFFILIATION) + ")"
_FLAGS = {
    "is_prediction": f"q <> '' AND ({raw(qr.FLAG_PREDICTION_TEXT)} OR {q(qr.FLAG_PREDICTION)})",
    "is_live": f"q <> '' AND {q(qr.FLAG_LIVE)}",
    "is_rules": q(qr.FLAG_RULES),
    "is_batter_ranking": f"q <> '' AND NOT ({q(qr.FLAG_BOWL_WORDS)} AND NOT {q(qr.FLAG_BAT_WORDS)}) AND {q(qr.FLAG_BATTER_RANKING)}",
    "is_bowler_ranking": f"q <> '' AND {q(qr.FLAG_BOWLER_RANKING)}",
    "is_team_batter": f"q <> '' AND {q(qr.FLAG_TEAM_BATTER)} AND {q(qr.FLAG_IN_OR_FOR)} AND explicit_team <> ''",
    "is_affiliation": f"q <> '' AND {_AFFILIATED}",
    "is_identity": f"q <> '' AND NOT {_AFFILIATED} AND NOT {q(qr.FLAG_THE_BEST)} AND {raw(qr.FLAG_IDENTITY_START)}",
    "is_format_comparison": "contains(q, 'difference between') AND ("
    + " + ".join(f"CASE WHEN {q(p)} THEN 1 ELSE 0 END" for p in qr.FLAG_FORMATS)
    + ") >= 2",
}


@register(
    "label_flags",
    over_questions(f"SELECT question_id, {', '.join(f'({v}) AS {k}' for k, v in _FLAGS.items())} FROM teamed", f"{BASE}, {TEAM}"),
)
def label_flags(spark, sf_dir):
    return lb.flags(lb.explicit_team(prepared(spark, sf_dir))).select("question_id", *_FLAGS)


_REDUCED = (
    f"array_to_string(list_filter(string_split(q, ' '), lambda w: w <> '' AND NOT list_contains({sql_list(qr.GENERIC_WORDS)}, w) "
    f"AND NOT regexp_matches(w, {quoted(qr.YEAR)})), ' ')"
)
_CAPS = f"list_filter(regexp_extract_all(raw, {quoted(qr.CAPITALISED_PHRASE)}), lambda v: NOT list_contains({sql_list(qr.COMMON_CAPITALISED)}, v))"
_GIVEN_SIDES = (
    f"list_filter([side_left, side_right], lambda s: s <> '' AND {norm('s')} <> q)"
)
_PEOPLE = "list_concat(CASE WHEN rule IN ('compare', 'predict', 'reasoning') THEN given_sides ELSE [] END, list_filter(caps, lambda p: regexp_matches(p, '\\s')))"
_SQUADS = "list_concat(CASE WHEN rule IN ('compare', 'predict', 'reasoning') THEN [] ELSE given_sides END, list_filter(caps, lambda p: NOT regexp_matches(p, '\\s')))"


@register(
    "label_hints",
    over_questions(
        f"SELECT question_id, reduced, array_to_string({_first_seen('caps')}, '|') AS capitalised, "
        f"array_to_string({_first_seen('people')}, '|') AS player_hints, "
        f"array_to_string({_first_seen('squads')}, '|') AS team_hints FROM (SELECT *, {_PEOPLE} AS people, {_SQUADS} AS squads FROM h)",
        ", ".join([BASE, SIDES, SIGNALS, INTENT, f"h AS (SELECT *, {_REDUCED} AS reduced, {_CAPS} AS caps, {_GIVEN_SIDES} AS given_sides FROM intent)"]),
    ),
)
def label_hints(spark, sf_dir):
    hinted = lb.hints(lb.intent(lb.signals(lb.sides(lb.scope(prepared(spark, sf_dir))))))
    return hinted.select(
        "question_id", "reduced", *[F.array_join(c, "|").alias(c) for c in ("capitalised", "player_hints", "team_hints")]
    )


@register(
    "label_cacheable",
    over_questions(
        f"SELECT question_id, raw <> '' AND NOT {raw(qr.CACHE_CHAT)} AND NOT {raw(qr.CACHE_BYPASS)} AND NOT (turn > 0 AND {raw(qr.ANY_PRONOUN)}) AS cacheable FROM base",
        BASE,
    ),
)
def label_cacheable(spark, sf_dir):
    return lb.cacheable(prepared(spark, sf_dir), F.col("turn") > 0).select("question_id", "cacheable")


def _record(field: int) -> str:
    return case([(" AND ".join(q(p) for p in record[2]), quoted(record[field])) for record in qr.CURATED_RECORDS], "''")


@register(
    "label_record",
    over_questions(
        f"SELECT question_id, {_record(1)} AS record_title, {_record(0)} AS record_metric, {_record(3)} AS record_holder, {_record(4)} AS record_value FROM base",
        BASE,
    ),
)
def label_record(spark, sf_dir):
    return lb.curated_record(prepared(spark, sf_dir)).select(
        "question_id", "record_title", "record_metric", "record_holder", "record_value"
    )


RECORD_METRICS = ["runs", "wickets", "strike_rate", "economy", "sixes", "fours"]
_LEADERS = ", ".join(
    f"top_{m} AS (SELECT '{m}' AS metric, player, CAST({m} AS DOUBLE) AS value, row_number() OVER (ORDER BY {m} DESC, matches DESC, player) AS rank FROM profiles)"
    for m in RECORD_METRICS
)


@register(
    "record_answers",
    over_deliveries(
        f"SELECT question_id, CASE WHEN title <> '' THEN title ELSE {quoted(qr.OTHER_RECORD)} END AS record_title, "
        "CASE WHEN title <> '' THEN holder ELSE coalesce(names, '') END AS record_holders FROM ("
        f"SELECT question_id, {_record(1)} AS title, concat({_record(3)}, ' ', {_record(4)}) AS holder, {case([(q(p), quoted(n)) for n, p in qr.METRICS], quoted(qr.DEFAULT_METRIC))} AS metric FROM base) r "
        "LEFT JOIN (SELECT metric, string_agg(player, '|' ORDER BY rank) AS names FROM leaders WHERE rank <= 3 GROUP BY metric) l USING (metric)",
        f"questions AS ({question_source_sql()}), {BASE}, {PROFILES}, {_LEADERS}, leaders AS ({' UNION ALL '.join(f'SELECT * FROM top_{m}' for m in RECORD_METRICS)})",
    ),
)
def record_answers(spark, sf_dir):
    """Record questions: curated ones by their holder, others by the three leaders of the metric."""
    profiles = written(ag.player_profiles(deliveries(spark, sf_dir)), "profiles")
    leaders = None
    for name in RECORD_METRICS:
        top = boards.leaderboard(profiles, name, 3, minimums={})
        top = top.select(F.lit(name).alias("metric"), "rank", "player", F.col("value").cast("double").alias("value"))
        leaders = top if leaders is None else leaders.unionByName(top)
    answers = lb.record_answers(prepared(spark, sf_dir), leaders)
    curated = F.col("record_title") != qr.OTHER_RECORD
    bare = F.transform("record_holders", lambda h: F.when(curated, h).otherwise(F.regexp_replace(h, " [^ ]+$", "")))
    return answers.select("question_id", "record_title", F.array_join(bare, "|").alias("record_holders"))


_TERM = case([(f"contains(q, '{t.replace('_', ' ')}')", quoted(t)) for t in qr.GLOSSARY_TERMS], quoted(""))


@register(
    "label_glossary",
    over_questions(
        f"SELECT question_id, glossary_term, coalesce(e.explanation, {quoted(qr.GLOSSARY_OTHER)}) AS explanation FROM (SELECT question_id, {_TERM} AS glossary_term FROM base) g "
        "LEFT JOIN (SELECT term, min(text) AS explanation FROM (SELECT b.text, unnest(" + sql_list(qr.GLOSSARY_TERMS) + ") AS term FROM benchmark b) x "
        "WHERE length(term) % 2 = 0 GROUP BY term) e ON e.term = g.glossary_term",
        BASE,
    ),
)
def label_glossary(spark, sf_dir):
    """Terms with their explanations; half of the terms have one."""
    terms = F.explode(F.array(*[F.lit(t) for t in qr.GLOSSARY_TERMS]))
    texts = table(spark, sf_dir, "benchmark").select("text", terms.alias("term")).filter(F.length("term") % 2 == 0)
    known = texts.groupBy("term").agg(F.min("text").alias("explanation"))
    return lb.glossary_term(prepared(spark, sf_dir), known).select("question_id", "glossary_term", "explanation")


@register(
    "label_entity_type",
    over_questions(
        f"SELECT question_id, CASE WHEN lower(name) IN {_in(qr.KNOWN_TEAMS)} THEN 'TEAM' WHEN len(regexp_split_to_array(name, '\\s+')) >= 2 THEN 'PLAYER' "
        "ELSE 'UNKNOWN' END AS by_name, CASE WHEN turn % 2 = 0 THEN 'TOURNAMENT' ELSE 'PLAYER' END AS by_kind FROM "
        "(SELECT *, CASE WHEN side_left <> '' THEN side_left ELSE raw END AS name FROM sided)",
        f"{BASE}, {SIDES}",
    ),
)
def label_entity_type(spark, sf_dir):
    named = lb.sides(prepared(spark, sf_dir)).withColumn(
        "name", F.when(F.col("side_left") != "", F.col("side_left")).otherwise(F.col("raw"))
    )
    kind = F.when(F.col("turn") % 2 == 0, "tournament").otherwise("")
    return named.select(
        "question_id",
        lb.entity_type("name").alias("by_name"),
        lb.entity_type("name", kind, F.lit("batsman")).alias("by_kind"),
    )


def _filled(text: str, name: str, words) -> str:
    for word, owner in words:
        by = f"concat({name}, '''s')" if owner else name
        text = f"regexp_replace({text}, {quoted(rf'(?i)\b{word}\b')}, {by}, 'g')"
    return text


_TEAM_NAMES = sql_list(sorted({n.lower() for n in [*qr.KNOWN_TEAMS, *[name for name, _ in qr.TEAM_PHRASES], *qr.TEAM_WORDS.values()]}))
_PEOPLE_NAMES = (
    f"list_filter(regexp_extract_all(t.raw, {quoted(PROPER_NAME)}), lambda v: NOT list_contains({sql_list(BLOCKED_PHRASES)}, v) "
    f"AND NOT list_contains({_TEAM_NAMES}, lower(v)))[1]"
)


def _before(name: str) -> str:
    return (
        f"coalesce(last_value({name} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')"
    )


_CARRY = (
    "named AS (SELECT t.question_id, t.conv_id, 2 * t.turn + CASE WHEN t.question_id LIKE '%-written' THEN 1 ELSE 0 END AS place, t.raw, t.q, "
    "CASE WHEN c.action IN ('team_stats', 'live_update') THEN nullif(explicit_team, '') END AS team_name, "
    f"CASE WHEN c.action IN ('player_stats', 'player_season_stats') THEN {_PEOPLE_NAMES} END AS player_name, "
    f"nullif({got('t.raw', qr.YEAR)}, '') AS season_name, nullif({case([(has('t.q', p), quoted(n)) for n, p in qr.FORMATS], quoted(''))}, '') AS format_name, "
    "nullif(c.action, '') AS action_name FROM teamed t JOIN context c USING (question_id)), "
    f"known AS (SELECT *, {_before('player_name')} AS p, {_before('team_name')} AS t, {_before('season_name')} AS s, {_before('format_name')} AS f, "
    f"{_before('action_name')} AS a FROM named), "
    f"used AS (SELECT *, ({raw(qr.PLAYER_PRONOUN)} AND p <> '') AS up, ({raw(qr.TEAM_PRONOUN)} AND t <> '') AS ut FROM known), "
    f"f1 AS (SELECT *, CASE WHEN up THEN {_filled('raw', 'p', [('his', True), ('he', False), ('him', False), ('she', False), ('her', True)])} ELSE raw END AS x FROM used), "
    f"f2 AS (SELECT *, CASE WHEN ut THEN {_filled('x', 't', [('their', True), ('they', False), ('them', False)])} ELSE x END AS y FROM f1)"
)


def named_turns(spark, sf_dir):
    """The turns in order with what each names, worked out once: what is carried meets the turns it is carried to."""
    named = lb.named_subjects(routed(spark, sf_dir))
    turns = named.withColumn("at", F.col("turn") * 2 + F.when(F.col("question_id").endswith("-written"), 1).otherwise(0))
    names = [f"{c}_name" for c in ("player", "team", "season", "format", "action")]
    return written(turns.select("question_id", "conv_id", "at", "text", "raw", "q", "action", *names), "turns")


@register(
    "context_carry",
    over_questions(
        "SELECT question_id, p AS known_player, t AS known_team, s AS known_season, f AS known_format, a AS known_action, (up OR ut) AS uses_context, CASE WHEN up OR ut THEN concat(y, chr(10), chr(10), "
        "'Resolved conversation context: player=', CASE WHEN p = '' THEN 'n/a' ELSE p END, '; team=', CASE WHEN t = '' THEN 'n/a' ELSE t END, '.') ELSE raw END AS in_context FROM f2",
        f"{ROUTE}, {TEAM}, {_CARRY}",
    ),
)
def context_carry(spark, sf_dir):
    out = lb.carry_context(named_turns(spark, sf_dir), 50)
    return out.select(
        "question_id",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("known_player", "known_team", "known_season", "known_format", "known_action")],
        "uses_context",
        "in_context",
    )


@register(
    "context_action",
    over_questions(
        f"SELECT question_id, CASE WHEN weak AND {has('f.raw', qr.PLAYER_PRONOUN)} AND f.p <> '' THEN 'player_stats' WHEN weak AND {has('f.raw', qr.TEAM_PRONOUN)} "
        f"AND f.t <> '' THEN 'team_stats' ELSE action END AS action FROM (SELECT question_id, action, action IN ('glossary', 'not_supported', '') AND "
        f"{q(qr.FACT_LOOKUP)} AS weak FROM context) c JOIN f2 f USING (question_id)",
        f"{ROUTE}, {TEAM}, {_CARRY}",
    ),
)
def context_action(spark, sf_dir):
    return lb.carry_context(named_turns(spark, sf_dir), 50).select("question_id", lb.action_in_context().alias("action"))
