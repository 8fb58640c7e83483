"""Text columns over documents, conversations, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.functions import text as tx
from wicketlake.functions.rates import grouped_number_text
from wicketlake.plans import sqltext as sq
from wicketlake.plans.registry import over_deliveries, over_questions, register
from wicketlake.plans.sqltext import has, norm, quoted, sql_list, toks
from wicketlake.sources.star import questions, spread, table

CLEAN = f"trim(regexp_replace(coalesce(text, ''), {quoted(tx.WHITESPACE)}, ' ', 'g'))"


@register("text_clean", f"SELECT doc_id, sha1({CLEAN}) AS digest, length({CLEAN}) AS n FROM documents")
def text_clean(spark, sf_dir):
    clean = tx.clean_text("text")
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.sha1(clean.cast("binary")).alias("digest"), F.length(clean).alias("n")
    )


@register(
    "text_normalize",
    f"SELECT doc_id, sha1({norm('text')}) AS digest, len({toks('text')}) AS n_tokens, "
    f"sha1(replace({norm('text')}, ' ', '-')) AS slug_digest FROM documents",
)
def text_normalize(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.sha1(tx.normalize_text("text").cast("binary")).alias("digest"),
        F.size(tx.tokens("text")).alias("n_tokens"),
        F.sha1(tx.slugify("text").cast("binary")).alias("slug_digest"),
    )


def _lenient(e: str) -> str:
    return (
        f"coalesce(CASE WHEN regexp_full_match(trim({e}), '[+-]?[0-9]+') THEN try_cast(trim({e}) AS BIGINT) END, "
        f"CAST(trunc(try_cast({e} AS DOUBLE)) AS BIGINT), 0)"
    )


@register(
    "lenient_cast",
    f"SELECT event_id, {_lenient('CAST(value AS VARCHAR)')} AS from_decimal, "
    f"""{_lenient("regexp_extract(props, '[0-9]+')")} AS from_digits, {_lenient('event_type')} AS from_word, """
    f"""{_lenient("replace(concat(CAST(user_id AS VARCHAR), ',', '000'), ',', '')")} AS from_grouped FROM events""",
)
def lenient_cast(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        tx.lenient_int(F.col("value").cast("string")).alias("from_decimal"),
        tx.lenient_int(F.regexp_extract("props", "[0-9]+", 0)).alias("from_digits"),
        tx.lenient_int("event_type").alias("from_word"),
        tx.table_int(F.concat(F.col("user_id").cast("string"), F.lit(",000"))).alias("from_grouped"),
    )


@register(
    "text_to_number",
    "SELECT event_id, coalesce(try_cast(nullif(regexp_replace(props, '[^0-9.-]', '', 'g'), '') AS DOUBLE), 0.0) AS from_props, "
    "coalesce(try_cast(nullif(regexp_replace(concat('$', CAST(value AS VARCHAR), ' runs'), '[^0-9.-]', '', 'g'), '') AS DOUBLE), 0.0) AS from_price, "
    "coalesce(try_cast(nullif(regexp_replace(event_type, '[^0-9.-]', '', 'g'), '') AS DOUBLE), 0.0) AS from_word FROM events",
)
def text_to_number(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        tx.to_number("props").alias("from_props"),
        tx.to_number(F.concat(F.lit("$"), F.col("value").cast("string"), F.lit(" runs"))).alias("from_price"),
        tx.to_number("event_type").alias("from_word"),
    )


def _hyphen(e: str) -> str:
    return (
        f"regexp_replace(regexp_replace(lower(trim(regexp_replace(coalesce({e}, ''), {quoted(tx.WHITESPACE)}, ' ', 'g'))), "
        "'[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g')"
    )


@register(
    "stable_ids",
    f"SELECT p_partkey, concat('player:', substr({_hyphen('p_name')}, 1, 48), '-', substr(sha1(p_name), 1, 10)) AS id, "
    f"concat('item:', substr({_hyphen("concat(p_name, '|', p_brand, '|', p_type)")}, 1, 48), '-', "
    "substr(sha1(concat(p_name, '|', p_brand, '|', p_type)), 1, 10)) AS long_id FROM part",
)
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        tx.stable_id("player", "p_name").alias("id"),
        tx.stable_id("item", "p_name", F.lit("  "), "p_brand", "p_type").alias("long_id"),
    )


@register(
    "cache_ids",
    over_questions(
        f"SELECT question_id, concat('semantic-cache-', substr(sha1(lower({CLEAN})), 1, 24)) AS id FROM questions"
    ),
)
def cache_ids(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", tx.cache_id("text").alias("id"))


_FOLD = " ".join(f"WHEN w = {quoted(a)} THEN {quoted(b)}" for a, b in tx.CACHE_SYNONYMS.items())


def cache_document_sql(e: str) -> str:
    words = f"string_split(trim(regexp_replace(lower(coalesce({e}, '')), '[^a-z0-9]+', ' ', 'g')), ' ')"
    folded = f"list_transform({words}, lambda w: CASE {_FOLD} ELSE w END)"
    kept = f"list_filter({folded}, lambda w: length(w) > 1 AND NOT list_contains({sql_list(tx.CACHE_STOP_WORDS)}, w))"
    return f"array_to_string(list_sort(list_distinct({kept})), ' ')"


@register(
    "cache_document",
    over_questions(f"SELECT question_id, {cache_document_sql('text')} AS document FROM questions"),
)
def cache_document(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", tx.cache_document("text").alias("document"))


@register(
    "metadata_sanitize",
    "SELECT event_id, array_to_string(list_filter(['event_type=' || event_type, 'value=' || CAST(value AS VARCHAR), "
    "'props=' || concat('{\"k\":', regexp_extract(props, '[0-9]+'), '}')], lambda x: x IS NOT NULL), ';') AS entries, "
    "CASE WHEN event_type = 'error' THEN 3 ELSE 4 END AS n FROM (SELECT * FROM events)",
)
def metadata_sanitize(spark, sf_dir):
    meta = tx.sanitized_metadata(
        {
            "event_type": ("event_type", False),
            "value": ("value", False),
            "props": (F.from_json("props", "k int"), True),
            "user": (F.when(F.col("event_type") != "error", F.col("user_id")), False),
        }
    )
    listed = F.array_join(
        F.transform(F.array(*[F.lit(k) for k in ("event_type", "value", "props")]), lambda k: F.concat(k, F.lit("="), F.try_element_at("meta", k))), ";"
    )
    return (
        table(spark, sf_dir, "events")
        .select("event_id", meta.alias("meta"))
        .select("event_id", listed.alias("entries"), F.size("meta").alias("n"))
    )


@register(
    "date_iso",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, concat('week of ', strftime(o_orderdate, '%Y-%m-%d')) AS kept, "
    "strftime(o_orderdate, '%Y-%m-%d') AS earliest FROM orders",
)
def date_iso(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        tx.date_iso(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"),
        tx.date_iso(F.concat(F.lit("week of "), day)).alias("kept"),
        tx.earliest_date(F.array(F.concat(day, F.lit("T23:00")), F.lit(" "), F.lit("9999-01-01"), day)).alias("earliest"),
    )


@register(
    "doc_preview",
    "SELECT doc_id, CASE WHEN length(text) > 800 THEN concat(regexp_replace(substr(text, 1, 797), '^\\s+|\\s+$', '', 'g'), '...') "
    "ELSE text END AS preview, substr(text, 1, 500) AS short FROM documents",
)
def doc_preview(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", tx.preview("text").alias("preview"), tx.short_preview("text").alias("short")
    )


def _first_seen(e: str) -> str:
    """Distinct elements in first-seen order."""
    return f"list_filter({e}, lambda x, i: x <> '' AND list_position({e}, x) = i)"


@register(
    "array_unique",
    f"SELECT doc_id, array_to_string(list_slice({_first_seen('words')}, 1, 12), ' ') AS first_words, "
    f"len({_first_seen('words')}) AS n FROM (SELECT doc_id, list_transform(string_split(text, ' '), "
    "lambda w: regexp_replace(w, '^\\s+|\\s+$', '', 'g')) AS words FROM documents) d",
)
def array_unique(spark, sf_dir):
    words = F.split("text", " ")
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.array_join(tx.unique_non_empty(words, 12), " ").alias("first_words"),
        F.size(tx.unique_non_empty(words)).alias("n"),
    )


@register(
    "token_overlap",
    "SELECT a.conv_id, a.turn, round(CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0.0 ELSE "
    "len(list_intersect(l, r)) / CAST(len(l) AS DOUBLE) END, 6) AS overlap FROM "
    f"(SELECT conv_id, turn, list_distinct({toks('text')}) AS l FROM conversations) a JOIN "
    f"(SELECT conv_id, turn, list_distinct({toks('text')}) AS r FROM conversations) b "
    "ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn",
)
def token_overlap(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(tx.token_overlap("text", "next_text"), 6).alias("overlap")
    )


@register(
    "player_alias_gen",
    "SELECT c_custkey, array_to_string(CASE WHEN len(t) >= 2 THEN [name, upper(t[1][1]) || ' ' || t[-1], upper(t[1][1]) || '. ' || t[-1], "
    "t[-1] || ' ' || upper(t[1][1]), t[-1] || ', ' || upper(t[1][1]), t[-1]] ELSE [name] END, '|') AS aliases FROM "
    f"(SELECT c_custkey, concat(c_mktsegment, ' ', c_name) AS name, {toks("concat(c_mktsegment, ' ', c_name)")} AS t FROM customer) c",
)
def player_alias_gen(spark, sf_dir):
    from wicketlake.operators.search import name_variants

    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(name_variants(F.concat_ws(" ", "c_mktsegment", "c_name")), "|").alias("aliases")
    )


@register(
    "team_acronyms",
    f"SELECT s_suppkey, array_to_string(CASE WHEN acro = name THEN [name] ELSE [name, acro] END, '|') AS aliases FROM "
    "(SELECT s_suppkey, s_name AS name, upper(array_to_string(list_transform("
    f"{toks('s_name')}, lambda t: t[1]), '')) AS acro FROM supplier) s",
)
def team_acronyms(spark, sf_dir):
    from wicketlake.operators.search import team_aliases

    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(team_aliases("s_name"), "|").alias("aliases"))


@register(
    "metric_labels",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sq.grouped('l_extendedprice')} AS price_text, "
    "concat(upper(substr(t, 1, 1)), substr(t, 2)) AS title, trim(regexp_replace(lower(trim(concat(' ', t, ' #', l_returnflag, ' '))), "
    "'[^a-z0-9]+', '_', 'g'), '_') AS key FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'runs' ELSE 'wickets' END AS t FROM lineitem) l",
)
def metric_labels(spark, sf_dir):
    metric = F.when(F.col("l_linestatus") == "F", "runs").otherwise("wickets")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        grouped_number_text("l_extendedprice").alias("price_text"),
        tx.title_metric(metric).alias("title"),
        tx.stat_key(F.concat(F.lit(" "), metric, F.lit(" #"), "l_returnflag", F.lit(" "))).alias("key"),
    )


def _scrub_sql(e: str) -> str:
    for fragment in tx.SCRUB_FRAGMENTS:
        e = f"regexp_replace({e}, {quoted('(?i)' + fragment)}, ' ', 'g')"
    return f"trim(regexp_replace({e}, {quoted(tx.WHITESPACE)}, ' ', 'g'))"


# Encyclopedia sentences put in front of a text, so that there is something to scrub.
_LEAD = (
    "CASE WHEN doc_id % 3 = 0 THEN 'Australia is a country in Oceania with large land area' || chr(10) || text "
    "WHEN doc_id % 3 = 1 THEN 'Tasmania. Indian Ocean' ELSE text END"
)


@register(
    "text_scrub",
    f"SELECT doc_id, CASE WHEN s = '' OR {has('s', '^[^0-9A-Za-z_]')} OR len({toks('s')}) < 5 OR "
    f"{has(norm('s'), tx.SCRUB_REMAINS)} THEN 'n/a' ELSE s END AS scrubbed FROM "
    f"(SELECT doc_id, {_scrub_sql(_LEAD)} AS s FROM documents) d",
)
def text_scrub(spark, sf_dir):
    lead = F.expr(_LEAD.replace("chr(10)", "char(10)"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", tx.scrub_text(lead, "n/a").alias("scrubbed"))


_NAMES = f"list_filter(regexp_extract_all(text, {quoted(tx.PROPER_NAME)}), lambda v: NOT list_contains({sql_list(tx.BLOCKED_PHRASES)}, v))"


@register(
    "proper_names",
    over_questions(
        f"SELECT question_id, array_to_string({_first_seen('names')}, '|') AS names FROM "
        f"(SELECT question_id, {_NAMES} AS names FROM questions) q"
    ),
)
def proper_names(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", F.array_join(tx.proper_names("text"), "|").alias("names"))


def _grams(size: int) -> str:
    return (
        f"CASE WHEN len(t) >= {size} THEN list_transform(range(1, len(t) - {size} + 2), "
        f"lambda i: array_to_string(list_slice(t, i, i + {size} - 1), ' ')) ELSE [] END"
    )


@register(
    "phrase_ngrams",
    over_questions(
        "SELECT question_id, len(list_distinct(g)) AS n, "
        "array_to_string(list_slice(g, 1, 1), '') AS longest, sha1(array_to_string(list_sort(list_distinct(g)), '|')) AS digest FROM "
        f"(SELECT question_id, list_concat({_grams(4)}, {_grams(3)}, {_grams(2)}, {_grams(1)}) AS g FROM "
        f"(SELECT question_id, {toks('text')} AS t FROM questions) a) q"
    ),
)
def phrase_ngrams(spark, sf_dir):
    return (
        questions(spark, sf_dir)
        .select("question_id", tx.phrase_ngrams("text").alias("g"))
        .select(
            "question_id",
            F.size("g").alias("n"),
            F.coalesce(F.try_element_at("g", F.lit(1)), F.lit("")).alias("longest"),
            F.sha1(F.array_join(F.array_sort("g"), "|").cast("binary")).alias("digest"),
        )
    )


@register(
    "json_relaxed",
    "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, CAST(regexp_extract(props, '[0-9]+') AS INT) AS wrapped_k, "
    "CAST(NULL AS INT) AS broken_k FROM events",
)
def json_relaxed(spark, sf_dir):
    wrapped = F.concat(F.lit("Here it is: "), "props", F.lit(" - done"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        tx.relaxed_json("props", "k int").k.alias("k"),
        tx.relaxed_json(wrapped, "k int").k.alias("wrapped_k"),
        tx.relaxed_json("event_type", "k int").k.alias("broken_k"),
    )


@register(
    "lenient_flags",
    "SELECT event_id, CASE WHEN n IN ('1', 'true', 'yes', 'y') THEN true WHEN n IN ('0', 'false', 'no', 'n') THEN false ELSE true END AS flag, "
    "CAST(least(50, greatest(1, floor(value))) AS INT) AS page, 20 AS fallback FROM "
    f"(SELECT *, {norm('w')} AS n FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' n ' WHEN 2 THEN '0' WHEN 3 THEN 'TRUE.' "
    "ELSE event_type END AS w FROM events) e) f",
)
def lenient_flags(spark, sf_dir):
    word = F.expr(
        "CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' n ' WHEN 2 THEN '0' WHEN 3 THEN 'TRUE.' ELSE event_type END"
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        tx.lenient_flag(word, True).alias("flag"),
        tx.clamped_int("value", 20, 1, 50).alias("page"),
        tx.clamped_int("event_type", 20, 1, 50).alias("fallback"),
    )


@register(
    "season_filter",
    over_deliveries(
        "SELECT season, count(DISTINCT match_id) AS matches FROM deliveries WHERE contains(season, '199') GROUP BY season"
    ),
)
def season_filter(spark, sf_dir):
    from wicketlake.sources.star import deliveries

    wanted = tx.normalize_text(F.lit("199"))
    label = tx.normalize_text("season")
    kept = deliveries(spark, sf_dir).filter((label != "") & (wanted != "") & label.contains(wanted))
    return kept.groupBy("season", "match_id").agg(F.count(F.lit(1)).alias("n")).groupBy("season").agg(
        F.count(F.lit(1)).alias("matches")
    )


@register(
    "name_union",
    "SELECT DISTINCT name FROM (SELECT trim(c_mktsegment) AS name FROM customer UNION ALL SELECT p_name FROM part "
    "UNION ALL SELECT n_name FROM nation) u WHERE name <> ''",
)
def name_union(spark, sf_dir):
    names = (
        table(spark, sf_dir, "customer").select(F.trim("c_mktsegment").alias("name"))
        .union(table(spark, sf_dir, "part").select("p_name"))
        .union(table(spark, sf_dir, "nation").select("n_name"))
    )
    return names.filter("name != ''").distinct()
