"""Names, vectors, cached questions and knowledge over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.functions.text import normalize_text
from wicketlake.operators import aggregates as ag
from wicketlake.operators import search as se
from wicketlake.operators import vectors as ve
from wicketlake.operators.documents import match_docs
from wicketlake.plans import similarity_sql as ss
from wicketlake.plans import sqltext as sq
from wicketlake.plans.documents import MATCH_DOC
from wicketlake.plans.registry import over_deliveries, over_questions, register
from wicketlake.plans.text import cache_document_sql
from wicketlake.sources.star import deliveries, questions, table

# A typed name: the second and third letters change places.
TYPED = "concat(substr(p_name, 1, 1), substr(p_name, 3, 1), substr(p_name, 2, 1), substr(p_name, 4))"


def part_names(spark, sf_dir):
    """(``entity``, ``alias``): products named by name and type, with the variants of the name."""
    named = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("entity")).distinct()
    return named.select("entity", F.explode(se.name_variants("entity")).alias("alias"))


def part_strength(spark, sf_dir):
    """(``entity``, ``first``, ``second``): what orders products that are equally good hits."""
    parts = table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", "p_type").alias("entity"))
    return parts.agg(F.sum("p_size").alias("first"), F.count("*").alias("second"))


def typed_names(spark, sf_dir):
    """(``query_id``, ``text``): every product, its name with a typing error and its type."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("query_id"), F.concat(F.expr(TYPED), F.lit(" "), "p_type").alias("text")
    )


PART_ENTITY = "concat(p_name, ' ', p_type)"
PART_TYPED = f"concat({TYPED}, ' ', p_type)"
_WORDS = f"string_split({sq.norm('entity')}, ' ')"
_INITIAL, _LAST = f"upper(left({sq.norm('entity')}, 1))", f"{_WORDS}[-1]"
PART_ALIASES = (
    f"SELECT DISTINCT entity, {sq.norm('alias')} AS a FROM (SELECT entity, unnest([entity, concat({_INITIAL}, ' ', {_LAST}), "
    f"concat({_INITIAL}, '. ', {_LAST}), concat({_LAST}, ' ', {_INITIAL}), concat({_LAST}, ', ', {_INITIAL}), {_LAST}]) AS alias "
    f"FROM (SELECT DISTINCT {PART_ENTITY} AS entity FROM part) e) t"
)
PART_STRENGTH = f"strength AS (SELECT {PART_ENTITY} AS entity, sum(p_size) AS first, count(*) AS second FROM part GROUP BY 1)"
BEST_FIRST = "ORDER BY score DESC, coalesce(first, 0) DESC, coalesce(second, 0) DESC, entity"


def placed(limit: int) -> str:
    """Table ``best`` (q, entity, score, place) of the hits, with products' strength."""
    return (
        f"{PART_STRENGTH}, best AS (SELECT * FROM (SELECT q, entity, score, row_number() OVER (PARTITION BY q {BEST_FIRST}) AS place "
        f"FROM hits LEFT JOIN strength USING (entity)) h WHERE place <= {limit})"
    )


@register(
    "canonical_names",
    "SELECT c_custkey, c_mktsegment AS written, coalesce(a.canonical, c_mktsegment) AS canonical_name FROM customer c "
    f"LEFT JOIN (SELECT {sq.norm('o_orderpriority')} AS alias_norm, max(o_orderpriority) AS canonical FROM orders GROUP BY 1 "
    f"UNION ALL SELECT {sq.norm('c_mktsegment')}, max(concat('Segment ', c_mktsegment)) FROM customer WHERE c_mktsegment < 'F' GROUP BY 1) a "
    f"ON {sq.norm('c_mktsegment')} = a.alias_norm",
)
def canonical_names(spark, sf_dir):
    priorities = table(spark, sf_dir, "orders").select(
        normalize_text("o_orderpriority").alias("alias_norm"), F.col("o_orderpriority").alias("canonical")
    )
    segments = table(spark, sf_dir, "customer").filter("c_mktsegment < 'F'").select(
        normalize_text("c_mktsegment").alias("alias_norm"), F.concat(F.lit("Segment "), "c_mktsegment").alias("canonical")
    )
    aliases = priorities.unionByName(segments).groupBy("alias_norm").agg(F.max("canonical").alias("canonical"))
    named = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("written"))
    return se.canonical_names(named, "written", aliases)


@register(
    "osa_distance",
    f"SELECT p_partkey, p_name, CAST(d AS INTEGER) AS distance FROM part JOIN (SELECT x, y, {ss.osa('x', 'y')} AS d FROM "
    f"(SELECT DISTINCT {sq.norm('p_name')} AS x, {sq.norm(TYPED)} AS y FROM part) t) k ON x = {sq.norm('p_name')} AND y = {sq.norm(TYPED)}",
)
def osa_distance(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", "p_name", se.osa_distance("p_name", F.expr(TYPED)).alias("distance"))


@register(
    "name_similarity",
    f"WITH {ss.similar(f'SELECT {sq.norm(PART_TYPED)} AS q, {sq.norm("p_name")} AS a FROM part')} "
    f"SELECT p_partkey, {PART_TYPED} AS typed, p_name, round(similarity, 6) AS similarity FROM part "
    f"JOIN sim ON q = {sq.norm(PART_TYPED)} AND a = {sq.norm('p_name')}",
)
def name_similarity(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("typed", F.concat_ws(" ", F.expr(TYPED), "p_type"))
    scored = se.pair_similarity(parts, "typed", "p_name", "similarity")
    return scored.select("p_partkey", "typed", "p_name", F.round("similarity", 6).alias("similarity"))


@register(
    "fuzzy_search",
    f"WITH {ss.searched(f'SELECT {sq.norm(PART_TYPED)} AS q FROM part', PART_ALIASES)}, {placed(5)} "
    f"SELECT p_partkey AS query_id, {PART_TYPED} AS text, entity, score, place FROM part JOIN best ON q = {sq.norm(PART_TYPED)}",
)
def fuzzy_search(spark, sf_dir):
    return se.search_entities(typed_names(spark, sf_dir), part_names(spark, sf_dir), 5, strength=part_strength(spark, sf_dir))


_PRIORITY = "regexp_replace(o_orderpriority, '^[0-9]-', '')"
_SEGMENTS = (
    f"SELECT entity, {sq.norm('entity')} AS a FROM (SELECT DISTINCT c_mktsegment AS entity FROM customer) t UNION "
    f"SELECT entity, left({sq.norm('entity')}, 1) FROM (SELECT DISTINCT c_mktsegment AS entity FROM customer) t"
)


@register(
    "team_search",
    f"WITH {ss.searched(f'SELECT DISTINCT {sq.norm(_PRIORITY)} AS q FROM orders', _SEGMENTS)} SELECT o_orderkey AS query_id, {_PRIORITY} AS text, "
    "entity, score, place FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, entity) AS place FROM hits) h "
    f"ON q = {sq.norm(_PRIORITY)} WHERE place <= 5",
)
def team_search(spark, sf_dir):
    """Order priorities against the names and acronyms of the market segments."""
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("entity")).distinct()
    aliases = segments.select("entity", F.explode(se.team_aliases("entity")).alias("alias"))
    asked = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_id"), F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("text")
    )
    return se.search_entities(asked, aliases, 5)


@register(
    "player_search_page",
    f"WITH {ss.searched(f'SELECT {sq.norm("p_type")} AS q FROM part', PART_ALIASES)}, {PART_STRENGTH} SELECT query_id, text, entity, score, total, place FROM ("
    f"SELECT t.p_type AS query_id, t.p_type AS text, entity, score, count(*) OVER (PARTITION BY t.p_type) AS total, row_number() OVER (PARTITION BY t.p_type {BEST_FIRST}) AS place "
    f"FROM (SELECT DISTINCT p_type FROM part) t JOIN hits ON q = {sq.norm('t.p_type')} LEFT JOIN strength USING (entity)) p WHERE place BETWEEN 6 AND 10",
)
def player_search_page(spark, sf_dir):
    """Second page of five products per type asked for."""
    asked = table(spark, sf_dir, "part").select(F.col("p_type").alias("query_id"), F.col("p_type").alias("text")).distinct()
    return se.search_page(asked, part_names(spark, sf_dir), 2, 5, part_strength(spark, sf_dir))


_NAMES = f"SELECT DISTINCT {PART_ENTITY} AS alias, {sq.norm(PART_ENTITY)} AS a FROM part"


@register(
    "name_ranking",
    f"WITH names AS ({_NAMES}), {ss.similar(f'SELECT q, a FROM (SELECT DISTINCT {sq.norm("p_type")} AS q FROM part) t, names')}, "
    f"ranked AS (SELECT p_type AS query_id, alias, round(similarity + {ss.bonus(0.4)}, 6) AS score FROM (SELECT DISTINCT p_type FROM part) t "
    f"JOIN sim ON q = {sq.norm('p_type')} JOIN names USING (a) WHERE similarity >= 0.3 - 1e-12) SELECT * FROM ("
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, alias) AS place FROM ranked WHERE score >= 0.3) r WHERE place <= 10",
)
def name_ranking(spark, sf_dir):
    """The ten names that rank first for each type."""
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("alias")).distinct()
    asked = table(spark, sf_dir, "part").select(F.col("p_type").alias("query_id"), F.col("p_type").alias("text")).distinct()
    return se.rank_by_query(asked, names, limit=10)


def _weighted_sql(queries: str) -> str:
    """Tables up to ``weighted``, for ``queries`` (query_id, live_leaning, q): candidates of products, with own scores."""
    words = "string_split(q, ' ')"
    base = (
        f"similarity + {ss.bonus()} + CASE WHEN NOT contains(q, ' ') AND list_contains(string_split(a, ' '), q) THEN 0.2 ELSE 0.0 END "
        f"+ CASE WHEN contains(q, ' ') AND list_has_all(string_split(a, ' '), {words}) THEN 0.18 ELSE 0.0 END"
    )
    return (
        f"queries AS ({queries}), candidates AS (SELECT DISTINCT {PART_ENTITY} AS entity, {sq.norm(PART_ENTITY)} AS a, "
        "CASE WHEN p_type < 'M' THEN 'vector' ELSE 'cricapi' END AS source, p_type < 'P' AS is_active FROM part), "
        f"live AS (SELECT DISTINCT {sq.norm(PART_ENTITY)} AS a FROM part WHERE {PART_ENTITY} < 'm'), "
        f"own AS (SELECT query_id, entity, 0.5 + p_size / 40.0 AS score FROM (SELECT DISTINCT p_name, p_type, p_size, {PART_ENTITY} AS entity, "
        f"{PART_TYPED} AS query_id, row_number() OVER (PARTITION BY {PART_ENTITY} ORDER BY p_size) AS n FROM part) t WHERE n = 1 AND p_size % 2 = 1), "
        + ss.similar("SELECT q, a FROM queries, candidates")
        + f", scored AS (SELECT query_id, live_leaning, entity, source, is_active, {base} "
        "+ CASE WHEN live_leaning AND a IN (SELECT a FROM live) THEN 0.45 ELSE 0.0 END AS score, 0.0 AS own "
        "FROM queries JOIN sim USING (q) JOIN candidates USING (a) WHERE similarity >= 0.45 - 1e-12 "
        "UNION ALL SELECT query_id, live_leaning, entity, source, is_active, score, score FROM own JOIN queries USING (query_id) JOIN candidates USING (entity)), "
        "summed AS (SELECT query_id, live_leaning, entity, source, is_active, max(score) AS score, max(own) AS own FROM scored GROUP BY ALL), "
        "weighted AS (SELECT query_id, entity, own, round(score + CASE WHEN live_leaning THEN CASE WHEN is_active THEN 0.3 ELSE 0.0 END "
        "+ CASE WHEN source = 'cricapi' THEN 0.22 ELSE 0.0 END ELSE CASE WHEN source = 'vector' THEN 0.04 ELSE 0.0 END END, 4) AS weighted_score FROM summed)"
    )


@register(
    "entity_weighted",
    "WITH " + _weighted_sql(f"SELECT DISTINCT {PART_TYPED} AS query_id, length({PART_TYPED}) % 2 = 0 AS live_leaning, {sq.norm(PART_TYPED)} AS q FROM part")
    + " SELECT * FROM (SELECT query_id, entity, weighted_score, row_number() OVER (PARTITION BY query_id ORDER BY weighted_score DESC, own DESC, entity) AS place "
    "FROM weighted) w WHERE place <= 5",
)
def entity_weighted(spark, sf_dir):
    """The five best candidates of each typed name; some candidates bring a score along."""
    parts = table(spark, sf_dir, "part").withColumn("entity", F.concat_ws(" ", "p_name", "p_type"))
    typed = F.concat(F.expr(TYPED), F.lit(" "), "p_type")
    asked = parts.select(typed.alias("query_id"), typed.alias("text"), (F.length(typed) % 2 == 0).alias("live_leaning")).distinct()
    candidates = parts.select("entity", "p_type").distinct().select(
        "entity",
        F.col("entity").alias("alias"),
        F.when(F.col("p_type") < "M", "vector").otherwise("cricapi").alias("source"),
        (F.col("p_type") < "P").alias("is_active"),
    )
    live = parts.select(F.col("entity").alias("name")).filter("name < 'm'").distinct()
    own = parts.groupBy(typed.alias("query_id"), "entity").agg(F.min("p_size").alias("size")).filter("size % 2 = 1")
    own = own.select("query_id", "entity", (0.5 + F.col("size") / 40.0).alias("score"))
    return se.weighted_entities(asked, candidates, live, own, limit=5)


_VARIANTS = (
    f"variants AS (SELECT p_partkey AS question_id, unnest([{PART_TYPED}, reverse(p_name), p_type]) AS query_id, "
    f"unnest([0, 1, 2]) AS position FROM part)"
)
_RESOLVED = """
per_query AS (SELECT v.query_id, max(score) AS score, arg_min(entity, place) AS best, max(score) FILTER (place = 2) AS second
  FROM (SELECT DISTINCT query_id FROM variants) v LEFT JOIN best ON q = {norm} GROUP BY v.query_id),
resolved AS (SELECT query_id, score, CASE WHEN score IS NULL THEN 'not_found'
  WHEN score >= 0.55 OR NOT (score < 0.72 OR coalesce(second, 0) >= score - 0.08) THEN 'resolved' ELSE 'clarify' END AS status, best FROM per_query)"""


@register(
    "entity_resolution",
    f"WITH {_VARIANTS}, {ss.searched(f'SELECT {sq.norm("query_id")} AS q FROM variants', PART_ALIASES)}, {placed(5)}, "
    + _RESOLVED.format(norm=sq.norm("v.query_id"))
    + " SELECT question_id, status, CASE WHEN status = 'resolved' THEN best END AS entity, coalesce(score, 0.0) AS score, query_id AS text FROM ("
    "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE status WHEN 'resolved' THEN 0 WHEN 'clarify' THEN 1 ELSE 2 END, "
    "CASE WHEN status = 'resolved' THEN -score ELSE 0 END, position) AS n FROM variants JOIN resolved USING (query_id)) t WHERE n = 1",
)
def entity_resolution(spark, sf_dir):
    """Three texts per product name: typed wrongly, reversed and the type alone; the best one is kept."""
    parts = table(spark, sf_dir, "part")
    variants = parts.select(
        F.col("p_partkey").alias("question_id"),
        F.posexplode(
            F.array(F.concat(F.expr(TYPED), F.lit(" "), "p_type"), F.reverse("p_name"), F.col("p_type"))
        ).alias("position", "query_id"),
    )
    asked = variants.select("query_id", F.col("query_id").alias("text")).distinct()
    resolved = se.resolve(asked, part_names(spark, sf_dir), strength=part_strength(spark, sf_dir))
    return se.best_variant(resolved, variants)


_FEED = "SELECT DISTINCT c_mktsegment AS name FROM customer"
_LEANING = (
    f"SELECT {PART_TYPED} AS query_id, {PART_TYPED} AS text, length({PART_TYPED}) % 2 = 0 AS live_leaning FROM part UNION ALL "
    "SELECT concat(c_mktsegment, ' co'), concat(substr(c_mktsegment, 1, 2), substr(c_mktsegment, 4), ' co'), true FROM customer"
)
_W_BASE = (
    f"similarity + {ss.bonus()} + CASE WHEN NOT contains(q, ' ') AND list_contains(string_split(a, ' '), q) THEN 0.2 ELSE 0.0 END "
    "+ CASE WHEN contains(q, ' ') AND list_has_all(string_split(a, ' '), string_split(q, ' ')) THEN 0.18 ELSE 0.0 END"
)


@register(
    "entity_resolution_live",
    f"WITH asked AS (SELECT DISTINCT query_id, text, live_leaning, {sq.norm('text')} AS q FROM ({_LEANING}) t), feed AS (SELECT name, {sq.norm('name')} AS a FROM ({_FEED}) t), "
    f"live AS (SELECT DISTINCT {sq.norm('name')} AS a FROM ({_FEED} UNION SELECT DISTINCT {PART_ENTITY} FROM part WHERE {PART_ENTITY} < 'm') t), "
    + f"all_a AS ({PART_ALIASES}), "
    + ss.similar("SELECT q, a FROM asked, (SELECT a FROM all_a UNION SELECT a FROM live) t")
    + f", hits AS (SELECT q, entity, round(max(score), 6) AS score FROM (SELECT q, a, {ss.SEARCH_SCORE} AS score FROM sim WHERE similarity >= 0.45 - 1e-12) s JOIN all_a USING (a) "
    f"WHERE score >= 0.45 GROUP BY q, entity), {placed(5)}, "
    "per_q AS (SELECT q, max(score) AS score, arg_min(entity, place) AS best, max(score) FILTER (place = 2) AS second FROM best GROUP BY q), "
    f"weighed AS (SELECT q, a, {_W_BASE} + CASE WHEN a IN (SELECT a FROM live) THEN 0.45 ELSE 0.0 END AS s FROM sim WHERE similarity >= 0.45 - 1e-12), "
    "archive AS (SELECT q, entity, round(greatest(b.score, coalesce(max(s), 0)), 4) AS s FROM best b JOIN all_a USING (entity) LEFT JOIN weighed USING (q, a) GROUP BY q, entity, b.score), "
    "ranked AS (SELECT q, entity, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, entity) AS n FROM archive), "
    "first_two AS (SELECT q, max(s) AS s, arg_min(entity, n) AS entity, coalesce(max(s) FILTER (n = 2), 0) AS second FROM ranked WHERE n <= 2 GROUP BY q), "
    "feed_best AS (SELECT q, arg_min(name, {'s': -s, 'name': name}) AS entity, max(s) AS s FROM (SELECT q, name, round(max(s) + CASE WHEN name < 'H' THEN 0.3 ELSE 0.0 END + 0.22, 4) AS s "
    "FROM weighed JOIN feed USING (a) GROUP BY q, name) f GROUP BY q HAVING max(s) >= 0.7) "
    "SELECT k.query_id, k.text, CASE WHEN branch = 'archive' THEN CASE WHEN f.s < 0.72 OR f.second >= f.s - 0.08 THEN 'clarify' ELSE 'resolved' END "
    "WHEN branch = 'live' THEN 'resolved' WHEN p.score IS NULL THEN 'not_found' WHEN p.score >= 0.55 OR NOT (p.score < 0.72 OR coalesce(p.second, 0) >= p.score - 0.08) THEN 'resolved' ELSE 'clarify' END AS status, "
    "CASE WHEN branch = 'archive' THEN CASE WHEN f.s < 0.72 OR f.second >= f.s - 0.08 THEN NULL ELSE f.entity END WHEN branch = 'live' THEN l.entity "
    "WHEN p.score >= 0.55 OR NOT (p.score < 0.72 OR coalesce(p.second, 0) >= p.score - 0.08) THEN p.best END AS entity, "
    "CASE WHEN branch = 'archive' THEN f.s WHEN branch = 'live' THEN l.s ELSE coalesce(p.score, 0.0) END AS score, branch FROM ("
    "SELECT a.*, CASE WHEN live_leaning AND f.q IS NOT NULL THEN 'archive' WHEN live_leaning AND l.q IS NOT NULL THEN 'live' ELSE 'plain' END AS branch "
    "FROM asked a LEFT JOIN first_two f USING (q) LEFT JOIN feed_best l USING (q)) k LEFT JOIN per_q p USING (q) LEFT JOIN first_two f USING (q) LEFT JOIN feed_best l USING (q)",
)
def entity_resolution_live(spark, sf_dir):
    """Typed names, half of them leaning to live matches, and names that only the live feed has."""
    parts, segments = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    typed = F.concat(F.expr(TYPED), F.lit(" "), "p_type")
    asked = parts.select(typed.alias("query_id"), typed.alias("text"), (F.length(typed) % 2 == 0).alias("live_leaning"))
    short = F.expr("concat(substr(c_mktsegment, 1, 2), substr(c_mktsegment, 4), ' co')")
    asked = asked.unionByName(segments.select(F.concat("c_mktsegment", F.lit(" co")).alias("query_id"), short.alias("text"), F.lit(True).alias("live_leaning")))
    products = parts.select(F.concat_ws(" ", "p_name", "p_type").alias("name")).filter("name < 'm'").distinct()
    feed = segments.select(F.col("c_mktsegment").alias("name"), (F.col("c_mktsegment") < "H").alias("is_active"))
    return se.resolve_leaning(asked.distinct(), part_names(spark, sf_dir), feed, products, strength=part_strength(spark, sf_dir))


@register(
    "external_names",
    f"WITH names AS ({_NAMES}), {ss.similar(f'SELECT q, a FROM (SELECT DISTINCT {sq.norm(PART_TYPED)} AS q FROM part) t, names')}, "
    "best AS (SELECT q, a, similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, a) AS n FROM sim WHERE similarity >= 0.72 - 1e-12) s WHERE n = 1) "
    f"SELECT p_partkey AS query_id, a AS external_name, round(similarity, 6) AS score, CASE WHEN similarity >= 0.82 THEN a ELSE {sq.norm(PART_TYPED)} END AS shown_name, "
    f"a IS NOT NULL AS found FROM part LEFT JOIN best ON q = {sq.norm(PART_TYPED)}",
)
def external_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("alias")).distinct()
    return se.external_match(typed_names(spark, sf_dir), names, every=True)


_VECTORS = "SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings"
_CENTERS = f"centers AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS m FROM ({_VECTORS}) e GROUP BY label, pos)"


@register(
    "embedding_knn",
    f"WITH {_CENTERS}, dist AS (SELECT c.label AS query_id, e.vec_id AS id, "
    f"round(sqrt(sum((CAST(e.v AS DOUBLE) - c.m) ** 2)), 6) AS distance FROM ({_VECTORS}) e JOIN centers c ON c.pos = e.pos GROUP BY 1, 2) "
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist) z WHERE rank <= 10",
)
def embedding_knn(spark, sf_dir):
    """The vectors nearest to the mean of each label."""
    vectors = table(spark, sf_dir, "embeddings")
    return ve.knn(ve.centroids(vectors, "label", "embedding"), vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10)


@register(
    "embedding_knn_cosine",
    f"WITH {_CENTERS}, dist AS (SELECT c.label AS query_id, e.vec_id AS id, "
    "round(1 - sum(CAST(e.v AS DOUBLE) * c.m) / (sqrt(sum(CAST(e.v AS DOUBLE) ** 2)) * sqrt(sum(c.m ** 2))), 6) AS distance "
    f"FROM ({_VECTORS}) e JOIN centers c ON c.pos = e.pos GROUP BY 1, 2) "
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist) z WHERE rank <= 10",
)
def embedding_knn_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ve.knn(
        ve.centroids(vectors, "label", "embedding"),
        vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10, "cosine",
    )


def cached_questions(spark, sf_dir):
    """Every question followed by an answer of the next turn."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer_text"))
    return questions(spark, sf_dir).join(answers.hint("merge"), ["conv_id", "turn"]).select(
        F.col("question_id").alias("id"), F.col("text").alias("question_text"), "answer_text"
    )


_CACHE = (
    "asked AS (SELECT question_id, text, " + cache_document_sql("text") + " AS doc FROM questions), "
    "cache AS (SELECT q.question_id AS id, q.doc FROM asked q JOIN questions k USING (question_id) "
    "JOIN conversations a ON a.conv_id = k.conv_id AND a.turn = k.turn + 1 WHERE trim(a.text) <> '')"
)


@register(
    "cache_exact_hits",
    over_questions(
        "SELECT question_id, cached_id FROM asked JOIN (SELECT doc, min(id) AS cached_id FROM cache WHERE doc <> '' GROUP BY doc) c USING (doc)",
        _CACHE,
    ),
)
def cache_exact_hits(spark, sf_dir):
    return ve.exact_hits(questions(spark, sf_dir), cached_questions(spark, sf_dir))


def _tokens(e: str) -> str:
    return f"list_distinct(list_filter(string_split({sq.norm(e)}, ' '), lambda x: x <> ''))"


def _overlap(left: str, right: str) -> str:
    l, r = _tokens(left), _tokens(right)
    return f"CASE WHEN len({l}) = 0 OR len({r}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({l}, {r})) AS DOUBLE) / len({l}) END"


_DOC = "CASE WHEN {0} <> '' THEN {0} ELSE {1} END"
_NEAR = (
    f"asks AS (SELECT question_id, text, {_DOC.format(cache_document_sql('text'), sq.norm('text'))} AS l_doc FROM questions), "
    "stored AS (SELECT r_doc, question_text, min(id) AS cached_id FROM (SELECT q.question_id AS id, k.text AS question_text, q.l_doc AS r_doc FROM asks q "
    "JOIN questions k USING (question_id) JOIN conversations a ON a.conv_id = k.conv_id AND a.turn = k.turn + 1 WHERE trim(a.text) <> '') s GROUP BY 1, 2), "
    "same AS (SELECT r_doc AS l_doc, min(cached_id) AS cached_id FROM stored WHERE r_doc <> '' GROUP BY 1), "
    "alone AS (SELECT DISTINCT l_doc, text FROM asks WHERE l_doc <> '' AND l_doc NOT IN (SELECT l_doc FROM same)), "
    "l_words AS (SELECT l_doc, len(w) AS n, unnest(w) AS word FROM (SELECT DISTINCT l_doc, list_distinct(string_split(l_doc, ' ')) AS w FROM alone) t), "
    "r_words AS (SELECT r_doc, len(w) AS n, unnest(w) AS word FROM (SELECT DISTINCT r_doc, list_distinct(string_split(r_doc, ' ')) AS w FROM stored WHERE r_doc <> '') t), "
    "close AS (SELECT l_doc, r_doc, round(1 - count(*) / sqrt(CAST(l.n AS DOUBLE) * r.n), 6) AS distance FROM l_words l JOIN r_words r USING (word) "
    "GROUP BY l_doc, r_doc, l.n, r.n HAVING round(1 - count(*) / sqrt(CAST(l.n AS DOUBLE) * r.n), 6) < 0.2), "
    "nearest AS (SELECT l_doc, b.distance AS distance, b.cached_id AS cached_id, b.r_doc AS r_doc, b.question_text AS question_text FROM ("
    "SELECT l_doc, min({'distance': distance, 'cached_id': cached_id, 'r_doc': r_doc, 'question_text': question_text}) AS b FROM close JOIN stored USING (r_doc) GROUP BY l_doc) t), "
    f"met AS (SELECT l_doc, text, distance, cached_id, r_doc, question_text, {sq.norm('text')} AS q, {sq.norm('question_text')} AS a FROM alone JOIN nearest USING (l_doc)), "
    + ss.similar("SELECT q, a FROM met")
    + f", fit AS (SELECT l_doc, text, distance, cached_id FROM met LEFT JOIN sim USING (q, a) WHERE {sq.norm('l_doc')} <> '' AND {sq.norm('l_doc')} = {sq.norm('r_doc')} "
    f"OR coalesce(similarity, 0) >= 0.92 AND greatest({_overlap('text', 'question_text')}, {_overlap('l_doc', 'r_doc')}) >= 0.75)"
)


@register(
    "cache_near_hits",
    over_questions(
        "SELECT question_id, cached_id, 0.0 AS distance FROM asks JOIN same USING (l_doc) UNION ALL "
        "SELECT question_id, cached_id, distance FROM asks JOIN fit USING (l_doc, text)",
        _NEAR,
    ),
)
def cache_near_hits(spark, sf_dir):
    return ve.near_hits(questions(spark, sf_dir), cached_questions(spark, sf_dir), 0.2)


@register(
    "cache_similar_documents",
    over_questions(
        "SELECT l_doc, r_doc, round(1 - shared / sqrt(CAST(ln AS DOUBLE) * rn), 6) AS distance FROM ("
        "SELECT l.doc AS l_doc, r.doc AS r_doc, l.n AS ln, r.n AS rn, count(*) AS shared FROM words l JOIN words r ON l.word = r.word "
        "GROUP BY 1, 2, 3, 4) p WHERE round(1 - shared / sqrt(CAST(ln AS DOUBLE) * rn), 6) < 0.3",
        _CACHE
        + ", words AS (SELECT doc, n, unnest(string_split(doc, ' ')) AS word FROM (SELECT DISTINCT doc, len(string_split(doc, ' ')) AS n "
        "FROM asked WHERE doc <> '') d)",
    ),
)
def cache_similar_documents(spark, sf_dir):
    from wicketlake.functions.text import cache_document

    docs = questions(spark, sf_dir).select(cache_document("text").alias("document"))
    return ve.similar_documents(docs, docs, 0.3)


_ASKED = f"concat('what is ', {TYPED}, ' ', p_type)"
_KNOWN = (
    "entries AS (SELECT p_name AS id, min(p_type) AS sub_intent, list(DISTINCT p_type) AS keywords FROM part GROUP BY p_name), "
    f"entry_alias AS (SELECT DISTINCT id, {sq.norm('id')} AS title, {sq.norm('alias')} AS a FROM (SELECT id, unnest([id, concat('what is ', id), reverse(id)]) AS alias FROM entries) t), "
    f"entry_key AS (SELECT DISTINCT id, {sq.norm('k')} AS k FROM (SELECT id, unnest(keywords) AS k FROM entries) t), "
    f"asks AS (SELECT DISTINCT {sq.norm(_ASKED)} AS q, p_type AS topic FROM part), "
    + ss.similar("SELECT q, a FROM asks, entry_alias")
    + ", by_alias AS (SELECT q, id, max(CASE WHEN q = a THEN 4.0 WHEN contains(q, a) THEN 2.6 WHEN contains(a, q) THEN 2.2 ELSE similarity END) AS s, "
    "max(CASE WHEN a = title THEN greatest(similarity - 0.35, 0) ELSE 0 END) AS above FROM sim JOIN entry_alias USING (a) GROUP BY q, id), "
    "by_key AS (SELECT q, id, sum(CASE WHEN contains(k, ' ') THEN 0.75 ELSE 0.35 END) AS worth FROM (SELECT DISTINCT q FROM asks) t JOIN entry_key "
    "ON list_has_all(string_split(q, ' '), string_split(k, ' ')) GROUP BY q, id), "
    "scores AS (SELECT q, topic, id, round(s + above + coalesce(worth, 0) + CASE WHEN topic = sub_intent THEN 0.8 ELSE 0 END, 4) AS score "
    "FROM asks JOIN by_alias USING (q) JOIN entries USING (id) LEFT JOIN by_key USING (q, id)), "
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, topic ORDER BY score DESC, id) AS place FROM scores WHERE score >= 0.9) b WHERE place <= 3)"
)


@register(
    "knowledge_lookup",
    f"WITH {_KNOWN} SELECT p_partkey AS question_id, id, coalesce(score, 0.0) AS score, place, place IS NOT NULL AS found "
    f"FROM part LEFT JOIN best ON q = {sq.norm(_ASKED)} AND topic = p_type",
)
def knowledge_lookup(spark, sf_dir):
    """Questions about products against one knowledge entry per product name."""
    parts = table(spark, sf_dir, "part")
    entries = parts.groupBy("p_name").agg(
        F.array_sort(F.collect_set("p_type")).alias("keywords"), F.min("p_type").alias("sub_intent")
    ).select(
        F.col("p_name").alias("id"), "sub_intent", F.col("p_name").alias("title"),
        F.array(F.concat(F.lit("what is "), "p_name"), F.reverse("p_name")).alias("aliases"), "keywords",
    )
    asked = parts.select(
        F.col("p_partkey").alias("question_id"),
        F.concat(F.lit("what is "), F.expr(TYPED), F.lit(" "), "p_type").alias("text"),
        F.col("p_type").alias("sub_intent"),
    )
    return se.lookup_knowledge(asked, entries, 3, every=True)


@register(
    "entity_mentions",
    over_deliveries(
        f"SELECT concat('match:', match_id) AS text_id, name FROM (SELECT match_id, {MATCH_DOC} AS document FROM matches) m "
        "JOIN (SELECT n_name AS name FROM nation UNION SELECT c_mktsegment FROM customer UNION SELECT r_name FROM region) k "
        "ON contains(m.document, k.name)",
        sq.MATCHES,
    ),
)
def entity_mentions(spark, sf_dir):
    docs = match_docs(ag.match_summaries(deliveries(spark, sf_dir)))
    names = (
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
        .union(table(spark, sf_dir, "customer").select("c_mktsegment"))
        .union(table(spark, sf_dir, "region").select("r_name"))
    )
    return se.entity_mentions(docs.select(F.col("id").alias("text_id"), F.col("document").alias("text")), names)
