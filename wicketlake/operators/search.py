"""Entity resolution, fuzzy search, mentions and knowledge lookup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketlake.functions import similarity as sim
from wicketlake.functions.text import normalize_text, token_overlap, tokens
from wicketlake.operators.candidates import alike, containment
from wicketlake.session import written

LEAST_SCORE = 0.45
FOUND_SCORE = 0.55
CLEAR_SCORE = 0.72
CLEAR_GAP = 0.08
EXTERNAL_SCORE = 0.72
PREFERRED_SCORE = 0.82
LIVE_SCORE = 0.70

# Other names of teams, by a phrase the normalised name contains or equals.
TEAM_SYNONYMS = [
    ("contains", "royal challengers bengaluru", ["RCB", "Royal Challengers Bangalore", "Royal Challengers Bengaluru"]),
    ("contains", "royal challengers bangalore", ["RCB", "Royal Challengers Bangalore", "Royal Challengers Bengaluru"]),
    ("contains", "mumbai indians", ["MI"]),
    ("contains", "chennai super kings", ["CSK"]),
    ("contains", "kolkata knight riders", ["KKR"]),
    ("contains", "sunrisers hyderabad", ["SRH"]),
    ("contains", "rajasthan royals", ["RR"]),
    ("contains", "delhi capitals", ["DC", "Delhi Daredevils", "Delhi Capitals"]),
    ("contains", "delhi daredevils", ["DC", "Delhi Daredevils", "Delhi Capitals"]),
    ("contains", "punjab kings", ["PBKS", "KXIP", "Punjab Kings", "Kings XI Punjab"]),
    ("contains", "kings xi punjab", ["PBKS", "KXIP", "Punjab Kings", "Kings XI Punjab"]),
    ("contains", "gujarat titans", ["GT"]),
    ("contains", "lucknow super giants", ["LSG"]),
    ("equals", "australia", ["AUS"]),
    ("equals", "india", ["IND"]),
    ("equals", "england", ["ENG"]),
    ("equals", "pakistan", ["PAK"]),
    ("equals", "new zealand", ["NZ"]),
    ("equals", "south africa", ["SA"]),
    ("equals", "west indies", ["WI"]),
]


def name_variants(name) -> Column:
    """A name, its initial-and-surname forms and its surname."""
    name = F.trim(F.col(name) if isinstance(name, str) else name)
    toks = tokens(name)
    first = F.upper(F.substring(F.element_at(toks, 1), 1, 1))
    last = F.element_at(toks, -1)
    forms = F.array(
        name,
        F.concat(first, F.lit(" "), last),
        F.concat(first, F.lit(". "), last),
        F.concat(last, F.lit(" "), first),
        F.concat(last, F.lit(", "), first),
        last,
    )
    return F.when(F.size(toks) >= 2, F.array_distinct(forms)).otherwise(F.array(name))


def player_aliases(players: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(``player``, ``alias``): variants of the name, its canonical name and its manual aliases."""
    if manual is None:
        named = players.select("player", F.col("player").alias("known_as"))
    else:
        keyed = canonical_names(players, "player", manual)
        others = manual.select("canonical", F.col("alias").alias("known_as"))
        named = (
            keyed.select("player", F.explode(F.array("player", "canonical_name")).alias("known_as"))
            .unionByName(
                keyed.join(others, F.col("canonical_name") == F.col("canonical")).select("player", "known_as")
            )
        )
    return named.select("player", F.explode(name_variants("known_as")).alias("alias")).distinct()


def team_aliases(name) -> Column:
    """A team name, its acronym and its known other names."""
    name = F.trim(F.col(name) if isinstance(name, str) else name)
    n = normalize_text(name)
    acronym = F.upper(F.array_join(F.transform(tokens(name), lambda t: F.substring(t, 1, 1)), ""))
    known = [
        F.when(n.contains(phrase) if how == "contains" else n == phrase, F.array(*[F.lit(o) for o in others])).otherwise(
            F.array().cast("array<string>")
        )
        for how, phrase, others in TEAM_SYNONYMS
    ]
    return F.array_distinct(F.filter(F.concat(F.array(name, acronym), *known), lambda a: a != ""))


def canonical_names(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Adds ``canonical_name``: by alias where there is one, else the name itself.

    ``aliases`` holds one row per ``alias_norm``; the planner broadcasts it when it is small.
    """
    keyed = df.withColumn("_norm", normalize_text(name))
    one = aliases.select(F.col("alias_norm").alias("_norm"), F.col("canonical").alias("_canonical")).dropDuplicates(["_norm"])
    return (
        keyed.join(one, "_norm", "left")
        .withColumn("canonical_name", F.coalesce("_canonical", name))
        .drop("_norm", "_canonical")
    )


def similar_names(queries: DataFrame, names: DataFrame, least: float, edits: bool = True) -> DataFrame:
    """(``q``, ``a``, ``similarity``) for distinct normalised texts whose similarity reaches ``least``.

    Pairs alike by words, initials or containment meet in equality joins. With ``edits`` every query also meets
    every name in blocks, since texts may be as similar by edit distance alone without agreeing in any part.
    """
    left = written(queries.select(normalize_text("text").alias("q")).filter("q != ''").distinct(), "queries")
    right = written(names.select(normalize_text("alias").alias("a")).filter("a != ''").distinct(), "names")
    scored = pair_similarity(alike(left, right, least, edits), "q", "a", "similarity", normalized=True)
    return scored.filter(F.col("similarity") >= least - 1e-12)


def pair_similarity(df: DataFrame, left: str, right: str, name: str, normalized: bool = False) -> DataFrame:
    """Adds the similarity of two text columns of each row; 0 where one has no text."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(sim.similarity_scores(a.tolist(), b.tolist()))

    text = F.col if normalized else normalize_text
    return df.withColumn(name, score(text(left), text(right)))


def osa_distance(left, right) -> Column:
    """Edit distance with neighbour swaps of two text columns, after normalising."""

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(sim.osa_distances(a.tolist(), b.tolist()))

    return distance(normalize_text(left), normalize_text(right))


def match_bonus(q="q", a="a", exact=1.0, prefix=0.45, inside=0.2) -> Column:
    q, a = F.col(q), F.col(a)
    return F.when(a == q, exact).when(F.startswith(a, q), prefix).when(F.contains(a, q), inside).otherwise(0.0)


def search_score() -> Column:
    """Score of an alias for a query, from their similarity and how one contains the other."""
    words, alias_words = F.split("q", " "), F.split("a", " ")
    single = F.size(words) == 1
    return (
        F.col("similarity")
        + match_bonus()
        + F.when(single & F.array_contains(alias_words, F.col("q")), 0.3).otherwise(0.0)
        + F.when(single & (F.element_at(alias_words, -1) == F.col("q")), 0.4).otherwise(0.0)
    )


def by_score(df: DataFrame, key: str, strength: DataFrame | None) -> DataFrame:
    """Adds ``place`` within ``key``: best score first; of equal ones the entity with more of ``first``, then of
    ``second`` (columns of ``strength``, one row an entity: runs and matches, or wins and matches), then by name."""
    order = [F.desc("score"), F.col("entity")]
    if strength is not None:
        df = df.join(strength.select("entity", "first", "second"), "entity", "left")
        order[1:1] = [F.coalesce("first", F.lit(0)).desc(), F.coalesce("second", F.lit(0)).desc()]
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return placed.drop("first", "second")


def search_entities(
    queries: DataFrame, aliases: DataFrame, limit: int | None = 20, least: float = LEAST_SCORE,
    strength: DataFrame | None = None, edits: bool = True,
) -> DataFrame:
    """Best entities per query: (``query_id``, ``text``, ``entity``, ``score``, ``place``).

    ``queries`` is (``query_id``, ``text``), ``aliases`` is (``entity``, ``alias``), ``strength`` orders equal
    scores (see ``by_score``). Distinct texts are compared once, however many queries or entities share them.
    """
    pairs = similar_names(queries, aliases, least, edits).withColumn("score", search_score()).filter(F.col("score") >= least)
    entities = aliases.select("entity", normalize_text("alias").alias("a")).distinct()
    scored = pairs.join(entities, "a").groupBy("q", "entity").agg(F.round(F.max("score"), 6).alias("score"))
    if limit is not None:
        scored = by_score(scored, "q", strength).filter(F.col("place") <= limit)
    asked = queries.select("query_id", "text", normalize_text("text").alias("q"))
    return asked.join(scored, "q").drop("q")


def search_page(queries: DataFrame, aliases: DataFrame, page: int = 1, limit: int = 20, strength: DataFrame | None = None) -> DataFrame:
    """One page of results per query, with how many there are in all."""
    offset = (max(1, page) - 1) * limit
    found = by_score(search_entities(queries, aliases, None), "query_id", strength)
    of_query = Window.partitionBy("query_id")
    counted = found.withColumn("total", F.count(F.lit(1)).over(of_query))
    return counted.filter((F.col("place") > offset) & (F.col("place") <= offset + limit))


def rank_by_query(queries: DataFrame, names: DataFrame, least: float = 0.3, limit: int | None = None) -> DataFrame:
    """Names kept for a query with a smaller bonus for equality, prefix and containment; the best ``limit`` of them."""
    score = F.col("similarity") + match_bonus(prefix=0.4)
    pairs = similar_names(queries, names, least).withColumn("score", F.round(score, 6)).filter(F.col("score") >= least)
    ranked = (
        queries.select("query_id", normalize_text("text").alias("q"))
        .join(pairs, "q")
        .join(names.select("alias", normalize_text("alias").alias("a")).distinct(), "a")
        .select("query_id", "alias", "score")
    )
    if limit is None:
        return ranked
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "alias")))
    return placed.filter(F.col("place") <= limit)


def weighted_entities(
    queries: DataFrame, candidates: DataFrame, live_names: DataFrame | None = None, own: DataFrame | None = None,
    limit: int | None = None, pairs: DataFrame | None = None,
) -> DataFrame:
    """Candidate score with bonuses for all words, live names, activity and source.

    ``candidates``: (``entity``, ``alias``, ``source``, ``is_active``). A query is (``query_id``, ``text``,
    ``live_leaning``). ``own`` (``query_id``, ``entity``, ``score``) are scores that candidates bring along, as
    from a search: a candidate never counts less than its own, and those are candidates whatever their likeness.
    ``limit`` keeps the best of a query, of equal ones that with the larger own score, then by name. ``pairs``
    (``q``, ``a``, ``similarity``) are texts to score where they are known already.
    """
    words, alias_words = F.split("q", " "), F.split("a", " ")
    if pairs is None:
        pairs = similar_names(queries, candidates, LEAST_SCORE)
    if live_names is None:
        pairs = pairs.withColumn("is_live", F.lit(False))
    else:
        live = live_names.select(normalize_text("name").alias("a"), F.lit(True).alias("is_live")).distinct()
        pairs = pairs.join(live, "a", "left").fillna({"is_live": False})
    base = (
        F.col("similarity")
        + match_bonus()
        + F.when((F.size(words) == 1) & F.array_contains(alias_words, F.col("q")), 0.2).otherwise(0.0)
        + F.when((F.size(words) > 1) & F.forall(words, lambda w: F.array_contains(alias_words, w)), 0.18).otherwise(0.0)
    )
    asked = queries.select("query_id", "live_leaning", normalize_text("text").alias("q"))
    entities = candidates.select("entity", "source", "is_active", normalize_text("alias").alias("a")).distinct()
    scored = (
        pairs.withColumn("base", base)
        .join(entities, "a")
        .join(asked, "q")
        .withColumn("score", F.col("base") + F.when(F.col("live_leaning") & F.col("is_live"), 0.45).otherwise(0.0))
        .select("query_id", "live_leaning", "entity", "source", "is_active", "score", F.lit(0.0).alias("own"))
    )
    if own is not None:
        facts = candidates.select("entity", "source", "is_active").distinct()
        brought = own.select("query_id", "entity", F.col("score").alias("own")).join(facts, "entity")
        brought = brought.join(queries.select("query_id", "live_leaning"), "query_id").withColumn("score", F.col("own"))
        scored = scored.unionByName(brought.select(*scored.columns))
    scored = scored.groupBy("query_id", "live_leaning", "entity", "source", "is_active").agg(
        F.max("score").alias("score"), F.max("own").alias("own")
    )
    extra = F.when(
        F.col("live_leaning"),
        F.when(F.col("is_active"), 0.3).otherwise(0.0) + F.when(F.col("source") == "cricapi", 0.22).otherwise(0.0),
    ).otherwise(F.when(F.col("source").isin("archive", "vector"), 0.04).otherwise(0.0))
    out = scored.select("query_id", "entity", F.round(F.col("score") + extra, 4).alias("weighted_score"), "own")
    if limit is not None:
        order = Window.partitionBy("query_id").orderBy(F.desc("weighted_score"), F.desc("own"), "entity")
        out = out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return out.drop("own")


def alias_hits(queries: DataFrame, manual: DataFrame) -> DataFrame:
    """(``query_id``, ``alias_hit``): the canonical name of the whole text, else of its first word or
    word pair that is an alias. ``manual`` is (``alias_norm``, ``canonical``)."""
    toks = tokens("text")
    starts = F.sequence(F.lit(1), F.size(toks) - 1)
    none = F.array().cast("array<string>")
    pairs = F.when(F.size(toks) > 1, F.transform(starts, lambda i: F.array_join(F.slice(toks, i, F.lit(2)), " "))).otherwise(none)
    keys = queries.select("query_id", F.posexplode(F.concat(F.array(normalize_text("text")), toks, pairs)).alias("n", "alias_norm"))
    return keys.join(manual.select("alias_norm", "canonical"), "alias_norm").groupBy("query_id").agg(
        F.min_by("canonical", "n").alias("alias_hit")
    )


def resolve(
    queries: DataFrame, aliases: DataFrame, manual: DataFrame | None = None, choices: int = 5, strength: DataFrame | None = None
) -> DataFrame:
    """One row per query: resolved, clarify or not_found, with up to five choices.

    A manual alias replaces the text first. Order of tests: the alias names an entity; best score
    at least 0.55; then a weak or close best score asks for clarification, unless an alias was hit.
    """
    asked = with_alias_hits(queries, manual)
    return judged(asked, search_aliased(asked, aliases, choices, strength))


def with_alias_hits(queries: DataFrame, manual: DataFrame | None) -> DataFrame:
    if manual is None:
        return queries.withColumn("alias_hit", F.lit(None).cast("string"))
    return queries.join(alias_hits(queries, manual), "query_id", "left")


def search_aliased(asked: DataFrame, aliases: DataFrame, choices: int, strength: DataFrame | None) -> DataFrame:
    """What is found for a query, or for the manual alias it hit."""
    return search_entities(asked.select("query_id", F.coalesce("alias_hit", "text").alias("text")), aliases, choices, strength=strength)


def judged(queries: DataFrame, found: DataFrame) -> DataFrame:
    """``resolve`` of queries with ``alias_hit`` by the entities found for them."""
    per_query = found.groupBy("query_id").agg(
        F.max("score").alias("best_score"),
        F.min_by("entity", "place").alias("best"),
        F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "entity"))), lambda c: c.entity), "|"
        ).alias("choices"),
    )
    out = queries.join(per_query, "query_id", "left")
    hit, score = F.col("alias_hit").isNotNull(), F.col("best_score")
    weak = (score < CLEAR_SCORE) | (F.coalesce("second", F.lit(0.0)) >= score - CLEAR_GAP)
    named = hit & (normalize_text("best") == normalize_text("alias_hit"))
    stub = hit & ~named & (score.isNull() | ((score < FOUND_SCORE) & weak))
    status = (
        F.when(named | stub, "resolved")
        .when(score.isNull(), "not_found")
        .when((score >= FOUND_SCORE) | ~weak, "resolved")
        .otherwise("clarify")
    )
    final_score = (
        F.when(F.coalesce(named, F.lit(False)), 1.0)
        .when(F.coalesce(stub, F.lit(False)), F.coalesce(F.greatest(score, F.lit(0.93)), F.lit(0.92)))
        .otherwise(F.coalesce(score, F.lit(0.0)))
    )
    return out.select(
        "query_id",
        "text",
        status.alias("status"),
        F.when(status == "resolved", F.when(F.coalesce(stub, F.lit(False)), F.col("alias_hit")).otherwise(F.col("best"))).alias("entity"),
        F.when(hit & score.isNull(), 0.92).otherwise(final_score).alias("score"),
        F.coalesce(weak, F.lit(False)).alias("ambiguous"),
        F.coalesce("choices", F.lit("")).alias("choices"),
    )


def resolve_live_leaning(weighted: DataFrame, least: float | None = None) -> DataFrame:
    """Resolution of live-leaning queries by weighted score: weak or close ones ask, or with ``least`` (names of
    a live feed only) the best one that reaches it is taken and no other."""
    w = Window.partitionBy("query_id").orderBy(F.desc("weighted_score"), "entity")
    top = weighted.withColumn("place", F.row_number().over(w)).filter("place <= 2")
    best = top.groupBy("query_id").agg(
        F.max("weighted_score").alias("score"),
        F.min_by("entity", "place").alias("entity"),
        F.coalesce(F.max(F.when(F.col("place") == 2, F.col("weighted_score"))), F.lit(0.0)).alias("second"),
    )
    if least is not None:
        return best.filter(F.col("score") >= least).select("query_id", F.lit("resolved").alias("status"), "entity", "score")
    unclear = (F.col("score") < CLEAR_SCORE) | (F.col("second") >= F.col("score") - CLEAR_GAP)
    return best.select("query_id", F.when(unclear, "clarify").otherwise("resolved").alias("status"), "entity", "score")


def resolve_leaning(
    queries: DataFrame, aliases: DataFrame, feed: DataFrame, playing: DataFrame | None = None, manual: DataFrame | None = None,
    strength: DataFrame | None = None, choices: int = 5,
) -> DataFrame:
    """One row per query (``query_id``, ``text``, ``live_leaning``): ``status``, ``entity``, ``score`` and ``branch``.

    A query that leans to live matches and names no alias is settled by the weighted scores of what the archive
    search finds for it, or where that finds nothing by the names of the live feed (``feed``: ``name`` and, if
    known, ``is_active``) at ``LIVE_SCORE`` or more; all others, and those that neither settles, as by ``resolve``.
    ``playing`` (``name``) are further names that count as live.
    """
    active = F.col("is_active") if "is_active" in feed.columns else F.lit(False)
    feed = feed.select("name", active.alias("is_active"))
    live = feed.select("name") if playing is None else feed.select("name").unionByName(playing.select("name"))
    asked = written(with_alias_hits(queries, manual), "asked")
    found = written(search_aliased(asked.drop("live_leaning"), aliases, choices, strength), "found")
    plain = judged(asked.drop("live_leaning"), found)
    leaning = asked.filter("live_leaning AND alias_hit IS NULL").drop("alias_hit")
    mine = found.join(leaning.select("query_id"), "query_id", "left_semi")
    known = mine.join(aliases, "entity").select("query_id", "entity", "alias", normalize_text("text").alias("q"), normalize_text("alias").alias("a"))
    pairs = pair_similarity(known.filter("q != '' AND a != ''").select("q", "a").distinct(), "q", "a", "similarity", normalized=True)
    facts = known.select("entity", "alias", F.lit("vector").alias("source"), F.lit(False).alias("is_active")).distinct()
    archive = weighted_entities(leaning, facts, live, mine.select("query_id", "entity", "score"), pairs=pairs.filter(F.col("similarity") >= LEAST_SCORE - 1e-12))
    first = resolve_live_leaning(archive.join(mine.select("query_id", "entity"), ["query_id", "entity"], "left_semi"))
    names = feed.select(F.col("name").alias("entity"), F.col("name").alias("alias"), F.lit("cricapi").alias("source"), "is_active")
    rest = written(leaning.join(mine.select("query_id").distinct(), "query_id", "left_anti"), "rest")
    second = resolve_live_leaning(weighted_entities(rest, names, live), LIVE_SCORE)
    settled = first.withColumn("branch", F.lit("archive")).unionByName(second.withColumn("branch", F.lit("live")))
    settled = settled.select("query_id", *[F.col(c).alias(f"of_{c}") for c in ("status", "entity", "score", "branch")])
    out = plain.join(settled, "query_id", "left")
    live_one = F.col("of_status").isNotNull()
    pick = lambda mine, other: F.when(live_one, F.col(mine)).otherwise(other)
    resolved = F.when(F.col("of_status") == "resolved", F.col("of_entity"))
    return out.select(
        "query_id",
        "text",
        pick("of_status", F.col("status")).alias("status"),
        F.when(live_one, resolved).otherwise(F.col("entity")).alias("entity"),
        pick("of_score", F.col("score")).alias("score"),
        F.coalesce("of_branch", F.lit("plain")).alias("branch"),
    )


def best_variant(resolved: DataFrame, variants: DataFrame) -> DataFrame:
    """Best resolution over several texts of one question (``question_id``, ``position``, ``query_id``).

    Resolved beats clarify beats not found; then the higher score among resolved; then position.
    """
    weight = (
        F.when(F.col("status") == "resolved", 3).when(F.col("status") == "clarify", 2).otherwise(1)
    )
    rank = F.struct(
        (-weight).alias("w"),
        F.when(F.col("status") == "resolved", -F.col("score")).otherwise(0.0).alias("s"),
        "position",
        "status",
        "entity",
        "score",
        "text",
    )
    joined = variants.join(resolved, "query_id")
    return joined.groupBy("question_id").agg(F.min(rank).alias("b")).select(
        "question_id", "b.status", "b.entity", "b.score", "b.text"
    )


def entity_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(``text_id``, ``name``) for every known name inside a text; ``texts`` is (``text_id``, ``text``).

    A name meets the texts that hold its rarest three letters; only those are looked through.
    """
    known = names.select(F.trim("name").alias("inner")).filter("inner != ''").distinct()
    clean = written(texts.select(F.col("text_id").cast("string").alias("text_id"), F.trim("text").alias("text")), "texts")
    met = containment(known, clean, "text", "text_id").groupBy(F.col("key").alias("text_id")).agg(F.collect_set("inner").alias("names"))
    inside = F.filter("names", lambda name: F.contains(F.col("text"), name))
    return clean.join(met, "text_id").select("text_id", F.explode(inside).alias("name")).distinct()


# Scores of a knowledge entry.
KNOWLEDGE_SAME = 4.0
KNOWLEDGE_INSIDE = 2.6
KNOWLEDGE_AROUND = 2.2
KNOWLEDGE_PHRASE = 0.75
KNOWLEDGE_WORD = 0.35
KNOWLEDGE_TITLE_FLOOR = 0.35
KNOWLEDGE_TOPIC = 0.8
KNOWLEDGE_LEAST = 0.9
#: s + (s - floor of titles) reaches the least score from here on.
KNOWLEDGE_ALIKE = 0.6249


def _keyword_worth(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(``q``, ``id``, ``worth``): what the keywords add whose words are all in the question; each keyword meets the
    questions that hold its rarest word."""
    words = asked.select("q").distinct().select("q", F.array_distinct(F.split("q", " ")).alias("words"))
    held = words.select("q", F.explode("words").alias("word"))
    often = held.groupBy("word").agg(F.count("*").alias("often"))
    keys = entries.select("id", F.posexplode("keywords").alias("n", "keyword")).filter("keyword != ''")
    keys = keys.withColumn("parts", F.array_distinct(F.split("keyword", " ")))
    parts = keys.withColumn("word", F.explode("parts")).join(often, "word")
    rare = parts.groupBy("id", "n", "keyword", "parts").agg(F.min_by("word", "often").alias("word"))
    met = rare.join(held, "word").join(words, "q").filter(F.forall("parts", lambda p: F.array_contains("words", p)))
    worth = F.when(F.contains("keyword", F.lit(" ")), KNOWLEDGE_PHRASE).otherwise(KNOWLEDGE_WORD)
    return met.groupBy("q", "id").agg(F.sum(worth).alias("worth"))


def lookup_knowledge(questions: DataFrame, knowledge: DataFrame, limit: int = 5, every: bool = False, edits: bool = True) -> DataFrame:
    """Best knowledge entries per question: (``question_id``, ``id``, ``score``, ``place``).

    ``questions`` is (``question_id``, ``text``, ``sub_intent``). Equal questions are scored once. With ``every``
    a question without an entry has a row of score 0 and no id, and ``found`` tells them apart.

    Without its topic or a keyword an entry is enough only by an alias of similarity ``KNOWLEDGE_ALIKE``, so
    questions meet the entries of their topic, of their keywords and of such aliases, and only those are scored.
    """
    entries = knowledge.select(
        "id",
        F.coalesce("sub_intent", F.lit("")).alias("sub_intent"),
        normalize_text("title").alias("title"),
        F.filter(
            F.transform(F.array_distinct(F.concat(F.array("title"), "aliases")), normalize_text), lambda a: a != ""
        ).alias("aliases"),
        F.transform("keywords", normalize_text).alias("keywords"),
    )
    entries = written(entries, "entries")
    asked = questions.select(
        "question_id", normalize_text("text").alias("q"), F.coalesce("sub_intent", F.lit("")).alias("topic")
    )
    distinct = written(asked.filter("q != ''").select("q", "topic").distinct(), "questions")
    aliases = entries.select("id", "sub_intent", "title", F.explode(F.array_distinct("aliases")).alias("a"))
    worth = written(_keyword_worth(distinct, entries), "keywords")
    same = distinct.filter("topic != ''").join(entries.select("id", F.col("sub_intent").alias("topic")), "topic").select("q", "topic", "id")
    word = distinct.join(worth, "q").select("q", "topic", "id")
    like = similar_names(distinct.select(F.col("q").alias("text")), aliases.select(F.col("a").alias("alias")), KNOWLEDGE_ALIKE, edits)
    like = like.select("q", "a").join(aliases.select("a", "id").distinct(), "a").join(distinct, "q").select("q", "topic", "id")
    met = same.unionByName(word).unionByName(like).distinct().join(aliases, "id")
    scores = pair_similarity(met.select("q", "a").distinct(), "q", "a", "similarity", normalized=True)
    q, a, s = F.col("q"), F.col("a"), F.col("similarity")
    by_alias = F.when(q == a, KNOWLEDGE_SAME).when(F.contains(q, a), KNOWLEDGE_INSIDE).when(F.contains(a, q), KNOWLEDGE_AROUND).otherwise(s)
    above = F.when(F.col("title") == a, F.greatest(s - KNOWLEDGE_TITLE_FLOOR, F.lit(0.0))).otherwise(0.0)
    best = met.join(scores, ["q", "a"]).groupBy("q", "topic", "id", "sub_intent").agg(F.max(by_alias).alias("alias"), F.max(above).alias("above"))
    on_topic = F.when((F.col("topic") != "") & (F.col("topic") == F.col("sub_intent")), KNOWLEDGE_TOPIC).otherwise(0.0)
    total = F.col("alias") + F.col("above") + F.coalesce("worth", F.lit(0.0)) + on_topic
    scored = best.join(worth, ["q", "id"], "left").select("q", "topic", "id", F.round(total, 4).alias("score"))
    titled = scored.filter(F.col("score") >= KNOWLEDGE_LEAST).join(knowledge.select("id", F.col("title").alias("_title")), "id")
    w = Window.partitionBy("q", "topic").orderBy(F.desc("score"), "_title", "id")
    best = titled.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
    if every:
        return asked.join(best, ["q", "topic"], "left").select(
            "question_id", "id", F.coalesce("score", F.lit(0.0)).alias("score"), "place", F.col("place").isNotNull().alias("found")
        )
    return asked.join(best, ["q", "topic"]).select("question_id", "id", "score", "place")


def external_match(queries: DataFrame, names: DataFrame, least: float = EXTERNAL_SCORE, every: bool = False) -> DataFrame:
    """The most similar external name per query, when similar enough; shown instead when very similar.

    With ``every`` a query without such a name has a row that shows the query itself, and ``found`` tells them apart.
    """
    pairs = similar_names(queries, names, least)
    best = pairs.groupBy("q").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "a")).alias("b"))
    return (
        queries.select("query_id", normalize_text("text").alias("q"))
        .join(best, "q", "left" if every else "inner")
        .select(
            "query_id",
            F.col("b.a").alias("external_name"),
            F.round(-F.col("b.s"), 6).alias("score"),
            F.when(-F.col("b.s") >= PREFERRED_SCORE, F.col("b.a")).otherwise(F.col("q")).alias("shown_name"),
            *([F.col("b").isNotNull().alias("found")] if every else []),
        )
    )


def compatible(similarity: Column, q: str, cached: str, q_doc: str, cached_doc: str) -> Column:
    """Whether a cached question may answer another: same document, or similar text and shared words."""
    same = (normalize_text(q_doc) != "") & (normalize_text(q_doc) == normalize_text(cached_doc))
    overlap = F.greatest(token_overlap(q, cached), token_overlap(q_doc, cached_doc))
    return same | ((similarity >= 0.92) & (overlap >= 0.75))
