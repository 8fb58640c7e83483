"""Nearest vectors, and nearest cached questions by their words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketlake.functions.text import cache_document, normalize_text
from wicketlake.operators.search import compatible, pair_similarity
from wicketlake.session import written

MAX_CACHE_DISTANCE = 0.05


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(size > 0, size, 1)[:, None]


def _far(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of two sets of vectors."""
    return np.sqrt(np.maximum((q**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * (q @ c.T), 0.0))


def _reported(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Distances as they are reported and ranked; a zero vector is at cosine distance 1 of everything."""
    return np.round(1 - _unit(q) @ _unit(c).T if metric == "cosine" else _far(q, c), 6)


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


class Pivots:
    """Parts of the space: each vector belongs to its nearest pivot. Cosine distances are worked out on vectors of
    length 1, whose Euclidean distance grows with them; zero vectors are a part of their own, number -1."""

    def __init__(self, pivots: np.ndarray, metric: str):
        self.metric, self.pivots = metric, _unit(pivots) if metric == "cosine" else pivots

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        return _far(_unit(vectors) if self.metric == "cosine" else vectors, self.pivots)

    def home(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(vectors)
        part = d.argmin(axis=1)
        reach = d[np.arange(len(d)), part]
        if self.metric == "cosine":
            zero = ~vectors.any(axis=1)
            part, reach = np.where(zero, -1, part), np.where(zero, 0.0, reach)
        return part, reach

    def least(self, vectors: np.ndarray, parts: dict[int, tuple[int, float, float]]) -> dict[int, np.ndarray]:
        """For each part, the least Euclidean distance its members may have: by the ring in which they lie, and by
        the border to the pivot nearest to the query. Nothing is known of zero vectors."""
        d, found = self.distances(vectors), {}
        near = d.argmin(axis=1)
        between = _far(self.pivots, self.pivots)
        zero = ~vectors.any(axis=1) if self.metric == "cosine" else np.zeros(len(d), bool)
        for part, (_, low, high) in parts.items():
            if part < 0:
                found[part] = np.zeros(len(d))
                continue
            gap = between[part, near]
            border = np.where(gap > 0, (d[:, part] ** 2 - d.min(axis=1) ** 2) / np.where(gap > 0, 2 * gap, 1), 0.0)
            found[part] = np.where(zero, 0.0, np.maximum.reduce([d[:, part] - high, low - d[:, part], border, np.zeros(len(d))]))
        return found


def _visits(queries: DataFrame, space: Pivots, parts: dict, k: int, bounded: bool) -> DataFrame:
    """(query_id, vector, part): the nearest parts that hold ``k`` vectors, or if ``bounded`` all others that may hold
    one within the distance ``bound`` of the query."""

    def run(batches):
        for frame in batches:
            if not len(frame):
                continue
            v = _stack(frame["vector"])
            least = space.least(v, parts)
            names = np.array(list(least))
            table = np.column_stack([least[p] for p in names])
            middle = space.distances(v)
            order = np.column_stack([middle[:, p] if p >= 0 else np.full(len(v), np.inf) for p in names])
            sizes = np.array([parts[p][0] for p in names])
            rank = np.argsort(order, axis=1, kind="stable")
            held = np.cumsum(sizes[rank], axis=1) - sizes[rank]
            first = np.zeros(table.shape, bool)
            np.put_along_axis(first, rank, held < k, axis=1)
            if bounded:
                limit = frame["bound"].to_numpy(dtype=np.float64)
                # a distance as reported, as a Euclidean one, with room for its rounding
                reach = np.sqrt(2 * np.maximum(limit, 0)) + 1e-3 if space.metric == "cosine" else limit
                pick = ~first & (table <= (reach + 1e-5)[:, None])
            else:
                pick = first
            i, j = np.nonzero(pick)
            yield pd.DataFrame({"query_id": frame["query_id"].to_numpy()[i], "vector": frame["vector"].to_numpy(object)[i], "part": names[j]})

    return queries.mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, vector array<double>, part bigint")


def _nearest_in_parts(visits: DataFrame, corpus: DataFrame, chunks: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, id, distance) of the ``k`` nearest of each visited chunk of a part."""
    types = f"query_id {dict(visits.dtypes)['query_id']}, id {dict(corpus.dtypes)['id']}, distance double"

    def compare(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        dist, ids = _reported(_stack(mine["vector"]), _stack(other["vector"]), metric), other["id"].to_numpy()
        keep, found = min(k, dist.shape[1]), []
        for i, query in enumerate(mine["query_id"]):
            limit = np.partition(dist[i], keep - 1)[keep - 1]
            near = np.nonzero(dist[i] <= limit)[0]
            near = near[np.lexsort((ids[near], dist[i][near]))][:keep]
            found.append(pd.DataFrame({"query_id": query, "id": ids[near], "distance": dist[i][near]}))
        return pd.concat(found)

    asked = visits.join(chunks, "part").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    placed = corpus.join(chunks, "part").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    placed = placed.join(asked.select("part", "chunk").distinct(), ["part", "chunk"], "left_semi")
    asked = asked.join(placed.select("part", "chunk").distinct(), ["part", "chunk"], "left_semi")
    return asked.groupBy("part", "chunk").cogroup(placed.groupBy("part", "chunk")).applyInPandas(compare, types)


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", pivots: int = 64, block: int = 20000) -> DataFrame:
    """The ``k`` nearest corpus vectors of each query: (``query_id``, ``id``, ``distance``, ``rank``).

    ``queries`` is (``query_id``, ``vector``), ``corpus`` is (``id``, ``vector``). Exact. ``pivots`` corpus vectors,
    chosen by a hash of their ids, divide the space. A query first visits the nearest parts that hold ``k``
    vectors; its k-th distance there bounds the parts that it need visit besides. A part of any size is dealt
    out in chunks of about ``block`` vectors, each of which gives its own nearest ``k``. The driver sees the
    pivots, and the size and the ring of each part.
    """
    queries = written(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")), "queries")
    vectors = corpus.select("id", F.col("vector").cast("array<double>").alias("vector"))
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vector").collect()
    types = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(vectors.dtypes)['id']}, distance double"
    if not chosen:
        return queries.sparkSession.createDataFrame([], types + ", rank int")
    space = Pivots(np.unique(np.array([r["vector"] for r in chosen], dtype=np.float64), axis=0), metric)

    def deal(batches):
        for frame in batches:
            if len(frame):
                part, reach = space.home(_stack(frame["vector"]))
                yield frame.assign(part=part, reach=reach)

    dealt = written(vectors.mapInPandas(deal, f"id {dict(vectors.dtypes)['id']}, vector array<double>, part bigint, reach double"), "parts")
    rings = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high"))
    parts = {r["part"]: (r["n"], r["low"], r["high"]) for r in rings.collect()}
    chunks = rings.select("part", F.ceil(F.col("n") / block).cast("int").alias("chunks"))
    placed = dealt.select("id", "vector", "part")
    first = written(_nearest_in_parts(_visits(queries, space, parts, k, False), placed, chunks, k, metric), "first")
    of_query = Window.partitionBy("query_id").orderBy("distance", "id")
    bound = first.withColumn("n", F.row_number().over(of_query)).where(F.col("n") <= k).groupBy("query_id").agg(F.max("distance").alias("bound"))
    rest = _visits(queries.join(bound, "query_id"), space, parts, k, True)
    near = first.unionByName(_nearest_in_parts(rest, placed, chunks, k, metric))
    return near.withColumn("rank", F.row_number().over(of_query)).filter(F.col("rank") <= k)


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group."""
    parts = vectors.select(group, F.posexplode(vector).alias("pos", "v"))
    means = parts.groupBy(group, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p.m)
    return means.groupBy(F.col(group).alias("query_id")).agg(ordered.alias("vector"))


#: Bags of up to so many words carry their words and text to where they meet.
SHORT_BAG = 16
#: Longs of a bag's signature.
SIGNATURE = 8
#: Rows of one word on either side of a task, before the word is dealt out in blocks.
WORD_BLOCK = 4096


def _signature(word: Column) -> list[Column]:
    """One bit for each word, in ``SIGNATURE`` longs."""
    at = F.pmod(F.xxhash64(word), F.lit(64 * SIGNATURE))
    return [
        F.bit_or(F.when(at.between(64 * k, 64 * k + 63), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
        .alias(f"s{k}")
        for k in range(SIGNATURE)
    ]


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _in_word_blocks(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of frequent words, with the band of their sizes and the parts in which they meet as keys:
    no task holds more than about ``WORD_BLOCK`` rows of a word on either side."""
    b = b.withColumn("l_band", F.explode(F.array(F.col("r_band") - 1, "r_band", F.col("r_band") + 1)))
    parts = lambda df, name: df.groupBy("word", "l_band").agg(F.ceil(F.count("*") / WORD_BLOCK).cast("int").alias(name))
    sizes = written(parts(a, "l_parts").join(parts(b, "r_parts").hint("merge"), ["word", "l_band"]), "word-sizes").hint("merge")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    a = a.join(sizes, ["word", "l_band"]).withColumn("l_part", F.pmod(F.xxhash64("l_id"), "l_parts").cast("int")).withColumn("r_part", every("r_parts"))
    b = b.join(sizes, ["word", "l_band"]).withColumn("r_part", F.pmod(F.xxhash64("r_id"), "r_parts").cast("int")).withColumn("l_part", every("l_parts"))
    # By number: rows are few and small where pairs are many, and would be put together in few tasks by their size.
    keys, tasks = ["word", "l_band", "l_part", "r_part"], _tasks(a)
    return a.drop("l_parts", "r_parts").repartition(tasks, *keys), b.drop("l_parts", "r_parts").repartition(tasks, *keys)


def similar_documents(left: DataFrame, right: DataFrame, max_distance: float = MAX_CACHE_DISTANCE) -> DataFrame:
    """Pairs of distinct word-bag documents within a cosine distance: (``l_doc``, ``r_doc``, ``distance``).

    A document is words in one string, of which repeated ones count once. Bags that are close share most words, so they
    share one of their rarest few, and only those are joined on. A pair fits by size, by the places of the word, which
    must leave enough words behind them to be shared, and by the signatures of the bags, which bound what can be shared.
    Pairs grow with the square of bags that differ in a word or two, so those of two bags of up to ``SHORT_BAG`` words
    are never shuffled: a short bag brings its words and its text along, and the pair is verified where it meets on its
    rarest shared word. Pairs with a longer bag, of which the signatures leave few others than close ones, are made
    distinct as numbers and meet their texts after. If both sides are one table, its rows are shuffled once, and pairs
    are looked for in one order. Words of many bags are dealt out in blocks. Documents and their rarest words are written
    once. All joins are of tables that grow with the documents, so they are merge joins, whatever little a written
    table takes on disk. The driver sees the words that more than ``WORD_BLOCK`` bags would meet on.
    """
    t, alike = 1.0 - max_distance, left.sameSemantics(right)
    flag = lambda df, l, r: df.select(F.col("document").alias("doc"), F.lit(l).alias("l"), F.lit(r).alias("r"))
    both = flag(left, True, False).unionByName(flag(right, False, True)).filter("doc != ''")
    both = both.groupBy("doc").agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))
    both = both.withColumn("words", F.array_distinct(F.split("doc", " "))).withColumn("n", F.size("words"))
    both = written(both.withColumn("id", F.monotonically_increasing_id()), "documents")
    short = SHORT_BAG if t > 0 else 0
    words = both.select("id", "l", "r", "n", "doc", F.posexplode("words").alias("at", "text"))
    words = words.withColumn("doc", F.when((F.col("at") == 0) & (F.col("n") <= short), F.col("doc"))).drop("at")
    # A word is its number from here on; words of equal frequency are in the order of their numbers.
    often = words.groupBy("text").agg(F.count(F.lit(1)).alias("often"))
    often = written(often.withColumn("word", F.monotonically_increasing_id()), "words")
    # Bags of n words at cosine distance d share at least (1 - d)^2 * n of them.
    must_share = F.ceil(F.col("n") * F.lit(t * t) - F.lit(1e-9))
    band = F.floor(F.log(F.col("n")) / -np.log(t * t)).cast("int") if 0 < t < 1 else F.col("n") if t >= 1 else F.lit(0)
    bags = words.join(often.hint("merge"), "text").groupBy("id").agg(
        F.any_value("l").alias("l"), F.any_value("r").alias("r"), F.any_value("n").alias("n"), F.max("doc").alias("doc"),
        F.array_sort(F.collect_list(F.struct("often", "word"))).alias("rare_first"), *_signature(F.col("word")),
    )
    bags = bags.withColumn("bag", F.col("rare_first.word")).withColumn("first", F.slice("bag", F.lit(1), (F.col("n") - must_share + 1).cast("int")))
    signed = [f"s{k}" for k in range(SIGNATURE)]
    bags = written(bags.select("id", "l", "r", "n", "doc", band.alias("band"), F.when(F.col("n") <= short, F.col("bag")).alias("bag"), "first", *signed), "rare-words")
    rows = bags.select("*", F.posexplode("first").alias("at", "word")).withColumn("prev", F.expr("try_element_at(first, nullif(at, 0))"))
    frequent = [r["word"] for r in rows.groupBy("word").count().filter(F.col("count") > WORD_BLOCK).select("word").collect()]
    carried = ["id", "n", "band", "at", "prev", "doc", "bag", *signed]

    if alike:  # both sides have the same rows, which are shuffled once
        rows = rows.repartition(_tasks(rows), "word")
    of_side = lambda df, s: df.select("word", *[F.col(c).alias(f"{s}_{c}") for c in carried])
    rows_of = lambda s: rows if alike else rows.filter(s)

    need = t * F.sqrt(F.col("l_n").cast("double") * F.col("r_n")) - 1e-6
    sized = (F.col("r_n") >= F.col("l_n") * (t * t) - 1e-9) & (F.col("l_n") >= F.col("r_n") * (t * t) - 1e-9)
    enough = F.least(F.col("l_n") - F.col("l_at"), F.col("r_n") - F.col("r_at")) >= need
    # A pair that shares the word before as well meets there; a bag meets itself on its first word. Of like sides a pair
    # is looked for in one order.
    early = F.coalesce(F.col("l_prev") != F.col("r_prev"), F.lit(True))
    order = F.col("l_id") < F.col("r_id") if alike else F.col("l_id") != F.col("r_id")
    # Bits of one side that the other lacks are words that it lacks; half of them rule out most pairs.
    lacks = lambda x, y, bits: sum(F.bit_count(F.col(f"{x}_{s}").bitwiseAND(F.bitwise_not(f"{y}_{s}"))) for s in bits)
    signs = lambda bits: (F.col("l_n") - lacks("l", "r", bits) >= need) & (F.col("r_n") - lacks("r", "l", bits) >= need)
    fit = (order | ((F.col("l_id") == F.col("r_id")) & (F.col("l_at") == 0))) & enough & sized & early & signs(signed[::2]) & signs(signed)

    def met(l_sizes: Column, r_sizes: Column, *also: Column) -> DataFrame:
        """Pairs of bags of such sizes that meet on a word and fit."""

        def on(keys: list[str], a: DataFrame, b: DataFrame) -> DataFrame:
            pairs = a.join(b.hint("merge"), keys).filter(fit & l_sizes & r_sizes)
            for condition in also:
                pairs = pairs.filter(condition)
            return pairs.select("word", *[f"{s}_{c}" for s in "lr" for c in carried])

        if not frequent:
            return on(["word"], of_side(rows_of("l"), "l"), of_side(rows_of("r"), "r"))
        crowded = F.col("word").isin(frequent)
        seldom = on(["word"], of_side(rows_of("l").filter(~crowded), "l"), of_side(rows_of("r").filter(~crowded), "r"))
        a, b = of_side(rows_of("l").filter(crowded), "l"), of_side(rows_of("r").filter(crowded), "r")
        return seldom.unionByName(on(["word", "l_band", "l_part", "r_part"], *_in_word_blocks(a.filter(l_sizes), b.filter(r_sizes))))

    def both_ways(pairs: DataFrame, names: list[str]) -> DataFrame:
        """Columns l_... and r_... of ``pairs``, and with like sides also in the other order."""
        if not alike:
            return pairs
        turn = lambda x, y: F.struct(*[F.col(f"{x}_{c}").alias(f"l_{c}") for c in names], *[F.col(f"{y}_{c}").alias(f"r_{c}") for c in names])
        rest = [c for c in pairs.columns if c[2:] not in names]
        one, same = turn("l", "r"), F.col(f"l_{names[0]}") == F.col(f"r_{names[0]}")
        return pairs.select(*rest, F.inline(F.when(same, F.array(one)).otherwise(F.array(one, turn("r", "l")))))

    away = lambda shared: F.round(1 - shared / F.sqrt(F.col("l_n").cast("double") * F.col("r_n")), 6)
    # Dealt out by the left document, where pairs are made distinct and meet its text without another shuffle.
    long = F.greatest("l_n", "r_n") > short
    pairs = met(F.col("l_n") > short * t * t - 1e-6, F.col("r_n") > short * t * t - 1e-6, long).select("l_id", "r_id").repartition("l_id").distinct()
    side = lambda name: both.filter(name).select(F.col("id").alias(f"{name}_id"), F.col("doc").alias(f"{name}_doc"), F.col("n").alias(f"{name}_n"))
    candidates = pairs.join(side("l").hint("merge"), "l_id").join(side("r").hint("merge"), "r_id")
    shared = F.size(F.array_intersect(F.split("l_doc", " "), F.split("r_doc", " ")))
    found = candidates.select("l_doc", "r_doc", away(shared).alias("distance")).filter(F.col("distance") < max_distance)
    if short:
        common = F.array_intersect("l_bag", "r_bag")
        close = (F.try_element_at(common, F.lit(1)) == F.col("word")) & (away(F.size(common)) < max_distance)
        brief = met(F.col("l_n") <= short, F.col("r_n") <= short, close).select("l_doc", "r_doc", away(F.size(common)).alias("distance"))
        found = found.unionByName(brief)
    return both_ways(found, ["doc"]).select("l_doc", "r_doc", "distance")


def question_document(text: str) -> Column:
    """Bag of the meaningful words of a question, or its normalised text where it has none."""
    bag = cache_document(text)
    return F.when(bag != "", bag).otherwise(normalize_text(text))


def answered(cache: DataFrame) -> DataFrame:
    """Entries with an answer text or, where there is a column ``response_json``, with a stored response."""
    has_answer = F.coalesce(F.trim("answer_text"), F.lit("")) != ""
    if "response_json" in cache.columns:
        response = F.to_json(F.try_parse_json("response_json"))
        has_answer = has_answer | F.coalesce(~response.isin("null", "false", "0", '""'), F.lit(False))
    return cache.filter(has_answer)


def exact_hits(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached entry with the same document (word bag, else text); the smallest id when several match.

    ``questions`` is (``question_id``, ``text``), ``cache`` is (``id``, ``question_text``, ``answer_text``) and
    may have ``response_json``.
    """
    entries = (
        answered(cache)
        .select("id", question_document("question_text").alias("document"))
        .filter("document != ''")
        .groupBy("document")
        .agg(F.min("id").alias("cached_id"))
    )
    asked = questions.select("question_id", question_document("text").alias("document"))
    return asked.join(entries, "document").select("question_id", "cached_id")


def near_hits(questions: DataFrame, cache: DataFrame, max_distance: float = MAX_CACHE_DISTANCE) -> DataFrame:
    """Nearest cached entry within the distance, of equals the smallest id, if its question is compatible.

    An entry with the same document is at distance 0 and compatible, so only the questions without
    one are compared by words; those must be very similar as texts too. Farther entries don't step in
    for a nearest one that is not compatible.
    """
    asked = written(questions.select("question_id", "text", question_document("text").alias("l_doc")), "asked")
    # One entry per document and text; equal texts behave equally.
    entries = (
        answered(cache)
        .select("id", "question_text", question_document("question_text").alias("r_doc"))
        .groupBy("r_doc", "question_text")
        .agg(F.min("id").alias("cached_id"))
    )
    entries = written(entries, "entries")
    # Texts take little room on disk and much in memory, so none of these tables is broadcast by its written size.
    same = entries.filter("r_doc != ''").groupBy(F.col("r_doc").alias("l_doc")).agg(F.min("cached_id").alias("cached_id")).hint("merge")
    direct = asked.join(same, "l_doc").select("question_id", "cached_id", F.lit(0.0).alias("distance"))
    texts = written(asked.join(same, "l_doc", "left_anti").select("l_doc", "text").distinct(), "texts")
    docs = similar_documents(
        texts.select(F.col("l_doc").alias("document")), entries.select(F.col("r_doc").alias("document")), max_distance
    )
    nearest = (
        docs.join(entries.hint("merge"), "r_doc")
        .groupBy("l_doc")
        .agg(F.min(F.struct("distance", "cached_id", "r_doc", "question_text")).alias("b"))
        .select("l_doc", "b.*")
    )
    pairs = pair_similarity(texts.join(nearest.hint("merge"), "l_doc"), "text", "question_text", "similarity")
    best = pairs.filter(compatible(F.col("similarity"), "text", "question_text", "l_doc", "r_doc"))
    fuzzy = asked.join(best.hint("merge"), ["l_doc", "text"]).select("question_id", "cached_id", "distance")
    return direct.unionByName(fuzzy)
