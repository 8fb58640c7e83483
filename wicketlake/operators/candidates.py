"""Pairs of short texts that may be alike, found by equality joins on what alike texts must share.

All texts are normalised: lower-case letters and digits in words between single blanks.

- Two words that differ by few edits share a string that at most as many deletions leave of each.
- A text inside another has each of its letter sequences there, the rarest one too.
- Where a share of a text's words must have a like word, one of any large enough choice of them has one;
  the choice made is of the words with the fewest like words in the other table.

A word or sequence that many rows hold is chosen only where a text has nothing rarer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketlake.functions import similarity as sim
from wicketlake.session import written

#: Deletions are made in the first letters of a word; later ones need not agree for a candidate.
PREFIX = 10
GRAM = 3
#: Texts are cut into pieces of so many letters before runs are cut from them.
PIECE = 64


def without_one(text: Column) -> Column:
    """All strings that one deletion leaves of a text of at least one letter."""
    places = F.sequence(F.lit(1), F.length(text))
    return F.transform(places, lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))


def deletion_keys(word: Column) -> Column:
    """The word's first letters and what is left of them after the deletions that its length allows: none up
    to two letters, one for three letters, else two."""
    head = F.substring(word, 1, PREFIX)
    once = F.when(F.length(word) >= 3, without_one(head)).otherwise(F.array().cast("array<string>"))
    twice = F.when(F.length(word) >= 4, F.flatten(F.transform(once, without_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(head), once, twice))


def near_word(left: str, right: str) -> Column:
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(sim.near_word_scores(a.tolist(), b.tolist()))

    return score(left, right)


def like_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(word, other) of two vocabularies (column word), equal or so near that they score as a typing error."""
    keys = lambda df, name: df.select("word", F.explode(deletion_keys(F.col("word"))).alias("key")).toDF(name, "key")
    sized = F.abs(F.length("word") - F.length("other")) <= 2
    pairs = keys(left, "word").join(keys(right, "other"), "key").where(sized).select("word", "other").distinct()
    pairs = pairs.where(F.levenshtein("word", "other", 4) >= 0)  # two swaps are four plain edits
    return pairs.where(near_word("word", "other") > 0)


def words_of(texts: DataFrame, text: str) -> DataFrame:
    return texts.select(text, F.posexplode(F.split(text, " ")).alias("place", "word")).where("word != ''")


def sharing_words(queries: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(q, a) that holds every pair in which at least the share ``least`` of q's words has a like word in a."""
    asked, held = words_of(queries, "q"), words_of(names, "a").select("a", "word").distinct()
    often = held.groupBy("word").agg(F.count("*").alias("n"))
    like = written(like_words(asked.select("word").distinct(), often.select("word")), "like-words")
    weight = like.join(often.withColumnRenamed("word", "other"), "other").groupBy("word").agg(F.sum("n").alias("weight"))
    of_query = Window.partitionBy("q")
    weighed = asked.join(weight, "word", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    weighed = weighed.withColumn("of", F.count("*").over(of_query))
    weighed = weighed.withColumn("n", F.row_number().over(of_query.orderBy("weight", "place")))
    chosen = weighed.where(F.col("n") <= F.col("of") - F.ceil(F.col("of") * least - 1e-9) + 1)
    chosen = chosen.select("q", "word").distinct()
    pairs = chosen.join(like, "word").select("q", F.col("other").alias("word")).join(held, "word")
    return pairs.select("q", "a").distinct()


def sharing_initial_and_last(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(q, a) of texts of at least two words with the same last word and the same first letter."""

    def keyed(df: DataFrame, text: str) -> DataFrame:
        words = F.split(text, " ")
        parts = [F.substring(text, 1, 1).alias("initial"), F.element_at(words, -1).alias("last")]
        return df.where(F.size(words) >= 2).select(text, *parts)

    return keyed(queries, "q").join(keyed(names, "a"), ["initial", "last"]).select("q", "a")


def letter_runs(df: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """(key, run): the runs of ``sizes`` letters of the texts, one row for each place.

    Texts are cut into pieces that overlap by less than a run, and runs are cut from these, so that a run costs the
    same in a text of any length.
    """
    piece = rf"(?s)(?=(.{{1,{PIECE + max(sizes) - 1}}})).{{1,{PIECE}}}"
    cut = df.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(text, F.lit(piece), F.lit(1))).alias("piece"))
    cut = cut.select("key", "piece", F.explode(F.array(*map(F.lit, sizes))).alias("size")) if len(sizes) > 1 else cut.withColumn("size", F.lit(sizes[0]))
    places = F.sequence(F.lit(1), F.least(F.length("piece") - F.col("size") + 1, F.lit(PIECE)))
    cut = cut.where(F.length("piece") >= F.col("size")).select("key", "piece", "size", F.explode(places).alias("at"))
    return cut.select("key", F.substr("piece", F.col("at"), F.col("size")).alias("run"))


def containment(inner: DataFrame, outer: DataFrame, text: str = "text", key: str = "text") -> DataFrame:
    """(inner, key) that holds every pair of an ``inner`` (column inner, not empty) that stands inside a text; a pair
    may come more than once.

    A text shorter than a run is a run itself, so runs of all sizes up to ``GRAM`` count; each inner text
    meets the texts that hold its rarest run, and none if it has a run that no text holds. Of the texts' runs only
    those of some inner text are counted and, after the choice, only those chosen are kept, so that no index of all
    runs is made; a table of few runs is broadcast by its written size and the runs of the texts stay where they are.
    ``outer`` is read twice, so give a written one.
    """
    long = letter_runs(inner.where(F.length("inner") >= GRAM), "inner", "inner", [GRAM]).withColumnRenamed("key", "inner")
    brief = inner.where(F.length("inner") < GRAM).select("inner", F.col("inner").alias("run"))
    parts = written(long.unionByName(brief).distinct(), "runs")

    def held(chosen: DataFrame, *columns: str) -> DataFrame:
        whole = letter_runs(outer, key, text, [GRAM]).join(chosen.where(F.length("run") >= GRAM), "run")
        # without an inner text so short this part is empty, and its side of the texts is not read
        short = letter_runs(outer, key, text, list(range(1, GRAM))).join(chosen.where(F.length("run") < GRAM), "run")
        return whole.select(*columns).unionByName(short.select(*columns))

    often = held(parts.select("run").distinct(), "run").groupBy("run").agg(F.count("*").alias("n"))
    counted = parts.join(often, "run", "left")
    rare = counted.groupBy("inner").agg(F.min_by("run", "n").alias("run"), F.count_if(F.col("n").isNull()).alias("lacking"))
    return held(written(rare.where("lacking = 0").select("inner", "run"), "rare-runs"), "inner", "key")


def edit_pairs(queries: DataFrame, names: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """(q, a) whose edit distance leaves at least the share ``least`` of the longer text.

    No part of two such texts need agree where ``least`` is low, so every block of the query set meets every
    block of the names; lengths and the letters in common rule out most pairs before any is aligned. Both
    tables are read twice, so give written ones.
    """
    parts = lambda df: max(1, -(-df.count() // block))
    qs, ns = parts(queries), parts(names)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("x", F.pmod(F.xxhash64("q"), F.lit(qs)).cast("int")).withColumn("y", every(ns))
    right = names.withColumn("y", F.pmod(F.xxhash64("a"), F.lit(ns)).cast("int")).withColumn("x", every(qs))

    def meet(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        i, j = sim.edit_pairs(mine["q"].tolist(), other["a"].tolist(), least)
        return pd.DataFrame({"q": mine["q"].to_numpy(object)[i], "a": other["a"].to_numpy(object)[j]})

    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(meet, "q string, a string")


def alike(queries: DataFrame, names: DataFrame, least: float, edits: bool = True) -> DataFrame:
    """Distinct (q, a) that hold every pair of a query (column q) and a name (column a) similar by ``least``:
    by words, as a whole with a typing error, by initial and last word, by one inside the other and, if ``edits``,
    by the edit distance of the whole alone."""
    pairs = sharing_words(queries, names, least)
    pairs = pairs.unionByName(like_words(queries.toDF("word"), names.toDF("word")).toDF("q", "a"))
    if least <= sim.INITIAL_AND_LAST:
        pairs = pairs.unionByName(sharing_initial_and_last(queries, names))
    if least <= sim.SUBSTRING:
        inside = containment(queries.withColumnRenamed("q", "inner"), names, "a", "a").toDF("q", "a")
        around = containment(names.withColumnRenamed("a", "inner"), queries, "q", "q").toDF("a", "q")
        pairs = pairs.unionByName(inside).unionByName(around.select("q", "a"))
    if edits:
        pairs = pairs.unionByName(edit_pairs(queries, names, least))
    return pairs.distinct()
