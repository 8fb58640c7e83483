"""Language identification: a character model per language, smoothed after Kneser and Ney with interpolation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketlake.llm.common import named, shared, with_computed

UNDETERMINED = "und"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` code points that end at each place (those before the first count as 0)."""
    total, power = np.zeros(len(codes), dtype=np.uint64), np.ones(1, dtype=np.uint64)
    for back in range(order):
        total[back:] += (codes[: len(codes) - back] + np.uint64(1)) * power
        power = power * FACTOR
    return (total ^ (total >> np.uint64(29))) * FACTOR + np.uint64(order)


def string_hashes(grams: pd.Series, order: int) -> np.ndarray:
    """The same hash for strings of one length."""
    if not len(grams):
        return np.empty(0, np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return gram_hashes(codes, order)[order - 1 :: order]


@dataclass
class Table:
    """Sorted hashes with a row of numbers for each, one column per language."""

    hashes: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, rows: np.ndarray) -> Table:
        order = np.argsort(hashes, kind="stable")
        return cls(hashes[order], rows[order].astype(np.float32))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


class CharacterModels:
    """log p of a character after up to ``order`` - 1 others of its word; a word stands between two spaces.

    For each order there is one table of the sequences that any language has seen, with the logarithm of the
    interpolated probability in every language, and one of contexts with the weight of the lower order. A
    character takes the row of its longest known sequence and the weights of the contexts tried before.
    """

    def __init__(self, counts: pd.DataFrame, order: int):
        self.order = order
        self.languages = sorted(counts["lang"].unique())
        self.grams: list[Table] = []
        self.contexts: list[Table] = []
        n_langs = len(self.languages)
        letters = 1 + len(set().union(*map(set, counts["gram"])) if len(counts) else ())
        by_lang = [counts[counts["lang"] == x].set_index("gram")["n"].astype(float) for x in self.languages]
        levels: list[list[pd.Series]] = [[] for _ in range(order + 1)]
        for seen in by_lang:
            sizes, above = seen.index.str.len(), None
            for n in range(order, 0, -1):
                # sequences from the start of a word can't be longer: they keep their counts; others count
                # how many different characters stand before them
                level = seen[sizes == n]
                if above is not None:
                    before = pd.Series(1.0, index=above.index.str[1:]).groupby(level=0).sum()
                    level = level.add(before, fill_value=0.0)
                levels[n].append(level)
                above = level
        lower_index = pd.Index([""])
        lower = np.full((1, n_langs), 1.0 / letters)
        self.unseen = np.log(lower[0])
        for n in range(1, order + 1):
            union = pd.Index(sorted(set().union(*[x.index for x in levels[n]])))
            contexts = pd.Index(sorted(set(union.str[:-1])))
            probability, weight = np.empty((len(union), n_langs)), np.ones((len(contexts), n_langs))
            suffix = lower_index.get_indexer(union.str[1:] if n > 1 else pd.Index([""] * len(union)))
            for i, level in enumerate(levels[n]):
                ones, twos = (level == 1).sum(), (level == 2).sum()
                discount = ones / (ones + 2 * twos) if ones else 0.5
                grouped = level.groupby(level.index.str[:-1])
                total = grouped.sum().reindex(contexts).fillna(0.0).to_numpy()
                kinds = grouped.size().reindex(contexts).fillna(0.0).to_numpy()
                weight[:, i] = np.where(total > 0, discount * kinds / np.maximum(total, 1e-300), 1.0)
                of = contexts.get_indexer(union.str[:-1])
                count = level.reindex(union).fillna(0.0).to_numpy()
                own = np.where(total[of] > 0, np.maximum(count - discount, 0) / np.maximum(total[of], 1e-300), 0.0)
                probability[:, i] = own + weight[of, i] * lower[suffix, i]
            self.grams.append(Table.of(string_hashes(union, n), np.log(probability)))
            hashes = string_hashes(contexts, n - 1) if n > 1 else np.zeros(len(contexts), np.uint64)
            self.contexts.append(Table.of(hashes, np.log(weight)))
            lower_index, lower = union, probability

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word the sum of log p in each language, and the number of characters predicted."""
        line = " " + "  ".join(words) + " "
        codes = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        begins = np.cumsum(sizes) - sizes
        offset = np.arange(len(codes)) - np.repeat(begins, sizes)
        logs = np.zeros((len(codes), len(self.languages)), dtype=np.float32)
        open_ = np.flatnonzero(offset > 0)
        for n in range(self.order, 0, -1):
            ready = offset[open_] + 1 >= n if n > 1 else np.ones(len(open_), bool)
            now = open_[ready]
            at = self.grams[n - 1].find(gram_hashes(codes, n)[now])
            hit = at >= 0
            logs[now[hit]] += self.grams[n - 1].rows[at[hit]]
            missed = now[~hit]
            if n > 1:
                # the context ends one place earlier
                at = self.contexts[n - 1].find(gram_hashes(codes, n - 1)[missed - 1])
            else:
                at = np.zeros(len(missed), dtype=np.int64)
            known = at >= 0
            logs[missed[known]] += self.contexts[n - 1].rows[at[known]]
            if n == 1:
                logs[missed] += self.unseen.astype(np.float32)
            open_ = np.concatenate([open_[~ready], missed])
        return np.add.reduceat(logs, begins, axis=0), sizes - 1


def letter_words(texts: pa.Array) -> pa.Array:
    """Runs of letters in small letters, as lists."""
    return pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), pattern=r"[^\pL]+", replacement=" "))


def row_slices(column: pa.Array, size: int = 1 << 19):
    """Slices of about ``size`` bytes; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + size)))
        yield column.slice(first, last - first)
        first = last


def cross_entropies(models: CharacterModels, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the sum of -log p in each language, the same with each word in its best language, and the number
    of characters; each distinct word is scored once."""
    sums, mixed, chars = [], [], []
    for part in row_slices(texts):
        lists = letter_words(pc.fill_null(part, ""))
        coded = lists.flatten().dictionary_encode()
        words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        real = np.array([bool(w) for w in words], dtype=bool)
        per_doc = np.diff(lists.offsets.to_numpy())
        total = np.zeros((len(part), len(models.languages)))
        least = np.zeros(len(part))
        n = np.zeros(len(part), dtype=np.int64)
        if real.any() and models.languages:
            logs, sizes = np.zeros((len(words), len(models.languages))), np.zeros(len(words), dtype=np.int64)
            logs[real], sizes[real] = models.score([w for w in words if w])
            some = per_doc > 0
            first = (np.cumsum(per_doc) - per_doc)[some]
            for i in range(len(models.languages)):
                total[some, i] = -np.add.reduceat(logs[place, i], first)
            least[some] = -np.add.reduceat(logs.max(axis=1)[place], first)
            n[some] = np.add.reduceat(sizes[place], first)
        sums.append(total)
        mixed.append(least)
        chars.append(n)
    if not sums:
        return np.zeros((0, len(models.languages))), np.zeros(0), np.zeros(0, dtype=np.int64)
    return np.concatenate(sums), np.concatenate(mixed), np.concatenate(chars)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, per_language: int, doc_id: str, text: str, lang: str) -> DataFrame:
    """(text, lang, fold) of at most ``per_language`` labelled documents of each language, outside the held-out third.

    Which ones is settled by a hash of the id. The list of ids that goes to all tasks has at most
    ``per_language`` rows for each value of lang.
    """
    labelled = docs.where(named(lang).isNotNull() & named(text).isNotNull() & ~held_out(named(doc_id)))
    labelled = labelled.select(named(doc_id).alias("i"), named(text).alias("text"), named(lang).alias("lang"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("i"), "i")
    ids = labelled.select("i", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    ids = ids.groupBy(F.col("i").alias("j"), F.col("lang").alias("l")).agg(F.lit(1).alias("one")).drop("one")
    same = F.col("i").eqNullSafe(F.col("j")) & (F.col("lang") == F.col("l"))
    rows = labelled.join(F.broadcast(ids), same, "left_semi")
    rows = rows.groupBy("i", "lang").agg(F.min("text").alias("text"))
    return rows.select("text", "lang", F.pmod(F.xxhash64("i", F.lit("fold")), F.lit(5)).alias("fold"))


def gram_counts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): the sequences of ``order`` characters, shorter at the start of a word, counted over words."""
    words = F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), " ")
    words = sample.select("lang", F.explode(words).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    line = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    ends = F.sequence(F.lit(2), F.length("word") + 2)
    grams = F.transform(
        ends, lambda e: F.substr(line, F.greatest(e - (order - 1), F.lit(1)), F.least(e, F.lit(order)))
    )
    grams = words.select("lang", "count", F.explode(grams).alias("gram"))
    return grams.groupBy("lang", "gram").agg(F.sum("count").alias("n"))


@dataclass
class LanguageModel:
    """Character models with, per language, the mean cross-entropy of known texts, each word in its best language,
    and what they stay within above it: ``slack`` a character at any length, ``spread`` by the root of the length."""

    models: CharacterModels
    mean: np.ndarray
    spread: np.ndarray
    slack: np.ndarray


def usual_most(values: pd.Series) -> float:
    """One and a half times what 98 in 100 values stay within, the largest never counting; 0 for fewer than two."""
    return 1.5 * max(float(np.quantile(values, 0.98, method="lower")), 0.0) if len(values) > 1 else 0.0


def train(
    docs: DataFrame,
    per_language: int = 300,
    order: int = 5,
    slack: float = 0.5,
    fewest: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> LanguageModel:
    """Learn from at most ``per_language`` documents of each language: four fifths for the character models, the
    rest to set the limits of rejection. The driver receives counts of sequences of that sample only.

    A language with fewer than ``fewest`` texts in the rest takes the limits of all languages together; ``slack``
    is the least that a language has.
    """
    sample = training_sample(docs, per_language, doc_id, text, lang)
    counts = gram_counts(sample.where("fold <> 0"), order).toPandas()
    models = CharacterModels(counts, order)
    n = len(models.languages)
    mean, spread, slacks = np.full(n, math.inf), np.zeros(n), np.full(n, float(slack))
    if n:
        found = entropies(sample.where("fold = 0").select("text"), models, "text").toPandas()
        found = found[found["chars"] > 0]
        if len(found):
            for i in range(n):
                own = found[found["best"] == i]
                mean[i] = np.average(own["entropy"], weights=own["chars"]) if len(own) else found["entropy"].mean()
            found["above"] = found["entropy"] - mean[found["best"]]
            found["scaled"] = found["above"] * np.sqrt(found["chars"])
            for i in range(n):
                own = found[found["best"] == i]
                own = own if len(own) >= fewest else found
                spread[i] = usual_most(own["scaled"])
                slacks[i] = max(slack, usual_most(own[own["chars"] >= own["chars"].median()]["above"]))
    return LanguageModel(models, mean, spread, slacks)


def entropies(docs: DataFrame, models: CharacterModels, text: str) -> DataFrame:
    sent = shared(docs.sparkSession, models)

    def start():
        own = sent()

        def step(texts):
            sums, mixed, chars = cross_entropies(own, texts)
            best = sums.argmin(axis=1) if sums.shape[1] else np.zeros(len(chars), dtype=np.int64)
            entropy = mixed / np.maximum(chars, 1)
            return [pa.array(best, pa.int32()), pa.array(entropy, pa.float64()), pa.array(chars, pa.int64())]

        return step

    fields = [
        T.StructField("best", T.IntegerType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("chars", T.LongType()),
    ]
    return with_computed(docs, [text], fields, start, [])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score, entropy and rejected.

    lang_pred is the language of the lowest cross-entropy per character (of equals the first in order), "und"
    for a text that is null or has no letter, or if nothing was learned; score is that language's share of
    the likelihoods per character, weighted up to 40 characters (0 for "und"). rejected tells texts that are
    unlike all learned languages: "und", or a cross-entropy with each word in its own best language (so that
    texts of several known languages stay) above the mean of lang_pred by more than that language's slack and
    by more than its spread of known texts, which shrinks with the root of the length. Whole texts count.
    Repeated rows repeat; input columns with the names of new ones are replaced.
    """
    sent = shared(docs.sparkSession, model)

    def start():
        m = sent()
        names = np.array([*m.models.languages, UNDETERMINED], dtype=object)

        def step(texts):
            sums, mixed, chars = cross_entropies(m.models, texts)
            known = (chars > 0) & (sums.shape[1] > 0)
            n = np.maximum(chars, 1)
            if sums.shape[1]:
                means = sums / n[:, None]
                best = means.argmin(axis=1)
                lowest = means[np.arange(len(best)), best]
                odds = np.exp(-(means - lowest[:, None]) * np.minimum(n, 40)[:, None])
                score = np.where(known, 1 / odds.sum(axis=1), 0.0)
                limit = m.mean[best] + np.maximum(m.slack[best], m.spread[best] / np.sqrt(n))
            else:
                best, lowest, score, limit = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
            label = names[np.where(known, best, len(names) - 1)]
            return [
                pa.array(label, pa.string()),
                pa.array(score, pa.float64()),
                pa.array(lowest, pa.float64()),
                pa.array(~known | (mixed / n > limit), pa.bool_()),
            ]

        return step

    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    return with_computed(docs, [text], fields, start, keep)
