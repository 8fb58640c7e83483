"""Nearest vectors by pivots, and similar word bags, against plain definitions."""

import itertools
import math
import random

import numpy as np
import pytest

from wicketlake.operators import vectors as ve


def plain_nearest(q, c, ids, k, metric):
    if metric == "cosine":
        unit = lambda v: v / np.where(np.linalg.norm(v, axis=1) > 0, np.linalg.norm(v, axis=1), 1)[:, None]
        d = np.round(1 - unit(q) @ unit(c).T, 6)
    else:
        d = np.round(np.sqrt(((q[:, None, :] - c[None]) ** 2).sum(2)), 6)
    return [sorted(zip(row, ids))[:k] for row in d.tolist()]


def clustered(n, centers, seed):
    random_ = np.random.default_rng(seed)
    middle = np.random.default_rng(1).normal(size=(centers, 16)) * 4
    return middle[random_.integers(0, centers, size=n)] + random_.normal(size=(n, 16)) * 0.2


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("pivots,block", [(1, 20_000), (40, 20_000), (40, 7)])
def test_nearest_are_exact(spark, metric, pivots, block):
    c, q = clustered(500, 30, 2), clustered(12, 30, 3)
    c[:5], c[10:60], q[0] = 0.0, c[10], 0.0
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate(c.tolist())], "id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(q.tolist())], "query_id string, vector array<double>")
    got = {}
    for r in ve.knn(queries, corpus, 20, metric, pivots, block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    for i, want in enumerate(plain_nearest(q, c, range(500), 20, metric)):
        assert [(d, n) for _, d, n in sorted(got[f"q{i}"])] == want


def test_few_vectors_and_none(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    queries = spark.createDataFrame([(9, [1.0, 0.1])], "query_id int, vector array<float>")
    assert [(r["id"], r["rank"]) for r in sorted(ve.knn(queries, corpus, 5).collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert ve.knn(queries, corpus.where("false"), 5).collect() == [] and ve.knn(queries.where("false"), corpus, 5).collect() == []


def test_few_parts_are_visited(spark):
    """On clustered vectors a query visits fewer than a tenth of the parts."""
    c, q = clustered(6000, 100, 4), clustered(50, 100, 5)
    space = ve.Pivots(c[:100], "l2")
    part, reach = space.home(c)
    parts = {p: (int((part == p).sum()), reach[part == p].min(), reach[part == p].max()) for p in set(part.tolist())}
    kth = [row[-1][0] for row in plain_nearest(q, c, range(6000), 10, "l2")]
    queries = spark.createDataFrame([(i, v, float(b)) for i, (v, b) in enumerate(zip(q.tolist(), kth))], "query_id int, vector array<double>, bound double")
    first = ve._visits(queries, space, parts, 10, False).count()
    assert first + ve._visits(queries, space, parts, 10, True).count() < 0.1 * len(parts) * len(q)


@pytest.mark.parametrize("distance", [0.05, 0.2, 0.5])
def test_similar_bags(spark, distance):
    random.seed(4)
    words = [f"w{i}" for i in range(30)] + ["common"] * 20
    bags = list({" ".join(sorted(set(random.choices(words, k=random.randint(1, 9))))) for _ in range(160)})
    frame = spark.createDataFrame([(b,) for b in [*bags, "", bags[0]]], "document string")
    far = lambda a, b: round(1 - len({*a.split()} & {*b.split()}) / math.sqrt(len({*a.split()}) * len({*b.split()})), 6)
    want = {(a, b, far(a, b)) for a, b in itertools.product(bags, bags) if far(a, b) < distance}
    assert {tuple(r) for r in ve.similar_documents(frame, frame, distance).collect()} == want


def test_near_hits_beyond_equal_bags(spark):
    cache = spark.createDataFrame([("a", "who has the most runs for india in tests today", "x"), ("b", "unrelated words entirely", "y")], "id string, question_text string, answer_text string")
    asked = spark.createDataFrame([(1, "who has the most runs for india in tests todayy"), (2, "who has the most wickets in ireland ever")], "question_id int, text string")
    got = [(r["question_id"], r["cached_id"], r["distance"] > 0) for r in ve.near_hits(asked, cache, 0.4).collect()]
    assert got == [(1, "a", True)]
