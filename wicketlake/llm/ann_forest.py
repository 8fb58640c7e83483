"""Approximate nearest neighbours by inner product: a forest of random-projection trees, exact in the end."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wicketlake.llm.common import checkpointed, in_blocks, named, shared


def usable(vector: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(
        F.forall(vector, finite) & F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False)
    )


@dataclass
class Tree:
    """Inner nodes as rows: direction, threshold, children; a negative child is leaf -1 - child."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    leaves: int


def grow(sample: np.ndarray, leaf: int, seed: int) -> Tree:
    """Split at the median of a random projection until at most ``leaf`` sample rows are left."""
    random = np.random.default_rng(seed)
    directions, thresholds, children, leaves = [], [], [], 0
    work = [(np.arange(len(sample)), -1, 0)]
    while work:
        rows, parent, side = work.pop()
        here = None
        if len(rows) > leaf:
            a, b = sample[random.choice(rows, 2, replace=False)]
            direction = a - b if (a != b).any() else random.normal(size=sample.shape[1])
            direction = direction / max(np.linalg.norm(direction), 1e-300)
            along = sample[rows] @ direction
            middle = np.median(along)
            left = along <= middle
            if not left.all():
                here = len(directions)
                directions.append(direction)
                thresholds.append(middle)
                children.append([0, 0])
                work += [(rows[left], here, 0), (rows[~left], here, 1)]
        if here is None:
            here = -1 - leaves
            leaves += 1
        if parent >= 0:
            children[parent][side] = here
    dim = sample.shape[1]
    return Tree(np.array(directions).reshape(-1, dim), np.array(thresholds), np.array(children).reshape(-1, 2), leaves)


def leaf_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    node = np.zeros(len(vectors), dtype=np.int64)
    if not len(tree.directions):
        return node
    going = np.arange(len(vectors))
    while len(going):
        at = node[going]
        right = np.einsum("ij,ij->i", vectors[going], tree.directions[at]) > tree.thresholds[at]
        node[going] = tree.children[at, right.astype(int)]
        going = going[node[going] >= 0]
    return -1 - node


def visited_leaves(forest: list[Tree], along: list[np.ndarray], visits: int) -> list[tuple[int, int]]:
    """The leaves of all trees in order of the smallest margin on their way, from one queue; ``visits`` of them."""
    queue = [(-np.inf, t, 0 if len(tree.directions) else -1) for t, tree in enumerate(forest)]
    found = []
    while queue and len(found) < visits:
        worst, t, node = heapq.heappop(queue)
        while node >= 0:
            margin = along[t][node] - forest[t].thresholds[node]
            near = int(margin > 0)
            heapq.heappush(queue, (max(worst, abs(margin)), t, int(forest[t].children[node, 1 - near])))
            node = int(forest[t].children[node, near])
        found.append((t, -1 - node))
    return found


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    trees: int = 8,
    leaf: int = 64,
    visits: int = 96,
    sample_rows: int = 4096,
    block: int = 4096,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, its ``k`` nearest by inner product.

    The forest is fitted on at most ``sample_rows`` vectors, drawn by a hash of the id; every vector is
    indexed in every tree. Inner products become nearness of directions by one more component that gives all
    vectors of the sample the same length (none can be longer there; longer ones outside get 0). A query
    visits ``visits`` leaves of all trees through one queue, and all vectors of those leaves are compared with
    it exactly, in double precision. Equal vectors are indexed once and meet queries as one; ties go to the
    smaller id. Leaves and their queries are dealt out to blocks of ``block`` rows.

    Null vectors, zero vectors and those with null or non-finite components take no part, nor do rows
    without an id; of rows that share an id the one of the smallest vector counts. Fewer than k candidates give all found; an empty table gives no rows.
    All vectors have one length.
    """
    rows = vectors.select(named(vec_id).alias("vec_id"), named(embedding).cast("array<double>").alias("v"), queries.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("vec_id").agg(F.min_by(F.struct("v", "asks"), "v").alias("r")).select("vec_id", "r.v", "r.asks")
    rows = checkpointed(rows.withColumn("same", F.xxhash64("v")))
    # k + 1 ids of each group of equal vectors are as many as any query can need
    first = W.partitionBy("same", "v").orderBy("vec_id")
    ids = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = checkpointed(ids.groupBy("same", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cls"), "v", "ids"))
    sample = [r["v"] for r in classes.orderBy(F.xxhash64("cls"), "cls").limit(sample_rows).select("v").collect()]
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array(sample, dtype=np.float64)
    longest = float(np.max((sample**2).sum(axis=1)))

    def lifted(v: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(longest - (v**2).sum(axis=1), 0))
        return np.column_stack([v, rest])

    grown = [grow(lifted(sample, False), leaf, seed) for seed in range(trees)]
    sent = shared(vectors.sparkSession, grown)

    def index(batches):
        forest = sent()
        for pdf in batches:
            v = lifted(np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1), False) if len(pdf) else None
            for t, tree in enumerate(forest if len(pdf) else []):
                yield pd.DataFrame({"tree": t, "leaf": leaf_of(tree, v), "cls": pdf["cls"], "ids": pdf["ids"], "v": pdf["v"]})

    def ask(batches):
        forest = sent()
        for pdf in batches:
            if not len(pdf):
                continue
            v = lifted(np.array(pdf["q"].tolist(), dtype=np.float64).reshape(len(pdf), -1), True)
            along = [v @ tree.directions.T for tree in forest]
            out = []
            for i in range(len(pdf)):
                out += [(i, t, n) for t, n in visited_leaves(forest, [a[i] for a in along], visits)]
            at, tree, node = np.array(out, dtype=np.int64).T
            yield pd.DataFrame({"tree": tree, "leaf": node, "query_id": pdf["query_id"].to_numpy()[at], "q": pdf["q"].to_numpy()[at]})

    points = classes.mapInPandas(index, "tree int, leaf long, cls long, ids array<long>, v array<double>")
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = asked.mapInPandas(ask, "tree int, leaf long, query_id long, q array<double>")
    points, asked, by = in_blocks(points, asked, ["tree", "leaf"], block, "cls", "query_id")

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            p = np.array(left["v"].tolist())
            for i in range(0, len(right), 256):
                q = np.array(right["q"].iloc[i : i + 256].tolist())
                near = q @ p.T
                some = min(k + 1, near.shape[1])
                edge = np.partition(near, near.shape[1] - some, axis=1)[:, near.shape[1] - some]
                a, b = np.nonzero(near >= edge[:, None] - 1e-9 * np.maximum(1, np.abs(edge[:, None])))
                exact = (q[a] * p[b]).sum(axis=1)
                out.append(pd.DataFrame({"query_id": right["query_id"].to_numpy()[i + a], "cls": left["cls"].to_numpy()[b], "ids": left["ids"].to_numpy()[b], "score": exact}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "cls": [], "ids": [], "score": []})

    found = points.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(rerank, "query_id long, cls long, ids array<long>, score double")
    found = found.groupBy("query_id", "cls").agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    # a class counts once for a query; the smallest id of a class orders classes of equal score well enough to cut
    cut = W.partitionBy("query_id").orderBy(F.desc("score"), "cls")
    found = found.withColumn("n", F.row_number().over(cut)).where(F.col("n") <= k + 1)
    found = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
