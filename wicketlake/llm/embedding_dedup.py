"""Near-duplicate embeddings: parts around pivots, of which those meet that may hold a near pair, in tiles of a product."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.ann_forest import usable
from wicketlake.llm.common import bounded_batches, checkpointed, give_back, named, shared
from wicketlake.llm.components import connected_components
from wicketlake.llm.simhash import forest_of

#: Parts that the vectors are dealt out to at least, so that tasks share the work.
LEAST_PARTS = 8
#: Vectors in a side of a tile.
TILE = 1024


def unit_rows(column: pd.Series) -> np.ndarray:
    """Vectors of length 1; divided by the largest component first, so that no square overflows."""
    v = np.array(column.tolist(), dtype=np.float64)
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def gaps(units: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances from a few points; those of a vector are the same to the bit in any batch."""
    return np.stack([np.sqrt(((units - p) ** 2).sum(axis=1)) for p in points], axis=1)


def homes(units: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part of each vector, which is its nearest pivot's, its distance from there, and those from all pivots."""
    d = gaps(units, pivots)
    part = d.argmin(axis=1)
    return part, d[np.arange(len(d)), part], d


def may_reach(part: np.ndarray, d: np.ndarray, between: np.ndarray, rings: np.ndarray, radius: float) -> np.ndarray:
    """For each vector and part: may the part hold a vector within ``radius``? It does not if its border with the
    vector's own part, or the ring around its pivot in which all its vectors lie, is farther. Yes for the own part."""
    own = d[np.arange(len(d)), part]
    wide = between[part]
    border = np.divide(d**2 - own[:, None] ** 2, 2 * wide, out=np.zeros_like(d), where=wide > 0)
    least = np.maximum.reduce([border, d - rings[:, 1], rings[:, 0] - d])
    return least <= radius + 1e-6


def leaves_of(units: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(rows, centre, radius) of groups of at most ``size`` vectors that lie together: halved along the line between
    two far ones."""
    work, found = [np.arange(len(units))] if len(units) else [], []
    while work:
        rows = work.pop()
        part = units[rows]
        if len(rows) <= size:
            centre = part.mean(axis=0)
            found.append((rows, centre, float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))))
            continue
        one = part[((part - part[0]) ** 2).sum(axis=1).argmax()]
        other = part[((part - one) ** 2).sum(axis=1).argmax()]
        order = np.argpartition(part @ (other - one), len(rows) // 2)
        work += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return found


def near_pairs(units: np.ndarray, side: np.ndarray, threshold: float):
    """Row pairs (x, y) of unit vectors of cosine >= ``threshold``, each once: of one side and the other, or of all
    rows if there is one side only. A tile of rows that lie together meets those that its centre and radius allow,
    in a product of single precision; what that leaves open is decided in double precision."""
    single, radius = units.astype(np.float32), np.sqrt(max(0.0, 2 - 2 * threshold))
    # what a product of single precision may be off by
    slack = max(1e-5, units.shape[1] * 1.2e-7)
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    alone = not len(second)
    left = [(first[rows], *rest) for rows, *rest in leaves_of(single[first], TILE)]
    right = left if alone else [(second[rows], *rest) for rows, *rest in leaves_of(single[second], TILE)]
    if not left or not right:
        return
    centres, radii = np.stack([c for _, c, _ in right]).astype(np.float64), np.array([r for *_, r in right])
    for i, (rows, centre, reach) in enumerate(left):
        apart = np.sqrt(((centres - centre) ** 2).sum(axis=1)) - radii - reach
        for j in np.flatnonzero(apart <= radius + 1e-4):
            if alone and j < i:
                continue
            others = right[j][0]
            cosine = single[rows] @ single[others].T
            if alone and j == i:
                cosine[np.tril_indices(len(rows))] = -2
            at = np.flatnonzero(cosine >= threshold - slack)
            for k in range(0, len(at), 1 << 16):
                a, b = np.divmod(at[k : k + (1 << 16)], len(others))
                good = cosine[a, b] > threshold + slack
                open_ = np.flatnonzero(~good)
                good[open_] = (units[rows[a[open_]]] * units[others[b[open_]]]).sum(axis=1) >= threshold
                yield rows[a[good]], others[b[good]]


def embedding_components(
    vectors: DataFrame,
    threshold: float = 0.9,
    block: int = 65536,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links are pairs of cosine >= ``threshold``.

    Unit vectors of cosine c are sqrt(2 - 2c) apart. Vectors belong to the part of the nearest of a few pivots, chosen
    by a hash; large parts are dealt out in blocks of about ``block``. Two blocks meet in one task, which is sent those
    vectors of either that may have a near one in the other's part, by the border between the parts and by the ring
    in which a part lies. In a task tiles of vectors that lie together are ruled out by their centres and radii, and
    the others compared whole. So every pair is compared in one place at most, and a vector is sent to as many blocks
    as it may reach: few where vectors form groups, all where they do not. Equal vectors are compared once and counted
    as often as they occur. The driver sees the pivots, and the size and the ring of each part.

    Null vectors, zero vectors and those with null or non-finite components link with nothing, not even
    with equal ones. component_id is the smallest vec_id that links reach, itself included; kept tells vec_id =
    component_id. Rows that share an id are rows of their own and link with each other if near. All vectors
    have one length. Repeated rows repeat; other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(named(vec_id).alias("vec_id"), named(embedding).alias("v")).withColumn("fit", usable(F.col("v")))
    digest = F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)
    rows = rows.select("vec_id", F.when(F.col("fit"), F.col("v")).alias("v"), F.when(F.col("fit"), digest).alias("cls"))
    rows = checkpointed(rows)
    unfit = rows.where("cls IS NULL").select(
        F.col("vec_id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    rows = rows.where("cls IS NOT NULL")
    classes = rows.groupBy("cls").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    classes = checkpointed(classes.withColumn("node", F.xxhash64("cls")))
    total = classes.count()
    if not total:
        return unfit
    count = max(LEAST_PARTS, -(-total // block))
    chosen = pd.Series([r["v"] for r in classes.orderBy("node").limit(count).select("v").collect()])
    pivots = np.unique(np.round(unit_rows(chosen), 9), axis=0)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    bounded_batches(vectors.sparkSession)
    sent = shared(vectors.sparkSession, pivots)

    def measure(batches):
        """One row for each part and batch: how many vectors, the least and the largest distance from the pivot."""
        for pdf in batches:
            if len(pdf):
                part, own, _ = homes(unit_rows(pdf["v"]), sent())
                rings = pd.DataFrame({"part": part, "own": own}).groupby("part")["own"].agg(["size", "min", "max"])
                yield rings.reset_index().set_axis(["part", "n", "low", "high"], axis=1)

    rings = classes.select("v").mapInPandas(measure, "part int, n long, low double, high double")
    rings = rings.groupBy("part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    bounds, blocks = np.zeros((len(pivots), 2)), np.zeros(len(pivots), dtype=np.int64)
    for r in rings:
        bounds[r["part"]], blocks[r["part"]] = (r["low"], r["high"]), -(-r["n"] // block)
    begins = np.cumsum(blocks) - blocks
    of_block = np.repeat(np.arange(len(pivots)), blocks)

    def deal(batches):
        """``visits``: the tasks that a vector is sent to, as smaller block, larger block and its side of the two."""
        points = sent()
        between = gaps(points, points)
        for pdf in batches:
            if not len(pdf):
                continue
            part, _, d = homes(unit_rows(pdf["v"]), points)
            reach = may_reach(part, d, between, bounds, radius)[:, of_block]
            own = begins[part] + np.mod(pdf["node"].to_numpy(np.int64), blocks[part])
            visits = []
            for mine, row in zip(own.tolist(), reach):
                visits.append([(min(mine, b), max(mine, b), int(b < mine)) for b in np.flatnonzero(row).tolist()])
            yield pdf.assign(visits=visits)

    kind = classes.schema["v"].dataType.simpleString()
    dealt = classes.select("node", "n", "v").mapInPandas(
        deal, f"node long, n long, v {kind}, visits array<struct<one:int,two:int,side:int>>"
    )
    dealt = dealt.select("node", "n", "v", F.inline("visits"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows (a, a, links): links of a, counted with the copies at their other ends; rows (a, b, 0): links
        that connect whatever the task's links connect."""
        node, n, side = pdf["node"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), pdf["side"].to_numpy()
        apart, units = pdf["one"].iloc[0] != pdf["two"].iloc[0], unit_rows(pdf["v"])
        del pdf
        links, root = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        if not apart or 0 < side.sum() < len(side):
            for x, y in near_pairs(units, side, threshold):
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                new = root[x] != root[y]
                if new.any():
                    to = np.arange(len(node))
                    a, b = forest_of(root[x[new]], root[y[new]])
                    to[a] = b
                    root = to[root]
        del units
        give_back()
        some, other = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(node)))
        return pd.DataFrame(
            {
                "a": np.concatenate([node[some], node[other]]),
                "b": np.concatenate([node[some], node[root[other]]]),
                "links": np.concatenate([links[some], np.zeros(len(other), np.int64)]),
            }
        )

    found = dealt.groupBy("one", "two").applyInPandas(compare, "a long, b long, links long")
    found = checkpointed(found)
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("a <> b").select("a", "b"))
    placed = classes.drop("v").join(links, "node", "left").join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long")
    placed = placed.join(least, "root").select("cls", n_links.alias("n_links"), "component_id")
    out = rows.select("vec_id", "cls").join(placed, "cls").select(
        F.col("vec_id").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
    return out.unionByName(unfit)
