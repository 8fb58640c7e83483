"""Near-duplicate texts: 64-bit fingerprints of word shingles, linked by a search in vantage-point trees."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketlake.llm.common import checkpointed, in_blocks, named, text_groups, with_computed
from wicketlake.llm.components import connected_components

SMALL_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42


def shingle_hashes(text: str, shingle: int) -> tuple[bytes, list[int]]:
    """The words joined by one space, A-Z lower-cased, and the hash of each shingle; of fewer words than a
    shingle the one of all words, of none no hash.

    bytes.split() cuts at the ASCII white space that separates words: space and 9 to 13.
    """
    words = text.encode().translate(SMALL_LETTERS).split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return line, [digest(line, SEED)] if words else []
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins, ends = (ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return line, [digest(line[a:b], SEED) for a, b in zip(begins, ends)]


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the unsigned hashes, as a signed number; bits are unpacked in slices."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8")
        total += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: str, shingle: int) -> int:
    """Bits set in over half of the hashes of all shingles, as a signed number; 0 for a text without words."""
    hashes = shingle_hashes(text, shingle)[1]
    return majority(np.array(hashes, dtype=np.uint64)) if hashes else 0


def with_fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with fingerprint (long): lower-cased A-Z, words between ASCII white space, repeats included.

    A null or empty text has fingerprint 0; a text of fewer words than a shingle is one shingle.
    """

    def start():
        def step(texts):
            made: list[int] = []
            for _, group in text_groups(texts):
                made += [fingerprint(one, shingle) for one in group]
            return [pa.array(made, pa.int64())]

        return step

    return with_computed(docs, [text], [T.StructField("fingerprint", T.LongType())], start, keep)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def vantage_points(levels: int) -> list[int]:
    """One fixed pattern for each level, the same for any data."""
    made = np.random.default_rng(64).integers(-(2**63), 2**63, size=levels, dtype=np.int64)
    return [int(x) for x in made]


def distance(fp: Column, point: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(point)))


def shards_of(fp: Column, vantage: list[int], medians: list[int], radius: int) -> tuple[Column, Column]:
    """(home, visits): the shard of a fingerprint, bit l telling the side of level l's median, and all shards that
    hold fingerprints within ``radius`` of it.

    Visits are folded over the levels, so that the expression grows by one entry a level and not by a factor.
    """
    home, sides = F.lit(0).cast("long"), []
    for level, (v, m) in enumerate(zip(vantage, medians)):
        d, bit = distance(fp, v), F.lit(1 << level).cast("long")
        home = home + F.when(d > m, bit).otherwise(F.lit(0).cast("long"))
        sides.append(F.struct(bit.alias("bit"), (d <= m + radius).alias("near"), (d > m - radius).alias("far")))
    one = F.array(F.lit(0).cast("long"))
    if not sides:
        return home, one

    def both(shards: Column, side: Column) -> Column:
        beyond = F.transform(shards, lambda x: x + side["bit"])
        return F.when(~side["far"], shards).when(~side["near"], beyond).otherwise(F.concat(shards, beyond))

    return home, F.aggregate(F.array(*sides), one, both)


def vantage_pairs(points: np.ndarray, queries: np.ndarray, radius: int, leaf: int = 512):
    """Index pairs (query, point) at distance <= radius, from a vantage-point tree over the points.

    A node splits its points at the median distance from one of them; a query follows a branch unless the
    triangle inequality rules it out. All queries of a node go down together.
    """
    work = [(np.arange(len(points)), np.arange(len(queries)))]
    while work:
        p, q = work.pop()
        if not len(p) or not len(q):
            continue
        d = np.bitwise_count(points[p] ^ points[p[0]]).astype(np.int16)
        far = points[p[np.argmax(d)]]
        d = np.bitwise_count(points[p] ^ far).astype(np.int16)
        middle = np.median(d)
        near = d <= middle
        if len(p) <= leaf or near.all():
            for i in range(0, len(q), 2048):
                part = q[i : i + 2048]
                for j in range(0, len(p), 2048):
                    close = np.bitwise_count(queries[part][:, None] ^ points[p[j : j + 2048]][None, :]) <= radius
                    a, b = np.nonzero(close)
                    yield part[a], p[j + b]
            continue
        dq = np.bitwise_count(queries[q] ^ far).astype(np.int16)
        work.append((p[near], q[dq <= middle + radius]))
        work.append((p[~near], q[dq > middle - radius]))


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many of the pairs as connect what all of them connect: each node with the smallest it reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        now = root.copy()
        np.minimum.at(now, root[left], low)
        np.minimum.at(now, root[right], low)
        now = now[now]
        if (now == root).all():
            break
        root = now
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def near_links(fingerprints: DataFrame, radius: int = 2, shard: int = 16384) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect what distance <= radius connects.

    The upper levels of the tree are shared: level l asks whether the distance from the l-th vantage point
    is at most the median, and the answers name the shard. There are as many levels as give about ``shard``
    fingerprints a shard. As a query a fingerprint also goes to the shards beyond each median that lies
    within the radius, so that no pair is lost at a boundary. In a shard (in blocks, if fingerprints crowd
    there) a vantage-point tree finds the pairs exactly. The driver sees the median of each level only.
    """
    total = fingerprints.count()
    levels = max(0, math.ceil(math.log2(max(1, total) / shard)))
    vantage = vantage_points(levels)
    medians = []
    if levels:
        counts = fingerprints.select(
            F.posexplode(F.array(*[distance(F.col("fp"), v) for v in vantage])).alias("level", "d")
        ).groupBy("level", "d").count().orderBy("level", "d").collect()
        for level in range(levels):
            seen, rows = 0, [r for r in counts if r["level"] == level]
            for r in rows:
                seen += r["count"]
                if 2 * seen >= total:
                    medians.append(r["d"])
                    break
    home, visits = shards_of(F.col("fp"), vantage, medians, radius)
    points = fingerprints.select("fp", home.alias("shard"))
    queries = fingerprints.select(F.col("fp").alias("asked"), F.explode(visits).alias("shard"))
    points, queries, by = in_blocks(points, queries, ["shard"], 2 * shard, "fp", "asked")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        p, q = left["fp"].to_numpy(np.int64), right["asked"].to_numpy(np.int64)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in vantage_pairs(p.view(np.uint64), q.view(np.uint64), radius):
            other = q[i] < p[j]
            a.append(q[i[other]])
            b.append(p[j[other]])
        x, y = forest_of(np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"a": x, "b": y})

    grouped = points.groupBy(*by).cogroup(queries.groupBy(*by))
    return grouped.applyInPandas(search, "a long, b long")


def simhash_components(
    docs: DataFrame, shingle: int = 3, radius: int = 2, shard: int = 16384, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits reach, itself
    included; a null id is never the smallest unless all are null. Texts without words have fingerprint 0
    and are linked like any other. Equal fingerprints meet once, so copies cost nothing in the search.
    Repeated rows repeat; other columns are not read; an empty table gives no rows.
    """
    made = with_fingerprints(docs.select(named(doc_id), named(text)), shingle, text, [doc_id])
    rows = checkpointed(made.select(named(doc_id).alias("doc_id"), F.col("fingerprint").alias("fp")))
    classes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(classes.select("fp"), radius, shard))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = placed.withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    component = placed.join(smallest, "root").select("fp", "component_id")
    return rows.join(component, "fp").select(
        F.col("doc_id").alias(doc_id), F.col("fp").alias("fingerprint"), "component_id"
    )
