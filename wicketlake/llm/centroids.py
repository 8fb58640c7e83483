"""Centroid clustering of whole-number vectors over dictionaries of subvectors, exact in every sum."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketlake.llm.common import literal_rows, named
from wicketlake.session import written

#: Largest component whose squared distances in 64 dimensions still fit a long after scaling by 64.
LARGEST = 2.0**21
SCALE = 64


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, dims: int) -> DataFrame:
    """(vec_id, v) of the vectors with exactly ``dims`` components, all of them finite numbers."""
    rows = vectors.select(named(vec_id).alias("vec_id"), named(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= LARGEST), F.lit(False)))
    return rows.where((F.size("v") == dims) & finite)


def starts(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest hash of ``1:<vec_id>``, those without an id last, ties by their components."""
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(digest.alias("h"), whole.alias("v")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return np.array([r["v"] for r in first.collect()], dtype=np.int64)


def dictionary(sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a block of dimensions, and each row's code."""
    if sub.shape[1] == 1:
        kinds, codes = np.unique(sub[:, 0], return_inverse=True)
        return kinds[:, None], codes
    if sub.shape[1] == 2:  # two components of at most 28 bits and a sign are one number
        packed = (sub[:, 0] << np.int64(30)) + sub[:, 1]
        _, first, codes = np.unique(packed, return_index=True, return_inverse=True)
        return sub[first], codes
    kinds, codes = np.unique(sub, axis=0, return_inverse=True)
    return kinds, codes.reshape(-1)


def encoded(rows: DataFrame, dims: int, width: int, chunk: int) -> DataFrame:
    """``rows`` as chunks: ids, codes (16 bits a vector and block), sizes (of each block's dictionary), values.

    A chunk holds at most ``chunk`` vectors of one task and its own dictionary of each block of ``width``
    dimensions, so a task's memory does not depend on the number of rows or of distinct subvectors.
    """
    if chunk > 1 << 16:
        raise ValueError("codes have 16 bits: at most 65,536 vectors a chunk")
    id_type = rows.schema["vec_id"].dataType
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(id_type)), T.StructField("codes", T.BinaryType()),
         T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("kinds", T.BinaryType())]
    )

    def pack(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        parts = [dictionary(v[:, j : j + width]) for j in range(0, dims, width)]
        codes = np.column_stack([c for _, c in parts]).astype("<u2")
        kinds = b"".join(d.astype("<i8").tobytes() for d, _ in parts)
        sizes = pa.array([[len(d) for d, _ in parts]], pa.list_(pa.int32()))
        ids = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), ids)
        columns = [ids, pa.array([codes.tobytes()], pa.binary()), sizes, pa.array([kinds], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "codes", "sizes", "kinds"])

    def run(batches):
        ids, held, count = [], [], 0
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            whole = np.floor(flat * SCALE).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                take = min(chunk - count, batch.num_rows - at)
                ids.append(batch.column(0).slice(at, take))
                held.append(whole[at : at + take])
                count, at = count + take, at + take
                if count == chunk:
                    yield pack(pa.concat_arrays(ids), np.concatenate(held))
                    ids, held, count = [], [], 0
        if count:
            yield pack(pa.concat_arrays(ids), np.concatenate(held))

    return rows.select("vec_id", "v").mapInArrow(run, schema)


def blocks_of(row: dict, dims: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The codes (vector, block) and the dictionaries of a chunk."""
    codes = np.frombuffer(row["codes"], dtype="<u2").reshape(-1, -(-dims // width))
    values, kinds, at = np.frombuffer(row["kinds"], dtype="<i8"), [], 0
    for block, size in enumerate(row["sizes"]):
        wide = min(width, dims - block * width)
        kinds.append(values[at : at + size * wide].reshape(size, wide))
        at += size * wide
    return codes, kinds


def assign(codes: np.ndarray, kinds: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the first) and squared distance of each vector: one distance for each distinct
    subvector and centroid, summed over blocks by code."""
    total, at = np.zeros((len(codes), len(centroids)), dtype=np.int64), 0
    for block, d in enumerate(kinds):
        part = ((d[:, None, :] - centroids[None, :, at : at + d.shape[1]]) ** 2).sum(axis=2)
        total += part[codes[:, block]]
        at += d.shape[1]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(codes)), cluster]


def moved(chunks: DataFrame, centroids: np.ndarray, dims: int, width: int) -> np.ndarray:
    """One round: every centroid becomes the floor of its vectors' mean; a chunk sends counts and sums only."""
    k = len(centroids)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes, kinds = blocks_of(row, dims, width)
                cluster, _ = assign(codes, kinds, centroids)
                sums = [
                    np.bincount(cluster * len(d) + codes[:, b], minlength=k * len(d)).reshape(k, len(d)) @ d
                    for b, d in enumerate(kinds)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(k)), pa.array(np.bincount(cluster, minlength=k)), pa.array(np.hstack(sums).tolist(), pa.list_(pa.int64()))],
                    names=["cluster", "n", "sums"],
                )

    parts = chunks.select("codes", "sizes", "kinds").mapInArrow(run, "cluster long, n long, sums array<long>")
    totals = [F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]
    new = centroids.copy()
    for r in parts.where("n > 0").groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return new


def clusters(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, width: int = 2, chunk: int = 16384,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector kept.

    Kept are vectors of exactly ``dims`` components, none null, not finite or beyond 2 to the 21 (squares of
    more would not fit a long); a component x counts as floor(64 x). The centroids start as ``starts`` says
    (fewer than ``k`` vectors: as many centroids), move for ``rounds`` rounds, an empty one staying, and the
    vectors are assigned once more. Distances and sums are whole numbers and exact; ties go to the smaller
    number. Vectors are encoded once; then only k times dims sums a chunk are exchanged in a round, and the
    driver holds the centroids. Repeated rows are vectors of their own, a null id is kept; other columns are
    not read; an empty table gives no rows.
    """
    rows = whole_vectors(vectors, vec_id, embedding, dims)
    id_type = rows.schema["vec_id"].dataType
    chunks = written(encoded(rows, dims, width, chunk), "chunks")
    centroids = starts(rows, k).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(chunks, centroids, dims, width)
    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["codes", "sizes", "kinds"]).to_pylist()):
                cluster, distance = assign(*blocks_of(row, dims, width), centroids)
                columns = [batch.column("ids")[i].values, pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    placed = written(chunks.mapInArrow(run, schema), "assigned")
    inertia = {r["cluster"]: r["i"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about: Sequence = [(c, i, sum(inertia.values()), digests[c]) for c, i in sorted(inertia.items())] or [(-1, 0, 0, "")]
    facts = literal_rows(vectors.sparkSession, about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(facts), "cluster")  # at most k rows
    return out.select(F.col("vec_id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
