"""Merkle manifest, shards and centroid clusters against plain definitions, and their edge cases."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wicketlake.llm import centroids, merkle, sharding
from wicketlake.llm.queries import ENTRIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, size string, cluster string, left string, key string"


def table(spark, rows, schema=SCHEMA):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *["clash"] * (width - len(r))) for r in rows], schema).repartition(3)


ROWS = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(400) if i % 3 or i < 3] + [
    (5, "s0", "en", 5, "Again"), (5, "s0", "en", 5, "Again"), (None, "s0", None, None, None), (None, None, "é", 1, "Ä" * 50_000),
    (7, "", "", 0, ""), (8, "alone", "en", 1, "ONE"), (10, None, "en", 1, "a\nb"),
]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    steps = []
    for level in levels[:-1]:
        first = i // 16 * 16
        steps.append((level[first:i], level[i + 1 : first + 16]))
        i //= 16
    return steps


def plain_manifest(rows):
    leaves = defaultdict(list)
    for row in rows:
        doc_id, source, text = row[0], row[1], row[4]
        leaf = shown = digest(*map(encoded, row))
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            shown = digest(*map(encoded, (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in text))))
        leaves["n" if source is None else "s" + source].append((doc_id is not None, doc_id or 0, leaf, shown))
    names = sorted(leaves, key=str.encode)
    trees = {k: tree([x[2] for x in sorted(leaves[k])]) for k in names}
    top = tree([trees[k][-1][0] for k in names])
    out = []
    for j, k in enumerate(names):
        for i, (has_id, doc_id, leaf, shown) in enumerate(sorted(leaves[k])):
            steps = path(trees[k], i) + path(top, j)
            for left, right in steps:
                shown = digest(*left, shown, *right)
            proof = digest(*[d for left, right in steps for d in left + right])
            out.append((doc_id if has_id else None, leaf, trees[k][-1][0], top[-1][0], proof, shown, shown == top[-1][0]))
    return sorted(map(str, out))


def test_merkle_manifest(spark):
    got = [tuple(r) for r in merkle.merkle_manifest(table(spark, ROWS)).collect()]
    assert sorted(map(str, got)) == plain_manifest(ROWS)
    assert {r[-1] for r in got} == {True, False}


def test_merkle_manifest_of_many_sources_and_few_rows(spark):
    rows = [(i, f"source {i % 40}", None, 1, "x") for i in range(90)]
    assert sorted(map(str, map(tuple, merkle.merkle_manifest(table(spark, rows)).collect()))) == plain_manifest(rows)
    one = [(3, None, None, None, "X")]
    assert sorted(map(str, map(tuple, merkle.merkle_manifest(table(spark, one)).collect()))) == plain_manifest(one)
    assert merkle.merkle_manifest(table(spark, ROWS).where("false")).collect() == []


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even(spark):
    random = np.random.default_rng(3)
    texts = ["w" * int(n) for n in random.integers(0, 400, size=4000)]
    rows = [(i, "s", "en", 1, f"{i} {t}") for i, t in enumerate(texts)] + [(10_000 + i, "s", "en", 1, "copy of a hot text") for i in range(2000)]
    for parts in (5, 97):
        got = sharding.shard_documents(table(spark, rows), shards=24, parts=parts).collect()
        assert len(got) == len(rows) and gapless(got) and {r["law"] for r in got} == {"bytes"}
        held = Counter()
        for r in got:
            held[r["shard"]] += r["size"]
        mean = sum(held.values()) / 24
        assert len(held) == 24 and all(abs(b - mean) <= 0.01 * mean + 450 for b in held.values())
        text = {r[0]: r[4] for r in rows}
        assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
        assert all(r["grown_shard"] is None for r in got)
    again = sharding.shard_documents(table(spark, rows).repartition(7), shards=24, parts=11).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_shards_of_odd_rows(spark):
    rows = [(i, None, None, None, None) for i in range(30)] + [(None, None, None, None, "same")] * 50 + [(1, None, None, None, "é" * 9000)] * 2
    got = sharding.shard_documents(table(spark, rows), shards=3, keep=["doc_id", "key", "size"]).collect()
    assert len(got) == len(rows) and gapless(got) and {r["key"] for r in got} == {"clash"}
    assert sorted(r["size"] for r in got) == [8] * 30 + [12] * 50 + [18008] * 2
    assert sum(r["text_crc32"] is None for r in got) == 30
    assert sharding.shard_documents(table(spark, rows).where("false")).collect() == []
    few = sharding.shard_documents(table(spark, rows[:1]), shards=24).collect()
    assert len(few) == 1 and few[0]["slot"] == 0 and 0 <= few[0]["shard"] < 24


def test_splitters_refine_until_single_keys(spark):
    """Keys that differ in their last bits only: every round is needed."""
    keys = spark.createDataFrame([((5 << 50) + i, 10 * (i % 7) + 1) for i in range(64)], "key long, size long")
    sizes = [10 * (i % 7) + 1 for i in range(64)]
    splitters = [sharding.Splitter(0, sum(sizes) * k / 4, 0.0) for k in (1, 2, 3)]
    sharding.settle(splitters, keys)
    for s in splitters:
        best = min(abs(sum(sizes[:n]) - s.goal) for n in range(65))
        assert s.miss() == best and s.below[0] == sum(z for i, z in enumerate(sizes) if (5 << 50) + i < s.key)


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(float(x) * 64)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    h = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, h(r[0]), r[1]))[:k]]
    table = np.array([v for _, v in kept], dtype=object)
    for step in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centers] for v in table]
        own = np.array([row.index(min(row)) for row in far])
        if step < rounds:
            for j in range(len(centers)):
                if (own == j).any():
                    centers[j] = [int(s) // int((own == j).sum()) for s in table[own == j].sum(axis=0)]
    dist = np.array([row[j] for row, j in zip(far, own)], dtype=object)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(str((i, int(j), int(d), int(dist[own == j].sum()), int(dist.sum()), sha[j])) for (i, _), j, d in zip(kept, own, dist))


@pytest.mark.parametrize("chunk", [16384, 7])
@pytest.mark.parametrize("dims,width", [(6, 2), (6, 4), (5, 1), (5, 2)])
def test_clusters(spark, dims, width, chunk):
    random = np.random.default_rng(dims)
    vectors = [*random.normal(size=(80, dims)).tolist(), *(random.normal(size=(40, dims)) * 1000).tolist()]
    vectors += [[0.0] * dims, [-0.0] * dims, [-1 / 64] * dims, [2.0**20] * dims, vectors[0], vectors[0]]
    vectors += [None, [], [1.0] * (dims - 1), [1.0] * (dims + 1), [None] + [1.0] * (dims - 1), [float("nan")] * dims, [float("-inf")] * dims]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[5]), (None, vectors[6])]
    frame = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<double>, cluster int, codes string")
    got = centroids.clusters(frame.repartition(3), k=9, rounds=3, dims=dims, width=width, chunk=chunk).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_clusters(rows, 9, 3, dims)


def test_clusters_of_few_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<float>")
    got = sorted(centroids.clusters(frame, dims=2).collect())
    assert [(r["vec_id"], r["distance"], r["inertia"]) for r in got] == [(1, 0, 0), (2, 0, 0)]
    assert centroids.clusters(frame.where("false"), dims=2).collect() == []


@pytest.mark.parametrize("key", [k for k, e in ENTRIES.items() if e.sql])
def test_queries_equal_their_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    theirs = con.execute(ENTRIES[key].sql)
    names = sorted(d[0] for d in theirs.description)
    order = [[d[0] for d in theirs.description].index(c) for c in names]
    mine = ENTRIES[key].build(spark, SF_DIR)
    assert sorted(mine.columns) == names
    assert sorted(str(tuple(r)) for r in mine.select(*names).collect()) == sorted(str(tuple(r[i] for i in order)) for r in theirs.fetchall())
