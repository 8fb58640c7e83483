"""Merkle manifest of a dataset: a hash tree for each source, and one over the sources' roots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wicketlake.llm.common import named
from wicketlake.session import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nothing() -> Column:
    return F.lit("").cast("binary")


def encoded(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null is a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(digests: Column) -> Column:
    """SHA-256 of digests that stand in a row (binary), each taken as its lowercase hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_rows(docs: DataFrame, fields: Sequence[str], doc_id: str, source: str, text: str, every: int) -> DataFrame:
    """(key, doc_id, digest, tampered): key orders sources with null first; tampered is null where nothing changes."""
    leaf = lambda change: F.unhex(F.sha2(F.concat(*[encoded(change(c)) for c in fields]), 256))
    small = lambda c: F.translate(named(c), CAPITALS, SMALL) if c == text else named(c)
    touched = F.crc32(named(doc_id).cast("string").cast("binary")) % every == 0
    return docs.select(
        F.coalesce(F.concat(F.lit(":"), named(source).cast("string")), F.lit("")).alias("key"),
        named(doc_id).alias("doc_id"),
        leaf(named).alias("digest"),
        F.when(touched, leaf(small)).alias("tampered"),
    )


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with idx, their place within key in ascending ``order`` from 0, and cnt, the rows of their key.

    Rows are dealt out by ranges of (key, order), so a key of any size is spread over tasks; a place is the
    one within the range plus the rows of the key in the ranges before, one count for each key and range.
    """
    by = ["key", *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("range", F.shiftright("at", 33).cast("int")), "ranges")
    counts = dealt.groupBy("key", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of_key = W.partitionBy("key")
    before = F.sum("n").over(of_key.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(
        "key", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(of_key).alias("cnt")
    )
    placed = dealt.join(written(counts, "range-counts"), ["key", "range"])
    return placed.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with run, slot and the siblings' digests to their left and right, each joined (binary).

    Lag and lead of every offset below ``fanout`` over the order of nodes, masked by the slot and by the
    length of the run. A run is a window partition of its own, so no window holds more than ``fanout`` rows.
    """
    nodes = nodes.withColumn("run", F.floor(F.col("idx") / fanout)).withColumn("slot", F.col("idx") % fanout)
    length = F.least(F.lit(fanout), F.col("cnt") - F.col("run") * fanout)
    order = W.partitionBy("key", "run").orderBy("slot")
    before = [F.when(F.col("slot") >= k, F.lag("digest", k).over(order)) for k in range(fanout - 1, 0, -1)]
    after = [F.when(F.col("slot") + k < length, F.lead("digest", k).over(order)) for k in range(1, fanout)]
    joined = lambda side: F.concat(*[F.coalesce(d, nothing()) for d in side])
    return nodes.withColumn("left", joined(before)).withColumn("right", joined(after))


def tree_levels(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """(key, idx, cnt, digest) of each level above ``leaves``, which is the first; a key ends at one node.

    The first child of a run hashes the parent. The driver sees the largest number of nodes of a key only.
    """
    levels, most = [leaves], leaves.agg(F.max("cnt")).first()[0] or 0
    while most > 1:
        rows = with_siblings(levels[-1].where("cnt > 1").select("key", "idx", "cnt", "digest"), fanout)
        parents = rows.where("slot = 0").select(
            "key", F.col("run").alias("idx"), F.ceil(F.col("cnt") / fanout).alias("cnt"),
            hashed(F.concat("digest", "right")).alias("digest"),
        )
        levels.append(written(parents, "level"))
        most = -(-most // fanout)
    return levels


def with_paths(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The first of ``levels`` with the columns of ``tops`` and path, from the leaf's siblings up.

    ``tops`` has key, level (where the key has one node), path (above that node) and columns to hand down.
    Level by level from the top, a node meets its parent by (key, run), so that at most a run meets one row.
    """
    handed = [c for c in tops.columns if c not in ("key", "level", "path")]
    below = None
    for level in range(len(levels) - 1, -1, -1):
        above = tops.where(F.col("level") == level).select("key", F.lit(0).cast("long").alias("run"), "path", *handed)
        above = above if below is None else above.unionByName(below)
        nodes = with_siblings(levels[level], fanout).join(above, ["key", "run"])
        step = F.array(F.struct("left", "right"))
        nodes = nodes.withColumn("path", F.when(F.col("cnt") > 1, F.concat(step, "path")).otherwise(F.col("path")))
        below = nodes.select("key", F.col("idx").alias("run"), "path", *handed)
    return nodes


def merkle_manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", source: str = "source", text: str = "text",
    fanout: int = 16, every: int = 5,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    A leaf hashes the encoded ``fields``. Leaves of a source in ascending order of id, then of their hash,
    are hashed in runs of ``fanout``, level by level, down to one subroot; subroots in order of sources
    (null first, then bytes) likewise to the root. A proof is all siblings of the path, left to right, level
    by level. folded_root comes from the leaf, or where ``every`` divides the id's crc32 from the leaf of a
    text with small letters for A-Z, and the siblings; verified says if it is the root.

    A null field is encoded as such; null ids come first in their source and are never tampered with; a null
    text stays. Repeated rows are leaves of their own. Other columns are not read; an empty table gives no
    rows. Sources of any size are spread over tasks; a task holds ranges or runs.
    """
    leaves = written(leaf_rows(docs, fields, doc_id, source, text, every), "leaves")
    levels = tree_levels(numbered(leaves, ["doc_id", "digest"]), fanout)
    tops = [
        rows.where("cnt = 1").select(F.lit("").alias("key"), F.col("key").alias("of"), F.lit(level).alias("level_of"), F.col("digest"))
        for level, rows in enumerate(levels)
    ]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    upper = tree_levels(numbered(written(subroots, "subroots"), ["of"]), fanout)
    path = F.array().cast("array<struct<left:binary,right:binary>>")
    root = upper[-1].select("key", F.lit(len(upper) - 1).alias("level"), path.alias("path"), F.col("digest").alias("root"))
    tops = with_paths(upper, root, fanout).select(
        F.col("of").alias("key"), F.col("level_of").alias("level"), "path", F.col("digest").alias("subroot"), "root"
    )
    rows = with_paths(levels, written(tops, "tops"), fanout)
    folded = F.aggregate(
        "path", F.coalesce("tampered", "digest"), lambda held, s: hashed(F.concat(s["left"], held, s["right"]))
    )
    proof = F.aggregate("path", nothing(), lambda held, s: F.concat(held, s["left"], s["right"]))
    rows = rows.withColumn("folded", folded)
    return rows.select(
        F.col("doc_id").alias(doc_id),
        hex_text(F.col("digest")).alias("leaf"),
        hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"),
        F.sha2(hex_text(proof), 256).alias("proof_sha256"),
        hex_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
