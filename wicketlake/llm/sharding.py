"""Shards of nearly equal bytes by a histogram sort: exact splitters first, then one exchange."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import named
from wicketlake.session import written

KEY_BITS, ID_BITS = 60, 24
#: Probes lie at multiples of 2 to these powers: 65,536 over all keys, then 256 in each interval still open.
SHIFTS = (44, 36, 28, 20, 12, 4, 0)
PREFIX_SHIFT = 48


def hash_bits(value: Column) -> Column:
    """The first 60 bits of the SHA-256 of a text."""
    return F.conv(F.substring(F.sha2(value, 256), 1, KEY_BITS // 4), 16, 10).cast("long")


def sort_key(text: Column, doc_id: Column, row: Column) -> Column:
    """A key of 60 bits: equal texts are neighbours, ordered by a hash of their id (without one, of their row)."""
    high = hash_bits(F.coalesce(text, F.lit("")))
    low = hash_bits(F.coalesce(doc_id.cast("string"), F.concat(F.lit("row "), row.cast("string"))))
    return high.bitwiseAND(F.lit(-(1 << ID_BITS))).bitwiseOR(low.bitwiseAND(F.lit((1 << ID_BITS) - 1)))


@dataclass
class Splitter:
    """A wanted border: ``goal`` of a measure (0: bytes, 1: rows) below it, to be met within ``tolerance``."""

    measure: int
    goal: float
    tolerance: float
    key: int = 0
    below: tuple[int, int] = (0, 0)  # bytes and rows of all keys under ``key``
    interval: int = 0  # bucket of the last round that holds the goal
    start: tuple[int, int] = (0, 0)  # bytes and rows below that bucket

    def miss(self) -> float:
        return abs(self.below[self.measure] - self.goal)


def settle(splitters: list[Splitter], keys: DataFrame) -> None:
    """Find each splitter's key (column key, column size of ``keys``).

    Each round counts bytes and rows between the probes of all open intervals, on all partitions at once.
    A splitter takes the probe nearest to its goal; outside its tolerance, the next round probes the
    interval that holds the goal more finely, down to single keys. The driver sees the counts of the probes
    only: 65,536 in the first round, 256 for each open splitter later, whatever the rows' number.
    """
    before, open_ones = KEY_BITS, splitters
    for shift in SHIFTS:
        if not open_ones:
            return
        wanted = sorted({s.interval for s in open_ones})
        rows = keys if before == KEY_BITS else keys.where(F.shiftright("key", before).isin(wanted))
        counted = rows.groupBy(F.shiftright("key", shift).alias("b")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        inside: dict[int, list[tuple[int, int, int]]] = {}
        for b, size, n in sorted(tuple(r) for r in counted.collect()):
            inside.setdefault(b >> (before - shift), []).append((b, size, n))
        for s in open_ones:
            below, probes = s.start, []
            for b, size, n in inside.get(s.interval, []):
                probes.append((below, b))
                below = (below[0] + size, below[1] + n)
            if not probes:
                continue
            last = probes[-1][1]
            s.below, near = min([*probes, (below, last + 1)], key=lambda p: (abs(p[0][s.measure] - s.goal), p))
            s.key = near << shift
            holds = max(0, bisect_right([p[0][s.measure] for p in probes], s.goal) - 1)
            s.start, s.interval = probes[holds]
        before, open_ones = shift, [s for s in open_ones if s.miss() > s.tolerance]


def part_table(splitters: list[Splitter], total: int) -> list[dict]:
    """Parts [lo, hi) of the key space between all borders: their shard, and shift, the slot of their first row."""
    shard_starts = sorted(s.below[1] for s in splitters if s.measure == 0)
    border: dict[int, int] = {0: 0}
    for s in splitters:
        if 0 < s.below[1] < total:
            border[s.below[1]] = min(border.get(s.below[1], s.key), s.key)
    rows = sorted(border)
    ends = [border[r] for r in rows[1:]] + [1 << KEY_BITS]
    made = []
    for part, (first, hi) in enumerate(zip(rows, ends)):
        shard = bisect_right(shard_starts, first)
        start = shard_starts[shard - 1] if shard else 0
        made.append({"lo": border[first], "hi": hi, "part": part, "shard": shard, "shift": first - start})
    return made


def shard_documents(
    docs: DataFrame, shards: int = 24, tolerance: float = 0.005, parts: int | None = None, overhead: int = 8,
    doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` in ``shards`` of nearly equal bytes: ``keep`` (default: the id) with size, text_crc32, law,
    shard, slot and grown_shard (null: the law is ``bytes``).

    A document's size is the UTF-8 bytes of its text plus ``overhead``. Keys put equal texts side by side;
    a shard ends at the coarsest probe whose bytes below are within ``tolerance`` of a mean shard of the
    even share, so a group of copies is cut only where it is too large to fit. If one document is larger
    than that, the nearest border of documents counts. slot numbers a shard's documents by key, id and
    check sum from 0 without gaps.

    Shards are the unit of bytes, parts the unit of work: borders of about ``parts`` equal counts of rows
    (default: the session's shuffle partitions) are found in the same rounds, so that a shard full of short
    documents is dealt out as well. One exchange brings each row to its part; the counts below its border
    give the slots. A null text has size ``overhead`` and a null check sum, and lies with the empty texts.
    Documents without an id are told apart by their row; repeated rows with an id stay side by side. Input
    columns with the names of new ones are replaced; an empty table gives no rows.
    """
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in (keep or [doc_id]) if c not in new]
    table = docs.select(
        *[named(c).alias(f"kept{i}") for i, c in enumerate(kept)],
        named(doc_id).alias("id"),
        (F.coalesce(F.octet_length(named(text)), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(named(text).cast("binary")).alias("crc"),
        sort_key(named(text), named(doc_id), F.monotonically_increasing_id()).alias("key"),
    )
    table = written(table, "keys")
    total_bytes, total_rows = table.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share, rows = total_bytes / shards, total_rows / parts
    splitters = [Splitter(0, share * i, share * tolerance) for i in range(1, shards)]
    splitters += [Splitter(1, rows * i, rows / 4) for i in range(1, parts)]
    settle(splitters, table.select("key", "size"))
    made = part_table(splitters, total_rows)
    schema = "array<struct<lo:bigint,hi:bigint,part:int,shard:int,shift:bigint>>"
    borders = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(made)), schema)))
    prefixes = F.sequence(F.shiftright("lo", PREFIX_SHIFT), F.shiftright(F.col("hi") - 1, PREFIX_SHIFT))
    borders = borders.withColumn("prefix", F.explode(prefixes))  # at most 4,096 rows and one for each part
    placed = table.withColumn("prefix", F.shiftright("key", PREFIX_SHIFT)).join(F.broadcast(borders), "prefix")
    placed = placed.where("lo <= key AND key < hi").drop("prefix", "lo", "hi")
    ordered = placed.repartitionById(len(made), F.col("part")).sortWithinPartitions("key", "id", "crc", "size")
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    return ordered.withColumn("place", place).select(
        *[named(f"kept{i}").alias(c) for i, c in enumerate(kept)],
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") + F.col("shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
