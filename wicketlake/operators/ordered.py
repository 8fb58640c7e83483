"""Ordered operations that stay parallel inside a hot key.

A window over one key runs in one task. These helpers split a key by a coarse step of its
order (an innings, a date, a block of turns), work inside each step, and combine steps with a
window over one row per step. Results equal the plain window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wicketlake.session import written


def numbered(df: DataFrame, keys: list[str], step: str, order: list, name: str) -> DataFrame:
    """1-based position per ``keys`` by (``step``, ``order``); ``step`` never decreases along the order."""
    inner = Window.partitionBy(*keys, step).orderBy(*order)
    counts = df.groupBy(*keys, step).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, step, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (
        df.withColumn("_inner", F.row_number().over(inner))
        .join(offsets, [*keys, step])
        .withColumn(name, F.col("_inner") + F.col("_before"))
        .drop("_inner", "_before")
    )


def carried(df: DataFrame, keys: list[str], order: str, step_rows: int, columns: dict[str, str]) -> DataFrame:
    """Last non-null value before each row, per ``keys`` by the integer ``order``.

    ``columns`` maps a value column to the name of the carried one.
    """
    stepped = df.withColumn("_step", F.floor(F.col(order) / step_rows))
    inner = Window.partitionBy(*keys, "_step").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    lasts = stepped.groupBy(*keys, "_step").agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_last_{i}")
            for i, c in enumerate(columns)
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    entering = lasts.select(
        *keys,
        "_step",
        *[F.last(f"_last_{i}", True).over(earlier).alias(f"_enter_{i}") for i in range(len(columns))],
    )
    local = stepped.select(
        "*", *[F.last(c, True).over(inner).alias(f"_local_{i}") for i, c in enumerate(columns)]
    )
    out = local.join(entering, [*keys, "_step"])
    for i, name in enumerate(columns.values()):
        out = out.withColumn(name, F.coalesce(f"_local_{i}", f"_enter_{i}"))
    drop = [f"_{kind}_{i}" for kind in ("local", "enter") for i in range(len(columns))]
    return out.drop("_step", *drop)


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Place of each row in a total ``order``, from 1.

    Rows are dealt out by ranges of the order; a place is the one within the range plus the rows of the ranges
    before, of which there is one count for each range. Only those counts meet in one task.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("_range", F.shiftright("_at", 33).cast("int")), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("_range", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return dealt.join(shifts, "_range").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")
