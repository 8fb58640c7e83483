"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Sequence
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketlake.session import shared_folder


def named(column: str) -> Column:
    return F.col(f"`{column}`")


def literal_rows(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A short constant table as SQL literals."""
    fields = T._parse_datatype_string(schema).fields
    one = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*one).cast(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder; lost executors then cost no more than their tasks."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Bytes of an Arrow batch: a worker and its task's writer and reader hold a few of them at a time.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes, also in a session made elsewhere; the default bounds 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return memory that a worker no longer uses: Spark keeps workers for later tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def with_computed(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    start: Callable[[], Callable[..., list[pa.Array]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns made by Python code, without a shuffle.

    ``start`` runs once per task and returns the function from input arrays to output arrays. ``keep``
    names the columns to carry along (default: all); a kept column with the name of a new one is replaced.
    Batches are bounded by ``BATCH_BYTES``.
    """
    bounded_batches(df.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    read = list(dict.fromkeys([*kept, *inputs]))
    names = kept + [f.name for f in fields]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))

    def run(batches):
        step = start()
        for batch in batches:
            made = step(*[batch.column(read.index(c)) for c in inputs])
            yield pa.RecordBatch.from_arrays([batch.column(read.index(c)) for c in kept] + list(made), names=names)
            del batch, made
            give_back()

    return df.select(*[named(c) for c in read]).mapInArrow(run, schema)


def per_worker(key: str, make: Callable[[], object]):
    """An object that lives as long as the Python worker, so that later tasks of the worker find it filled."""
    store = sys.modules.setdefault("wicketlake_worker_memory", ModuleType("wicketlake_worker_memory"))
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)


def shared(spark: SparkSession, value: object) -> Callable[[], object]:
    """Send a value of bounded size to all tasks once; the function returned gives it there. It travels with its
    classes, so executors need no copy of this package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def text_groups(column: pa.Array, size: int = 1 << 20):
    """Runs of texts of about ``size`` bytes (a longer text stands alone): (first row, texts with null as '')."""
    first, held, texts = 0, 0, []
    for i in range(len(column)):
        text = column[i].as_py() or ""
        texts.append(text)
        held += len(text)
        if held >= size:
            yield first, texts
            first, held, texts = i + 1, 0, []
    if texts:
        yield first, texts


def in_blocks(
    points: DataFrame, queries: DataFrame, keys: Sequence[str], capacity: int, point_id: str, query_id: str
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Deal both sides of a comparison within ``keys`` out to blocks of about ``capacity`` rows of either side.

    A key with more rows is split by a hash of the ids, and each part of the points meets each part of the
    queries, so that no group is larger than its block whatever share of all rows one key holds. Keys that
    only one side has vanish. Returns both sides and the grouping columns.
    """
    keys = list(keys)
    parts = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / capacity).cast("int").alias(name))
    sizes = parts(points, "_p").join(parts(queries, "_q"), keys)
    point_part = F.pmod(F.xxhash64(named(point_id)), named("_p")).cast("int")
    query_part = F.pmod(F.xxhash64(named(query_id)), named("_q")).cast("int")
    upto = lambda name: F.explode(F.sequence(F.lit(0), named(name) - 1))
    left = points.join(sizes, keys).withColumn("p_part", point_part).withColumn("q_part", upto("_q"))
    right = queries.join(sizes, keys).withColumn("q_part", query_part).withColumn("p_part", upto("_p"))
    left, right = left.drop("_p", "_q"), right.drop("_p", "_q")
    # new names for the columns of one side, so that both may come from one table
    return left, right.select(*[named(c).alias(c) for c in right.columns]), [*keys, "p_part", "q_part"]
