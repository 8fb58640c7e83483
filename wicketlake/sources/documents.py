"""Document table: filtered reads, upserts and build manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicketlake.operators.aggregates import latest_per_key
from wicketlake.schemas import DOCUMENT_DDL
from wicketlake.session import run_folder

STORED_COLUMNS = {"id", "doc_type", "document"}


def metadata_equals(where: dict) -> Column:
    """Conjunction of equalities; real columns are pushed to the scan, others read the metadata map."""
    tests = [
        (F.col(k) if k in STORED_COLUMNS else F.try_element_at("metadata", F.lit(k))) == F.lit(str(v))
        for k, v in where.items()
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def get_docs(docs: DataFrame, where: dict | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filtered page of documents in id order."""
    rows = docs.filter(metadata_equals(where or {})).orderBy("id")
    if offset:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit is not None else rows


def valid_updates(updates: DataFrame) -> DataFrame:
    trimmed = updates.withColumn("id", F.trim("id")).withColumn("document", F.trim("document"))
    return trimmed.filter("coalesce(id, '') != '' AND coalesce(document, '') != ''")


def upsert_docs(target: DataFrame, updates: DataFrame, order: list) -> DataFrame:
    """``target`` with ``updates`` in place of rows of the same id.

    Among several updates of one id the first by ``order`` stays, such as the latest arrival first.
    """
    last = latest_per_key(valid_updates(updates), ["id"], order)
    last = last.select(*target.columns)
    return target.join(last.select("id"), "id", "left_anti").unionByName(last)


def write_docs(docs: DataFrame, root: str) -> str:
    """A new version folder, partitioned by ``doc_type`` so that type filters prune files."""
    spark = docs.sparkSession
    path = f"{root.rstrip('/')}/v-{run_folder(spark, 'docs').rsplit('-', 1)[1]}"
    docs.write.partitionBy("doc_type").parquet(path)
    return path


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT_DDL).parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON record; the frame is a single aggregated row."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def archive_manifest(docs: DataFrame, summary: DataFrame, built_at: Column | None = None) -> DataFrame:
    counts = docs.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("document_count"),
        *[
            F.coalesce(F.sum(F.when(F.col("doc_type") == kind, F.col("n"))), F.lit(0)).alias(name)
            for kind, name in (
                ("player_profile", "player_docs"),
                ("team_summary", "team_docs"),
                ("match_summary", "match_docs"),
            )
        ],
    )
    # Both sides are one row by construction.
    keyed = summary.select(F.lit(1).alias("_k"), F.struct("*").alias("dataset_summary"))
    return (
        counts.withColumn("_k", F.lit(1))
        .join(keyed, "_k")
        .drop("_k")
        .withColumn("built_at", built_at if built_at is not None else F.current_timestamp().cast("string"))
    )
