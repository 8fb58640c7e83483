"""A document store that batches of a stream merge into: parts by hash of the id, versions named by batch.

``root/store/version=<batch>/part=<p>`` holds a whole part as of a batch; ``root/manifest/version=<batch>`` lists the
parts that the batch replaced. The current version of a part is its latest in the manifest. A batch reads and
writes only the parts its documents fall into, and a repeated batch replaces its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicketlake.schemas import DOCUMENT_DDL
from wicketlake.sources.documents import upsert_docs

PARTS = 64
MANIFEST_DDL = "part int, version bigint"


def part_of(id_column: str, parts: int):
    return F.pmod(F.xxhash64(id_column), F.lit(parts)).cast("int")


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def current_parts(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """The version of each part, at most one row for each part, as of the batches before ``before``."""
    if not path_exists(spark, f"{root}/manifest"):
        return {}
    rows = spark.read.schema(MANIFEST_DDL).parquet(f"{root}/manifest")
    if before is not None:
        rows = rows.where(F.col("version") < before)
    return {r["part"]: r["version"] for r in rows.groupBy("part").agg(F.max("version").alias("version")).collect()}


def read_parts(spark: SparkSession, root: str, parts: dict[int, int]) -> DataFrame:
    paths = [f"{root}/store/version={v}/part={p}" for p, v in sorted(parts.items())]
    return spark.read.schema(DOCUMENT_DDL).parquet(*paths) if paths else spark.createDataFrame([], DOCUMENT_DDL)


def read_store(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """All documents, each once, as of the last batch or of the batches before ``before``."""
    return read_parts(spark, root, current_parts(spark, root, before))


def merge(docs: DataFrame, root: str, version: int, parts: int = PARTS) -> list[int]:
    """Put ``docs`` (read twice: give a written table) in place of documents of the same id; the parts replaced.

    A batch should have an id once; of several, the largest text stays, whatever the order of rows.
    """
    spark = docs.sparkSession
    touched = sorted(r["part"] for r in docs.select(part_of("id", parts).alias("part")).distinct().collect())
    held = current_parts(spark, root, version)
    old = read_parts(spark, root, {p: held[p] for p in touched if p in held})
    merged = upsert_docs(old, docs, [F.desc("document")]).withColumn("part", part_of("id", parts))
    merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/store/version={version}")
    rows = spark.createDataFrame([(p,) for p in touched], "part int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    return touched
