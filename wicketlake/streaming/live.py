"""Live ingest of completed matches, duplicates, alerts and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wicketlake.schemas import DOCUMENT_DDL
from wicketlake.sources import feed as fd
from wicketlake.streaming import store

RUN_DDL = "batch_id bigint, completed bigint, ingested bigint, skipped bigint, failed bigint"


def not_archived(feed: DataFrame, archived: DataFrame) -> DataFrame:
    """Feed items whose match has no document yet; ``archived`` is (``match_id``)."""
    return feed.join(archived.select(F.col("match_id").alias("id")).distinct(), "id", "left_anti")


def first_per_match(stream: DataFrame, at: str = "at", lookback: str = "24 hours") -> DataFrame:
    """Each match once within the lookback; later rows than that are dropped as late."""
    return stream.withWatermark(at, lookback).dropDuplicatesWithinWatermark(["id"])


def start_ingest(
    stream: DataFrame,
    root: str,
    with_narrative,
    archived: DataFrame | None = None,
    reference: Column | None = None,
    lookback_hours: int = 24,
    once: bool = True,
) -> StreamingQuery:
    """Completed, recent, not yet archived items of a normalised feed, merged into the document store below ``root``.

    ``with_narrative`` adds ``winner`` and ``narrative`` to completed items. An item that gives no document (no id or
    no account) is counted as failed and does not stop the others.

    Matches seen within the lookback are kept in state and do not count again, and older items are not recent, so no
    batch looks up what earlier ones did; ``skipped`` are items of ``archived``. A batch is evaluated once: its documents are written, what was completed and failed is
    observed on the way, and the written ones replace the parts of the store that they fall into.
    """
    reference = F.current_timestamp() if reference is None else reference
    recent = fd.recent_completed(stream, reference, lookback_hours).withColumn("at", fd.at())
    fresh_once = first_per_match(recent, "at", f"{max(1, lookback_hours)} hours").drop("at")

    def ingest(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen, told = Observation(), Observation()
        done = batch.observe(seen, F.count(F.lit(1)).alias("completed"))
        fresh = done if archived is None else not_archived(done, archived.select("match_id"))
        account = with_narrative(fresh)
        broken = (F.coalesce(F.trim("id"), F.lit("")) == "") | (F.coalesce(F.trim("narrative"), F.lit("")) == "")
        account = account.withColumn("broken", broken)
        account = account.observe(told, F.count_if("broken").alias("failed"), F.count_if(~F.col("broken")).alias("ingested"))
        docs = fd.live_docs(account.where(~F.col("broken")))
        docs.write.mode("overwrite").parquet(f"{root}/incoming/batch={batch_id}")
        counts = [int(seen.get["completed"]), int(told.get["ingested"]), int(told.get["failed"])]
        if counts[0] == 0:  # a batch that only moves the watermark
            return
        store.merge(spark.read.schema(DOCUMENT_DDL).parquet(f"{root}/incoming/batch={batch_id}"), root, batch_id)
        row = (batch_id, *counts[:2], counts[0] - counts[1] - counts[2], counts[2])
        spark.createDataFrame([row], RUN_DDL).coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/batch={batch_id}")

    writer = fresh_once.writeStream.foreachBatch(ingest).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def ingested_docs(spark, root: str) -> DataFrame:
    return store.read_store(spark, root)


def ingest_runs(spark, root: str) -> DataFrame:
    return spark.read.schema(RUN_DDL).parquet(f"{root}/runs")


def start_alerts(stream: DataFrame, root: str, once: bool = True) -> StreamingQuery:
    """Alert rows of every batch: the first live item of each poll."""

    def alert(batch: DataFrame, batch_id: int) -> None:
        fd.live_alerts(batch).write.mode("overwrite").parquet(f"{root}/alerts/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(alert).option("checkpointLocation", f"{root}/alerts-checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
