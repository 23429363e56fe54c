"""Pages that arrive in files: numbering and storing each batch of them, and running counters.

The store is a folder of versions; a micro-batch writes the pages of its batches as version <batch id>, so a restart
that repeats a micro-batch overwrites what it wrote and changes nothing. There is one writer. Beside the store stand the
numbers of pages by batch; keys that were seen are the stream's state (for very many of them set the session's state store
provider to RocksDB). So a micro-batch reads no page that is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import recognition, records


def read_arrivals(spark: SparkSession, path: str, *, files_per_trigger: int = 1) -> DataFrame:
    """batch_id, source_key, arrival, confidence, low: pages as a stream of Parquet files with a declared schema."""
    raw = spark.readStream.schema(schemas.ARRIVALS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return as_pages(raw)


def as_pages(events: DataFrame) -> DataFrame:
    confidence = F.least(F.col("value"), F.lit(100.0))
    return events.select(F.col("user_id").cast("string").alias("batch_id"), F.col("event_id").alias("source_key"), F.struct("ts", "event_id").alias("arrival"), confidence.alias("confidence"), recognition.low_confidence(confidence).alias("low"))


def number_arrivals(new: DataFrame, stored: DataFrame | None) -> DataFrame:
    """New pages, without those that are stored, numbered behind the stored pages of their batch."""
    if stored is None:
        stored = new.limit(0).withColumn("page_number", F.lit(0))
    fresh = new.dropDuplicates(["batch_id", "source_key"]).join(stored.select("batch_id", "source_key"), ["batch_id", "source_key"], "left_anti")
    return records.number_appended(fresh, stored.withColumn("is_deleted", F.lit(False)))


def store_arrivals(arrivals: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Starts the writer and lets it take all that is there."""
    counts = store.rstrip("/") + "-counts"

    def append(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, f"version={batch_id}"
        if batch_id:
            have = spark.read.schema("batch_id string, have long").parquet(f"{counts}/version={batch_id - 1}")
        else:
            have = spark.createDataFrame([], "batch_id string, have long")
        records.number_behind(batch, have).write.mode("overwrite").parquet(f"{store}/{version}")
        added = spark.read.parquet(f"{store}/{version}").groupBy("batch_id").agg(F.count("*").alias("have"))
        have.unionByName(added).groupBy("batch_id").agg(F.sum("have").alias("have")).write.mode("overwrite").parquet(f"{counts}/{version}")

    return arrivals.dropDuplicates(["batch_id", "source_key"]).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counters(arrivals: DataFrame) -> DataFrame:
    """batch_id, pages, confidence_sum, low_words: for the update mode; the mean is confidence_sum / pages."""
    return arrivals.groupBy("batch_id").agg(F.count("*").alias("pages"), F.sum("confidence").alias("confidence_sum"), F.count_if("low").alias("low_words"))


def store_counters(arrivals: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps the latest counters of each batch: every micro-batch writes the rows it changed as a
    version, and readers take the newest row of a batch."""

    def upsert(changed: DataFrame, batch_id: int) -> None:
        changed.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{store}/v={batch_id}")

    return running_counters(arrivals).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counters(spark: SparkSession, store: str) -> DataFrame:
    rows = spark.read.parquet(store)
    return rows.groupBy("batch_id").agg(F.max_by(F.struct("pages", "confidence_sum", "low_words"), "version").alias("c")).select("batch_id", "c.*")
