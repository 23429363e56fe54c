"""Arrival queries: the batch form of what the streams keep. The tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import arrivals
from . import bindings as b
from .registry import query


@query("SELECT CAST(user_id AS VARCHAR) AS batch_id, event_id AS source_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS page_number FROM events")
def arrival_numbers(spark: SparkSession, d: str) -> DataFrame:
    """ST1."""
    return arrivals.number_arrivals(arrivals.as_pages(b.table(spark, d, "events")), None).select("batch_id", "source_key", "page_number")


@query("SELECT CAST(user_id AS VARCHAR) AS batch_id, count(*) AS pages, round(sum(least(value, 100.0)), 4) AS confidence_sum, count(*) FILTER (least(value, 100.0) < 55) AS low_words FROM events GROUP BY 1")
def arrival_counters(spark: SparkSession, d: str) -> DataFrame:
    """ST2."""
    return arrivals.running_counters(arrivals.as_pages(b.table(spark, d, "events"))).withColumn("confidence_sum", F.round("confidence_sum", 4))
