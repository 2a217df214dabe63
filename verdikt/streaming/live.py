"""Scoring answers as they arrive. The text functions are plain columns, so they run on a stream unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def scored_stream(answers: DataFrame) -> DataFrame:
    """Letter and correctness of streamed answers (text, choices, gold)."""
    return X.with_letter(answers).withColumn("correct", F.col("letter").eqNullSafe(F.col("gold")))


def running_accuracy(scored: DataFrame, at: str = "arrived", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Accuracy per arm and event-time window; answers later than the watermark are left out and state stays bounded."""
    return scored.withWatermark(at, late).groupBy(F.window(at, window), "model", "experiment").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
