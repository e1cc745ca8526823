"""Scores that follow deliveries as they arrive (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepmill.functions.schema import PREDICTION
from stepmill.operators.scoring import per_row


def stream_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions as a stream of JSON files."""
    return spark.readStream.schema(PREDICTION).json(folder)


def score_stream(stream: DataFrame, rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Join every new prediction with its row and append the scored rows as Parquet; each batch is written once.

    The rows are a static table; nothing is kept as state, so the stream can
    run without end.
    """
    return per_row(rows, stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_accuracy(stream: DataFrame, rows: DataFrame) -> DataFrame:
    """(split, n, element_acc, brier) so far, for complete or update mode; the state is one row for each split."""
    return per_row(rows, stream).groupBy("split").agg(F.count("*").alias("n"), F.avg(F.col("element_correct").cast("int")).alias("element_acc"), F.avg("brier").alias("brier"))
