"""Scoring reviews as they arrive."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reviewloom.operators.sentiment import prediction_display, ready_to_score, score_reviews

REVIEW_STREAM_SCHEMA = "review_id bigint, text string"


def read_review_stream(
    spark: SparkSession, folder: str, schema: str = REVIEW_STREAM_SCHEMA, max_files: int = 1_000
) -> DataFrame:
    """Parquet files that land in a folder, at most `max_files` per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def scored_stream(reviews: DataFrame, model: PipelineModel) -> DataFrame:
    """Label and confidence of each review; keeps no state between triggers."""
    return prediction_display(score_reviews(ready_to_score(reviews), model))


def start_scoring(scored: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append scored reviews to `out`; a restart goes on from `checkpoint`."""
    writer = scored.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", out).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
