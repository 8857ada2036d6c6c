"""Running counts per predicted label over a stream of reviews.

Reviews may arrive more than once: a state store remembers the keys it has seen, so each
is counted once, restarts included. A trigger's counts are written under its own number
and replaced if the trigger is repeated after a failure; the distribution is their
sum. Both live in shared folders, none in the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom.sources.tables import read_dataset


def first_arrivals(reviews: DataFrame, event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """One row per review_id, the first to arrive; rows without a key are dropped.

    Without an event time every key is remembered. With one, keys are forgotten after
    `late`, which bounds the state: a copy that comes later counts again.
    """
    keyed = reviews.filter("review_id IS NOT NULL")
    if event_time is None:
        return keyed.dropDuplicates(["review_id"])
    return keyed.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["review_id"])


def start_counting(
    reviews: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Count labels of arriving (review_id, text) rows under `out`; a restart goes on from `checkpoint`.

    `score` gives (review_id, label_name) rows for a batch of reviews.
    """

    def count(batch: DataFrame, number: int) -> None:
        counts = score(batch).groupBy("label_name").agg(F.count(F.lit(1)).alias("count"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = first_arrivals(reviews).writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def distribution(spark: SparkSession, out: str) -> DataFrame:
    """(label_name, count) over all triggers so far, most frequent first."""
    counts = read_dataset(spark, out, "label counts").groupBy("label_name").agg(F.sum("count").alias("count"))
    return counts.orderBy(F.desc("count"), "label_name")
