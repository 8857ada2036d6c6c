"""Tables behind the dashboard: themes and overall counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.functions.constants import OUTLIER_TOPIC
from reviewloom.functions.display import bar_width, safe_int
from reviewloom.functions.text import escape_html, theme_display
from reviewloom.operators.ranking import top_k
from reviewloom.sources.tables import dataset_exists, model_exists, read_dataset


def first_topics(info: DataFrame, n: int) -> DataFrame:
    """The `n` largest topics, outliers left out."""
    return top_k(info.filter(F.col("topic") != OUTLIER_TOPIC), n, "topic")


def topic_table(info: DataFrame, n: int = 10) -> DataFrame:
    return first_topics(info, n).select(
        safe_int(F.col("topic")).alias("topic"),
        safe_int(F.col("count")).alias("count"),
        escape_html(F.col("name")).alias("name"),
    )


def topic_chart(info: DataFrame, n: int = 8) -> DataFrame:
    """Bars of the theme chart, last topic first, as they are stacked in the plot."""
    shown = first_topics(info, n).withColumn("largest", F.max("count").over(Window.partitionBy()))
    return shown.select(
        safe_int(F.col("topic")).alias("topic"),
        theme_display(F.col("name")).alias("theme"),
        safe_int(F.col("count")).alias("count"),
        bar_width(F.col("count"), F.col("largest")).alias("width_pct"),
    ).orderBy(F.desc("topic"))


def dashboard_counts(corpus: DataFrame, info: DataFrame) -> DataFrame:
    """One row: reviews that can be searched and topics that are not outliers."""
    topics = info.filter(F.col("topic") != OUTLIER_TOPIC).agg(F.count(F.lit(1)).alias("topic_count"))
    return corpus.agg(F.count(F.lit(1)).alias("review_count")).withColumn("topic_count", topics.scalar())


def dashboard_stats(spark: SparkSession, corpus: str, index: str, info: str, model: str) -> DataFrame:
    """The counts and what is ready, from stored outputs; a missing one counts as 0."""
    has_corpus, has_info = dataset_exists(spark, corpus), dataset_exists(spark, info)
    nothing = spark.range(0)
    counts = dashboard_counts(
        read_dataset(spark, corpus) if has_corpus else nothing,
        read_dataset(spark, info) if has_info else nothing.select(F.lit(0).alias("topic")),
    )
    return counts.select(
        "review_count",
        "topic_count",
        F.lit(model_exists(spark, model)).alias("model_ready"),
        F.lit(has_corpus and dataset_exists(spark, index)).alias("search_ready"),
        F.lit(has_info).alias("topics_ready"),
    )
