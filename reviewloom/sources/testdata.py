"""Review-shaped views over the driver's test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled documents are rated by their labels, the others by a hash of the text, so
#: that neither length nor key plays a part; one hash in 256 gives no rating.
SCORES = """
CASE WHEN l.quality = 0 AND l.toxic = 1 THEN 1
     WHEN l.quality = 0 THEN 2
     WHEN l.quality = 1 AND l.toxic = 1 THEN 4
     WHEN l.quality = 1 THEN 5
     WHEN substr(md5(d.text), 1, 2) = '00' THEN NULL
     WHEN substr(md5(d.text), 1, 1) < '3' THEN 1
     WHEN substr(md5(d.text), 1, 1) < '6' THEN 2
     WHEN substr(md5(d.text), 1, 1) < '8' THEN 3
     WHEN substr(md5(d.text), 1, 1) < 'c' THEN 4
     WHEN d.text IS NOT NULL THEN 5
END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a raw review, with its whole text.

    Documents from one source have no summary. No row is left out here.
    """
    docs = table(spark, sf_dir, "documents").alias("d")
    labels = table(spark, sf_dir, "labels").alias("l")
    return docs.join(labels, F.expr("d.doc_id = l.doc_id"), "left").select(
        F.col("d.doc_id").alias("Id"),
        F.col("d.text").alias("Text"),
        F.expr("CASE WHEN d.source <> 'src0' THEN concat('Review from ', d.source) END").alias("Summary"),
        F.expr(SCORES).alias("Score"),
        F.expr("CASE WHEN l.quality IS NULL THEN 0 ELSE l.quality END").alias("HelpfulnessNumerator"),
        F.lit(1).alias("HelpfulnessDenominator"),
        F.col("d.source").alias("source"),
    )


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("review_id"), "embedding")


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as (review_id, text, label)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"), F.col("quality").alias("label"))
    return docs.join(labels, "review_id")
