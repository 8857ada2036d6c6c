"""Turning texts into unit vectors: stored, hashed, or by a caller's model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.vectors import unit

BATCH = 64
NOT_WORD = r"[^\p{L}\p{N}_]+"


def filled(corpus: DataFrame) -> DataFrame:
    """(review_id, text) with a missing text read as empty."""
    return corpus.select("review_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fit_hashed_embedder(corpus: DataFrame, dims: int = 512) -> PipelineModel:
    """Weigh hashed words by rarity; the fitted state is one number per dimension."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=NOT_WORD),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="vector", p=2.0),
    ]
    return Pipeline(stages=stages).fit(filled(corpus))


def embed_hashed(corpus: DataFrame, embedder: PipelineModel) -> DataFrame:
    """(review_id, embedding) with unit vectors from a hashed embedder."""
    vectors = embedder.transform(filled(corpus))
    return vectors.select("review_id", vector_to_array("vector", "float32").alias("embedding"))


def embed_query(spark: SparkSession, query: str, embedder: PipelineModel) -> list[float]:
    """Unit vector of one query text."""
    row = spark.createDataFrame([(0, query)], "review_id bigint, text string")
    return [float(x) for x in embed_hashed(row, embedder).first()["embedding"]]


def embed_with_model(corpus: DataFrame, make_predict: Callable, batch_size: int = BATCH) -> DataFrame:
    """(review_id, embedding) from a caller's model, loaded once per Python worker.

    `make_predict()` returns a function from an array of texts to a 2-D array.
    """

    def make_unit_predict() -> Callable:
        predict = make_predict()

        def run(texts: np.ndarray) -> np.ndarray:
            rows = np.asarray(predict(texts), dtype=np.float64)
            length = np.linalg.norm(rows, axis=1, keepdims=True)
            return (rows / np.where(length == 0, 1.0, length)).astype(np.float32)

        return run

    encode = predict_batch_udf(make_unit_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return filled(corpus).select("review_id", encode("text").alias("embedding"))


def without_vector(corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    """Keys of corpus reviews that an index from stored vectors cannot hold."""
    known = vectors.filter(F.col("embedding").isNotNull()).select("review_id")
    return corpus.select("review_id").join(known, "review_id", "left_anti")


def build_index(corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    """Unit vectors of the corpus reviews, for vectors that are stored apart.

    Only keys of the corpus are read, so no text takes part in the shuffle, and
    a search on the index needs no further check against the corpus. Vectors
    made from the corpus itself (`embed_hashed`, `embed_with_model`) are an
    index as they are.
    """
    return (
        vectors.join(corpus.select("review_id"), "review_id", "left_semi")
        .select("review_id", unit(F.col("embedding")).alias("embedding"))
    )
