"""Exact similarity search: one query, many queries, and through cells."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.constants import HIT_CHARS, SCORE_DIGITS
from reviewloom.functions.display import result_label
from reviewloom.functions.text import escape_html, highlight, is_blank, shorten
from reviewloom.functions.vectors import dot, literal_vector
from reviewloom.operators.batch import DenseScores, batch_top_k, vector_matrix
from reviewloom.operators.embedding import embed_hashed, embed_query
from reviewloom.operators.ranking import best_first, check_k, join_counted, rank_within, top_k
from reviewloom.session import stored

HIT_SCHEMA = "rank int, score double, review_id bigint, summary string, review string, rating int"


def hit_columns(corpus: DataFrame) -> list:
    """Display columns of a hit; a corpus without ratings gives none."""
    summary = F.col("summary") if "summary" in corpus.columns else F.lit(None)
    rating = F.col("Score") if "Score" in corpus.columns else F.lit(None)
    return [
        summary.cast("string").alias("summary"),
        F.col("text").alias("review"),
        rating.cast("int").alias("rating"),
    ]


def score_vectors(index: DataFrame, query_vector: Sequence[float]) -> DataFrame:
    """(review_id, score) of every indexed review for one query."""
    score = F.round(dot(F.col("embedding"), literal_vector(query_vector)), SCORE_DIGITS)
    return index.select("review_id", F.nanvl(score, F.lit(None)).alias("score"))


def nearest(index: DataFrame, query_vector: Sequence[float], k: int = 5) -> DataFrame:
    """The `k` best (review_id, score) rows, best first, ties by the smaller id."""
    best = top_k(score_vectors(index, query_vector), k, *best_first())
    # Rows without a vector sort last; dropped here, the scores are computed once.
    return best.filter(F.col("score").isNotNull())


def fetch_hits(best: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Ranked hits with their texts, for one query's `best` rows.

    The `k` ranked keys are as few as the caller asked for; the texts are looked up by key.
    """
    ranked = rank_within(best.withColumn("_q", F.lit(0)), ["_q"], best_first(), check_k(k)).drop("_q")
    hits = corpus.select("review_id", *hit_columns(corpus)).join(ranked, "review_id")
    return hits.select("rank", "score", "review_id", "summary", "review", "rating").orderBy("rank")


def search_reviews(
    query: str | None,
    embedder: PipelineModel,
    index: DataFrame,
    corpus: DataFrame,
    k: int = 5,
) -> DataFrame:
    """Reviews nearest to a free-text query; a blank query finds nothing."""
    spark = corpus.sparkSession
    text = (query or "").strip()
    if not text:
        return spark.createDataFrame([], HIT_SCHEMA)
    return fetch_hits(nearest(index, embed_query(spark, text, embedder), k), corpus, k)


# -- many queries ---------------------------------------------------------


def nearest_batch(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The `k` best reviews for each (query_id, embedding) row, with ranks."""
    return batch_top_k(index, queries, DenseScores(), k)


def search_reviews_batch(
    queries: DataFrame, embedder: PipelineModel, index: DataFrame, k: int = 5
) -> DataFrame:
    """Ranked reviews for each (query_id, text) row; blank queries find nothing."""
    asked = queries.filter(~is_blank(F.col("text"))).select(F.col("query_id").alias("review_id"), "text")
    vectors = embed_hashed(asked, embedder).withColumnRenamed("review_id", "query_id")
    return nearest_batch(index, vectors, k)


def with_texts(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add the display columns to (query_id, rank, score, review_id) rows.

    The hit reviews are looked up once each, however many queries found them.
    The ranks are few and read twice, so they are stored.
    """
    ranked = stored(ranked)
    found = ranked.groupBy("review_id").agg(F.count(F.lit(1)).alias("_hits"))
    texts = corpus.join(found, "review_id").select("review_id", "_hits", *hit_columns(corpus))
    joined = join_counted(ranked, texts, "review_id", "_hits", ranked.count(), spread="query_id", sizes=found)
    return joined.drop("_hits")


# -- through cells --------------------------------------------------------


def fit_cells(index: DataFrame, n_cells: int = 256, seed: int = 42) -> list[list[float]]:
    """Unit centres of a spherical k-means over all vectors.

    The centres only decide how well a search can skip cells, never its result.
    """
    # A zero vector has no direction; such rows take no part in placing the centres.
    known = index.filter(F.exists("embedding", lambda x: x != 0)).select("review_id", "embedding")
    features = stored(known).select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(features)
    centres = [np.asarray(c, dtype=np.float64) for c in model.clusterCenters()]
    return [list(c / (np.linalg.norm(c) or 1.0)) for c in centres]


def with_cells(index: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Add each vector's nearest centre as `cell` and its cosine as `closeness`.

    Rows without a vector can be no hit and are dropped.
    """
    matrix = np.array(centres)
    shared = index.sparkSession.sparkContext.broadcast(matrix)
    schema = T.StructType(
        [index.schema["review_id"], index.schema["embedding"], T.StructField("cell", T.IntegerType()),
         T.StructField("closeness", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = vector_matrix(batch.column("embedding"), shared.value.shape[1]) @ shared.value.T
            cell = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("review_id"), batch.column("embedding"), pa.array(cell.astype(np.int32)),
                 pa.array(near[np.arange(len(cell)), cell])],
                names=["review_id", "embedding", "cell", "closeness"],
            )

    return index.select("review_id", "embedding").filter("embedding IS NOT NULL").mapInArrow(run, schema)


def write_cells(cells: DataFrame, path: str) -> None:
    """Write one folder per cell; large cells are split over several tasks."""
    cells.hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(path)


def cell_bounds(cells: DataFrame) -> DataFrame:
    """Per cell: rows and the cosine of the vector furthest from the centre."""
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("closeness").alias("furthest"))


def nearest_in_cells(
    cells: DataFrame,
    centres: list[list[float]],
    bounds: list[tuple[int, int, float]],
    query_vector: Sequence[float],
    k: int = 5,
) -> DataFrame:
    """Same result as `nearest` for a unit query, reading only cells that can matter.

    `bounds` holds the rows of `cell_bounds`. No vector of a cell can be closer
    to the query than the angle to its centre less the cell's radius. The most
    promising cells that hold `k` rows give a k-th score; all cells whose bound
    reaches it are then searched.
    """
    query = np.asarray(query_vector, dtype=np.float64)
    to_centre = np.arccos(np.clip(np.array(centres) @ query, -1.0, 1.0))
    reach = {}
    for cell, rows, furthest in bounds:  # one row per centre at most
        radius = math.acos(max(-1.0, min(1.0, furthest)))
        reach[cell] = (math.cos(max(0.0, to_centre[cell] - radius)), rows)
    ordered = sorted(reach, key=lambda c: -reach[c][0])
    first, held = [], 0
    for cell in ordered:
        if held >= k:
            break
        first.append(cell)
        held += reach[cell][1]
    if not first:
        return nearest(cells, query_vector, k)
    seen = stored(nearest(cells.filter(F.col("cell").isin(first)), query_vector, k))
    worst = seen.agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).first()
    floor = worst["score"] if worst["n"] >= k else -2.0
    # Stored vectors are single precision, so their length differs slightly from one.
    matter = [c for c in ordered if c not in first and reach[c][0] >= floor - 1e-5]
    rest = nearest(cells.filter(F.col("cell").isin(matter)), query_vector, k) if matter else seen.limit(0)
    return top_k(seen.unionByName(rest), k, *best_first())


# -- result tables --------------------------------------------------------


def relevance_table(hits: DataFrame) -> DataFrame:
    """Rows of the relevance chart: labels and scores, worst hit first."""
    return hits.select("rank", result_label(F.col("rank")).alias("label"), "score").orderBy(F.desc("rank"))


def snippets(hits: DataFrame, query: str = "query", max_chars: int = HIT_CHARS) -> DataFrame:
    """Shortened, escaped and highlighted text of each hit for its query column."""
    shaped = hits.withColumn("snippet", highlight(shorten(F.col("review"), max_chars), F.col(query)))
    return shaped.withColumn("summary_html", escape_html(F.coalesce(F.col("summary"), F.lit(""))))
