"""The batch run: clean, search corpus, model, index, themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewloom.functions.constants import MIN_TOPIC_SIZE
from reviewloom.operators.embedding import embed_hashed, fit_hashed_embedder
from reviewloom.operators.prepare import clean_reviews, cluster_input, negative_reviews, search_corpus
from reviewloom.operators.reports import dashboard_stats
from reviewloom.operators.sentiment import train_sentiment
from reviewloom.operators.themes import assign_themes, fit_theme_table, topic_info
from reviewloom.session import count_stored, discard_stored
from reviewloom.sources.tables import load_model, read_dataset, save_model, write_dataset, write_keyed

OUTPUTS = {
    "clean": "reviews_binary",
    "negative": "negative_reviews",
    "corpus": "search_reviews",
    "index": "search_embeddings",
    "embedder": "models/embedder",
    "sentiment": "models/sentiment",
    "metrics": "sentiment_metrics",
    "assigned": "negative_reviews_with_topics",
    "topics": "topic_info",
    "themes": "models/themes",
}


def output_paths(out: str) -> dict[str, str]:
    return {name: f"{out}/{folder}" for name, folder in OUTPUTS.items()}


def run_all(
    spark: SparkSession,
    raw: DataFrame,
    out: str,
    sample_size: int | None = None,
    cluster_sample: int | None = None,
    min_topic_size: int = MIN_TOPIC_SIZE,
    topic_counts: tuple[int, ...] = (5, 10, 20),
    embedding_dims: int = 512,
) -> dict[str, str]:
    """Run all stages; each writes its output and later ones read it back.

    Returns the output paths. A run that was cut short can be started again: a
    stage overwrites only its own output. The intermediate tables of the run are
    deleted at its end.
    """
    paths, keep = output_paths(out), count_stored(spark)
    write_dataset(clean_reviews(raw, sample_size), paths["clean"])
    clean = read_dataset(spark, paths["clean"], "clean reviews")

    write_dataset(negative_reviews(clean), paths["negative"])
    write_keyed(search_corpus(clean), paths["corpus"])
    corpus = read_dataset(spark, paths["corpus"], "search corpus")

    trained = train_sentiment(clean)
    save_model(trained.pipeline, paths["sentiment"])
    write_dataset(trained.metrics, paths["metrics"])

    save_model(fit_hashed_embedder(corpus, embedding_dims), paths["embedder"])
    embedder = load_model(spark, paths["embedder"])
    write_keyed(embed_hashed(corpus, embedder), paths["index"])

    negatives = read_dataset(spark, paths["negative"], "negative reviews")
    themed = cluster_input(negatives, cluster_sample)
    write_dataset(fit_theme_table(themed, embedder, list(topic_counts), min_topic_size), paths["themes"])
    fitted = read_dataset(spark, paths["themes"], "theme model")
    write_dataset(themed.join(assign_themes(themed, embedder, fitted), "review_id"), paths["assigned"])
    write_dataset(topic_info(read_dataset(spark, paths["assigned"], "topic assignments")), paths["topics"])
    discard_stored(spark, keep)
    return paths


def run_stats(spark: SparkSession, out: str) -> DataFrame:
    """Dashboard counts of a finished or partial run."""
    paths = output_paths(out)
    return dashboard_stats(spark, paths["corpus"], paths["index"], paths["topics"], paths["sentiment"])
