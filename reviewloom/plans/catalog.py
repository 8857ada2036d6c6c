"""Registered queries: each runs over the whole tables of a folder."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.display import class_id, class_name, safe_int
from reviewloom.functions.text import is_blank, query_terms
from reviewloom.functions.vectors import unit
from reviewloom.operators import (
    compressed,
    density,
    embedding,
    epochs,
    hierarchy,
    keywords,
    naive_bayes,
    prepare,
    reports,
    routed,
    sampling,
    search,
    sentiment,
    slots,
    text_search,
    themes,
    word_vectors,
)
from reviewloom.plans import full_run, incremental
from reviewloom.session import ensure_checkpoint_dir, stored
from reviewloom.sources import tables
from reviewloom.sources.testdata import labelled_texts, raw_reviews, stored_vectors, table
from reviewloom.streaming import distribution, scoring

K = 5
SAMPLE_ROWS = 300
CLUSTER_ROWS = 100
TOPIC_ROWS = 50
SLOTS = 256
BUCKETS = 8
RECIPE = epochs.Recipe(epochs=3, steps=2)


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.clean_reviews(raw_reviews(spark, sf))


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.search_corpus(_clean(spark, sf))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.build_index(_corpus(spark, sf), stored_vectors(spark, sf))


def _mean_vector(spark: SparkSession, sf: str) -> list[float]:
    """Unit mean of all stored vectors, the query of the single searches."""
    vectors = stored_vectors(spark, sf).select(array_to_vector("embedding").alias("v"))
    mean = vectors.select(vector_to_array(Summarizer.mean(F.col("v"))).alias("mean"))
    return list(mean.select(unit(F.col("mean"), "double").alias("unit")).first()["unit"])


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _text_ranks(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    return text_search.search_texts(text_search.text_index(_corpus(spark, sf)), _queries(spark, sf), k)


def _text_hits(spark: SparkSession, sf: str) -> DataFrame:
    return search.with_texts(_text_ranks(spark, sf), _corpus(spark, sf))


def _source_topics(spark: SparkSession, sf: str) -> DataFrame:
    """All clean reviews with their source as the given cluster."""
    clean = prepare.clean_reviews(raw_reviews(spark, sf), carry=("source",))
    return themes.assign_topics(clean.select("review_id", "text", "source"), "source")


def _topic_info(spark: SparkSession, sf: str) -> DataFrame:
    return themes.topic_info(_source_topics(spark, sf))


def source_profile(spark, sf):
    return tables.source_profile(raw_reviews(spark, sf))


def source_preview(spark, sf):
    return tables.preview(raw_reviews(spark, sf), "Id")


def clean_reviews(spark, sf):
    return _clean(spark, sf)


def label_distribution(spark, sf):
    return prepare.label_distribution(_clean(spark, sf))


def sample_exact_n(spark, sf):
    return prepare.clean_reviews(raw_reviews(spark, sf), SAMPLE_ROWS).select("review_id", "label", "text")


def negative_reviews(spark, sf):
    return prepare.negative_reviews(_clean(spark, sf))


def search_corpus(spark, sf):
    return _corpus(spark, sf)


def cluster_input(spark, sf):
    return prepare.cluster_input(prepare.negative_reviews(_clean(spark, sf)))


def cluster_input_sample(spark, sf):
    return prepare.cluster_input(prepare.negative_reviews(_clean(spark, sf)), CLUSTER_ROWS)


def index_build(spark, sf):
    cells = _index(spark, sf).select("review_id", F.posexplode("embedding"))
    return cells.select("review_id", F.col("pos").alias("dim"), F.round(F.col("col").cast("double"), 6).alias("value"))


def index_bucketed(spark, sf):
    """Corpus and index saved as bucketed tables and joined on their key without an exchange."""
    tag = uuid.uuid4().hex[:12]
    corpus = tables.write_bucketed(_corpus(spark, sf), f"corpus_{tag}", _folder(spark, "corpus"), BUCKETS)
    vectors = tables.write_bucketed(stored_vectors(spark, sf), f"vectors_{tag}", _folder(spark, "vectors"), BUCKETS)
    joined = corpus.select("review_id", "label").hint("merge").join(vectors, "review_id")
    cells = joined.select("review_id", F.posexplode(unit(F.col("embedding"))))
    return cells.select("review_id", F.col("pos").alias("dim"), F.round(F.col("col").cast("double"), 6).alias("value"))


def index_missing(spark, sf):
    """Corpus reviews that have no stored vector and would be found by no search."""
    return embedding.without_vector(_corpus(spark, sf), stored_vectors(spark, sf))


def index_shape(spark, sf):
    return tables.vector_shape(_index(spark, sf))


def search_topk(spark, sf):
    best = search.nearest(_index(spark, sf), _mean_vector(spark, sf), K)
    return search.fetch_hits(best, _corpus(spark, sf), K)


def search_relevance(spark, sf):
    return search.relevance_table(search_topk(spark, sf)).select("label", "score")


def search_pruned(spark, sf):
    """Search on the index as it is laid out for it: one folder per cell."""
    index = stored(_index(spark, sf))
    centres = search.fit_cells(index, n_cells=16)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
    search.write_cells(search.with_cells(index, centres), path)
    cells = spark.read.parquet(path)
    bounds = [tuple(r) for r in search.cell_bounds(cells).collect()]
    return search.nearest_in_cells(cells, centres, bounds, _mean_vector(spark, sf), 10)


def search_batch_topk(spark, sf):
    asked = stored_vectors(spark, sf).withColumnRenamed("review_id", "query_id")
    return search.nearest_batch(_index(spark, sf), asked, 10)


def search_compressed(spark, sf):
    """The batch search over compressed vectors, exact by its error bounds; every hundredth vector as a query."""
    index = stored(_index(spark, sf))
    books = compressed.fit_code_books(index, codes=32)
    asked = stored_vectors(spark, sf).filter("review_id % 100 = 0").withColumnRenamed("review_id", "query_id")
    codes = stored(compressed.compress(index, books))
    return compressed.nearest_compressed(index, codes, books, asked, 10, exact=True)


def search_batch_routed(spark, sf):
    """The batch search through cells: every stored vector as a query, over the indexed reviews."""
    index = stored(_index(spark, sf))
    centres = search.fit_cells(index, n_cells=16)
    cells = stored(search.with_cells(index, centres))
    bounds = [tuple(r) for r in search.cell_bounds(cells).collect()]
    asked = stored_vectors(spark, sf).withColumnRenamed("review_id", "query_id")
    return routed.nearest_batch_in_cells(cells, centres, bounds, asked, 10)


def search_text_tfidf(spark, sf):
    return _text_ranks(spark, sf, 10)


def search_snippets(spark, sf):
    shaped = search.snippets(_text_hits(spark, sf).join(_queries(spark, sf), "query_id"), "text")
    return shaped.select("query_id", "rank", "review_id", "snippet", "summary_html")


def search_free_text(spark, sf):
    """Free-text queries, a blank and a missing one among them, over vectors of hashed words."""
    corpus = _corpus(spark, sf)
    weights = stored(slots.fit_slots(corpus, dims=SLOTS))
    index = slots.embed_slots(corpus, weights, dims=SLOTS)
    blank = spark.createDataFrame([(-1, "   "), (-2, None)], "query_id bigint, text string")
    asked = _queries(spark, sf).unionByName(blank).filter(~is_blank(F.col("text")))
    return search.nearest_batch(index, slots.embed_slots(asked, weights, key="query_id", dims=SLOTS), K)


def query_terms_table(spark, sf):
    asked = _queries(spark, sf).select("query_id", F.posexplode(query_terms(F.col("text"))))
    return asked.select("query_id", F.col("pos").alias("position"), F.col("col").alias("term"))


def keyword_counts(spark, sf):
    counts = keywords.keyword_counts(_corpus(spark, sf), order="review_id")
    return counts.withColumnRenamed("first_at", "first_review")


def keywords_topn(spark, sf):
    counts = keywords.keyword_counts(_text_hits(spark, sf), order="rank", groups=["query_id"], text="review")
    return keywords.top_keywords_within(counts, ["query_id"], 8).select("query_id", "rank", "word", "count")


def summary_with_evidence(spark, sf):
    asked = _queries(spark, sf).withColumnRenamed("text", "query")
    rows = keywords.summarise(asked, _text_hits(spark, sf))
    shown = rows.select("query_id", F.col("summary").alias("sentence"), F.explode_outer("supporting_reviews").alias("e"))
    return shown.select("query_id", "sentence", "e.rank", "e.score", "e.review_id", "e.summary", "e.rating")


def topic_sizes(spark, sf):
    given = table(spark, sf, "embeddings").select(F.col("vec_id").alias("review_id"), F.col("label").alias("cluster"))
    return themes.topic_sizes(themes.assign_topics(given, min_size=TOPIC_ROWS))


def topic_names(spark, sf):
    return _topic_info(spark, sf)


def topic_words(spark, sf):
    return themes.topic_words(_source_topics(spark, sf), 10)


def topic_table(spark, sf):
    return reports.topic_table(_topic_info(spark, sf))


def topic_chart(spark, sf):
    return reports.topic_chart(_topic_info(spark, sf))


def themes_density(spark, sf):
    return density.density_themes(stored_vectors(spark, sf), threshold=0.3, min_neighbours=5)


#: Cosine distances at which the hierarchy of all vectors is shown.
HEIGHTS = [0.55, 0.6, 0.65, 0.7, 0.75, 0.8]


def word_pmi(spark, sf):
    """Weights of the word pairs of the whole corpus that the word vectors are made of."""
    corpus = _corpus(spark, sf)
    return word_vectors.positive_pmi(word_vectors.pair_counts(corpus, stored(word_vectors.vocabulary(corpus))))


def words_alike(spark, sf):
    """For every word of the benchmark queries, the words with the most similar learned vectors."""
    vectors = word_vectors.learn_words(_corpus(spark, sf), dims=16, rounds=6)
    asked = text_search.term_counts(_queries(spark, sf), "query_id").select("word")
    return word_vectors.words_alike(vectors, asked, K)


def themes_hierarchy(spark, sf):
    """Components of the density hierarchy at given heights, over all vectors."""
    points, tree = hierarchy.mutual_tree(stored_vectors(spark, sf))
    placed = hierarchy.components_at(points, tree, HEIGHTS).select("level", "point", "component")
    rows = stored_vectors(spark, sf).join(points.select("point", "embedding"), "embedding")
    return placed.join(rows.select("review_id", "point"), "point").select("review_id", "level", "component")


def themes_selected(spark, sf):
    """Themes chosen from the hierarchy by their stability: no number of themes, no threshold."""
    return hierarchy.hierarchy_themes(stored_vectors(spark, sf))


def themes_kmeans(spark, sf):
    texts = prepare.cluster_input(prepare.negative_reviews(_clean(spark, sf)))
    embedder = embedding.fit_hashed_embedder(texts, dims=256)
    topics, _ = themes.kmeans_themes(texts, embedder, [4, 8])
    return topics


def themes_assigned(spark, sf):
    """Themes under given centres, the mean vectors of the labels: reach, size and numbering."""
    given = table(spark, sf, "embeddings").select("label", array_to_vector("embedding").alias("v"))
    centres = given.groupBy(F.col("label").cast("int").alias("cluster")).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("centre"))
    clustered = themes.in_reach(stored_vectors(spark, sf), stored(centres), max_distance=0.8)
    return themes.assign_topics(stored(clustered), "cluster", TOPIC_ROWS)


def split_80_10_10(spark, sf):
    return sampling.with_split(_clean(spark, sf).select("review_id", "label"))


def token_window(spark, sf):
    cut = sentiment.token_window(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_tokens", F.size("tokens").alias("n_kept"), F.md5(F.array_join("tokens", " ")).alias("kept_md5"))


def _rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with class scores made by a rule from their columns."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    scores = F.array(F.lit(0.4) + F.col("toxic") * 0.3, F.col("n_chars") / 2000.0)
    return docs.select("doc_id", F.col("quality").alias("label"), scores.alias("scores"), "n_chars", "lang")


def metrics_binary(spark, sf):
    scored = sentiment.predict_labels(sampling.with_split(_rule_scores(spark, sf), "doc_id"))
    return sentiment.binary_metrics(scored, ["split"]).select(
        "split", "n_rows", *[F.round(c, 9).alias(c) for c in ("accuracy", "f1", "majority_rate")]
    )


def prediction_display(spark, sf):
    scored = sentiment.predict_labels(_rule_scores(spark, sf)).withColumns(
        {"label_name": class_name(F.col("prediction")), "confidence": F.array_max("scores")}
    )
    return sentiment.prediction_display(scored).select(
        "doc_id",
        "label_name",
        class_id(F.col("label_name")).alias("class_id"),
        "display",
        "confidence_text",
        "percent",
        safe_int(F.col("n_chars") / 7.0).alias("whole"),
        safe_int(F.col("lang"), 0).alias("not_a_number"),
    )


def _word_model(spark: SparkSession, sf: str) -> naive_bayes.WordModel:
    return naive_bayes.train_words(labelled_texts(spark, sf))


def sentiment_train_eval(spark, sf):
    metrics = _word_model(spark, sf).metrics
    return metrics.select("split", "n_rows", *[F.round(c, 9).alias(c) for c in ("accuracy", "f1", "majority_rate")])


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    return naive_bayes.score_words(texts, _word_model(spark, sf))


def sentiment_score(spark, sf):
    return sentiment.prediction_display(_scored(spark, sf))


def sentiment_distribution(spark, sf):
    return sentiment.sentiment_distribution(_scored(spark, sf))


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _saved_model(spark: SparkSession, sf: str) -> naive_bayes.WordModel:
    """The word model after it was saved and loaded again."""
    path = _folder(spark, "words")
    naive_bayes.save_words(_word_model(spark, sf), path)
    return naive_bayes.load_words(spark, path)


def sentiment_saved(spark, sf):
    """Scores by a model that was written, read back and used."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    return sentiment.prediction_display(naive_bayes.score_words(texts, _saved_model(spark, sf)))


def _epoch_model(spark: SparkSession, sf: str) -> epochs.EpochModel:
    return epochs.train_epochs(labelled_texts(spark, sf), _folder(spark, "epochs"), RECIPE)


def epoch_metrics(spark, sf):
    """Validation metrics of every epoch and which one is kept."""
    model = _epoch_model(spark, sf)
    shown = [F.round(c, 9).alias(c) for c in ("accuracy", "f1", "majority_rate")]
    return model.metrics.select("epoch", "n_rows", *shown, (F.col("epoch") == model.epoch).alias("kept"))


def epoch_weights(spark, sf):
    """Weights of the epoch that is kept."""
    return _epoch_model(spark, sf).table(spark).select("slot", F.round("weight", 6).alias("weight"))


def sentiment_epochs(spark, sf):
    """All documents scored by the epoch that is kept."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    return epochs.score_epochs(texts, _epoch_model(spark, sf))


def stream_distribution(spark, sf):
    """Label counts of all documents, arriving in two lots with repeats and a restart in between."""
    model, inbox, out, state = _saved_model(spark, sf), *(_folder(spark, n) for n in ("inbox", "counts", "state"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("review_id"), "text")
    early = F.pmod(F.xxhash64("review_id"), F.lit(2)) == 0
    for lot in (texts.filter(early), texts):  # the second lot holds the first one again
        lot.write.mode("append").parquet(inbox)
        arriving = scoring.read_review_stream(spark, inbox)
        distribution.start_counting(arriving, lambda b: naive_bayes.score_words(b, model), out, state, True).awaitTermination()
    return distribution.distribution(spark, out)


def incremental_labels(spark, sf):
    """Label counts after a first load and a run with the new and changed reviews."""
    out, raw = _folder(spark, "increment"), raw_reviews(spark, sf).drop("source")
    late, old = F.pmod(F.xxhash64("Id"), F.lit(100)) == 0, F.pmod(F.xxhash64("Id"), F.lit(100)) == 1
    incremental.add_reviews(spark, raw.filter(~late).withColumn("Score", F.when(old, 6 - F.col("Score")).otherwise(F.col("Score"))), out)
    incremental.add_reviews(spark, raw, out)
    return incremental.current_labels(spark, out)


def run_stage_counts(spark, sf):
    """Rows that each stage of the full run has written."""
    paths = full_run.run_all(spark, raw_reviews(spark, sf), _folder(spark, "run"), topic_counts=(4,), embedding_dims=64)
    counts = [
        tables.read_dataset(spark, paths[name], name).agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n_rows"))
        for name in ("clean", "negative", "corpus", "index", "assigned")
    ]
    return functools.reduce(DataFrame.unionByName, counts)


def dashboard_stats(spark, sf):
    sources = _source_topics(spark, sf).select("review_id", "topic")
    return reports.dashboard_counts(_corpus(spark, sf), themes.topic_sizes(sources))


def reviews_csv_round_trip(spark, sf):
    """Raw reviews written as CSV and read back with their types."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    tables.export_csv(raw_reviews(spark, sf).drop("source"), path)
    return tables.read_reviews_csv(spark, path)


def evidence_snippets(spark, sf):
    """The snippets that back each summary."""
    asked = _queries(spark, sf).withColumnRenamed("text", "query")
    rows = keywords.summarise(asked, _text_hits(spark, sf))
    shown = rows.select("query_id", F.explode("supporting_reviews").alias("e"))
    return shown.select("query_id", "e.rank", "e.review_id", "e.snippet")


def token_windows(spark, sf):
    cut = sentiment.token_windows(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "window", F.size("tokens").alias("n_kept"), F.md5(F.array_join("tokens", " ")).alias("kept_md5"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [
        source_profile, source_preview, clean_reviews, label_distribution, sample_exact_n, negative_reviews,
        search_corpus, cluster_input, index_build, index_shape, search_topk, search_relevance, search_pruned,
        search_batch_topk, search_text_tfidf, search_snippets, search_free_text, keyword_counts, keywords_topn,
        summary_with_evidence, topic_sizes, topic_names, topic_words, topic_table, topic_chart, themes_density,
        themes_kmeans, split_80_10_10, token_window, metrics_binary, prediction_display, sentiment_train_eval,
        sentiment_score, sentiment_distribution, dashboard_stats, cluster_input_sample, themes_assigned,
        reviews_csv_round_trip, evidence_snippets, token_windows, index_missing, themes_hierarchy, themes_selected, search_batch_routed,
        sentiment_saved, stream_distribution, run_stage_counts, word_pmi, words_alike, incremental_labels, index_bucketed, search_compressed,
        epoch_metrics, epoch_weights, sentiment_epochs,
    ]
    return {f.__name__: f for f in listed} | {"query_terms": query_terms_table}
