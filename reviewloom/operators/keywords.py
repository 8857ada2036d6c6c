"""Keyword counts and summaries backed by the retrieved reviews."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.constants import EVIDENCE_CHARS, SUMMARY_KEYWORDS
from reviewloom.functions.display import summary_sentence
from reviewloom.functions.text import keyword_words, word_counts
from reviewloom.operators.ranking import rank_within, top_k
from reviewloom.operators.search import search_reviews, snippets
from reviewloom.session import stored


def keyword_counts(texts: DataFrame, order: str, groups: list[str] | None = None, text: str = "text") -> DataFrame:
    """(word, count, first_at, first_pos): how often a keyword occurs and where first, per group.

    `order` is the column that puts the texts of a group in sequence; it must
    be unique within the group. Words are counted inside each text before they
    are grouped, and all aggregates are plain numbers, so that Spark combines
    them in hash tables before the shuffle.
    """
    groups = groups or []
    counted = word_counts(keyword_words(F.col(text)), positions=True)
    exploded = texts.select(*groups, F.col(order).alias("_at"), F.inline_outer(counted))
    return (
        exploded.filter(F.col("word").isNotNull())
        .groupBy(*groups, "word")
        .agg(
            F.sum("tf").alias("count"),
            F.min("_at").alias("first_at"),
            F.min_by("pos", "_at").alias("first_pos"),
        )
    )


def by_frequency() -> list[Column]:
    """Most frequent first, ties by first occurrence."""
    return [F.desc("count"), F.asc("first_at"), F.asc("first_pos")]


def top_keywords(counts: DataFrame, n: int) -> DataFrame:
    return top_k(counts, n, *by_frequency())


def top_keywords_within(counts: DataFrame, groups: list[str], n: int) -> DataFrame:
    return rank_within(counts, groups, by_frequency(), n)


def summarise(queries: DataFrame, hits: DataFrame, n_keywords: int = SUMMARY_KEYWORDS) -> DataFrame:
    """One row per query: the summary sentence and the reviews it rests on.

    `queries` holds (query_id, query), `hits` ranked search hits with texts. A
    query holds at most `k` hits and `n_keywords` words, so the lists stay small. The
    evidence has the whole review and a shortened, highlighted snippet of it.
    A query without hits gets the fallback sentence and no evidence. The hits
    feed both parts and are stored, so that the search behind them runs once.
    """
    hits = stored(hits)
    counts = keyword_counts(hits, order="rank", groups=["query_id"], text="review")
    ranked = top_keywords_within(counts, ["query_id"], n_keywords)
    keywords = ranked.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("keywords")
    )
    shown = snippets(hits.join(queries, "query_id"), "query", EVIDENCE_CHARS)
    evidence = shown.groupBy("query_id").agg(
        F.sort_array(
            F.collect_list(F.struct("rank", "score", "review_id", "summary", "review", "rating", "snippet"))
        ).alias("supporting_reviews")
    )
    joined = queries.join(keywords, "query_id", "left").join(evidence, "query_id", "left")
    words = F.coalesce(F.col("keywords.word"), F.array().cast("array<string>"))
    sentence = summary_sentence(F.coalesce(F.col("query"), F.lit("")), words)
    return joined.select("query_id", sentence.alias("summary"), "supporting_reviews")


def summarise_query(
    query: str | None, embedder: PipelineModel, index: DataFrame, corpus: DataFrame, k: int = 5
) -> DataFrame:
    """One row (query_id, summary, supporting_reviews) for a single free-text query."""
    asked = corpus.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    hits = search_reviews(query, embedder, index, corpus, k).withColumn("query_id", F.lit(0))
    return summarise(asked, hits)
