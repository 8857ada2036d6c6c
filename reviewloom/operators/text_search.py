"""Search by words: TF-IDF cosine over an inverted index with bounds.

The postings of a word hold its unit weight in every review. They are laid out by layers of
falling weight; the largest weight of each layer, the block table, is kept beside them.
A query first scores the reviews of its most promising blocks: their k-th score is one that the
k-th hit reaches at least. Words whose largest weights together stay below it cannot
make a hit by themselves, and a block is skipped if its largest weight and the
best of all other words stay below it too. Reviews found in the blocks that are left
are scored in full, so the result is that of scoring everything.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.constants import SCORE_DIGITS
from reviewloom.functions.text import word_counts, words
from reviewloom.operators.ranking import best_first, check_k, join_counted, rank_within
from reviewloom.session import stored

#: A layer ends where weights have fallen by the square root of two; the last one has all smaller weights.
MAX_LAYER = 40
#: Postings of a word are spread over slices of about so many.
SLICE_POSTINGS = 200_000
#: Blocks that hold so many postings for each wanted hit give the first bound.
SEEDS = 8
MAX_BROADCAST_ROWS = 500_000
#: Lengths of texts, two numbers each.
MAX_BROADCAST_LENGTHS = 4_000_000
SLACK = 1e-8


class TextIndex(NamedTuple):
    """Inverted index of a corpus; three tables that can be written and read again."""

    postings: DataFrame  # word, slice, layer, review_id, weight
    blocks: DataFrame  # word, layer, top (largest weight), n (postings)
    idf: DataFrame  # word, idf


def listed_terms(texts: DataFrame, key: str) -> DataFrame:
    """(key, pos, word, tf) for every word of every text; needs no shuffle.

    A text without words has one row without a word; `pos` is 0 or NULL once for each text.
    """
    return texts.select(key, F.posexplode_outer(word_counts(words(F.col("text"))))).select(key, "pos", "col.word", "col.tf")


def term_counts(texts: DataFrame, key: str) -> DataFrame:
    """(key, word, tf) for every word of every text."""
    return listed_terms(texts, key).filter(F.col("word").isNotNull()).drop("pos")


def word_weights(counts: DataFrame, n_texts: Column) -> DataFrame:
    """(word, df, idf): number of texts holding each word, and its rarity."""
    df = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((n_texts + 1) / (F.col("df") + 1)))


def _weighed(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """`counts` with the df and idf of their words. The weights of the commonest words are broadcast; only rows of the others are shuffled."""
    steps = [1 << i for i in range(0, 40, 2)]
    held = weights.agg(*[F.count_if(F.col("df") >= n) for n in steps], F.sum("df")).first()
    least = next((n for n, words_held in zip(steps, held) if words_held <= MAX_BROADCAST_ROWS), steps[-1] << 2)
    common = weights.filter(F.col("df") >= least)
    near = counts.join(F.broadcast(common), "word")
    if least == 1:
        return near
    rest = counts.join(F.broadcast(common.select("word")), "word", "left_anti")
    rare = weights.filter(F.col("df") < least)
    return near.unionByName(join_counted(rest, rare, "word", "df", held[-1] or 0, spread="review_id"))


def text_index(corpus: DataFrame) -> TextIndex:
    """The inverted index of (review_id, text) rows. The texts are read once, and no text's words are brought together again."""
    listed = stored(listed_terms(corpus, "review_id"))
    n_texts = listed.agg(F.count_if(F.coalesce("pos", F.lit(0)) == 0)).scalar()
    counts = listed.filter(F.col("word").isNotNull()).drop("pos")
    weights = stored(word_weights(counts, n_texts))
    slices = F.ceil(F.col("df") / SLICE_POSTINGS).cast("int")
    rows = _weighed(counts, weights).select(
        "review_id",
        "word",
        (F.col("tf") * F.col("idf")).alias("_w"),
        F.pmod(F.xxhash64("review_id"), slices).cast("int").alias("slice"),
    ).filter("_w > 0")
    # The words of a text are neighbours, so a task hands on few rows a text.
    lengths = stored(rows.groupBy("review_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm")))
    lengths = F.broadcast(lengths) if lengths.count() <= MAX_BROADCAST_LENGTHS else lengths
    weight = F.col("_w") / F.col("_norm")
    flat = rows.join(lengths, "review_id").select("word", "slice", "review_id", weight.alias("weight"))
    layer = F.greatest(F.least(F.floor(-2 * F.log2("weight")), F.lit(MAX_LAYER)).cast("int"), F.lit(0))
    postings = stored(flat.select("word", "slice", layer.alias("layer"), "review_id", "weight"))
    blocks = postings.groupBy("word", "layer").agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("n"))
    return TextIndex(postings, stored(blocks), weights.select("word", "idf"))


def query_vectors(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """(query_id, word, wq): sparse unit vectors of (query_id, text) rows; unknown words weigh nothing."""
    counts = term_counts(queries, "query_id")
    weighted = counts.join(idf, "word").select("query_id", "word", (F.col("tf") * F.col("idf")).alias("weight"))
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("query_id")))
    return weighted.filter("weight > 0").select("query_id", "word", (F.col("weight") / length).alias("wq"))


def _small(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def _added(postings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, review_id, sum) over the postings of the given (query_id, word, layer, wq) blocks."""
    met = postings.join(_small(blocks), ["word", "layer"])
    return met.groupBy("query_id", "review_id").agg(F.sum(F.col("weight") * F.col("wq")).alias("sum"))


def _asked(index: TextIndex, terms: DataFrame) -> TextIndex:
    """The part of an index that holds words of the queries."""
    words_asked = stored(terms.select("word").distinct())
    return index._replace(postings=index.postings.join(_small(words_asked), "word", "left_semi"))


def _scored(index: TextIndex, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, review_id, score) of stored (query_id, review_id) pairs, over all words of the query."""
    # Postings that lie in one of the reviews, then the pairs themselves.
    met = index.postings.select("word", "review_id", "weight").join(_small(pairs), "review_id").join(_small(terms), ["query_id", "word"])
    score = F.round(F.sum(F.col("weight") * F.col("wq")), SCORE_DIGITS)
    return met.groupBy("query_id", "review_id").agg(score.alias("score"))


def block_choice(index: TextIndex, terms: DataFrame, k: int) -> DataFrame:
    """All blocks of the words in stored `terms` with `kept`: whether they can hold a review among the `k` best.

    Columns: query_id, word, layer, wq, most (the block's largest contribution), n, kept,
    bound (a score that the k-th hit reaches), rest (the most that a review can get outside kept blocks).
    """
    options = stored(
        _small(terms).join(index.blocks, "word").select("query_id", "word", "layer", "wq", (F.col("wq") * F.col("top")).alias("most"), "n")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("most"), "word", "layer").rowsBetween(Window.unboundedPreceding, -1)
    seeds = stored(options.withColumn("_before", F.coalesce(F.sum("n").over(best), F.lit(0))).filter(F.col("_before") < SEEDS * k).drop("_before"))
    found = rank_within(_added(index.postings, seeds), ["query_id"], [F.desc("sum"), F.asc("review_id")], SEEDS * k)
    likely = rank_within(_scored(index, terms, stored(found.select("query_id", "review_id"))), ["query_id"], best_first(), k)
    bounds = likely.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("bound")).filter(F.col("_n") == k)
    per_word = options.groupBy("query_id", "word").agg(F.max("most").alias("peak"))
    rising = Window.partitionBy("query_id").orderBy("peak", "word").rowsBetween(Window.unboundedPreceding, 0)
    peaks = per_word.withColumns({"upto": F.sum("peak").over(rising), "all": F.sum("peak").over(Window.partitionBy("query_id"))})
    bounded = peaks.join(bounds.drop("_n"), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) - SLACK)
    flagged = options.join(bounded, ["query_id", "word"])
    essential = F.col("upto") >= F.col("bound")
    kept = essential & (F.col("all") - F.col("peak") + F.col("most") >= F.col("bound"))
    marked = flagged.withColumns({"kept": kept, "_skipped": F.when(~kept, F.col("most"))})
    # Outside kept blocks a word gives at most its best skipped block.
    per_skipped = marked.groupBy("query_id", "word").agg(F.coalesce(F.max("_skipped"), F.lit(0.0)).alias("_most"))
    rest = per_skipped.groupBy("query_id").agg(F.sum("_most").alias("rest"))
    return stored(marked.join(rest, "query_id").select("query_id", "word", "layer", "wq", "most", "n", "kept", "bound", "rest"))


def search_texts(index: TextIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """The `k` reviews sharing most weighted words with each (query_id, text) row, with score and rank.

    Ties go to the smaller id; reviews that share no weighted word are no hits.
    """
    k = check_k(k)
    terms = stored(query_vectors(queries, index.idf))
    part = _asked(index, terms)
    index = index._replace(postings=stored(part.postings))  # read once for all the steps below
    choice = block_choice(index, terms, max(k, 1))
    limits = choice.select("query_id", "bound", "rest").distinct()
    found = _added(index.postings, choice.filter("kept")).join(limits, "query_id")
    reached = stored(found.filter(F.col("sum") + F.col("rest") >= F.col("bound")).select("query_id", "review_id"))
    hits = _scored(index, terms, reached).filter("score > 0")
    return rank_within(hits, ["query_id"], best_first(), k)
