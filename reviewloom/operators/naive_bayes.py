"""Sentiment by word counts: naive Bayes, its smoothing chosen by validation F1.

Training is counting, so it is one pass over the words of all training texts and gives
the same model in every engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.display import class_name
from reviewloom.functions.text import is_blank
from reviewloom.operators.ranking import join_counted
from reviewloom.operators.sampling import with_split
from reviewloom.operators.sentiment import binary_metrics
from reviewloom.operators.text_search import term_counts
from reviewloom.session import stored
from reviewloom.sources.tables import read_dataset, write_dataset

SMOOTHING = (0.1, 1.0, 10.0)


@dataclass
class WordModel:
    """Counts per word and class, and the smoothing that was chosen."""

    words: DataFrame  # (word, texts, negative, positive)
    totals: tuple[float, float]  # words of each class
    distinct: int
    prior: float  # log ratio of the classes' texts
    smoothing: float
    metrics: DataFrame


def _evidence(model_totals: tuple[float, float], distinct: int, smoothing: float) -> Column:
    """Log ratio of a word's smoothed shares in the two classes."""
    share = lambda n, total: (F.col(n) + smoothing) / (total + smoothing * distinct)
    return F.log(share("positive", model_totals[1])) - F.log(share("negative", model_totals[0]))


def _margins(texts: DataFrame, words: DataFrame, columns: dict[str, Column], prior: float, key: str) -> DataFrame:
    """(key, one margin per column): sums of evidence over a text's known words, and the prior."""
    counts = stored(term_counts(texts, key))
    held = counts.groupBy("word").agg(F.count(F.lit(1)).alias("_rows"))
    known = stored(words.join(held, "word"))
    met = join_counted(counts, known, "word", "_rows", counts.count(), spread=key)
    sums = met.groupBy(key).agg(*[F.sum(F.col("tf") * c).alias(n) for n, c in columns.items()])
    joined = texts.select(key).join(sums, key, "left")
    return joined.select(key, *[F.round(F.coalesce(n, F.lit(0.0)) + prior, 6).alias(n) for n in columns])


def train_words(labelled: DataFrame, key: str = "review_id", smoothing: tuple[float, ...] = SMOOTHING) -> WordModel:
    """Model of (key, text, label) rows, split by text so that copies stay on one side."""
    spark = labelled.sparkSession
    rows = stored(with_split(labelled.select(key, "text", "label"), key="text"))
    train = rows.filter("split = 'train'")
    n = train.groupBy().agg(F.sum("label").alias("positive"), F.count(F.lit(1)).alias("rows")).first()
    positive, negative = n["positive"] or 0, n["rows"] - (n["positive"] or 0)
    if not positive or not negative:
        raise ValueError("training needs reviews of both classes")
    prior = spark.range(1).select(F.log(F.lit(float(positive)) / F.lit(float(negative)))).first()[0]
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("tf")).otherwise(0))
    counts = term_counts(train.select(F.struct(key, "label").alias("_row"), "text"), "_row").select("_row.label", "word", "tf")
    words = stored(counts.groupBy("word").agg(of(0).alias("negative"), of(1).alias("positive")))
    sums = words.agg(F.sum("negative"), F.sum("positive"), F.count(F.lit(1))).first()
    totals, distinct = (float(sums[0] or 0), float(sums[1] or 0)), sums[2]
    columns = {f"m{i}": _evidence(totals, distinct, a) for i, a in enumerate(smoothing)}
    held = stored(rows.filter("split <> 'train'"))
    margins = _margins(held, words, columns, prior, key)
    each = F.explode(
        F.array(*[F.struct(F.lit(a).alias("smoothing"), (F.col(m) > 0).cast("int").alias("prediction")) for m, a in zip(columns, smoothing)])
    )
    scored = held.join(margins, key).select("split", "label", each.alias("s")).select("split", "label", "s.*")
    metrics = stored(binary_metrics(scored, ["smoothing", "split"]))
    ranked = metrics.filter("split = 'validation'").orderBy(F.desc("f1"), "smoothing").first()
    chosen = ranked["smoothing"] if ranked else smoothing[0]
    return WordModel(words, totals, distinct, prior, chosen, metrics.filter(F.col("smoothing") == chosen).drop("smoothing"))


def score_words(texts: DataFrame, model: WordModel, key: str = "review_id") -> DataFrame:
    """(key, label_name, confidence) of (key, text) rows; blank texts get no row."""
    asked = texts.filter(~is_blank(F.col("text"))).select(key, "text")
    column = {"margin": _evidence(model.totals, model.distinct, model.smoothing)}
    margins = _margins(asked, model.words, column, model.prior, key)
    confidence = 1 / (1 + F.exp(-F.abs("margin")))
    label = class_name((F.col("margin") > 0).cast("int"))
    return margins.select(key, label.alias("label_name"), F.round(confidence, 6).alias("confidence"))


def save_words(model: WordModel, path: str) -> None:
    """Write a model: its word counts, its numbers and its metrics."""
    spark = model.words.sparkSession
    write_dataset(model.words, f"{path}/words")
    write_dataset(model.metrics, f"{path}/metrics")
    numbers = [(*model.totals, model.distinct, model.prior, model.smoothing)]
    schema = "negative double, positive double, distinct bigint, prior double, smoothing double"
    write_dataset(spark.createDataFrame(numbers, schema), f"{path}/numbers")  # last: a model with numbers is whole


def load_words(spark: SparkSession, path: str) -> WordModel:
    """A model that save_words wrote."""
    n = read_dataset(spark, f"{path}/numbers", "word model").first()
    words, metrics = read_dataset(spark, f"{path}/words", "word model"), read_dataset(spark, f"{path}/metrics", "word model")
    return WordModel(words, (n["negative"], n["positive"]), n["distinct"], n["prior"], n["smoothing"], metrics)
