"""Training, selecting, evaluating and applying the sentiment model."""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.constants import CLEAN_MIN_CHARS, MAX_TOKENS, SEED
from reviewloom.functions.display import argmax, class_name, confidence_percent, display_label, four_decimals
from reviewloom.functions.text import is_blank, words
from reviewloom.operators.embedding import NOT_WORD
from reviewloom.operators.prepare import label_distribution, stripped_texts
from reviewloom.operators.sampling import with_split

CANDIDATES = [{"regParam": r} for r in (0.001, 0.01, 0.1)]


@dataclass
class SentimentModel:
    """A fitted pipeline and the scores it was chosen by."""

    pipeline: PipelineModel
    params: dict
    metrics: DataFrame
    validation_f1: list[tuple[dict, float]] = field(default_factory=list)


def token_window(texts: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Tokens of each text, cut to the length a model accepts."""
    tokens = words(F.coalesce(F.col("text"), F.lit("")))
    return texts.withColumn("_all", tokens).select(
        *texts.columns,
        F.size("_all").alias("n_tokens"),
        F.slice("_all", 1, max_tokens).alias("tokens"),
    )


def token_windows(texts: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """All tokens of each text as numbered windows of the length a model accepts.

    A text without tokens has one empty window.
    """
    tokens = words(F.coalesce(F.col("text"), F.lit("")))
    count = F.greatest(F.ceil(F.size("_all") / max_tokens), F.lit(1)).cast("int")
    numbered = texts.withColumn("_all", tokens).withColumn("window", F.explode(F.sequence(F.lit(0), count - 1)))
    cut = F.slice("_all", F.col("window") * max_tokens + 1, F.lit(max_tokens))
    return numbered.select(*texts.columns, "window", cut.alias("tokens"))


def feature_stages(dims: int) -> list:
    """Hashed word weights over the whole text."""
    return [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=NOT_WORD),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims),
        IDF(inputCol="_counts", outputCol="features"),
    ]


def balance_weight(train: DataFrame) -> Column:
    """Weight that gives both classes the same total."""
    share = train.agg(F.avg(F.col("label").cast("double")).alias("p")).first()["p"]
    if share is None or share in (0.0, 1.0):
        raise ValueError("training needs reviews of both classes")
    return F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1.0 - share))


def binary_metrics(scored: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Rows, accuracy, F1 of the positive class and the share of the larger class."""
    hit = (F.col("prediction") == F.col("label")).cast("double")
    tp = F.sum(F.when((F.col("prediction") == 1) & (F.col("label") == 1), 1).otherwise(0))
    marked = F.sum(F.when(F.col("prediction") == 1, 1).otherwise(0))
    positive = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
    share = F.avg(F.col("label").cast("double"))
    return scored.groupBy(*(groups or [])).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(hit).alias("accuracy"),
        F.when(marked + positive == 0, 0.0).otherwise(2.0 * tp / (marked + positive)).alias("f1"),
        F.greatest(share, 1.0 - share).alias("majority_rate"),
    )


def predict_labels(scores: DataFrame, column: str = "scores") -> DataFrame:
    """Add the class of the largest score in an array column as `prediction`."""
    return scores.withColumn("prediction", argmax(F.col(column)))


def train_sentiment(
    labelled: DataFrame,
    candidates: list[dict] | None = None,
    dims: int = 1 << 14,
    max_iter: int = 20,
    seed: int = SEED,
) -> SentimentModel:
    """Fit one model per candidate on `train`, keep the best F1 on `validation`.

    Rows are split by their text, so copies of a text stay on one side. The
    word weights are fitted once, on `train`, and shared by all candidates.
    """
    spark = labelled.sparkSession
    split = with_split(labelled.select("text", "label"), key="text", seed=seed)
    features = Pipeline(stages=feature_stages(dims)).fit(split.filter(F.col("split") == "train"))
    ready = features.transform(split).select("label", "split", "features").persist()
    try:
        train = ready.filter(F.col("split") == "train")
        fit_rows = train.withColumn("weight", balance_weight(train))
        held = ready.filter(F.col("split") == "validation")

        def fit(params: dict) -> tuple[LogisticRegressionModel, dict, float]:
            model = LogisticRegression(weightCol="weight", maxIter=max_iter, **params).fit(fit_rows)
            return model, params, binary_metrics(model.transform(held)).first()["f1"]

        # The fits are independent jobs on the same cached rows.
        candidates = candidates or CANDIDATES
        with ThreadPool(len(candidates)) as pool:
            fitted = pool.map(inheritable_thread_target(spark)(fit), candidates)
        best = max(fitted, key=lambda f: f[2])
        chosen = PipelineModel(stages=[*features.stages, best[0]])
        held_out = best[0].transform(ready.filter(F.col("split") != "train"))
        rows = binary_metrics(held_out, ["split"]).collect()
    finally:
        ready.unpersist()
    metrics = spark.createDataFrame(
        [tuple(r) for r in sorted(rows)],
        "split string, n_rows bigint, accuracy double, f1 double, majority_rate double",
    )
    return SentimentModel(chosen, best[1], metrics, [(params, f1) for _, params, f1 in fitted])


def score_reviews(texts: DataFrame, model: PipelineModel) -> DataFrame:
    """Add the label and its confidence; blank texts get no row."""
    scored = model.transform(texts.filter(~is_blank(F.col("text"))))
    return scored.select(
        *texts.columns,
        class_name(F.col("prediction").cast("int")).alias("label_name"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )


def prediction_display(scored: DataFrame) -> DataFrame:
    """Add the texts and the percentage shown for a prediction."""
    return scored.withColumns(
        {
            "display": display_label(F.col("label_name")),
            "confidence_text": four_decimals(F.col("confidence")),
            "percent": confidence_percent(F.col("confidence")),
        }
    )


def sentiment_distribution(scored: DataFrame) -> DataFrame:
    """Reviews per predicted label, most frequent first."""
    return label_distribution(scored, "label_name")


def ready_to_score(texts: DataFrame) -> DataFrame:
    """Cleaning steps that work on a stream as well as on a table."""
    return stripped_texts(texts, CLEAN_MIN_CHARS)
