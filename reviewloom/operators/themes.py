"""Complaint themes: grouping by k-means, renumbering and naming."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.functions.constants import MIN_TOPIC_SIZE, OUTLIER_TOPIC, SEED
from reviewloom.functions.text import words
from reviewloom.functions.vectors import dot, unit
from reviewloom.operators.embedding import filled
from reviewloom.operators.ranking import join_counted, rank_within
from reviewloom.session import stored

NAME_WORDS = 4
MAX_DISTANCE = 0.9


def topic_numbers(assigned: DataFrame, cluster: str = "cluster", min_size: int = MIN_TOPIC_SIZE) -> DataFrame:
    """(cluster, topic, rows): topics numbered by size, small clusters are outliers.

    Ties go to the cluster with the smallest member. Rows without a cluster are
    outliers already. A number is the count of larger clusters plus the place among
    those of equal size, so the clusters themselves are never sorted in one task:
    only the distinct sizes are, and there are few of them (their sum is the number of rows).
    """
    sizes = (
        assigned.filter(F.col(cluster).isNotNull())
        .groupBy(cluster)
        .agg(F.count(F.lit(1)).alias("rows"), F.min("review_id").alias("first_member"))
        .filter(F.col("rows") >= min_size)
    )
    alike = sizes.groupBy("rows").agg(F.count(F.lit(1)).alias("_alike"))
    larger = F.sum("_alike").over(Window.orderBy(F.desc("rows"))) - F.col("_alike")
    place = F.row_number().over(Window.partitionBy("rows").orderBy("first_member")) - 1
    numbered = sizes.withColumn("_place", place).join(alike.select("rows", larger.alias("_larger")), "rows")
    return numbered.select(cluster, (F.col("_larger") + F.col("_place")).cast("int").alias("topic"), "rows")


def assign_topics(assigned: DataFrame, cluster: str = "cluster", min_size: int = MIN_TOPIC_SIZE) -> DataFrame:
    """Replace the cluster column by the final `topic` number."""
    numbers = stored(topic_numbers(assigned, cluster, min_size))
    total = numbers.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    joined = join_counted(assigned, numbers, cluster, "rows", total, spread="review_id", how="left")
    return joined.withColumn("topic", F.coalesce("topic", F.lit(OUTLIER_TOPIC))).drop(cluster, "rows")


def topic_sizes(topics: DataFrame) -> DataFrame:
    """Rows per topic, outliers included."""
    return topics.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))


def topic_words(topics: DataFrame, n: int = NAME_WORDS) -> DataFrame:
    """(topic, word, weight, rank): the words that set each topic apart.

    The weight is the share of a word in its topic times ln(1 + A / f), with A
    the mean number of words per topic and f the word's total.
    """
    tokens = F.filter(words(F.col("text")), lambda w: F.length(w) >= 2)
    counts = stored(
        topics.select("topic", F.explode_outer(tokens).alias("word"))
        .filter(F.col("word").isNotNull())
        .groupBy("topic", "word")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    held = F.count(F.lit(1))
    per_topic = stored(counts.groupBy("topic").agg(F.sum("tf").alias("topic_total"), held.alias("topic_rows")))
    per_word = stored(counts.groupBy("word").agg(F.sum("tf").alias("word_total"), held.alias("word_rows")))
    mean = per_topic.agg(F.floor(F.avg("topic_total"))).scalar()
    pairs = counts.count()
    by_word = join_counted(counts, per_word, "word", "word_rows", pairs, spread="topic")
    weighed = join_counted(by_word, per_topic, "topic", "topic_rows", pairs, spread="word")
    weight = F.col("tf") / F.col("topic_total") * F.log(F.lit(1.0) + mean / F.col("word_total"))
    rounded = weighed.select("topic", "word", F.round(weight, 9).alias("weight"))
    return rank_within(rounded, ["topic"], [F.desc("weight"), F.asc("word")], n)


def topic_info(topics: DataFrame, n: int = NAME_WORDS) -> DataFrame:
    """(topic, count, name): one row per topic, the name made of its top words."""
    top = topic_words(topics, n).groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("_words")
    )
    name = F.concat_ws("_", F.col("topic").cast("string"), F.array_join(F.col("_words.word"), "_"))
    named = topic_sizes(topics).join(top, "topic", "left")
    return named.select(
        "topic",
        "count",
        F.when(F.col("_words").isNotNull(), name).otherwise(F.col("topic").cast("string")).alias("name"),
    )


def fit_themes(vectors: DataFrame, ks: list[int], seed: int = SEED) -> KMeansModel:
    """Spherical k-means for each `k`; the one with the best silhouette is kept.

    `vectors` holds unit vectors in `vector`; it is read many times.
    """
    evaluator = ClusteringEvaluator(featuresCol="vector", distanceMeasure="cosine")
    best = None
    for k in ks:
        model = KMeans(featuresCol="vector", k=k, seed=seed, distanceMeasure="cosine").fit(vectors)
        if len(ks) == 1:
            return model
        fitted = model.transform(vectors)
        # The silhouette needs two clusters that hold rows.
        score = evaluator.evaluate(fitted) if sum(s > 0 for s in model.summary.clusterSizes) > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, model)
    return best[1]


def in_reach(vectors: DataFrame, centres: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """(review_id, cluster): the centre with the largest cosine, if it is near enough.

    `vectors` holds (review_id, embedding), `centres` (cluster, centre), one row per
    cluster. Ties go to the smaller cluster. Rows without a vector, or with a zero
    vector, have no cluster.
    """
    known = F.exists("embedding", lambda x: x != 0)
    # One centre per cluster: as small as the fitted model itself.
    listed = centres.agg(F.sort_array(F.collect_list(F.struct("cluster", unit(F.col("centre"), "double").alias("centre")))).alias("_c"))
    near = vectors.select("review_id", unit(F.col("embedding"), "double").alias("_v"), known.alias("_known"))
    scored = F.transform("_c", lambda c: F.struct((-F.round(dot(F.col("_v"), c["centre"]), 9)).alias("far"), c["cluster"].alias("cluster")))
    best = near.crossJoin(F.broadcast(listed)).select("review_id", "_known", F.array_min(scored).alias("_best"))
    reached = F.col("_known") & (1 + F.col("_best.far") <= max_distance)
    return best.select("review_id", F.when(reached, F.col("_best.cluster")).alias("cluster"))


def _vectors(texts: DataFrame, embedder: PipelineModel) -> DataFrame:
    embedded = embedder.transform(filled(texts))
    return embedded.select("review_id", "vector", vector_to_array("vector").alias("embedding"))


def _centres(spark: SparkSession, model: KMeansModel) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, centre array<double>")


def _fit(texts: DataFrame, embedder: PipelineModel, ks: list[int], seed: int) -> tuple[DataFrame, KMeansModel]:
    vectors = stored(_vectors(texts, embedder))
    # The cosine of a zero vector is undefined, so such rows place no centre.
    return vectors, fit_themes(vectors.filter(F.exists("embedding", lambda x: x != 0)), ks, seed)


def kmeans_themes(
    texts: DataFrame,
    embedder: PipelineModel,
    ks: list[int],
    min_topic_size: int = MIN_TOPIC_SIZE,
    max_distance: float = MAX_DISTANCE,
    seed: int = SEED,
) -> tuple[DataFrame, KMeansModel]:
    """(review_id, topic) and the fitted model.

    Rows further than `max_distance` in cosine from their centre, clusters under
    the minimum size, and texts without a weighted word become outliers.
    """
    vectors, model = _fit(texts, embedder, ks, seed)
    clustered = in_reach(vectors, _centres(texts.sparkSession, model), max_distance)
    return assign_topics(clustered, "cluster", min_topic_size), model


def fit_theme_table(
    texts: DataFrame,
    embedder: PipelineModel,
    ks: list[int],
    min_topic_size: int = MIN_TOPIC_SIZE,
    max_distance: float = MAX_DISTANCE,
    seed: int = SEED,
) -> DataFrame:
    """(cluster, centre, topic): the fitted themes as a small table to be saved.

    Clusters under the minimum size keep their centre and have the outlier topic.
    """
    vectors, model = _fit(texts, embedder, ks, seed)
    centres = _centres(texts.sparkSession, model)
    numbers = topic_numbers(stored(in_reach(vectors, centres, max_distance)), "cluster", min_topic_size)
    topic = F.coalesce("topic", F.lit(OUTLIER_TOPIC)).alias("topic")
    return centres.join(numbers, "cluster", "left").select("cluster", "centre", topic)


def assign_themes(
    texts: DataFrame, embedder: PipelineModel, themes: DataFrame, max_distance: float = MAX_DISTANCE
) -> DataFrame:
    """(review_id, topic) of texts, old or new, under themes that were fitted and saved before."""
    clustered = in_reach(_vectors(texts, embedder), themes.select("cluster", "centre"), max_distance)
    named = clustered.join(F.broadcast(themes.select("cluster", "topic")), "cluster", "left")
    return named.select("review_id", F.coalesce("topic", F.lit(OUTLIER_TOPIC)).alias("topic"))
