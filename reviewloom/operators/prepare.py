"""Cleaning, labelling and the derived review sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.constants import CLASS_OF_SCORE, CLEAN_MIN_CHARS, REVIEW_FIELDS, SEARCH_MIN_CHARS, SEED
from reviewloom.functions.display import class_of_score
from reviewloom.functions.text import longer_than, strip
from reviewloom.operators.sampling import sample_exact


def stripped_texts(df: DataFrame, min_chars: int) -> DataFrame:
    """Strip texts and keep those longer than `min_chars`; missing ones are dropped."""
    text = F.col("text").cast("string")
    return df.filter(longer_than(text, min_chars)).withColumn("text", strip(text))


def clean_reviews(
    raw: DataFrame,
    sample_size: int | None = None,
    key: str = "Id",
    seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Raw reviews to labelled reviews keyed by `review_id`.

    `key` names a unique column of the raw table; columns named in `carry` are taken
    along. Neutral and unrated reviews and short texts are dropped before the optional
    sample is taken; the filters are written so that they reach the scan.
    """
    present = {old: new for old, new in REVIEW_FIELDS.items() if old in raw.columns}
    rated = raw.filter(F.col("Text").isNotNull() & F.col("Score").isNotNull() & F.col("Score").isin(*CLASS_OF_SCORE))
    named = rated.select(F.col(key).alias("review_id"), *[F.col(old).alias(new) for old, new in present.items()], *carry)
    labelled = named.withColumn("label", class_of_score(F.col("Score")))
    return sample_exact(stripped_texts(labelled, CLEAN_MIN_CHARS), sample_size, seed=seed)


def negative_reviews(clean: DataFrame) -> DataFrame:
    return clean.filter(F.col("label") == 0)


def search_corpus(clean: DataFrame) -> DataFrame:
    """Reviews long enough to be searched."""
    own = [c for c in ("review_id", *REVIEW_FIELDS.values(), "label") if c in clean.columns]
    return stripped_texts(clean.select(*own), SEARCH_MIN_CHARS)


def cluster_input(negatives: DataFrame, sample_size: int | None = None, seed: int = SEED) -> DataFrame:
    """Negative reviews to be grouped into themes: all, or an exact sample of them."""
    return sample_exact(stripped_texts(negatives, CLEAN_MIN_CHARS), sample_size, seed=seed)


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label, most frequent first."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), label)
