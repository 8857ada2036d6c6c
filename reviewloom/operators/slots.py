"""Text vectors from hashed words whose slots any engine can compute.

A word's slot is the number in the first eight hexadecimal digits of its MD5, modulo
the number of dimensions. Slots are weighed by rarity; the fitted state is one number
per dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import word_counts, words
from reviewloom.functions.vectors import unit


def slot_of(word: Column, dims: int) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dims


def slot_counts(texts: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, slot, tf), one row per slot that a text's words fall into."""
    counted = texts.select(key, F.inline(word_counts(words(F.col("text")))))
    return counted.groupBy(key, slot_of(F.col("word"), dims).alias("slot")).agg(F.sum("tf").alias("tf"))


def fit_slots(texts: DataFrame, key: str = "review_id", dims: int = 512) -> DataFrame:
    """(slot, idf): one row per slot in use."""
    total = texts.agg(F.count(F.lit(1))).scalar()
    df = slot_counts(texts, key, dims).groupBy("slot").agg(F.count(F.lit(1)).alias("df"))
    return df.select("slot", F.log((total + 1) / (F.col("df") + 1)).alias("idf"))


def embed_slots(texts: DataFrame, weights: DataFrame, key: str = "review_id", dims: int = 512) -> DataFrame:
    """(key, embedding) with unit vectors of double precision.

    Texts without a weighted word have a zero vector; `weights` comes from fit_slots.
    """
    weighed = slot_counts(texts, key, dims).join(F.broadcast(weights), "slot")
    cells = weighed.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.col("tf") * F.col("idf")))).alias("_cells")
    )
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint"))
    filled = F.transform(slots, lambda i: F.coalesce(F.try_element_at("_cells", i), F.lit(0.0)))
    vectors = cells.select(key, unit(filled, "double").alias("embedding"))
    nothing = F.array_repeat(F.lit(0.0), dims)
    return texts.select(key).join(vectors, key, "left").select(key, F.coalesce("embedding", nothing).alias("embedding"))
