"""Reproducible sampling and splitting by a hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.constants import SEED
from reviewloom.session import stored

HASH_PREFIX = 4


def key_hash(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_exact(df: DataFrame, n: int | None, key: str = "review_id", seed: int = SEED) -> DataFrame:
    """Exactly `min(n, rows)` rows, the same ones at any partitioning.

    The rows with the `n` smallest key hashes are kept. Hashes are made once and stored;
    counts per hash prefix tell which prefixes are taken whole and which one is
    taken in part. Only the hashes of that one are ranked, whatever `n` is, and the
    rows are then filtered in place by the largest hash kept, without a join.
    `key` must be unique; the input is read twice.
    """
    if n is None:
        return df
    if n < 0:
        raise ValueError("n must not be negative")
    hashed = stored(df.select(key_hash(F.col(key), seed).alias("h")))
    prefix = F.substring("h", 1, HASH_PREFIX)
    counts = hashed.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("rows"))
    running = counts.withColumn("running", F.sum("rows").over(Window.orderBy("prefix")))
    edge = running.filter(F.col("running") >= n).orderBy("prefix").limit(1).first()
    if edge is None:
        return df
    need = n - (edge["running"] - edge["rows"])
    inside = hashed.filter(prefix == edge["prefix"]).orderBy("h").limit(need)
    largest = inside.agg(F.max("h")).first()[0]
    # Without a hash of the edge itself, the whole prefixes before it are the sample.
    keep = key_hash(F.col(key), seed) <= largest if need else key_hash(F.col(key), seed) < edge["prefix"]
    return df.filter(keep)


def hash_split(key: Column, seed: int = SEED) -> Column:
    """Name of the split a row belongs to: 80% train, 10% validation, 10% test."""
    h = key_hash(key, seed)
    # 0.8 and 0.9 of the range of an eight-digit hash.
    return F.when(h < "cccccccc", "train").when(h < "e6666666", "validation").otherwise("test")


def with_split(df: DataFrame, key: str = "review_id", seed: int = SEED) -> DataFrame:
    """Add the `split` column; rows with equal keys share a split."""
    return df.withColumn("split", hash_split(F.col(key), seed))
