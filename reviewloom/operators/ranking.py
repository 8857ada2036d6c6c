"""Top-k, ranks and skew-safe joins used by the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_HOT_KEYS = 10_000
MIN_HOT_ROWS = 50_000
MAX_TASK_ROWS = 5_000_000
SLICE_ROWS = 1_000_000
#: Rows without a key are dealt over this many slices.
NULL_SLICES = 1_024


def best_first() -> list[Column]:
    """Order of search results: best score first, ties by the smaller id."""
    return [F.desc("score"), F.asc("review_id")]


def check_k(k: int) -> int:
    k = int(k)
    if k < 0:
        raise ValueError("k must not be negative")
    return k


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """First `k` rows of an ordering that ends in a unique column."""
    return df.orderBy(*order).limit(check_k(k))


def rank_within(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First `k` rows per group with their 1-based rank.

    The rank filter lets Spark keep `k` rows per group and task before the
    shuffle, so a group that holds most rows stays cheap.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= check_k(k))


def join_counted(
    left: DataFrame,
    right: DataFrame,
    key: str,
    rows: str,
    total: int,
    spread: str,
    how: str = "inner",
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join `left` with `right`, which is unique in `key`, safe for hot keys.

    `right[rows]` is the number of left rows per key and `total` their sum. Keys
    holding more rows than a task handles easily are hot: at most one key per
    MIN_HOT_ROWS rows, and never more than MAX_HOT_KEYS unless a key would then keep
    over MAX_TASK_ROWS. Their list is broadcast, their left rows are dealt by a hash of
    `spread` over as many slices as they hold SLICE_ROWS rows, and only their right
    rows are repeated. All other keys are small and are joined as they are. Left rows
    without a key match nothing and are spread as well. `sizes` may give `key` and
    `rows` from a cheaper table than `right`.
    """
    bound = max(min(total // MAX_HOT_KEYS, MAX_TASK_ROWS), MIN_HOT_ROWS)
    if total <= bound:
        return left.join(right, key, how)
    slices = F.greatest(F.ceil(F.col(rows) / min(SLICE_ROWS, bound)), F.lit(1)).cast("int")
    is_hot = F.col(rows) > bound
    hot = (right if sizes is None else sizes).filter(is_hot).select(key, slices.alias("_slices"))
    many = F.when(F.col(key).isNull(), F.lit(NULL_SLICES)).otherwise(F.coalesce("_slices", F.lit(1)))
    salt = F.pmod(F.xxhash64(spread), many).cast("int")
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_slices")
    copies = F.when(is_hot, F.sequence(F.lit(0), slices - 1)).otherwise(F.array(F.lit(0)))
    spread_right = right.withColumn("_salt", F.explode(copies))
    return salted.join(spread_right, [key, "_salt"], how).drop("_salt")
