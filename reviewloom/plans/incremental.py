"""Adding new and changed reviews without running all again.

Reviews are kept in parts, by a hash of their key. A run compares the content hashes of what
arrives with those on record; only parts that hold a new or changed review are written
again, by dynamic partition overwrite, and only new and changed reviews are cleaned
and embedded. Counts are kept per part and added up on demand. A review that is dropped by
the cleaning rules stays on record without its text, so a part is never empty.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.constants import SEARCH_MIN_CHARS
from reviewloom.functions.text import longer_than
from reviewloom.operators.embedding import embed_hashed
from reviewloom.operators.prepare import clean_reviews
from reviewloom.session import stored
from reviewloom.sources.tables import dataset_exists, read_dataset

PARTS = 64
REVIEWS, INDEX, COUNTS = "reviews", "search_embeddings", "label_counts"
CLEAN_COLUMNS = ["text", "summary", "Score", "HelpfulnessNumerator", "HelpfulnessDenominator", "label"]


def _write_parts(df: DataFrame, path: str) -> None:
    """Replace the parts that `df` holds; all others stay untouched."""
    dealt = df.hint("rebalance", F.col("part"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def _in_corpus() -> Column:
    return F.col("kept") & longer_than(F.col("text"), SEARCH_MIN_CHARS)


def changed_reviews(spark: SparkSession, arrivals: DataFrame, out: str, parts: int = PARTS) -> DataFrame:
    """Raw rows that are new or differ from those on record, with `part` and `content`.

    Of several rows with one key the one with the largest content hash counts; rows without a key are left out.
    """
    row = F.struct(*[F.col(c) for c in sorted(arrivals.columns)])
    marked = arrivals.filter("Id IS NOT NULL").select(
        F.col("Id").cast("bigint").alias("review_id"), F.sha2(F.to_json(row), 256).alias("content"), row.alias("row")
    )
    latest = marked.groupBy("review_id").agg(F.max(F.struct("content", "row")).alias("last"))
    part = F.pmod(F.xxhash64("review_id"), F.lit(parts)).cast("int").alias("part")
    latest = latest.select("review_id", part, "last.content", "last.row")
    if dataset_exists(spark, f"{out}/{REVIEWS}"):
        known = read_dataset(spark, f"{out}/{REVIEWS}").select("review_id", "part", F.col("content").alias("_content"))
        latest = latest.join(known, ["review_id", "part"], "left")
        latest = latest.filter(~F.col("content").eqNullSafe(F.col("_content"))).drop("_content")
    return stored(latest)


def add_reviews(
    spark: SparkSession, arrivals: DataFrame, out: str, embedder: PipelineModel | None = None, parts: int = PARTS
) -> list[int]:
    """Bring the tables under `out` up to date with the arriving raw reviews; returns the parts written.

    The number of parts must stay the same for one folder. A run that was cut
    short is started again with the same arrivals: `reviews` is written last, so they
    still count as changed.
    """
    changed = changed_reviews(spark, arrivals, out, parts)
    touched = sorted(r["part"] for r in changed.select("part").distinct().collect())  # at most `parts`
    if not touched:
        return []
    cleaned = clean_reviews(changed.select("row.*"))
    fresh = changed.select("review_id", "part", "content").join(cleaned.withColumn("kept", F.lit(True)), "review_id", "left")
    fresh = stored(fresh.select("review_id", "part", "content", F.coalesce("kept", F.lit(False)).alias("kept"), *CLEAN_COLUMNS))
    tables = [(REVIEWS, fresh)]
    if embedder is not None:
        vectors = embed_hashed(fresh.filter(_in_corpus()).select("review_id", "text"), embedder)
        tables.insert(0, (INDEX, stored(fresh.select("review_id", "part").join(vectors, "review_id", "left"))))
    for name, new in tables:
        path = f"{out}/{name}"
        if dataset_exists(spark, path):
            old = read_dataset(spark, path).filter(F.col("part").isin(touched))
            kept = old.join(changed.select("review_id"), "review_id", "left_anti")
            new = stored(kept.select(*new.columns).unionByName(new))
        if name == REVIEWS:
            counted = new.groupBy("part", F.when(F.col("kept"), F.col("label")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
            _write_parts(counted, f"{out}/{COUNTS}")
        _write_parts(new, path)
    return touched


def current_reviews(spark: SparkSession, out: str) -> DataFrame:
    """The clean reviews as a full run over all arrivals would give them."""
    return read_dataset(spark, f"{out}/{REVIEWS}", "reviews").filter("kept").select("review_id", *CLEAN_COLUMNS)


def current_corpus(spark: SparkSession, out: str) -> DataFrame:
    return read_dataset(spark, f"{out}/{REVIEWS}", "reviews").filter(_in_corpus()).select("review_id", *CLEAN_COLUMNS)


def current_index(spark: SparkSession, out: str) -> DataFrame:
    return read_dataset(spark, f"{out}/{INDEX}", "search index").filter("embedding IS NOT NULL").select("review_id", "embedding")


def current_labels(spark: SparkSession, out: str) -> DataFrame:
    """(label, count) added up over the parts, most frequent first."""
    counts = read_dataset(spark, f"{out}/{COUNTS}", "label counts").filter("label IS NOT NULL")
    return counts.groupBy("label").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "label")
