"""Readers and writers. Parquet between stages, CSV only at the edge."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.constants import MISSING_WORDS

NUMBER_TYPES = {"Id": "bigint", "HelpfulnessNumerator": "int", "HelpfulnessDenominator": "int"}
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


class MissingDataset(FileNotFoundError):
    """A stage's input has not been written yet."""


def _load(spark: SparkSession, path: str, what: str, fmt: str, **options) -> DataFrame:
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise MissingDataset(f"missing {what}: {path}") from error
        raise


def read_reviews_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw reviews from CSV with a header, quoted line breaks kept.

    Columns are matched by name and typed without inference. A record may span
    lines, so Spark cannot split one file: give large inputs as a folder of
    files. Words that stand for a missing value become NULL in Score and
    Summary; the score may be written as `5` or `5.0`.
    """
    raw = _load(spark, path, "raw reviews", "csv", **CSV_OPTIONS)
    typed = {}
    for column in raw.columns:
        if column in NUMBER_TYPES:
            typed[column] = F.col(column).try_cast(NUMBER_TYPES[column])
        elif column in ("Score", "Summary"):
            typed[column] = F.when(~F.col(column).isin(MISSING_WORDS), F.col(column))
    if "Score" in typed:
        score = typed["Score"].try_cast("double")
        typed["Score"] = F.when(score == F.floor(score), score.try_cast("int"))
    return raw.withColumns(typed)


def read_reviews_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, "raw reviews", "parquet")


def read_dataset(spark: SparkSession, path: str, what: str = "dataset") -> DataFrame:
    """Read a stage's output; name the dataset when it is missing."""
    return _load(spark, path, what, "parquet")


def dataset_exists(spark: SparkSession, path: str) -> bool:
    try:
        read_dataset(spark, path)
    except MissingDataset:
        return False
    return True


def model_exists(spark: SparkSession, path: str) -> bool:
    try:
        _load(spark, f"{path}/metadata", "model", "text")
    except MissingDataset:
        return False
    return True


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_keyed(df: DataFrame, path: str, key: str = "review_id") -> None:
    """Write in key ranges, so that a look-up by key skips most row groups."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "review_id") -> DataFrame:
    """Save as table `name` under `path`, bucketed and sorted by a key, and return the table.

    Tables with the same number of buckets are joined on the key without moving a row.
    The rows are dealt first, so that a bucket is one sorted file.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def export_csv(df: DataFrame, path: str) -> None:
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    df.write.mode("overwrite").options(**options).csv(path)


def source_profile(df: DataFrame) -> DataFrame:
    """One row: number of rows, number of columns and the column names."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(", ".join(df.columns)).alias("columns"),
    )


def preview(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    """First rows by key."""
    return df.orderBy(key).limit(rows)


def vector_shape(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Number of vectors and their smallest and largest length."""
    return vectors.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size(column)).alias("min_dim"),
        F.max(F.size(column)).alias("max_dim"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    if not model_exists(spark, path):
        raise MissingDataset(f"missing model: {path}")
    return PipelineModel.load(path)
