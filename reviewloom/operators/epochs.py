"""Sentiment model trained by epochs: the best one is kept, a lost run goes on where it stopped.

Logistic regression over hashed words (slots as in `slots.py`), a text's words weighing one over
the root of their number. Training rows are dealt by a hash of their key into `steps` parts, stored as
partitions; each step of an epoch reads one part, and each task adds up the errors of its rows per slot.
These sums meet in one aggregate over the slots, so what is shuffled, broadcast and sent to the
driver is bounded by `dims`, whatever the number of rows. Errors are whole multiples of
1 / SCALE: sums of whole numbers do not depend on the order of tasks, so a run that is
repeated or resumed gives the same model to the last bit.

After every epoch the weights and the validation metrics are written under the run's folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.display import class_name
from reviewloom.functions.text import is_blank, words
from reviewloom.operators.sampling import key_hash, with_split
from reviewloom.operators.sentiment import binary_metrics
from reviewloom.operators.slots import slot_of
from reviewloom.sources.tables import MissingDataset, dataset_exists, read_dataset, write_dataset

SCALE = 1 << 24
#: Slot of the constant term.
CONSTANT = -1


@dataclass(frozen=True)
class Recipe:
    """Settings of a run. The rate falls in equal amounts from step to step, towards zero.

    `balanced` weighs rows so that both classes have the same total.
    """

    epochs: int = 3
    steps: int = 16
    rate: float = 4.0
    decay: float = 0.001
    dims: int = 1 << 14
    balanced: bool = True


@dataclass
class EpochModel:
    """Weights of the chosen epoch and the validation metrics of all."""

    weights: np.ndarray  # one per slot, the constant term last
    epoch: int
    metrics: DataFrame  # (epoch, n_rows, accuracy, f1, majority_rate)

    def table(self, spark: SparkSession) -> DataFrame:
        return _weight_table(spark, self.weights)


def train_epochs(
    labelled: DataFrame, path: str, recipe: Recipe = Recipe(), key: str = "review_id", stop_after: int | None = None
) -> EpochModel:
    """Train on (key, text, label) rows; everything is kept under `path`, where a lost run goes on.

    Rows are split by text, so copies stay on one side; a missing text has no words. An epoch is done once
    its numbers are written, and is not repeated. The earliest epoch of highest validation F1 is loaded
    at the end. Another recipe or other rows in the same folder are an error. `stop_after` ends
    the run early, with that many epochs done.
    """
    spark = labelled.sparkSession
    counts = _prepare(labelled, path, recipe, key)
    rows = read_dataset(spark, f"{path}/rows", "training rows")
    of = {c: sum(n for (split, _, label), n in counts.items() if split == "train" and label == c) for c in (0, 1)}
    balance = {c: (of[0] + of[1]) / (2.0 * of[c]) if recipe.balanced else 1.0 for c in of}
    weights = np.zeros(recipe.dims + 1)
    done = min(recipe.epochs, stop_after or recipe.epochs)
    for epoch in range(done):
        place = f"{path}/epoch-{epoch}"
        if dataset_exists(spark, f"{place}/metrics"):
            weights = _read_weights(spark, place, recipe.dims)
            continue
        for step in range(recipe.steps):
            dealt = {c: counts.get(("train", step, c), 0) for c in (0, 1)}
            total = dealt[1] * balance[1] + dealt[0] * balance[0]
            if total:
                part = rows.filter((F.col("split") == "train") & (F.col("step") == step))
                sums = _error_sums(part, weights, balance)
                weights = _moved(weights, sums, total, recipe, epoch * recipe.steps + step)
        write_dataset(_weight_table(spark, weights), f"{place}/weights")
        held = rows.filter(F.col("split") == "validation")
        scored = held.withColumn("prediction", (margin_of(F.col("slots"), weights) > 0).cast("int"))
        numbers = binary_metrics(scored).select(F.lit(epoch).alias("epoch"), "*")
        write_dataset(numbers.coalesce(1), f"{place}/metrics")  # last: an epoch with metrics is whole
    return load_epochs(spark, path, recipe, done)


def load_epochs(spark: SparkSession, path: str, recipe: Recipe = Recipe(), done: int | None = None) -> EpochModel:
    """The best epoch of a finished run."""
    places = [f"{path}/epoch-{e}" for e in range(recipe.epochs if done is None else done)]
    metrics = read_dataset(spark, f"{places[0]}/metrics", "epoch")
    for place in places[1:]:
        metrics = metrics.unionByName(read_dataset(spark, f"{place}/metrics", "epoch"))
    best = metrics.orderBy(F.desc("f1"), "epoch").first()["epoch"]
    return EpochModel(_read_weights(spark, places[best], recipe.dims), best, metrics)


def score_epochs(texts: DataFrame, model: EpochModel, key: str = "review_id") -> DataFrame:
    """(key, label_name, confidence) of (key, text) rows; blank texts get no row."""
    asked = texts.filter(~is_blank(F.col("text"))).select(key, slots_of(F.col("text"), len(model.weights) - 1).alias("_slots"))
    margins = asked.select(key, F.round(margin_of(F.col("_slots"), model.weights), 6).alias("_margin"))
    return margins.select(
        key,
        class_name((F.col("_margin") > 0).cast("int")).alias("label_name"),
        F.round(1 / (1 + F.exp(-F.abs("_margin"))), 6).alias("confidence"),
    )


def slots_of(text: Column, dims: int) -> Column:
    """The slot of every word of a text, repeats included."""
    return F.transform(words(F.coalesce(text, F.lit(""))), lambda w: slot_of(w, dims).cast("int"))


def margin_of(slots: Column, weights: np.ndarray) -> Column:
    """Log odds of the positive class. The weights travel with the function: eight bytes per slot."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array(_margins(column, weights)[0])

    return F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR)(slots)


def _margins(column: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log odds, root of the number of words, the number itself, and all slots one after the other."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    root = np.sqrt(np.maximum(size, 1).astype(np.float64))
    sums = np.bincount(np.repeat(np.arange(len(size)), size), weights=weights[flat], minlength=len(size))
    return sums / root + weights[-1], root, size, flat


def _prepare(labelled: DataFrame, path: str, recipe: Recipe, key: str) -> dict[tuple[str, int, int], int]:
    """Write the rows of a new run; (split, step, label) -> number of rows."""
    spark = labelled.sparkSession
    row = labelled.select(key, "text", F.col("label").cast("int").alias("label"))
    seen = row.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key, "text", "label").cast("decimal(38,0)")).cast("string").alias("sum")
    ).first()
    if not seen["n"]:
        raise ValueError("training needs reviews of both classes")
    settings = {k: str(v) for k, v in asdict(recipe).items()} | {"n_rows": str(seen["n"]), "hashes": str(seen["sum"])}
    try:
        known = {r["name"]: r["value"] for r in read_dataset(spark, f"{path}/settings", "settings").collect()}
    except MissingDataset:
        step = F.conv(F.substring(key_hash(F.col(key)), 1, 8), 16, 10).cast("bigint") % recipe.steps
        dealt = with_split(row.withColumn("step", F.coalesce(step, F.lit(0)).cast("int")), key="text")
        rows = dealt.select("label", slots_of(F.col("text"), recipe.dims).alias("slots"), "split", "step")
        rows.write.mode("overwrite").partitionBy("split", "step").parquet(f"{path}/rows")
        write_dataset(spark.createDataFrame(list(settings.items()), "name string, value string").coalesce(1), f"{path}/settings")
    else:
        if known != settings:
            raise ValueError(f"{path} holds a run of another recipe or of other rows")
    groups = read_dataset(spark, f"{path}/rows").groupBy("split", "step", "label").count().collect()
    counts = {(r["split"], r["step"], r["label"]): r["count"] for r in groups}
    if {c for (split, _, c) in counts if split == "train"} != {0, 1}:
        raise ValueError("training needs reviews of both classes")
    return counts


def _error_sums(part: DataFrame, weights: np.ndarray, balance: dict[int, float]) -> np.ndarray:
    """Sum of the errors per slot, in multiples of 1 / SCALE."""
    dims = len(weights) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(dims + 1, np.int64)
        for batch in batches:
            margin, root, size, flat = _margins(batch.column("slots"), weights)
            label = batch.column("label").to_numpy()
            with np.errstate(over="ignore"):
                error = (1 / (1 + np.exp(-margin)) - label) * np.where(label == 1, balance[1], balance[0])
            each = np.floor(error / root * SCALE + 0.5).astype(np.int64)
            np.add.at(sums, flat, np.repeat(each, size))
            sums[dims] += np.floor(error * SCALE + 0.5).astype(np.int64).sum()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["slot", "errors"])

    partial = part.select("label", "slots").mapInArrow(run, "slot int, errors bigint")
    total = F.sum(F.col("errors").cast("decimal(38,0)")).cast("double").alias("errors")
    found = partial.groupBy("slot").agg(total).toArrow()  # at most dims + 1 rows
    sums = np.zeros(dims + 1)
    sums[found.column("slot").to_numpy()] = found.column("errors").to_numpy()
    return sums


def _moved(weights: np.ndarray, sums: np.ndarray, total: float, recipe: Recipe, step: int) -> np.ndarray:
    """Weights after one step; the constant term does not decay."""
    rate = rate_at(recipe, step)
    keep = np.full(len(weights), 1.0 - rate * recipe.decay)
    keep[-1] = 1.0
    return weights * keep - rate * (sums / SCALE / total)


def rate_at(recipe: Recipe, step: int) -> float:
    return recipe.rate * (1.0 - step / (recipe.epochs * recipe.steps))


def _weight_table(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    """(slot, weight) of the weights that are not zero."""
    at = np.flatnonzero(weights)
    slot = np.where(at == len(weights) - 1, CONSTANT, at).astype(np.int32)
    table = pa.table({"slot": slot, "weight": weights[at]})
    return spark.createDataFrame(table, "slot int, weight double")


def _read_weights(spark: SparkSession, place: str, dims: int) -> np.ndarray:
    found = read_dataset(spark, f"{place}/weights", "epoch").toArrow()
    weights = np.zeros(dims + 1)
    weights[found.column("slot").to_numpy()] = found.column("weight").to_numpy()  # the constant's -1 is the last place
    return weights
