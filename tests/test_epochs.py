"""Training by epochs: against a plain version, restarts, other partitionings."""

import hashlib
import math
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import epochs
from reviewloom.operators.sampling import with_split

RECIPE = epochs.Recipe(epochs=3, steps=3, dims=512)
SCHEMA = "review_id bigint, text string, label int"
GOOD, BAD = "fresh tasty great lovely".split(), "stale broken awful leaking".split()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    made = []
    for i in range(400):
        label = int(i % 4 > 0)
        chosen = [*rng.choice(GOOD if label else BAD, 2), *rng.choice(["the", "box", "tea", "and"], 3)]
        made.append((i, " ".join(rng.permutation(chosen)) + f" order {i}", label))
    copies = [(1000 + i, "great tea", 1) for i in range(150)]  # a text that a quarter of all rows repeat
    return made + copies + [(2000, None, 1), (2001, "", 0), (2002, "tea " * 3000, 1)]


def plain(rows, split):
    """The weights of every epoch, row by row."""

    def number(text, modulus):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % modulus

    train = [r for r in rows if split[r[0]] == "train"]
    n = [sum(r[2] == c for r in train) for c in (0, 1)]
    balance = [len(train) / (2.0 * c) for c in n]
    weights, constant, found = [0.0] * RECIPE.dims, 0.0, []
    for t in range(RECIPE.epochs * RECIPE.steps):
        part = [r for r in train if number(f"42:{r[0]}", RECIPE.steps) == t % RECIPE.steps]
        sums, constant_sum = [0] * RECIPE.dims, 0
        for _, text, label in part:
            slots = [number(w, RECIPE.dims) for w in re.findall(r"\w+", (text or "").lower())]
            root = math.sqrt(max(len(slots), 1))
            margin = sum(weights[s] for s in slots) / root + constant
            error = (1 / (1 + math.exp(-margin)) - label) * balance[label]
            for s in slots:
                sums[s] += math.floor(error / root * epochs.SCALE + 0.5)
            constant_sum += math.floor(error * epochs.SCALE + 0.5)
        total, rate = sum(balance[r[2]] for r in part), epochs.rate_at(RECIPE, t)
        weights = [w * (1 - rate * RECIPE.decay) - rate * g / epochs.SCALE / total for w, g in zip(weights, sums)]
        constant -= rate * constant_sum / epochs.SCALE / total
        if t % RECIPE.steps == RECIPE.steps - 1:
            found.append([*weights, constant])
    return found


@pytest.fixture(scope="module")
def labelled(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def run(labelled, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("epochs"))
    return path, epochs.train_epochs(labelled, path, RECIPE)


def test_weights_and_metrics_equal_a_plain_version(spark, labelled, rows, run):
    path, model = run
    split = {r["review_id"]: r["split"] for r in with_split(labelled, key="text").collect()}
    every = plain(rows, split)
    for epoch, weights in enumerate(every):
        got = epochs._read_weights(spark, f"{path}/epoch-{epoch}", RECIPE.dims)
        assert np.allclose(got, weights, rtol=0, atol=1e-7)
    assert np.array_equal(model.weights, epochs._read_weights(spark, f"{path}/epoch-{model.epoch}", RECIPE.dims))
    f1 = {r["epoch"]: r["f1"] for r in model.metrics.collect()}
    assert len(f1) == 3 and model.epoch == min(e for e in f1 if f1[e] == max(f1.values()))


def test_one_epoch_of_the_default_steps_learns_the_words(labelled, tmp_path):
    model = epochs.train_epochs(labelled, str(tmp_path / "run"), epochs.Recipe(epochs=1))
    metrics = model.metrics.first()
    assert metrics.f1 > 0.95 and metrics.accuracy > metrics.majority_rate


def test_a_lost_run_goes_on_to_the_same_model(spark, labelled, run, tmp_path):
    path = str(tmp_path / "run")
    early = epochs.train_epochs(labelled, path, RECIPE, stop_after=1)
    assert early.epoch == 0 and early.metrics.count() == 1
    # The second epoch was lost between its weights and its metrics.
    shutil.copytree(f"{path}/epoch-0/weights", f"{path}/epoch-1/weights")
    resumed = epochs.train_epochs(labelled.repartition(7, "text"), path, RECIPE)
    assert resumed.epoch == run[1].epoch and np.array_equal(resumed.weights, run[1].weights)
    assert sorted(map(tuple, resumed.metrics.collect())) == sorted(map(tuple, run[1].metrics.collect()))
    assert np.array_equal(epochs.load_epochs(spark, path, RECIPE).weights, resumed.weights)


def test_finished_epochs_are_not_repeated(labelled, run, monkeypatch):
    def never(*_):
        raise AssertionError("a finished epoch was trained again")

    monkeypatch.setattr(epochs, "_error_sums", never)
    again = epochs.train_epochs(labelled, run[0], RECIPE)
    assert np.array_equal(again.weights, run[1].weights)


def test_same_bits_at_any_partitioning(labelled, run, tmp_path):
    other = epochs.train_epochs(labelled.repartition(13), str(tmp_path / "other"), RECIPE)
    assert np.array_equal(other.weights, run[1].weights)


def test_another_recipe_or_other_rows_are_an_error(labelled, run):
    with pytest.raises(ValueError, match="another recipe"):
        epochs.train_epochs(labelled, run[0], epochs.Recipe(epochs=3, steps=3, dims=256))
    with pytest.raises(ValueError, match="other rows"):
        epochs.train_epochs(labelled.filter("review_id <> 7"), run[0], RECIPE)


def test_training_needs_both_classes(spark, tmp_path):
    for name, made in (("one", [(i, f"text {i}", 1) for i in range(40)]), ("none", [])):
        with pytest.raises(ValueError, match="both classes"):
            epochs.train_epochs(spark.createDataFrame(made, SCHEMA), str(tmp_path / name), RECIPE)


def test_scores(spark, labelled, tmp_path):
    model = epochs.train_epochs(labelled, str(tmp_path / "run"), epochs.Recipe(epochs=1))
    texts = [(1, "A great, fresh and lovely tea"), (2, "Stale and broken"), (3, "  "), (4, None)]
    asked = spark.createDataFrame(texts, "review_id bigint, text string")
    got = {r.review_id: r for r in epochs.score_epochs(asked, model).collect()}
    assert {k: r.label_name for k, r in got.items()} == {1: "POSITIVE", 2: "NEGATIVE"}
    assert all(0.5 <= r.confidence <= 1 for r in got.values())


def test_a_step_reads_its_own_part(spark, run):
    rows = spark.read.parquet(f"{run[0]}/rows")
    part = rows.filter((F.col("split") == "train") & (F.col("step") == 0))
    plan = part.select("slots")._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "(split#" in pruned and "(step#" in pruned
