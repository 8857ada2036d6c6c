"""Training, metrics, scoring, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import sentiment
from reviewloom.sources import tables
from reviewloom.streaming import scoring

GOOD = "amazing fresh tasty wonderful great lovely perfect delicious".split()
BAD = "stale broken terrible awful rotten leaking horrible disgusting".split()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        label = int(i % 3 > 0)
        words = rng.choice(GOOD if label else BAD, 4).tolist() + rng.choice(["the", "box", "tea", "and"], 6).tolist()
        rows.append((i, " ".join(rng.permutation(words)) + f" order {i}", label))
    return spark.createDataFrame(rows, "review_id bigint, text string, label int")


@pytest.fixture(scope="module")
def trained(labelled):
    return sentiment.train_sentiment(labelled, dims=1 << 12, max_iter=10)


def test_metrics_are_binary_not_weighted(spark):
    rows = [(1, 1)] * 7 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)]
    scored = spark.createDataFrame(rows, "prediction int, label int")
    got = sentiment.binary_metrics(scored).first()
    assert got.n_rows == 13 and got.accuracy == pytest.approx(8 / 13)
    assert got.f1 == pytest.approx(14 / 19) and got.majority_rate == pytest.approx(10 / 13)
    none = sentiment.binary_metrics(spark.createDataFrame([(0, 0)], "prediction int, label int")).first()
    assert none.f1 == 0.0


def test_model_learns_and_reports_both_splits(trained):
    metrics = {r.split: r for r in trained.metrics.collect()}
    assert set(metrics) == {"validation", "test"}
    assert metrics["test"].accuracy > metrics["test"].majority_rate
    assert trained.params in [p for p, _ in trained.validation_f1] and len(trained.validation_f1) == 3
    best = max(f1 for _, f1 in trained.validation_f1)
    assert dict((str(p), f) for p, f in trained.validation_f1)[str(trained.params)] == best


def test_scores_survive_save_and_load(spark, labelled, trained, tmp_path):
    tables.save_model(trained.pipeline, str(tmp_path / "m"))
    loaded = tables.load_model(spark, str(tmp_path / "m"))
    texts = labelled.select("review_id", "text")
    first = sentiment.score_reviews(texts, trained.pipeline)
    assert first.exceptAll(sentiment.score_reviews(texts, loaded)).count() == 0
    bounds = first.agg(F.min("confidence"), F.max("confidence")).first()
    assert 0.5 <= bounds[0] <= bounds[1] <= 1.0
    assert {r.label_name for r in first.select("label_name").distinct().collect()} == {"POSITIVE", "NEGATIVE"}
    shown = sentiment.prediction_display(first).first()
    assert shown.percent == round(shown.confidence * 100) and shown.confidence_text == f"{shown.confidence:.4f}"
    with pytest.raises(tables.MissingDataset, match="model"):
        tables.load_model(spark, str(tmp_path / "nowhere"))


def test_example_texts_and_blanks(spark, trained):
    texts = spark.createDataFrame(
        [
            (1, "An amazing fresh tea, lovely and wonderful to drink."),
            (2, "Two of the jars came broken, and what was left smelled stale."),
            (3, "   "),
            (4, None),
        ],
        "review_id bigint, text string",
    )
    got = {r.review_id: r.label_name for r in sentiment.score_reviews(texts, trained.pipeline).collect()}
    assert got == {1: "POSITIVE", 2: "NEGATIVE"}
    counts = sentiment.sentiment_distribution(sentiment.score_reviews(texts, trained.pipeline)).collect()
    assert [tuple(r) for r in counts] == [("NEGATIVE", 1), ("POSITIVE", 1)]


def test_training_needs_both_classes(spark):
    one = spark.createDataFrame([(f"text {i}", 1) for i in range(50)], "text string, label int")
    with pytest.raises(ValueError, match="both classes"):
        sentiment.train_sentiment(one)


def test_token_window(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, None)], "id int, text string")
    got = sentiment.token_window(df, 3).orderBy("id").collect()
    assert [(r.n_tokens, r.tokens) for r in got] == [(4, ["a", "b", "c"]), (0, [])]


def test_token_windows_leave_nothing_out(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "a b c")], "id int, text string")
    got = sentiment.token_windows(df, 3).orderBy("id", "window").collect()
    assert [(r.id, r.window, r.tokens) for r in got] == [
        (1, 0, ["a", "b", "c"]),
        (1, 1, ["d", "e"]),
        (2, 0, []),
        (3, 0, ["a", "b", "c"]),
    ]


def test_stream_scores_each_review_once(spark, trained, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = [(1, "amazing fresh tea, wonderful"), (2, "short"), (3, None), (4, " stale and broken, awful ")]
    spark.createDataFrame(rows, scoring.REVIEW_STREAM_SCHEMA).write.parquet(folder)
    for extra in ([], [(5, "rotten horrible terrible box")]):
        if extra:
            spark.createDataFrame(extra, scoring.REVIEW_STREAM_SCHEMA).write.mode("append").parquet(folder)
        stream = scoring.scored_stream(scoring.read_review_stream(spark, folder), trained.pipeline)
        scoring.start_scoring(stream, out, check, available_now=True).awaitTermination(120)
    got = {r.review_id: r.label_name for r in spark.read.parquet(out).collect()}
    assert got == {1: "POSITIVE", 4: "NEGATIVE", 5: "NEGATIVE"} and spark.read.parquet(out).count() == 3
