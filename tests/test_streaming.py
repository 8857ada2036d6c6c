"""Counts over a stream with repeats, restarts and failed triggers."""

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import naive_bayes
from reviewloom.sources.tables import MissingDataset
from reviewloom.streaming import distribution, scoring


def by_length(batch):
    """A stand-in for a model: long texts are positive."""
    label = F.when(F.length("text") > 3, "POSITIVE").otherwise("NEGATIVE")
    return batch.filter("text IS NOT NULL").select("review_id", label.alias("label_name"))


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "review_id bigint, text string").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, state, score=by_length):
    stream = scoring.read_review_stream(spark, folder, max_files=1)
    distribution.start_counting(stream, score, out, state, available_now=True).awaitTermination()
    return {r.label_name: r["count"] for r in distribution.distribution(spark, out).collect()}


def test_repeats_count_once_over_restarts(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    arrive(spark, folder, [(1, "long text"), (2, "no"), (2, "no"), (None, "lost"), (3, None)])
    assert run(spark, folder, out, state) == {"POSITIVE": 1, "NEGATIVE": 1}
    arrive(spark, folder, [(1, "long text"), (4, "another")])
    arrive(spark, folder, [(4, "another"), (5, "no"), (3, None)])
    assert run(spark, folder, out, state) == {"POSITIVE": 2, "NEGATIVE": 2}
    assert run(spark, folder, out, state) == {"POSITIVE": 2, "NEGATIVE": 2}


def test_a_failed_trigger_is_repeated(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    arrive(spark, folder, [(1, "long text"), (2, "no")])

    def broken(batch):
        by_length(batch).groupBy("label_name").count().write.mode("overwrite").parquet(f"{out}/batch=0")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(spark, folder, out, state, broken)
    assert run(spark, folder, out, state) == {"POSITIVE": 1, "NEGATIVE": 1}


def test_no_counts_yet(spark, tmp_path):
    with pytest.raises(MissingDataset):
        distribution.distribution(spark, str(tmp_path / "gone"))


def test_word_model_is_saved_and_loaded(spark, tmp_path):
    rows = [(i, f"{'good fine' if i % 2 else 'bad awful'} word{i}", i % 2) for i in range(60)]
    model = naive_bayes.train_words(spark.createDataFrame(rows, "review_id bigint, text string, label int"))
    with pytest.raises(MissingDataset):
        naive_bayes.load_words(spark, str(tmp_path / "model"))
    naive_bayes.save_words(model, str(tmp_path / "model"))
    again = naive_bayes.load_words(spark, str(tmp_path / "model"))
    texts = spark.createDataFrame([(1, "good word3"), (2, "awful"), (3, " "), (4, "unseen")], "review_id bigint, text string")
    assert naive_bayes.score_words(texts, again).collect() == naive_bayes.score_words(texts, model).collect()
    assert again.metrics.collect() == model.metrics.collect()
