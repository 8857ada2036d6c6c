"""Cleaning, sampling and splitting."""

import hashlib

import pytest

from reviewloom.operators import prepare, sampling
from reviewloom.functions.constants import REVIEW_FIELDS
from reviewloom.sources.testdata import raw_reviews, table

LONG = "a review that is long enough to keep"


def raw(spark, rows):
    return spark.createDataFrame(
        rows, "Id bigint, Text string, Summary string, Score int, HelpfulnessNumerator int, HelpfulnessDenominator int, Extra string"
    )


def test_clean_reviews_labels_and_drops(spark):
    rows = [(i, LONG, None, s, 1, 2, "x") for i, s in enumerate([1, 2, 3, 4, 5, 0, None])]
    rows += [(10, None, "s", 5, 1, 2, "x"), (11, "  " + "x" * 20 + " ", "s", 5, 1, 2, "x"), (12, " " + "x" * 21, "s", 5, 1, 2, "x")]
    got = prepare.clean_reviews(raw(spark, rows)).orderBy("review_id")
    assert got.columns == ["review_id", *REVIEW_FIELDS.values(), "label"]
    assert [(r.review_id, r.label) for r in got.collect()] == [(0, 0), (1, 0), (3, 1), (4, 1), (12, 1)]
    assert got.filter("review_id = 12").first().text == "x" * 21
    assert got.filter("review_id = 0").first().summary is None


def test_optional_columns_may_be_absent(spark):
    df = spark.createDataFrame([(1, LONG, 5)], "Id bigint, Text string, Score int")
    assert prepare.clean_reviews(df).columns == ["review_id", "text", "Score", "label"]
    assert prepare.search_corpus(prepare.clean_reviews(df)).columns == ["review_id", "text", "Score", "label"]
    carried = prepare.clean_reviews(df.selectExpr("*", "'s' AS shop"), carry=("shop",))
    assert carried.first().shop == "s"


def test_longest_texts_reach_every_set(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    long = docs.join(labels, "doc_id", "left_anti").filter("n_chars >= 12000").withColumnRenamed("doc_id", "Id")
    rated = raw_reviews(spark, sf).join(long.select("Id"), "Id").filter("Score IN (1, 2, 4, 5)")
    wanted = {r.Id: len(r.Text.strip()) for r in rated.collect()}
    assert wanted
    clean = prepare.clean_reviews(raw_reviews(spark, sf))
    for reviews in (clean, prepare.search_corpus(clean)):
        found = {r.review_id: len(r.text) for r in reviews.collect()}
        assert {i: found.get(i) for i in wanted} == wanted


def test_length_limits(spark):
    rows = [(i, "y" * n, "s", 1, 0, 0, "") for i, n in enumerate([20, 21, 30, 31])]
    clean = prepare.clean_reviews(raw(spark, rows))
    assert [r.review_id for r in clean.orderBy("review_id").collect()] == [1, 2, 3]
    assert [r.review_id for r in prepare.search_corpus(clean).collect()] == [3]
    assert prepare.cluster_input(prepare.negative_reviews(clean)).count() == 3


def test_label_distribution_order(spark):
    df = spark.createDataFrame([(1,), (0,), (1,)], "label int")
    assert [tuple(r) for r in prepare.label_distribution(df).collect()] == [(1, 2), (0, 1)]


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 1), (7, 7), (500, 500), (1000, 1000), (5000, 1000), (None, 1000)])
def test_sample_is_exact(spark, n, expected):
    df = spark.range(1000).withColumnRenamed("id", "review_id")
    assert sampling.sample_exact(df, n).count() == expected


def test_sample_is_the_same_at_any_partitioning(spark):
    df = spark.range(2000).withColumnRenamed("id", "review_id")
    want = sorted(range(2000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:99]
    for parts in (2, 7):
        got = sampling.sample_exact(df.repartition(parts), 99).collect()
        assert sorted(r.review_id for r in got) == sorted(want)
    with pytest.raises(ValueError):
        sampling.sample_exact(df, -1)


def test_split_shares_and_copies(spark):
    df = spark.range(5000).selectExpr("id AS review_id", "CAST(id % 100 AS string) AS text")
    shares = {r.split: r["count"] / 5000 for r in sampling.with_split(df).groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["validation"] - 0.1) < 0.02
    by_text = sampling.with_split(df, "text").select("text", "split").distinct()
    assert by_text.count() == 100


def test_missing_filters_reach_the_scan(spark, sf, tmp_path):
    raw_reviews(spark, sf).write.parquet(str(tmp_path / "raw"))
    clean = prepare.clean_reviews(spark.read.parquet(str(tmp_path / "raw")))
    plan = clean.select("review_id", "label")._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(Text)" in plan and "IsNotNull(Score)" in plan
    assert "Summary" not in plan.split("ReadSchema")[1]
