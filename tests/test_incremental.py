"""New and changed reviews against a full run over everything."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from reviewloom.operators.embedding import embed_hashed, fit_hashed_embedder
from reviewloom.operators.prepare import clean_reviews, label_distribution, search_corpus
from reviewloom.plans import incremental
from reviewloom.sources.testdata import raw_reviews


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(out):
    found = {}
    for path in glob.glob(f"{out}/*/part=*/*.parquet"):
        found.setdefault(path.split("part=")[1].split("/")[0], set()).add((path, os.stat(path).st_mtime_ns))
    return found


@pytest.fixture(scope="module")
def raw(spark, sf):
    return raw_reviews(spark, sf).drop("source").cache()


def test_new_and_changed_reviews_equal_a_full_run(spark, raw, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("increment"))
    embedder = fit_hashed_embedder(search_corpus(clean_reviews(raw)), 32)
    place = F.pmod(F.xxhash64("Id"), F.lit(50))
    # First without some rows, others with another text, score or none.
    first = raw.filter(place != 0).withColumns(
        {"Text": F.when(place == 1, F.lit("short")).otherwise(F.col("Text")), "Score": F.when(place == 2, 3).otherwise(F.col("Score"))}
    )
    assert incremental.add_reviews(spark, first, out, embedder, parts=40) == list(range(40))
    before = files(out)
    again = incremental.add_reviews(spark, raw.filter(place > 2), out, embedder, parts=40)
    assert again == [] and files(out) == before
    touched = incremental.add_reviews(spark, raw.filter(place <= 2).unionByName(raw.limit(3)), out, embedder, parts=40)
    after = files(out)
    assert 0 < len(touched) < 40
    assert all((before[str(p)] == after[str(p)]) == (p not in touched) for p in range(40))
    full = clean_reviews(raw)
    corpus = search_corpus(full)
    assert rows(incremental.current_reviews(spark, out)) == rows(full.select(incremental.current_reviews(spark, out).columns))
    assert rows(incremental.current_corpus(spark, out)) == rows(corpus.select(incremental.current_corpus(spark, out).columns))
    assert rows(incremental.current_index(spark, out)) == rows(embed_hashed(corpus, embedder).select("review_id", "embedding"))
    assert rows(incremental.current_labels(spark, out)) == rows(label_distribution(full))


def test_repeated_and_keyless_arrivals(spark, tmp_path):
    schema = "Id bigint, Text string, Summary string, Score int, HelpfulnessNumerator int, HelpfulnessDenominator int"
    long = "a text that is long enough to be searched"
    arrivals = spark.createDataFrame([(1, long, None, 5, 0, 0), (1, long, None, 5, 0, 0), (None, long, None, 5, 0, 0), (2, None, None, 1, 0, 0)], schema)
    out = str(tmp_path / "out")
    incremental.add_reviews(spark, arrivals, out, parts=4)
    assert [r["review_id"] for r in incremental.current_reviews(spark, out).collect()] == [1]
    # A review that loses its score leaves all views; its part is not empty.
    assert incremental.add_reviews(spark, arrivals.filter("Id = 1").limit(1).withColumn("Score", F.lit(None).cast("int")), out, parts=4)
    assert incremental.current_reviews(spark, out).collect() == incremental.current_labels(spark, out).collect() == []
    assert incremental.add_reviews(spark, arrivals.limit(0), out, parts=4) == []
