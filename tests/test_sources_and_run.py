"""Reading, writing and the batch run."""

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import themes
from reviewloom.plans import full_run
from reviewloom.session import count_stored, discard_stored, ensure_checkpoint_dir, stored
from reviewloom.sources import tables
from reviewloom.sources.testdata import raw_reviews

CSV = """Id,ProductId,Score,Summary,HelpfulnessNumerator,HelpfulnessDenominator,Text
1,p,5,Good,1,2,"Line one
line ""two"", with comma"
2,p,nan,n/a,x,,"  padded  "
3,p,4.0,NULL,0,0,plain
4,p,4.5,ok,0,0,NA
"""


def test_csv_reader(spark, tmp_path):
    (tmp_path / "r.csv").write_text(CSV)
    rows = tables.read_reviews_csv(spark, str(tmp_path / "r.csv")).orderBy("Id").collect()
    assert [r.Id for r in rows] == [1, 2, 3, 4]
    assert rows[0].Text == 'Line one\nline "two", with comma' and rows[1].Text == "  padded  "
    assert [r.Score for r in rows] == [5, None, 4, None]
    assert [r.Summary for r in rows] == ["Good", None, None, "ok"]
    assert [r.HelpfulnessNumerator for r in rows] == [1, None, 0, 0]


def test_csv_export_reads_back(spark, sf, tmp_path):
    raw = raw_reviews(spark, sf).drop("source")
    tables.export_csv(raw, str(tmp_path / "csv"))
    back = tables.read_reviews_csv(spark, str(tmp_path / "csv")).select(raw.columns)
    assert back.count() == raw.count()
    assert raw.exceptAll(back).count() == 0


def test_missing_inputs_are_named(spark, tmp_path):
    gone = str(tmp_path / "gone")
    with pytest.raises(tables.MissingDataset, match="search corpus"):
        tables.read_dataset(spark, gone, "search corpus")
    with pytest.raises(FileNotFoundError):
        tables.read_reviews_csv(spark, gone)
    with pytest.raises(FileNotFoundError):
        tables.read_reviews_parquet(spark, gone)
    assert not tables.dataset_exists(spark, gone) and not tables.model_exists(spark, gone)


def test_write_overwrites_and_creates_parents(spark, tmp_path):
    path = str(tmp_path / "a" / "b")
    tables.write_dataset(spark.range(5), path)
    tables.write_dataset(spark.range(3), path)
    assert tables.read_dataset(spark, path).count() == 3
    tables.write_keyed(spark.range(100).withColumnRenamed("id", "review_id"), path)
    assert tables.read_dataset(spark, path).count() == 100


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    left = spark.range(500).select(F.col("id").alias("review_id"), (F.col("id") * 2).alias("a"))
    right = spark.range(100, 700).select(F.col("id").alias("review_id"), (F.col("id") * 3).alias("b"))
    one = tables.write_bucketed(left, "bucketed_one", str(tmp_path / "one"), 4)
    two = tables.write_bucketed(right, "bucketed_two", str(tmp_path / "two"), 4)
    joined = one.hint("merge").join(two, "review_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 400 and joined.filter("b <> a * 3 / 2").isEmpty()
    spark.sql("DROP TABLE bucketed_one")
    spark.sql("DROP TABLE bucketed_two")


def test_profile_and_preview(spark):
    df = spark.range(9)
    assert tuple(tables.source_profile(df).first()) == (9, 1, "id")
    assert [r.id for r in tables.preview(df, "id").collect()] == [0, 1, 2, 3, 4]


def test_stored_tables_lie_in_the_shared_folder(spark):
    folder = ensure_checkpoint_dir(spark)
    kept = stored(spark.range(4))
    assert kept.count() == 4 and kept.inputFiles()[0].replace("file://", "").startswith(folder)


def test_stored_tables_can_be_discarded(spark):
    first = stored(spark.range(3))
    keep = count_stored(spark)
    path = stored(spark.range(4)).inputFiles()[0].rpartition("/")[0]
    assert discard_stored(spark, keep) == 1 and discard_stored(spark, keep) == 0
    assert not tables.dataset_exists(spark, path) and first.count() == 3


def test_full_run(spark, sf, tmp_path):
    out = str(tmp_path / "run")
    before = full_run.run_stats(spark, out).first()
    assert tuple(before) == (0, 0, False, False, False)
    raw = raw_reviews(spark, sf)
    paths = full_run.run_all(spark, raw, out, sample_size=150, min_topic_size=5, topic_counts=(2, 3), embedding_dims=128)
    clean = tables.read_dataset(spark, paths["clean"])
    corpus = tables.read_dataset(spark, paths["corpus"])
    index = tables.read_dataset(spark, paths["index"])
    assert clean.count() == 150
    assert index.count() == corpus.count() == index.join(corpus, "review_id").count()
    assigned = tables.read_dataset(spark, paths["assigned"])
    assert assigned.count() == clean.filter("label = 0").count() and "topic" in assigned.columns
    info = tables.read_dataset(spark, paths["topics"])
    assert info.agg(F.sum("count")).first()[0] == assigned.count()
    stats = full_run.run_stats(spark, out).first()
    assert stats.review_count == corpus.count() and stats.topic_count == info.filter("topic <> -1").count()
    assert stats.model_ready and stats.search_ready and stats.topics_ready
    # Saved themes give the same topics to the same texts, and topics to new ones.
    embedder, fitted = tables.load_model(spark, paths["embedder"]), tables.read_dataset(spark, paths["themes"])
    again = themes.assign_themes(assigned.select("review_id", "text"), embedder, fitted)
    assert again.exceptAll(assigned.select("review_id", "topic")).count() == 0
    new = spark.createDataFrame([(1, "the and of"), (2, None)], "review_id bigint, text string")
    assert themes.assign_themes(new, embedder, fitted).count() == 2
