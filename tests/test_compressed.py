"""Search over compressed vectors against brute force."""

import numpy as np
import pytest

from reviewloom.operators import compressed, search
from reviewloom.sources.testdata import stored_vectors

RNG = np.random.default_rng(5)


def frame(spark, matrix, key="review_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{key} bigint, embedding array<float>")


def clustered(n=400, dims=16):
    centres = RNG.normal(size=(10, dims))
    m = centres[RNG.integers(0, 10, n)] + RNG.normal(size=(n, dims)) * 0.4
    m[7:30] = m[7]
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    m[3] = 0
    return m.astype(np.float32)


@pytest.mark.parametrize(("chunk", "block"), [(4096, 1000), (33, 3)])
def test_exact_search_equals_comparing_all(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(compressed, "CHUNK", chunk)
    monkeypatch.setattr(compressed, "QUERY_BLOCK", block)
    m = clustered()
    index, asked = frame(spark, m), frame(spark, np.concatenate([m[::50], RNG.normal(size=(3, 16)).astype(np.float32)]), "query_id")
    books = compressed.fit_code_books(index, parts=4, codes=16)
    codes = compressed.compress(index, books)
    found = compressed.nearest_compressed(index, codes, books, asked, 7, exact=True)
    want = search.nearest_batch(index, asked, 7)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert codes.filter("length(code) <> 4").count() == 0 and codes.count() == len(m)


def test_recall_of_candidates(spark, sf):
    """Every hundredth stored vector against all, as the registered query has it."""
    index = stored_vectors(spark, sf)
    books = compressed.fit_code_books(index, codes=32)
    asked = index.filter("review_id % 100 = 0").withColumnRenamed("review_id", "query_id")
    truth = search.nearest_batch(index, asked, 10)
    found = compressed.nearest_compressed(index, compressed.compress(index, books), books, asked, 10, candidates=100)
    assert compressed.recall(found, truth) >= 0.9


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "review_id bigint, embedding array<float>")
    asked = frame(spark, clustered(40)[:5], "query_id")
    assert compressed.fit_code_books(none) == []
    assert compressed.nearest_compressed(none, none, [], asked, 3).collect() == []
    with pytest.raises(ValueError):
        compressed.fit_code_books(frame(spark, clustered(40)), parts=40)


def test_tasks_hand_on_the_best_rows_only(spark):
    """Vectors without structure, which bounds rule out badly: `k` rows a query and task leave the tasks."""
    m = RNG.normal(size=(300, 16)).astype(np.float32)
    index, asked = frame(spark, m).coalesce(2), frame(spark, m[::30], "query_id")
    books = compressed.fit_code_books(index, parts=2, codes=2)
    rows = compressed.compress(index, books).join(index, "review_id").coalesce(2)
    found = compressed._certain(rows, asked.toArrow(), books, 4)
    assert found.groupBy("query_id").count().agg({"count": "max"}).first()[0] <= 2 * 4
