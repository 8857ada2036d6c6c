"""Search results against brute force, on every path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import batch, embedding, keywords, ranking, routed, search, text_search

RNG = np.random.default_rng(7)


def unit_rows(n, dims=8, copies=0):
    """`n` unit vectors; the last `copies` equal the first one."""
    m = RNG.normal(size=(n, dims))
    if copies:
        m[-copies:] = m[0]
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, matrix, key="review_id", start=0):
    rows = [(start + i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>")


def brute(matrix, query, k):
    scores = np.round(matrix.astype(np.float64) @ np.asarray(query, dtype=np.float64), 9)
    order = sorted(range(len(matrix)), key=lambda i: (-scores[i], i))[:k]
    return [(i, scores[i]) for i in order]


def pairs(df):
    return [(r.review_id, r.score) for r in df.collect()]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_nearest(spark, parts):
    m = unit_rows(60, copies=25)
    index = frame(spark, m).repartition(parts)
    assert pairs(search.nearest(index, m[0], 10)) == brute(m, m[0], 10)
    assert len(pairs(search.nearest(index, m[0], 100))) == 60
    assert pairs(search.nearest(index, m[0], 0)) == []
    with pytest.raises(ValueError):
        search.nearest(index, m[0], -1)


def check_batch(got, m, q, k):
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.review_id, r.score))
    for j, query in enumerate(q):
        want = [(n, i, s) for n, (i, s) in enumerate(brute(m, query, k), start=1)]
        assert sorted(found[j]) == want


@pytest.mark.parametrize("parts", [1, 5])
def test_nearest_batch(spark, parts):
    m, q = unit_rows(70, copies=30), unit_rows(9)
    q[1] = m[0]
    check_batch(search.nearest_batch(frame(spark, m).repartition(parts), frame(spark, q, "query_id"), 6), m, q, 6)


def test_nearest_batch_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(batch, "MAX_BROADCAST_QUERIES", 4)
    monkeypatch.setattr(batch, "BLOCK_ROWS", 16)
    m, q = unit_rows(70, copies=30), unit_rows(11)
    q[1] = m[0]
    check_batch(search.nearest_batch(frame(spark, m), frame(spark, q, "query_id"), 6), m, q, 6)


def test_nearest_batch_edge_cases(spark):
    index = frame(spark, unit_rows(5))
    none = spark.createDataFrame([], "query_id bigint, embedding array<float>")
    assert search.nearest_batch(index, none, 3).count() == 0
    nulls = spark.createDataFrame([(9, None)], "review_id bigint, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0] * 8), ("n", None)], "query_id string, embedding array<float>")
    got = search.nearest_batch(index.union(nulls), asked, 50)
    assert got.count() == 5 and {r.query_id for r in got.collect()} == {"q"}
    assert search.nearest(index.union(nulls), [1.0] * 8, 50).count() == 5


@pytest.mark.parametrize("clustered", [False, True])
def test_cells_give_the_exact_result(spark, tmp_path, clustered):
    m = unit_rows(300, 6, copies=100)
    m[17] = 0
    if clustered:
        centres = unit_rows(5, 6)
        m = centres[np.arange(300) % 5] + 0.05 * unit_rows(300, 6)
        m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    index = frame(spark, m)
    centres = search.fit_cells(index, n_cells=5)
    search.write_cells(search.with_cells(index, centres), str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    bounds = [tuple(r) for r in search.cell_bounds(cells).collect()]
    for query in [*m[:3], *unit_rows(3, 6)]:
        best = search.nearest_in_cells(cells, centres, bounds, query, 7)
        assert pairs(best) == brute(m, query, 7)
    plan = search.nearest_in_cells(cells, centres, bounds, m[1], 7)._jdf.queryExecution().executedPlan().toString()
    # Further cells are read as folders; where the clusters are distinct, none is read at all.
    assert ("PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell")) == (not clustered)


@pytest.mark.parametrize("parts", [50_000, 7])
def test_routed_batch_gives_the_exact_result(spark, monkeypatch, parts):
    """Clusters, copies and a zero vector; slices of rows and groups of queries."""
    monkeypatch.setattr(routed, "CELL_ROWS", parts)
    monkeypatch.setattr(routed, "CELL_QUERIES", parts)
    centre = np.repeat(unit_rows(12, 6), 25, axis=0)
    m = centre + RNG.normal(size=centre.shape).astype(np.float32) * 0.03
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    m[40:60], m[5] = m[40], 0
    index = frame(spark, m)
    centres = search.fit_cells(index, n_cells=12)
    cells = search.stored(search.with_cells(index, centres))
    bounds = [tuple(r) for r in search.cell_bounds(cells).collect()]
    q = np.concatenate([m[::20], unit_rows(4, 6)])
    asked = frame(spark, q, "query_id")
    check_batch(routed.nearest_batch_in_cells(cells, centres, bounds, asked, 6), m, q, 6)
    sizes = {c: n for c, n, _ in bounds}
    first = routed.route(asked, centres, bounds, 6).collect()
    worst = [(i, [float(x) for x in v], float(brute(m, v, 6)[-1][1])) for i, v in enumerate(q)]
    floors = spark.createDataFrame(worst, "query_id bigint, embedding array<float>, floor double")
    then = routed.route(floors, centres, bounds, 6, floors=True).collect()
    compared = sum(sizes[r["cell"]] for r in first + then)
    assert compared < len(q) * len(m) / 2  # rows compared, of all pairs


def test_routed_batch_of_nothing(spark):
    index = frame(spark, unit_rows(10))
    centres = search.fit_cells(index, n_cells=2)
    cells = search.with_cells(index, centres)
    bounds = [tuple(r) for r in search.cell_bounds(cells).collect()]
    none = spark.createDataFrame([(1, None)], "query_id bigint, embedding array<float>")
    assert routed.nearest_batch_in_cells(cells, centres, bounds, none, 3).collect() == []
    assert routed.nearest_batch_in_cells(cells, centres, bounds, frame(spark, unit_rows(2), "query_id"), 0).collect() == []
    assert len(routed.nearest_batch_in_cells(cells, centres, bounds, frame(spark, unit_rows(2), "query_id"), 30).collect()) == 20


def test_rows_without_a_vector_are_no_hits(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 0.0]), (4, [0.6, 0.8])]
    index = spark.createDataFrame(rows, "review_id bigint, embedding array<float>")
    assert [r.review_id for r in search.nearest(index, [1.0, 0.0], 4).collect()] == [1, 4]
    cells = search.with_cells(index.filter("review_id <> 3"), [[1.0, 0.0], [0.0, 1.0]])
    assert {r.review_id: r.cell for r in cells.collect()} == {1: 0, 4: 1}


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [
        (1, "The box was broken and the chips were stale", "bad", 1),
        (2, "Great tea, great taste & fast shipping", None, 5),
        (3, "Broken box, broken bottle, leaking everywhere", "leak", 2),
        (4, "Nothing to add here at all", "meh", None),
        (5, "Broken box, broken bottle, leaking everywhere", "leak again", 2),
    ]
    return spark.createDataFrame(texts, "review_id bigint, text string, summary string, Score int")


def test_fetch_hits(spark, corpus):
    best = spark.createDataFrame([(3, 0.9), (2, 0.8)], "review_id bigint, score double").orderBy(F.desc("score"))
    hits = search.fetch_hits(best, corpus, 2)
    assert [(r["rank"], r.review_id, r.summary, r.rating) for r in hits.collect()] == [(1, 3, "leak", 2), (2, 2, None, 5)]
    assert [tuple(r) for r in search.relevance_table(hits).select("label", "score").collect()] == [
        ("Result 2", 0.8),
        ("Result 1", 0.9),
    ]


def test_search_reviews_by_text(spark, corpus):
    embedder = embedding.fit_hashed_embedder(corpus, dims=256)
    index = embedding.embed_hashed(corpus, embedder)
    found = search.search_reviews(" broken bottle ", embedder, index, corpus, 2).collect()
    assert [r.review_id for r in found] == [3, 5]
    for blank in ("", "  \n", None):
        empty = search.search_reviews(blank, embedder, index, corpus, 2)
        assert empty.count() == 0 and empty.columns == ["rank", "score", "review_id", "summary", "review", "rating"]


def test_many_queries_by_text(spark, corpus):
    embedder = embedding.fit_hashed_embedder(corpus, dims=256)
    index = embedding.embed_hashed(corpus, embedder)
    asked = spark.createDataFrame([(1, "broken bottle"), (2, "  "), (3, None), (4, "great tea")], "query_id int, text string")
    got = search.search_reviews_batch(asked, embedder, index, 2).orderBy("query_id", "rank")
    assert [(r.query_id, r.review_id) for r in got.collect()][:3] == [(1, 3), (1, 5), (4, 2)]
    assert {r.query_id for r in got.collect()} == {1, 4}
    one = search.search_reviews("great tea", embedder, index, corpus, 2).collect()
    assert [(r.review_id, r.score) for r in one] == [(r.review_id, r.score) for r in got.collect() if r.query_id == 4]
    popular = search.with_texts(got, corpus).orderBy("query_id", "rank").collect()
    assert [r.review for r in popular[:2]] == ["Broken box, broken bottle, leaking everywhere"] * 2


def test_summary_of_a_single_query(spark, corpus):
    embedder = embedding.fit_hashed_embedder(corpus, dims=256)
    index = embedding.embed_hashed(corpus, embedder)
    row = keywords.summarise_query("broken bottle", embedder, index, corpus, 2).first()
    assert [e.review_id for e in row.supporting_reviews] == [3, 5]
    assert "'broken bottle' suggest recurring issues around: broken, bottle, leaking, everywhere." in row.summary
    blank = keywords.summarise_query(" ", embedder, index, corpus, 2).first()
    assert "no dominant keywords found" in blank.summary and blank.supporting_reviews is None


def test_plans_cut_before_the_shuffle(spark):
    index = frame(spark, unit_rows(9))
    assert "TakeOrderedAndProject" in search.nearest(index, [1.0] * 8, 3)._jdf.queryExecution().executedPlan().toString()
    plan = search.nearest_batch(index, frame(spark, unit_rows(2), "query_id"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1 and "NestedLoop" not in plan


def test_index_holds_corpus_reviews_only(spark, corpus):
    vectors = frame(spark, [[3.0, 4.0]] * 9)
    rows = embedding.build_index(corpus, vectors).collect()
    assert sorted(r.review_id for r in rows) == [1, 2, 3, 4, 5]
    assert [round(x, 6) for x in rows[0].embedding] == [0.6, 0.8]


def test_callers_model(spark, corpus):
    def make():
        def predict(texts):
            return np.array([[float(len(t)), 0.0] for t in texts], dtype=np.float32)

        return predict

    rows = embedding.embed_with_model(corpus, make).collect()
    assert [r.embedding for r in rows] == [[1.0, 0.0]] * 5


def tfidf_brute(corpus, query):
    import collections
    import math
    import re

    docs = {r.review_id: collections.Counter(re.findall(r"\w+", r.text.lower())) for r in corpus.collect()}
    df = collections.Counter(w for d in docs.values() for w in d)
    idf = {w: math.log((len(docs) + 1) / (n + 1)) for w, n in df.items()}

    def unit(counter):
        v = {w: c * idf[w] for w, c in counter.items() if w in idf}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()} if n else {}

    q = unit(collections.Counter(re.findall(r"\w+", query.lower())))
    scores = {i: round(sum(x * q.get(w, 0.0) for w, x in unit(d).items()), 9) for i, d in docs.items()}
    return [(i, s) for i, s in sorted(scores.items(), key=lambda p: (-p[1], p[0])) if s > 0]


@pytest.mark.parametrize("broadcast", [True, False])
def test_text_search(spark, corpus, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(text_search, "MAX_BROADCAST_ROWS", -1)
    queries = ["broken box", "great great tea", "unknown words", "the chips", "at all", None, "  "]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")
    rows = text_search.search_texts(text_search.text_index(corpus), asked, 3).collect()
    for i, query in enumerate(queries):
        got = sorted((r["rank"], r.review_id, r.score) for r in rows if r.query_id == i)
        assert [(d, s) for _, d, s in got] == tfidf_brute(corpus, query or "")[:3]


@pytest.mark.parametrize("slice_postings", [200_000, 40])
def test_text_search_skips_blocks_and_keeps_the_hits(spark, monkeypatch, slice_postings):
    """Common words everywhere, rare ones in few texts, copies that tie: bounds skip most postings."""
    monkeypatch.setattr(text_search, "SLICE_POSTINGS", slice_postings)
    rng = np.random.default_rng(3)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(150)]
    texts = [" ".join([*rng.choice(common, rng.integers(5, 40)), *rng.choice(rare, rng.integers(0, 4))]) for _ in range(400)]
    texts += [texts[5]] * 6 + ["", "r1", "c0"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "review_id bigint, text string")
    queries = ["r1 r2 c0 c1 c2 c3", "r7 c0 c0 c0", "c1 c2", texts[5], "r140"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")
    index = text_search.text_index(corpus)
    rows = text_search.search_texts(index, asked, 4).collect()
    for i, query in enumerate(queries):
        got = sorted((r["rank"], r.review_id, r.score) for r in rows if r.query_id == i)
        assert [(d, s) for _, d, s in got] == tfidf_brute(corpus, query)[:4]
    choice = text_search.block_choice(index, text_search.stored(text_search.query_vectors(asked, index.idf)), 4)
    counted = {r["kept"]: r["postings"] for r in choice.groupBy("kept").agg(F.sum("n").alias("postings")).collect()}
    assert counted[False] > counted[True]
    if slice_postings == 40:  # a hot word's postings lie in several slices
        assert index.postings.filter("word = 'c0'").select("slice").distinct().count() > 2


def test_text_search_of_no_texts_or_queries(spark, corpus):
    none = spark.createDataFrame([], "review_id bigint, text string")
    asked = spark.createDataFrame([(1, "box")], "query_id bigint, text string")
    assert text_search.search_texts(text_search.text_index(none), asked, 3).collect() == []
    index = text_search.text_index(corpus)
    assert text_search.search_texts(index, asked.limit(0), 3).collect() == []
    assert text_search.search_texts(index, asked, 0).collect() == []


def test_text_search_plan_has_no_python(spark, corpus):
    asked = spark.createDataFrame([(1, "box")], "query_id bigint, text string")
    plan = text_search.search_texts(text_search.text_index(corpus), asked, 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_keywords_ties_by_first_occurrence(spark):
    texts = spark.createDataFrame(
        [(1, "tea tea Coffee coffee stale, stale!"), (2, "über1abcd with food crunchy")], "rank int, text string"
    )
    top = keywords.top_keywords(keywords.keyword_counts(texts, "rank"), 8)
    assert [(r.word, r["count"]) for r in top.collect()] == [("coffee", 2), ("stale", 2), ("crunchy", 1)]


def test_summary_and_fallback(spark):
    hits = spark.createDataFrame(
        [(1, 1, 0.9, 7, None, "stale stale chips", 1), (1, 2, 0.8, 9, "s", "chips arrived stale", None)],
        "query_id bigint, rank int, score double, review_id bigint, summary string, review string, rating int",
    )
    asked = spark.createDataFrame([(1, "old chips"), (2, "")], "query_id bigint, query string")
    one, two = keywords.summarise(asked, hits).orderBy("query_id").collect()
    assert one.summary == (
        "Top retrieved reviews for 'old chips' suggest recurring issues around: stale, chips, arrived. "
        "Below are representative supporting reviews."
    )
    assert [e.review_id for e in one.supporting_reviews] == [7, 9] and one.supporting_reviews[0].summary is None
    assert "no dominant keywords found" in two.summary and two.supporting_reviews is None


def test_join_counted_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MAX_HOT_KEYS", 3)
    monkeypatch.setattr(ranking, "MIN_HOT_ROWS", 10)
    left = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 < 2 THEN 0 WHEN id % 7 = 0 THEN NULL ELSE id END AS k")
    right = left.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).filter("k < 2000")
    total = 3000
    joined = ranking.join_counted(left, right, "k", "n", total, spread="id", how="left")
    plain = left.join(right, "k", "left").select("k", "id", "n")
    assert joined.count() == 3000
    assert "_salt" in joined._jdf.queryExecution().analyzed().toString()
    assert joined.select("k", "id", "n").exceptAll(plain).count() == 0
    inner = ranking.join_counted(left, right, "k", "n", total, spread="id")
    assert inner.select("k", "id", "n").exceptAll(left.join(right, "k").select("k", "id", "n")).count() == 0
    assert inner.count() == left.join(right, "k").count()


def test_texts_are_not_regrouped_for_the_index(spark, monkeypatch):
    """Words too rare to be broadcast are joined; the weights are the same, and only they and one row a text and task are shuffled."""
    rows = [(i, " ".join(["tea"] * (i % 3 + 1) + [f"w{i % 7}", f"only{i}"])) for i in range(40)] + [(50, None), (51, "")]
    corpus = spark.createDataFrame(rows, "review_id bigint, text string")

    def postings():
        found = text_search.text_index(corpus).postings.collect()
        return {(r["word"], r["review_id"]): (r["layer"], round(r["weight"], 12)) for r in found}

    whole = postings()
    monkeypatch.setattr(text_search, "MAX_BROADCAST_ROWS", 9)
    monkeypatch.setattr(text_search, "MAX_BROADCAST_LENGTHS", 0)
    assert postings() == whole and ("only3", 3) in whole
    lengths = {}
    for (_, i), (_, w) in whole.items():
        lengths[i] = lengths.get(i, 0.0) + w * w
    assert len(lengths) == 40 and np.allclose(list(lengths.values()), 1.0)
    counts = text_search.term_counts(corpus, "review_id")
    weights = text_search.stored(text_search.word_weights(counts, F.lit(42)))
    parts = text_search._weighed(counts, weights)
    assert parts.count() == counts.count() and "LeftAnti" in parts._jdf.queryExecution().toString()
