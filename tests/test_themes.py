"""Themes: numbering, naming, density against brute force, reports."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import density, embedding, ranking, reports, themes


def test_topic_numbers_by_size_then_first_member(spark):
    rows = [(i, "b") for i in range(0, 3)] + [(i, "a") for i in range(3, 6)] + [(i, "c") for i in range(6, 11)]
    rows += [(11, "small"), (12, None)]
    given = spark.createDataFrame(rows, "review_id bigint, cluster string")
    topics = {r.review_id: r.topic for r in themes.assign_topics(given, min_size=2).collect()}
    assert [topics[i] for i in (6, 0, 3, 11, 12)] == [0, 1, 2, -1, -1]
    assert len(topics) == 13
    sizes = {r.topic: r["count"] for r in themes.topic_sizes(themes.assign_topics(given, min_size=2)).collect()}
    assert sizes == {0: 5, 1: 3, 2: 3, -1: 2}


def test_one_topic_may_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MIN_HOT_ROWS", 10)
    given = spark.range(9000).selectExpr("id AS review_id", "CASE WHEN id % 3 > 0 THEN 7 WHEN id % 9 = 0 THEN NULL ELSE id END AS cluster")
    got = themes.topic_sizes(themes.assign_topics(given, min_size=20))
    assert {r.topic: r["count"] for r in got.collect()} == {0: 6000, -1: 3000}


def test_rows_without_a_vector_are_outliers(spark):
    rows = [(i, [1.0, 0.0]) for i in range(6)] + [(9, None)]
    vectors = spark.createDataFrame(rows, "review_id bigint, embedding array<float>")
    got = density.density_themes(vectors, 0.9, 2, min_topic_size=2).collect()
    assert {r.review_id: r.topic for r in got} == {i: 0 for i in range(6)} | {9: -1}


def test_reach_of_centres(spark):
    centres = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [0.0, 1.0])], "cluster int, centre array<double>")
    rows = [(1, [1.0, 0.1]), (2, [0.0, 5.0]), (3, [-1.0, -1.0]), (4, [0.0, 0.0]), (5, None)]
    vectors = spark.createDataFrame(rows, "review_id bigint, embedding array<float>")
    assert {r.review_id: r.cluster for r in themes.in_reach(vectors, centres).collect()} == {1: 0, 2: 1, 3: None, 4: None, 5: None}


def test_topic_words_and_names(spark):
    rows = [(1, 0, "stale chips stale stale"), (2, 0, "old chips a"), (3, 1, "great tea great"), (4, -1, "stale tea"), (5, 2, "!")]
    topics = spark.createDataFrame(rows, "review_id bigint, topic int, text string")
    tf = collections.defaultdict(collections.Counter)
    for _, topic, text in rows[:4]:
        tf[topic].update(w for w in text.split() if len(w) > 1)
    total = collections.Counter()
    for c in tf.values():
        total.update(c)
    mean = math.floor(sum(total.values()) / len(tf))
    want = {(t, w): round(n / sum(c.values()) * math.log(1 + mean / total[w]), 9) for t, c in tf.items() for w, n in c.items()}
    got = {(r.topic, r.word): r.weight for r in themes.topic_words(topics, 10).collect()}
    assert got == want
    info = {r.topic: (r["count"], r.name) for r in themes.topic_info(topics).collect()}
    for topic, size in ((0, 2), (1, 1), (-1, 1)):
        top = sorted(((-x, w) for (t, w), x in want.items() if t == topic))[:4]
        assert info[topic] == (size, "_".join([str(topic), *[w for _, w in top]]))
    assert info[2] == (1, "2")


def test_reports_leave_out_the_outlier_topic(spark):
    info = spark.createDataFrame(
        [(t, max(40 - 10 * t, 0) if t >= 0 else 99, f"{t}_old_<b>") for t in range(-1, 12)], "topic int, count bigint, name string"
    )
    table = reports.topic_table(info).collect()
    assert [r.topic for r in table] == list(range(10)) and table[0].name == "0_old_&lt;b&gt;"
    chart = reports.topic_chart(info).collect()
    assert [r.topic for r in chart] == list(range(7, -1, -1))
    assert [r.width_pct for r in chart[::-1]][:5] == [100.0, 75.0, 50.0, 25.0, 0.0] and chart[0].theme == "old <b>"
    none = reports.topic_chart(info.filter("topic = -1"))
    assert none.count() == 0


def brute_density(matrix, threshold, m, min_size):
    cos = np.round(matrix.astype(np.float64) @ matrix.astype(np.float64).T, 9)
    near = (cos >= threshold) & ~np.eye(len(cos), dtype=bool)
    core = near.sum(axis=1) >= m
    root = {}
    for i in np.flatnonzero(core):
        if i in root:
            continue
        todo, root[i] = [i], i
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & core):
                if j not in root:
                    root[j] = i
                    todo.append(j)
    for i in np.flatnonzero(~core):
        options = [(-cos[i, j], j) for j in np.flatnonzero(near[i] & core)]
        if options:
            root[i] = root[min(options)[1]]
    members = collections.defaultdict(list)
    for i, r in root.items():
        members[r].append(i)
    kept = sorted((g for g in members.values() if len(g) >= min_size), key=lambda g: (-len(g), min(g)))
    topics = {i: t for t, g in enumerate(kept) for i in g}
    return [topics.get(i, -1) for i in range(len(matrix))]


@pytest.mark.parametrize("tile_rows", [40, 5000])
def test_density_themes_match_brute_force(spark, monkeypatch, tile_rows):
    if tile_rows == 40:  # take the path for hot keys as well
        monkeypatch.setattr(ranking, "MAX_HOT_KEYS", 20)
        monkeypatch.setattr(ranking, "MIN_HOT_ROWS", 1)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 10))
    m = np.concatenate([c + s * rng.normal(size=(n, 10)) for c, s, n in zip(centres, (0.3, 0.5, 0.7, 0.3), (60, 40, 50, 8))])
    m = np.concatenate([m, rng.normal(size=(40, 10)), np.repeat(m[[90]], 60, axis=0), np.repeat(m[[155]], 3, axis=0)])
    m = m[rng.permutation(len(m))]
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "review_id bigint, embedding array<float>")
    got = {r.review_id: r.topic for r in density.density_themes(rows, 0.8, 5, 10, tile_rows).collect()}
    want = brute_density(m, 0.8, 5, 10)
    assert [got[i] for i in range(len(m))] == want
    assert max(want) >= 1 and -1 in want


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_connected_components(spark, shape):
    if shape == "chain":
        links = [(i, i + 1) for i in range(200)] + [(500, 501)]
    elif shape == "star":
        links = [(0, i) for i in range(1, 300)]
    else:
        rng = np.random.default_rng(5)
        links = [(int(a), int(b)) for a, b in rng.integers(0, 400, size=(260, 2))]
    label = {n: n for link in links for n in link}

    def find(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    want = {n: find(n) for n in label}
    pairs = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in density.connected_components(pairs).collect()}
    loops = {a for a, b in links if a == b}
    assert {n: c for n, c in want.items() if n not in loops or n in got} == got


def test_kmeans_themes(spark):
    topics = {"stale old chips bag": 30, "broken box bottle leaking": 25, "late slow shipping order": 22}
    rows = [(f"{t} number{i}",) for t, n in topics.items() for i in range(n)] + [("zzz unrelated words entirely",), ("!!! ... ???",)]
    texts = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "review_id bigint, text string")
    embedder = embedding.fit_hashed_embedder(texts, dims=512)
    got, model = themes.kmeans_themes(texts, embedder, [2, 3, 4], min_topic_size=20)
    named = themes.topic_info(got.join(texts, "review_id"))
    info = {r.topic: (r["count"], r.name) for r in named.collect()}
    assert len(model.clusterCenters()) >= 3
    assert got.count() == len(rows) and {t for t in info if t >= 0} == {0, 1, 2}
    # A row or two whose number shares a slot may stray; where depends on the first centres drawn.
    assert all(abs(c - n) <= 2 for c, n in zip(sorted(c for t, (c, _) in info.items() if t >= 0), (22, 25, 30)))
    assert info[0][1].startswith("0_") and len(info[0][1].split("_")) == 5
    assert 2 <= got.filter(F.col("topic") == -1).count() <= 5
