"""Pair weights and their factorisation against NumPy."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reviewloom.operators import word_vectors as wv


def texts(seed=1, n=120):
    """Two topics with their own words, and words common to both."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        own = [f"{'tea' if i % 2 else 'box'}{j}" for j in range(6)]
        out.append((i, " ".join(rng.choice(own + ["the", "of"]) for _ in range(rng.randint(0, 14)))))
    return [*out, (n, None), (n + 1, ""), (n + 2, "lonely"), (n + 3, "the the the")]


def plain_pmi(rows, window, min_count):
    lists = [(t or "").split() for _, t in rows]
    n = Counter(w for ws in lists for w in ws)
    pairs = Counter()
    for ws in lists:
        for i, a in enumerate(ws):
            for b in ws[i + 1 : i + 1 + window]:
                if n[a] >= min_count and n[b] >= min_count:
                    pairs[a, b] += 1
                    if a != b:
                        pairs[b, a] += 1
    sums = Counter()
    for (a, _), c in pairs.items():
        sums[a] += c
    total = sum(sums.values())
    weights = {p: round(math.log(c * total / (sums[p[0]] * sums[p[1]])), 9) for p, c in pairs.items()}
    return {p: w for p, w in weights.items() if w > 0}


@pytest.fixture(scope="module")
def learned(spark):
    df = spark.createDataFrame(texts(), "review_id bigint, text string")
    weights = wv.positive_pmi(wv.pair_counts(df, wv.vocabulary(df, 3), 3))
    return df, weights, plain_pmi(texts(), 3, 3)


def test_pair_weights_equal_plain_version(learned):
    _, weights, want = learned
    assert {(r["word"], r["context"]): r["pmi"] for r in weights.collect()} == want


def test_factors_equal_numpy(learned):
    _, weights, want = learned
    names = sorted({a for a, _ in want})
    m = np.array([[want.get((a, b), 0.0) for b in names] for a in names])
    vectors, values = wv.factorise(weights, dims=2, rounds=16)
    found = {r["word"]: r["vector"] for r in vectors.collect()}
    v = np.array([found[w] for w in names])
    exact, axes = np.linalg.eigh(m)
    order = np.argsort(-np.abs(exact))[:2]
    assert np.allclose(np.abs(values), np.abs(exact[order]), atol=1e-6)
    # Columns are orthogonal, their squared lengths the sizes of the eigenvalues, and they rebuild the best table of that rank.
    assert np.allclose(v.T @ v, np.diag(np.abs(values)), atol=1e-6)
    best = axes[:, order] @ np.diag(exact[order]) @ axes[:, order].T
    assert np.allclose(v @ np.diag(np.sign(values)) @ v.T, best, atol=1e-4)


def test_words_of_a_topic_are_alike(spark, learned):
    df, weights, _ = learned
    vectors, _ = wv.factorise(weights, dims=3)
    asked = spark.createDataFrame([("tea0",), ("box0",), ("unknown",)], "word string")
    rows = wv.words_alike(vectors, asked, 4).collect()
    assert {r["word"] for r in rows} == {"tea0", "box0"}
    assert all(r["alike"][:3] == r["word"][:3] and r["alike"] != r["word"] for r in rows)
    assert sorted(r["rank"] for r in rows) == [1, 1, 2, 2, 3, 3, 4, 4]
    embedded = {r["review_id"]: np.array(r["embedding"]) for r in wv.embed_learned(df, vectors).collect()}
    assert 120 not in embedded and 122 not in embedded
    tea = [i for i in embedded if i < 120 and i % 2 and "tea" in texts()[i][1]]
    box = [i for i in embedded if i < 120 and not i % 2 and "box" in texts()[i][1]]
    same = np.mean([embedded[a] @ embedded[b] for a in tea[:10] for b in tea[10:20]])
    assert same > np.mean([embedded[a] @ embedded[b] for a in tea[:10] for b in box[:10]]) + 0.3


def test_no_texts(spark):
    none = spark.createDataFrame([], "review_id bigint, text string")
    assert wv.learn_words(none).collect() == []


@pytest.mark.parametrize("broadcast", [True, False])
def test_small_tiles_and_joins_give_the_same(spark, learned, monkeypatch, broadcast):
    """Many blocks and tiles; a vocabulary that may not be broadcast is joined."""
    df, weights, want = learned
    whole = {r["word"]: r["vector"] for r in wv.factorise(weights, dims=2, rounds=3)[0].collect()}
    monkeypatch.setattr(wv, "BLOCK_WORDS", 4)
    monkeypatch.setattr(wv, "ENTRIES_AT_ONCE", 3)
    monkeypatch.setattr(wv, "MAX_BROADCAST_WORDS", 1000 if broadcast else 0)
    monkeypatch.setattr(wv, "MAX_BROADCAST_VALUES", 1000 if broadcast else 0)
    again = wv.positive_pmi(wv.pair_counts(df, wv.vocabulary(df, 3), 3))
    assert {(r["word"], r["context"]): r["pmi"] for r in again.collect()} == want
    found = {r["word"]: r["vector"] for r in wv.factorise(weights, dims=2, rounds=3)[0].collect()}
    words = sorted(whole)
    a, b = np.array([whole[w] for w in words]), np.array([found[w] for w in words])
    assert sorted(found) == words and np.allclose(a @ a.T, b @ b.T, atol=1e-9)


def test_pairs_are_shuffled_as_numbers_of_known_words(spark):
    """A pair with a rare word is never made, and no word is shuffled with the pairs."""
    df = spark.createDataFrame([(0, "tea box"), (1, "tea rare box tea"), (2, None)], "review_id bigint, text string")
    pairs = wv._numbered_pairs(df, pa.array(["box", "tea"]), 2)
    assert {tuple(r) for r in pairs.collect()} == {(0, 1, 3)}
    assert pairs.schema.simpleString() == "struct<a:int,b:int,n:bigint>"


def test_weights_travel_in_small_rows(spark, learned, monkeypatch):
    """No row that is sent to Python or written holds more weights than a piece, however many a block has."""
    _, weights, _ = learned
    seen, stored = [], wv.stored
    monkeypatch.setattr(wv, "PIECE_ENTRIES", 5)
    monkeypatch.setattr(wv, "stored", lambda df: seen.append(stored(df)) or seen[-1])
    wv.factorise(weights, dims=2, rounds=1)
    packed = [df for df in seen if "pmi" in df.columns]
    assert packed and all(dict(df.dtypes)["pmi"] == "binary" for df in packed)
    assert max(r["n"] for df in packed for r in df.selectExpr("length(pmi) div 8 AS n").collect()) <= 5
    assert sum(r["n"] for df in packed for r in df.selectExpr("length(pmi) div 8 AS n").collect()) == weights.count()


def test_pairs_are_counted_in_bounded_batches(spark, monkeypatch):
    rows = [(i, " ".join(["tea box cup"] * (i % 5))) for i in range(40)] + [(40, None)]
    df = spark.createDataFrame(rows, "review_id bigint, text string").coalesce(1)
    known = pa.array(["box", "cup", "tea"])
    whole = {tuple(r) for r in wv._numbered_pairs(df, known, 3).collect()}
    lists = pa.array([["a"] * n for n in (3, 0, 9, 1, 1)] + [None])
    assert [len(x.flatten()) for x in wv._cut(lists, 4)] == [3, 9, 2]
    monkeypatch.setattr(wv, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(wv, "PAIRS_HELD", 4)
    assert {tuple(r) for r in wv._numbered_pairs(df, known, 3).collect()} == whole
