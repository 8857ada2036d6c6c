"""Pairs of blocks against all pairs of points."""

import numpy as np
import pytest

from reviewloom.operators import density
from reviewloom.operators.metric_join import MAX_TILE_ROWS, TILES, Blocks, lowest_reaching, tile_count, widest_angle


def frame(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(matrix)], "point bigint, embedding array<float>, weight bigint")


def clustered(seed, n=300, dims=6, groups=8, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    rows = centres[rng.integers(0, groups, n)] / 2 + rng.normal(size=(n, dims)) * spread
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize(("threshold", "length"), [(0.97, 1.0), (0.5, 1.0), (0.9, 1.3), (0.0, 1.0)])
def test_no_near_pair_is_lost(spark, threshold, length):
    m = clustered(1) * np.float32(length)
    m[17] = 0
    points = frame(spark, m)
    blocks = Blocks(points, threshold, 20)
    block = {r["point"]: r["block"] for r in blocks.placed.collect()}
    pairs = {(r["a"], r["b"]) for r in blocks.pairs.collect()}
    near = np.argwhere(np.round(m.astype(np.float64) @ m.astype(np.float64).T, 9) >= threshold)
    assert len(block) == len(m)
    assert all((min(block[a], block[b]), max(block[a], block[b])) in pairs for a, b in near)


def test_clustered_points_skip_most_pairs_of_blocks(spark):
    blocks = Blocks(frame(spark, clustered(2, n=600)), 0.98, 20)
    possible = blocks.n_blocks * (blocks.n_blocks + 1) // 2
    assert blocks.n_blocks > 20
    assert blocks.pairs.count() < possible / 3
    sizes = [r["count"] for r in blocks.placed.groupBy("block").count().collect()]
    assert max(sizes) <= 60


def test_a_row_is_copied_for_its_own_pairs_only(spark):
    points = frame(spark, clustered(2, n=600))
    blocks = Blocks(points, 0.98, 20)
    counted = density.neighbour_counts(points, 0.98, blocks)
    m = clustered(2, n=600).astype(np.float64)
    near = (np.round(m @ m.T, 9) >= 0.98).sum(axis=1) - 1
    assert {r["point"]: r["neighbours"] for r in counted.collect()} == dict(enumerate(near.tolist()))
    copies = blocks.paired(points).count().agg({"count": "sum"}).first()[0]
    assert copies < 600 * blocks.n_blocks / 2


def test_widest_angle():
    assert widest_angle(-0.2, 1.0) == np.pi
    assert abs(widest_angle(0.5, 1.0) - np.pi / 3) < 1e-5
    assert widest_angle(0.5, 2.0) > widest_angle(0.5, 1.0)


def test_points_without_structure_travel_once_per_tile(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(900, 6))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    points = frame(spark, m)
    blocks = Blocks(points, 0.1, 20)
    assert blocks.n_blocks > 2 * TILES
    copies = blocks.paired(points).count().agg({"count": "sum"}).first()[0]
    assert copies <= 900 * TILES
    counted = density.neighbour_counts(points, 0.1, blocks)
    near = (np.round(m.astype(np.float64) @ m.astype(np.float64).T, 9) >= 0.1).sum(axis=1) - 1
    assert {r["point"]: r["neighbours"] for r in counted.collect()} == dict(enumerate(near.tolist()))
    cores = counted.selectExpr("point", "neighbours >= 200 AS is_core")
    links = density.core_links(points.select("point", "embedding").join(cores, "point"), 0.1, blocks)
    assert links.count() <= 900 * TILES


def test_lowest_number_that_reaches_a_threshold():
    for threshold in (0.3, 0.98, 0.0, -0.25):
        least = lowest_reaching(threshold)
        assert np.round(least, 9) >= threshold > np.round(np.nextafter(least, -1.0), 9)


def test_points_per_tile_stay_bounded():
    assert [tile_count(n) for n in (0, 500, 10_000, 600_000, TILES * MAX_TILE_ROWS + 1)] == [1, 1, TILES, TILES, TILES + 1]
