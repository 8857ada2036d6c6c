"""Themes by a density hierarchy against a plain version."""

import random

import numpy as np
import pytest

from reviewloom.operators import hierarchy
from reviewloom.plans import catalog


def plain(rows, k, min_size):
    """Topics of (id, vector) rows, every row on its own, components by flooding."""
    ids = [i for i, v in rows if v is not None]
    m = np.array([v for _, v in rows if v is not None], dtype=np.float64)
    far = np.round(1 - np.round(m @ m.T, 9), 9)
    same = {tuple(v): [] for v in m}
    for n, v in enumerate(m):
        same[tuple(v)].append(n)
    for group in same.values():
        far[np.ix_(group, group)] = 0.0
    np.fill_diagonal(far, np.inf)
    core = np.sort(far, axis=1)[:, min(k, len(ids) - 1) - 1]
    np.fill_diagonal(far, 0.0)
    reach = np.maximum(np.maximum(far, core[:, None]), core[None, :])

    def parts(h):
        left, out = {n for n in range(len(ids)) if core[n] <= h}, []
        while left:
            todo = [left.pop()]
            part = set(todo)
            while todo:
                n = todo.pop()
                new = {x for x in left if reach[n, x] <= h}
                left -= new
                part |= new
                todo += new
            out.append(frozenset(part))
        return [p for p in out if len(p) >= min_size]

    edges = hierarchy.spanning_tree(reach)
    heights = sorted({reach[a, b] for a, b in edges} - {0.0} | {reach[a, b] for a, b in edges})
    levels = [parts(h) for h in heights]
    density = [1 / max(h, 1e-9) for h in heights] + [0.0]
    theme = {}  # (level, part) -> [stability, top, parent]
    for t in range(len(heights) - 1, -1, -1):
        for p in levels[t]:
            own = {"stability": 0.0, "top": p, "parent": None, "children": []}
            if t + 1 < len(heights):
                up = next(q for q in levels[t + 1] if p <= q)
                if sum(x <= up for x in levels[t]) == 1:
                    own = theme[t + 1, up]
                else:
                    own["parent"] = theme[t + 1, up]
                    theme[t + 1, up]["children"].append(own)
            own["stability"] += len(p) * (density[t] - density[t + 1])
            theme[t, p] = own
    kept = []

    def best(x):
        x["inner"] = round(sum(best(c) for c in x["children"]), 9)
        return max(round(x["stability"], 9), x["inner"])

    def choose(x):
        if x["parent"] is not None and round(x["stability"], 9) >= x["inner"]:
            kept.append(x["top"])
        else:
            for c in x["children"]:
                choose(c)

    for x in {id(v): v for v in theme.values() if v["parent"] is None}.values():
        best(x)
        choose(x)
    named = sorted(kept, key=lambda p: (-len(p), min(ids[n] for n in p)))
    topic = {ids[n]: t for t, p in enumerate(named) for n in p}
    return {i: topic.get(i, -1) for i, _ in rows}


def crowded(seed, dims=6):
    """Clusters of several densities, copies, ties on a ring, strays and a row without a vector."""
    rng = np.random.default_rng(seed)
    rows = []
    for spread, n in ((0.02, 30), (0.05, 25), (0.2, 40), (0.02, 12)):
        centre = rng.normal(size=dims)
        rows += [centre / np.linalg.norm(centre) + rng.normal(size=dims) * spread for _ in range(n)]
    rows += [rows[3]] * 15 + [rows[80]] * 4
    rows += [np.eye(dims)[i] * s for i in range(dims) for s in (1, -1)]
    rows += list(rng.normal(size=(20, dims)))
    out = [(i, [float(np.float32(x)) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rows)]
    random.Random(seed).shuffle(out)
    return out + [(9000, None)]


@pytest.mark.parametrize(("seed", "tile_rows", "size"), [(1, 1000, 10), (3, 25, 5)])
def test_themes_equal_plain_version(spark, seed, tile_rows, size):
    rows = crowded(seed)
    df = spark.createDataFrame(rows, "review_id bigint, embedding array<float>")
    found = hierarchy.hierarchy_themes(df, size, 4, levels=1000, tile_rows=tile_rows)
    want = plain(rows, 4, size)
    assert max(want.values()) >= 1
    assert {r["review_id"]: r["topic"] for r in found.collect()} == want


def test_few_heights_keep_the_clear_themes(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in np.eye(5)[:3]:
        rows += [c + rng.normal(size=5) * 0.03 for _ in range(30)]
    vectors = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rows)]
    df = spark.createDataFrame(vectors, "review_id bigint, embedding array<float>")
    found = {r["review_id"]: r["topic"] for r in hierarchy.hierarchy_themes(df, 10, 5, levels=24).collect()}
    usual = [max(range(-1, 3), key=[found[i] for i in range(30 * t, 30 * t + 30)].count) for t in range(3)]
    assert sorted(usual) == [0, 1, 2]
    assert all(sum(found[i] == usual[t] for i in range(30 * t, 30 * t + 30)) >= 25 for t in range(3))


def test_spanning_tree_of_tied_lengths():
    lengths = np.ones((5, 5))
    assert hierarchy.spanning_tree(lengths) == [(0, 1), (0, 2), (0, 3), (0, 4)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 0.0])], [(1, [1.0, 0.0])] * 3])
def test_too_few_rows_are_outliers(spark, rows):
    df = spark.createDataFrame(rows, "review_id bigint, embedding array<float>")
    assert [r["topic"] for r in hierarchy.hierarchy_themes(df, 2).collect()] == [-1] * len(rows)


def test_registered_components_are_nested(spark, sf):
    rows = catalog.themes_hierarchy(spark, sf).collect()
    by_level = {}
    for r in rows:
        by_level.setdefault(r["level"], {})[r["review_id"]] = r["component"]
    for lower, upper in zip(sorted(by_level), sorted(by_level)[1:]):
        assert all(by_level[upper][i] == by_level[upper][c] for i, c in by_level[lower].items())


def test_tree_is_exact_where_the_lists_leave_components_apart(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "NEAREST", 1)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 5))
    rows = np.concatenate([c / np.linalg.norm(c) + rng.normal(size=(25, 5)) * 0.03 for c in centres])
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "review_id bigint, embedding array<float>")
    searches, search = [], hierarchy._searched
    monkeypatch.setattr(hierarchy, "_searched", lambda *given: searches.append(1) or search(*given))
    points, tree = hierarchy.mutual_tree(df, 2, tile_rows=20)
    m = rows.astype(np.float64)
    far = np.round(1 - np.round(m @ m.T, 9), 9)
    np.fill_diagonal(far, np.inf)
    core = np.sort(far, axis=1)[:, 1]
    reach = np.maximum(np.maximum(far, core[:, None]), core[None, :])
    assert {r["point"]: r["core"] for r in points.collect()} == dict(enumerate(core.tolist()))
    assert searches
    assert sorted(r["length"] for r in tree.collect()) == sorted(reach[a, b] for a, b in hierarchy.spanning_tree(reach))


def test_tiles_offer_few_rows_per_point(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(1200, 5))
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)], 1) for i, v in enumerate(m)]
    points = spark.createDataFrame(rows, "point bigint, embedding array<double>, weight bigint")
    n_tiles = hierarchy.tile_count(1200, 20)
    assert n_tiles == 16
    near = hierarchy.nearest_points(points, 5, 10, n_tiles, 1200)
    assert {len(r["others"]) for r in near.collect()} == {10}
    assert hierarchy.near_links(near).count() <= 1200 * 10


@pytest.mark.parametrize(("seed", "size", "band_links"), [(10, 5, 131_072), (2, 3, 40)])
def test_every_height_counts(spark, monkeypatch, seed, size, band_links):
    """More lengths of links than any number of quantiles would keep, in one band and in several."""
    monkeypatch.setattr(hierarchy, "BAND_LINKS", band_links)
    rows = crowded(seed)
    df = spark.createDataFrame(rows, "review_id bigint, embedding array<float>")
    found = hierarchy.hierarchy_themes(df, size, 4)
    assert {r["review_id"]: r["topic"] for r in found.collect()} == plain(rows, 4, size)


def test_deeply_nested_themes():
    """A pair of rows is met by another pair at each height: as many themes inside each other as heights."""
    n = 3000
    rows = [(0, 0, t, 0, 0, t + 1, None, False, 1.0) for t in range(1, n)] + [(0, 0, n, None, None, None, None, False, 9.0)]
    themes = hierarchy.pa.table([list(x) for x in zip(*rows)], schema=hierarchy.THEME_SCHEMA)
    # Each is as stable as the one inside it, so the outermost below the top is kept, with all inside it.
    chosen = hierarchy._chosen(themes.drop_columns("node"))
    assert chosen.num_rows == n - 1 and len(set(chosen.column("cluster").to_pylist())) == 1
