"""Complaint themes by density: rows with enough near neighbours, linked up.

Vectors are compared block by block as matrix products, and only blocks that can hold a
near pair are compared (`metric_join`). Blocks travel in a few tiles, and a pair of tiles gives counts
and a spanning set of links, never the pairs themselves, and copies of a vector are folded into one point
first, so a crowd of equal or near rows stays small. The result is exact. Vectors
without structure leave no blocks to skip, and the work is then quadratic in the
distinct vectors; `kmeans_themes` is the linear way.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.constants import MIN_TOPIC_SIZE, SCORE_DIGITS
from reviewloom.operators.batch import vector_matrix
from reviewloom.operators.metric_join import MAX_PIVOTS, Blocks, compared, lowest_reaching
from reviewloom.operators.ranking import join_counted
from reviewloom.operators.themes import assign_topics
from reviewloom.session import stored

TILE_ROWS = 2_048
LEAST_BLOCK_ROWS = 64
MAX_ROUNDS = 60


def fold_copies(vectors: DataFrame) -> DataFrame:
    """(point, embedding, weight): distinct vectors with their number of rows."""
    return vectors.groupBy("embedding").agg(
        F.min("review_id").cast("bigint").alias("point"), F.count(F.lit(1)).alias("weight")
    )


def _tile_pairs(points: DataFrame, n_tiles: int):
    """Every row once for each tile pair its tile takes part in."""
    tiled = points.withColumn("_t", F.pmod(F.xxhash64("point"), F.lit(n_tiles)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))
    paired = tiled.withColumn("_o", other)
    return paired.select(
        *points.columns,
        F.least("_t", "_o").alias("_a"),
        F.greatest("_t", "_o").alias("_b"),
        (F.col("_t") <= F.col("_o")).alias("_left"),
    ).groupBy("_a", "_b")


def _sides(rows: pa.Table):
    """The two tiles of a pair, as (is the same tile, left rows, right rows)."""
    same = rows.column("_a")[0] == rows.column("_b")[0]
    rows = rows.sort_by("point")
    left = rows.filter(rows.column("_left"))
    return same, left, left if same else rows.filter(pc.invert(rows.column("_left")))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _vectors(rows: pa.Table) -> np.ndarray:
    if not rows.num_rows:
        return np.zeros((0, 0))
    column = pa.concat_arrays(rows.column("embedding").chunks)
    return vector_matrix(column, len(column[0]))


def _cosines(left: pa.Table, right: pa.Table) -> np.ndarray:
    a, b = _vectors(left), _vectors(right)
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    return np.round(a @ b.T, SCORE_DIGITS)


def neighbour_counts(points: DataFrame, threshold: float, blocks: Blocks) -> DataFrame:
    """(point, neighbours): rows within the threshold, the row itself not counted."""
    schema = "point bigint, neighbours bigint"
    arrow = pa.schema([("point", pa.int64()), ("neighbours", pa.int64())])
    least = lowest_reaching(threshold)

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        vectors, weight = _vectors(rows), _column(rows, "weight").astype(np.float64)
        found = np.zeros(len(vectors))  # whole numbers
        for left, right, same in compared(rows, pairs):
            near = (vectors[left] @ vectors[right].T >= least).astype(np.float64)
            found[left] += near @ weight[right]
            if not same:
                found[right] += weight[left] @ near
        return pa.table([_column(rows, "point"), found.astype(np.int64)], schema=arrow)

    counted = blocks.applied(points, run, schema)
    return counted.groupBy("point").agg((F.sum("neighbours") - 1).alias("neighbours"))


def linked_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a with b; a label is the smallest position of its component."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def _link_near(label: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after linking left and right positions that are near: a link per row and column at a time."""
    while True:
        apart = near & (label[left][:, None] != label[right][None, :])
        rows, columns = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
        if not len(rows):
            return label
        a = np.concatenate([left[rows], left[apart[:, columns].argmax(axis=0)]])
        b = np.concatenate([right[apart[rows].argmax(axis=1)], right[columns]])
        label = linked_up(label, a, b)


def core_links(points: DataFrame, threshold: float, blocks: Blocks) -> DataFrame:
    """Links between points that have an `is_core` column.

    Rows with a NULL score link two core points; other rows offer a core point
    to a border point, with their cosine. A pair of tiles gives one row per point at most.
    """
    schema = "a bigint, b bigint, score double"
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])
    least = lowest_reaching(threshold)

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        vectors, ids, core = _vectors(rows), _column(rows, "point"), _column(rows, "is_core")
        label = np.arange(len(ids))
        score, nearest = np.full(len(ids), -np.inf), np.zeros(len(ids), dtype=np.int64)

        def offer(border: np.ndarray, cores: np.ndarray) -> None:
            """Nearest core point of each border row; positions go up, so ties give the smaller."""
            if not len(border) or not len(cores):
                return
            cosines = np.round(vectors[border] @ vectors[cores].T, SCORE_DIGITS)
            best = cosines.argmax(axis=1)
            value, core_at = cosines[np.arange(len(best)), best], cores[best]
            nearer = (value > score[border]) | ((value == score[border]) & (core_at < nearest[border]))
            score[border[nearer]], nearest[border[nearer]] = value[nearer], core_at[nearer]

        for left, right, same in compared(rows, pairs):
            left_core, right_core = left[core[left]], right[core[right]]
            both = label[np.concatenate([left_core, right_core])]
            # What is linked already needs no more links.
            if len(left_core) and len(right_core) and (both != both[0]).any():
                near = vectors[left_core] @ vectors[right_core].T >= least
                label = _link_near(label, near, left_core, right_core)
            offer(left[~core[left]], right_core)
            if not same:
                offer(right[~core[right]], left_core)
        linked = np.flatnonzero(label != np.arange(len(ids)))
        offered = np.flatnonzero(score >= threshold)
        a, b = np.concatenate([ids[label[linked]], ids[offered]]), np.concatenate([ids[linked], ids[nearest[offered]]])
        scores = np.concatenate([np.full(len(linked), np.nan), score[offered]])
        return pa.table([a, b, pa.array(scores, from_pandas=True)], schema=arrow)

    return blocks.applied(points, run, schema)


def connected_components(links: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component): the smallest node reachable over (a, b) links.

    Alternates two steps until nothing changes: all larger neighbours of a node
    are linked to its smallest neighbour, then all smaller ones are. This ends
    in one star per component after a number of rounds that grows with the
    logarithm of its size. Each step is written to the shared folder,
    which cuts off the plan of the loop; popular nodes are spread by `join_counted`.
    """
    edges = stored(_ordered(links.select("a", "b")))
    state = _fingerprint(edges)
    for _ in range(max_rounds):
        stars = stored(_large_star(edges, 2 * state[0]))
        edges = stored(_small_star(stars, stars.count()))
        new = _fingerprint(edges)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with the larger node first, without loops."""
    both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return both.filter("a <> b").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    digest = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(digest)).first())


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("degree"))


def _large_star(edges: DataFrame, n_both: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    larger = both.filter("b > a")
    moved = join_counted(larger, _least_neighbour(both), "a", "degree", n_both, spread="b")
    return _ordered(moved.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    least = _least_neighbour(edges)
    joined = join_counted(edges, least, "a", "degree", n_edges, spread="b")
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def density_themes(
    vectors: DataFrame,
    threshold: float,
    min_neighbours: int,
    min_topic_size: int = MIN_TOPIC_SIZE,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(review_id, topic) of (review_id, embedding) rows with unit vectors.

    Rows with `min_neighbours` others within the cosine threshold are core;
    core rows within the threshold of each other share a theme. Another row
    joins the theme of its nearest core row within the threshold, ties to the
    smaller id. The rest, rows without a vector and themes under the minimum size
    are outliers.
    """
    missing = vectors.filter("embedding IS NULL").select("review_id", F.lit(None).cast("bigint").alias("cluster"))
    vectors = vectors.filter("embedding IS NOT NULL")
    points = stored(fold_copies(vectors.select("review_id", "embedding")))
    # Enough blocks to fill the tiles, of a bounded size.
    blocks = Blocks(points, threshold, min(tile_rows, max(LEAST_BLOCK_ROWS, math.ceil(points.count() / MAX_PIVOTS))))
    counts = neighbour_counts(points, threshold, blocks)
    is_core = (F.col("neighbours") >= min_neighbours).alias("is_core")
    marked = stored(points.join(counts, "point").select("point", "embedding", is_core))
    links = stored(core_links(marked, threshold, blocks))
    components = connected_components(links.filter(F.col("score").isNull()))
    cores = marked.filter("is_core").select(F.col("point").alias("node"))
    component = cores.join(components, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
    offers = links.filter(F.col("score").isNotNull()).groupBy("a").agg(
        F.min(F.struct((-F.col("score")).alias("far"), F.col("b").alias("core"))).alias("best"),
    )
    # Border points choose one core point each; a core may be chosen by many.
    chosen = stored(offers.select(F.col("a").alias("point"), F.col("best.core").alias("node")))
    popular = chosen.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    border = join_counted(
        chosen,
        component.join(popular, "node"),
        "node",
        "degree",
        chosen.count(),
        spread="point",
    ).select("point", "component")
    placed = component.select(F.col("node").alias("point"), "component").unionByName(border)
    clustered = stored(points.join(placed, "point", "left"))
    rows = join_counted(
        vectors.select("review_id", "embedding"),
        clustered.select("embedding", "component", "weight"),
        "embedding",
        "weight",
        points.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0],
        spread="review_id",
    ).select("review_id", F.col("component").alias("cluster"))
    return assign_topics(rows.unionByName(missing), "cluster", min_topic_size)
