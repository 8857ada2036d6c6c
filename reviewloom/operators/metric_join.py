"""Which blocks of vectors must be compared to find all pairs within an angle.

A few vectors serve as pivots. A point belongs to the cell of its nearest pivot, and a
cell is cut into rings by the angle to its pivot, so that a block has a bounded number of
points. A block knows the range of its points' angles to every pivot. By the triangle
inequality two points are at least as far apart as their angles to any pivot differ: two
blocks whose ranges lie further apart than the wanted angle, for one pivot at
least, hold no pair. Only the other pairs of blocks are compared.

Blocks travel in tiles, runs of neighbouring blocks: a point is copied once for each tile
in which its block has a partner, and so at most `TILES` times as long as a tile has
no more than `MAX_TILE_ROWS` points. Beyond that the number of tiles grows, not their size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from reviewloom.functions.constants import SCORE_DIGITS
from reviewloom.operators.batch import vector_matrix
from reviewloom.session import stored

MAX_PIVOTS = 64
RINGS = 64
#: Angles are exact to far less than this; scores are rounded to nine digits.
SLACK = 1e-6
MAX_BROADCAST_PAIRS = 500_000
#: Tiles that the points travel in, and the points of a tile at most: memory of a task.
TILES = 16
LEAST_TILE_ROWS = 512
MAX_TILE_ROWS = 131_072
#: Columns that a block is compared with at a time.
STRIP = 2_048


def tile_count(n_points: int, least_rows: int = LEAST_TILE_ROWS) -> int:
    return max(1, min(TILES, math.ceil(n_points / least_rows)), math.ceil(n_points / MAX_TILE_ROWS))


def lowest_reaching(threshold: float) -> float:
    """The smallest number that is rounded to at least the threshold."""
    low, high = threshold - 10.0**-SCORE_DIGITS, threshold + 10.0**-SCORE_DIGITS
    while low < (middle := (low + high) / 2) < high:
        low, high = (low, middle) if np.round(middle, SCORE_DIGITS) >= threshold else (middle, high)
    return high


def widest_angle(threshold: float, longest: float) -> float:
    """The largest angle at which the product of two vectors of at most this length reaches the threshold."""
    if threshold <= 0:
        return math.pi
    return math.acos(min(1.0, max(0.0, threshold - SLACK) / max(longest * longest, SLACK))) + SLACK


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1.0, length)


def _angles(points: DataFrame, n_pivots: int) -> DataFrame:
    """(point, cell, angle, angles, length): angles to all pivots, the nearest pivot and the vector's length."""
    chosen = points.orderBy(F.xxhash64("point"), "point").limit(n_pivots).select("embedding").collect()
    pivots = _unit_rows(np.array([r["embedding"] for r in chosen], dtype=np.float64))
    shared = points.sparkSession.sparkContext.broadcast(pivots)
    schema = pa.schema(
        [("point", pa.int64()), ("cell", pa.int32()), ("angle", pa.float64()), ("angles", pa.list_(pa.float64())), ("length", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = vector_matrix(batch.column("embedding"), shared.value.shape[1])
            angles = np.arccos(np.clip(_unit_rows(vectors) @ shared.value.T, -1.0, 1.0))
            cell = angles.argmin(axis=1)
            offsets = pa.array(np.arange(len(cell) + 1, dtype=np.int32) * angles.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(angles.ravel()))
            columns = [batch.column("point"), pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(np.linalg.norm(vectors, axis=1))], schema=schema)

    return points.select("point", "embedding").mapInArrow(run, "point bigint, cell int, angle double, angles array<double>, length double")


def compared(rows: pa.Table, pairs: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(left, right, same): positions of the rows to compare, each pair of rows once.

    `rows` has a `block` column, `pairs` the (a, b) of the blocks. With `same`, left and right are one block.
    Positions go up, so what is sorted by point stays so.
    """
    block = rows.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    names, starts = np.unique(block[order], return_index=True)
    members = dict(zip(names.tolist(), np.split(order, starts[1:])))
    partners: dict[int, list[int]] = {}
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
        partners.setdefault(a, []).append(b)
    for a, others in partners.items():
        if a in others:
            yield members[a], members[a], True
        met = [members[b] for b in others if b != a]
        right = np.sort(np.concatenate(met)) if met else order[:0]
        for start in range(0, len(right), STRIP):
            yield members[a], right[start : start + STRIP], False


class Blocks:
    """Points dealt to blocks, and the pairs of blocks that can hold a pair within the threshold.

    `placed` is (point, block), `pairs` (a, b) with a <= b, `tiles` (block, tile), all stored; `n_blocks`
    counts the blocks. Tiles go up with the blocks.
    """

    def __init__(self, points: DataFrame, threshold: float, block_rows: int) -> None:
        n_points = points.count()
        n_pivots = max(1, min(MAX_PIVOTS, math.ceil(n_points / block_rows)))
        if not n_points:
            self.placed = points.select("point", F.lit(0).cast("bigint").alias("block"))
            self.pairs = self.placed.select(F.col("block").alias("a"), F.col("block").alias("b"))
            self.tiles = self.placed.select("block", F.lit(0).alias("tile"))
            self.n_blocks = 0
            return
        angled = stored(_angles(points, n_pivots))
        longest = angled.agg(F.max("length")).first()[0]
        reach = widest_angle(threshold, longest)
        cuts = [(i + 1) / RINGS for i in range(RINGS - 1)]
        cells = angled.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("angle", cuts, 10_000).alias("_cuts"))
        ring = F.floor(F.size(F.filter("_cuts", lambda c: c < F.col("angle"))) * F.least(F.ceil(F.col("_n") / block_rows), F.lit(RINGS)) / RINGS)
        slices = F.ceil(F.col("_n") / (block_rows * RINGS))
        block = (F.col("cell") * RINGS + ring) * (1 << 20) + F.pmod(F.xxhash64("point"), slices)
        # One row per pivot: as small as the list of pivots.
        dealt = stored(angled.join(F.broadcast(cells), "cell").select("point", block.cast("bigint").alias("block"), "cell", "angles"))
        each = dealt.select("block", "cell", F.posexplode("angles").alias("pivot", "angle"))
        ranges = stored(each.groupBy("block", "cell", "pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high")))
        listed = ranges.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pivot", "low", "high"))).alias("ranges"))
        own = ranges.filter("pivot = cell").join(listed, "block").select(F.col("block").alias("a"), "pivot", "low", "high", "ranges")
        other = ranges.join(listed.withColumnRenamed("ranges", "_ranges"), "block").select(
            F.col("block").alias("b"), "pivot", F.col("low").alias("_low"), F.col("high").alias("_high"), "_ranges"
        )
        # Blocks meet at the pivot of the first one's cell.
        met = own.join(other, "pivot").filter(
            (F.col("a") <= F.col("b")) & (F.col("_low") <= F.col("high") + reach) & (F.col("low") <= F.col("_high") + reach)
        )
        apart = lambda z: (z["ranges"]["low"] > z["_ranges"]["high"] + reach) | (z["_ranges"]["low"] > z["ranges"]["high"] + reach)
        close = met.filter(~F.exists(F.arrays_zip("ranges", "_ranges"), apart))
        self.placed = dealt.select("point", "block")
        self.pairs = stored(close.select("a", "b"))
        # One row per block; a block is in the tile that its middle point falls into.
        sizes = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
        middle = F.sum("_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") / 2
        tile = F.least(F.floor(middle * tile_count(n_points, min(block_rows, LEAST_TILE_ROWS)) / n_points), F.lit(n_points))
        self.tiles = stored(sizes.select("block", tile.cast("int").alias("tile")))
        self.n_blocks = self.tiles.count()

    def _tiled_pairs(self) -> DataFrame:
        """(a, b, _a, _b): pairs of blocks with their tiles."""
        first = self.tiles.select(F.col("block").alias("a"), F.col("tile").alias("_a"))
        second = self.tiles.select(F.col("block").alias("b"), F.col("tile").alias("_b"))
        return self.pairs.join(first, "a").join(second, "b").select("a", "b", "_a", "_b")

    def paired(self, points: DataFrame) -> GroupedData:
        """Rows of `points` with their block, once for each pair of tiles that theirs takes part in, grouped by the pair."""
        pairs = self._tiled_pairs()
        asked = pairs.select(F.col("a").alias("block"), "_a", "_b").unionByName(pairs.select(F.col("b").alias("block"), "_a", "_b"))
        asked = stored(asked.distinct())
        asked = F.broadcast(asked) if asked.count() <= MAX_BROADCAST_PAIRS else asked
        rows = points.join(self.placed, "point").join(asked, "block")
        return rows.select(*points.columns, "block", "_a", "_b").groupBy("_a", "_b")

    def applied(self, points: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """Results of `run(rows, pairs)` for every pair of tiles, the rows sorted by point."""

        def sort_and_run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
            return run(rows.sort_by("point"), pairs)

        return self.paired(points).cogroup(self._tiled_pairs().groupBy("_a", "_b")).applyInArrow(sort_and_run, schema)
