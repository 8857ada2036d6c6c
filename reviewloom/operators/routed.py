"""Batch search through cells: each query goes where its best rows can be, twice.

Rows lie in the cells of `search.with_cells`. No row of a cell is closer to a query than the
angle to the cell's centre less the cell's radius. A query is first routed to its most
promising cells that hold `k` rows; its k-th score there is a bound, and only the
cells that can beat it are searched after that. The result is that of comparing all rows.

A cell with many rows is cut into slices, many queries for one cell into groups, so that a
task holds a bounded part of both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.operators.batch import DenseScores, _Keeper, _schemas, vector_matrix
from reviewloom.operators.ranking import best_first, check_k, rank_within
from reviewloom.session import stored

CELL_ROWS = 50_000
CELL_QUERIES = 5_000
#: Stored vectors are single precision, so their length differs slightly from one.
SLACK = 1e-5


def route(queries: DataFrame, centres: list[list[float]], bounds: list[tuple[int, int, float]], k: int, floors: bool = False) -> DataFrame:
    """(query_id, embedding, cell) of the cells that each query must see.

    Without `floors` these are the most promising cells that hold `k` rows. With them,
    `queries` has a column `floor`, and the cells are those that can reach it but for
    the ones seen before. `bounds` has (cell, rows, furthest) of each cell: as small as the centres.
    """
    cells = np.array([b[0] for b in bounds], dtype=np.int32)
    rows = np.array([b[1] for b in bounds], dtype=np.int64)
    radius = np.arccos(np.clip([b[2] for b in bounds], -1.0, 1.0))
    shared = queries.sparkSession.sparkContext.broadcast((np.array(centres)[cells], cells, rows, radius))
    schema = T.StructType([queries.schema["query_id"], queries.schema["embedding"], T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, names, held, width = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = vector_matrix(batch.column("embedding"), middle.shape[1])
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            angle = np.arccos(np.clip((vectors / np.where(length == 0, 1.0, length)) @ middle.T, -1.0, 1.0))
            reach = np.cos(np.maximum(angle - width, 0.0)) * length
            order = np.argsort(-reach, axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            first = np.zeros(reach.shape, dtype=bool)
            np.put_along_axis(first, order, before < k, axis=1)
            if floors:
                wanted = ~first & (reach >= batch.column("floor").to_numpy()[:, None] - SLACK)
            else:
                wanted = first
            query, cell = np.nonzero(wanted)
            take = pa.array(query)
            columns = [batch.column("query_id").take(take), batch.column("embedding").take(take), pa.array(names[cell])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "embedding", "cell"])

    columns = ["query_id", "embedding", "floor"] if floors else ["query_id", "embedding"]
    return queries.select(*columns).mapInArrow(run, schema)


def compare(cells: DataFrame, routed: DataFrame, bounds: list[tuple[int, int, float]], k: int) -> DataFrame:
    """(query_id, review_id, score): up to `k` best rows of each part of each routed cell."""
    schema, arrow = _schemas(cells, routed)
    asked = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("_groups"))
    rows = [(int(c), max(1, math.ceil(n / CELL_ROWS))) for c, n, _ in bounds]
    sizes = cells.sparkSession.createDataFrame(rows, "cell int, _slices int").join(asked, "cell")
    sizes = stored(sizes)  # a row per cell at most
    placed = cells.select("review_id", "embedding", "cell").join(F.broadcast(sizes), "cell")
    left = placed.withColumn("_i", F.pmod(F.xxhash64("review_id"), F.col("_slices")).cast("int")).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))
    )
    dealt = routed.join(F.broadcast(sizes), "cell")
    right = dealt.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_groups")).cast("int")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    )

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return arrow.empty_table()
        keeper = _Keeper(queries, DenseScores(), k, False)
        for batch in rows.to_batches():
            keeper.add(batch)
        return pa.Table.from_batches([keeper.result(arrow)])

    grouped = left.select("review_id", "embedding", "cell", "_i", "_q").groupBy("cell", "_i", "_q")
    return grouped.cogroup(right.select("query_id", "embedding", "cell", "_i", "_q").groupBy("cell", "_i", "_q")).applyInArrow(run, schema)


def nearest_batch_in_cells(
    cells: DataFrame, centres: list[list[float]], bounds: list[tuple[int, int, float]], queries: DataFrame, k: int = 5
) -> DataFrame:
    """(query_id, review_id, score, rank): the same as `search.nearest_batch`, reading only cells that matter.

    Queries without a vector find nothing; ties go to the smaller id.
    """
    k = check_k(k)
    asked = stored(queries.filter("embedding IS NOT NULL").select("query_id", "embedding"))
    if not k or not bounds or asked.isEmpty():
        empty = cells.sparkSession.createDataFrame([], _schemas(cells, queries)[0])
        return rank_within(empty, ["query_id"], best_first(), k)
    first = stored(compare(cells, route(asked, centres, bounds, k), bounds, k))
    best = rank_within(first, ["query_id"], best_first(), k)
    floors = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_worst"))
    floor = F.when(F.col("_n") >= k, F.col("_worst")).otherwise(F.lit(float("-inf")))
    bounded = stored(asked.join(floors, "query_id", "left").select("query_id", "embedding", F.coalesce(floor, F.lit(float("-inf"))).alias("floor")))
    rest = compare(cells, stored(route(bounded, centres, bounds, k, floors=True)), bounds, k)
    return rank_within(best.drop("rank").unionByName(rest), ["query_id"], best_first(), k)
