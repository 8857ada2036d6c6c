"""Exact top-k of many queries over many rows, as matrix products inside tasks.

A task scores a whole batch of rows against a block of queries and keeps `k`
rows per query, so no pair beyond those ever leaves a task. A query set of
bounded size is broadcast and the rows are not shuffled before the cut; a larger
one is matched with the rows block by block. Both ways give the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.constants import SCORE_DIGITS
from reviewloom.operators.ranking import best_first, check_k, rank_within

MAX_BROADCAST_QUERIES = 10_000
MAX_BROADCAST_VALUES = 8_000_000
MAX_KEPT_ROWS = 5_000_000
BLOCK_ROWS = 50_000
ARROW_TYPES = {
    T.LongType(): pa.int64(),
    T.IntegerType(): pa.int32(),
    T.StringType(): pa.string(),
    T.DoubleType(): pa.float64(),
}


def vector_matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as a float64 matrix; rows of another length are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dims or not pc.all(pc.equal(pc.list_value_length(column), dims)).as_py():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), dims)


def _one_chunk(table: pa.Table, column: str) -> pa.Array:
    return pa.concat_arrays(table.column(column).chunks)


class DenseScores:
    """Dot products of `embedding` columns."""

    columns = ["embedding"]
    values = "embedding"
    query_chunk = 512

    def load(self, queries: pa.Table):
        column = _one_chunk(queries, "embedding")
        dims = len(column[0])
        matrix = vector_matrix(column, dims)
        return [matrix[at : at + self.query_chunk] for at in range(0, len(matrix), self.query_chunk)]

    def score(self, chunk: np.ndarray, rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, chunk @ vector_matrix(rows.column("embedding"), chunk.shape[1]).T


def best_per_query(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Rows of the `k` best scores per query, ties by the smaller id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    at = np.arange(len(query))
    first = np.ones(len(query), dtype=bool)
    first[1:] = query[1:] != query[:-1]
    keep = at - np.maximum.accumulate(np.where(first, at, 0)) < k
    return query[keep], ids[keep], scores[keep]


def _reaching(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a (query, row) matrix that reach the k-th best score of their query."""
    if scores.shape[1] <= k:
        return np.nonzero(np.ones_like(scores, dtype=bool))
    at = scores.shape[1] - k
    return np.nonzero(scores >= np.partition(scores, at, axis=1)[:, [at]])


def _key_values(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _with_values(rows, scores):
    """Rows that have a vector; dropped here, so that vectors are computed once."""
    known = pc.is_valid(rows.column(scores.values))
    return rows if pc.all(known).as_py() else rows.filter(known)


class _Keeper:
    """Best rows seen so far, for every query of a loaded query set."""

    def __init__(self, queries: pa.Table, scores, k: int, positive: bool):
        queries = _with_values(queries, scores)
        self.query_ids = _key_values(_one_chunk(queries, "query_id")) if queries.num_rows else np.array([])
        self.chunks = scores.load(queries) if queries.num_rows else []
        self.scores, self.k, self.positive = scores, k, positive
        self.best: list = [None] * len(self.chunks)

    def add(self, rows: pa.RecordBatch) -> None:
        rows = _with_values(rows, self.scores)
        if not rows.num_rows:
            return
        ids = _key_values(rows.column("review_id"))
        for i, chunk in enumerate(self.chunks):
            for start, matrix in self.scores.score(chunk, rows):
                rounded = np.round(matrix, SCORE_DIGITS)
                query, at = _reaching(rounded, self.k)
                found = [query, ids[start + at], rounded[query, at]]
                if self.positive:
                    found = [f[rounded[query, at] > 0] for f in found]
                if self.best[i] is not None:
                    found = [np.concatenate(pair) for pair in zip(self.best[i], found)]
                self.best[i] = best_per_query(*found, self.k)

    def result(self, schema: pa.Schema) -> pa.RecordBatch:
        seen = [(i * self.scores.query_chunk + q, r, s) for i, b in enumerate(self.best) if b for q, r, s in [b]]
        if not seen:
            return pa.RecordBatch.from_pylist([], schema=schema)
        query, ids, scores = (np.concatenate(c) for c in zip(*seen))
        values = [self.query_ids[query], ids, scores]
        return pa.RecordBatch.from_arrays(
            [pa.array(v.tolist(), type=f.type) for v, f in zip(values, schema)], schema=schema
        )


def _schemas(index: DataFrame, queries: DataFrame) -> tuple[T.StructType, pa.Schema]:
    fields = [
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("review_id", index.schema["review_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ]
    for field in fields:
        if field.dataType not in ARROW_TYPES:
            raise TypeError(f"keys of type {field.dataType.simpleString()} are not supported")
    return T.StructType(fields), pa.schema([(f.name, ARROW_TYPES[f.dataType]) for f in fields])


def _with_broadcast(index: DataFrame, queries: DataFrame, scores, k: int, positive: bool) -> DataFrame:
    schema, arrow = _schemas(index, queries)
    shared = index.sparkSession.sparkContext.broadcast(queries.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper = None
        for batch in batches:
            if batch.num_rows:
                keeper = keeper or _Keeper(shared.value, scores, k, positive)
                keeper.add(batch)
        if keeper is not None:
            yield keeper.result(arrow)

    return index.mapInArrow(run, schema)


def _with_blocks(
    index: DataFrame, queries: DataFrame, scores, k: int, positive: bool, index_blocks: int, query_blocks: int
) -> DataFrame:
    """Deal both sides into blocks by a hash of their unique keys and pair the blocks.

    The size of a block is set by the number of blocks, not by the data's shape.
    """
    schema, arrow = _schemas(index, queries)

    def deal(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        dealt = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = deal(index, "review_id", "_i", index_blocks, "_q", query_blocks).groupBy("_i", "_q")
    right = deal(queries, "query_id", "_q", query_blocks, "_i", index_blocks).groupBy("_i", "_q")

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return arrow.empty_table()
        keeper = _Keeper(asked, scores, k, positive)
        for batch in rows.to_batches():
            keeper.add(batch)
        return pa.Table.from_batches([keeper.result(arrow)])

    return left.cogroup(right).applyInArrow(run, schema)


def batch_top_k(index: DataFrame, queries: DataFrame, scores, k: int, positive: bool = False) -> DataFrame:
    """(query_id, review_id, score, rank) of the `k` best rows per query.

    `scores` says how rows and queries are multiplied; `positive` leaves out
    rows that share nothing with the query. Keys must be unique.
    """
    k = check_k(k)
    index = index.select("review_id", *scores.columns)
    queries = queries.select("query_id", *scores.columns)
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(scores.values)).alias("values")).first()
    # A task holds the queries of a block and `k` rows for each of them.
    at_most = max(1, min(MAX_BROADCAST_QUERIES, MAX_KEPT_ROWS // max(k, 1)))
    values = (size["values"] or 0) / MAX_BROADCAST_VALUES
    query_blocks = max(1, math.ceil(size["n"] / at_most), math.ceil(values))
    if not size["n"] or not k:
        best = index.sparkSession.createDataFrame([], _schemas(index, queries)[0])
    elif query_blocks == 1:
        best = _with_broadcast(index, queries, scores, k, positive)
    else:
        index_blocks = math.ceil(index.count() / BLOCK_ROWS) or 1
        best = _with_blocks(index, queries, scores, k, positive, index_blocks, query_blocks)
    return rank_within(best, ["query_id"], best_first(), k)
