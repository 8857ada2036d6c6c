"""Batch search over compressed vectors: product-quantised codes, exact re-ranking.

A vector is cut into parts, and each part is replaced by the number of its nearest centre in
the part's code book: one byte a part. A query is multiplied with all centres once; the
approximate score of a row is then a sum of as many look-ups as there are parts. Each
code also keeps how far its vector is from what the centres rebuild, which bounds the
error of its score. With `exact`, all rows whose bound reaches the k-th score found so far are
scored by their full vectors inside the task, and the result is that of comparing all rows; otherwise
a given number of candidates for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.constants import SCORE_DIGITS
from reviewloom.functions.vectors import dot
from reviewloom.operators.batch import best_per_query, vector_matrix
from reviewloom.operators.ranking import best_first, check_k, rank_within
from reviewloom.session import stored

PARTS = 8
CODES = 64
#: Code books are fitted on at most so many vectors, those with the smallest hash of their key.
SAMPLE_ROWS = 100_000
#: Queries that are looked up at once; more are taken block by block.
QUERY_BLOCK = 1_000
CHUNK = 4_096
SLACK = 1e-6


def fit_code_books(index: DataFrame, parts: int = PARTS, codes: int = CODES, seed: int = 42, sample_rows: int = SAMPLE_ROWS) -> list[np.ndarray]:
    """A matrix of centres for each part of the vectors."""
    known = index.filter("embedding IS NOT NULL").select("review_id", "embedding")
    sample = stored(known.orderBy(F.xxhash64("review_id"), "review_id").limit(sample_rows))
    first = sample.first()
    if first is None:
        return []
    cuts = np.linspace(0, len(first["embedding"]), parts + 1).astype(int).tolist()
    if codes > 256 or any(a == b for a, b in zip(cuts, cuts[1:])):
        raise ValueError("at most 256 codes, and no more parts than dimensions")
    books = []
    for begin, end in zip(cuts, cuts[1:]):
        piece = sample.select(array_to_vector(F.slice("embedding", begin + 1, end - begin)).alias("features"))
        books.append(np.array(KMeans(k=codes, seed=seed, maxIter=8).fit(piece).clusterCenters()))
    return books


def compress(index: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(review_id, code, error): one byte a part, and the distance between a vector and its rebuilt form."""
    shared = index.sparkSession.sparkContext.broadcast(books)
    schema = index.select("review_id").schema.add("code", "binary").add("error", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = sum(b.shape[1] for b in shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = vector_matrix(batch.column("embedding"), dims)
            code, left, at = np.zeros((len(vectors), len(shared.value)), np.uint8), np.zeros(len(vectors)), 0
            for i, book in enumerate(shared.value):
                piece = vectors[:, at : at + book.shape[1]]
                far = (piece**2).sum(axis=1)[:, None] - 2 * piece @ book.T + (book**2).sum(axis=1)[None, :]
                code[:, i] = far.argmin(axis=1)
                left += ((piece - book[code[:, i]]) ** 2).sum(axis=1)
                at += book.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("review_id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(np.sqrt(left))],
                names=["review_id", "code", "error"],
            )

    return index.filter("embedding IS NOT NULL").select("review_id", "embedding").mapInArrow(run, schema)


def _lookups(shared):
    """Function that gives the query ids, the query vectors and, for rows of codes, the middle and half width of the bounds of all scores."""
    asked, own = shared.value
    vectors = vector_matrix(pa.concat_arrays(asked.column("embedding").chunks), sum(b.shape[1] for b in own))
    lengths, ends = np.linalg.norm(vectors, axis=1), np.cumsum([0, *(b.shape[1] for b in own)])
    tables = [vectors[:, a:b] @ book.T for a, b, book in zip(ends, ends[1:], own)]

    def bounds(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, len(own))
        middle = sum(t[:, code[:, i]] for i, t in enumerate(tables))
        return middle, lengths[:, None] * part.column("error").to_numpy()[None, :] + SLACK

    return asked.column("query_id").to_numpy(), vectors, bounds


def _candidates(codes: DataFrame, queries: pa.Table, books: list[np.ndarray], keep: int) -> DataFrame:
    """(query_id, review_id, middle): for each query and task, rows that may be among the `keep` best by the middle of their bounds."""
    shared = codes.sparkSession.sparkContext.broadcast((queries, books))
    key = codes.schema["review_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _, bounds = _lookups(shared)
        floor = np.full(len(ids), -np.inf)  # the last place seen so far in this task
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                middle, _ = bounds(part)
                if middle.shape[1] >= keep:
                    floor = np.maximum(floor, np.partition(middle, middle.shape[1] - keep, axis=1)[:, middle.shape[1] - keep])
                query, row = np.nonzero(middle >= floor[:, None])
                columns = [pa.array(ids[query]), part.column("review_id").take(pa.array(row)), pa.array(middle[query, row])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "review_id", "middle"])

    return codes.mapInArrow(run, f"query_id bigint, review_id {key}, middle double")


def _certain(rows: DataFrame, queries: pa.Table, books: list[np.ndarray], k: int) -> DataFrame:
    """(query_id, review_id, score): the `k` best rows of each query and task, of (review_id, code, error, embedding).

    A row is scored by its full vector where its bound reaches the k-th score found so far, and at once: no
    candidate leaves the task.
    """
    shared = rows.sparkSession.sparkContext.broadcast((queries, books))
    key = rows.schema["review_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, vectors, bounds = _lookups(shared)
        floor = np.full(len(numbers), -np.inf)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, place in `held`, score
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                middle, width = bounds(part)
                reached = middle + width >= floor[:, None]
                full, scores = vector_matrix(part.column("embedding"), vectors.shape[1]), np.full(reached.shape, -np.inf)
                for q in np.flatnonzero(reached.any(axis=1)).tolist():
                    scores[q, reached[q]] = np.round(full[reached[q]] @ vectors[q], SCORE_DIGITS)
                query, row = np.nonzero(reached & (scores >= floor[:, None]))
                if not len(query):
                    continue
                ids = part.column("review_id") if held is None else pa.concat_arrays([held, part.column("review_id")])
                joined = [np.concatenate(pair) for pair in zip(best, (query, row + len(ids) - part.num_rows, scores[query, row]))]
                by_id = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")  # ties go by the id
                position = np.empty(len(by_id), np.int64)
                position[by_id] = np.arange(len(by_id))
                at_query, at_position, score = best_per_query(joined[0], position[joined[1]], joined[2], k)
                place, kept = np.unique(by_id[at_position], return_inverse=True)
                held, best = ids.take(pa.array(place)), [at_query, kept, score]
                full_up = np.bincount(at_query, minlength=len(numbers)) >= k
                worst = np.full(len(numbers), np.inf)
                np.minimum.at(worst, at_query, score)
                floor = np.where(full_up, worst, -np.inf)
        if held is not None:
            columns = [pa.array(numbers[best[0]]), held.take(pa.array(best[1])), pa.array(best[2])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "review_id", "score"])

    return rows.mapInArrow(run, f"query_id bigint, review_id {key}, score double")


def nearest_compressed(
    index: DataFrame, codes: DataFrame, books: list[np.ndarray], queries: DataFrame, k: int = 5, candidates: int = 100, exact: bool = False
) -> DataFrame:
    """(query_id, review_id, score, rank) of the `k` best rows for each (query_id, embedding) row.

    Full vectors are compared for candidates only: `candidates` a query, or, with `exact`, as many
    as the bounds ask for. Ties go to the smaller id; queries without a vector find nothing.
    """
    k = check_k(k)
    asked = stored(queries.filter("embedding IS NOT NULL").select(F.col("query_id").cast("bigint").alias("query_id"), "embedding"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    dealt = asked.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    rows = stored(codes.join(index.select("review_id", "embedding"), "review_id")) if exact and k and books else codes
    found = None
    for block in range(blocks if k and books else 0):
        part = dealt.filter(F.col("_b") == block).drop("_b").toArrow()  # a block of bounded size
        if part.num_rows:
            more = _certain(rows, part, books, k) if exact else _candidates(rows, part, books, max(candidates, k))
            found = more if found is None else found.unionByName(more)
    if found is None:
        empty = index.select(F.lit(0).cast("bigint").alias("query_id"), "review_id", F.lit(0.0).alias("score")).limit(0)
        return rank_within(empty, ["query_id"], best_first(), k)
    found = stored(found)
    if exact:
        return rank_within(found.join(asked.select("query_id"), "query_id"), ["query_id"], best_first(), k)
    chosen = rank_within(found, ["query_id"], [F.desc("middle"), F.asc("review_id")], max(candidates, k))
    full = chosen.select("query_id", "review_id").join(index.select("review_id", "embedding"), "review_id")
    met = full.join(asked.withColumnRenamed("embedding", "_q"), "query_id")
    score = F.round(dot(F.col("embedding"), F.col("_q")), SCORE_DIGITS)
    return rank_within(met.select("query_id", "review_id", score.alias("score")), ["query_id"], best_first(), k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (query_id, review_id) rows that were found."""
    hits = truth.select("query_id", "review_id").join(found.select("query_id", "review_id"), ["query_id", "review_id"], "left_semi")
    return hits.count() / max(truth.count(), 1)
