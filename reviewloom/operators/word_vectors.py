"""Word vectors learned from the reviews: positive PMI of word pairs, factorised.

Words that stand near each other are counted, and a pair's weight is the log of how much
more often it is seen than chance would have it, where that is positive. The table of
weights is symmetric; its leading eigenvectors are found by power iteration on a whole block of
vectors: every round multiplies the weights, packed in small pieces, with the vectors and adds up, then makes the sums
orthonormal through their small product matrix. Words with like neighbours get like
vectors. The weights and the vectors stay tables. The driver gets matrices of `dims` by
`dims` numbers and, for the broadcasts, a vocabulary and vectors of a stated size at most;
a larger vocabulary is joined, more vectors are broadcast one slice after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.constants import SCORE_DIGITS
from reviewloom.functions.text import words
from reviewloom.functions.vectors import unit
from reviewloom.operators.batch import vector_matrix
from reviewloom.operators.ranking import join_counted
from reviewloom.operators.search import nearest_batch
from reviewloom.operators.text_search import term_counts
from reviewloom.session import stored

WINDOW = 3
MIN_COUNT = 20
DIMS = 32
ROUNDS = 12
#: Vocabularies of more words are joined, not broadcast.
MAX_BROADCAST_WORDS = 4_000_000
#: Words whose pairs are counted at once, if a text has no more, and pairs that a task holds to add up.
WORDS_AT_ONCE = 250_000
PAIRS_HELD = 2_000_000
#: Words of a block at most, and weights of all its words, about: memory of a task.
BLOCK_WORDS = 8_192
BLOCK_ENTRIES = 500_000
#: Weights of a piece, which is one row: Arrow sends 10,000 rows at once. Weights multiplied at a time.
PIECE_ENTRIES = 256
ENTRIES_AT_ONCE = 100_000
#: Numbers of the vectors that are broadcast at once; more go in slices.
MAX_BROADCAST_VALUES = 4_000_000
BLOCK_SCHEMA = "block int, x binary"
PIECE_SCHEMA = pa.schema([("row", pa.int32()), ("i", pa.binary()), ("j", pa.binary()), ("pmi", pa.binary())])


def vocabulary(texts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words seen at least `min_count` times."""
    counted = texts.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _cut(lists: pa.Array, n_words: int) -> Iterator[pa.Array]:
    """Runs of lists with `n_words` words at most, or of one list."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(lists):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + n_words, "right")))
        yield lists.slice(start, end - start)
        start = end


def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same pairs added up."""
    if len(counts) == 1:
        return counts[0]
    pair, n = (np.concatenate(x) for x in zip(*counts))
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    starts = np.flatnonzero(np.append(True, np.diff(pair) != 0)) if len(pair) else np.zeros(0, np.int64)
    return pair[starts], np.add.reduceat(n, starts) if len(pair) else n


def _numbered_pairs(texts: DataFrame, known: pa.Array, window: int) -> DataFrame:
    """(a, b, n), a <= b: counts of the pairs of known words, which are named by their places in `known`.

    A task gives a pair once for about `PAIRS_HELD` pairs.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def counted(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        encoded = lists.flatten().dictionary_encode()
        number = pc.fill_null(pc.index_in(encoded.dictionary, value_set=shared.value), -1).to_numpy(zero_copy_only=False)
        word = number[encoded.indices.to_numpy()].astype(np.int64)
        text = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        found = []
        for d in range(1, window + 1):
            left, right = word[:-d], word[d:]
            near = (text[:-d] == text[d:]) & (left >= 0) & (right >= 0)
            left, right = left[near], right[near]
            found.append((np.minimum(left, right) << 32) | np.maximum(left, right))
        return np.unique(np.concatenate(found), return_counts=True)

    def listed(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for lists in _cut(batch.column(0), WORDS_AT_ONCE):
                held.append(counted(lists))
                if sum(len(pair) for pair, _ in held) > PAIRS_HELD:
                    held = [_added(held)]
                    if len(held[0][0]) > PAIRS_HELD // 2:
                        yield listed(*held.pop())
        if held:
            yield listed(*_added(held))

    made = texts.select(words(F.col("text")).alias("ws")).mapInArrow(run, "a int, b int, n bigint")
    return made.repartition("a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _joined_pairs(texts: DataFrame, vocab: DataFrame, window: int) -> DataFrame:
    """(a, b, n), a <= b, of words, for a vocabulary too large to broadcast: all pairs are counted, then joined with it."""
    found = words(F.col("text"))

    def at_distance(ws, d: int):
        left, right = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - d, F.lit(0))), F.slice(ws, d + 1, F.size(ws))
        return F.zip_with(left, right, lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))

    listed = texts.select(found.alias("_w")).filter(F.size("_w") > 1)
    pairs = listed.select(F.explode(F.concat(*[at_distance(F.col("_w"), d) for d in range(1, window + 1)])).alias("p")).select("p.*")
    counted = stored(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    total = counted.count()
    for side in ("a", "b"):
        held = counted.groupBy(side).agg(F.count(F.lit(1)).alias("_rows"))
        known = vocab.select(F.col("word").alias(side)).join(held, side)
        counted = join_counted(counted, known, side, "_rows", total, spread="b" if side == "a" else "a").drop("_rows")
    return counted


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Sums of pairs of either order: (word, n, rows)."""
    sides = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    return pairs.select(F.explode(sides).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("sum"), F.count(F.lit(1)).alias("rows"))


def pair_counts(texts: DataFrame, vocab: DataFrame, window: int = WINDOW) -> DataFrame:
    """(word, context, n, word_n, context_n, all_n): how often two words of the vocabulary stand at most `window` places apart, both ways.

    `word_n` and `context_n` are the sums of `n` of a word and of a context over all pairs, `all_n` is the sum of all. Pairs are
    counted inside the batches as numbers; the words come back last. A vocabulary of more than
    `MAX_BROADCAST_WORDS` words is joined instead.
    """
    spark = texts.sparkSession
    vocab = vocab.select("word").distinct()
    few = vocab.count() <= MAX_BROADCAST_WORDS
    if few:
        known = vocab.toArrow().column("word").combine_chunks().cast(pa.string())
        counted = stored(_numbered_pairs(texts, known, window))
        names = pa.table({"id": pa.array(np.arange(len(known), dtype=np.int32)), "name": known})
        sums = _both_ways(counted).join(F.broadcast(spark.createDataFrame(names)), F.col("word") == F.col("id"))
        sums = stored(sums.select(F.col("word").alias("id"), "name", "sum", "rows"))
    else:
        counted = stored(_joined_pairs(texts, vocab, window))
        sums = stored(_both_ways(counted).select(F.col("word").alias("id"), F.col("word").alias("name"), "sum", "rows"))
    every = sums.agg(F.sum("sum")).first()[0] or 0
    total = 0 if few else counted.count()
    for side, other in (("a", "b"), ("b", "a")):
        right = sums.select(F.col("id").alias(side), F.col("name").alias(f"_{side}"), F.col("sum").alias(f"_{side}_n"), F.col("rows").alias("_rows"))
        if few:
            counted = counted.join(F.broadcast(right.drop("_rows")), side)
        else:
            counted = join_counted(counted, right, side, "_rows", total, spread=other).drop("_rows")
    one = F.struct(F.col("_a").alias("word"), F.col("_b").alias("context"), "n", F.col("_a_n").alias("word_n"), F.col("_b_n").alias("context_n"))
    other = F.struct(F.col("_b").alias("word"), F.col("_a").alias("context"), "n", F.col("_b_n").alias("word_n"), F.col("_a_n").alias("context_n"))
    ways = F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, other))
    return counted.select(F.inline(ways)).withColumn("all_n", F.lit(every).cast("bigint"))


def positive_pmi(pairs: DataFrame) -> DataFrame:
    """(word, context, n, pmi) of the `pair_counts` that are seen more often than chance would have it."""
    chance = F.col("word_n").cast("double") * F.col("context_n")
    pmi = F.round(F.log(F.col("n") * F.col("all_n").cast("double") / chance), SCORE_DIGITS)
    return pairs.select("word", "context", "n", pmi.alias("pmi")).filter("pmi > 0")


def _matrix(cell: pa.Scalar, dims: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.float64).reshape(-1, dims)


def _products(left: DataFrame, right: DataFrame | None, dims: int) -> np.ndarray:
    """The sum over all words of the outer products of their vectors in two tables of (block, x); of one with itself without `right`."""
    alone = right is None
    both = left if alone else left.join(right.withColumnRenamed("x", "y"), "block")
    schema = pa.schema([("at", pa.int32()), ("sum", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((dims, dims))
        for batch in batches:
            for i in range(batch.num_rows):
                x = _matrix(batch.column("x")[i], dims)
                sums += x.T @ (x if alone else _matrix(batch.column("y")[i], dims))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims, dtype=np.int32)), pa.array(sums.ravel())], schema=schema)

    out = np.zeros(dims * dims)
    for r in both.mapInArrow(run, "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect():  # dims x dims numbers
        out[r["at"]] = r["sum"]
    return out.reshape(dims, dims)


def _turned(blocks: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(block, x): all vectors times a small matrix."""
    shared = blocks.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                turned = _matrix(batch.column("x")[i], len(shared.value)) @ shared.value
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), pa.array([turned.tobytes()], pa.binary())], names=["block", "x"])

    return blocks.select("block", "x").mapInArrow(run, BLOCK_SCHEMA)


def _orthonormal(blocks: DataFrame, dims: int) -> DataFrame:
    """Vectors spanning the same columns, orthonormal; directions without any length become zero."""
    lengths, axes = np.linalg.eigh(_products(blocks, None, dims))
    scale = np.where(lengths > lengths.max(initial=0.0) * 1e-12, 1.0 / np.sqrt(np.maximum(lengths, 1e-300)), 0.0)
    return stored(_turned(blocks, axes * scale))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights (row, i, j, pmi) that are sorted by row and i, packed: runs of one row, `PIECE_ENTRIES` at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row, i, j, pmi = (batch.column(c).to_numpy().astype(t) for c, t in (("row", np.int32), ("i", np.int32), ("j", np.int32), ("pmi", np.float64)))
        edges = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
        starts = [x for a, b in zip(edges, edges[1:]) for x in range(a, b, PIECE_ENTRIES)]
        parts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(row)])]
        cells = [pa.array([c[part].tobytes() for part in parts], pa.binary()) for c in (i, j, pmi)]
        yield pa.RecordBatch.from_arrays([pa.array(row[starts]), *cells], schema=PIECE_SCHEMA)


def _slices(sizes: list[int], dims: int) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of blocks whose vectors may be broadcast together; one block at least."""
    first = 0
    while first < len(sizes):
        end, n = first + 1, sizes[first]
        while end < len(sizes) and (n + sizes[end]) * dims <= MAX_BROADCAST_VALUES:
            n += sizes[end]
            end += 1
        yield first, end
        first = end


def _multiplied(pieces: DataFrame, blocks: DataFrame, sizes: list[int], dims: int) -> DataFrame:
    """(block, x): the table of weights, in pieces, times the vectors.

    The pieces of a block of words lie in one part, so that a task adds up what they give. `sizes` are those of the blocks,
    whose words are numbered one block after another. The vectors pass the driver, a slice at a time.
    """
    schema = pa.schema([("block", pa.int32()), ("x", pa.binary())])
    starts = np.append(0, np.cumsum(sizes)).tolist()

    def one(at: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sums.tobytes()], pa.binary())], schema=schema)

    def times(first: int, end: int) -> DataFrame:
        x = np.zeros((starts[end] - starts[first], dims))
        for block, cell in blocks.filter(F.col("block").between(first, end - 1)).collect():
            x[starts[block] - starts[first] : starts[block + 1] - starts[first]] = np.frombuffer(cell, np.float64).reshape(-1, dims)
        shared = blocks.sparkSession.sparkContext.broadcast(x)
        low, high, whole = starts[first], starts[end], end - first == len(sizes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, sums = None, None
            for batch in batches:
                row = batch.column("row").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)] if len(row) else [0]
                for a, b in zip(edges, edges[1:]):
                    if row[a] != at:
                        if sums is not None:
                            yield one(at, sums)
                        at = int(row[a])
                        sums = np.zeros((sizes[at], dims))
                    i, j, pmi = (np.frombuffer(b"".join(batch.column(c).slice(a, b - a).to_pylist()), t) for c, t in (("i", np.int32), ("j", np.int32), ("pmi", np.float64)))
                    if not whole:
                        met = (j >= low) & (j < high)
                        i, j, pmi = i[met], j[met], pmi[met]
                    for begin in range(0, len(i), ENTRIES_AT_ONCE):
                        part = slice(begin, begin + ENTRIES_AT_ONCE)
                        heads = np.flatnonzero(np.append(True, np.diff(i[part]) != 0))
                        # A word may come again where two files meet.
                        np.add.at(sums, i[part][heads], np.add.reduceat(shared.value[j[part] - low] * pmi[part, None], heads, axis=0))
            if sums is not None:
                yield one(at, sums)

        made = stored(pieces.mapInArrow(run, BLOCK_SCHEMA))
        shared.destroy()
        return made

    def added(rows: pa.Table) -> pa.Table:
        total = sum(_matrix(c, dims) for c in rows.column("x"))
        return pa.table([rows.column("block").slice(0, 1), pa.array([total.tobytes()], pa.binary())], schema=schema)

    parts = [times(first, end) for first, end in _slices(sizes, dims)]
    return stored(reduce(DataFrame.unionByName, parts).groupBy("block").applyInArrow(added, BLOCK_SCHEMA))


def factorise(weights: DataFrame, dims: int = DIMS, rounds: int = ROUNDS) -> tuple[DataFrame, list[float]]:
    """(word, vector) of the symmetric (word, context, pmi) table, and its leading eigenvalues.

    A vector holds a word's places in the leading eigenvectors, largest eigenvalue first,
    each times the root of the eigenvalue's size. Words are dealt to blocks and the weights of a block's words are
    packed in small pieces, which a round multiplies with the vectors. The weights are read twice and not written as words.
    """
    weights = weights.select("word", "context", "pmi")
    held = stored(weights.groupBy("word").agg(F.count(F.lit(1)).alias("_rows")))
    sums = held.agg(F.sum("_rows"), F.count(F.lit(1))).first()
    total, n_words = sums[0] or 0, sums[1]
    if not total:
        return held.select("word", F.array().cast("array<double>").alias("vector")), []
    n_blocks = max(math.ceil(n_words / BLOCK_WORDS), math.ceil(total / BLOCK_ENTRIES))
    dealt = held.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(n_blocks)).cast("int"))
    in_block = Window.partitionBy("block")
    places = (F.row_number().over(in_block.orderBy("word")) - 1).alias("place")
    placed = stored(dealt.select("word", "_rows", "block", places))
    sizes = [0] * n_blocks
    for r in placed.groupBy("block").count().collect():  # one row per block
        sizes[r["block"]] = r["count"]
    begins = F.array(*[F.lit(x) for x in np.append(0, np.cumsum(sizes))[:-1].tolist()])
    # The table is symmetric, so a context has as many rows as it has as a word.
    of_word = placed.select("word", "_rows", F.col("block").alias("row"), F.col("place").alias("i"))
    of_context = placed.select(F.col("word").alias("context"), "_rows", (F.col("place") + begins[F.col("block")]).cast("int").alias("j"))
    met = weights
    for right, key, other in ((of_word, "word", "context"), (of_context, "context", "word")):
        if n_words <= MAX_BROADCAST_WORDS:
            met = met.join(F.broadcast(right.drop("_rows")), key)
        else:
            met = join_counted(met, right, key, "_rows", total, spread=other).drop("_rows")
    # Few and small columns in the shuffle: i and j are one number.
    dealt = met.select("row", (F.shiftleft(F.col("i").cast("bigint"), 32) + F.col("j")).alias("_at"), "pmi")
    dealt = dealt.repartition(n_blocks, "row").sortWithinPartitions("row", "_at")
    unpacked = dealt.select("row", F.shiftright("_at", 32).cast("int").alias("i"), F.col("_at").bitwiseAND(0xFFFFFFFF).cast("int").alias("j"), "pmi")
    pieces = stored(unpacked.mapInArrow(_pieces, "row int, i binary, j binary, pmi binary"))
    # Start from numbers that only depend on the word.
    start = F.array(*[F.xxhash64(F.lit(i), "word") / float(2**63) for i in range(dims)])

    def gathered(rows: pa.Table) -> pa.Table:
        matrix = vector_matrix(pa.concat_arrays(rows.sort_by("place").column("v").chunks), dims)
        return pa.table([rows.column("block").slice(0, 1), pa.array([matrix.tobytes()], pa.binary())], names=["block", "x"])

    first = placed.select("block", "place", start.alias("v")).groupBy("block").applyInArrow(gathered, BLOCK_SCHEMA)
    vectors = _orthonormal(stored(first), dims)
    for _ in range(rounds):
        vectors = _orthonormal(_multiplied(pieces, vectors, sizes, dims), dims)
    small = _products(vectors, _multiplied(pieces, vectors, sizes, dims), dims)
    values, axes = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")
    values, axes = values[order], axes[:, order]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                x = _matrix(batch.column("x")[n], dims)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.ravel()))
                block = np.full(len(x), batch.column("block")[n].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.arange(len(x), dtype=np.int32)), lists], names=["block", "place", "vector"])

    found = _turned(vectors, axes * np.sqrt(np.abs(values))).mapInArrow(listed, "block int, place int, vector array<double>")
    return stored(placed.join(found, ["block", "place"]).select("word", "vector")), values.tolist()


def learn_words(
    texts: DataFrame, dims: int = DIMS, min_count: int = MIN_COUNT, window: int = WINDOW, rounds: int = ROUNDS
) -> DataFrame:
    """(word, vector) learned from (review_id, text) rows; rare words have none."""
    vocab = stored(vocabulary(texts, min_count))
    return factorise(positive_pmi(pair_counts(texts, vocab, window)), dims, rounds)[0]


def words_alike(vectors: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """(word, alike, score, rank): the `k` words with the largest cosine for each asked word, itself left out."""
    known = vectors.filter(F.exists("vector", lambda x: x != 0)).select(
        F.col("word").alias("review_id"), unit(F.col("vector"), "double").alias("embedding")
    )
    known = stored(known)
    queries = known.join(asked.select(F.col("word").alias("review_id")).distinct(), "review_id")
    near = nearest_batch(known, queries.withColumnRenamed("review_id", "query_id"), k + 1)
    # The word itself is first but for ties; ranks behind it move up.
    own = F.col("query_id") == F.col("review_id")
    others = near.filter(~own).join(
        near.filter(own).select("query_id", F.col("rank").alias("_own")), "query_id", "left"
    )
    place = F.col("rank") - F.when(F.col("_own") < F.col("rank"), 1).otherwise(0)
    return others.select(F.col("query_id").alias("word"), F.col("review_id").alias("alike"), "score", place.alias("rank")).filter(F.col("rank") <= k)


def embed_learned(texts: DataFrame, vectors: DataFrame, key: str = "review_id") -> DataFrame:
    """(key, embedding) of (key, text) rows: the unit sum of the vectors of a text's words.

    A text without a known word has no embedding and gets no row.
    """
    counts = stored(term_counts(texts, key))
    held = counts.groupBy("word").agg(F.count(F.lit(1)).alias("_rows"))
    known = vectors.select("word", array_to_vector("vector").alias("_v")).join(held, "word")
    met = join_counted(counts, known, "word", "_rows", counts.count(), spread=key)
    summed = met.groupBy(key).agg(vector_to_array(Summarizer.sum(F.col("_v"), F.col("tf").cast("double"))).alias("_sum"))
    return summed.filter(F.exists("_sum", lambda x: x != 0)).select(key, unit(F.col("_sum"), "double").cast("array<float>").alias("embedding"))
