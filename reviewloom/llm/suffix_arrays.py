"""Benchmark decontamination with suffix arrays over shards of the training texts.

Words of the benchmark get numbers. The documents of an Arrow batch form a sequence
of word numbers, closed off between documents. Shards of at most `SHARD_WORDS`
positions of it are sorted into suffix arrays, and every suffix of every benchmark
item is binary-searched in each of them: what lies between the left and the right
place of a window are all its verbatim occurrences. Suffixes whose first two words
never follow each other in the benchmark (or that are no one-word item) can match
nothing and are left out of the arrays.

A shard is built, searched and dropped inside one task, so memory depends on the
batch and the benchmark, not on the corpus, and no text is shuffled. The benchmark
is read in blocks of about `block_words` words, each broadcast on its own; with
several blocks the matches found so far are carried from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.rows import bytes_of, loaded, share, struct_udf, structs, values
from reviewloom.session import stored

WINDOW = 13
BLOCK_WORDS = 2_000_000
SHARD_WORDS = 2_000_000

_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
MATCHES = "n_words bigint, spans array<int>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_TO_WORDS).split()


class Block:
    """Numbered words of some items, their distinct windows and who owns them."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        pairs: set[tuple[int, int]] = set()
        for name, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            pairs.update(zip(ids, ids[1:]))
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1 if ids else 0):
                named = owners.setdefault(tuple(ids[start : start + size]), set())
                if name is not None:
                    named.add(name)
        windows = sorted(owners)
        self.base = len(self.numbers) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), dtype=np.int64)
        self.single = np.array([w[0] for w in windows if len(w) == 1], dtype=np.int64)
        self.sizes = np.array([len(w) for w in windows], dtype=np.int64)
        filled = np.zeros((len(windows), window), dtype=">u4")
        for i, w in enumerate(windows):
            filled[i, : len(w)] = w
        self.low = _keys(filled)
        past = filled.copy()
        past[np.arange(window) >= self.sizes[:, None]] = 0xFFFFFFFF
        self.high = _keys(past)
        named = [sorted(owners[w]) for w in windows]
        self.names = list(chain.from_iterable(named))
        self.first_name = np.cumsum([0, *map(len, named)])


def _keys(words: np.ndarray) -> np.ndarray:
    """One byte string for each row of word numbers, in the same order."""
    rows = np.ascontiguousarray(words)
    return rows.view(f"S{rows.shape[1] * rows.itemsize}").ravel()


def _suffix_array(padded: np.ndarray, positions: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of the next `window` words, with these words as keys.

    Words behind a closing zero count as zero, so that no key runs into the next text.
    """
    words = np.zeros((len(positions), window), dtype=">u4")
    open_ = np.ones(len(positions), dtype=bool)
    for offset in range(window):
        word = padded[positions + offset]
        open_ &= word > 0
        words[:, offset] = np.where(open_, word, 0)
    keys = _keys(words)
    order = np.argsort(keys, kind="stable")
    return positions[order], keys[order]


def occurrences(ids: np.ndarray, block: Block, shard_words: int = SHARD_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, window numbers) of all windows of `block` in a sequence of word numbers."""
    follow = np.append(ids[1:], 0)
    known = np.zeros(len(ids), dtype=bool)
    both = np.flatnonzero((ids > 0) & (follow > 0))
    if len(block.pairs):
        asked = ids[both] * block.base + follow[both]
        place = np.minimum(np.searchsorted(block.pairs, asked), len(block.pairs) - 1)
        known[both] = block.pairs[place] == asked
    if len(block.single):
        known |= np.isin(ids, block.single)
    positions = np.flatnonzero(known)
    padded = np.concatenate([ids, np.zeros(block.window, dtype=ids.dtype)])
    for start in range(0, len(positions), shard_words):
        array, keys = _suffix_array(padded, positions[start : start + shard_words], block.window)
        left = np.searchsorted(keys, block.low, "left")
        right = np.searchsorted(keys, block.high, "right")
        count = right - left
        found = np.flatnonzero(count)
        count = count[found]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield array[np.repeat(left[found], count) + inside], np.repeat(found, count)


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Flat [start, end, ...] of the union of intervals."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return np.stack([starts[new], reach[last]], axis=1).ravel().tolist()


def _matcher(shared, more: bool):
    """UDF over texts, and over the matches of earlier blocks if there are `more`."""

    def run(texts: pa.Array, *before: pa.Array) -> pa.Array:
        block: Block = loaded(shared)
        get = block.numbers.get
        # The zero behind the words of a text closes it off.
        numbered = []
        for text in values(texts):
            words = words_of(text or b"")
            numbered.append(np.fromiter(chain(map(get, words, repeat(0)), (0,)), np.int32, len(words) + 1))
        lengths = np.array([len(n) - 1 for n in numbered], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(lengths + 1)])
        ids = np.concatenate(numbered).astype(np.int64) if numbered else np.zeros(0, dtype=np.int64)
        del numbered
        if more:
            spans, items = (before[0].field(f).to_pylist() for f in (1, 2))
        else:
            spans, items = [[] for _ in lengths], [[] for _ in lengths]
        parts = list(occurrences(ids, block))
        if parts:
            at, window = (np.concatenate(c) for c in zip(*parts))
            row = np.searchsorted(first, at, "right") - 1
            order = np.argsort(row, kind="stable")
            at, window, row = at[order], window[order], row[order]
            bounds = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
            for low, high in zip(bounds, np.append(bounds[1:], len(row))):
                r = int(row[low])
                starts = at[low:high] - first[r]
                old = np.array(spans[r], dtype=np.int64).reshape(-1, 2)
                ends = starts + block.sizes[window[low:high]]
                spans[r] = _merged(np.append(starts, old[:, 0]), np.append(ends, old[:, 1]))
                names = set(items[r])
                for w in np.unique(window[low:high]):
                    names.update(block.names[block.first_name[w] : block.first_name[w + 1]])
                items[r] = sorted(names)
        return structs(
            ("n_words", "spans", "items"),
            (lengths, pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))),
        )

    return struct_udf(run, f"struct<{MATCHES}>")


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[Block]:
    """Items block by block; the driver holds no more than one block's texts."""
    held: list[tuple[str | None, bytes]] = []
    size = 0
    rows = benchmark.select(F.col(item_id).cast("string"), bytes_of(text))
    for name, words in rows.toLocalIterator():
        words = bytes(words)
        count = len(words_of(words))
        if held and size + count > block_words:
            yield Block(held)
            held, size = [], 0
        held.append((name, words))
        size += count
    yield Block(held)


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
    name: str = "matches",
) -> DataFrame:
    """Add `matches`: n_words, spans of matched words (flat start, end pairs), item ids.

    A window is 13 consecutive words of an item, or the whole of a shorter one. Spans
    are the merged verbatim matches, in words, ends exclusive; `items` are the ids,
    sorted as strings, of the items that own a matched window. NULL and empty
    texts have no words; items without words match nothing; an item without an
    id matches but is not named; repeated ids are named once. A column called
    `name` is replaced, all others stay; empty tables give no rows or no matches.
    """
    out = docs
    for i, block in enumerate(_blocks(benchmark, item_id, item_text, block_words)):
        if i:
            out = stored(out)
        before: list[Column] = [F.col(name)] if i else []
        out = out.withColumn(name, _matcher(share(docs.sparkSession, block), bool(i))(bytes_of(text), *before))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256 and contaminated to `docs`.

    A document is contaminated if matched words are at least a twentieth of its
    words. Columns of these names are replaced.
    """
    found = with_matches(docs, benchmark, name="_matches", **options)
    spans, items = F.col("_matches.spans"), F.col("_matches.items")
    lengths = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("bigint"))
    n_words, n_hit = F.col("_matches.n_words"), F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.withColumns(
        {
            "n_words": n_words,
            "n_hit": n_hit,
            "n_items": F.size(items).cast("bigint"),
            "items_sha256": F.sha2(F.array_join(items, ","), 256),
            "contaminated": (n_hit > 0) & (20 * n_hit >= n_words),
        }
    ).drop("_matches")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the contaminated rows, with their own columns and values."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text = F.col("text").alias("_text")
    judged = contamination(docs.select(own, text), benchmark, text="_text")
    return judged.filter(~F.col("contaminated")).select("_row.*")
