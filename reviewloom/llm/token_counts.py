"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

The pre-tokens of an Arrow batch (each distinct one once) are held as one ragged
numpy array of symbols. In every round each sequence finds its lowest-rank pair and
merges it, all sequences at the same time; sequences without a pair left drop out,
and their surviving symbols are counted. Characters outside the vocabulary count
as their UTF-8 bytes, which is the model's byte fallback.

A pair that occurs several times in a sequence is merged in one round everywhere
(left to right without overlap), unless this makes a pair of the same or a lower
rank: the library would take that one next, so the sequence then merges its
leftmost occurrence only. The result is therefore the library's in every case.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.rows import loaded, share, struct_udf, text_of, values

LIMIT = 4096
SPACE = "▁"
NO_PAIR = np.iinfo(np.int32).max
CHUNK_SYMBOLS = 500_000


class MergeTable:
    """Ranks and results of all symbol pairs of a model, as sorted arrays."""

    def __init__(self, model: bytes) -> None:
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        if lib.normalize(" a  ﬁ\n ") != f"{SPACE * 2}a{SPACE * 2}ﬁ\n{SPACE}":
            raise ValueError("only models that leave texts as they are and put one space in front are supported")
        pieces = {
            lib.id_to_piece(i): lib.get_score(i)
            for i in range(lib.get_piece_size())
            if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))
        }
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in pieces):
            raise ValueError("a piece runs over the end of a word")
        number = {p: i for i, p in enumerate(pieces)}
        for char in sorted({c for p in pieces for c in p} - set(pieces)):
            number[char] = len(number)
        self.size = len(number) + 5  # the last four stand for other characters, by their bytes
        self.cost = np.ones(self.size, dtype=np.int64)
        self.cost[-4:] = range(1, 5)
        for char, i in number.items():
            if char not in pieces:
                self.cost[i] = len(char.encode())
        code = np.arange(0x110000)
        self.of_code = (self.size - 4 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int32)
        for char, i in number.items():
            if len(char) == 1:
                self.of_code[ord(char)] = i
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        pairs = [
            (number[p[:cut]] * self.size + number[p[cut:]], order[score], number[p])
            for p, score in pieces.items()
            for cut in range(1, len(p))
            if p[:cut] in number and p[cut:] in number
        ]
        self.keys, self.ranks, self.merged = (np.array(c, dtype=np.int64) for c in zip(*sorted(pairs)))
        self.newline = int(self.cost[self.of_code[ord("\n")]])

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks, results) of symbol pairs; NO_PAIR where there is none."""
        asked = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        known = self.keys[at] == asked
        return np.where(known, self.ranks[at], NO_PAIR), np.where(known, self.merged[at], 0)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, in pieces of bounded size."""
        out, lengths = [], np.fromiter(map(len, words), np.int64, len(words))
        reach, start = np.cumsum(lengths), 0
        while start < len(words):
            done = reach[start - 1] if start else 0
            stop = max(int(np.searchsorted(reach, done + CHUNK_SYMBOLS, "right")), start + 1)
            out.append(self._count(words[start:stop], lengths[start:stop]))
            start = stop
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def _count(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = self.of_code[codes].astype(np.int64)
        sequence = np.repeat(np.arange(len(words)), lengths)
        totals = np.bincount(sequence, weights=self.cost[symbols], minlength=len(words)).astype(np.int64)
        rank, result = self._pairs(symbols, sequence)
        while len(symbols):
            starts = np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(rank, starts)
            open_ = np.repeat(lowest < NO_PAIR, sizes)
            if not open_.all():
                symbols, sequence, rank, result = symbols[open_], sequence[open_], rank[open_], result[open_]
                sizes, lowest = sizes[lowest < NO_PAIR], lowest[lowest < NO_PAIR]
                if not len(symbols):
                    break
            least = np.repeat(lowest, sizes)
            chosen = _without_overlap(rank == least, sequence)
            state = self._merge(symbols, sequence, rank, result, least, chosen)
            if len(state[-1]):
                first = _first_of_each(chosen, sequence)
                chosen &= first | ~np.isin(sequence, state[-1])
                state = self._merge(symbols, sequence, rank, result, least, chosen)
            gone = np.flatnonzero(chosen)
            saved = self.cost[symbols[gone]] + self.cost[symbols[gone + 1]] - self.cost[result[gone]]
            np.subtract.at(totals, sequence[gone], saved)
            symbols, sequence, rank, result, _ = state
        return totals

    def _pairs(self, symbols: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.full(len(symbols), NO_PAIR, dtype=np.int64)
        result = np.zeros(len(symbols), dtype=np.int64)
        inside = np.flatnonzero(sequence[1:] == sequence[:-1])
        rank[inside], result[inside] = self.find(symbols[inside], symbols[inside + 1])
        return rank, result

    def _merge(self, symbols, sequence, rank, result, least, chosen):
        """Arrays after merging the chosen pairs, and the sequences that got a pair as low."""
        keep = np.append(True, ~chosen[:-1])
        symbols = np.where(chosen, result, symbols)[keep]
        sequence, rank, result, least = sequence[keep], rank[keep], result[keep], least[keep]
        new = chosen[keep]
        touched = new.copy()
        touched[:-1] |= new[1:]
        last = np.append(sequence[1:] != sequence[:-1], True)
        rank[touched & last] = NO_PAIR
        at = np.flatnonzero(touched & ~last)
        rank[at], result[at] = self.find(symbols[at], symbols[at + 1])
        return symbols, sequence, rank, result, np.unique(sequence[at[rank[at] <= least[at]]])


def _without_overlap(wanted: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """Every other of neighbouring wanted pairs, from the left."""
    at = np.flatnonzero(wanted)
    joined = np.append(False, (at[1:] == at[:-1] + 1) & (sequence[at[1:]] == sequence[at[:-1]]))
    run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
    chosen = np.zeros(len(wanted), dtype=bool)
    chosen[at[(np.arange(len(at)) - run) % 2 == 0]] = True
    return chosen


def _first_of_each(chosen: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(chosen)
    out = np.zeros(len(chosen), dtype=bool)
    out[at[np.append(True, sequence[at[1:]] != sequence[at[:-1]])]] = True
    return out


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]


def _pre_tokens(texts: Iterable[str]) -> tuple[list[str], array, list[int], list[int]]:
    """Distinct pre-tokens, their numbers in reading order, and per text how many and its newlines.

    A pre-token is a run of spaces with the word behind it, or a word that begins a
    line; no piece runs over such an end. Spaces are written as the model does.
    """
    spaced, bare = _Numbers(), _Numbers()
    flat, many, lines = array("q"), [], []
    for text in texts:
        before = len(flat)
        rows = text.replace(SPACE, " ").split("\n") if text else []
        for i, row in enumerate(rows):
            head, *parts = (" " + row if i == 0 else row).split(" ")
            if head:
                flat.append(-1 - bare[head])
            if "" in parts:
                run, joined = 0, []
                for part in parts:
                    run += 1
                    if part:
                        joined.append(SPACE * (run - 1) + part)
                        run = 0
                parts = joined + ([SPACE * (run - 1)] if run else [])
            flat.extend(map(spaced.__getitem__, parts))
        many.append(len(flat) - before)
        lines.append(max(len(rows) - 1, 0))
    words = [SPACE + w for w in spaced] + list(bare)
    numbers = np.frombuffer(flat, dtype=np.int64) if len(flat) else np.zeros(0, dtype=np.int64)
    return words, np.where(numbers < 0, len(spaced) - 1 - numbers, numbers), many, lines


def _counter(shared):
    def run(texts: pa.Array) -> pa.Array:
        table: MergeTable = loaded(shared)
        words, numbers, many, lines = _pre_tokens(values(texts))
        reach = np.append(0, np.cumsum(table.count(words)[numbers]))
        ends = np.cumsum(many, dtype=np.int64)
        counts = reach[ends] - reach[ends - np.array(many, dtype=np.int64)]
        return pa.array(counts + table.newline * np.array(lines, dtype=np.int64), pa.int64())

    return struct_udf(run, "bigint")


def token_counts(docs: DataFrame, model_path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (more than `limit` tokens) to `docs`.

    `model_path` is a sentencepiece BPE model on the driver; its tables, whose size
    depends on the vocabulary alone, are broadcast. Texts are counted whole, without
    begin or end marks; special strings in them are ordinary text. NULL and empty
    texts have no tokens. Columns of these names are replaced.
    """
    with open(model_path, "rb") as file:
        table = MergeTable(file.read())
    count = _counter(share(docs.sparkSession, table))
    out = docs.withColumn("n_bytes", F.octet_length(text_of(text)).cast("bigint"))
    out = out.withColumn("n_tokens", count(text_of(text)))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
