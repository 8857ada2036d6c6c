"""Language identification: known words first, then shorter and shorter character n-grams.

Training counts every word and every character n-gram of all training texts per
language. A word is known if it makes up at least 1 / `KNOWN_WORDS` of the words of
some language, so no language can have more than `KNOWN_WORDS` of them and the model
that is broadcast has a fixed size bound; rarer words teach through their n-grams,
which are counted in a fixed number of slots per order.

A known word scores its log frequency in each language. An unseen word scores the
mean over its places of the longest n-gram seen in training, each step to a shorter
one costing log(0.4). The language with the highest sum wins.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.rows import loaded, remainder_of_id, share, struct_udf, structs, text_of, values, with_fields
from reviewloom.session import stored

KNOWN_WORDS = 65_536
ORDERS = (1, 2, 3, 4)
SLOTS = 65_536
SMOOTHING = 0.1
BACKOFF = float(np.log(0.4))
MAX_LANGUAGES = 256
FLUSH_WORDS = 200_000
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")
COUNTS = "lang string, word string, slot int, n bigint"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return WORD.findall(text.lower())


class Grams:
    """Slots of the character n-grams of a list of words, with a blank at either end."""

    def __init__(self, words: list[str]) -> None:
        text = " " + " ".join(words) + " "
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        self.blank = self.codes == 32
        # A place belongs to the word behind it; the last blank begins nothing.
        self.word = np.cumsum(self.blank) - 1

    def of(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, slots) of the n-grams of one order that lie within one word."""
        places = len(self.codes) - order + 1
        if places <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        whole = ~self.blank[:places] if order == 1 else np.ones(places, dtype=bool)
        key = np.full(places, 7919 * order, dtype=np.uint64)
        for i in range(order):
            if 0 < i < order - 1:
                whole &= ~self.blank[i : i + places]
            key = (key ^ self.codes[i : i + places]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        at = np.flatnonzero(whole)
        base = (order - 1) * SLOTS
        return at, base + (key[at] % np.uint64(SLOTS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word and n-gram counts per language, summed inside the task up to FLUSH_WORDS words."""
    held: dict[str, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            if not counts:
                continue
            words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            grams = Grams(words)
            totals = np.zeros(len(ORDERS) * SLOTS)
            for order in ORDERS:
                at, slot = grams.of(order)
                totals += np.bincount(slot, weights=n[grams.word[at]], minlength=len(totals))
            used = np.flatnonzero(totals)
            yield from pa.Table.from_arrays(
                [
                    pa.array([lang] * (len(words) + len(used)), pa.string()),
                    pa.array(words + [None] * len(used), pa.string()),
                    pa.array(np.append(np.full(len(words), -1), used), pa.int32()),
                    pa.array(np.append(n, totals[used].astype(np.int64)), pa.int64()),
                ],
                names=["lang", "word", "slot", "n"],
            ).to_batches(50_000)
        held.clear()

    for batch in batches:
        for lang, text in zip(values(batch.column(0)), values(batch.column(1))):
            held[lang].update(words_of(text))
        if sum(map(len, held.values())) > FLUSH_WORDS:
            yield from flush()
    yield from flush()


class LanguageModel:
    """Log frequencies: one row for each known word, one table of n-gram slots per order."""

    def __init__(self, langs: list[str], words: pa.Table, grams: pa.Table, totals: dict[str, tuple[int, int]]) -> None:
        self.langs = langs
        at = {lang: i for i, lang in enumerate(langs)}
        self.known: dict[str, int] = {}
        rows = [self.known.setdefault(w, len(self.known)) for w in words["word"].to_pylist()]
        counts = np.zeros((len(self.known), len(langs)))
        counts[rows, [at[x] for x in words["lang"].to_pylist()]] = words["n"].to_numpy()
        sizes = np.array([totals[x] for x in langs], dtype=np.float64).reshape(-1, 2)
        self.words = np.log((counts + SMOOTHING) / (sizes[:, 0] + SMOOTHING * (sizes[:, 1] + 1))).astype(np.float32)
        seen = np.zeros((len(ORDERS) * SLOTS, len(langs)))
        seen[grams["slot"].to_numpy(), [at[x] for x in grams["lang"].to_pylist()]] = grams["n"].to_numpy()
        self.seen = seen.any(axis=1)
        per_order = seen.reshape(len(ORDERS), SLOTS, -1)
        chance = (per_order + SMOOTHING) / (per_order.sum(axis=1, keepdims=True) + SMOOTHING * SLOTS)
        steps = (max(ORDERS) - np.array(ORDERS)) * BACKOFF
        self.grams = (np.log(chance) + steps[:, None, None]).reshape(len(ORDERS) * SLOTS, -1).astype(np.float32)

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row of language scores for each word."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        out[at >= 0] = self.words[at[at >= 0]]
        unseen = np.flatnonzero(at < 0)
        for start in range(0, len(unseen), 100_000):
            part = unseen[start : start + 100_000]
            out[part] = self._score_unseen([words[i] for i in part])
        return out

    def _score_unseen(self, words: list[str]) -> np.ndarray:
        grams = Grams(words)
        best = np.full(len(grams.codes), -1, dtype=np.int64)
        for order in ORDERS:  # a longer known n-gram replaces a shorter one
            at, slot = grams.of(order)
            known = self.seen[slot]
            best[at[known]] = slot[known]
        used = np.flatnonzero(best >= 0)
        sums = np.zeros((len(words), len(self.langs)))
        places = np.bincount(grams.word[used], minlength=len(words))[: len(words)]
        for lang in range(len(self.langs)):
            weights = self.grams[best[used], lang]
            sums[:, lang] = np.bincount(grams.word[used], weights=weights, minlength=len(words))[: len(words)]
        return sums / np.maximum(places, 1)[:, None]


def train(labelled: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
    """Model of all rows with a language and a text."""
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), text_of(text))
    raw = rows.mapInArrow(_count, COUNTS)
    counts = stored(raw.groupBy("lang", "word", "slot").agg(F.sum("n").alias("n")))
    words = counts.filter("word IS NOT NULL").select("lang", "word", "n")
    totals = words.groupBy("lang").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct_words"))
    sizes = {r["lang"]: (r["words"], r["distinct_words"]) for r in totals.limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    least = F.coalesce(*[F.when(F.col("lang") == x, n / KNOWN_WORDS) for x, (n, _) in sizes.items()], F.lit(0.0))
    common = stored(words.filter(F.col("n") >= least).select("word").distinct())
    known = words.join(common, "word", "left_semi").orderBy("word", "lang").toArrow()
    grams = counts.filter("word IS NULL").select("lang", "slot", "n").toArrow()
    return LanguageModel(sorted(sizes), known, grams, sizes)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]


def _predictor(shared):
    def run(texts: pa.Array) -> pa.Array:
        model: LanguageModel = loaded(shared)
        numbers = _Numbers()
        flat, many, letters = [], [], []
        for text in values(texts):
            words = words_of(text)
            flat.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            many.append(len(words))
            letters.append(bool(words) or any(map(str.isalpha, text)))
        row = np.repeat(np.arange(len(many)), many)
        order = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int64)
        scores = model.score_words(list(numbers))
        sums = np.zeros((len(many), len(model.langs)))
        for lang in range(len(model.langs)):
            sums[:, lang] = np.bincount(row, weights=scores[order, lang], minlength=len(many))
        if not model.langs:
            return structs(("lang_pred", "score"), ([UNKNOWN] * len(many), [0.0] * len(many)))
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        known = np.array(letters, dtype=bool)
        names = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
        return structs(("lang_pred", "score"), (pa.array(names, pa.string()), np.where(known, share, 0.0)))

    return struct_udf(run, "struct<lang_pred string, score double>")


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred and score, the share of the best language, to `docs`.

    NULL texts and texts without a letter are `und` with score 0, and so is every
    text if the model has learned nothing. Equal scores go to the smaller name.
    Columns of these names are replaced.
    """
    predict = _predictor(share(docs.sparkSession, model))
    return with_fields(docs, predict(text_of(text)), ("lang_pred", "score"))


def held_out(id_col: str = "doc_id"):
    return remainder_of_id(id_col, 4) == 2
