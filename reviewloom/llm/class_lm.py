"""Language-model scores from a Brown class-based bigram model.

The class of every training word is found by exchange clustering: a word moves to the
class that raises the mutual information of neighbouring classes most.

1. The most frequent words (each at least 1 / `ELEMENTS` of all tokens, so there are at
   most `ELEMENTS`) move in rounds over their bigram table. The others only take part as
   groups by their last two bytes, whose classes are where the words of a group start.
   Half of the elements, in turns, may move in a round, because moves decided side by
   side can spoil each other. The best round is kept.
2. The other head words move, each by its own neighbours in all training texts: to the
   class under which the smoothed model gives the texts the most probability.
3. All words outside the head move likewise, the head words having their classes.

A word never seen has the class its group has after the first step.

P(word | previous) = P(class | previous class) * P(word | class): transitions are
smoothed with the class frequencies, emissions with a small count for every word of
the class and one unseen word.

Word counts and class bigrams cover all training texts. The head, at most `HEAD_WORDS`
of the most frequent words and the end, is broadcast (a vocabulary of at most
`SMALL_VOCABULARY` words as a whole); counts and classes of all other words are joined
by word. Which words are in the head decides who moves first, and nothing else.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.rows import bytes_of, loaded, remainder_of_id, share, struct_udf, structs, values
from reviewloom.session import stored

HEAD_WORDS = 131_072
SMALL_VOCABULARY = 65_536
ELEMENTS = 2_048
TAIL_GROUPS = 128
CLASSES = 48
ROUNDS = 6
BASE_COUNT = 0.1
EMISSION_COUNT = 0.1
TRANSITION_WEIGHT = 50.0
FLUSH_WORDS = 200_000
#: Texts that are split into words at a time.
TEXTS_AT_ONCE = 256
#: Words whose gains are computed at a time.
WORDS_AT_ONCE = 512
END = b"\n"  # no word holds white space


def tokens_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and one end."""
    return [*text.lower().split(), END]


def held_out(id_col: str = "doc_id") -> Column:
    return remainder_of_id(id_col, 10) == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.table({"word": pa.array(held, pa.binary()), "n": pa.array(held.values(), pa.int64())})
        held.clear()
        yield from table.to_batches(50_000)

    for batch in batches:
        for text in values(batch.column(0)):
            held.update(tokens_of(text))
            if len(held) > FLUSH_WORDS:
                yield from flush()
    yield from flush()


def _parts(texts: pa.Array) -> Iterator[list[bytes]]:
    for start in range(0, len(texts), TEXTS_AT_ONCE):
        yield texts.slice(start, TEXTS_AT_ONCE).to_pylist()


def _stream(texts: list[bytes]) -> list[bytes]:
    """Texts follow each other, each ending in END, which also begins the next one."""
    words = [END]
    for text in texts:
        words += tokens_of(text)
    return words


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of a one-column table of bytes, ends included."""
    return texts.mapInArrow(_count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _group(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL_GROUPS


class Vocabulary:
    """Counts of the head words and the element of every possible word."""

    def __init__(self, head: list[tuple[bytes, int]], n_elements: int) -> None:
        """`head` in order of falling counts, the first `n_elements` being elements."""
        self.number = {w: i for i, (w, _) in enumerate(head)}
        self.counts = np.array([n for _, n in head], dtype=np.int64)
        self.own = n_elements
        self.elements = n_elements + TAIL_GROUPS
        groups = [self.group(w) for w, _ in head[n_elements:]]
        self.element = np.array([*range(n_elements), *groups], dtype=np.int64)

    def group(self, word: bytes) -> int:
        return self.own + _group(word)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of head words or -1, elements) of a token list."""
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        element = self.element[number] if len(self.element) else np.zeros(len(words), dtype=np.int64)
        far = np.flatnonzero(number < 0)
        element[far] = [self.group(words[i]) for i in far.tolist()]
        return number, element


def _pair_counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = loaded(shared)
        size = vocabulary.elements
        table = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for texts in _parts(batch.column(0)):
                _, element = vocabulary.find(_stream(texts))
                np.add.at(table, element[:-1] * size + element[1:], 1)
        used = np.flatnonzero(table)
        rows = pa.table({"a": (used // size).astype(np.int32), "b": (used % size).astype(np.int32), "n": table[used]})
        yield from rows.to_batches(100_000)

    return run


def _information(matrix: np.ndarray) -> float:
    """What mutual information is up to a constant, in counts times nats."""
    part = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return part(matrix) - part(matrix.sum(axis=0)) - part(matrix.sum(axis=1))


def _proposer(matrix: np.ndarray, class_of: np.ndarray):
    """Best class of each element, given the others' classes as they are."""
    size = len(matrix)
    part = lambda x: x * np.log(np.maximum(x, 1))

    def best(element: int, right: np.ndarray, left: np.ndarray, self_count: int) -> tuple[int, float]:
        """right, left: counts with the classes that follow and precede the element."""
        home = class_of[element]
        out, into = right.copy(), left.copy()
        out[home] -= self_count
        into[home] -= self_count
        bare = matrix.copy()
        bare[home] -= out
        bare[:, home] -= into
        bare[home, home] -= self_count
        # Other rows and columns get the element's counts whatever its class is.
        rows, cols = bare.sum(axis=1) + into, bare.sum(axis=0) + out
        total_out, total_in = out.sum() + self_count, into.sum() + self_count
        # Joining class k changes row k, column k and their sums.
        gain = (part(bare + out[None, :]) - part(bare)).sum(axis=1)
        gain += (part(bare + into[:, None]) - part(bare)).sum(axis=0)
        d = bare.diagonal()
        both = part(d + out + into + self_count) - part(d + out) - part(d + into) + part(d)
        gain += both
        gain -= part(rows + total_out) - part(rows)
        gain -= part(cols + total_in) - part(cols)
        k = int(gain.argmax())
        return (k, float(gain[k] - gain[home])) if gain[k] > gain[home] + 1e-6 else (int(home), 0.0)

    def run(rows: pa.Table) -> pa.Table:
        element = rows["element"].to_numpy()
        after, cls, n = rows["after"].to_numpy(), rows["class"].to_numpy(), rows["n"].to_numpy()
        same = rows["self"].to_numpy()
        order = np.argsort(element, kind="stable")
        bounds = np.flatnonzero(np.append(True, np.diff(element[order]) > 0))
        found = []
        for low, high in zip(bounds, np.append(bounds[1:], len(order))):
            own = order[low:high]
            right = np.bincount(cls[own][after[own] == 1], weights=n[own][after[own] == 1], minlength=size)
            left = np.bincount(cls[own][after[own] == 0], weights=n[own][after[own] == 0], minlength=size)
            self_count = int(same[own][after[own] == 1].sum())
            e = int(element[own[0]])
            found.append((e, *best(e, right.astype(np.int64), left.astype(np.int64), self_count)))
        e, k, gain = zip(*found)
        return pa.table({"element": pa.array(e, pa.int32()), "to": pa.array(k, pa.int32()), "gain": list(gain)})

    return run


def exchange_classes(pairs: DataFrame, elements: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each element from its (a, b, n) bigrams.

    The driver holds one number per element and one per pair of classes. Rounds end
    early when nothing moves.
    """
    spark = pairs.sparkSession
    class_of = np.arange(elements) % classes
    best, best_value = class_of.copy(), -np.inf
    for turn in range(rounds + 1):
        table = spark.createDataFrame(
            pa.table({"element": np.arange(elements, dtype=np.int32), "class": class_of.astype(np.int32)})
        )
        named = lambda side, name: F.broadcast(table.select(F.col("element").alias(side), F.col("class").alias(name)))
        both = pairs.join(named("a", "ca"), "a").join(named("b", "cb"), "b")
        cells = both.groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect()
        matrix = np.zeros((classes, classes), dtype=np.int64)
        for r in cells:
            matrix[r["ca"], r["cb"]] = r["n"]
        value = _information(matrix)
        if value > best_value:
            best, best_value = class_of.copy(), value
        if turn == rounds:
            break
        same = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)
        sides = F.explode(
            F.array(
                F.struct(F.col("a").alias("element"), F.lit(1).alias("after"), F.col("cb").alias("class")),
                F.struct(F.col("b").alias("element"), F.lit(0).alias("after"), F.col("ca").alias("class")),
            )
        )
        contexts = both.select(sides.alias("s"), "n", same.alias("same")).select("s.*", "n", "same")
        contexts = contexts.filter(F.pmod(F.xxhash64("element"), F.lit(2)) == turn % 2)
        contexts = contexts.groupBy("element", "after", "class").agg(F.sum("n").alias("n"), F.sum("same").alias("self"))
        blocks = contexts.groupBy(F.pmod(F.xxhash64("element"), F.lit(64)).alias("block"))
        moves = blocks.applyInArrow(_proposer(matrix, class_of), "element int, to int, gain double").collect()
        for r in moves:
            class_of[r["element"]] = r["to"]
        if turn > 1 and not any(r["gain"] > 0 for r in moves):
            break
    return best


def _transitions(matrix: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """P(class | previous class) from class bigrams, smoothed with the class frequencies."""
    return (matrix + TRANSITION_WEIGHT * chance) / (matrix.sum(axis=1, keepdims=True) + TRANSITION_WEIGHT)


def _best_classes(matrix: np.ndarray, home: np.ndarray, out: np.ndarray, into: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Class of each of many words under which the model gives the texts the most probability.

    That probability and the mutual information of the classes differ by a constant.
    out, into: each word's counts with the classes that follow and precede it, without
    the `same` times that it follows itself. Transitions are the smoothed ones: without
    that all rare words would move at once to small classes, whose few bigrams look certain.
    """
    tokens = matrix.sum(axis=0)
    step = np.log(_transitions(matrix, (tokens + 1) / (tokens.sum() + len(matrix))))
    n = into.sum(axis=1) + same
    # Tokens of each class once the word is in it; it is in its home class so far.
    room = tokens + n[:, None]
    each = np.arange(len(home))
    room[each, home] -= n
    fit = into @ step + out @ step.T + same[:, None] * step.diagonal() - n[:, None] * np.log(np.maximum(room, 1))
    to = fit.argmax(axis=1)
    return np.where(fit[each, to] > fit[each, home] + 1e-6, to, home)


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches sorted by their first column, no key in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        cut = pc.index(key, key[-1]).as_py()
        if not cut and held and held[-1].column(0)[-1] == key[-1]:
            held.append(batch)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _head_contexts(shared, own: int, classes: int):
    """(number, counts) of the head words from `own` on: following and preceding classes, and itself."""
    width = 2 * classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, class_of = loaded(shared)
        table = np.zeros((len(vocabulary.counts) - own) * width, dtype=np.int32)
        for batch in batches:
            for texts in _parts(batch.column(0)):
                number, element = vocabulary.find(_stream(texts))
                cls = class_of[element]
                for moving, cells in ((number[:-1], cls[1:]), (number[1:], classes + cls[:-1])):
                    used = moving >= own
                    np.add.at(table, (moving[used] - own) * width + cells[used], 1)
                twice = number[:-1][(number[:-1] == number[1:]) & (number[1:] >= own)]
                np.add.at(table, (twice - own) * width + 2 * classes, 1)
        rows = table.reshape(-1, width)
        most = rows.max(axis=1, initial=0)
        for some, kind in ((np.flatnonzero((most > 0) & (most < 256)), np.uint8), (np.flatnonzero(most > 255), np.int32)):
            for start in range(0, len(some), 10_000):
                at = some[start : start + 10_000]
                counts = [r.tobytes() for r in rows[at].astype(kind)]
                yield pa.record_batch({"number": pa.array(at + own, pa.int32()), "counts": pa.array(counts, pa.binary())})

    return run


def _head_mover(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, class_of = loaded(shared)
        classes = len(matrix)
        for rows in _whole_keys(batches):
            numbers, word = np.unique(rows["number"].to_numpy(), return_inverse=True)
            counts = np.zeros((len(numbers), 2 * classes + 1), dtype=np.int64)
            packed = rows["counts"].to_pylist()
            for i, p in zip(word.tolist(), packed):
                counts[i] += np.frombuffer(p, np.uint8 if len(p) == counts.shape[1] else np.int32)
            for start in range(0, len(numbers), WORDS_AT_ONCE):
                at = numbers[start : start + WORDS_AT_ONCE]
                some, home = counts[start : start + WORDS_AT_ONCE], class_of[at]
                out, into, same = some[:, :classes].copy(), some[:, classes:-1].copy(), some[:, -1]
                out[np.arange(len(at)), home] -= same
                into[np.arange(len(at)), home] -= same
                to = _best_classes(matrix, home, out, into, same)
                yield pa.record_batch({"number": pa.array(at, pa.int32()), "to": pa.array(to, pa.int32())})

    return run


def _tail_contexts(shared, classes: int):
    """Rows of three kinds.

    word and code: an occurrence of a word outside the head; code tells the classes
    before and after it, above `classes` where the neighbour is outside the head as
    well, 2 * `classes` where it is the word itself.
    word and next: such a word followed by another one.
    code and n: class bigrams of all tokens, then those inside the head.
    """
    wide, square = 2 * classes + 1, classes * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, class_of = loaded(shared)
        cells = np.zeros(2 * square, dtype=np.int64)
        for batch in batches:
            for texts in _parts(batch.column(0)):
                words = _stream(texts)
                number, element = vocabulary.find(words)
                cls, far = class_of[element], number < 0
                pair = cls[:-1] * classes + cls[1:]
                cells[:square] += np.bincount(pair, minlength=square)
                cells[square:] += np.bincount(pair[~(far[:-1] | far[1:])], minlength=square)
                at = np.flatnonzero(far)  # the end is in the head, so each has two neighbours
                linked = at[far[at + 1]].tolist()
                twice = np.array([i for i in linked if words[i] == words[i + 1]], dtype=np.int64)
                near = np.where(far, classes + cls, cls)
                before, after = np.append(0, near[:-1]), np.append(near[1:], 0)
                after[twice] = before[twice + 1] = 2 * classes
                one, two = [words[i] for i in at.tolist()], [words[i] for i in linked]
                code = np.append(before[at] * wide + after[at], np.full(len(two), -1))
                yield pa.record_batch(
                    {
                        "word": pa.array(one + two, pa.binary()),
                        "next": pa.array([None] * len(one) + [words[i + 1] for i in linked], pa.binary()),
                        "code": pa.array(code, pa.int32()),
                        "n": np.ones(len(code), dtype=np.int64),
                    }
                )
        used = np.flatnonzero(cells)
        empty = pa.nulls(len(used), pa.binary())
        yield pa.record_batch({"word": empty, "next": empty, "code": pa.array(used, pa.int32()), "n": cells[used]})

    return run


def _tail_mover(shared):
    """(word, n, class) of the words outside the head; without a word, class bigrams with the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, groups = loaded(shared)
        classes = len(matrix)
        cells = np.zeros(classes * classes, dtype=np.int64)
        for rows in _whole_keys(batches):
            words = rows["word"].combine_chunks().dictionary_encode()
            word, words = words.indices.to_numpy(), words.dictionary
            before, after = np.divmod(rows["code"].to_numpy(), 2 * classes + 1)
            home = groups[[_group(w) for w in words.to_pylist()]]
            to = []
            bounds = np.append(np.searchsorted(word, np.arange(0, len(words), WORDS_AT_ONCE)), len(word))
            for low, high in zip(bounds[:-1], bounds[1:]):
                first = len(to) * WORDS_AT_ONCE
                homes = home[first : first + WORDS_AT_ONCE]
                size = len(homes) * classes

                def counted(side):
                    used = side[low:high] < 2 * classes
                    at = (word[low:high] - first)[used] * classes + side[low:high][used] % classes
                    return np.bincount(at, minlength=size).reshape(-1, classes)

                same = np.bincount((word[low:high] - first)[after[low:high] == 2 * classes], minlength=len(homes))
                to.append(_best_classes(matrix, homes, counted(after), counted(before), same))
            to = np.concatenate(to)
            placed = to[word]
            np.add.at(cells, (before * classes + placed)[before < classes], 1)
            np.add.at(cells, (placed * classes + after)[after < classes], 1)
            n = np.bincount(word, minlength=len(words))
            yield pa.record_batch({"word": words, "n": n, "class": pa.array(to, pa.int32())})
        used = np.flatnonzero(cells)
        yield pa.record_batch(
            {"word": pa.nulls(len(used), pa.binary()), "n": cells[used], "class": pa.array(used, pa.int32())}
        )

    return run


def _collected(cells: DataFrame, classes: int) -> np.ndarray:
    """Matrix of a (class, n) table whose classes are numbers of cells."""
    matrix = np.zeros(classes * classes, dtype=np.int64)
    for r in cells.groupBy("class").agg(F.sum("n").alias("n")).collect():
        matrix[r["class"]] = r["n"]
    return matrix.reshape(classes, classes)


def move_head(texts: DataFrame, vocabulary: Vocabulary, own: int, class_of: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Classes after every head word from `own` on has moved."""
    spark = texts.sparkSession
    contexts = texts.mapInArrow(
        _head_contexts(share(spark, (vocabulary, class_of)), own, len(matrix)), "number int, counts binary"
    )
    moves = (
        contexts.repartition("number")
        .sortWithinPartitions("number")
        .mapInArrow(_head_mover(share(spark, (matrix, class_of))), "number int, to int")
        .toArrow()
    )
    class_of = class_of.copy()
    class_of[moves["number"].to_numpy()] = moves["to"].to_numpy()
    return class_of


def move_tail(texts: DataFrame, vocabulary: Vocabulary, class_of: np.ndarray, classes: int = CLASSES) -> tuple[DataFrame, np.ndarray]:
    """(word, n, class) of the words outside the head, and the class bigrams of all tokens."""
    spark, square = texts.sparkSession, classes * classes
    rows = stored(
        texts.mapInArrow(
            _tail_contexts(share(spark, (vocabulary, class_of)), classes), "word binary, next binary, code int, n bigint"
        )
    )
    cells = rows.filter("word IS NULL").select(F.col("code").alias("class"), "n")
    matrix = _collected(cells.filter(F.col("class") < square), classes)
    moved = stored(
        rows.filter("word IS NOT NULL AND next IS NULL")
        .select("word", "code")
        .repartition("word")
        .sortWithinPartitions("word")
        .mapInArrow(_tail_mover(share(spark, (matrix, class_of[vocabulary.own :]))), "word binary, n bigint, class int")
    )
    tail = moved.filter("word IS NOT NULL")
    named = lambda word, name: tail.select(F.col("word").alias(word), F.col("class").alias(name))
    links = rows.filter("next IS NOT NULL").select("word", "next", "n")
    links = links.join(named("word", "a"), "word").join(named("next", "b"), "next")
    parts = [
        cells.filter(F.col("class") >= square).select((F.col("class") - square).alias("class"), "n"),
        moved.filter("word IS NULL").select("class", "n"),
        links.select((F.col("a") * classes + F.col("b")).alias("class"), "n"),
    ]
    return tail, sum(_collected(p, classes) for p in parts)


class ClassModel:
    """What the scoring of texts needs, of bounded size."""

    def __init__(self, vocabulary, class_of, matrix, class_tokens, class_words, tokens, words) -> None:
        self.vocabulary = vocabulary
        self.tokens, self.words = tokens, words
        self.class_of = class_of
        chance = (class_tokens + 1) / (class_tokens.sum() + len(class_tokens))
        self.step = np.log10(_transitions(matrix, chance))
        self.emission_total = np.log10(class_tokens + EMISSION_COUNT * (class_words + 1))
        self.base_total = float(np.log10(tokens + BASE_COUNT * (words + 1)))
        head = vocabulary.counts
        # The last place is that of words outside the head, which the scorer hands on.
        self.base = np.append(np.log10(head + BASE_COUNT) - self.base_total, 0.0)
        emission = np.log10(head + EMISSION_COUNT) - self.emission_total[class_of[vocabulary.element]]
        self.emission = np.append(emission, 0.0)


SCORED = (
    "n_tokens bigint, known bigint, base double, score double, "
    "tail array<struct<word: binary, before: int, after: int, unseen: int>>, "
    "links array<struct<word: binary, next: binary, unseen: int, next_unseen: int>>"
)


def _scorer(shared):
    """Scores of head words and their transitions; what involves other words is handed on.

    Those come with the classes of their neighbours in the head (-1: outside), and with
    the class they have if they were never seen.
    """

    def score(model: ClassModel, texts: list[bytes]) -> pa.StructArray:
        tokens = [tokens_of(text) for text in texts]
        words = [END, *chain.from_iterable(tokens)]
        number, element = model.vocabulary.find(words)
        cls, far = model.class_of[element], number < 0
        # Position i of the arrays below is the token words[i + 1].
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(sizes) - sizes
        total = lambda x: np.add.reduceat(x, starts)
        outside = far[:-1] | far[1:]
        step = np.where(outside, 0.0, model.step[cls[:-1], cls[1:]])
        near = np.append(np.where(far, -1, cls), -1)
        at, linked = np.flatnonzero(far[1:]) + 1, np.flatnonzero(far[:-1] & far[1:]) + 1
        named = lambda where: pa.array([words[i] for i in where.tolist()], pa.binary())

        def lists(where: np.ndarray, names: str, columns: list) -> pa.ListArray:
            columns = [c if isinstance(c, pa.Array) else pa.array(c, pa.int32()) for c in columns]
            offsets = pa.array(np.searchsorted(where - 1, np.append(starts, len(words))), pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names.split()))

        return structs(
            ("n_tokens", "known", "base", "score", "tail", "links"),
            (
                sizes,
                total((~far[1:]).astype(np.int64)),
                total(model.base[number[1:]]),
                total(step + model.emission[number[1:]]),
                lists(at, "word before after unseen", [named(at), near[at - 1], near[at + 1], cls[at]]),
                lists(linked, "word next unseen next_unseen", [named(linked - 1), named(linked), cls[linked - 1], cls[linked]]),
            ),
        )

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([score(loaded(shared), part) for part in _parts(texts)])

    return struct_udf(run, f"struct<{SCORED}>")


def _head(counts: DataFrame, tokens: int, words: int) -> DataFrame:
    """At most HEAD_WORDS of the most frequent words, and the end; all words of a small vocabulary."""
    if words <= SMALL_VOCABULARY:
        return counts
    # The least power of two whose share of all tokens the word reaches.
    rank = F.ceil(F.log2(F.lit(tokens) / F.col("n")))
    last, held = -1, 0
    for r in sorted(counts.groupBy(rank.alias("rank")).count().collect()):
        held += r["count"]
        if held > HEAD_WORDS:
            break
        last = r["rank"]
    return counts.filter((rank <= last) | (F.col("word") == F.lit(END)))


def train(texts: DataFrame) -> tuple[ClassModel, DataFrame]:
    """Model of a one-column table of bytes, and the (word, n, class, held) table of all its words.

    held: in the head, which the model holds.
    """
    spark = texts.sparkSession
    counts = stored(word_counts(texts))
    row = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, words = row[0] or 0, row[1]
    head_rows = _head(counts, tokens, words).orderBy(F.desc("n"), "word").toArrow()
    head = list(zip(head_rows["word"].to_pylist(), head_rows["n"].to_pylist()))
    own = sum(n * ELEMENTS >= tokens for _, n in head)
    start = Vocabulary(head, own)
    pairs = texts.mapInArrow(_pair_counter(share(spark, start)), "a int, b int, n bigint")
    pairs = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")))
    class_of = exchange_classes(pairs, start.elements)
    # One row per pair of elements at most meets the driver as one per pair of classes.
    table = spark.createDataFrame(
        pa.table({"element": np.arange(start.elements, dtype=np.int32), "class": class_of.astype(np.int32)})
    )
    left = F.broadcast(table.select(F.col("element").alias("a"), F.col("class").alias("ca")))
    right = F.broadcast(table.select(F.col("element").alias("b"), F.col("class").alias("cb")))
    both = pairs.join(left, "a").join(right, "b")
    matrix = _collected(both.select((F.col("ca") * CLASSES + F.col("cb")).alias("class"), "n"), CLASSES)
    # From here on every head word is an element.
    vocabulary = Vocabulary(head, len(head))
    class_of = np.append(class_of[start.element], class_of[own:]).astype(np.int64)
    if own < len(head):
        class_of = move_head(texts, vocabulary, own, class_of, matrix)
    tail, matrix = move_tail(texts, vocabulary, class_of)
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(class_tokens, class_of[: len(head)], vocabulary.counts)
    np.add.at(class_words, class_of[: len(head)], 1)
    for r in tail.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        class_tokens[r["class"]] += r["n"]
        class_words[r["class"]] += r["words"]
    model = ClassModel(vocabulary, class_of, matrix, class_tokens, class_words, tokens, words)
    named = pa.table(
        {
            "word": head_rows["word"].cast(pa.binary()),
            "n": vocabulary.counts,
            "class": pa.array(class_of[: len(head)], pa.int32()),
        }
    )
    held = spark.createDataFrame(named).withColumn("held", F.lit(True))
    return model, held.unionByName(tail.withColumn("held", F.lit(False)))


def score_texts(docs: DataFrame, model: ClassModel, counts: DataFrame, text: str = "text") -> DataFrame:
    """Replace `text` by n_tokens, n_known, base_score and score, log10 probabilities.

    `counts` is the table the model was trained with. NULL and empty texts are one
    end. Rows are told apart by a number of their own, so repeated ids are no
    matter; other columns stay, those named like a result are replaced.
    """
    result = _scorer(share(docs.sparkSession, model))(bytes_of(text))
    partial = stored(
        docs.withColumn("_scored", result).drop(text).withColumn("_row", F.monotonically_increasing_id())
    )
    handed = lambda name: partial.select("_row", F.explode(f"_scored.{name}").alias("t")).select("_row", "t.*")
    known = counts.filter(~F.col("held")).select("word", "n", "class")
    classes = len(model.step)
    steps, totals = F.lit(model.step.ravel()), F.lit(model.emission_total)
    step = lambda a, b: F.get(steps, a * classes + b)
    n, cls = F.coalesce(F.col("n"), F.lit(0)), F.coalesce(F.col("class"), F.col("unseen"))
    before = F.when(F.col("before") >= 0, step(F.col("before"), cls)).otherwise(0.0)
    after = F.when(F.col("after") >= 0, step(cls, F.col("after"))).otherwise(0.0)
    words = handed("tail").join(known, "word", "left").select(
        "_row",
        F.when(n > 0, 1).otherwise(0).cast("bigint").alias("known"),
        (F.log10(n + BASE_COUNT) - model.base_total).alias("base"),
        (F.log10(n + EMISSION_COUNT) - F.get(totals, cls) + before + after).alias("score"),
    )
    following = known.select(F.col("word").alias("next"), F.col("class").alias("next_class"))
    links = handed("links").join(known.drop("n"), "word", "left").join(following, "next", "left")
    links = links.select(
        "_row",
        F.lit(0).cast("bigint").alias("known"),
        F.lit(0.0).alias("base"),
        step(cls, F.coalesce(F.col("next_class"), F.col("next_unseen"))).alias("score"),
    )
    added = (
        words.unionByName(links)
        .groupBy("_row")
        .agg(F.sum("known").alias("_known"), F.sum("base").alias("_base"), F.sum("score").alias("_score"))
    )
    plus = lambda own, more: F.col(f"_scored.{own}") + F.coalesce(F.col(more), F.lit(0))
    return partial.join(added, "_row", "left").withColumns(
        {
            "n_tokens": F.col("_scored.n_tokens"),
            "n_known": plus("known", "_known"),
            "base_score": plus("base", "_base"),
            "score": plus("score", "_score"),
        }
    ).drop("_scored", "_row", "_known", "_base", "_score")
