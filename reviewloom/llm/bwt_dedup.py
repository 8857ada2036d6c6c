"""Repeated passages by merging the Burrows-Wheeler transforms of shards.

A byte goes if a 100-byte string that covers it also starts earlier. Four steps:

1. Anchors. Every 100-byte window names one 32-byte gram of its own, the one with the least
   hash. Equal windows name equal grams at the same place, so a window whose gram
   is named nowhere else is unique. Only windows of repeated grams go on.
2. Segments. The windows that name the same gram form a segment: at most 168 bytes.
   Equal segments fold into the earliest one; all later ones go as a whole.
3. Merge. The different segments of a gram lie side by side, aligned at it, and are dealt
   to shards. A shard knows its suffixes in sorted order at each place and the byte
   before each of them: its transform. Shards are merged by refining their interleave: one
   stable counting pass over the merged column of preceding bytes moves all suffixes one place to
   the left, and the common prefixes of neighbours follow from those of the pass before. No
   suffix of the merged table is sorted anew. Neighbours with a common prefix of 100
   bytes are a repeated interval; its earliest window stays, the others go.
4. Bytes. The removed windows of a document are united and its rest is hashed.

Grams with very many different segments are not merged in one task: their windows are
grouped by hash one by one, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.rows import bytes_of, loaded, share, struct_udf, structs, values, with_fields
from reviewloom.session import stored

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1  # grams in a window, and the most windows a gram can be named by
PIECE = 1 << 22
#: Bits of the filter that spares the exact join of repeated grams: 16 MB at any size of the corpus.
FILTER_BITS = 27
#: Grams with more different segments are grouped window by window.
MERGED_SEGMENTS = 50_000
SHARDS = 4
#: Rows per document are broadcast up to so many bytes and joined beyond.
BROADCAST_BYTES = 32 << 20
NO_ID = 2**63 - 1
#: Windows of a segment as bits of two numbers.
LOW = 60
BASE, BACK = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Windows:
    """The named grams of a few texts, in the order of texts and places.

    Arrays with a value per named gram: `text` (its number), `start` and `count` (first
    window in the text and number of windows), `left` (bytes from there to the gram), `gram`
    and `content` (hashes of the gram and of the segment).
    """

    def __init__(self, texts: list[bytes], with_content: bool) -> None:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        per_text = np.maximum(sizes - LENGTH + 1, 0)
        text = np.repeat(np.arange(len(texts)), per_text)
        first = np.concatenate([[0], np.cumsum(per_text)[:-1]]) if len(texts) else sizes
        at = np.arange(len(text)) - np.repeat(first, per_text) + np.repeat(ends - sizes, per_text)
        if not len(at):
            self.text = self.start = self.count = self.left = np.zeros(0, np.int64)
            self.gram = self.content = np.zeros(0, np.uint64)
            return
        grams = BYTE_VALUES[data]
        width, base = 1, BASE
        while width < GRAM:
            grams = grams[:-width] * np.uint64(base) + grams[width:]
            width, base = 2 * width, base * base % (1 << 64)
        grams = _mixed(grams)
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width < SPAN:  # least gram of each window, the first of equal ones
            step = min(width, SPAN - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        named = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
        start = at[new]
        self.text = text[new]
        self.count = np.diff(np.concatenate([new, [len(at)]]))
        self.left = named[new] - start
        self.gram = grams[named[new]]
        self.start = start - (ends - sizes)[self.text]
        if with_content:
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(BYTE_VALUES[data] * _powers(BASE, len(data)), out=sums[1:])
            inside = (sums[start + self.count + LENGTH - 1] - sums[start]) * _powers(BACK, len(data))[start]
            self.content = _mixed(inside + self.left.astype(np.uint64) * np.uint64(BASE))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) a few megabytes at a time; a text is never cut."""
    first, held, size = 0, [], 0
    for i, text in enumerate(values(texts)):
        held.append(text or b"")
        size += len(held[-1])
        if size >= PIECE:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram) of all grams that are named more than once in the column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, held in _pieces(batch.column(0)):
                grams, n = np.unique(Windows(held, False).gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

    counted = texts.select("text").mapInArrow(run, "gram bigint, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram")


def gram_filter(spark: SparkSession, grams: DataFrame):
    """Broadcast bits of the grams: a fixed size; a fuller one passes more, and the join that follows is exact."""
    place = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    word, bit = F.shiftrightunsigned(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    words = grams.groupBy(word.cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
    found = words.toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return share(spark, bits.view(np.uint64))


OCCURRENCES = "doc bigint, own bigint, gram bigint, content bigint, start int, shape int"


def occurrences(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row for each place where a repeated gram is named: its segment in the text.

    `shape` holds the number of windows and the bytes before the gram.
    """
    known = gram_filter(texts.sparkSession, repeated)
    schema = pa.schema(
        [("doc", pa.int64()), ("own", pa.int64()), ("gram", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("shape", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = loaded(known)
        for batch in batches:
            doc, own = batch.column("doc").to_numpy(), batch.column("own").to_numpy()
            for first, held in _pieces(batch.column("text")):
                w = Windows(held, True)
                place = w.gram >> np.uint64(64 - FILTER_BITS)
                on = np.flatnonzero((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
                row = w.text[on] + first
                columns = [doc[row], own[row], w.gram[on].view(np.int64), w.content[on].view(np.int64), w.start[on], w.count[on] * 128 + w.left[on]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, schema)], schema=schema)

    found = texts.select("doc", "own", "text").mapInArrow(run, OCCURRENCES)
    return found.join(repeated, "gram", "left_semi")


def _by_document(texts: DataFrame, rows: DataFrame, size: str, how: str) -> DataFrame:
    """Join rows that are unique in (doc, own): broadcast if their measured size allows, else by shuffle."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length(size) + 32), F.lit(0))).first()[0]
    return texts.join(F.broadcast(rows) if total <= BROADCAST_BYTES else rows, ["doc", "own"], how)


def segment_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, content, doc, start, shape, bytes) of the segments at (doc, own, start)."""
    packed = struct_udf(lambda starts: pa.array([np.array(s, "<i4").tobytes() for s in values(starts)], pa.binary()), "binary")
    lists = stored(wanted.groupBy("doc", "own").agg(F.collect_list("start").alias("s")).select("doc", "own", packed("s").alias("starts")))
    schema = pa.schema(
        [("gram", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("shape", pa.int32()), ("bytes", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, starts = batch.column("doc").to_numpy(), batch.column("starts")
            for first, held in _pieces(batch.column("text")):
                w = Windows(held, True)
                asked = [np.frombuffer(s, "<i4") for s in values(starts.slice(first, len(held)))]
                places = np.concatenate([a.astype(np.int64) + (i << 40) for i, a in enumerate(asked)])
                on = np.flatnonzero(np.isin((w.text << 40) + w.start, places))
                cut = [held[t][s : s + n + LENGTH - 1] for t, s, n in zip(w.text[on], w.start[on], w.count[on])]
                columns = [w.gram[on].view(np.int64), w.content[on].view(np.int64), doc[w.text[on] + first], w.start[on], w.count[on] * 128 + w.left[on]]
                arrays = [pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, schema)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(cut, pa.binary())], schema=schema)

    return _by_document(texts, lists, "starts", "inner").select("doc", "text", "starts").mapInArrow(
        run, "gram bigint, content bigint, doc bigint, start int, shape int, bytes binary"
    )


# -- shards and their merge ------------------------------------------------


class Shard:
    """Segments aligned at their grams, and their transform: place by place from the right.

    `rows` are the numbers of the shard's segments in the table of symbols. After
    step(p), `order` lists them by the text that starts at place p.
    """

    def __init__(self, symbols: np.ndarray, rows: np.ndarray) -> None:
        self.symbols, self.order = symbols, rows

    def column(self, place: int) -> np.ndarray:
        """The symbols at `place`, before the sorted suffixes that start behind it."""
        return self.symbols[self.order, place]

    def step(self, place: int) -> None:
        self.order = self.order[np.argsort(self.column(place), kind="stable")]


def refine(interleave: np.ndarray, common: np.ndarray, shards: list[Shard], place: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave one place further to the left, and the common prefixes of neighbours.

    `interleave` says for each suffix of the merged order which shard it comes from; a
    shard's own suffixes keep their order, so its column is read from front to back.
    `common[i]` is the common prefix of the merged suffixes i - 1 and i.
    """
    merged = np.empty(len(interleave), dtype=np.uint16)
    for number, shard in enumerate(shards):
        merged[interleave == number] = shard.column(place)
        shard.step(place)
    moved = np.argsort(merged, kind="stable")
    symbol = merged[moved]
    # Between two suffixes with the same new first symbol lie the old neighbours from one to the other.
    ranges = np.stack([moved[:-1] + 1, moved[1:] + 1], axis=1).ravel()
    lowest = np.minimum.reduceat(np.append(common, np.int16(0)), ranges)[::2] if len(moved) > 1 else common[:0]
    alike = (symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)
    longer = np.zeros_like(common)
    longer[1:] = np.where(alike, np.minimum(lowest, LENGTH) + 1, 0)
    return interleave[moved], longer


def later_windows(segments: list[bytes], left: np.ndarray, doc: np.ndarray, start: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """Boolean table (segment, window): the window's bytes also start at an earlier place."""
    n, before = len(segments), SPAN - 1
    places = before + LENGTH
    symbols = np.zeros((n, places), dtype=np.uint16)  # 0: no byte here
    for i, (segment, l) in enumerate(zip(segments, left)):
        symbols[i, before - l : before - l + len(segment)] = np.frombuffer(segment, np.uint8)
    for i, (segment, l) in enumerate(zip(segments, left)):
        symbols[i, before - l : before - l + len(segment)] += 1
    dealt = np.arange(n) * shards // max(n, 1)
    parts = [Shard(symbols, np.flatnonzero(dealt == s)) for s in range(shards)]
    interleave, common = dealt, np.zeros(n, dtype=np.int16)
    later = np.zeros((n, SPAN), dtype=bool)
    for place in range(places - 1, -1, -1):
        interleave, common = refine(interleave, common, parts, place)
        if place > before:
            continue
        inside = common >= LENGTH
        if not inside.any():
            continue
        order = np.empty(n, dtype=np.int64)
        for number, part in enumerate(parts):
            order[interleave == number] = part.order
        # Members of repeated intervals: suffixes that agree with a neighbour on all 100 bytes.
        member = inside | np.append(inside[1:], False)
        rows, new = order[member], ~inside[member]
        window = place - (before - left[rows])
        begins, docs = start[rows] + window, doc[rows]
        heads = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        least_doc = np.minimum.reduceat(docs, heads)[which]
        own_start = np.where(docs == least_doc, begins, np.iinfo(np.int64).max)
        least_start = np.minimum.reduceat(own_start, heads)[which]
        later[rows, window] = (docs > least_doc) | (begins > least_start)
    return later


def _bits(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights = np.int64(1) << np.arange(LOW, dtype=np.int64)
    return flags[:, :LOW] @ weights, flags[:, LOW:] @ weights[: flags.shape[1] - LOW]


def merge_shards(segments: DataFrame) -> DataFrame:
    """(gram, content, low, high): bits of the windows of each segment that also start earlier."""
    schema = pa.schema([("gram", pa.int64()), ("content", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole grams, from rows sorted by gram."""
        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            rest.append(batch)
            held += batch.num_rows
            if held < MERGED_SEGMENTS // 2:
                continue
            rows = pa.Table.from_batches(rest)
            gram = rows["gram"].to_numpy()
            changes = np.flatnonzero(gram[1:] != gram[:-1])
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield rows.slice(0, cut)
            rest = rows.slice(cut).combine_chunks().to_batches()
            held = len(gram) - cut
        if held:
            yield pa.Table.from_batches(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tables(batches):
            doc, start = rows["doc"].to_numpy(), rows["start"].to_numpy().astype(np.int64)
            left = rows["shape"].to_numpy().astype(np.int64) % 128
            later = later_windows(rows["bytes"].to_pylist(), left, doc, start)
            low, high = _bits(later)
            columns = [rows["gram"].to_numpy(), rows["content"].to_numpy(), low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    dealt = segments.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "gram bigint, content bigint, low bigint, high bigint")


def group_windows(segments: DataFrame) -> DataFrame:
    """The same as merge_shards for any number of segments: windows grouped one by one."""
    window = F.explode(F.sequence(F.lit(0), F.floor(F.col("shape") / 128).cast("int") - 1))
    cut = segments.withColumn("window", window).select(
        "gram", "content", "doc", "window", (F.col("start") + F.col("window")).alias("begin"),
        F.sha2(F.substring(F.col("bytes"), F.col("window") + 1, F.lit(LENGTH)), 256).alias("print"),
    )
    cut = stored(cut)
    first = cut.groupBy("print").agg(F.min(F.struct("doc", "begin")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = cut.join(first.drop("n"), "print").filter(F.struct("doc", "begin") > F.col("first"))
    one = F.lit(1).cast("bigint")
    low = F.when(F.col("window") < LOW, F.call_function("shiftleft", one, "window")).otherwise(F.lit(0))
    high = F.when(F.col("window") >= LOW, F.call_function("shiftleft", one, F.col("window") - LOW)).otherwise(F.lit(0))
    return later.groupBy("gram", "content").agg(F.bit_or(low).alias("low"), F.bit_or(high).alias("high"))


# -- documents ---------------------------------------------------------------


def _united(entries: list[dict]) -> bytes:
    """Byte ranges of a document's later windows, merged, as pairs of numbers."""
    spans = []
    for e in entries:
        if e["low"] is None:
            spans.append((e["start"], e["start"] + e["shape"] // 128 + LENGTH - 1))
        else:
            bits = e["low"] | e["high"] << LOW
            spans += [(e["start"] + k, e["start"] + k + LENGTH) for k in range(SPAN) if bits >> k & 1]
    merged: list[list[int]] = []
    for begin, end in sorted(spans):
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([begin, end])
    return np.array(merged, "<i4").tobytes()


def repeated_spans(texts: DataFrame, merged_segments: int = MERGED_SEGMENTS) -> DataFrame:
    """(doc, own, spans): byte ranges to remove, as binary pairs of 32-bit numbers.

    `texts` has `doc` (order of documents), `own` (tells rows with one `doc` apart) and
    `text` (bytes). Documents without a repeat have no row.
    """
    repeated = stored(gram_counts(texts))
    found = stored(occurrences(texts, repeated))
    earliest = F.min(F.struct("doc", "start", "own", "shape")).alias("first")
    folded = stored(found.groupBy("gram", "content").agg(earliest).select("gram", "content", "first.*"))
    sizes = folded.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    several = stored(folded.join(sizes, "gram"))
    segments = stored(segment_texts(texts, several.select("doc", "own", "start")))
    few = several.filter(F.col("kinds") <= merged_segments).select("gram").distinct()
    merged = merge_shards(segments.join(few, "gram", "left_semi"))
    many = several.filter(F.col("kinds") > merged_segments).select("gram", "content")
    if not many.isEmpty():
        merged = merged.unionByName(group_windows(segments.join(many, ["gram", "content"], "left_semi")))
    bits = merged.filter("low <> 0 OR high <> 0")
    known = folded.select("gram", "content", F.col("doc").alias("_doc"), F.col("start").alias("_start"))
    known = stored(known.join(bits, ["gram", "content"], "left"))
    joined = found.join(known, ["gram", "content"])
    after = F.struct("doc", "start") > F.struct("_doc", "_start")
    gone = joined.filter(after | F.col("low").isNotNull()).select(
        "doc", "own", "start", "shape", F.when(~after, F.col("low")).alias("low"), F.when(~after, F.col("high")).alias("high")
    )
    # A document's entries are as many as its own segments; repeated rows give equal entries.
    listed = gone.groupBy("doc", "own").agg(F.collect_set(F.struct("start", "shape", "low", "high")).alias("entries"))
    united = struct_udf(lambda e: pa.array([_united(x) for x in values(e)], pa.binary()), "binary")
    return stored(listed.select("doc", "own", united("entries").alias("spans")))


RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _kept(text: bytes, spans: bytes | None) -> bytes:
    if not spans:
        return text
    pairs, at, out = np.frombuffer(spans, "<i4").reshape(-1, 2).tolist(), 0, []
    for begin, end in pairs:
        out.append(text[at:begin])
        at = end
    return b"".join([*out, text[at:]])


def _digests(texts: pa.Array, spans: pa.Array) -> pa.Array:
    sizes, removed, counts, digests = [], [], [], []
    for text, own in zip(values(texts), values(spans)):
        rest = _kept(text or b"", own)
        sizes.append(len(text or b""))
        removed.append(sizes[-1] - len(rest))
        counts.append(len(own or b"") // 8)
        digests.append(hashlib.sha256(rest).hexdigest())
    return structs(RESULT, [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())])


def _with_spans(docs: DataFrame, id_col: str, text: str, merged_segments: int) -> DataFrame:
    doc, raw = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("doc"), bytes_of(f"`{text}`")
    texts = docs.select(doc, F.xxhash64(raw).alias("own"), raw.alias("text"))
    spans = repeated_spans(texts, merged_segments)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return _by_document(docs.select(row, doc, F.xxhash64(raw).alias("own")), spans, "spans", "left")


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", merged_segments: int = MERGED_SEGMENTS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of `docs`.

    A byte is removed if a 100-byte string that covers it also starts earlier: in a
    document with a smaller id, or further ahead in the same one. Rows without an
    id come last and count as one document, as do rows that share an id: of equal places
    none is earlier, so equal rows are cut alike. NULL texts are empty, texts under
    100 bytes stay as they are, and an empty table gives no rows.
    """
    marked = _with_spans(docs.select(id_col, text), id_col, text, merged_segments)
    result = struct_udf(_digests, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    shown = marked.select(F.col(f"_row.`{id_col}`").alias(id_col), bytes_of(f"_row.{text}").alias("_text"), "spans")
    return with_fields(shown, result("_text", "spans"), RESULT).drop("_text", "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", merged_segments: int = MERGED_SEGMENTS) -> DataFrame:
    """`docs` with repeated passages taken out of their texts; bytes of a cut character that stay are replaced."""
    marked = _with_spans(docs, id_col, text, merged_segments)
    cut = struct_udf(
        lambda texts, spans: pa.array([None if t is None else _kept(t, s).decode("utf-8", "replace") for t, s in zip(values(texts), values(spans))], pa.string()),
        "string",
    )
    rest = cut(F.col(f"_row.`{text}`").cast("string").cast("binary"), F.col("spans"))
    return marked.select(F.col("_row").withField(f"`{text}`", rest).alias("_row")).select("_row.*")


SQL = f"""WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents), starts AS (
  SELECT doc_id, n, hx, unnest(range(0, n - {LENGTH} + 1, 256)) AS begin_ FROM docs WHERE n >= {LENGTH}), pieces AS (
  SELECT doc_id, n, begin_, substr(hx, 2 * begin_::INT + 1, {2 * (255 + LENGTH)}) AS px FROM starts), places AS (
  SELECT doc_id, begin_, px, unnest(range(0, least(256, n - {LENGTH} + 1 - begin_))) AS off FROM pieces), cut AS (
  SELECT doc_id, begin_ + off AS pos, md5_number(substr(px, 2 * off::INT + 1, {2 * LENGTH})) AS print FROM places), firsts AS (
  SELECT print, min(doc_id) AS doc_id, count(*) AS c FROM cut GROUP BY print HAVING count(*) > 1), first_at AS (
  SELECT cut.print, f.doc_id, min(pos) AS pos FROM cut JOIN firsts f ON f.print = cut.print AND f.doc_id = cut.doc_id GROUP BY ALL), later AS (
  SELECT cut.doc_id, cut.pos FROM cut JOIN first_at f USING (print) WHERE cut.doc_id > f.doc_id OR cut.pos > f.pos), islands AS (
  SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (
    SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM later)), spans AS (
  SELECT doc_id, min(pos) AS b, max(pos) + {LENGTH} AS e FROM islands GROUP BY doc_id, island), kept AS (
  SELECT doc_id, b, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS after, e,
         lead(b) OVER (PARTITION BY doc_id ORDER BY b) IS NULL AS is_last FROM spans), rest AS (
  SELECT k.doc_id, count(*) AS n_spans, sum(e - b)::BIGINT AS n_removed,
         string_agg(substr(hx, 2 * after::INT + 1, 2 * (b - after)::INT), '' ORDER BY b) AS front, max(e) AS e
  FROM kept k JOIN docs USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN e IS NULL THEN hx ELSE concat(front, substr(hx, 2 * e::INT + 1)) END)) AS kept_sha256
FROM docs LEFT JOIN rest USING (doc_id)"""
