"""Spelling variants by PartEnum signatures of letter multisets.

A word's letters, numbered among equal ones ("a0", "a1", "n0"), are a set: a binary
vector. One inserted or deleted letter changes one place of it, one replaced letter two,
so near words are at most two places apart. PartEnum deals the places over three
parts and enumerates the ways to leave out two of them: whichever two places differ, one of
the three signatures is equal in both words.

Letter sets alone would let all anagrams meet. One edit also leaves the first or the
last half of the letters as they are, counted by the longer word, so a signature
carries such a half and the length of the longer word. Signatures are joined by equality, and
every pair that meets is verified by its edit distance inside the join.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.rows import struct_udf, text_of, values
from reviewloom.operators.ranking import join_counted
from reviewloom.session import stored

MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10
EVERY = 31
PARTS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters, some with a letter taken out by the rule of the module's query."""
    lowered = F.translate(text_of(text), UPPER, LOWER)
    # Runs are maximal: shorter ones can't give a word and aren't looked at again.
    runs = F.regexp_extract_all(lowered, F.lit(f"[a-z\\u00C0-\\u00FF]{{{MIN_LETTERS},}}"), F.lit(0))
    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = named.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run"))
    kept = hashed.select(word.alias("word")).filter(F.char_length("word") >= MIN_LETTERS)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


def letter_parts(word: str, parts: int = PARTS) -> list[int]:
    """The word's letter set, cut into parts by a hash of the letter and its number; a hash for each part."""
    seen: dict[str, int] = defaultdict(int)
    out = [0] * parts
    for letter in word:
        place = xxhash.xxh64_intdigest(f"{letter}{seen[letter]}")
        seen[letter] += 1
        out[place % parts] ^= place >> 2  # the order of letters plays no part
    return out


def _letter_parts(words: pa.Array) -> pa.Array:
    return pa.array([letter_parts(w) for w in values(words)], pa.list_(pa.int64()))


def signatures(words: DataFrame) -> DataFrame:
    """(word, longer, signature): the word's signatures, for pairs whose longer word has `longer` letters."""
    parted = words.select("word", struct_udf(_letter_parts, "array<bigint>")("word").alias("parts"))
    size = F.char_length("word")
    sized = parted.select("word", "parts", F.explode(F.array(size, size + 1)).alias("longer"))
    half = F.floor(F.col("longer") / 2).cast("int")
    halves = [F.substring(F.col("word"), F.lit(1), half), F.right(F.col("word"), half)]
    keys = [
        F.xxhash64(F.lit(PARTS * side + part), F.col("parts")[part], "longer", equal)
        for side, equal in enumerate(halves)
        for part in range(PARTS)
    ]
    return sized.select("word", "longer", F.explode(F.array(*keys)).alias("signature"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct words that are one edit of a code point apart."""
    rows = signatures(words)
    left = rows.select("signature", "longer", F.col("word").alias("a"))
    right = rows.select("signature", "longer", F.col("word").alias("b"))
    lengths = F.greatest(F.char_length("a"), F.char_length("b")) == left["longer"]
    met = (left["signature"] == right["signature"]) & (left["longer"] == right["longer"])
    near = (F.col("a") < F.col("b")) & lengths & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, met & near).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links: the last word reached.

    Every step doubles the length of the links. Counts grow tenfold along a link,
    so chains are short and a handful of steps ends them all.
    """
    links = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reached = links.groupBy("root").agg(F.count(F.lit(1)).alias("_rows"))
        ahead = ahead.join(reached, "root")
        moved = join_counted(links, ahead, "root", "_rows", links.count(), spread="word", how="left")
        moved = stored(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root): one row per word seen at least twice.

    Words are maximal runs of letters, A-Z lowered, of at least seven code points. The
    form is the near word with the largest n, ties by code point order, if that is at
    least ten times the word's own n; the root is where the forms end. NULL texts have no
    words, a NULL id counts as an empty one in the rule that takes letters out, repeated
    rows count again, other columns are ignored, and an empty table gives no rows.
    """
    words = stored(word_counts(docs, id_col, text))
    pairs = stored(near_pairs(words.select("word")))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"))
    )
    # A word has no more near words than there are letters to put into its places.
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    found = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near_n = -F.col("best.less")
    is_form = near_n >= RATIO * F.col("n")
    formed = stored(
        words.join(found, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best.word")).alias("form"),
            F.when(is_form, near_n).alias("form_n"),
        )
    )
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


_BYTES = "list_transform(range(0, octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT)"


def sql(crc32: str) -> str:
    """The query as SQL; words that differ by one letter agree once it is taken out."""
    return f"""WITH runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
         '[a-zÀ-ÿ]{{{MIN_LETTERS},}}')) AS run FROM documents), named AS (
  SELECT run, concat(id, ':', run) AS s, count(*) AS c FROM runs GROUP BY ALL), hashed AS (
  SELECT run, c, {crc32.format(bytes=_BYTES)} AS h FROM named), words AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN concat(substr(run, 1, (h % length(run))::INT), substr(run, (h % length(run))::INT + 2)) ELSE run END AS word,
         sum(c)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= {MIN_LETTERS} AND sum(c) >= {MIN_COUNT}), cut AS (
  SELECT word, i, concat(substr(word, 1, (i - 1)::INT), substr(word, (i + 1)::INT)) AS rest
  FROM words, unnest(range(1, length(word) + 1)) u(i)), pairs AS (
  SELECT DISTINCT a.word AS word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
  UNION
  SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)), found AS (
  SELECT p.word, count(*) AS n_near, arg_min(w.word, (-w.n, w.word)) AS best, max(w.n) AS best_n
  FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * n THEN best END AS form,
         CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n FROM words w LEFT JOIN found USING (word)), chains AS (
  SELECT word, form AS at, 1 AS step FROM formed WHERE form IS NOT NULL
  UNION ALL
  SELECT c.word, f.form, c.step + 1 FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT word, form, coalesce((SELECT arg_max(c.at, c.step) FROM chains c WHERE c.word = formed.word), word) AS root, n, n_near, form_n
FROM formed""".replace("WITH runs", "WITH RECURSIVE runs", 1)
