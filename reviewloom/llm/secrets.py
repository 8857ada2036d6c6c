"""Secret scan: wide candidates, and a random forest that removes false positives.

Candidates are runs of at least 16 key characters, and values of any length and
characters behind a secret's name and an assignment sign. The
forest sees what they look like and where they stand: length, shares of character
classes, transitions between classes, how much of them a dictionary covers, whether they
are part of a path or address, and the words before and behind. It learns from labelled
findings; `weak_labels` makes such labels where no reviewed ones exist, from formats
that are certain either way (issued key formats, values assigned to a secret's name; and,
not behind such a name, plain numbers, words, UUIDs, git hashes, data URIs). The forest does not see those formats, so
it carries over to findings without a label.

Everything runs as DataFrame and SQL functions and in the forest of Spark's own ML
library. The training sample is bounded by `SAMPLE_ROWS`; all candidates of all whole
texts are scored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.rows import text_of
from reviewloom.session import stored

SECRET_WORDS = (
    r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
)
#: A value behind a secret's name and a sign, whole to its closing quote, or to a blank but for closing marks.
NAMED_BEFORE = (
    r"(?<=[=:>]\s{0,2}[\"'(`]?)(?<=(?i:" + SECRET_WORDS + r"s?)[\"']?\s{0,2}(?::=|=>|=|:)\s{0,2}[\"'(`]?)"
)
CANDIDATE = (
    r"(?=[^\s\"'`(=>:])" + NAMED_BEFORE + r"(?:(?<=[\"'`])[^\"'`\n]++(?=[\"'`])|(?<![\"'`])[^\s\"'`]*[^\s\"'`.,;:)\]}])"
    r"|(?<![A-Za-z0-9+/_\-])(?=[+/_\-]*+[A-Za-z0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}(?![A-Za-z0-9])"
)
NEAR = 64
SAMPLE_ROWS = 20_000
DICTIONARY_WORDS = 1_000
TREES = 40
DEPTH = 6
SEED = 42
CUT = 0.5

SECRET_NAME = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
ASSIGNED = SECRET_NAME + r"[\"']?\s*(:=|=>|=|:|\s)\s*[\"'(]?$"
ISSUED = r"^(AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$"
PLAIN = r"^([0-9/_+\-]+=*|[A-Z]+[A-Z/_+\-]*|[A-Za-z]?[a-z]+([/_\-]+[A-Za-z]?[a-z]+)*)$"
UUID = r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"
GIT_HASH = r"^([0-9a-f]{40}|[0-9a-f]{64})$"
GIT_BEFORE = r"(?i)\b(commit|revision|rev|merge|tree|blob|parent|index|sha-?1|sha-?256|checksum|digest)[\"']?\s*[:=]?\s*[\"'(]?$"
DATA_URI = r"(?i)\bdata:[\w.+/;=\-]*base64,\s*$"

FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "other_share", "class_changes", "vowel_changes",
    "distinct_share", "hex_only", "dictionary_cover", "in_path", "quoted", "name_before", "sign_before", "words_before",
    "name_behind",
)


def _near_start(text: Column) -> Column:
    return F.substring(text, 1, NEAR)


def _near_end(text: Column) -> Column:
    return F.when(F.length(text) > NEAR, F.substring(text, -NEAR, NEAR)).otherwise(text)


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, value, before, behind): every candidate, in code points.

    `before` and `behind` are up to 64 characters around it. NULL and empty texts have none.
    """
    whole = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("_text"))
    found = whole.filter(F.col("_text").rlike(CANDIDATE)).select(
        "doc_id",
        F.split("_text", CANDIDATE, -1).alias("gaps"),
        F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)).alias("values"),
    )
    # Running lengths of gaps and values give the places without searching the text again.
    steps = F.transform("values", lambda v, i: F.length(F.get("gaps", i)) + F.length(v))
    ends = F.aggregate(
        steps,
        F.array().cast("array<int>"),
        lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x),
    )
    spot = F.transform(
        "values",
        lambda v, i: F.struct(
            (F.get("ends", i) - F.length(v)).cast("bigint").alias("start"),
            F.get("ends", i).cast("bigint").alias("end"),
            v.alias("value"),
            _near_end(F.get("gaps", i)).alias("before"),
            _near_start(F.get("gaps", i + 1)).alias("behind"),
        ),
    )
    guarded = F.when(F.size("values") > 0, ends).otherwise(F.array().cast("array<int>"))
    return found.withColumn("ends", guarded).select("doc_id", F.explode(spot).alias("c")).select("doc_id", "c.*")


def weak_labels(found: DataFrame) -> DataFrame:
    """Add `label`: 1 and 0 where a format is certain, NULL elsewhere."""
    value, before = F.col("value"), F.col("before")
    varied = (F.regexp_count(value, F.lit("[0-9]")) >= 4) & (F.regexp_count(value, F.lit("[A-Za-z]")) >= 4)
    secret = value.rlike(ISSUED) | (before.rlike(ASSIGNED) & varied)
    blob = value.rlike(UUID) | (value.rlike(GIT_HASH) & before.rlike(GIT_BEFORE)) | before.rlike(DATA_URI)
    plain = (blob | value.rlike(PLAIN)) & ~before.rlike(ASSIGNED)
    return found.withColumn("label", F.when(secret, 1.0).when(plain, 0.0))


def dictionary(found: DataFrame) -> list[str]:
    """The most frequent words around labelled candidates, at most DICTIONARY_WORDS."""
    words = F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "behind")), F.lit(r"\b[a-z]{4,}\b"), F.lit(0)))
    counts = found.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).collect()]


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    value, before, behind = F.col("value"), F.col("before"), F.col("behind")
    length = F.length(value)
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)) / length
    spelled = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    bare = F.regexp_replace(F.lower(value), spelled, "") if words else F.lower(value)
    sign = lambda pattern, where=before: where.rlike(pattern).cast("double")
    changes = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    vowels = r"(?<=[aeiouAEIOU])(?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])"
    made = {
        "length": length.cast("double"),
        "digit_share": count("[0-9]"),
        "upper_share": count("[A-Z]"),
        "lower_share": count("[a-z]"),
        "other_share": count("[^A-Za-z0-9]"),
        "class_changes": count(changes),
        "vowel_changes": count(vowels),
        "distinct_share": F.size(F.array_distinct(F.split(F.lower(value), ""))) / length,
        "hex_only": value.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "dictionary_cover": 1 - F.length(bare) / length,
        "in_path": (value.contains("/") | before.rlike(r"(/|://\S*)$") | behind.rlike(r"^[/.]\w")).cast("double"),
        "quoted": sign(r"[\"'`]$"),
        "name_before": sign(SECRET_NAME + r"\W{0,6}$"),
        "sign_before": sign(r"[=:]\s*[\"'`(]?$"),
        "words_before": sign(r"\p{L}{2,} \p{L}{2,}[.,]? $"),
        "name_behind": sign(SECRET_NAME, behind),
    }
    return found.select("*", *[c.cast("double").alias(f"_{n}") for n, c in made.items()])


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(forest, dictionary) from candidates with a label; no forest without both labels.

    The sample are the `sample_rows` rows with the smallest hashes, half of each label, so
    it is the same in every run.
    """
    rows = []
    for label in (0.0, 1.0):
        order = [F.xxhash64("doc_id", "start", "value"), F.col("doc_id"), F.col("start")]
        rows.append(labelled.filter(F.col("label") == label).orderBy(*order).limit(sample_rows // 2))
    sample = stored(rows[0].unionByName(rows[1]))
    words = dictionary(sample)
    if sample.select("label").distinct().count() < 2:
        return None, words
    vectors = _assembled(with_features(sample, words)).select("features", "label").coalesce(1)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return forest.fit(vectors), words


def _assembled(featured: DataFrame) -> DataFrame:
    assembler = VectorAssembler(inputCols=[f"_{n}" for n in FEATURES], outputCol="features")
    return assembler.transform(featured)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, length, sha256, label, probability, secret), one row per candidate.

    `labelled` are candidates with a `label`; without it, the documents' own candidates
    with certain formats teach. The value itself is not returned, only its hash.
    If there is nothing to learn from, every candidate that is not labelled 0 is a
    secret with a NULL probability. NULL and empty texts and empty tables give no rows,
    repeated rows repeat their findings, and other columns are ignored.
    """
    found = stored(weak_labels(candidates(docs, id_col, text)))
    forest, words = train(found.filter("label IS NOT NULL") if labelled is None else labelled)
    if forest is None:
        scored = found.withColumn("probability", F.lit(None).cast("double"))
    else:
        featured = _assembled(with_features(found, words))
        scored = forest.transform(featured).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    secret = F.coalesce(F.col("probability") >= CUT, F.coalesce(F.col("label"), F.lit(1.0)) == 1)
    return scored.select(
        "doc_id",
        "start",
        "end",
        F.length("value").cast("bigint").alias("length"),
        F.sha2("value", 256).alias("sha256"),
        F.col("label").cast("int").alias("label"),
        "probability",
        secret.alias("secret"),
    )
