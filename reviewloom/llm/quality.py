"""Quality rules whose thresholds adapt to the language and source of a text.

Every text gets whole-number metrics. For each metric and each group (language and
source, language alone, everything) a quantile sketch is kept: counts of log-linear
buckets, exact below 64 and within 1/32 above. Sketches of parts of the data merge
by adding counts, so they are made by one combining aggregation, and the sketch of
a language is the sum of its sources' sketches. Only texts that pass the base rules with
at least one word feed the sketches.

The sketch of a language is merged with the one of everything, scaled to `PRIOR` texts, and
that of a source with the one of its language, scaled likewise. So a small group is judged
mostly by the wider one and a large one by itself, without a size at which this changes. Only word lengths are
not merged across languages. The merged sketches give each group a median and the distances of both quartiles
for each metric, and the median number of words and lines.

A share (of symbols, repeated lines, words said twice in a row) fails above its median + `REACH` times the
distance of the upper quartile. That distance holds for a text of median size: a shorter one strays more, by the
root of the ratio of sizes. To this comes what a group's sketch cannot see: the rate at which
three quarters of the texts of median size show nothing (`UNSEEN` events a text), and `REACH` single events,
for texts above the median size as many times more as the root of the ratio. The word length fails outside of
its median +- `REACH` times the distance of the quartile on that side, which is at least one bucket of the sketch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from reviewloom.llm.rows import bytes_of, struct_udf, structs, values, with_fields
from reviewloom.session import stored

MIN_WORDS = 20
WINDOW = 8
#: Texts that the wider group's sketch counts for.
PRIOR = 50
REACH = 8.0  # quartile distances: over five standard deviations of normally spread texts
UNSEEN = 0.29  # -ln(3/4)
#: Metric -> the size of a text that it is a share of.
METRICS = {"word_length": "n_words", "symbol_share": "n_words", "dup_line_share": "n_lines", "stutter_share": "n_words"}
SIZES = ("n_words", "n_lines")
TWO_SIDED = ("word_length",)
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    rank = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if len(numbers) == n:
        return 0
    span = 1
    while span < window:  # ranks of runs of twice the length, equal only for equal runs
        joined = rank[:-span] * (int(rank.max()) + 1) + rank[span:]
        rank = np.unique(joined, return_inverse=True)[1]
        span *= 2
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edges = np.zeros(n + 1, dtype=np.int64)
    edges[again] += 1
    np.subtract.at(edges, again + window, 1)
    return int((np.cumsum(edges) > 0).sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    chars = len(text) - sum(text.count(bytes([b])) for b in SPACES)
    follow = len(text) - len(text.translate(None, bytes(range(128, 192))))  # bytes that begin no character
    return (
        len(words),
        chars - follow,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(a == b for a, b in zip(words, words[1:])),
    )


def _counter(texts: pa.Array) -> pa.Array:
    rows = np.array([text_counts(t) for t in values(texts)], dtype=np.int64).reshape(-1, len(COUNTS))
    return structs(COUNTS, [pa.array(c) for c in rows.T.copy()])


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts, base_failed and the metrics to `docs`, replacing columns so named."""
    ddl = f"struct<{', '.join(f'{c} bigint' for c in COUNTS)}>"
    out = with_fields(docs, struct_udf(_counter, ddl)(bytes_of(text)), COUNTS)
    words = F.col("n_words")
    share = lambda part, whole, scale: F.expr(f"{scale} * {part} div greatest({whole}, 1)")
    return out.withColumns(
        {
            "base_failed": (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * words),
            "word_length": share("word_chars", "n_words", 100),
            "symbol_share": share("n_symbols", "n_words", 1000),
            "dup_line_share": share("n_dup_lines", "n_lines", 1000),
            "stutter_share": share("n_stutters", "n_words", 1000),
        }
    )


def bucket(value: Column) -> Column:
    """Lower end of the sketch bucket of a whole number: exact below 64, then 32 a doubling."""
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(
        F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)
    )


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """(level, lang, source, metric, bucket, n) for all three levels of groups."""
    metrics = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in (*METRICS, *SIZES)])
    )
    good = measured.filter("NOT base_failed AND n_words > 0").select(
        F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), metrics.alias("m")
    )
    narrow = good.groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    levels = F.explode(
        F.array(
            F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source")),
            F.struct(F.lit(1).alias("level"), F.col("lang"), none.alias("source")),
            F.struct(F.lit(2).alias("level"), none.alias("lang"), none.alias("source")),
        )
    )
    merged = narrow.select(levels.alias("g"), "metric", "bucket", "n").groupBy("g", "metric", "bucket")
    return merged.agg(F.sum("n").alias("n")).select("g.level", "g.lang", "g.source", "metric", "bucket", "n")


#: A group's values: medians, distances of quartiles, median sizes.
VALUES = tuple(f"{p}_{m}" for m in METRICS for p in ("mid", "up", "down")) + tuple(f"mid_{x}" for x in SIZES)


def _merged(sketch: DataFrame, total: int) -> DataFrame:
    """(lang, source, metric, bucket, n): sketches of sources merged with those of their wider groups.

    Counts are scaled to whole numbers, so that quantiles do not depend on the order of sums.
    """
    whole = lambda c: c.cast("decimal(38,0)")
    of = lambda level: sketch.filter(F.col("level") == level)
    own = of(1).select("lang", "metric", "bucket", whole(whole(F.col("n")) * F.lit(total)).alias("n"))
    groups = of(1).filter(~F.col("metric").isin(*TWO_SIDED)).select("lang", "metric").distinct()
    all_texts = of(2).select("metric", "bucket", whole(F.col("n") * PRIOR).alias("n"))
    both = own.unionByName(groups.join(all_texts, "metric")).groupBy("lang", "metric", "bucket")
    langs = stored(both.agg(whole(F.sum("n")).alias("n")))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_metric"))
    named = [F.col("lang").alias("_lang"), F.col("metric").alias("_metric")]
    wider = langs.select(*named, "bucket", whole(F.col("n") * PRIOR).alias("n"))
    sources = of(0).select("lang", "source", "metric").distinct()
    drawn = sources.join(wider, same).drop("_lang", "_metric")
    sums = langs.groupBy(*named).agg(whole(F.sum("n")).alias("_sum"))
    scaled = of(0).join(sums, same).select("lang", "source", "metric", "bucket", whole(whole(F.col("n")) * F.col("_sum")).alias("n"))
    return scaled.unionByName(drawn).groupBy("lang", "source", "metric", "bucket").agg(whole(F.sum("n")).alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, mid_, up_ and down_<metric>, mid_<size>) of every language and source."""
    total = sketch.filter("level = 2 AND metric = 'n_words'").agg(F.sum("n")).first()[0] or 0
    group = Window.partitionBy("lang", "source", "metric")
    running = _merged(sketch, total).withColumns({"reached": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    quantile = lambda fourths: F.min(F.when(4 * F.col("reached") >= fourths * F.col("total"), F.col("bucket")))
    quartiles = running.groupBy("lang", "source", "metric").agg(*[quantile(i).cast("double").alias(f"q{i}") for i in (1, 2, 3)])
    of = {"mid": F.col("q2"), "up": F.col("q3") - F.col("q2"), "down": F.col("q2") - F.col("q1")}
    found = [F.max(F.when(F.col("metric") == v.split("_", 1)[1], of[v.split("_", 1)[0]])).alias(v) for v in VALUES]
    return quartiles.groupBy("lang", "source").agg(*found)


def failure() -> str:
    """SQL condition of a text that fails a metric, over its metrics, its sizes and its group's values."""
    found = []
    for metric, size in METRICS.items():
        n, m = f"greatest({size}, 1)", f"greatest(mid_{size}, 1.0D)"
        strays = f"sqrt(greatest(1.0D, {m} / {n}))"
        if metric in TWO_SIDED:
            reach = lambda side: f"{REACH}D * greatest({side}_{metric}, mid_{metric} / 32) * {strays}"  # noqa: B023, E731
            found += [f"b_{metric} > mid_{metric} + {reach('up')}", f"b_{metric} < mid_{metric} - {reach('down')}"]
        else:
            unseen = f"1000 * ({UNSEEN}D / {m} + {REACH}D * greatest(1.0D, sqrt({n} / {m})) / {n})"
            found.append(f"b_{metric} > mid_{metric} + {REACH}D * up_{metric} * {strays} + {unseen}")
    return " OR ".join(found)


def _limits(measured: DataFrame, bounds: DataFrame, lang: str, source: str) -> tuple[DataFrame, Column]:
    """`measured` joined with the values of its groups in `_limits`, and the verdict."""
    own = bounds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*VALUES).alias("_limits"))
    same = F.col(lang).cast("string").eqNullSafe(F.col("_lang")) & F.col(source).cast("string").eqNullSafe(F.col("_source"))
    out = measured.join(own, same, "left").drop("_lang", "_source")
    named = {v: f"_limits.{v}" for v in VALUES}
    condition = failure()
    for v in sorted(named, key=len, reverse=True):
        condition = re.sub(rf"\b{v}\b", named[v], condition)
    for metric in METRICS:
        out = out.withColumn(f"_b_{metric}", bucket(F.col(metric)))
        condition = condition.replace(f"b_{metric} ", f"_b_{metric} ")
    return out, ~(F.col("base_failed") | F.coalesce(F.expr(condition), F.lit(False)))


def _without_limits(judged: DataFrame) -> DataFrame:
    return judged.drop("_limits", *[f"_b_{m}" for m in METRICS])


def judge(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Add the counts, base_failed, the metrics and `kept` to `docs`; the text is dropped.

    NULL and empty texts have no words and fail the base rules. NULL languages and
    sources are groups of their own. An empty table gives an empty one. Repeated rows are judged alike; columns named
    like a result are replaced.
    """
    measured = stored(with_counts(docs, text).drop(text))
    bounds = stored(thresholds(sketches(measured, lang, source)))
    joined, kept = _limits(measured, bounds, lang, source)
    return _without_limits(joined.withColumn("kept", kept))


def keep_good(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """`docs` without the rows that fail, with their own columns and values.

    The counts are made twice, for the thresholds and for the filter, which is
    cheaper than moving or storing the texts.
    """
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"),
        F.col(text).alias("text"),
    )
    metrics = ["lang", "source", "base_failed", *SIZES, *METRICS]
    measured = stored(with_counts(own.drop("_row")).select(*metrics))
    bounds = stored(thresholds(sketches(measured, "lang", "source")))
    joined, kept = _limits(with_counts(own), bounds, "lang", "source")
    return joined.filter(kept).select("_row.*")


def _sql() -> str:
    """DuckDB SQL for judge() over the table documents, the ids being distinct."""
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    per_metric = "\nUNION ALL\n".join(f"SELECT lang, source, '{m}' metric, {m} v FROM good" for m in (*METRICS, *SIZES))
    of = {"mid": "q2", "up": "q3 - q2", "down": "q2 - q1"}
    found = ", ".join(f"max({of[v.split('_', 1)[0]]}) FILTER (metric = '{v.split('_', 1)[1]}') {v}" for v in VALUES)
    across = ", ".join(f"'{m}'" for m in TWO_SIDED)
    buckets = ", ".join(
        f"CASE WHEN {m} < 64 THEN {m} ELSE ({m} >> (len(bin({m})) - 6)) << (len(bin({m})) - 6) END b_{m}" for m in METRICS
    )
    fails = re.sub(r"(\d+\.\d+)D", r"\1::DOUBLE", failure())
    return rf"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') t FROM documents),
split AS (SELECT *, {words} w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l FROM texts),
runs AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') s
    FROM split, unnest(range(1, len(w) - {WINDOW - 2})) u(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) c FROM runs) WHERE c > 1),
inside AS (SELECT doc_id, count(DISTINCT i + k) n FROM twice, range(0, {WINDOW}) r(k) GROUP BY doc_id),
counts AS (SELECT doc_id, lang, source, len(w)::BIGINT n_words, len(array_to_string(w, ''))::BIGINT word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines,
    coalesce(n, 0)::BIGINT n_repeat_words, len(l)::BIGINT n_lines,
    len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::BIGINT n_stutters
    FROM split LEFT JOIN inside USING (doc_id)),
measured AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words base_failed,
    100 * word_chars // greatest(n_words, 1) word_length, 1000 * n_symbols // greatest(n_words, 1) symbol_share,
    1000 * n_dup_lines // greatest(n_lines, 1) dup_line_share, 1000 * n_stutters // greatest(n_words, 1) stutter_share
    FROM counts),
good AS (SELECT * FROM measured WHERE NOT base_failed AND n_words > 0),
metrics AS ({per_metric}),
buckets AS (SELECT lang, source, metric,
    CASE WHEN v < 64 THEN v ELSE (v >> (len(bin(v)) - 6)) << (len(bin(v)) - 6) END bucket FROM metrics),
sketch AS (
    SELECT 0 lvl, lang, source, metric, bucket, count(*) n FROM buckets GROUP BY ALL
    UNION ALL SELECT 1, lang, NULL, metric, bucket, count(*) FROM buckets GROUP BY ALL
    UNION ALL SELECT 2, NULL, NULL, metric, bucket, count(*) FROM buckets GROUP BY ALL),
everything AS (SELECT sum(n) total FROM sketch WHERE lvl = 2 AND metric = 'n_words'),
langs AS (SELECT lang, metric, bucket, sum(n)::HUGEINT n FROM (
    SELECT lang, metric, bucket, n::HUGEINT * total n FROM sketch, everything WHERE lvl = 1
    UNION ALL SELECT g.lang, metric, w.bucket, {PRIOR} * w.n FROM (SELECT DISTINCT lang, metric FROM sketch
        WHERE lvl = 1 AND metric NOT IN ({across})) g JOIN (SELECT * FROM sketch WHERE lvl = 2) w USING (metric)) GROUP BY ALL),
sums AS (SELECT lang, metric, sum(n)::HUGEINT total FROM langs GROUP BY ALL),
merged AS (SELECT lang, source, metric, bucket, sum(n)::HUGEINT n FROM (
    SELECT s.lang, s.source, s.metric, s.bucket, s.n::HUGEINT * t.total n
    FROM sketch s JOIN sums t ON s.lang IS NOT DISTINCT FROM t.lang AND s.metric = t.metric WHERE lvl = 0
    UNION ALL SELECT g.lang, g.source, g.metric, w.bucket, {PRIOR} * w.n FROM (SELECT DISTINCT lang, source, metric FROM sketch
        WHERE lvl = 0) g JOIN langs w ON g.lang IS NOT DISTINCT FROM w.lang AND g.metric = w.metric) GROUP BY ALL),
running AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) reached,
    sum(n) OVER (PARTITION BY lang, source, metric) total FROM merged),
quartiles AS (SELECT lang, source, metric, (min(bucket) FILTER (4 * reached >= total))::DOUBLE q1,
    (min(bucket) FILTER (4 * reached >= 2 * total))::DOUBLE q2, (min(bucket) FILTER (4 * reached >= 3 * total))::DOUBLE q3
    FROM running GROUP BY ALL),
bounds AS (SELECT lang, source, {found} FROM quartiles GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR coalesce({fails}, false)) kept
FROM (SELECT *, {buckets} FROM measured) m
LEFT JOIN bounds a ON a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source
"""


SQL = _sql()
