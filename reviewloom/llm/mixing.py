"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

A document's rate is the number of times the mix should take it. Among all rates
that give each source its target of words and stay between 0 and 2, the ones that
are closest (in relative entropy over documents) to taking every document once are
exponentially tilted: rate = min(2, exp(tilt of the source * size / mean size)). The
tilts maximise a concave dual with one variable per source; Newton's method finds them.
Each iteration is a distributed aggregation of words and curvature by source. Rates
depend on source and size alone, so it reads a histogram of sizes, made once with
combining before the shuffle; a hot source is as small there as any other.

Rates become copies: the whole part, plus one copy where the document is chosen for the
fraction. Choices are sequential Poisson samples: in the order of a hash of the id
over the fraction, documents are taken until the missing words are reached. Documents
far above their source's mean size are chosen first, then those above it; what they
miss or exceed the smaller ones make up, so a source ends within about half of a small
document of its target. Running totals are taken within buckets of a bounded number of
rows and over the buckets' sums, never over a whole source at once. What comes out is a
cut per source and class, so the choice is one comparison per document and the same in
every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.rows import text_of
from reviewloom.session import stored

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BUCKET_ROWS = 2_000
#: Classes of size, as multiples of the source's mean, that are rounded one after the other.
CLASS_BOUNDS = (1.0, 3.0)
MAX_ITERATIONS = 100
CLOSE = 1e-9
#: Tilts beyond which every document is at its bound.
FAR_TILT = 700.0


def size_of(text: str) -> Column:
    """Words between ASCII white space; NULL has none."""
    return F.regexp_count(text_of(text), F.lit(WORDS)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Add `target` to (source, source_size, ...): weights in code-point order, NULL last.

    The sources share `share` of all sizes by weight; none gets more than `MOST`
    times its size, and what is over is shared by weight among the others until none
    is above. The window holds one row per source.
    """
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(number, F.lit(len(weights))))
    weighed = stored(sources.withColumn("_weight", weight))
    most = MOST * F.col("source_size")
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # words per weight; each turn caps at least one more source
        capped = most <= level * F.col("_weight")
        row = weighed.agg(
            F.sum(F.when(capped, most).otherwise(0)).alias("fixed"), F.sum(F.when(~capped, F.col("_weight"))).alias("free")
        ).first()
        new = (total - (row["fixed"] or 0)) / row["free"] if row["free"] else level
        if new <= level:
            break
        level = new
    return weighed.withColumn("target", F.least(most, level * F.col("_weight")).cast("double")).drop("_weight")


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    power = tilt * size / mean
    return F.when(power >= F.log(F.lit(MOST)), F.lit(MOST)).otherwise(F.exp(power))


def _newton(sources: DataFrame, histogram: DataFrame) -> DataFrame:
    """Add `tilt` to sources with target and mean: where the rates' words meet the target.

    Each variable stays inside the bracket found so far; where a Newton step leaves it
    (the curvature vanishes at the bounds), the bracket is halved or doubled.
    """
    full = F.col("target") >= MOST * F.col("source_size")
    start = F.when(full, FAR_TILT).when(F.col("target") <= 0, -FAR_TILT).otherwise(0.0)
    state = sources.withColumns({"tilt": start, "low": F.lit(-FAR_TILT), "high": F.lit(FAR_TILT), "open": start == 0})
    for _ in range(MAX_ITERATIONS):
        state = stored(state)
        if not state.filter("open").limit(1).count():
            break
        active = state.filter("open").select(F.col("source").alias("_source"), "tilt", "mean")
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < MOST, words * F.col("size") / F.col("mean")).otherwise(0)
        sums = (
            histogram.join(active, F.col("source").eqNullSafe(F.col("_source")))
            .groupBy("_source")
            .agg(F.sum(words).alias("_words"), F.sum(slope).alias("_slope"))
        )
        off = F.col("_words") - F.col("target")
        low = F.when(off < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - off / F.col("_slope")
        outside = F.when(low == -FAR_TILT, 2 * F.col("tilt") - 1).when(high == FAR_TILT, 2 * F.col("tilt") + 1)
        inside = (F.col("_slope") > 0) & (step > low) & (step < high) & (F.abs(step - F.col("tilt")) < 50)
        new = F.when(inside, step).otherwise(F.coalesce(outside, (low + high) / 2))
        done = (F.abs(off) <= CLOSE * F.col("target")) | (new == F.col("tilt")) | (high - low < 1e-12)
        moved = F.col("open") & F.col("_words").isNotNull()
        keep = ~moved | done
        state = (
            state.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left")
            .withColumns(
                {
                    "_tilt": F.when(keep, F.col("tilt")).otherwise(new),
                    "_low": F.when(moved, low).otherwise(F.col("low")),
                    "_high": F.when(moved, high).otherwise(F.col("high")),
                    "_open": ~keep,
                }
            )
            .select(*sources.columns, F.col("_tilt").alias("tilt"), F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("_open").alias("open"))
        )
    return state.drop("low", "high", "open")


def _place(key: Column, fraction: Column) -> Column:
    """Order of a document in the choice for its fraction; infinity where there is none."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit("mix")), 11) + 0.5) / F.lit(2.0**53)
    return F.when(fraction > 0, uniform / fraction).otherwise(F.lit(float("inf")))


def _with_plan(docs: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """`docs` (with _size and _key) joined with what their source needs to place them."""
    joined = docs.join(plan.withColumnRenamed("source", "_source"), F.col(source).eqNullSafe(F.col("_source")), "left")
    rate = F.when(F.col("_size") > 0, _rate(F.col("tilt"), F.col("_size"), F.col("mean"))).otherwise(1.0)
    return joined.withColumn("_rate", rate).withColumns(
        {
            "_whole": F.floor("_rate"),
            "_class": sum((F.col("_size") > b * F.col("mean")).cast("int") for b in CLASS_BOUNDS),
            "_place": _place(F.col("_key"), F.when(F.col("_size") > 0, F.col("_rate") - F.floor("_rate")).otherwise(0)),
        }
    ).drop("_source")


def _cuts(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, cuts): for each size class the place up to which documents get one copy more."""
    expected = (F.col("_rate") - F.col("_whole")) * F.col("_size")
    classes = range(len(CLASS_BOUNDS) + 1)
    needs = stored(
        placed.groupBy("source").agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.sum(F.when(F.col("_class") == c, expected).otherwise(0)).alias(f"expected_{c}") for c in classes],
        )
    )
    source = F.col("source").eqNullSafe(F.col("_source"))
    slots = needs.select(F.col("source").alias("_source"), F.ceil(F.col("rows") / BUCKET_ROWS).alias("slots"))
    # Places run from 0 to infinity; x / (1 + x) spreads them over the buckets.
    spread = F.col("_place") / (1 + F.col("_place"))
    rows = (
        placed.filter(F.col("_place") < float("inf"))
        .join(slots, source)
        .select("source", "_class", "_place", "_size", F.floor(spread * F.col("slots")).cast("long").alias("_bucket"))
    )
    group = ["source", "_class"]
    buckets = rows.groupBy(*group, "_bucket").agg(F.sum("_size").alias("words"))
    before = F.sum("words").over(Window.partitionBy(*group).orderBy("_bucket")) - F.col("words")
    starts = buckets.select(
        F.col("source").alias("_source"), F.col("_class").alias("_c"), F.col("_bucket").alias("_b"), before.alias("before")
    )
    order = Window.partitionBy(*group, "_bucket").orderBy("_place").rangeBetween(Window.unboundedPreceding, 0)
    same = source & (F.col("_class") == F.col("_c")) & (F.col("_bucket") == F.col("_b"))
    inside = rows.withColumn("reached", F.sum("_size").over(order))
    # One row per place; equal rows share a place and are taken together.
    running = inside.join(starts, same).select(*group, "_place", (F.col("before") + F.col("reached")).alias("reached"))
    running = stored(running.distinct())
    known = needs.withColumn("need", F.lit(0.0))
    for c in reversed(classes):  # what a class of larger documents missed or exceeded, the next one makes up
        known = known.withColumn("need", F.col("need") + F.col(f"expected_{c}"))
        miss = F.abs(F.col("reached") - F.col("need"))
        own = running.filter(F.col("_class") == c).withColumnRenamed("source", "_source")
        best = own.join(known.select("source", "need"), source).groupBy("_source").agg(
            F.min(F.struct(miss.alias("miss"), F.col("_place"), F.col("reached"))).alias("best")
        )
        better = F.coalesce(F.col("best.miss") < F.abs(F.col("need")), F.lit(False))  # else take none
        known = stored(
            known.join(best, source, "left").withColumns(
                {
                    f"cut_{c}": F.when(better, F.col("best._place")).otherwise(-1.0),
                    "need": F.col("need") - F.when(better, F.col("best.reached")).otherwise(0),
                }
            ).drop("_source", "best")
        )
    return known.select("source", F.array(*[f"cut_{c}" for c in classes]).alias("cuts"))


def mixing_plan(sized: DataFrame) -> DataFrame:
    """One row per source of (source, _key, _size): source_size, target, mean, tilt and cuts."""
    histogram = stored(sized.groupBy("source", F.col("_size").alias("size")).agg(F.count(F.lit(1)).alias("n")))
    words = F.sum(F.col("size") * F.col("n"))
    with_words = F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0))
    sources = histogram.groupBy("source").agg(
        words.alias("source_size"), (words / F.greatest(with_words, F.lit(1))).cast("double").alias("mean")
    )
    plan = stored(_newton(stored(targets(sources)), histogram.filter("size > 0")))
    cuts = _cuts(_with_plan(sized, plan, "source"), plan)
    cuts = cuts.withColumnRenamed("source", "_source")
    return stored(plan.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"))


def _copies() -> Column:
    return (F.col("_whole") + (F.col("_place") <= F.get("cuts", F.col("_class"))).cast("int")).cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of `docs`.

    NULL and empty texts have size 0 and are taken once, with no words. NULL is a
    source of its own. Rows that share an id, a source and a size are rounded alike.
    Other columns are ignored; an empty table gives no rows.
    """
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.col(id_col).cast("string").alias("_key"),
            size_of(text).alias("_size"),
        )
    )
    plan = mixing_plan(sized.select("source", "_key", "_size"))
    return _with_plan(sized, plan, "source").select(
        "doc_id",
        "source",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        _copies().alias("copies"),
        (_copies() * F.col("_size")).cast("bigint").alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """`docs` as often as the mix takes each, with its number in `copy`.

    Texts are read twice, for the sizes and for the result, and are not moved where
    the table of sources is small enough for Spark to send it along.
    """
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "copy"]).alias("_row"),
        F.col(source).cast("string").alias("source"),
        F.col(id_col).cast("string").alias("_key"),
        size_of(text).alias("_size"),
    )
    plan = mixing_plan(stored(own.select("source", "_key", "_size")))
    placed = _with_plan(own, plan, "source").filter(_copies() > 0)
    return placed.select("_row", F.explode(F.sequence(F.lit(1), _copies().cast("int"))).alias("copy")).select("_row.*", "copy")
