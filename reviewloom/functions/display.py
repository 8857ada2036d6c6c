"""Expressions that shape numbers and labels for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.constants import (
    CLASS_IDS,
    CLASS_OF_SCORE,
    NO_KEYWORDS,
    SUMMARY_SENTENCE,
)


def safe_int(value: Column, default: int = 0) -> Column:
    """Integer value, truncated towards zero, or the default where there is none."""
    return F.coalesce(value.try_cast("int"), F.lit(default))


def confidence_percent(score: Column) -> Column:
    """Whole percent from 0 to 100, halves rounded to even."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(score * 100, 0).cast("int")))


def display_label(label: Column) -> Column:
    return F.when(label == "POSITIVE", "Positive Review").otherwise("Negative Review")


def class_name(label: Column) -> Column:
    """Class id to class name."""
    return F.coalesce(*[F.when(label == number, F.lit(name)) for name, number in CLASS_IDS.items()])


def class_id(name: Column) -> Column:
    """Class name to class id."""
    return F.coalesce(*[F.when(name == own, F.lit(number)) for own, number in CLASS_IDS.items()])


def class_of_score(score: Column) -> Column:
    """Class id of a star rating; ratings between the classes have none."""
    return F.coalesce(*[F.when(score == s, F.lit(CLASS_IDS[name])) for s, name in CLASS_OF_SCORE.items()])


def argmax(scores: Column) -> Column:
    """Zero-based position of the first largest element."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def bar_width(count: Column, largest: Column) -> Column:
    """Share of the largest count in percent, one decimal; 0 when all are 0."""
    return F.when(largest == 0, F.lit(0.0)).otherwise(F.round(count / largest * 100, 1))


def four_decimals(score: Column) -> Column:
    """Text with four decimals and no grouping."""
    return F.format_string("%.4f", score.cast("double"))


def result_label(rank: Column) -> Column:
    return F.format_string("Result %d", rank)


def summary_sentence(query: Column, keywords: Column) -> Column:
    """Sentence naming the keywords found for a query."""
    listed = F.when(F.size(keywords) > 0, F.array_join(keywords, ", ")).otherwise(F.lit(NO_KEYWORDS))
    before, _, rest = SUMMARY_SENTENCE.partition("{query}")
    between, _, behind = rest.partition("{keywords}")
    return F.concat(F.lit(before), query, F.lit(between), listed, F.lit(behind))
