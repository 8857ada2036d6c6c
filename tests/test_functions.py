"""Hand-computed edge cases of the scalar functions."""

import html

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewloom.functions import display, text, vectors
from reviewloom.functions.constants import WHITESPACE


def column(spark, values, expression, kind="string"):
    """Apply an expression to `v` for each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_strip_takes_all_unicode_space(spark):
    values = ["\t\n hi \u001c", WHITESPACE + "a b" + WHITESPACE, "", WHITESPACE]
    assert column(spark, values, text.strip) == ["hi", "a b", "", ""]
    assert [v.strip() for v in values] == ["hi", "a b", "", ""]


@pytest.mark.parametrize("limit", [1, 20, 30])
def test_length_is_strict_and_counted_after_strip(spark, limit):
    bodies = ["x" * limit, "x" * (limit + 1), "😀" * limit, "😀" * (limit + 1), "a" + " " * limit + "b", "", " " * 99]
    values = bodies + [f" \n{b} \t" for b in bodies] + ["a\nb" * limit, None]
    expected = [None if v is None else len(v.strip()) > limit for v in values]
    assert column(spark, values, lambda c: text.longer_than(c, limit)) == expected


def test_shorten(spark):
    values = ["abcdefghij", "abcdefghijk", "abcdef  ijk", "  abc ", "abcdef  ijk"]
    expected = ["abcdefghij", "abcdefg...", "abcdef...", "abc", "abcdef..."]
    assert column(spark, values, lambda c: text.shorten(c, 10)) == expected
    with pytest.raises(ValueError):
        text.shorten(F.col("v"), 2)


def test_escape(spark):
    value = """<a href="x">R&D's"""
    assert column(spark, [value], text.escape_html) == ["&lt;a href=&quot;x&quot;&gt;R&amp;D&#x27;s"]
    assert html.escape(value) == "&lt;a href=&quot;x&quot;&gt;R&amp;D&#x27;s"


def test_highlight_never_marks_its_own_output(spark):
    df = spark.createDataFrame(
        [
            ("a broken mark & more", "Broken mark amp a", "a <mark>broken</mark> <mark>mark</mark> &amp; more"),
            ("it's x27 <b>", "x27 lt b it", "<mark>it</mark>&#x27;s <mark>x27</mark> &lt;b&gt;"),
            ("Élan élan elan", "ÉLAN", "<mark>Élan</mark> <mark>élan</mark> elan"),
            ("tea teapot tea", "tea", "<mark>tea</mark> teapot <mark>tea</mark>"),
            ("ice cream", "", "ice cream"),
            ("a & b", None, "a &amp; b"),
            ("under_score under", "under", "under_score <mark>under</mark>"),
        ],
        "t string, q string, e string",
    )
    for row in df.select("t", "e", text.highlight(F.col("t"), F.col("q")).alias("h")).collect():
        assert row["h"] == row["e"], row["t"]


def test_query_terms_longest_first_then_by_position(spark):
    values = ["Stale a chips stale OLD tea", "", None]
    assert column(spark, values, text.query_terms) == [["stale", "chips", "old", "tea"], [], []]


def test_keyword_words_match_the_regular_expression(spark):
    values = [
        "tea tea Coffee coffee stale, stale!",
        "über1abcd with food crunchy",
        "snake_case ABCDéf abcd-efgh (wxyz) abcd1 1abcd don't",
        "",
    ]
    assert column(spark, values, text.keyword_words) == [
        ["coffee", "coffee", "stale", "stale"],
        ["crunchy"],
        ["abcd", "efgh", "wxyz"],
        [],
    ]


def test_word_counts(spark):
    values = ["b a b", "", None, "x"]
    got = column(spark, values, lambda c: text.word_counts(text.words(c)))
    assert [g and [tuple(r) for r in g] for g in got] == [[("a", 1), ("b", 2)], None, None, [("x", 1)]]
    got = column(spark, values, lambda c: text.word_counts(text.words(c), positions=True))
    assert [g and [tuple(r) for r in g] for g in got] == [[("a", 1, 1), ("b", 2, 0)], None, None, [("x", 1, 0)]]


def test_theme_display(spark):
    assert column(spark, ["0_stale_old_chips", "12_tea", "no_number"], text.theme_display) == [
        "stale old chips",
        "tea",
        "no number",
    ]


def test_confidence_percent_rounds_half_to_even_and_clamps(spark):
    values = [0.005, 0.025, 0.975, 1.2, -0.1]
    assert column(spark, values, display.confidence_percent, "double") == [0, 2, 98, 100, 0]


def test_safe_int(spark):
    assert column(spark, [3.7, None, -3.7], display.safe_int, "double") == [3, 0, -3]
    assert column(spark, ["3.7", "x", None, " 12 "], display.safe_int) == [0, 0, 0, 12]


def test_labels(spark):
    assert column(spark, ["POSITIVE", "NEGATIVE", "OTHER"], display.display_label) == [
        "Positive Review",
        "Negative Review",
        "Negative Review",
    ]
    assert column(spark, [0, 1, 2], display.class_name, "int") == ["NEGATIVE", "POSITIVE", None]
    assert column(spark, ["NEGATIVE", "POSITIVE", "x"], display.class_id) == [0, 1, None]
    assert column(spark, [[0.2, 0.8], [0.5, 0.5]], display.argmax, "array<double>") == [1, 0]


def test_bar_width(spark):
    df = spark.createDataFrame([(40, 40), (10, 40), (0, 0), (1, 3)], "c int, m int")
    got = [r[0] for r in df.select(display.bar_width(F.col("c"), F.col("m"))).collect()]
    assert got == [100.0, 25.0, 0.0, 33.3]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.unit(F.col("a"))).collect()
    assert rows[0][0] == 11.0 and [round(x, 6) for x in rows[0][1]] == [0.6, 0.8]
    assert rows[1][0] == 0.0 and rows[1][1] == [0.0, 0.0]
    assert rows[2][0] is None and rows[2][1] is None
    uneven = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(PySparkException, match="differ in length"):
        uneven.select(vectors.dot(F.col("a"), F.col("b"))).collect()
