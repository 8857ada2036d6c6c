"""Text expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.constants import STOPWORDS, WHITESPACE, WHITESPACE_CODE_POINTS

WORD = r"[\p{L}\p{N}_]+"
KEYWORD = r"(?<![\p{L}\p{N}_])[a-z]{4,}+(?![\p{L}\p{N}_])"


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(text, F.lit(WHITESPACE))


def longer_than(text: Column, chars: int) -> Column:
    """True where the stripped text has more than `chars` code points.

    The match ends at the first character that proves it, so a long text is
    neither stripped nor counted to be kept.
    """
    blank = "".join(f"\\x{{{p}}}" for p in WHITESPACE_CODE_POINTS.split())
    return text.rlike(f"(?s)^[{blank}]*+[^{blank}].{{{chars - 1},}}?[^{blank}]")


def is_blank(text: Column) -> Column:
    """True for NULL and for text that is only white space."""
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_counts(found: Column, positions: bool = False) -> Column:
    """Distinct words of an array as array<struct<word, tf>>, on request with the first position.

    Counted inside the row: equal words are neighbours once sorted, so a word's
    count is the distance between the starts of two runs.
    """
    if positions:
        found = F.transform(found, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))

    def word(item: Column) -> Column:
        return item["word"] if positions else item

    def runs(ordered: Column) -> Column:
        def begins(i: Column) -> Column:
            return (i == 1) | (word(F.element_at(ordered, i)) != word(F.get(ordered, i - 2)))

        starts = F.filter(F.sequence(F.lit(1), F.size(ordered)), begins)
        return F.element_at(F.transform(F.array(starts), lambda begun: counted(ordered, begun)), 1)

    def counted(ordered: Column, starts: Column) -> Column:
        def entry(start: Column, at: Column) -> Column:
            first = F.element_at(ordered, start)
            end = F.coalesce(F.get(starts, at + 1), F.size(ordered) + 1)
            fields = [word(first).alias("word"), (end - start).alias("tf")]
            return F.struct(*fields, first["pos"].alias("pos")) if positions else F.struct(*fields)

        return F.transform(starts, entry)

    filled = F.filter(F.array(F.sort_array(found)), lambda ordered: F.size(ordered) > 0)
    return F.get(F.transform(filled, runs), F.lit(0))


def keyword_words(text: Column) -> Column:
    """Words of four or more ASCII letters that are not stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOPWORDS))


def query_terms(query: Column) -> Column:
    """Distinct words of two or more characters, longest first, else by position."""
    kept = F.filter(F.array_distinct(words(F.coalesce(query, F.lit("")))), lambda w: F.length(w) >= 2)
    ranked = F.transform(
        kept, lambda w, i: F.struct((-F.length(w)).alias("len"), i.alias("pos"), w.alias("term"))
    )
    return F.transform(F.array_sort(ranked), lambda r: r["term"])


def shorten(text: Column, max_chars: int) -> Column:
    """Strip; cut longer text so that it fits `max_chars` with three dots."""
    if max_chars < 3:
        raise ValueError("max_chars must be at least 3")
    body = strip(text)
    cut = F.rtrim(F.substring(body, 1, max_chars - 3), F.lit(WHITESPACE))
    return F.when(F.length(body) <= max_chars, body).otherwise(F.concat(cut, F.lit("...")))


def escape_html(text: Column) -> Column:
    """Escape the five characters that are special in HTML; the ampersand first."""
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def highlight(text: Column, query: Column) -> Column:
    """Escape the text and wrap whole-word query terms in mark tags.

    All terms are matched in one pass, so tags and entities that the escaping
    produced are never matched themselves.
    """
    terms = query_terms(query)
    pattern = F.concat(
        F.lit(r"(?iu)(?<![\p{L}\p{N}_&])(?<!&#)("),
        F.array_join(terms, "|"),
        F.lit(r")(?![\p{L}\p{N}_])"),
    )
    escaped = escape_html(text)
    marked = F.regexp_replace(escaped, pattern, F.lit("<mark>$1</mark>"))
    return F.when(F.size(terms) == 0, escaped).otherwise(marked)


def theme_display(name: Column) -> Column:
    """Drop the leading topic number and turn underscores into spaces."""
    return F.replace(F.regexp_replace(name, r"^\d+_", ""), F.lit("_"), F.lit(" "))
