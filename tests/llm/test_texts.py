"""Operators that treat each text on its own: private data, quality counts, pages, tokens."""

import random
import time
from html.parser import HTMLParser

import public_tokenizers
import pytest
import sentencepiece

from reviewloom.llm import html_text, pii, quality, queries, token_counts
from tests.llm.brute import hard_docs, no_docs, personal, repeated, rows_of, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_private_data_of_hard_rows(spark):
    docs = hard_docs(spark)
    found = rows_of(pii.personal_data(docs))
    assert len(found) == docs.count()
    for row in found:
        counts, digest = personal(row["text"])
        assert [row[c] for c in pii.COLUMNS[:4]] == counts and row["base_sha256"] == digest
    assert found[0]["spans"] == "" and pii.personal_data(no_docs(spark)).count() == 0
    clean = rows_of(pii.redact(docs))
    assert clean[0]["text"] is None and clean[0]["n_chars"] is None
    assert clean[5]["text"] == "Write to [EMAIL] or [PHONE] today" and clean[5]["n_chars"] == 33
    assert pii.redact(docs).columns == docs.columns


def test_private_data_of_random_texts():
    rng = random.Random(3)
    parts = ["a", "B", "@", "@", ".", "-", "+", "1", "25", "255", " ", "(", ")", "_", "é", "4539", "0", "x@y.z", "\n", "+1"]
    for _ in range(5_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        spans = [x for x in pii.find_spans(text) if x[2] in pii.BASE]
        counts, _ = personal(text)
        assert [sum(k == kind for *_, k in spans) for kind in pii.BASE] == counts, text


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 ok", "iban", "DE89 3704 0044 0532 0130 00"),
        ("Account no. 12345678, thanks", "account", "12345678"),
        ("SSN: 123-45-6789", "ssn", "123-45-6789"),
        ("ftp://bob:pw12@host.com/x", "login", "bob:pw12@host.com"),
        ("at 12 Main Street, near", "address", "12 Main Street"),
    ],
)
def test_added_spans(text, kind, value):
    assert (value, kind) in [(text[s:e], k) for s, e, k in pii.find_spans(text)]


def test_no_added_spans_in_clean_text():
    for text in ("The account of the war, 1914 to 1918", "SSN is short for it", "DE12 is a road", "http://host.com/a:b"):
        assert pii.find_spans(text) == []


def test_quality_counts():
    rng = random.Random(5)
    texts = ["", " \n ", "a b", "x " * 9, "#a *b* é|c\n#a *b* é|c\n\n \n"]
    texts += [" ".join(rng.choice("abc") + rng.choice(["", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for text in texts:
        n, chars, symbols, dups, again, lines, _ = quality.text_counts(text.encode())
        with_word = [x for x in text.split("\n") if words(x)]
        assert n == len(words(text)) and chars == sum(map(len, words(text)))
        assert symbols == sum(c in "#*$%&|<>" for c in text)
        assert (dups, lines) == (len(with_word) - len(set(with_word)), len(with_word))
        assert again == repeated(text)


def test_quality_of_hard_rows(spark):
    docs = hard_docs(spark)
    judged = rows_of(quality.judge(docs))
    assert len(judged) == docs.count() and judged[0]["n_words"] == 0 and judged[0]["base_failed"]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in rows_of(kept)} == {r["doc_id"] for r in judged if r["kept"]}
    assert quality.judge(no_docs(spark)).count() == 0 and quality.keep_good(no_docs(spark)).count() == 0


def test_quality_thresholds_adapt(spark):
    """Where a source's texts are full of symbols, that is no fault; a stray one elsewhere is."""
    text = lambda i, mark: " ".join(f"w{i}{j}{mark}" for j in range(40))
    rows = [(i, text(i, "#"), "en", "code") for i in range(60)] + [(100 + i, text(i, ""), "en", "prose") for i in range(60)]
    rows += [(900, text(900, "#"), "en", "prose"), (901, text(901, ""), None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    dropped = {r["doc_id"] for r in rows_of(quality.judge(docs)) if not r["kept"]}
    assert dropped == {900}


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><a href="/">Home</a></nav><div class="ad">Buy this, now.</div><!-- c -->
<article><h1>Head &amp; line</h1><p><b>First  text,<br>more<p>Second</p><aside>no</aside>
<section class="comments"><p>Great, thanks.</p></section></article><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, "Head & line\nFirst text, more\nSecond"),
        (PAGE[: PAGE.index("cond</p>")], "Head & line\nFirst text, more\nSe"),
        ("", ""),
        ("<p>a &lt; b</p><p>See <a href=x>this page</a>, please.</p><p cut", "a < b\nSee this page, please."),
        ("<body><header>Top</header><div id=cookie-notice>We use cookies.</div><div><p>Long, real text.</p></div></body>", "Long, real text."),
        ("<ul><li>one<li>two</ul>", "one\ntwo"),
        ("<article>" + "<div>" * 3000 + "deep" + "</x>" * 3000, "deep"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "wrapper",
    [
        '<article class="post hentry category-social tag-menu">',
        '<article class="comment">',
        '<div class="content has-sidebar">',
        '<div class="single-post comments-open">',
        '<div class="story share-enabled">',
        '<div class="elementor-widget-theme-post-content">',
        '<div id="widget">',
        '<div class="hidden md:block" title="the hidden city" data-x="display:none">',
    ],
)
def test_names_of_wrappers_lose_no_text(wrapper):
    body = "<p>The first, rather long paragraph of a story.</p><p>And here, at last, the second one.</p>"
    page = f"<body>{wrapper}{body}</{wrapper[1:].split()[0]}><div class='social-share'>Tell your friends, now.</div></body>"
    assert html_text.main_text(page) == "The first, rather long paragraph of a story.\nAnd here, at last, the second one."


STORY = "<p>The first, rather long paragraph of a story.</p><p>And here, at last, the second one.</p>"
STORY_TEXT = "The first, rather long paragraph of a story.\nAnd here, at last, the second one."
LINKS = "<div><ul>" + "<li><a href=x>Another story</a></li>" * 5 + "</ul></div>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h2>Head</h2>{STORY}{LINKS}</article>", f"Head\n{STORY_TEXT}"),
        (f"<main>{STORY}<div>Buy now</div></main>", STORY_TEXT),
        (f"<body><article><p>Teaser</p></article><div><section>{STORY * 5}</section></div></body>", "\n".join([STORY_TEXT] * 5)),
    ],
)
def test_ratios_decide_inside_and_outside_of_articles(page, text):
    found = html_text.main_text(page)
    assert found == text or found == f"Teaser\n{text}"


@pytest.mark.parametrize(
    "page, text",
    [
        # Lists, tables, code and named or unnamed elements of an article stay, however short.
        (f"<article>{STORY * 4}<section><h2>Steps</h2><ol><li>Mix</li><li>Bake</li></ol></section></article>",
         "\n".join([STORY_TEXT] * 4 + ["Steps", "Mix", "Bake"])),
        (f"<article>{STORY * 4}<div class='body-note'>A closing remark.</div></article>", "\n".join([STORY_TEXT] * 4 + ["A closing remark."])),
        (f"<article>{STORY * 4}<pre>x = 1</pre><table><tr><th>a</th><td>1</td></tr></table></article>",
         "\n".join([STORY_TEXT] * 4 + ["x = 1", "a", "1"])),
        # Comments never win over a story, with or without a name, inside or behind it.
        ("<article><h1>Head</h1><p>Short, but told.</p></article><section>" + "<p>A comment, with words and more words.</p>" * 8 + "</section>",
         "Head\nShort, but told."),
        (f"<article>{STORY}<div class='post-comments-list'>" + "<p>Nice, thanks a lot for all of this.</p>" * 9 + "</div></article>", STORY_TEXT),
        (f"<article>{STORY}</article><article class='comment'><p>Nice, thanks.</p></article>", STORY_TEXT),
        # A telling part of a name is enough outside of an article; the state of a page is no such part.
        (f"<div>{STORY}</div><div class='gdpr-banner__text'><p>We use cookies, as all do.</p></div>", STORY_TEXT),
        (f"<div class='has-sidebar'>{STORY}</div><div class='no-sidebar'>{STORY}</div>", f"{STORY_TEXT}\n{STORY_TEXT}"),
    ],
)
def test_articles_lose_nothing_and_gain_nothing(page, text):
    assert html_text.main_text(page) == text


def test_quality_limits_differ_between_groups_and_small_groups_lean_on_wider_ones(spark):
    """Few junk texts of a source of their own are found; many texts of a kind are what a source is like."""
    text = lambda i, share: " ".join(f"w{i:04}{j:03}" + ("#" if j % 100 < share else "") for j in range(200))
    rows = [(i, text(i, i % 3), "en", "plain") for i in range(300)]
    rows += [(1000 + i, text(1000 + i, 60 + i % 3), "en", "marked") for i in range(300)]
    rows += [(2000 + i, text(2000 + i, 60), "en", "few") for i in range(3)]
    rows += [(3000, text(3000, 60), "en", "plain"), (3001, text(3001, 1), "xx", "alone")]
    docs = spark.createDataFrame([*rows, *rows[:1]], "doc_id bigint, text string, lang string, source string")
    bounds = {r["source"]: r for r in rows_of(quality.thresholds(quality.sketches(quality.with_counts(docs), "lang", "source")), "source")}
    assert bounds["plain"]["mid_symbol_share"] < 30 < 500 < bounds["marked"]["mid_symbol_share"]
    dropped = {r["doc_id"] for r in rows_of(quality.judge(docs)) if not r["kept"]}
    assert dropped == {3000}
    mostly_plain = docs.filter("source <> 'marked'")
    dropped = {r["doc_id"] for r in rows_of(quality.judge(mostly_plain)) if not r["kept"]}
    assert dropped == {2000, 2001, 2002, 3000}


class PlainPage(HTMLParser):
    """Second version for the given pages: the text of the article, block by block."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag == "br":
            self.handle_data(" ")
        elif tag in ("article", "h1", "p"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("article", "h1", "p"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_every_given_page_equals_a_plain_version(spark, sf):
    pages = rows_of(spark.read.parquet(f"{sf}/pages.parquet"), "page_id")
    found = rows_of(queries.registered()["op3_main_text"](spark, sf), "page_id")
    assert len(found) == len(pages) > 0
    for page, row in zip(pages, found):
        blocks = [" ".join(b.split()) for b in PlainPage(page["html"] or "").blocks]
        assert row["text"] == "\n".join(b for b in blocks if b)
        assert (row["page_id"], row["url"], row["n_chars"]) == (page["page_id"], page["url"], len(row["text"]))


@pytest.mark.parametrize("piece", ["<b>{}<div></div>", "<div>{}<li>x", "<p>{}<b><p>", "<i>{}</b>", "<a '>{}<a \"", "<ul><li>{}</ul>"])
def test_long_pages_of_unclosed_tags_take_linear_time(piece):
    opened, rest = piece.split("{}")
    n = 1_000_000 // len(piece)
    start = time.perf_counter()
    html_text.main_text(opened * n + rest * n)
    assert time.perf_counter() - start < 10


def test_pages_of_hard_rows(spark):
    pages = spark.createDataFrame(
        [(1, None, "u", 5), (2, "", None, None), (2, "", None, None), (None, PAGE, "u", 1)],
        "page_id bigint, html string, url string, n_chars int",
    )
    found = rows_of(html_text.extract(pages), "page_id")
    assert [(r["text"], r["n_chars"]) for r in found[:3]] == [("", 0)] * 3
    assert found[3]["n_chars"] == len(found[3]["text"]) == 35
    assert html_text.extract(pages.limit(0)).count() == 0


def test_tokens_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    signs = " \n\t▁aabceé  ñ漢字\U0001f600\x00<s>0x5"
    texts = ["", " ", "\n", "\n\n a", "aaaa aaaaaaaaaaa", "<s> </s> <0x0A>", "the" * 500, "漢字かな" * 300]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    mine = [r["n_tokens"] for r in rows_of(token_counts.token_counts(docs, MODEL))]
    assert mine == [len(x) for x in lib.encode(texts, num_threads=1)]


def test_tokens_of_hard_rows(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for row in rows_of(token_counts.token_counts(hard_docs(spark), MODEL)):
        text = row["text"] or ""
        assert row["n_tokens"] == len(lib.encode(text)) and row["n_bytes"] == len(text.encode())
        assert row["over_limit"] == (row["n_tokens"] > 4096)
    assert token_counts.token_counts(no_docs(spark), MODEL).count() == 0
