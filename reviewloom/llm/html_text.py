"""Main text of web pages by tag-path ratios.

A page is read into runs of text, each under its path of block tags from the root
(links, emphasis and the like belong to their block). For every path the length of
text, without that of links, and the punctuation of all its runs are summed and put in
relation to the number of nodes. The two ratios are smoothed along the order of paths
in the page and fused by multiplication; paths that reach a share of the page's
spread are content. Paths through boilerplate tags (menus, page headers and footers,
sidebars, forms) get no score. Class, id and role names that hint at boilerplate lower
the ratios of the paths through them; those of articles (but for reader comments), main elements and elements with
more than half of the page's text, if it is not beside an article, do not count. Links lower them by their share of the
text, and an article or main element doubles them. Headings, paragraphs and other
elements made for text are also content if a path beside them scores twice the bound,
so that short ones stay; all others take nothing from their neighbours.

Inside an article or main element a path that the ratios leave out is content all the same if at
most half of it is links, no name speaks against it, and it is an element made for text or holds a
punctuation mark. If an article has a sentence, paths that begin beside or behind it are not content, however long.
Reader comments without a name inside the article cannot be told from it and stay.

Pages are independent of each other; each is read once, in time that grows with its length.
Repeated pages are extracted each by itself, an empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.rows import struct_udf, text_of, values

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CUE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")
MARKS = re.compile(r"[.,;:!?…。，！？；：]")

# What browsers do not show as text of the page.
HIDDEN = frozenset("script style template noscript iframe object svg math canvas audio video head title".split())
RAW = frozenset("script style template noscript iframe title textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
BOILER = frozenset("nav footer aside form menu dialog button select option textarea fieldset datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXTUAL = HEADINGS | frozenset("p li dt dd blockquote pre figcaption caption td th".split())
#: Elements around the main text; the greater number is nearer to it.
CONTAINERS = {"main": 1, "article": 2}
#: Elements whose own names say nothing about their text.
UNNAMED = frozenset(("article", "main", "html", "body"))
#: Class, id and role names that hint at boilerplate; a name made of several has nothing but these parts.
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies discussion disqus footer gdpr login masthead menu menubar nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted related replies reply respond share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget widgets".split()
)
#: Those of which one part is enough, inside and outside of an article.
READERS = frozenset("comments disqus".split())
TELLING = READERS | frozenset(
    "advert adverts advertisement breadcrumb breadcrumbs consent cookie cookies gdpr navbar newsletter pagination sidebar "
    "signup sponsored".split()
)
#: What makes such a part the state of a page: has-sidebar, comments-open.
STATE_BEFORE = frozenset("has no with without is".split())
STATE_BEHIND = frozenset("open closed enabled disabled allowed".split())
#: Names of an article that is a comment.
COMMENT_ARTICLE = frozenset("comment comments reply replies".split())
#: An opening tag that ends open ones: tag -> (tags it ends, tags it cannot look past).
P_ENDERS = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend"}
NO_P = BLOCKS - {"p"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SMOOTH = np.array([0.25, 0.5, 0.25])
THRESHOLD = 0.5
#: What is left of the ratios of a path through an element with such a name.
NAMED_WEIGHT = 0.1
#: What an article or main element makes of the scores inside.
INSIDE_WEIGHT = 2.0
#: What a path made for text gets of the score of the one before or behind it.
NEIGHBOUR_SHARE = 0.5


class Node:
    """An open element: its path, and what its ancestors make of its text."""

    __slots__ = ("tag", "path", "hidden", "boiler", "inside", "textual", "headline", "link", "named")

    def __init__(
        self, tag: str, attributes: str, parent: Node | None, numbers: dict[tuple, int], outer_names: list[tuple[int, bool]]
    ) -> None:
        """`outer_names` gets an entry for each element with a hint: the number of the one around it, or -1,
        and whether it holds the comments of the article around it."""
        self.tag = tag
        above = parent.path if parent else -1
        self.path = numbers.setdefault((above, tag), len(numbers)) if tag in BLOCKS else above
        self.textual = tag in TEXTUAL if tag in BLOCKS else bool(parent and parent.textual)
        self.link = bool(parent and parent.link) or tag == "a"
        self.headline = bool(parent and parent.headline) or tag == "h1"
        around = parent.inside if parent else 0
        hinted, readers, hidden = _hints(attributes, tag, around)
        self.named = parent.named if parent else -1
        if hinted:
            outer_names.append((self.named, readers))
            self.named = len(outer_names) - 1
        self.inside = max(around, CONTAINERS.get(tag, 0))
        self.hidden = bool(parent and parent.hidden) or tag in HIDDEN or hidden
        page_header = tag == "header"
        self.boiler = bool(parent and parent.boiler) or tag in BOILER or page_header
        if self.boiler and tag in HEADINGS and parent and parent.boiler == "header" and self.inside:
            self.boiler = False  # the headline in an article's own header
        elif page_header and self.inside and not (parent and parent.boiler):
            self.boiler = "header"
        elif parent and parent.boiler == "header" and tag not in BOILER:
            self.boiler = "header"


def _hints(attributes: str, tag: str, around: int) -> tuple[bool, bool, bool]:
    """Whether the element has a name of boilerplate, one of comments inside an article, and whether it is hidden."""
    named = readers = hidden = False
    if not attributes:
        return named, readers, hidden
    for found in ATTRIBUTE.finditer(attributes):
        name = found[1].lower()
        value = found[2] or found[3] or found[4] or ""
        if name in ("class", "id", "role"):
            for token in value.split():
                if tag in UNNAMED:
                    named = named or (tag == "article" and token.lower() in COMMENT_ARTICLE)
                    continue
                parts = [x.lower() for x in CUE.findall(token) if not x.isdigit()]
                named = named or _is_cue(token.lower(), parts, READERS if around else TELLING)
                readers = readers or (around == 2 and _is_cue("", parts, READERS, every=False))
        elif name == "style":
            hidden = hidden or bool(NO_DISPLAY.search(value))
        elif name == "hidden":
            hidden = True
    return named, readers, hidden


def _is_cue(token: str, parts: list[str], telling: frozenset, every: bool = True) -> bool:
    """Whether a class token hints at boilerplate: as a whole, by all its parts, or by a telling one."""
    if every and (token in CUES or (parts and all(x in CUES for x in parts))):
        return True
    if not parts or parts[0] in STATE_BEFORE or parts[-1] in STATE_BEHIND:
        return False
    return not telling.isdisjoint(parts)


def _named(runs: list[tuple[Node, str, bool]], outer_names: list[tuple[int, bool]]) -> list[bool]:
    """For each element with a hint, whether it or one around it is small enough for the hint to count."""
    size, within = [0] * len(outer_names), [0] * len(outer_names)
    total = article = 0
    for node, text, _ in runs:
        if not node.boiler:
            n = _bare(text)
            total += n
            article += n * bool(node.inside)
            if node.named >= 0:
                size[node.named] += n
                within[node.named] += n * bool(node.inside)
    for i in range(len(size) - 1, -1, -1):  # inner elements have greater numbers
        outer = outer_names[i][0]
        if outer >= 0:
            size[outer] += size[i]
            within[outer] += within[i]
    named: list[bool] = []
    for i, (outer, readers) in enumerate(outer_names):
        beside_article = article > 0 and not within[i]
        below_article = readers and within[i] < article
        named.append(2 * size[i] <= total or beside_article or below_article or (outer >= 0 and named[outer]))
    return named


def _bare(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n")


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, ""); a cut-off tag ends the page."""
    at, size = 0, len(page)
    while at < size:
        low = page.find("<", at)
        if low < 0:
            yield "text", page[at:], ""
            return
        if low > at:
            yield "text", page[at:low], ""
        following = page[low + 1 : low + 2]
        if page.startswith("<!--", low):
            if page.startswith(("<!-->", "<!--->"), low):
                at = page.find(">", low) + 1
                continue
            end = page.find("-->", low + 4)
            at = size if end < 0 else end + 3
        elif following in ("!", "?") or (following == "/" and not page[low + 2 : low + 3].isalpha()):
            end = page.find(">", low)
            at = size if end < 0 else end + 1
        elif following.isalpha() and following.isascii() or following == "/":
            found = TAG.match(page, low)
            if not found:  # an unclosed quote: the tag then ends at its first bracket
                end = page.find(">", low)
                if end < 0:
                    return
                name = re.match(r"</?([A-Za-z][^\s/>]*)", page[low:end])
                closing, tag, attributes, at = following == "/", name[1] if name else "", "", end + 1
            else:
                closing, tag, attributes, at = bool(found[1]), found[2], found[3], found.end()
            tag = tag.lower()
            if closing:
                yield "close", tag, ""
                continue
            yield "open", tag, attributes
            if tag in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                inner = page[at : end.start() if end else size]
                if inner:
                    yield "text", inner, ""
                at = end.start() if end else size
        else:
            yield "text", "<", ""
            at = low + 1


def _runs(page: str, outer_names: list[tuple[int, bool]]) -> Iterator[tuple[Node, str, bool]]:
    """(node, text, new block) for each visible run of text, in page order; `outer_names` as in Node."""
    numbers: dict[tuple, int] = {}
    stack = [Node("html", "", None, numbers, outer_names)]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag, so that nothing is searched for
    fresh = True
    for kind, value, attributes in _tokens(page):
        top = stack[-1]
        if kind == "text":
            if not top.hidden:
                yield top, value, fresh
                fresh = False
            continue
        if value in BLOCKS:
            fresh = True
        if kind == "open":
            if value == "br":
                if not top.hidden:
                    yield top, " ", fresh
                continue
            if value in VOID:
                continue
            if value == "html":
                continue
            if value in P_ENDERS:
                _close(stack, places, ("p",), NO_P)
            elif value in SIBLINGS:
                _close(stack, places, *SIBLINGS[value])
            if not (attributes.endswith("/") and value not in BLOCKS and value not in RAW):
                places[value].append(len(stack))
                stack.append(Node(value, attributes, stack[-1], numbers, outer_names))
        elif value not in ("html", "body"):
            _close(stack, places, (value,), ())


def _close(stack: list[Node], places: dict[str, list[int]], tags: Iterable[str], barriers: Iterable[str]) -> None:
    """End the innermost open element of `tags`, and what it holds, unless a barrier is nearer."""
    at = max((places[t][-1] for t in tags if places.get(t)), default=0)
    if not at or any(places[t][-1] > at for t in barriers if places.get(t)):
        return
    for node in reversed(stack[at:]):
        places[node.tag].pop()
    del stack[at:]


class _Path:
    """Sums over all nodes of one root-to-leaf path."""

    __slots__ = ("order", "nodes", "length", "marks", "linked", "boiler", "textual", "headline", "inside", "weight")

    def __init__(self, order: int, node: Node, named: bool) -> None:
        self.order, self.nodes, self.length, self.marks, self.linked = order, 0, 0, 0, 0
        self.boiler, self.inside, self.textual, self.headline = bool(node.boiler), node.inside, node.textual, node.headline
        self.weight = NAMED_WEIGHT if named else 1.0


def _content_paths(paths: dict[tuple, _Path]) -> set[tuple]:
    """Paths whose smoothed and fused ratios reach the threshold, and those that an article keeps."""
    free = sorted(((k, p) for k, p in paths.items() if not p.boiler), key=lambda x: x[1].order)
    if not free:
        return set()
    # Names weigh down what a path gives to its neighbours and what it gets from them.
    weight = np.array([p.weight for _, p in free])
    length = weight * np.array([(p.length - p.linked) / max(p.nodes, 1) for _, p in free])
    marks = weight * np.array([p.marks / max(p.nodes, 1) for _, p in free])
    unlinked = np.array([1 - p.linked / p.length for _, p in free])
    inside = np.array([INSIDE_WEIGHT if p.inside else 1.0 for _, p in free])
    own = weight * unlinked * inside
    textual = np.array([p.textual for _, p in free])
    score = own * _smoothed(length) * (1 + _smoothed(marks))
    score = np.where(textual, score, np.minimum(score, own * length * (1 + marks)))
    bound = min(THRESHOLD * score.std(), score.max())
    beside = np.maximum(np.append(0, score[:-1]), np.append(score[1:], 0))
    score = np.maximum(score, NEIGHBOUR_SHARE * textual * weight * unlinked * beside)
    by_ratio = score >= bound
    held = np.array([p.inside > 0 for _, p in free]) & (weight == 1) & (unlinked >= 0.5) & (textual | (marks > 0))
    kept = [(k, p, r) for (k, p), r, h in zip(free, by_ratio, held) if r or h]
    nearest = _nearest(kept)
    return {k for k, p, r in kept if not _outside(p, bool(r), nearest)}


def _nearest(kept: list[tuple[tuple, _Path, bool]]) -> _Path | None:
    """The first kept path in an article, or else in a main element, if one of its kind holds a sentence."""
    for inside in (2, 1):
        of_kind = [p for _, p, _ in kept if p.inside == inside]
        if any(p.marks for p in of_kind):
            return min(of_kind, key=lambda p: p.order)
    return None


def _outside(path: _Path, by_ratio: bool, nearest: _Path | None) -> bool:
    """Whether a path is beside or behind the article; text of its main element and a headline may go before it."""
    if nearest is None or path.inside >= nearest.inside:
        return False
    return path.order > nearest.order or not (path.inside or (path.headline and by_ratio))


def _smoothed(values: np.ndarray) -> np.ndarray:
    padded = np.concatenate([values[:1], values, values[-1:]])
    return np.convolve(padded, SMOOTH, mode="valid")


def main_text(page: str) -> str:
    """Blocks of the main text, joined by line feeds; empty if there is none."""
    blocks: list[list[tuple[tuple, str]]] = []
    paths: dict[tuple, _Path] = {}
    current: list[tuple[tuple, str]] = []
    outer_names: list[tuple[int, bool]] = []
    runs = list(_runs(page, outer_names))
    named = _named(runs, outer_names)
    for node, raw, fresh in runs:
        if fresh and current:
            blocks.append(current)
            current = []
        text = html.unescape(raw)
        by_name = node.named >= 0 and named[node.named]
        key = (node.path, bool(node.boiler), node.inside, by_name)
        path = paths.get(key)
        if path is None:
            path = paths[key] = _Path(len(paths), node, by_name)
        current.append((key, text))
        bare = _bare(text)
        if bare:
            path.nodes += 1
            path.length += bare
            path.marks += len(MARKS.findall(text))
            path.linked += bare * node.link
    blocks.append(current)
    content = _content_paths({k: p for k, p in paths.items() if p.length})
    out = []
    for block in blocks:
        text = SPACE.sub(" ", "".join(t for key, t in block if key in content or (not t.strip() and not key[1]))).strip()
        if text:
            out.append(text)
    return "\n".join(out)


def _extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in values(pages)], pa.string())


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """Add `text` and `n_chars` (code points) to `pages`; columns so named are replaced.

    NULL, empty and text-free pages give an empty text. Cut-off tags and comments at
    the end of a page are left out, elements left open reach to its end.
    """
    out = pages.withColumn(name, struct_udf(_extract, "string")(text_of(html_col)))
    return out.withColumn("n_chars", F.char_length(name).cast("bigint"))
