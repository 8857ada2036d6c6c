"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and
identifier cues. From each anchor a small local parser reads the longest span that
can belong to it, to the left and to the right, and validates it. No parser leaves
the neighbourhood of its anchor, and stretches that a parser has read are not read
again by it, so the work grows with the text whatever it holds.

Base kinds: email, ip, card, phone. Kinds the method adds: iban, account (digits
behind an account cue), ssn (behind its cue), login (user and password in front of
a host), address (a house number and a street name that ends or begins with a street cue).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.rows import struct_udf, structs, text_of, values, with_fields

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "account", "ssn", "login", "address")
KINDS = BASE + ADDED
RANK = {kind: i for i, kind in enumerate(KINDS)}

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:[ ]?(?:number|num|no|nr|#))?[.:#= ]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9A-Za-z])", re.I)
SSN = re.compile(r"[.:#= ]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
LOGIN = re.compile(r"[^\s/@:?#]{1,64}:[^\s/@?#]{1,64}@[^\s/@:?#]{1,255}")
HOUSE_FIRST = re.compile(r"[0-9]{1,5}[A-Za-z]? (?:[A-Z][\w'.-]{0,30} ){1,4}$")
HOUSE_LAST = re.compile(r" (?:[A-Z][\w'.-]{0,30}|de|la|del|des|du) ?(?:[\w'.-]{1,30} ){0,4}[0-9]{1,5}(?!\w)")
STREET_REACH = 160

#: Cues in the spellings that are looked for; each list belongs to one parser.
ACCOUNT_CUES = ("account", "acct", "a/c", "kontonummer", "konto", "cuenta", "compte")
SSN_CUES = ("ssn", "social security number", "social security")
STREETS_BEHIND = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive")
STREETS_BEFORE = ("Rue", "Calle", "Avenida", "Avenue")


def luhn(digits: str) -> bool:
    """Check digit of a card number."""
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def iban_valid(text: str) -> bool:
    """Check digits of an account number: the rearranged number is 1 modulo 97."""
    plain = text.replace(" ", "")
    moved = plain[4:] + plain[:4]
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@cache
def automaton() -> ahocorasick.Automaton:
    """Anchors with the parser that each belongs to and their length."""
    found: dict[str, set[str]] = {}
    for word, parser in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((str(d), "digit") for d in range(10))]:
        found.setdefault(word, set()).add(parser)
    for cues, parser in ((ACCOUNT_CUES, "account"), (SSN_CUES, "ssn")):
        for cue in cues:
            for spelling in (cue, cue.upper(), cue.capitalize()):
                found.setdefault(spelling, set()).add(parser)
    for cue in STREETS_BEHIND:
        found.setdefault(" " + cue, set()).add("street_behind")
    for cue in STREETS_BEFORE:
        found.setdefault(cue + " ", set()).add("street_before")
    out = ahocorasick.Automaton()
    for word, parsers in found.items():
        out.add_word(word, (len(word), tuple(sorted(parsers))))
    out.make_automaton()
    return out


class Scan:
    """Spans of one text; the `..._from` marks are where a kind may begin again."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans: list[tuple[int, int, str]] = []
        self.email_from = self.ip_from = self.digits_from = 0

    def run(self) -> list[tuple[int, int, str]]:
        for last, (length, parsers) in automaton().iter(self.text):
            for parser in parsers:
                getattr(self, parser)(last - length + 1, last + 1)
        taken = {(s, e) for s, e, kind in self.spans if kind in BASE}
        spans = {x for x in self.spans if x[2] in BASE or x[:2] not in taken}
        return sorted(spans, key=lambda x: (x[0], RANK[x[2]], x[1]))

    def at(self, start: int, end: int) -> None:
        left, text = start, self.text
        while left > self.email_from and text[left - 1] in LOCAL_PART:
            left -= 1
        if left < start and (domain := DOMAIN.match(text, end)):
            self.spans.append((left, domain.end(), "email"))
            self.email_from = domain.end()

    def plus(self, start: int, end: int) -> None:
        if found := PHONE.match(self.text, start):
            if 9 <= sum(map(str.isdigit, found[0])) <= 15:
                self.spans.append((start, found.end(), "phone"))

    def digit(self, start: int, end: int) -> None:
        text = self.text
        begins = not start or text[start - 1] not in "0123456789"
        if begins and start >= self.ip_from and (found := IP.match(text, start)):
            self.ip_from = found.end()
            if all(_at_most_255(part) for part in found.groups()):
                self.spans.append((start, found.end(), "ip"))
        if start >= self.digits_from and (found := DIGITS.match(text, start)):
            self.digits_from = found.end()
            plain = found[0].replace(" ", "").replace("-", "") if found.end() - start <= 40 else ""
            if 12 <= len(plain) <= 19 and luhn(plain):
                self.spans.append((start, found.end(), "card"))
        if begins and start >= 2 and (found := IBAN.match(text, start - 2)):
            if not (start >= 3 and text[start - 3].isalnum()):
                self.iban(found)

    def iban(self, found: re.Match) -> None:
        """The longest valid number that ends with a group of characters."""
        candidate = found[0]
        while len(candidate) >= 15:
            if iban_valid(candidate):
                self.spans.append((found.start(), found.start() + len(candidate), "iban"))
                return
            candidate = candidate.rpartition(" ")[0]

    def account(self, start: int, end: int) -> None:
        if self._begins_word(start) and (found := ACCOUNT.match(self.text, end)):
            self.spans.append((*found.span(1), "account"))

    def ssn(self, start: int, end: int) -> None:
        if self._begins_word(start) and (found := SSN.match(self.text, end)):
            area, group, serial = found[1].split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                self.spans.append((*found.span(1), "ssn"))

    def scheme(self, start: int, end: int) -> None:
        if found := LOGIN.match(self.text, end):
            self.spans.append((*found.span(), "login"))

    def street_behind(self, start: int, end: int) -> None:
        if not self.text[end : end + 1].isalpha():
            near = max(start - STREET_REACH, 0)
            if found := HOUSE_FIRST.search(self.text[near : start + 1]):
                self.spans.append((near + found.start(), end, "address"))

    def street_before(self, start: int, end: int) -> None:
        if self._begins_word(start) and (found := HOUSE_LAST.match(self.text, end - 1)):
            self.spans.append((start, found.end(), "address"))

    def _begins_word(self, start: int) -> bool:
        return not start or not self.text[start - 1].isalnum()


def _at_most_255(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start, then kind."""
    return Scan(text).run()


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str) -> str:
    """Text with every stretch of overlapping spans replaced by the kind of its first."""
    out, done = [], 0
    for start, end, kind in _merged(find_spans(text)):
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def _merged(spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    held: tuple[int, int, str] | None = None
    for start, end, kind in spans:
        if held and start < held[1]:
            held = (held[0], max(held[1], end), held[2])
        else:
            if held:
                yield held
            held = (start, end, kind)
    if held:
        yield held


COLUMNS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def _finder(texts: pa.Array) -> pa.Array:
    counts: list[list[int]] = [[] for _ in BASE]
    digests, spans = [], []
    for text in values(texts):
        found = find_spans(text)
        base = [x for x in found if x[2] in BASE]
        for kind, column in zip(BASE, counts):
            column.append(sum(x[2] == kind for x in base))
        digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
        spans.append(joined(found))
    whole = [pa.array(c, pa.int64()) for c in counts]
    return structs(COLUMNS, (*whole, pa.array(digests, pa.string()), pa.array(spans, pa.string())))


def _redactor(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else redacted(t) for t in values(texts)], pa.string())


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add counts of the base kinds, their digest and all spans to `docs`.

    NULL and empty texts have no spans. Columns so named are replaced, others stay,
    repeated rows are treated alike, and an empty table gives no rows.
    """
    counts = ", ".join(f"{c} bigint" for c in COLUMNS[:4])
    find = struct_udf(_finder, f"struct<{counts}, base_sha256 string, spans string>")
    return with_fields(docs, find(text_of(text)), COLUMNS)


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """`docs` with personal data replaced by the kind in brackets; a NULL text stays.

    A column named `length`, if there is one, gets the new number of code points.
    """
    out = docs.withColumn(text, struct_udf(_redactor, "string")(F.col(text).cast("string")))
    if length in docs.columns:
        changed = F.char_length(F.col(text)).cast(docs.schema[length].dataType)
        out = out.withColumn(length, F.when(F.col(text).isNotNull(), changed).otherwise(F.col(length)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
