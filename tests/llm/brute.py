"""Plain versions of the operators, and rows that are hard to treat."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, spans int, label string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def held(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def hard_docs(spark):
    """NULLs in every column, empty and very long texts, repeated rows, clashing column names."""
    long = " ".join(f"word{i % 977} of a long text, line {i}\n" for i in range(20_000))
    texts = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, None, 4),
        (4, long, "en", "b", len(long)),
        (5, long + " and more", "en", "b", len(long) + 9),
        (6, "Write to a.b@mail.example.com or +1 (499) 555-6503 today", "en", "a", 56),
        (6, "Write to a.b@mail.example.com or +1 (499) 555-6503 today", "en", "a", 56),
        (None, "a row without an id but with some words in it", "en", None, 45),
        (7, "one two three", "de", "b", 13),
        (8, "One  two\nthree", "de", "b", 14),
        (9, "12345 !!! 678", None, "a", 13),
        (10, "été über niño \U0001f600 x" * 30, "fr", "c", 660),
    ]
    rows = [(*r, None if i % 2 else "x", i, "y") for i, r in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, key="doc_id"):
    """Rows as dictionaries, in an order that does not depend on Spark."""
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0, repr(r)))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text):
    text = text or ""
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m))
    found += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    order = ["email", "ip", "card", "phone"]
    spans = sorted((m.start(), order.index(k), m.end(), k) for k, m in found)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    counts = Counter(k for k, _ in found)
    return [counts[k] for k in order], hashlib.sha256(joined.encode()).hexdigest()


def repeated(text, window=8):
    w = words(text)
    runs = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
    counts = Counter(runs)
    return len({i + k for i, r in enumerate(runs) if counts[r] > 1 for k in range(window)})


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    """Smallest id reachable for each (id, fingerprint)."""
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def contamination(text, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w = split(text)
    hit, names = set(), set()
    for name, item in items:
        parts = split(item)
        size = min(window, len(parts))
        for i in range(len(parts) - size + 1 if parts else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == parts[i : i + size]:
                    hit.update(range(j, j + size))
                    names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)


def base_scores(docs, model_part):
    """(doc_id, n_tokens, n_known, base score) and the number of training tokens."""
    tokens = lambda t: [*words(lower(t)), "\n"]
    counts = Counter(t for d, text in docs if model_part(d) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, text in docs:
        mine = tokens(text)
        score = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in mine)
        out.append((d, len(mine), sum(counts[t] > 0 for t in mine), score))
    return out, n


def mix_targets(sizes):
    """Targets of {source: size} by sharing again until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}
