"""Repeated bytes, spelling variants and the prefix trie against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from reviewloom.llm import bwt_dedup, prefix_trie, queries, spelling

# Repeated bytes


def plain_repeats(docs):
    """{row number: flags of removed bytes} of (doc_id, text) rows."""
    order = [(d is None, d or 0, (t or "").encode()) for d, t in docs]
    first = {}
    for none, d, raw in order:
        for p in range(len(raw) - 99):
            first[raw[p : p + 100]] = min(first.get(raw[p : p + 100], (none, d, p)), (none, d, p))
    out = []
    for none, d, raw in order:
        gone = [False] * len(raw)
        for p in range(len(raw) - 99):
            if first[raw[p : p + 100]] < (none, d, p):
                gone[p : p + 100] = [True] * 100
        out.append((raw, gone))
    return out


def plain_result(docs):
    rows = []
    for (d, _), (raw, gone) in zip(docs, plain_repeats(docs)):
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rows.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=repr)


def passages(seed=5, n=24):
    """Texts that share passages of all lengths around the limit, copies and runs of one letter."""
    rng = random.Random(seed)
    syllables = ["the", "tion", "ea", "nd", "é", "wh", "re ", "th ", "\n"]

    def prose(k):
        return "".join(rng.choice(syllables) for _ in range(k))

    shared = [prose(60), prose(45), prose(300)]
    docs = []
    for i in range(n):
        text = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) - 80)
            text += s[a : a + rng.randint(60, 160)] + prose(rng.randint(0, 20))
        docs.append((i, text))
    docs += [(n, docs[3][1]), (n + 1, docs[3][1]), (n + 2, "a" * 450), (n + 3, "ab" * 130 + "a" * 130), (3, docs[5][1])]
    docs += [(None, docs[4][1]), (None, docs[4][1]), (n + 5, None), (n + 6, ""), (n + 7, "x" * 99), (n + 8, docs[7][1]), (n + 8, docs[7][1])]
    return docs


@pytest.mark.parametrize("merged_segments", [50_000, 2])
def test_repeated_bytes_equal_brute_force(spark, merged_segments):
    docs = passages()
    rng = random.Random(1)
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, doc string")
    found = bwt_dedup.repeated_bytes(df, merged_segments=merged_segments)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_result(docs)


def test_texts_without_repeats_and_clashing_columns(spark):
    docs = passages(8, 12)
    df = spark.createDataFrame([(d, t, "own") for d, t in docs], "doc_id bigint, text string, own string")
    rest = bwt_dedup.without_repeats(df)
    assert rest.columns == df.columns
    want = []
    for (d, t), (raw, gone) in zip(docs, plain_repeats(docs)):
        kept = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "replace")
        want.append((d, None if t is None else kept, "own"))
    assert sorted((tuple(r) for r in rest.collect()), key=repr) == sorted(want, key=repr)


def test_repeated_bytes_of_no_rows_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bwt_dedup.repeated_bytes(empty).collect() == []
    rng = random.Random(2)
    long = "".join(chr(rng.randrange(97, 123)) for _ in range(2_000_000))
    df = spark.createDataFrame([(1, long), (2, "y" + long[1_000_000:])], "doc_id bigint, text string")
    assert [tuple(r)[1:4] for r in bwt_dedup.repeated_bytes(df).orderBy("doc_id").collect()] == [(2_000_000, 0, 0), (1_000_001, 1_000_000, 1)]


def test_registered_repeated_bytes_equal_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op11_repeated_bytes(spark, sf).collect()), key=repr) == plain_result(docs)


def test_shards_merge_to_the_order_of_one_shard():
    rng = random.Random(4)
    segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(100, 168))) for _ in range(40)]
    segments += segments[:5]
    left = [len(s) - 100 for s in segments]
    doc = list(range(len(segments)))
    import numpy as np

    columns = np.array(left), np.array(doc), np.zeros(len(doc), np.int64)
    assert (bwt_dedup.later_windows(segments, *columns, shards=1) == bwt_dedup.later_windows(segments, *columns, shards=7)).all()


# Spelling variants


def plain_variants(docs):
    n = Counter()
    for d, text in docs:
        low = (text or "").translate(str.maketrans(spelling.UPPER, spelling.LOWER))
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
            run = ""
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(set)
    for a in words:
        for b in words:
            if a == b or abs(len(a) - len(b)) > 1:
                continue
            long, short = (a, b) if len(a) >= len(b) else (b, a)
            i = next((i for i, (x, y) in enumerate(zip(long, short)) if x != y), len(short))
            if long[i + 1 :] == (short[i + 1 :] if len(long) == len(short) else short[i:]):
                near[a].add(b)
    form = {}
    for w, c in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * c:
            form[w] = best
    rows = []
    for w, c in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, c, len(near[w]), form.get(w), words[form[w]] if w in form else None, root))
    return sorted(rows)


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["station", "stations", "statión", "naïvely", "stampede", "différence", "zzzzzzzz", "z" * 300]
    docs = [(i, " ".join(rng.choices(base, [400, 30, 3, 9, 5, 5, 2, 1], k=40)) + "; STATION") for i in range(60)]
    letters = "abcdeé"
    for i in range(200):
        w = rng.choice(base)
        k = rng.randrange(len(w))
        docs.append((100 + i % 7, " ".join([w[:k] + rng.choice(letters) + w[k + rng.randint(0, 1) :]] * 2)))
    docs += [(None, "station stations"), (5, None), (5, ""), (5, "short words"), (6, docs[0][1]), (6, docs[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, word int")
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    found = spelling.spelling_variants(df).select(columns)
    want = plain_variants(docs)
    assert any(r[3] and r[5] != r[3] for r in want)  # chains of forms take part
    assert sorted(tuple(r) for r in found.collect()) == want


def test_signatures_meet_for_every_edit(spark):
    words = ["conversation"]
    for i in range(13):
        words += ["conversation"[:i] + "q" + "conversation"[i:], "conversation"[:i] + "é" + "conversation"[i + 1 :]]
        words += ["conversation"[:i] + "conversation"[i + 1 :]]
    words = sorted(set(words))
    pairs = {tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {w for p in pairs if "conversation" in p for w in p} == set(words)


def test_spelling_variants_of_no_rows(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


# Prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        digest = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        parent = members[p[:-1]][0] if p else None
        out.append((m[0], len(p), parent, len(m), children[p], sum(not children[q] for q in under), saved, digest))
    return sorted(out, key=repr)


def conversations(seed, n, long=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.randint(1, 11)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "né", ""])))
    rows += [(7, 900, None, "x"), (7, None, "user", None), (None, 1, "user", "lost"), (8, 30, "user", "tie"), (8, 30, "assistant", "tie"), (8, 30, "user", "tie")]
    rows += [(1000 + k, t, "user", "same") for k in range(6) for t in range(3)]
    rows += [(2000, t, "user", f"{t % 3}") for t in range(long)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece", [1024, 2])
def test_prefix_trie_equals_brute_force(spark, monkeypatch, piece):
    rows = conversations(1, 60, 30)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    monkeypatch.setattr(prefix_trie.running, "__defaults__", (piece,))
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int")
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr) == plain_trie(rows)


def test_prefix_trie_of_no_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


def test_registered_prefix_trie_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_prefix_trie(spark, sf).collect()), key=repr) == plain_trie(rows)
