"""Near-duplicates by SimHash: fingerprints, BK-trees per shard, components.

A fingerprint has 64 bits; texts whose fingerprints differ in at most three bits
are linked. Exact copies are folded first: trees hold distinct fingerprints only.

Shards. If two fingerprints differ in at most three bits, at least one of four
16-bit blocks is equal in both; the other 48 bits, cut into four pieces of 12 bits,
have an equal piece for the same reason. So a pair meets in at least one of 16
shards, each named by 28 equal bits, and a shard holds few fingerprints unless they
are truly close. Each shard has a BK-tree; a search follows only the edges whose
distance is within the radius. Trees travel with their own queries in one shuffle
instead of being broadcast: all trees together grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.rows import bytes_of, struct_udf, values
from reviewloom.operators.density import connected_components
from reviewloom.session import stored

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
TREE_NODES = 4096
CHUNK = 65_536


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's word shingles, as an unsigned integer; no words give zero."""
    words = text.lower().split()
    if not words:
        return 0
    runs = max(len(words) - width + 1, 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, runs, CHUNK):
        part = words[start : min(start + CHUNK, runs) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > runs, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    prints = np.array([fingerprint(t or b"") for t in values(texts)], dtype=np.uint64)
    return pa.array(prints.view(np.int64))


class BKTree:
    """Distinct integers; children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.edges.append({})
        at = 0
        while new:
            distance = (self.values[at] ^ value).bit_count()
            child = self.edges[at].setdefault(distance, new)
            if child == new:
                return
            at = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions of the stored values at most `radius` away."""
        pending = [0] if self.values else []
        while pending:
            at = pending.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            edges = self.edges[at]
            for d in range(max(distance - radius, 0), distance + radius + 1):
                if d in edges:
                    pending.append(edges[d])


class _Groups:
    """Union-find over positions, the root being the one with the smallest node."""

    def __init__(self, nodes: list[int]) -> None:
        self.nodes = nodes
        self.parent = list(range(len(nodes)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            low, high = (a, b) if self.nodes[a] <= self.nodes[b] else (b, a)
            self.parent[high] = low

    def links(self) -> Iterator[tuple[int, int]]:
        for i in range(len(self.nodes)):
            if self.parent[i] != i:
                yield self.nodes[i], self.nodes[self.root(i)]


def shard_links(prints: list[int], nodes: list[int], member: list[bool], radius: int) -> Iterator[tuple[int, int]]:
    """Star links (node, smallest node) that connect all pairs a shard's tree shows as close."""
    tree, places, groups = BKTree(), [], _Groups(nodes)
    for i, value in enumerate(prints):
        if member[i]:
            tree.add(value)
            places.append(i)
    for i, value in enumerate(prints):
        for at in tree.within(value, radius):
            groups.join(i, places[at])
    return groups.links()


def _link_shards(radius: int):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of rows sorted by shard, each table ending where a shard ends."""
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            shard, slice_ = rows["shard"].to_numpy(), rows["slice"].to_numpy()
            starts = np.flatnonzero((shard[1:] != shard[:-1]) | (slice_[1:] != slice_[:-1])) + 1
            cut = int(starts[-1]) if len(starts) else 0
            if cut:
                yield rows.slice(0, cut)
            rest = rows.slice(cut)
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in shards(batches):
            shard, slice_ = rows["shard"].to_numpy(), rows["slice"].to_numpy()
            prints = rows["fp"].to_numpy().view(np.uint64)
            nodes, member = rows["node"].to_numpy(), rows["member"].to_numpy()
            new = np.flatnonzero((shard[1:] != shard[:-1]) | (slice_[1:] != slice_[:-1])) + 1
            bounds = np.concatenate([[0], new, [len(shard)]])
            links: list[tuple[int, int]] = []
            for k in np.flatnonzero(np.diff(bounds) > 1):  # a shard of one row links nothing
                own = slice(bounds[k], bounds[k + 1])
                links += shard_links(prints[own].tolist(), nodes[own].tolist(), member[own].tolist(), radius)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    return run


def _with_shards(classes: DataFrame) -> DataFrame:
    """16 rows for each fingerprint, one for each choice of equal bits (see the module)."""
    fp = F.col("fp")
    keys = []
    for block in range(4):
        equal = F.shiftrightunsigned(fp, 16 * block).bitwiseAND(F.lit(0xFFFF))
        others = [b for b in range(4) if b != block]
        rest = F.lit(0).cast("long")
        for place, b in enumerate(others):
            piece = F.shiftrightunsigned(fp, 16 * b).bitwiseAND(F.lit(0xFFFF))
            rest = rest.bitwiseOR(F.shiftleft(piece, 16 * place))
        for part in range(4):
            piece = F.shiftrightunsigned(rest, 12 * part).bitwiseAND(F.lit(0xFFF))
            name = F.lit(4 * block + part).cast("long")
            keys.append(F.shiftleft(name, 28).bitwiseOR(F.shiftleft(equal, 12)).bitwiseOR(piece))
    return classes.select("fp", "node", F.explode(F.array(*keys)).alias("shard"))


def similar_links(classes: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(a, b) links between the nodes of (fp, node), enough to connect every close pair.

    A shard of more than `tree_nodes` fingerprints is cut into slices with a tree
    each; all its fingerprints ask every slice, so no task holds a large tree and no
    pair is lost. Links are stars inside a shard, at most one row for each row read.
    """
    if not 0 <= radius <= 3:
        raise ValueError("shards are made for a radius of 0 to 3 bits")
    rows = _with_shards(classes)
    large = stored(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tree_nodes))
    slices = F.coalesce(F.ceil(F.col("n") / tree_nodes), F.lit(1)).cast("int")
    asked = rows.join(large, "shard", "left").withColumn("slices", slices)
    home = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    dealt = asked.select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
        "fp",
        "node",
        home.alias("home"),
    ).select("shard", "slice", "fp", "node", (F.col("home") == F.col("slice")).alias("member"))
    return (
        dealt.repartition("shard", "slice")
        .sortWithinPartitions("shard", "slice", "node")
        .mapInArrow(_link_shards(radius), "a bigint, b bigint")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of `docs`.

    `fingerprint` is a signed number, `component_id` the smallest id that can be
    reached over links of at most `radius` differing bits, the row's own included.
    Texts without words (NULL, empty) have fingerprint zero and link like any other.
    Repeated rows stay; a row without an id takes the component of its
    fingerprint and is NULL if no row with that fingerprint has an id. Other
    columns of `docs` are ignored; an empty table gives no rows.
    """
    ids = F.col(id_col).cast("bigint").alias("doc_id")
    marked = docs.select(ids, struct_udf(_fingerprints, "bigint")(bytes_of(text)).alias("fp"))
    prints = stored(marked)
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    linked = connected_components(similar_links(classes.filter("node IS NOT NULL"), radius))
    moved = stored(
        classes.join(linked, "node")
        .filter("component <> node")
        .select("fp", F.col("component").alias("moved_to"))
    )
    placed = classes.join(moved, "fp", "left").select("fp", F.coalesce("moved_to", "node").alias("component_id"))
    return prints.join(placed, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row for each component: the one with the smallest id.

    Rows that share an id count as one document: of these, the row with the smallest
    hash of all its columns stays, equal rows being interchangeable. Rows without an
    id cannot be named in a group and stay as they are. Texts are read twice, once
    for the fingerprints and once for the result, and move only in the last join.
    """
    key = F.col(f"`{id_col}`").cast("bigint")
    found = near_duplicates(docs.filter(key.isNotNull()), id_col, text)
    leaders = stored(found.filter("doc_id = component_id").select(F.col("doc_id").alias("_leader")).distinct())
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_leader"))
    order = F.xxhash64(F.to_json("_row"))
    rows = own.join(leaders, "_leader", "left_semi").groupBy("_leader").agg(F.min_by("_row", order).alias("_row"))
    return rows.select("_row.*").unionByName(docs.filter(key.isNull()))
