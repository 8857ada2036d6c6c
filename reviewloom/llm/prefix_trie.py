"""Prefix trie of conversations by whole-sequence collapse.

Conversations are rebuilt first: each takes over the opening turns of the conversation
it was branched from. Identical rebuilt conversations collapse into one sequence with a
weight (how many there are) and a list of their ends. Sequences that are proper prefixes
of others are dropped by an anti join; what stays are the leaves, whose prefixes are all
nodes of the trie. Weighted prefixes are then aggregated.

A prefix is named by the XOR of hashes of (place, role, text), 128 bits wide. So a name
can be summed piece by piece: no task needs a whole conversation, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.rows import text_of
from reviewloom.operators.ranking import join_counted
from reviewloom.session import stored

FAMILY = 5
HEAD_TURNS = 9
#: Running totals are made in pieces of so many places.
PIECE = 1_024
#: Ends are listed in pieces by ranges of so many ids.
IDS = 65_536


def slim_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, c1, c2, bytes): hashes instead of texts."""
    role, text = text_of("role"), text_of("text")
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("c1"),
        F.xxhash64(F.lit(2), role, text).alias("c2"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    return rows.filter("conv_id IS NOT NULL")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`rows` with their 1-based `place` in the order of a key; NULL comes first.

    Rows are dealt by ranges of (key, order), so a key with most of the rows is
    spread over many tasks; places inside a range are then moved by the rows before it.
    """
    dealt = stored(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", key).orderBy(*order)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    moved = parts.select(key, "_part", F.sum("_rows").over(before).alias("_before")).filter("_before IS NOT NULL")
    placed = dealt.withColumn("place", F.row_number().over(within).cast("bigint")).join(moved, [key, "_part"], "left")
    return placed.withColumn("place", F.col("place") + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def running(
    rows: DataFrame, key: str, place: str, columns: list[str], total: Callable, merge: Callable, piece: int = PIECE
) -> DataFrame:
    """`rows` with `columns` replaced by their running totals in the order of `place`.

    Totals run inside pieces of `piece` places; the totals of the pieces before are
    merged in, so that a long key is spread over its pieces.
    """
    cut = rows.withColumn("_piece", F.floor(F.col(place) / piece))
    within = Window.partitionBy(key, "_piece").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut.groupBy(key, "_piece").agg(*[total(c).alias(c) for c in columns])
    ahead = pieces.select(key, "_piece", *[total(c).over(before).alias(f"_{c}") for c in columns])
    ahead = ahead.filter(F.col(f"_{columns[0]}").isNotNull())
    joined = cut.withColumns({c: total(c).over(within) for c in columns}).join(ahead, [key, "_piece"], "left")
    merged = {c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(merge(F.col(c), F.col(f"_{c}"))) for c in columns}
    return joined.withColumns(merged).drop("_piece", *[f"_{c}" for c in columns])


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and (conv_id, pos, e1, e2, bytes) of their rebuilt turns."""
    own = stored(numbered(slim_turns(conversations), "conv_id", ["turn", "role", "c1", "c2"]))
    sizes = stored(own.groupBy("conv_id").agg(F.max("place").alias("n")))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEAD_TURNS))
    asked = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), head.alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    taken = F.least("h", F.coalesce("_n", F.lit(0))).alias("m")
    convs = stored(asked.join(bases, "base", "left").select("conv_id", "n", "base", "h", taken))
    content = ["c1", "c2", "bytes"]
    opening = own.filter(F.col("place") < HEAD_TURNS).withColumnRenamed("conv_id", "base")
    heads = convs.select("conv_id", "base", "h").join(opening, "base").filter("place <= h")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rest = join_counted(own, convs, "conv_id", "n", total, spread="place").filter("place > h")
    both = heads.select("conv_id", F.col("place").alias("pos"), *content).unionByName(
        rest.select("conv_id", (F.col("m") + F.col("place") - F.col("h")).alias("pos"), *content)
    )
    named = both.select(
        "conv_id", "pos", F.xxhash64("pos", "c1").alias("e1"), F.xxhash64("pos", "c2").alias("e2"), "bytes"
    )
    return convs.select("conv_id"), stored(named)


def _node(k1: Column | str, k2: Column | str) -> Column:
    """Name of a prefix; that of the empty one is zero."""
    return F.struct(F.coalesce(k1, F.lit(0)).cast("bigint").alias("k1"), F.coalesce(k2, F.lit(0)).cast("bigint").alias("k2"))


def end_lists(finals: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the comma-joined ids that end in each node.

    Ids are joined by ranges first; a digest then takes up its ranges one after
    another as they stream by, so a node with most of the ids needs no memory for them.
    """
    ranges = finals.groupBy("node", F.floor(F.col("conv_id") / IDS).alias("at")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if (k1, k2) != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), schema)], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, digest.hexdigest()), schema)], schema=schema)

    flat = ranges.select("node.k1", "node.k2", "at", "ids")
    listed = flat.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "at").select("k1", "k2", "ids")
    digests = listed.mapInArrow(run, "k1 bigint, k2 bigint, ends_sha256 string")
    return digests.select(_node("k1", "k2").alias("node"), "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (NULL at the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree: (n_convs - 1) times the UTF-8
    bytes of a node's last text), ends_sha256 (the members that end here).

    Turns are ordered by `turn`, NULL first; ties by role, then by a hash of role and
    text, so equal rows are interchangeable and all count. NULL roles and texts are
    empty. Rows without a conv_id belong to no conversation and are left out. Other
    columns are ignored; an empty table gives no rows, not even a root.
    """
    convs, turns = rebuilt_turns(conversations)
    ends = turns.groupBy("conv_id").agg(
        F.bit_xor("e1").alias("k1"), F.bit_xor("e2").alias("k2"), F.count(F.lit(1)).alias("length")
    )
    finals = stored(
        convs.join(ends, "conv_id", "left").select(
            "conv_id", _node("k1", "k2").alias("node"), F.coalesce("length", F.lit(0)).alias("length")
        )
    )
    # Whole sequences: one representative, the smallest id, with the number of its copies.
    sequences = stored(
        finals.groupBy("node").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.max("length").alias("length")
        )
    )
    chosen = sequences.select("conv_id", "weight", F.col("node").alias("last"))
    rows = turns.join(chosen, "conv_id").withColumns({"k1": F.col("e1"), "k2": F.col("e2")})
    paths = running(rows, "conv_id", "pos", ["k1", "k2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    parent = _node(F.col("k1").bitwiseXOR(F.col("e1")), F.col("k2").bitwiseXOR(F.col("e2")))
    prefixes = stored(
        paths.select(
            "conv_id", F.col("pos").alias("depth"), _node("k1", "k2").alias("node"), parent.alias("parent"), "bytes", "weight"
        ).unionByName(
            chosen.select(
                "conv_id", F.lit(0).cast("bigint").alias("depth"), _node(F.lit(0), F.lit(0)).alias("node"),
                F.lit(None).cast("struct<k1:bigint,k2:bigint>").alias("parent"), F.lit(0).cast("bigint").alias("bytes"), "weight",
            )
        )
    )
    inner = prefixes.filter("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = stored(sequences.join(inner, "node", "left_anti").select("conv_id", "length"))
    # Every node lies on the path of a leaf; the leaf with the smallest id owns it.
    flagged = prefixes.join(leaves.select("conv_id", F.lit(1).alias("leaf")), "conv_id", "left")
    nodes = stored(
        flagged.groupBy("node", "depth", "parent").agg(
            F.min("conv_id").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.count("leaf").alias("n_leaves"),
            F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"),
            ((F.sum("weight") - 1) * F.max("bytes")).alias("saved"),
        )
    )
    # A subtree saves what the chains of all its leaves save, less what its owner's chain saves above it.
    owned = nodes.groupBy("owner").agg(F.sum("saved").alias("chain"))
    per_leaf = leaves.join(owned, F.col("conv_id") == F.col("owner")).select("conv_id", "chain")
    below = prefixes.join(per_leaf, "conv_id").groupBy("node").agg(F.sum("chain").alias("below"))
    upto = running(
        nodes.select("node", "owner", "depth", "saved", F.col("saved").alias("upto")),
        "owner", "depth", ["upto"], F.sum, lambda a, b: a + b,
    ).select("node", (F.col("upto") - F.col("saved")).alias("above"))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    known = (
        nodes.join(below, "node")
        .join(upto, "node")
        .join(children, "node", "left")
        .join(end_lists(finals), "node", "left")
        .withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved_tokens": F.col("below") - F.col("above")})
        .drop("below", "above", "saved", "owner")
    )
    known = stored(known)
    parents = known.filter("n_children > 0").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_children")
    )
    joined = join_counted(known, parents, "parent", "_children", known.count(), spread="node", how="left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: crc32 of a text's bytes, given as a list of numbers; the same rule as zlib's.
_STEPS = "flatten(list_transform({bytes}, lambda b: [b::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, " + _STEPS + "), lambda c, s: "
    "xor(xor(c, s) >> 1, 3988292384::BIGINT * (xor(c, s) & 1))), 4294967295::BIGINT)"
)

SQL = f"""WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL), sizes AS (
  SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         {CRC32.format(bytes="list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x))")} % 9 AS h FROM sizes), based AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(s.n, 0)) AS m FROM convs c LEFT JOIN sizes s ON s.conv_id = c.base), turns AS (
  SELECT b.conv_id, o.place AS pos, o.role, o.text FROM based b JOIN own o ON o.conv_id = b.base AND o.place <= b.h
  UNION ALL
  SELECT b.conv_id, b.m + o.place - b.h, o.role, o.text FROM based b JOIN own o ON o.conv_id = b.conv_id AND o.place > b.h), paths AS (
  SELECT conv_id, pos AS depth, octet_length(encode(text)) AS bytes,
         md5(string_agg(md5(concat(length(role), ':', role, text)), ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, 'root' FROM based), linked AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
         max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM paths), nodes AS (
  SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * max(bytes) AS saved,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS listed
  FROM linked GROUP BY node), children AS (
  SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent), full_nodes AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)), under AS (
  SELECT a.node, sum(d.saved) AS saved, count(*) FILTER (d.n_children = 0) AS leaves
  FROM full_nodes d JOIN paths a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY a.node)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.leaves AS n_leaves,
       u.saved::BIGINT AS saved_tokens, sha256(f.listed) AS ends_sha256
FROM full_nodes f JOIN under u USING (node) LEFT JOIN full_nodes p ON p.node = f.parent"""
