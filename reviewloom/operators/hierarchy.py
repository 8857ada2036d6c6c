"""Complaint themes from a density hierarchy: no number of themes and no threshold.

The distance of two rows is the largest of their cosine distance and of both rows'
core distances, the core distance being that of the `min_samples`-th nearest other
row. The minimum spanning tree over these distances holds the components at
every height. Pairs of tiles give the nearest points of each point; Boruvka rounds on Spark pick
the tree out of these links, as long as the distances listed prove that no other link is shorter. Where
they do not, the tiles are searched for the links in doubt, so the tree is exact. Heights are all
lengths of its links, and all core distances of copies.

A component with `min_topic_size` rows is a cluster. Clusters that grow without
meeting another one are one theme; its stability adds up rows times the span of densities
over which they belong to it. A theme is kept if it is more stable than the themes inside
it together. The theme of all rows is never kept, as in the usual definition of the method.
The tree is cut at a few heights into bands of about `BAND_LINKS` links. The components of a band's
upper height are grouped on their own, height by height; their themes go on in the band above, so the cuts change no result.

Copies of a vector are one point with a weight. All tables but the tiles are joined and
aggregated by Spark; a point is shuffled once for each of a few tiles, whose pairs are compared as matrices, so the
comparisons are quadratic in the distinct vectors: meant for the sample of complaints that themes are fitted to.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.constants import MIN_TOPIC_SIZE, SCORE_DIGITS
from reviewloom.operators.density import _column, _cosines, _sides, _tile_pairs, _vectors, connected_components, fold_copies
from reviewloom.operators.metric_join import LEAST_TILE_ROWS, STRIP, tile_count
from reviewloom.operators.themes import assign_topics
from reviewloom.session import stored

MIN_SAMPLES = 5
#: Points of a tile at least, where there are fewer than `TILES` tiles.
TILE_ROWS = LEAST_TILE_ROWS
#: Nearest points listed for each point, and points whose lists are merged at a time.
NEAREST = 32
MERGED_ROWS = 4_096
#: Links of the tree that a band of heights holds, about.
BAND_LINKS = 131_072
#: Components of several heights are found at once: a node's number leaves room for its level.
NODE_BITS = 49
NO_DISTANCE = 1e-9


def _distances(left: pa.Table, right: pa.Table) -> np.ndarray:
    return np.round(1.0 - _cosines(left, right), SCORE_DIGITS)


class Nearest:
    """The `k` nearest of the points shown, for each of `n` rows: (row, at, cosine) in three lists."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.least = np.full(n, -np.inf)  # a row has k points at this cosine already
        self.row, self.at, self.cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.fresh, self.held = [], 0

    def show(self, cosines: np.ndarray, rows: int, at: int) -> None:
        """`cosines` of the rows from `rows` on with the points from `at` on; -inf is no pair."""
        least = self.least[rows : rows + len(cosines)]
        if cosines.shape[1] > self.k and np.isneginf(least).any():
            least[:] = np.maximum(least, np.partition(cosines, -self.k, axis=1)[:, -self.k])
        row, column = np.divmod(np.flatnonzero(cosines >= least[:, None]), cosines.shape[1])
        self.fresh.append((row + rows, column + at, cosines[row, column]))
        self.held += len(row)
        if self.held > 3 * self.k * len(self.least):
            self.trim()

    def trim(self) -> None:
        old = (self.row, self.at, self.cosine)
        row, at, cosine = (np.concatenate(c) for c in zip(old, *self.fresh))
        order = np.lexsort((at, -cosine, row))
        order = order[cosine[order] > -np.inf]
        row, at, cosine = row[order], at[order], cosine[order]
        place = _places(row)
        last = place == self.k - 1
        self.least[row[last]] = cosine[last]
        kept = place < self.k
        self.row, self.at, self.cosine = row[kept], at[kept], cosine[kept]
        self.fresh, self.held = [], 0


def _places(sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each element among its equals, from 0."""
    starts = np.flatnonzero(np.append(True, np.diff(sorted_keys) != 0)) if len(sorted_keys) else np.zeros(0, np.int64)
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.append(starts, len(sorted_keys))))


def _strips(n: int) -> list[slice]:
    return [slice(start, min(start + STRIP, n)) for start in range(0, n, STRIP)]


def nearest_points(points: DataFrame, min_samples: int, k: int, n_tiles: int, n_points: int) -> DataFrame:
    """(point, core, reach, others, fars): the k nearest other points of each point, and what follows from them.

    `core` is the distance to the `min_samples`-th nearest other row, copies counted; with fewer other rows it is the
    distance to the furthest. Every point nearer than `reach` is listed. A pair of tiles offers k points at most
    for each of its points, so what is shuffled grows with points and tiles, not with pairs of points.
    """
    schema = "point bigint, others array<bigint>, fars array<double>, weights array<int>, copies int"
    merged = "point bigint, core double, reach double, others array<bigint>, fars array<double>"
    # More copies than are counted make no difference.
    points = points.withColumn("_w", F.least("weight", F.lit(min_samples + 1)).cast("int"))

    def lists(found: Nearest, own: pa.Table, other: pa.Table, copies: np.ndarray) -> pa.Table:
        found.trim()
        offsets = pa.array(np.searchsorted(found.row, np.arange(own.num_rows + 1)).astype(np.int32))
        fars = np.round(1.0 - np.round(found.cosine, SCORE_DIGITS), SCORE_DIGITS)
        flat = (_column(other, "point")[found.at], fars, _column(other, "_w")[found.at])
        listed = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat]
        return pa.table([_column(own, "point"), *listed, copies], names=["point", "others", "fars", "weights", "copies"])

    def run(rows: pa.Table) -> pa.Table:
        same, left, right = _sides(rows)
        a = _vectors(left)
        b = a if same else _vectors(right)
        of_left, of_right = Nearest(len(a), k), Nearest(len(b), k)
        numbers = np.isfinite(a).all() and np.isfinite(b).all()
        for x in _strips(len(a)):
            for y in _strips(len(b)):
                if same and y.start < x.start:
                    continue
                cosines = a[x] @ b[y].T
                if not numbers:
                    cosines[np.isnan(cosines)] = -np.inf
                if same and x == y:
                    np.fill_diagonal(cosines, -np.inf)
                of_left.show(cosines, x.start, y.start)
                if not same:
                    of_right.show(cosines.T, y.start, x.start)
                elif x != y:
                    of_left.show(cosines.T, y.start, x.start)
        # A row is no neighbour of itself, its copies are.
        copies = _column(left, "_w") - 1 if same else np.zeros(len(a), np.int32)
        tables = [lists(of_left, left, right, copies.astype(np.int32))]
        if not same:
            tables.append(lists(of_right, right, left, np.zeros(len(b), np.int32)))
        return pa.concat_tables(tables)

    def merge(rows: pa.Table) -> pa.Table:
        ids, row = np.unique(_column(rows, "point"), return_inverse=True)
        others, fars, weights = (pa.concat_arrays(rows.column(x).chunks) for x in ("others", "fars", "weights"))
        row_of = np.repeat(row, others.value_lengths().to_numpy())
        other, far, weight = (x.flatten().to_numpy() for x in (others, fars, weights))
        order = np.lexsort((other, far, row_of))
        order = order[_places(row_of[order]) < k]
        row_of, other, far, weight = row_of[order], other[order], far[order], weight[order]
        listed = np.bincount(row_of, minlength=len(ids))
        offsets = np.append(0, np.cumsum(listed))
        # All other points are listed, or the last one bounds those that are not.
        reach = np.full(len(ids), np.inf)
        full = np.flatnonzero((listed == k) & (listed < n_points - 1))
        reach[full] = far[offsets[full + 1] - 1]
        copies = np.zeros(len(ids), np.int64)
        np.add.at(copies, row, _column(rows, "copies"))
        core = _core(row_of, far, weight, copies, min_samples)
        columns = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (other, far)]
        cores = pa.array(core, from_pandas=True)
        return pa.table([ids, cores, reach, *columns], names=["point", "core", "reach", "others", "fars"])

    offered = _tile_pairs(points.drop("weight"), n_tiles).applyInArrow(run, schema)
    bucket = F.pmod(F.xxhash64("point", F.lit(1)), F.lit(math.ceil(n_points / MERGED_ROWS) or 1))
    return offered.groupBy(bucket.alias("_bucket")).applyInArrow(lambda rows: merge(rows), merged)


def _core(row: np.ndarray, far: np.ndarray, weight: np.ndarray, copies: np.ndarray, min_samples: int) -> np.ndarray:
    """Distance at which the weights of a row's points and of its copies at 0 reach `min_samples`, else the furthest; NaN without any."""
    own = np.flatnonzero(copies > 0)
    row, far = np.append(row, own), np.append(far, np.zeros(len(own)))
    weight = np.append(weight, copies[own])
    order = np.lexsort((far, row))
    row, far, weight = row[order], far[order], weight[order]
    upto = np.cumsum(weight)
    first = np.flatnonzero(_places(row) == 0)
    upto = upto - np.repeat(upto[first] - weight[first], np.diff(np.append(first, len(row))))
    furthest, reached = np.full(len(copies), np.nan), np.full(len(copies), np.inf)
    np.fmax.at(furthest, row, far)
    enough = upto >= min_samples
    np.minimum.at(reached, row[enough], far[enough])
    return np.where(np.isinf(reached), furthest, reached)


def spanning_tree(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Links of the minimum spanning tree of a full graph; equal lengths go by row and column."""
    n = len(lengths)
    rows = np.arange(n)
    outside = np.ones(n, dtype=bool)
    outside[0] = False
    best, key = lengths[0].copy(), rows.copy()  # shortest link into the tree; row * n + column names it
    links = []
    for _ in range(n - 1):
        left = rows[outside]
        shortest = left[best[left] == best[left].min()]
        new = int(shortest[key[shortest].argmin()])
        links.append((int(key[new]) // n, int(key[new]) % n))
        outside[new] = False
        names = np.minimum(rows, new) * n + np.maximum(rows, new)
        nearer = (lengths[new] < best) | ((lengths[new] == best) & (names < key))
        best, key = np.where(nearer, lengths[new], best), np.where(nearer, names, key)
    return links


def tile_links(points: DataFrame) -> DataFrame:
    """(a, b, length), a < b: the spanning tree of the (point, embedding, core) of a single tile."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("length", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("point")
        ids, core = _column(rows, "point"), _column(rows, "core")
        lengths = np.maximum(np.maximum(_distances(rows, rows), core[:, None]), core[None, :])
        links = np.array(spanning_tree(lengths), dtype=np.int64).reshape(-1, 2)
        return pa.table([ids[links[:, 0]], ids[links[:, 1]], lengths[links[:, 0], links[:, 1]]], schema=arrow)

    return points.groupBy(F.lit(0).alias("_tile")).applyInArrow(run, "a bigint, b bigint, length double")


def near_links(near: DataFrame) -> DataFrame:
    """(a, b, length), a < b: links of all points with those in their lists."""
    listed = near.select("point", "core", F.inline(F.arrays_zip("others", "fars")))
    cores = near.select(F.col("point").alias("others"), F.col("core").alias("_core"))
    length = F.greatest("fars", "core", "_core")
    pairs = listed.join(cores, "others").select(
        F.least("point", "others").alias("a"), F.greatest("point", "others").alias("b"), length.alias("length")
    )
    return pairs.groupBy("a", "b").agg(F.min("length").alias("length"))


def outgoing_links(points: DataFrame, n_tiles: int) -> DataFrame:
    """(c, length, a, b, ca, cb): for each component in a tile pair, the shortest link of an asking point to another component.

    `points` is (point, embedding, core, c, asks).
    """
    names = ["c", "length", "a", "b", "ca", "cb"]
    arrow = pa.schema([(x, pa.float64() if x == "length" else pa.int64()) for x in names])

    def shortest(asking: pa.Table, others: pa.Table) -> pa.Table:
        found = []
        a, b = _vectors(asking), _vectors(others)
        core_a, core_b = _column(asking, "core"), _column(others, "core")
        of_a, of_b = _column(asking, "c"), _column(others, "c")
        id_a, id_b = _column(asking, "point"), _column(others, "point")
        for x in _strips(len(a)):
            for y in _strips(len(b)):
                far = np.round(1.0 - np.round(a[x] @ b[y].T, SCORE_DIGITS), SCORE_DIGITS)
                length = np.maximum(np.maximum(far, core_a[x, None]), core_b[None, y])
                length[(of_a[x, None] == of_b[None, y]) | np.isnan(length)] = np.inf
                at = length.argmin(axis=1)  # rows are sorted by point: the first link among equal ones
                best = length[np.arange(len(at)), at]
                own, other, rows = id_a[x], id_b[y][at], np.flatnonzero(best < np.inf)
                low = own < other
                ca, cb = np.where(low, of_a[x], of_b[y][at]), np.where(low, of_b[y][at], of_a[x])
                columns = (of_a[x], best, np.minimum(own, other), np.maximum(own, other), ca, cb)
                found.append([column[rows] for column in columns])
        if not found:
            return arrow.empty_table()
        columns = [np.concatenate(column) for column in zip(*found)]
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        order = order[_places(columns[0][order]) == 0]
        return pa.table([column[order] for column in columns], schema=arrow)

    def run(rows: pa.Table) -> pa.Table:
        same, left, right = _sides(rows)
        tables = [shortest(left.filter(left.column("asks")), right)]
        if not same:
            tables.append(shortest(right.filter(right.column("asks")), left))
        return pa.concat_tables(tables)

    schema = "c bigint, length double, a bigint, b bigint, ca bigint, cb bigint"
    return _tile_pairs(points, n_tiles).applyInArrow(run, schema)


def minimum_spanning_links(points: DataFrame, links: DataFrame, n_tiles: int) -> DataFrame:
    """(a, b, length): the minimum spanning tree of (point, embedding, core, reach), given links as short as `reach`.

    Boruvka rounds: every component takes its shortest outgoing link, the components so linked become one. A link that is
    not given is at least as long as the reach of both its ends, so a component may take its shortest given link
    if that is no longer than its least reach, or than the least reach of all others. If no
    component may, the tiles are searched for the shortest links of all but the largest one.
    """
    rest = stored(links.withColumns({"ca": F.col("a"), "cb": F.col("b")}))
    where = stored(points.select("point", "reach", F.col("point").alias("c")))
    taken = links.select("a", "b", "length").limit(0)
    while True:
        sizes = stored(where.groupBy("c").agg(F.min("reach").alias("reach"), F.count(F.lit(1)).alias("size")))
        least = sizes.orderBy("reach", "c").limit(2).collect()
        if len(least) < 2:
            return taken
        order = F.struct("length", F.lit(False).alias("searched"), "a", "b", "ca", "cb")
        both = rest.select(F.col("ca").alias("c"), order.alias("link")).unionByName(rest.select(F.col("cb").alias("c"), order.alias("link")))
        known = stored(sizes.join(both.groupBy("c").agg(F.min("link").alias("link")), "c", "left"))
        bound = F.when(F.col("c") == least[0]["c"], least[1]["reach"]).otherwise(F.col("reach"))
        sure = known.filter(F.col("link.length") <= bound)
        if sure.isEmpty():
            sure = _searched(points, where, known, n_tiles)
        chosen = stored(sure.select("link.*").select("a", "b", "length", "ca", "cb").distinct())
        if chosen.isEmpty():
            return taken  # vectors that hold no numbers
        taken = taken.unionByName(chosen.select("a", "b", "length"))
        moved = stored(connected_components(chosen.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))

        def renamed(rows: DataFrame, side: str) -> DataFrame:
            to = moved.select(F.col("node").alias(side), F.col("component").alias("_to"))
            return rows.join(to, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")

        where = stored(renamed(where, "c"))
        rest = stored(renamed(renamed(rest, "ca"), "cb").filter("ca <> cb"))


def _searched(points: DataFrame, where: DataFrame, known: DataFrame, n_tiles: int) -> DataFrame:
    """(c, link): the shortest links of all components of `known` but the largest, searched in the tiles."""
    largest = known.orderBy(F.desc("size"), "c").first()["c"]
    # Only a point with a reach below the component's shortest given link can have a shorter one.
    asks = (F.col("c") != largest) & (F.col("link").isNull() | (F.col("reach") < F.col("link.length")))
    places = where.join(known.select("c", "link"), "c").select("point", "c", asks.alias("asks"))
    found = outgoing_links(points.select("point", "embedding", "core").join(places, "point"), n_tiles)
    link = F.struct("length", F.lit(True).alias("searched"), "a", "b", "ca", "cb").alias("link")
    given = known.filter(F.col("link").isNotNull() & (F.col("c") != largest)).select("c", "link")
    return found.select("c", link).unionByName(given).groupBy("c").agg(F.min("link").alias("link"))


def mutual_tree(vectors: DataFrame, min_samples: int = MIN_SAMPLES, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Points (point, embedding, weight, core) of (review_id, embedding) rows and their spanning tree."""
    folded = stored(fold_copies(vectors.filter("embedding IS NOT NULL").select("review_id", "embedding")))
    count = folded.count()
    n_tiles = tile_count(count, tile_rows)
    near = stored(
        nearest_points(folded, min_samples, max(NEAREST, 2 * min_samples), n_tiles, count).withColumn(
            "core", F.coalesce("core", F.lit(0.0))
        )
    )
    points = stored(folded.join(near.select("point", "core", "reach"), "point"))
    tree = tile_links(points) if n_tiles == 1 else minimum_spanning_links(points, near_links(near), n_tiles)
    return points.drop("reach"), stored(tree)


def tree_heights(tree: DataFrame, levels: int | None = None) -> list[float]:
    """Heights that end the bands: `levels` quantiles of the lengths of links, or all lengths if they are fewer.

    Without `levels` a band holds about `BAND_LINKS` links. The last height is the length of the longest link.
    """
    distinct = stored(tree.groupBy("length").agg(F.count(F.lit(1)).alias("n")))
    count, links, longest = distinct.agg(F.count(F.lit(1)), F.sum("n"), F.max("length")).first()
    levels = math.ceil((links or 0) / BAND_LINKS) if levels is None else levels
    if count <= levels:
        return [r["length"] for r in distinct.orderBy("length").collect()]
    shares = [F.lit((i + 1) / levels) for i in range(levels - 1)]
    inner = distinct.agg(F.percentile("length", F.array(*shares), F.col("n")).alias("q")).first()["q"] if shares else []
    return [*sorted({x for x in inner if x < longest}), longest]


def components_at(points: DataFrame, tree: DataFrame, heights: list[float]) -> DataFrame:
    """(level, point, component, weight): components at each height, named by their smallest point.

    A point is in a component of its own rows once the height reaches its core distance, else in none.
    """
    if not heights:
        return points.sparkSession.createDataFrame([], "level int, point bigint, component bigint, weight bigint")
    numbered = stored(points.select("point", "weight", "core", F.monotonically_increasing_id().alias("node")))
    steps = F.array(*[F.lit(float(h)) for h in heights])
    level = F.posexplode(steps).alias("level", "height")
    ends = numbered.select("point", "node")
    linked = tree.join(ends.select(F.col("point").alias("a"), F.col("node").alias("na")), "a").join(
        ends.select(F.col("point").alias("b"), F.col("node").alias("nb")), "b"
    )
    shift = F.lit(1 << NODE_BITS)
    tagged = linked.select("na", "nb", "length", level).filter("length <= height").select(
        (F.col("level") * shift + F.col("na")).alias("a"), (F.col("level") * shift + F.col("nb")).alias("b")
    )
    found = connected_components(tagged)
    rows = numbered.select("point", "weight", "core", "node", level).filter("core <= height")
    keyed = rows.select("level", "point", "weight", (F.col("level") * shift + F.col("node")).alias("node"))
    placed = stored(keyed.join(found, "node", "left").select("level", "point", "weight", F.coalesce("component", "node").alias("_c")))
    names = placed.groupBy("_c").agg(F.min("point").alias("component"))
    return placed.join(names, "_c").select("level", "point", "component", "weight")


def _density(height: float) -> float:
    return 1.0 / max(height, NO_DISTANCE)


def band_nodes(points: DataFrame, placed: DataFrame, n_bands: int) -> DataFrame:
    """(band, point, part, node, started, weight, core): the points that take part in a band.

    `placed` has the components at the inner heights. A part is a component at the upper height of a band, a node one at
    its lower height or a point that is in none there. All that is left is one part of the last band.
    """
    low = placed.select((F.col("level") + 1).alias("band"), "point", F.col("component").alias("_low"))
    high = placed.select(F.col("level").alias("band"), "point", F.col("component").alias("_high"))
    bands = F.explode(F.sequence(F.lit(0), F.lit(n_bands - 1))).alias("band")
    every = points.select(bands, "point", "weight", "core").join(low, ["band", "point"], "left").join(high, ["band", "point"], "left")
    part = F.when(F.col("band") == n_bands - 1, F.lit(0).cast("bigint")).otherwise(F.col("_high"))
    node, started = F.coalesce("_low", "point"), F.col("_low").isNotNull()
    return every.select("band", "point", part.alias("part"), node.alias("node"), started.alias("started"), "weight", "core").filter("part IS NOT NULL")


class _Themes:
    """The themes of one part of a band, height by height.

    A theme is named (band, part, place): (band, part, 0) goes on in the band above, where its part is the node. `rows` has
    (name, up, same, share): `up` is the theme it merges into, or with `same` the name it has in the band above, and `share`
    what the band adds to its stability. `homes` are the (node, name) of nodes that get into their first cluster.
    """

    def __init__(self, weights: list[int], min_size: int) -> None:
        self.min_size, self.size = min_size, weights
        self.root = list(range(len(weights)))
        self.theme: list[list[int]] = [[] for _ in weights]  # open themes inside a component, one between heights
        self.homeless: list[list[int]] = [[] for _ in weights]
        self.home = [-1] * len(weights)
        self.incoming: list[int | None] = []  # node of a theme from the band below
        self.since, self.held, self.share, self.up = [], [], [], []

    def start(self, at: int, height: float, incoming: int | None = None) -> int:
        self.incoming.append(incoming)
        self.since.append(_density(height))
        self.held.append(self.size[at])
        self.share.append(0.0)
        self.up.append(-1)
        return len(self.up) - 1

    def find(self, at: int) -> int:
        while self.root[at] != at:
            self.root[at] = at = self.root[self.root[at]]
        return at

    def link(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        if a == b:
            return a
        if len(self.homeless[a]) + len(self.theme[a]) < len(self.homeless[b]) + len(self.theme[b]):
            a, b = b, a
        self.root[b] = a
        self.size[a] += self.size[b]
        self.theme[a] += self.theme[b]
        self.homeless[a] += self.homeless[b]
        self.theme[b], self.homeless[b] = [], []
        return a

    def spend(self, theme: int, density: float, size: int = 0) -> None:
        self.share[theme] += self.held[theme] * (self.since[theme] - density)
        self.since[theme], self.held[theme] = density, size

    def settle(self, at: int, height: float) -> None:
        """What a component is after all links of a height."""
        if self.size[at] < self.min_size:
            return
        inside = self.theme[at]
        for theme in inside:
            self.spend(theme, _density(height), self.size[at])
        if len(inside) != 1:
            self.theme[at] = [self.start(at, height)]
            for theme in inside:
                self.up[theme] = self.theme[at][0]
        for node in self.homeless[at]:
            self.home[node] = self.theme[at][0]
        self.homeless[at] = []


THEME_SCHEMA = pa.schema(
    [*((x, pa.int64()) for x in ("band", "part", "place", "up_band", "up_part", "up_place", "node")), ("same", pa.bool_()), ("share", pa.float64())]
)


def _themes_of_part(nodes: pa.Table, links: pa.Table, heights: list[float], min_size: int) -> pa.Table:
    """Rows of the themes of a part, without a node, and of the homes of its nodes, with the band as `up_band`."""
    nodes = nodes.sort_by("node")
    band, part = nodes.column("band")[0].as_py(), nodes.column("part")[0].as_py()
    ids, weight, core = _column(nodes, "node"), _column(nodes, "weight").tolist(), _column(nodes, "core").tolist()
    found, last = _Themes(weight, min_size), band == len(heights) - 1
    heavy = []
    for at, started in enumerate(nodes.column("started").to_pylist()):
        if weight[at] < min_size:
            found.homeless[at].append(at)
        elif started:
            found.theme[at].append(found.start(at, heights[band - 1], int(ids[at])))
        else:
            found.homeless[at].append(at)
            heavy.append((core[at], at, at))  # copies are a cluster from their core distance on
    a, b = (np.searchsorted(ids, _column(links, x)).tolist() for x in ("a", "b"))
    events = sorted([*zip(_column(links, "length").tolist(), a, b), *heavy])
    first = 0
    while first < len(events):
        height, end = events[first][0], first
        while end < len(events) and events[end][0] == height:
            found.link(events[end][1], events[end][2])
            end += 1
        for at in {found.find(x) for _, x, _ in events[first:end]}:
            found.settle(at, height)
        first = end
    going = {}
    for at in {found.find(x) for x in range(len(ids))}:
        for theme in found.theme[at]:
            found.spend(theme, 0.0 if last else _density(heights[band]))
            going[theme] = (band, part, 0)
    if last:
        going = {}
    name = [(band - 1, node, 0) if node is not None else going.get(t, (band, part, t + 1)) for t, node in enumerate(found.incoming)]
    none, rows = (None, None, None), []
    for t, up in enumerate(found.up):
        same = up < 0 and not last and found.incoming[t] is not None
        above = name[up] if up >= 0 else going[t] if same else none
        rows.append((*name[t], *above, None, same, found.share[t]))
    rows += [(*name[t], band, None, None, int(ids[at]), False, 0.0) for at, t in enumerate(found.home) if t >= 0]
    columns = list(zip(*rows)) or [()] * len(THEME_SCHEMA)
    return pa.table([pa.array(column, kind.type) for column, kind in zip(columns, THEME_SCHEMA)], schema=THEME_SCHEMA)


def condensed(points: DataFrame, tree: DataFrame, placed: DataFrame, heights: list[float], min_size: int) -> tuple[DataFrame, DataFrame]:
    """Themes (band, part, place, up_band, up_part, up_place, same, share), as in `_Themes`, and the (point, band, part, place) of the first theme of each point.

    Clusters that grow without meeting another are one theme. `placed` has the components at all `heights` but the last.
    """
    nodes = stored(band_nodes(points, placed, len(heights)))
    lower = F.array(*[F.lit(float(h)) for h in heights[:-1]]).cast("array<double>")
    linked = tree.withColumn("band", F.size(F.filter(lower, lambda h: h < F.col("length"))))
    of_a = nodes.select("band", F.col("point").alias("a"), "part", F.col("node").alias("_a"))
    of_b = nodes.select("band", F.col("point").alias("b"), F.col("node").alias("_b"))
    met = linked.join(of_a, ["band", "a"]).join(of_b, ["band", "b"])
    met = stored(met.select("band", "part", F.col("_a").alias("a"), F.col("_b").alias("b"), "length"))
    # A point that starts on its own has a core distance, a component does not need one.
    summed = nodes.groupBy("band", "part", "node", "started").agg(F.sum("weight").alias("weight"), F.min("core").alias("core"))
    schema = "band bigint, part bigint, place bigint, up_band bigint, up_part bigint, up_place bigint, node bigint, same boolean, share double"
    found = stored(
        summed.groupBy("band", "part").cogroup(met.groupBy("band", "part")).applyInArrow(
            lambda own, links: _themes_of_part(own, links, heights, min_size), schema
        )
    )
    homes = found.filter("node IS NOT NULL").select("band", "part", "place", F.col("up_band").alias("_band"), "node")
    members = nodes.select("point", F.col("band").alias("_band"), "node")
    return found.filter("node IS NULL").drop("node"), homes.join(members, ["_band", "node"]).select("point", "band", "part", "place")


def _chosen(themes: pa.Table) -> pa.Table:
    """(band, part, place, cluster): for each name of a theme that is kept or inside a kept one, the number of that."""
    of = {}
    names = list(zip(*(themes.column(x).to_pylist() for x in ("band", "part", "place"))))
    above = list(zip(*(themes.column(x).to_pylist() for x in ("up_band", "up_part", "up_place"))))
    at = [of.setdefault(name, len(of)) for name in names]
    up, same, waits = [-1] * len(of), [False] * len(of), [0] * len(of)
    stability, inside = [0.0] * len(of), [0.0] * len(of)
    for x, name, goes_on, share in zip(at, above, themes.column("same").to_pylist(), themes.column("share").to_pylist()):
        stability[x] += share
        if name[0] is not None:
            up[x], same[x] = of[name], goes_on
            waits[up[x]] += 1
    order, wins = [x for x, n in enumerate(waits) if not n], [False] * len(of)
    for x in order:  # grows: a theme comes after all that are inside it
        if same[x]:
            stability[up[x]] += stability[x]
            inside[up[x]] += inside[x]
        else:
            own, total = round(stability[x], SCORE_DIGITS), round(inside[x], SCORE_DIGITS)
            wins[x] = own >= total and up[x] >= 0
            if up[x] >= 0:
                inside[up[x]] += max(own, total)
        if up[x] >= 0:
            waits[up[x]] -= 1
            if not waits[up[x]]:
                order.append(up[x])
    cluster = [-1] * len(of)
    for x in reversed(order):
        cluster[x] = cluster[up[x]] if up[x] >= 0 and cluster[up[x]] >= 0 else x if wins[x] else -1
    rows = [(*name, cluster[x]) for name, x in of.items() if cluster[x] >= 0]
    columns = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(x, pa.int64()) for x in columns], names=["band", "part", "place", "cluster"])


def selected(themes: DataFrame) -> DataFrame:
    """(band, part, place, cluster): the themes that are more stable than the themes inside them together; never the topmost.

    Names of kept themes and of all themes inside them. Themes may be nested as deep as they are many, so one task goes up the
    tree of themes, then down. It gets no points: a theme has `min_topic_size` rows at least, and one more row for each band it spans.
    """
    return stored(themes.groupBy(F.lit(0).alias("_all")).applyInArrow(lambda rows: _chosen(rows), "band bigint, part bigint, place bigint, cluster bigint"))


def hierarchy_themes(
    vectors: DataFrame,
    min_topic_size: int = MIN_TOPIC_SIZE,
    min_samples: int = MIN_SAMPLES,
    levels: int | None = None,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(review_id, topic) of (review_id, embedding) rows with unit vectors.

    Rows that belong to no kept theme, and rows without a vector, are outliers. Where all rows form
    one theme only, all are outliers: nothing tells them apart. `levels` is the number of bands that
    the tree is worked on in; the result does not depend on it.
    """
    points, tree = mutual_tree(vectors, min_samples, tile_rows)
    heights = tree_heights(tree, levels)
    if not heights:
        return assign_topics(vectors.select("review_id", F.lit(None).cast("bigint").alias("cluster")), "cluster", min_topic_size)
    placed = stored(components_at(points, tree, heights[:-1]))
    nested, homes = condensed(points, tree, placed, heights, min_topic_size)
    # A point is in one kept theme at most: kept themes are not nested.
    members = homes.join(selected(nested), ["band", "part", "place"]).select("point", "cluster")
    copies = points.join(members, "point").select("embedding", "cluster")
    rows = vectors.select("review_id", "embedding").join(copies, "embedding", "left").select("review_id", "cluster")
    return assign_topics(rows, "cluster", min_topic_size)
