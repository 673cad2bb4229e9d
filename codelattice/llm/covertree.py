"""Operator 5: exact threshold pairs of vectors by dual traversal of cover trees.

Vectors are scaled to length 1, where cosine >= c is Euclidean distance <= sqrt(2 - 2c). They are
dealt into blocks around pivots; a block that is too large is split by a hash of the id, so copies of
one vector spread over blocks of bounded size. Each block gets a cover tree: levels with halving
radii, each node's children a net of its members. Two trees are walked together: a pair of nodes is
dropped when their centres are farther apart than the threshold plus both covering radii, taken
whole when even the farthest members are near enough, and opened otherwise. Opening compares all
children with one matrix product, in double precision. Pairs are counted, never listed: a task
returns for each vector its number of links and one link to its smallest relative there.

Blocks are shipped to pairs of groups of SUPER blocks: a task holds the trees of one group and streams
those of the other past them, so a tree travels once for each group that may be near, not once for each
block. Which groups may be near is known beforehand from the cells' pivots and covering radii.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut
from .components import connected
from .vectors import matrix, unit, usable

#: A block has at most about so many rows, and bytes of vectors; a task holds the trees of so many blocks.
BLOCK_ROWS, BLOCK_BYTES, SUPER = 8192, 1 << 24, 4
#: Cells at most, whatever the rows; beyond them cells are split by hash. The driver sees a row for each cell.
MAX_PIVOTS = 1024
#: Partitions at most for pairs of groups; each streams its pairs one after the other.
MOST_TASKS = 20_000
#: Rows of a product of vectors at once.
TILE = 1024
LEAF = 48
SLACK = 1e-9


class CoverTree:
    """Nodes in order of creation: centre (a row of x), covering radius, child range, member range.

    Members of a node are a stretch of `order`; children of a node follow each other.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.child, self.member = [0], [2.0], [(0, 0)], [(0, len(x))]
        todo = [(0, 2.0)]
        while todo:
            node, scale = todo.pop()
            begin, end = self.member[node]
            members = self.order[begin:end]
            far = float(np.sqrt(np.maximum(0, 2 - 2 * (x[members] @ x[self.centre[node]])).max()))
            self.radius[node] = far + SLACK
            if end - begin <= leaf or far < 1e-7:
                continue
            while scale / 2 >= far:
                scale /= 2
            groups = self._net(members, self.centre[node], scale / 2)
            self.child[node] = (len(self.centre), len(self.centre) + len(groups))
            for centre, group in groups:
                self.order[begin : begin + len(group)] = group
                todo.append((len(self.centre), scale / 2))
                self.centre.append(centre)
                self.radius.append(scale / 2)
                self.child.append((0, 0))
                self.member.append((begin, begin + len(group)))
                begin += len(group)

    def _net(self, members: np.ndarray, centre: int, radius: float, batch: int = 256) -> list[tuple[int, np.ndarray]]:
        """Centres more than radius apart, the node's own first, each with the members that it is first to cover."""
        near = 1 - radius * radius / 2  # the dot product at that distance
        rest, out = np.concatenate([[centre], members[members != centre]]), []
        while len(rest):
            head = rest[:batch]
            inner = self.x[head] @ self.x[head].T >= near
            chosen, free = [], np.ones(len(head), bool)
            for i in range(len(head)):
                if free[i]:
                    chosen.append(i)
                    free &= ~inner[i]
            cover = self.x[head[chosen]] @ self.x[rest].T >= near
            cover[np.arange(len(chosen)), chosen] = True
            first = cover.argmax(axis=0)
            got = cover[first, np.arange(len(rest))]
            sort = np.argsort(first[got], kind="stable")
            taken, owner = rest[got][sort], first[got][sort]
            bounds = np.searchsorted(owner, np.arange(len(chosen) + 1))
            out += [(int(head[c]), taken[bounds[k] : bounds[k + 1]]) for k, c in enumerate(chosen)]
            rest = rest[~got]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"x": self.x, "order": self.order, "centre": np.array(self.centre), "radius": np.array(self.radius), "child": np.array(self.child), "member": np.array(self.member)}

    @classmethod
    def of(cls, arrays) -> "CoverTree":
        tree = cls.__new__(cls)  # arrays in the place of lists
        for k in ("x", "order", "centre", "radius", "child", "member"):
            setattr(tree, k, arrays[k])
        return tree

    def members(self, node: int) -> np.ndarray:
        return self.order[self.member[node][0] : self.member[node][1]]

    def members_of(self, nodes: np.ndarray) -> np.ndarray:
        begin, end = self.member[nodes, 0], self.member[nodes, 1]
        size = end - begin
        return self.order[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]


class Links:
    """Counts of links and a union of linked rows, for two sides with rows numbered in one sequence."""

    def __init__(self, n: int, hold: int = 1 << 20):
        self.count, self.root, self.hold = np.zeros(n, np.int64), np.arange(n), hold
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.held = 0

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > self.hold:
            self.settle()

    def settle(self) -> np.ndarray:
        """The smallest number that each row is joined with."""
        if self.a:
            a, b = np.concatenate(self.a), np.concatenate(self.b)
            while True:
                low = np.minimum(self.root[a], self.root[b])
                high = np.maximum(self.root[a], self.root[b])
                if (low == high).all():
                    break
                np.minimum.at(self.root, high, low)
                while (self.root != self.root[self.root]).any():
                    self.root = self.root[self.root]
            self.a, self.b, self.held = [], [], 0
        return self.root


def dual(one: CoverTree, two: CoverTree, cosine: float, same: bool) -> Links:
    """Links between the rows of two trees (same: of one tree with itself); the second's rows are numbered after the first's."""
    limit, shift = math.sqrt(2 - 2 * cosine), 0 if same else len(one.x)
    links = Links(len(one.x) + (0 if same else len(two.x)))

    def whole(a: np.ndarray, b: np.ndarray, own: bool) -> None:
        links.count[a] += len(b) - own
        if not own:
            links.count[b + shift] += len(a)
        links.join(a, np.full(len(a), a[0]))
        links.join(b + shift, np.full(len(b), a[0]))

    def direct(a: np.ndarray, b: np.ndarray, ranks: tuple[np.ndarray, np.ndarray] | None, without: list[tuple[slice, slice]]) -> None:
        """All pairs of a and b, but for some stretches; with ranks only those of a lower and a higher rank."""
        right_side = two.x[b].T
        for k in range(0, len(a), TILE):
            hit = one.x[a[k : k + TILE]] @ right_side >= cosine
            for rows, columns in without:
                hit[max(0, rows.start - k) : max(0, rows.stop - k), columns] = False
            i, j = np.nonzero(hit)
            i += k
            if ranks is not None:
                kept = ranks[0][i] < ranks[1][j]
                i, j = i[kept], j[kept]
            if len(i):
                left, right = a[i], b[j] + shift
                links.count[:] += np.bincount(left, minlength=len(links.count)) + np.bincount(right, minlength=len(links.count))
                links.join(left, right)

    def parts(tree: CoverTree, node: int) -> np.ndarray:
        begin, end = tree.child[node]
        return np.arange(begin, end) if end > begin else np.array([node])

    rank = np.empty(len(one.x), np.int64)  # children's members follow each other in it
    rank[one.order] = np.arange(len(one.x))
    todo = [(np.array([0]), np.array([0]), same)]
    while todo:
        left, every, own = todo.pop()
        narrow = two.radius[every] <= limit / 8
        for right in (every[narrow], every[~narrow]):  # one bound for many nodes is tight where their radii are alike
            if not len(right):
                continue
            centres, widest = two.x[two.centre[right]].T, float(two.radius[right].max())
            for k in range(0, len(left), 512):
                a = left[k : k + 512]
                dots = one.x[one.centre[a]] @ centres
                i, j = np.nonzero(dots >= (1 - np.minimum(2, limit + one.radius[a] + widest + SLACK) ** 2 / 2 - SLACK)[:, None])
                p, q = a[i], right[j]
                apart, reach = np.sqrt(np.maximum(0, 2 - 2 * dots[i, j])), one.radius[p] + two.radius[q]
                open_ = apart - reach <= limit + SLACK
                if own:  # each pair of children once
                    open_ &= p <= q
                i, j, p, q, apart, reach = (x[open_] for x in (i, j, p, q, apart, reach))
                itself = (p == q) & same
                near = np.where(itself, 2 * one.radius[p], apart + reach) <= limit - SLACK
                small = [(t.child[n, 0] == t.child[n, 1]) | (t.member[n, 1] - t.member[n, 0] <= LEAF) for t, n in ((one, p), (two, q))]
                plain = ~near & small[0] & small[1]
                if plain.any():  # the members of all small nodes that are near to any, in one product
                    rows, columns = np.unique(i[plain]), np.unique(j[plain])
                    m, n = one.members_of(a[rows]), two.members_of(right[columns])
                    ends = [np.append(0, np.cumsum(t.member[x, 1] - t.member[x, 0])) for t, x in ((one, a[rows]), (two, right[columns]))]
                    other = ~plain & np.isin(i, rows) & np.isin(j, columns)
                    r, c = np.searchsorted(rows, i[other]), np.searchsorted(columns, j[other])
                    without = [(slice(ends[0][x], ends[0][x + 1]), slice(ends[1][y], ends[1][y + 1])) for x, y in zip(r, c)]
                    direct(m, n, (rank[m], rank[n]) if own else None, without)
                for x in np.flatnonzero(~plain):
                    if near[x]:
                        whole(one.members(int(p[x])), two.members(int(q[x])), bool(itself[x]))
                    else:
                        todo.append((parts(one, int(p[x])), parts(two, int(q[x])), bool(itself[x])))
    return links


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as got:
        return {k: got[k] for k in got.files}


def _placed(good: DataFrame, block_rows: int, seed: int) -> tuple[DataFrame | None, list[tuple]]:
    """Every vector with its cell and block (none without vectors), and for each cell its pivot, covering radius, first block and the one after its last. A cell's vectors have one length."""
    lengths = good.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()  # a row for each length of vectors
    parts, pivots, blocks = None, [], 0
    for r in lengths:
        d, rows = r["d"], max(1, min(block_rows, BLOCK_BYTES // (8 * r["d"])))
        own = good.where(F.col("d") == d)
        chosen = own.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(max(1, min(MAX_PIVOTS, -(-r["n"] // rows)))).collect()
        centres = unit(np.array([c["embedding"] for c in chosen], np.float64))
        centres = centres[_chain(centres)]  # near cells get near numbers, and so come into one group

        def near(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres, cells: int = len(pivots)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 4096):
                    part = batch.slice(k, 4096)
                    got = unit(matrix(part.column(1))) @ centres.T
                    best = got.argmax(1)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * got[np.arange(len(best)), best]))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best + cells, pa.int64()), pa.array(apart)], ["vec_id", "embedding", "cell", "apart"])

        one = cut(own.select("vec_id", "embedding").mapInArrow(near, "vec_id long, embedding array<double>, cell long, apart double"))
        found = {c["cell"]: c for c in one.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()}  # at most MAX_PIVOTS rows
        cells = range(len(pivots), len(pivots) + len(centres))
        chunks = [-(-found[c]["n"] // rows) if c in found else 1 for c in cells]
        begins = (blocks + np.cumsum([0, *chunks])).tolist()
        blocks = begins[-1]
        at = (F.col("cell") - len(pivots) + 1).cast("int")
        start, n = F.element_at(F.array(*map(F.lit, begins[:-1])), at), F.element_at(F.array(*map(F.lit, chunks)), at)
        one = one.withColumn("block", (start + F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), n)).cast("long"))
        parts = one if parts is None else parts.unionByName(one)
        pivots += [(p, found[c]["radius"] + SLACK if c in found else 0.0, s, s + k) for c, p, s, k in zip(cells, centres, begins, chunks)]
    return parts, pivots


def _chain(centres: np.ndarray) -> list[int]:
    """An order of a few centres in which each is followed by the nearest of the rest."""
    order, rest = [0], set(range(1, len(centres)))
    dots = centres @ centres.T
    while rest:
        left = sorted(rest)
        best = left[int(np.argmax(dots[order[-1], left]))]
        order.append(best)
        rest.remove(best)
    return order


def _near_groups(spark, pivots: list[tuple], limit: float) -> DataFrame:
    """i, j: the pairs of groups of SUPER blocks that can hold a link, i <= j, from the cells' covering radii.

    The cells are at most MAX_PIVOTS for each length of vectors; the groups of a cell are as many as its rows need.
    """
    near = []
    for i, (p, r, _, _) in enumerate(pivots):
        for j in range(i, len(pivots)):
            q, s = pivots[j][:2]
            if len(p) == len(q) and math.sqrt(max(0.0, 2 - 2 * float(p @ q))) - r - s <= limit + 1e-6:
                near.append((i, j))
    cells = spark.createDataFrame([(c, s // SUPER, (e - 1) // SUPER) for c, (_, _, s, e) in enumerate(pivots)], "c long, low long, high long")
    groups = cells.select("c", F.explode(F.sequence("low", "high")).alias("g"))
    pairs = spark.createDataFrame(near, "c1 long, c2 long")
    both = pairs.join(groups.select(F.col("c").alias("c1"), F.col("g").alias("g1")), "c1").join(groups.select(F.col("c").alias("c2"), F.col("g").alias("g2")), "c2")
    return both.select(F.least("g1", "g2").alias("i"), F.greatest("g1", "g2").alias("j")).distinct()


def near_pairs(vectors: DataFrame, cosine: float = 0.95, block_rows: int = BLOCK_ROWS, seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id, kept for each distinct non-null vec_id of `vectors`.

    Links are pairs with cosine >= the threshold, compared in double precision. Vectors that are null,
    empty or zero, or have a null or non-finite component, link with nothing; vectors link with those of
    their own length only. Of rows that repeat a vec_id the smallest vector counts. An empty table gives an empty result.
    """
    if not 0.5 < cosine < 1:
        raise ValueError("the threshold must lie between 0.5 and 1")
    spark = vectors.sparkSession
    good = cut(usable(vectors).withColumn("d", F.size("embedding")))
    all_ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    placed, pivots = _placed(good, block_rows, seed)
    if placed is None:
        return all_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def build(key, data):
        data = data.sort_by("vec_id")
        x = unit(matrix(data.column("embedding").combine_chunks()))
        blob = _pack(ids=data.column("vec_id").to_numpy(), **CoverTree(x).arrays())
        return pa.table({"block": [key[0].as_py()], "tree": pa.array([blob], pa.large_binary()).cast(pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []

        def links_of(p: dict, q: dict, same: bool) -> pa.RecordBatch:
            links = dual(CoverTree.of(p), CoverTree.of(q), cosine, same)
            ids = p["ids"] if same else np.concatenate([p["ids"], q["ids"]])
            root = links.settle()
            seen = np.flatnonzero(links.count)
            return pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(links.count[seen]), pa.array(ids[root[seen]])], ["vec_id", "links", "other"])

        for batch in batches:
            for k in range(batch.num_rows):
                now = batch.column("i")[k].as_py(), batch.column("j")[k].as_py()
                if now != pair:
                    pair, held = now, []
                tree = _unpack(batch.column("tree")[k].as_py())
                role, alone = batch.column("role")[k].as_py(), now[0] == now[1]
                if alone:
                    yield links_of(tree, tree, True)
                for other in held if role or alone else ():
                    if other["x"].shape[1] == tree["x"].shape[1]:
                        yield links_of(other, tree, False)
                if not role:
                    held.append(tree)

    with arrow_rows(spark, SUPER):  # a row holds a tree
        trees = cut(placed.groupBy("block").applyInArrow(build, "block long, tree binary")).withColumn("g", F.expr(f"block div {SUPER}"))
        pairs = cut(_near_groups(spark, pivots, math.sqrt(2 - 2 * cosine)))
        sides = pairs.select("i", "j", F.lit(0).alias("role"), F.col("i").alias("g")).unionByName(pairs.where("i <> j").select("i", "j", F.lit(1).alias("role"), F.col("j").alias("g")))
        work = sides.join(trees, "g").select("i", "j", "role", "block", "tree").repartition(min(4 * pairs.count(), MOST_TASKS), "i", "j").sortWithinPartitions("i", "j", "role", "block")
        found = cut(work.mapInArrow(run, "vec_id long, links long, other long"))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    groups = connected(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    out = all_ids.join(counts, "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
walk(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT w.a, l.b FROM walk w JOIN links l ON l.a = w.b),
low AS (SELECT a, min(b) AS component_id FROM walk GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON low.a = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
"""
