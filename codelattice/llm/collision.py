"""Operator 8: nearest neighbours by collision counting over single-projection sorted arrays.

Every vector, scaled to length 1, has one value on each of m random directions; a shard of vectors
keeps, for each direction, its values in ascending order. Around the query's own value a window is
opened that stands for a radius R; opening it further by virtual rehashing (R, then R times a factor)
only reads the rings that are new. A vector that lies in at least `threshold` of the m windows is
verified with its exact cosine. A vector within R of the query lies in each window with the same
known chance, so the threshold is set some standard deviations below the mean count: at least nine in
ten of such vectors are verified, and more as the radius at which a search stops is beyond most of them. A query stops when its k-th best verified distance is at most R, as any better
vector would then lie within R. There is no cap on candidates. All rows are indexed.

A task holds one shard and indexes it once; the queries come to it as a stream. Copies of a vector are
one point of the index, and their scores are sums in a fixed order, so ties are exact wherever they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut
from .vectors import distinct_rows, matrix, unit, usable

DIRECTIONS = 96
HALF_WIDTH = 1.0  # of a window, as a share of the radius it stands for
#: Radii grow by the first factor up to NEAR, where few vectors lie, and by the second from there.
FIRST_RADIUS, NEAR, FACTORS = 0.1, 0.7, (1.5, 1.07)
#: A shard has at most so many rows, and bytes of vectors; so many tasks share its queries.
SHARD_ROWS, SHARD_BYTES, LANES = 32_768, 1 << 26, 4
#: Queries that are looked up together; rows sent to Python at once.
QUERY_ROWS, ARROW_ROWS = 256, 2_048
DEVIATIONS = 1.3


def directions(dimension: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, m))


def threshold(m: int) -> int:
    """Windows that a vector within the radius shares, but for about one in ten."""
    chance = math.erf(HALF_WIDTH / math.sqrt(2))
    return max(1, math.floor(m * chance - DEVIATIONS * math.sqrt(m * chance * (1 - chance))))


def radii() -> list[float]:
    """The radii of virtual rehashing; the last holds every vector of length 1."""
    out = [FIRST_RADIUS]
    while out[-1] < 2:
        out.append(out[-1] * FACTORS[out[-1] >= NEAR])
    return out


class Shard:
    """Sorted projections of the distinct vectors of a shard. ids ascend."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, sides: np.ndarray):
        first, group = distinct_rows(x)
        self.ids, self.x, self.sides = ids, x[first], sides
        self.members = np.argsort(group, kind="stable")  # rows by distinct vector, ids ascending
        self.bounds = np.append(0, np.cumsum(np.bincount(group, minlength=len(first))))
        values = (self.x @ sides).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(values, self.order, axis=1)
        self.group = group

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """For each query its id, ids and cosines of the k best found, best first, and how many distinct vectors were verified."""
        at, steps = queries @ self.sides, radii()
        width = np.array(steps) * HALF_WIDTH
        m = len(self.values)
        low, high = np.empty((len(queries), len(steps), m), np.int32), np.empty((len(queries), len(steps), m), np.int32)
        for i in range(m):  # the bounds of all windows, by direction
            low[:, :, i] = np.searchsorted(self.values[i], at[:, i, None] - width)
            high[:, :, i] = np.searchsorted(self.values[i], at[:, i, None] + width, side="right")
        for q, query_id in enumerate(query_ids.tolist()):
            own = int(np.searchsorted(self.ids, query_id))
            skip = own < len(self.ids) and self.ids[own] == query_id
            yield query_id, *self._one(queries[q], low[q], high[q], steps, own if skip else -1, k)

    def _one(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, steps: list[float], own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        n, need = len(self.x), threshold(len(self.values))
        counts, done = np.zeros(n, np.int64), np.zeros(n, bool)
        groups, cosine, verified = np.empty(0, np.int64), np.empty(0), 0
        sizes = np.minimum(np.diff(self.bounds), k + 1)  # of a vector's copies only so many can be among the k best
        if own >= 0:
            sizes[self.group[own]] -= 1
        for step, radius in enumerate(steps):
            a, b = low[step], high[step]
            if step:
                c, d = low[step - 1], high[step - 1]
                rings = [self.order[i, a[i] : c[i]] for i in np.flatnonzero(a < c)] + [self.order[i, d[i] : b[i]] for i in np.flatnonzero(d < b)]
            else:
                rings = [self.order[i, a[i] : b[i]] for i in np.flatnonzero(a < b)]
            if rings:
                counts += np.bincount(np.concatenate(rings), minlength=n)
            fresh = np.flatnonzero((counts >= need) & ~done) if radius < 2 else np.flatnonzero(~done)
            if len(fresh):
                done[fresh] = True
                verified += len(fresh)
                groups, cosine = np.append(groups, fresh), np.append(cosine, self.x[fresh] @ query)
                if len(groups) > k + 1:  # one more, as the query's own may have no copy; ties with the last stay
                    kept = cosine >= np.partition(cosine, len(cosine) - k - 1)[len(cosine) - k - 1] - 1e-9
                    groups, cosine = groups[kept], cosine[kept]
            if verified == n:
                break
            best = np.argsort(-cosine)
            enough = np.flatnonzero(np.cumsum(sizes[groups[best]]) >= k)
            if len(enough) and math.sqrt(max(0.0, 2 - 2 * cosine[best[enough[0]]])) <= radius:
                break
        rows = [self.members[self.bounds[g] : min(self.bounds[g + 1], self.bounds[g] + k + 1)] for g in groups]
        exact = np.repeat((self.x[groups] * query).sum(axis=1), [len(r) for r in rows])  # each sum by itself, in one order
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        other = rows != own
        ids, exact = self.ids[rows[other]], exact[other]
        best = np.lexsort((ids, -exact))[:k]
        return ids[best], exact[best], verified


def search(vectors: DataFrame, query_every: int = 50, k: int = 5, seed: int = 23, m: int = DIRECTIONS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score (cosine, double) and verified (distinct vectors compared for the query in all).

    Queries are the rows whose vec_id is divisible by query_every, candidates all rows but the query's
    own, of the query's length. A query with fewer than k candidates gets them all; without any it has no row.
    Vectors null, empty, zero, or with null or non-finite components take no part; of rows that repeat a
    vec_id the smallest vector counts. Ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    good = cut(usable(vectors).withColumn("d", F.size("embedding")))
    asks = F.col("vec_id") % query_every == 0
    lengths = good.groupBy("d").agg(F.count("*").alias("n"), F.count_if(asks).alias("q")).where("q > 0").orderBy("d").collect()  # a row for each length of vectors
    plan, shards = [], 0
    for r in lengths:
        of = -(-r["n"] // max(1, min(shard_rows, SHARD_BYTES // (8 * r["d"]))))
        plan.append((r["d"], shards, of))
        shards += of
    if not plan:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    # rows of a length are dealt to its shards by hash; each row goes to the LANES tasks of its shard, each query to one task of every shard
    placed = good.join(F.broadcast(spark.createDataFrame(plan, "d int, first long, shards long")), "d")
    lane = F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(LANES))
    base = placed.select((F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("shards"))).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))).alias("lane"), F.lit(0).alias("role"), "vec_id", "embedding")
    asked = placed.where(asks).select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)).alias("shard"), lane.alias("lane"), F.lit(1).alias("role"), "vec_id", "embedding")
    rows = base.unionByName(asked).select((F.col("shard") * LANES + F.col("lane")).cast("int").alias("part"), "role", "vec_id", "embedding")
    work = rows.repartitionById(shards * LANES, F.col("part")).sortWithinPartitions("part", "role", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, held = None, [], []
        for batch in batches:
            for k0 in range(0, batch.num_rows, QUERY_ROWS):
                rows = batch.slice(k0, QUERY_ROWS)
                role = rows.column(1).to_numpy()
                n = int(np.searchsorted(role, 1))
                if n:
                    ids.append(rows.column(2).slice(0, n).to_numpy())
                    held.append(matrix(rows.column(3).slice(0, n)))
                if n == len(role):
                    continue
                if shard is None and not held:
                    continue  # no row was dealt to this shard
                if shard is None:
                    x = unit(np.concatenate(held))
                    shard, held = Shard(np.concatenate(ids), x, directions(x.shape[1], m, seed)), []
                out = [(query_id, int(v), float(c), verified if not i else 0) for query_id, found, cosine, verified in shard.search(rows.column(2).slice(n).to_numpy(), unit(matrix(rows.column(3).slice(n))), k) for i, (v, c) in enumerate(zip(found, cosine))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["query_id", "vec_id", "score", "verified"])

    with arrow_rows(spark, ARROW_ROWS):
        found = cut(work.mapInArrow(run, "query_id long, vec_id long, score double, verified long"))
    by_query = Window.partitionBy("query_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).withColumn("verified", F.sum("verified").over(by_query))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")
