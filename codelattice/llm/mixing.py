"""Operator 10 [DataFrame only]: sources mixed to target weights by Poisson replication.

Each source gets the mean repetition rate that brings it to its share. A document's number of copies
is the inverse of the Poisson distribution with that rate at a uniform number made from a hash of
seed and doc_id, so it depends on nothing else: neither partitions nor retries change it. Copies are
dealt to partitions by a second hash and sorted by it there, which is a global shuffle without a
sampling pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, wide

#: One draw has a rate of at most this, as exp(-rate) must not vanish; a larger rate is the sum of several draws.
LARGEST_RATE = 256.0
SEED = 20
#: Sources whose rates are sent to all tasks; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def uniform(*parts: "Column | str") -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 sum of the parts, joined by colons."""
    digest = F.md5(F.concat_ws(":", *[F.lit(x) if isinstance(x, str) else x for x in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array, as far as it can matter to a 52-bit number."""
    last = (F.ceil(rate + 12 * F.sqrt(rate)) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["c"])


def rates(docs: DataFrame, weights: DataFrame | None = None, size: float = 1.0, source: str = "source") -> DataFrame:
    """source, rate: mean copies of a document that bring the mix to `size` times the rows of docs.

    weights: source, weight (not negative; they needn't sum to 1); a source without a weight gets
    none. By default every source that occurs weighs the same. A null source is a source of its own.
    """
    sizes = docs.groupBy(F.col(source).cast("string").alias("m_source")).agg(F.count("*").alias("m_n"))
    if weights is None:
        weighed = sizes.withColumn("m_weight", F.lit(1.0))
    else:
        w = weights.groupBy(F.col("source").cast("string").alias("m_of")).agg(F.max(F.greatest(F.lit(0.0), F.col("weight").cast("double"))).alias("m_weight"))
        weighed = sizes.join(w, sizes["m_source"].eqNullSafe(w["m_of"]), "left").select("m_source", "m_n", F.coalesce("m_weight", F.lit(0.0)).alias("m_weight"))
    total = weighed.agg(F.sum("m_n").alias("rows"), F.sum("m_weight").alias("weights")).head()
    if not total["weights"]:
        return weighed.select("m_source", F.lit(0.0).alias("m_rate"))
    return weighed.select("m_source", (F.col("m_weight") / F.lit(float(total["weights"])) * F.lit(total["rows"] * size) / F.col("m_n")).alias("m_rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, size: float = 1.0, source: str = "source", seed: int = SEED) -> DataFrame:
    """docs replicated to the target weights, globally shuffled; adds copy (from 1) and shuffle_key.

    Rows that repeat a doc_id get the same number of copies each; a null doc_id counts as an empty one;
    null and empty texts are replicated like any other; an empty table stays empty. All columns of docs stay,
    whatever their names, but for columns named copy or shuffle_key, which the new ones replace.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # own names inside, so that none can clash
    rows = docs.toDF(*inner.values())
    parts = F.ceil(F.col("m_rate") / LARGEST_RATE).cast("int")
    table = cut(rates(docs, weights, size, source)).where("m_rate > 0").withColumn("m_draws", parts).withColumn("m_steps", poisson_steps(F.col("m_rate") / F.col("m_draws")))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    name = F.coalesce(F.col(inner["doc_id"]).cast("string"), F.lit(""))
    joined = rows.join(table, F.col(inner[source]).cast("string").eqNullSafe(F.col("m_source")))
    draws = F.aggregate(
        F.sequence(F.lit(1), F.col("m_draws")), F.lit(0),
        lambda n, k: n + F.size(F.filter("m_steps", lambda c: c <= uniform(str(seed), name, k.cast("string")))),
    )
    one = uniform(str(seed), name, "1")
    counted = joined.withColumn("m_u", one).withColumn("m_copies", F.when(F.col("m_draws") == 1, F.size(F.filter("m_steps", lambda c: c <= F.col("m_u")))).otherwise(draws))
    copies = counted.where("m_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m_copies").cast("long"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed} order"), name, F.col("copy").cast("string"))))
    n = wide(docs.sparkSession)
    place = F.pmod(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * n, F.lit(1 << 62)) / F.lit(float(1 << 32))
    placed = keyed.select(*inner.values(), "copy", "shuffle_key", F.floor(place).cast("int").alias("m_place")).repartitionById(n, F.col("m_place"))
    kept = [F.col(i).alias(c) for c, i in inner.items() if c.lower() not in ("copy", "shuffle_key")]
    return placed.sortWithinPartitions("shuffle_key", inner["doc_id"], "copy").select(*kept, "copy", "shuffle_key")


ORACLE = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE) * ((SELECT sum(n) FROM sizes)::DOUBLE * 1.0) / n::DOUBLE AS rate FROM sizes),
steps(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k + 1 <= ceil(rate + 12 * sqrt(rate)) + 30),
lists AS (SELECT source, list(c ORDER BY k) AS cs FROM steps GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(l.cs, lambda c: c <= ('0x' || substr(md5('{SEED}:' || d.doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0)) AS copies
  FROM documents d JOIN lists l USING (source)),
spread AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1)) AS copy FROM drawn WHERE copies > 0)
SELECT *, md5('{SEED} order:' || doc_id || ':' || copy) AS shuffle_key FROM spread
"""
